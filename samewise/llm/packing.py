"""Packing of documents into fixed windows by minimum bin slack.

A document's ids are cut at multiples of the window, so all but its last piece fill windows alone; what
is packed are the remainders. Remainders of one length are alike, so the plan is made on the histogram
of lengths (window - 1 numbers at any size of the corpus): for each window a bitset subset-sum dynamic
programme, over the lengths still there and their counts, finds the multiset that comes closest to the
capacity; it is backtracked to counts and used as often as the stock allows. Each such round uses up
some length, so the plan is bounded by the window too. Documents then take their places by rank
within their length, which is counted in salted parts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, checkpointed, gathered, give_back, pieces, split_up, tidied

#: Bound of the memo of one task, in entries.
MOST_WORDS = 600_000


def fullest(stock: dict[int, int], capacity: int) -> dict[int, int]:
    """The counts of lengths, the largest length in stock among them, whose sum comes closest to capacity from below.

    Bit s of a bitset is set if some choice of the lengths so far sums to s. Copies of a length go in
    by powers of two; the bitset before each step is kept to read the choice off backwards.
    """
    first = max(stock)
    reached, steps = 1 << first, []
    for length in sorted(stock, reverse=True):
        left, share = min(stock[length] - (length == first), (capacity - first) // length), 1
        while left > 0:
            k = min(share, left)
            more = reached | reached << (k * length) & (1 << capacity + 1) - 1
            if more != reached:
                steps.append((length, k, reached))
                reached = more
            left, share = left - k, share * 2
        if reached >> capacity & 1:
            break
    at, chosen = reached.bit_length() - 1, {first: 1}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + k
            at -= k * length
    return chosen


def plan(stock: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Places for all pieces. Per length, rows (rank0, window0, copies, offset): from rank0 on, pieces
    go by `copies` into the windows from window0 on, the first of a window at `offset`. And the number of windows."""
    stock = {k: n for k, n in stock.items() if n > 0}
    used, places, windows = dict.fromkeys(stock, 0), {k: [] for k in stock}, 0
    while stock:
        chosen = fullest(stock, capacity)
        times, offset = min(stock[k] // n for k, n in chosen.items()), 0
        for k, n in chosen.items():
            places[k].append((used[k], windows, n, offset))
            offset += k * n
            used[k] += n * times
            stock[k] -= n * times
            if not stock[k]:
                del stock[k]
        windows += times
    return places, windows


class WordIds:
    """Ids of whole texts by a tokenizers file; words between white space are encoded once while in the memo.

    White space is what the tokenizer's own pre-tokenizer drops, so no token reaches over it, and a
    text's ids are those of its words. It also splits letters from marks after them, so words are cut there, and
    words of letters alone that are new are encoded together: each ends with the one token that
    has the end-of-word suffix. Latin words, whose lower case has no exceptions, pass the normaliser by.
    Where a file does not split so, whole texts are encoded.
    """

    #: Marks after a Latin letter or digit and before a space. Elsewhere, lower case or normal form can end in a combining mark.
    MARK = re.compile(r"[!-&(-/:-@[-`{-~](?<=[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f].)[!-&(-/:-@[-`{-~]*(?=[ \n]|\Z)")

    def __init__(self, path: str) -> None:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        conf = json.loads(self.tokenizer.to_str())
        steps = (conf["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        pattern = steps[0].get("pattern", {}).get("Regex", "") if steps[0].get("behavior") == "Removed" and steps[0].get("invert") else ""
        self.by_word = "[^\\s" in pattern and "\\p{L}" in pattern and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in conf["added_tokens"])
        suffix = conf["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.level = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(128, 0x180)}
        normal = [x["type"] for x in (conf["normalizer"] or {}).get("normalizers", [])]
        self.plain = normal == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"] and not steps[1]["add_prefix_space"]
        self.added = [t["content"] for t in conf["added_tokens"]]
        self.memo = Memo(MOST_WORDS)

    @staticmethod
    def of(tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded(self, words: list[str]) -> list[bytes]:
        """Ids of each of some distinct words, as bytes."""
        known: dict[str, bytes] = {}
        letters = [w for w in words if w.isalpha()]
        lower = {w: w.lower() if w.isascii() else w.lower().translate(self.level) for w in letters if self.plain and (w.isascii() or max(w) < "\u0180" and "\u0130" not in w)}
        for tokenizer, own in ((self.bare, list(set(lower.values()))), (self.tokenizer, [w for w in letters if w not in lower])):
            for a in range(0, len(own), 2000):
                some = own[a : a + 2000]
                (ids,) = self.of(tokenizer, [" ".join(some)])
                at = np.append(0, 4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
                if len(at) == len(some) + 1 and at[-1] == 4 * len(ids):
                    raw = ids.tobytes()
                    known.update(zip(some, map(raw.__getitem__, map(slice, at, at[1:]))))
        found = [known.get(lower.get(w, w)) for w in words]
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(rest, self.of(self.tokenizer, [words[i] for i in rest])):
            found[i] = ids.tobytes()
        return found

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, as little-endian unsigned 32-bit numbers, and where each text ends."""
        if not self.by_word:
            found = self.of(self.tokenizer, [t or "" for t in texts])
            return np.concatenate([np.zeros(0, "<u4"), *found]), np.cumsum([0, *map(len, found)])[1:]
        texts = [t if any(map(t.__contains__, self.added)) else self.MARK.sub(r" \g<0>", t) for t in (t or "" for t in texts)]
        words, places, ends = split_up([t.replace("\n", " ") for t in texts], " ")
        known = self.memo.known(words)
        new = [i for i, ids in enumerate(known) if ids is None]
        names = [words[i] for i in new]
        encoded = self.encoded(names)
        for i, ids in zip(new, encoded):
            known[i] = ids
        self.memo.add(names, encoded)
        ids, after = gathered(known, places)
        return ids, np.append(0, after)[ends]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cut(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, salt) of the pieces of each document and its end id, cut at multiples of capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encode, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        try:
            for batch in pieces(batches, "text"):
                take, out = [], []
                every, ends = encode.batch(batch.column("text").to_pylist())
                for row, (begin, until) in enumerate(zip(np.append(0, ends), ends)):
                    ids = every[begin:until].tobytes() + end
                    n = len(ids) // 4
                    for a in range(0, n, capacity):
                        take.append(row)
                        out.append((a, min(capacity, n - a), zlib.crc32(ids[4 * a : 4 * (a + capacity)]), n))
                del every, ids
                give_back()
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(take, pa.int64())), *[pa.array(x, pa.int64()) for x in zip(*out)]], ["id", "start", "length", "ids_crc32", "doc_tokens"])
        finally:
            encode.memo.clear()  # Spark keeps more workers than it has tasks, and deals tasks to them in turn

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long").withColumnRenamed("id", id_col)


def packed(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", salts: int = 256) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one per piece.

    A null or empty text is its end id alone. Repeated rows are pieces of their own, and ties in a rank go by id, place and digest.
    An empty table gives an empty one. Other columns go, whatever their names. The
    tokenized pieces are checkpointed (a few numbers each), since their histogram comes before their
    places; the driver sees the histogram, at most capacity rows, and nothing else.
    """
    part = F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(salts)).cast("int")
    rows = checkpointed(cut(docs, tokenizer, capacity, end_id, id_col, text_col).withColumn("_salt", part))
    counts = checkpointed(rows.groupBy("length", "_salt").agg(F.count("*").alias("n")))
    places, _ = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = counts.select(F.col("length").alias("_length"), F.col("_salt").alias("_part"), (F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).alias("_before"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(id_col, "start", "ids_crc32")) - 1)
    ranked = ranked.join(before, F.expr("length = _length AND _salt = _part")).select(id_col, "start", "length", "ids_crc32", "doc_tokens", (F.col("_before") + F.col("_rank")).alias("rank"))
    tables = {k: np.array(v, np.int64) for k, v in places.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            window, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                at, own = np.flatnonzero(length == k), tables[int(k)]
                row = own[np.searchsorted(own[:, 0], rank[at], "right") - 1]
                nth = rank[at] - row[:, 0]
                window[at], offset[at] = row[:, 1] + nth // row[:, 2], row[:, 3] + nth % row[:, 2] * k
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(window), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(run, f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
