"""Removal of byte strings that an earlier document has, by blockwise suffix sorting.

Every window of `width` bytes has a minimizer, the least hash of its grams; consecutive windows with the
same one are a run, and equal windows always lie in runs of the same minimizer. So the work is dealt
by minimizers, in four steps of which each task holds a bounded block:

1. seeds: minimizers of each document go to a bucket of their range, packed; a bucket returns those that
   two documents have to the groups of documents (by hashed id) that have them, and marks the frequent.
2. runs: a group of documents sends the distinct runs with shared minimizers, each with the least id that
   has it there, to the buckets of their minimizers. Runs of frequent minimizers are sent window by
   window to buckets of the windows' own hashes, so no common line gathers in one task.
3. sorting: a bucket sorts the suffixes of its distinct runs block by block. Suffixes are dealt by their
   first word; long ties within such a suffix bucket are settled by the ranks of a difference-cover
   sample, sorted beforehand: any two suffixes have a common shift below the period at which both are
   in the sample. Neighbours that agree in `width` bytes are one window, whose least document is found.
4. cutting: the group marks each window whose least document is smaller than its own, and cuts the text.

Only whole-corpus figures are collected (rows and bytes); texts are shuffled once, by group.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, pieces, released, tidied

WIDTH, GRAM = 50, 20
#: Windows of a run at most, and documents with a minimizer from which it counts as frequent.
LONGEST_RUN, FREQUENT = 256, 2048
#: Bytes of text of a group of documents, of text whose seeds one bucket holds, and of a block of suffixes.
GROUP, BUCKET, BLOCK = 4 << 20, 4 << 20, 1 << 20
#: Period and residues of the difference cover: every difference modulo 7 is one of two residues.
PERIOD, COVER = 7, (0, 1, 3)
BASE = 0x9E3779B97F4A7C15 | 1
U64 = np.uint64


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as compressed byte planes."""
    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), a.dtype.itemsize)]], "<u8").tobytes()
    body = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + body)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = int(raw[:8].view("<u8")[0])
    sizes = raw[8 : 8 + 16 * n].view("<u8").reshape(n, 2).astype(int)
    out, at = [], 8 + 16 * n
    for length, width in sizes:
        out.append(np.ascontiguousarray(raw[at : at + length * width].reshape(width, length).T).reshape(-1).view(f"<u{width}"))
        at += length * width
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(29))


def runs_of(texts: list[bytes], at_once: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per text with windows: (its number, starts, windows, hashed minimizers) of its runs."""
    own, size = [], 0
    for i, t in enumerate(texts):
        if len(t) >= WIDTH:
            own.append(i)
            size += len(t)
        if own and (size >= at_once or i == len(texts) - 1):
            yield from _runs(texts, own)
            own, size = [], 0


def _runs(texts: list[bytes], own: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    lengths = np.array([len(texts[i]) for i in own])
    ends = np.cumsum(lengths)
    h = np.frombuffer(b"".join([texts[i] for i in own]), np.uint8).astype(U64)
    sizes, power, size = {1: h}, BASE, 1
    while size * 2 <= GRAM:
        h = h[:-size] * U64(power) + h[size:]
        size, power = size * 2, power * power & (1 << 64) - 1
        sizes[size] = h
    done = size
    for part in sorted((s for s in sizes if GRAM - size & s), reverse=True):  # the rest of GRAM in powers of two
        h = h[: len(h) - part] * U64(pow(BASE, part, 1 << 64)) + sizes[part][done : done + len(h) - part]
        done += part
    h, span, steps = mixed(h), 1, WIDTH - GRAM + 1
    while span * 2 <= steps:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if span < steps:
        h = np.minimum(h[: len(h) - (steps - span)], h[steps - span :])
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    for i, end, length in zip(own, ends.tolist(), lengths.tolist()):
        begin, n = end - length, length - WIDTH + 1
        here = new[begin : begin + n].copy()
        here[0] = True
        starts = np.flatnonzero(here)
        windows = np.diff(np.append(starts, n))
        if windows.max() > LONGEST_RUN:
            parts = -(-windows // LONGEST_RUN)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            starts, left = np.repeat(starts, parts) + nth * LONGEST_RUN, np.repeat(windows, parts) - nth * LONGEST_RUN
            windows = np.minimum(left, LONGEST_RUN)
        yield i, starts, windows, mixed(h[begin + starts])


def seeds(docs: DataFrame, groups: int, buckets: int, bits: int) -> DataFrame:
    """(bucket, data): packed (key, group, documents) of the minimizers of the documents, keys of `bits` bits."""

    def flush(keys: list, owners: list) -> Iterator[pa.RecordBatch]:
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
        count = np.minimum(np.diff(np.append(first, len(key))), 65535).astype("<u2")
        key, owner = key[first], owner[first]
        bucket = bucket_of(key, buckets, bits)
        edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        out = []
        for a, b in zip(edges, np.append(edges[1:], len(key))):
            out.append(pack(np.diff(key[a:b], prepend=U64(0)), owner[a:b], count[a:b]))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edges].astype(np.int32)), pa.array(out, pa.binary())], ["bucket", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, held = [], [], 0
        for batch in pieces(batches, "text"):
            rows = sorted(zip(batch.column("doc_id").to_pylist(), batch.column("group").to_pylist(), batch.column("text").to_pylist()))
            least: dict[bytes, int] = {}
            for _, group, text in rows:
                least.setdefault(text.encode(), group)  # of copies only the one of the least id is compared later on
            texts, groups_of = list(least), list(least.values())
            for i, _, _, m in runs_of(texts):
                keys.append(np.unique(m >> U64(64 - bits)))
                owners.append(np.full(len(keys[-1]), groups_of[i], "<u4"))
                held += len(keys[-1])
            if held >= 2_000_000:
                yield from flush(keys, owners)
                keys, owners, held = [], [], 0
        if held:
            yield from flush(keys, owners)

    return docs.select("doc_id", "group", "text").mapInArrow(tidied(run), "bucket int, data binary")


def bucket_of(key: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    top = min(bits, 31)
    return (key >> U64(bits - top)) * U64(buckets) >> U64(top)


def shared(found: DataFrame, frequent: int) -> DataFrame:
    """(group, kind, data): of each bucket, packed keys that two documents have, for each group that has them, and which are frequent."""

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(d) for d in rows["data"]]
        key, owner, count = np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        del parts
        order = np.argsort(key, kind="stable")
        key, owner, count = key[order], owner[order], count[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        total = np.repeat(np.add.reduceat(count.astype(np.int64), first), np.diff(np.append(first, len(key))))
        two = total > 1
        key, owner, often = key[two], owner[two], (total[two] >= frequent).astype("u1")
        order = np.lexsort((key, owner))
        key, owner, often = key[order], owner[order], often[order]
        edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.empty(0, int)
        out = [pack(np.diff(key[a:b], prepend=U64(0)), often[a:b]) for a, b in zip(edges, np.append(edges[1:], len(key)))]
        return pd.DataFrame({"group": owner[edges].astype(np.int64), "kind": "keys", "data": out})

    return found.groupBy("bucket").applyInPandas(lambda rows: released(meet(rows)), "group long, kind string, data binary")


class Group:
    """The documents of one group, and the distinct runs that must be compared."""

    def __init__(self, texts: pa.Table, notes: pa.Table, bits: int) -> None:
        kinds, data = notes.column("kind").to_pylist(), notes.column("data").to_pylist()
        rows = sorted(((i is None, i or 0, (t or "").encode(), n) for n, (i, t) in enumerate(zip(texts.column("doc_id").to_pylist(), texts.column("text").to_pylist()))))
        self.ids = [None if none else i for none, i, _, _ in rows]
        self.texts = [t for _, _, t, _ in rows]
        self.order = [n for _, _, _, n in rows]
        later = {(i, n) for d, k in zip(data, kinds) if k == "copies" for i, n in zip(*(x.tolist() for x in unpack(d)))}
        # a copy of an earlier document goes whole if a window fits in it
        self.whole = [len(t) >= WIDTH and i is not None and (i & (1 << 64) - 1, len(t)) in later for i, t in zip(self.ids, self.texts)]
        keys = [unpack(d) for d, k in zip(data, kinds) if k == "keys"]
        key, often = (np.concatenate([np.cumsum(k[0]) for k in keys]), np.concatenate([k[1] for k in keys])) if keys else (np.empty(0, U64), np.empty(0, "u1"))
        key, at = np.unique(key, return_index=True)
        often = often[at]
        self.answers = [unpack(d) for d, k in zip(data, kinds) if k == "answers"]
        own = [i for i, t in enumerate(self.texts) if not self.whole[i] and self.ids[i] is not None]
        #: Distinct strings in order of the first document that has them: (text, its least id, minimizer, frequent).
        self.number: dict[bytes, int] = {}
        self.least: list[int] = []
        self.minimizer: list[int] = []
        self.often: list[bool] = []
        #: Where they are, four numbers each: document, start, windows, number; of a frequent run -1 - its place in `runs`.
        self.places = array("q")
        #: Distinct frequent runs, and the numbers of the windows of each.
        self.runs: dict[bytes, int] = {}
        self.windows: list[array] = []
        if not len(key):
            return
        for k, starts, windows, m in runs_of([self.texts[i] for i in own]):
            doc, text, short = own[k], self.texts[own[k]], m >> U64(64 - bits)
            at = np.minimum(np.searchsorted(key, short), len(key) - 1)
            for j in np.flatnonzero(key[at] == short).tolist():
                a, n = int(starts[j]), int(windows[j])
                run = text[a : a + n + WIDTH - 1]
                if not often[at[j]]:
                    number = self.known(run, doc, int(m[j]), False)
                else:
                    place = self.runs.setdefault(run, len(self.windows))
                    if place == len(self.windows):
                        self.windows.append(array("I", [self.known(run[b : b + WIDTH], doc, 0, True) for b in range(n)]))
                    number = -1 - place
                self.places.extend((doc, a, n, number))

    def known(self, text: bytes, doc: int, minimizer: int, often: bool) -> int:
        number = self.number.setdefault(text, len(self.least))
        if number == len(self.least):
            self.least.append(self.ids[doc])
            self.minimizer.append(minimizer)
            self.often.append(often)
        return number

    def questions(self, group: int, buckets: int) -> pa.Table:
        """(bucket, group, data): the distinct strings, packed for the buckets of their minimizers or, of frequent ones, of themselves."""
        n = len(self.least)
        texts = list(self.number)
        deal = np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") if o else m for t, m, o in zip(texts, self.minimizer, self.often)], U64)
        bucket = (mixed(deal) >> U64(33)) % U64(buckets)
        order = np.lexsort((deal, bucket))
        edges = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])) if n else []
        size, least = np.array([len(t) for t in texts], "<u4"), np.array(self.least, np.int64).view("<u8")
        out = []
        for a, b in zip(edges, np.append(edges[1:], n) if n else []):
            own = order[a:b]
            out.append(pack(np.frombuffer(b"".join([texts[i] for i in own]), np.uint8), size[own], (deal[own] >> U64(32)).astype("<u4"), least[own], own.astype("<u4")))
        return pa.table({"bucket": pa.array(bucket[order[edges]].astype(np.int64) if n else [], pa.int64()), "group": pa.array([group] * len(out), pa.int64()), "data": pa.array(out, pa.binary())})

    def cut(self) -> pa.Table:
        """(doc_id, n_bytes, n_removed, n_spans, kept, kept_text): what is left once the windows are gone that a smaller id has."""
        least: list = list(self.least)
        for number, windows, values in self.answers:
            values, at = values.view(np.int64), 0
            for i, n in zip(number.tolist(), windows.tolist()):
                least[i] = int(values[at]) if n == 1 else values[at : at + n]
                at += n
        frequent = [np.array([least[i] for i in own], np.int64) for own in self.windows]
        marks: dict[int, list[tuple[int, int]]] = {}
        for doc, start, windows, number in np.frombuffer(self.places, np.int64).reshape(-1, 4).tolist():
            of, own = least[number] if number >= 0 else frequent[-1 - number], self.ids[doc]
            if isinstance(of, int):
                if of < own:
                    marks.setdefault(doc, []).append((start, start + windows + WIDTH - 1))
            elif (of < own).any():
                hit = np.flatnonzero(np.diff(np.concatenate([[0], of < own, [0]])))
                marks.setdefault(doc, []).extend((start + int(a), start + int(b) + WIDTH - 1) for a, b in zip(hit[::2], hit[1::2]))
        removed, spans, kept, whole = [], [], [], []
        for doc, text in enumerate(self.texts):
            if self.whole[doc]:
                removed.append(len(text))
                spans.append(1)
                kept.append(b"")
                whole.append("")
                continue
            left, end, gone, n = [], 0, 0, 0
            for a, b in sorted(marks.get(doc, ())):
                if a > end or not n:
                    left.append(text[end:a])
                    n, gone, end = n + 1, gone + b - a, b
                elif b > end:
                    gone, end = gone + b - end, b
            left.append(text[end:])
            removed.append(gone)
            spans.append(n)
            kept.append(b"".join(left))
            whole.append("".join(x.decode(errors="ignore") for x in left))  # what a cut leaves of a character goes
        return pa.table({"doc_id": pa.array(self.ids, pa.int64()), "n_bytes": pa.array([len(t) for t in self.texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary()), "kept_text": pa.array(whole, pa.string())})


def words_of(text: np.ndarray) -> np.ndarray:
    """For each position the next eight bytes as one big-endian number; past the end there are zeros."""
    padded = np.concatenate([text, np.zeros(7, np.uint8)])
    out = np.zeros(len(text), U64)
    for k in range(8):
        out = out << U64(8) | padded[k : k + len(text)]
    return out


def shifts() -> np.ndarray:
    """shift[r, s]: the least d with r + d and s + d both in the cover, modulo its period."""
    return np.array([[next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (s + d) % PERIOD in COVER) for s in range(PERIOD)] for r in range(PERIOD)])


SHIFT = shifts()


def sorted_windows(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The window starts of one block in order of their WIDTH bytes, and where a window differs from the one before.

    text must go on for WIDTH + PERIOD bytes after the last start.
    """
    word = words_of(text)
    steps = [*range(8, WIDTH - 7, 8), WIDTH - 8]
    # ranks of the cover sample: all positions whose residue is in the cover, by their first WIDTH bytes
    residue = np.arange(len(text)) % PERIOD
    sample = np.flatnonzero(np.isin(residue, COVER) & (np.arange(len(text)) < len(text) - WIDTH))
    order = np.lexsort([word[sample + d] for d in reversed([0, *steps])])
    sample = sample[order]
    new = np.zeros(len(sample), bool)
    for d in [0, *steps]:
        w = word[sample + d]
        new[1:] |= w[1:] != w[:-1]
    rank = np.zeros(len(text), np.int64)
    rank[sample] = np.cumsum(new)
    # suffix buckets by the first word; eight bytes are more than any shift of the cover
    order = np.argsort(word[starts], kind="stable")
    starts = starts[order]
    first = word[starts]
    bucket = np.cumsum(np.append(False, first[1:] != first[:-1]))
    ties = np.bincount(bucket)[bucket] > 1
    place = np.zeros(len(starts), np.int64)
    tied = np.flatnonzero(ties)
    span = int(rank.max(initial=0)) + 1
    kind = starts[tied] % PERIOD
    of = [tied[kind == r] for r in range(PERIOD)]
    for r in range(PERIOD):
        for s in range(PERIOD):
            if len(of[r]) and len(of[s]):
                d = SHIFT[r, s]
                there = np.sort(bucket[of[s]] * span + rank[starts[of[s]] + d])
                place[of[r]] += np.searchsorted(there, bucket[of[r]] * span + rank[starts[of[r]] + d])
    # a place counts the tied windows that sort before, so it also counts those of earlier buckets
    order = np.lexsort((place, bucket))
    starts = starts[order]
    new = np.ones(len(starts), bool)
    if len(starts):
        new[1:] = False
        for d in [0, *steps]:
            w = word[starts + d]
            new[1:] |= w[1:] != w[:-1]
    return starts, new


def least_ids(texts: list[bytes], least: np.ndarray) -> list[np.ndarray]:
    """For each of some distinct strings, per window, the least id among all strings that have the window."""
    size = np.array([len(t) for t in texts])
    windows = size - WIDTH + 1
    text = np.frombuffer(b"".join(texts) + bytes(WIDTH + PERIOD + 8), np.uint8)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(texts)), windows)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts, new = sorted_windows(text, begin[owner] + nth)
    back = np.searchsorted(begin, starts, "right") - 1
    first = np.flatnonzero(new)
    found = np.repeat(np.minimum.reduceat(least[back], first), np.diff(np.append(first, len(starts))))
    flat = np.empty(len(owner), np.int64)
    flat[(np.cumsum(windows) - windows)[back] + starts - begin[back]] = found
    return np.split(flat, np.cumsum(windows)[:-1])


def answers(questions: DataFrame) -> DataFrame:
    """(group, kind, data): for the strings that hold a window which a smaller id has in another group or run, its least ids."""

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        groups, parts = rows["group"].tolist(), [unpack(d) for d in rows["data"]]
        number: dict[bytes, int] = {}
        least: list[int] = []
        tags: list[int] = []
        entries = []
        for text, size, tag, ids, _ in parts:
            raw, at, own = text.tobytes(), 0, []
            for n, g, i in zip(size.tolist(), tag.tolist(), ids.view(np.int64).tolist()):
                k = number.setdefault(raw[at : at + n], len(least))
                at += n
                if k == len(least):
                    least.append(i)
                    tags.append(g)
                elif i < least[k]:
                    least[k] = i
                own.append(k)
            entries.append(own)
        texts, low, tag = list(number), np.array(least, np.int64), np.array(tags, np.int64)
        found: list = list(least)
        order = np.argsort(tag, kind="stable")
        edges = np.flatnonzero(np.append(True, tag[order][1:] != tag[order][:-1]))
        block, held = [], 0
        for a, b in zip(edges.tolist(), np.append(edges[1:], len(tag)).tolist()):
            if b - a > 1:
                block += order[a:b].tolist()
                held += sum(len(texts[i]) for i in order[a:b])
            if block and (held >= BLOCK or b == len(tag)):
                for i, ids in zip(block, least_ids([texts[i] for i in block], low[block])):
                    found[i] = int(ids[0]) if (ids == ids[0]).all() else ids
                block, held = [], 0
        if block:
            for i, ids in zip(block, least_ids([texts[i] for i in block], low[block])):
                found[i] = int(ids[0]) if (ids == ids[0]).all() else ids
        of, out = [], []
        for group, part, own in zip(groups, parts, entries):
            who, count, values = [], [], []
            for local, i, k in zip(part[4].tolist(), part[3].view(np.int64).tolist(), own):
                v = found[k]
                if isinstance(v, int):
                    if v < i:
                        who.append(local)
                        count.append(1)
                        values.append(v)
                elif (v < i).any():
                    who.append(local)
                    count.append(len(v))
                    values.extend(np.minimum(v, i).tolist())
            if who:
                of.append(group)
                out.append(pack(np.array(who, "<u4"), np.array(count, "<u4"), np.array(values, np.int64).view("<u8")))
        return pd.DataFrame({"group": pd.array(of, "int64"), "kind": "answers", "data": out})

    return questions.groupBy("bucket").applyInPandas(lambda rows: released(meet(rows)), "group long, kind string, data binary")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), frequent: int = FREQUENT, group_bytes: int = GROUP, bucket_bytes: int = BUCKET) -> DataFrame:
    """Rows (doc_id, *keep, n_bytes, n_removed, n_spans, kept binary, kept_text string), one per document.

    kept_text: the same without the characters that lost some of their bytes. kept: the UTF-8 bytes of the text without those that a string of WIDTH bytes covers which starts in a
    document with a smaller id as well. Null texts count as empty. Documents without an id are kept whole
    and remove nothing; rows with the same id don't remove from each other. Copies of a whole text are
    settled by digest, so any number of them costs a row each. Other columns go.
    """
    spark = docs.sparkSession
    kinds = "".join(f", `_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"_{c}") for c in keep])
    sizes = checkpointed(raw.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("digest")))
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    groups, buckets = 1 + total // group_bytes, 1 + total // bucket_bytes
    bits = min(62, 24 + max(1, total // 12).bit_length())
    group = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(groups)).alias("group")
    texts = raw.select(group, "doc_id", "text", *[f"_{c}" for c in keep])
    notes = checkpointed(shared(seeds(texts.where(f"doc_id IS NOT NULL AND octet_length(text) >= {WIDTH}"), groups, buckets, bits), frequent))

    first = checkpointed(sizes.where(f"doc_id IS NOT NULL AND n_bytes >= {WIDTH}").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "least"))  # so that Spark may split a hot digest in the join
    copies = sizes.join(first, F.expr("digest = d AND doc_id > least")).select(group, "doc_id", "n_bytes")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, i, n = (batch.column(c).to_numpy() for c in ("group", "doc_id", "n_bytes"))
            order = np.lexsort((i, own))
            edges = np.flatnonzero(np.append(True, np.diff(own[order]) != 0)) if len(own) else np.empty(0, int)
            out = [pack(i[order[a:b]].view("<u8"), n[order[a:b]].view("<u8")) for a, b in zip(edges, np.append(edges[1:], len(own)))]
            yield pa.RecordBatch.from_arrays([pa.array(own[order[edges]], pa.int64()), pa.array(["copies"] * len(out), pa.string()), pa.array(out, pa.binary())], ["group", "kind", "data"])

    notes = notes.unionByName(copies.mapInArrow(listed, "group long, kind string, data binary"))

    def ask(key: tuple, own: pa.Table, said: pa.Table) -> pa.Table:
        return released(Group(own, said, bits).questions(key[0].as_py(), buckets))

    def cut(key: tuple, own: pa.Table, said: pa.Table) -> pa.Table:
        group = Group(own, said, bits)
        out = group.cut()
        for c in keep:
            out = out.append_column(f"_{c}", own.column(f"_{c}").take(pa.array(group.order, pa.int64())))
        del group
        return released(out)

    asked = texts.groupBy("group").cogroup(notes.groupBy("group")).applyInArrow(ask, "bucket long, group long, data binary")
    told = notes.unionByName(answers(asked))
    out = texts.groupBy("group").cogroup(told.groupBy("group")).applyInArrow(cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string{kinds}")
    return out.select(F.col("doc_id").alias(id_col), *[F.col(f"_{c}").alias(c) for c in keep], "n_bytes", "n_removed", "n_spans", "kept", "kept_text")
