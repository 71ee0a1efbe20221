"""SentencePiece encoding and decoding by a table of last tokens.

A merge-type (BPE) vocabulary gives every text one encoding, and a sequence of tokens is that
encoding exactly when each token encodes to itself and each adjacent pair of tokens encodes to that
pair. So every prefix of a text has a unique last token: of the tokens that an automaton finds to end
there, the one that may follow the last token of the prefix before it. One pass fills the table from
left to right, and the ids are read off it backwards. The work is linear in the text, whatever the
length of its words.

Words recur, so encodings of the segments between which no piece can reach are kept in a bounded
memo; a text whose model has pieces that reach over spaces is one segment.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, gathered, pieces, split_up

SPACE = "▁"
#: Bounds of the memos of one Python worker, in entries; a full memo of pairs is emptied.
MOST_SEGMENTS, MOST_PAIRS, LONGEST_KEPT = 500_000, 300_000, 64
#: In the table, stands for a character that no piece has.
UNKNOWN = -2
#: Characters that mean something in a replacement pattern or are looked for in texts.
SPECIAL = "\\,.;:!?"


class PieceTable:
    """Encoder and decoder of one sentencepiece BPE model with byte fallback."""

    def __init__(self, model_file: str) -> None:
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {self.text[i]: sp.get_score(i) for i in plain}
        self.id = {self.text[i]: i for i in plain}
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.may_cut = not any(a != SPACE and b == SPACE for p in self.id for a, b in zip(p, p[1:]))
        # marks that no piece has after a letter or digit; a text may be cut before them as before a space
        inside = {b for p in self.id for a, b in zip(p, p[1:]) if a.isalnum()}
        marks = "".join(c for c in ",.;:!?" if c not in inside) if self.may_cut else ""
        self.mark = re.compile(rf"[{re.escape(marks)}](?<=[^\W_].)(?={SPACE}|\Z)") if marks else None
        self.segments = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if len(p) == 1 or self.merged(p) == [p]:  # a piece that its own text never gives can't be a token
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.memo = Memo(MOST_SEGMENTS)
        self.length = list(map(len, self.text))
        raw = [b"" if sp.is_control(i) else bytes([int(self.text[i][3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else self.text[i].replace(SPACE, " ").encode() for i in range(n)]
        self.size = np.array([len(x) for x in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(raw), np.uint8)

    def merged(self, text: str) -> list[str]:
        """The encoding by definition, for texts of a few pieces: merge the best-scored pair, the leftmost first."""
        parts = list(text)
        while True:
            best = max(((self.score[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the text of the two tokens encodes to just them."""
        if len(self.fits) >= MOST_PAIRS:
            self.fits.clear()
        x, y = self.text[a], self.text[b]
        known = self.fits[a << 24 | b] = self.merged(x + y) == [x, y]
        return known

    def table(self, text: str) -> list[int]:
        """For each prefix, the last token of its encoding (UNKNOWN: no text, or a character of no piece)."""
        last, known = [UNKNOWN] * (len(text) + 1), self.fits.get
        for end, (token, length) in self.automaton.iter(text):
            if last[end + 1] == UNKNOWN:
                before = last[end + 1 - length]
                if before != UNKNOWN:
                    fits = known(before << 24 | token)
                    if not (self.may_follow(before, token) if fits is None else fits):
                        continue
                last[end + 1] = token
        return last

    def segment_ids(self, text: str) -> bytes:
        """Ids of one segment as little-endian int32."""
        last, length, out, i = self.table(text), self.length, [], len(text)
        while i:
            token = last[i]
            if token == UNKNOWN:
                out += [self.bytes[b] for b in reversed(text[i - 1].encode())] if self.bytes else [self.unknown]
                i -= 1
            else:
                out.append(token)
                i -= length[token]
        return array("i", out[::-1]).tobytes()

    def cut(self, text: str, by: str) -> str:
        """The normalised text with `by` between the segments."""
        if not self.may_cut:
            return text
        text = text.replace(SPACE, by + SPACE) if SPACE + SPACE not in text else by.join(self.segments.findall(text))
        return self.mark.sub(rf"{by}\g<0>", text) if self.mark else text

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text ends; each distinct segment is encoded once."""
        whole = [self.library.normalize(t) if t else "" for t in texts]
        by = next(c for c in map(chr, range(1, 0xD800)) if c not in SPECIAL and not any(c in t for t in whole))
        segments, places, ends = split_up([self.cut(t, by) for t in whole], by)
        known = self.memo.known(segments)
        new = [i for i, ids in enumerate(known) if ids is None]
        for i in new:
            known[i] = self.segment_ids(segments[i])
        short = [i for i in new if len(segments[i]) <= LONGEST_KEPT]
        self.memo.add([segments[i] for i in short], [known[i] for i in short])
        ids, after = gathered(known, places)
        return ids.view("<i4"), np.append(0, after)[ends]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray, at_once: int = 1 << 20) -> str:
        """The text of the ids; the space that encoding puts first is taken off again."""
        out = bytearray()
        for i in range(0, len(ids), at_once):
            part = np.asarray(ids[i : i + at_once], np.int64)
            size = self.size[part]
            begin = np.cumsum(size) - size
            out += self.pool[np.repeat(self.start[part] - begin, size) + np.arange(int(size.sum()))].tobytes()
        if out[:1] == b" ":
            del out[:1]
        try:
            return out.decode()
        except UnicodeDecodeError:  # bytes that encoding never gives; the library writes a mark for each
            return self.library.decode(np.asarray(ids).tolist())


@lru_cache(maxsize=2)
def piece_table(model_file: str) -> PieceTable:
    return PieceTable(model_file)


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, ids array<int>, decoded string) of whole texts; null counts as empty.

    One narrow pass over the scan, no shuffle. An empty text has no ids and decodes to an empty one.
    Repeated rows stay, an empty table gives an empty one, other columns go, whatever their names. The model's path must exist on every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_table(model_file)
        for batch in pieces(batches, "text"):
            ids, ends = codec.encode_all(batch.column("text").to_pylist())
            ends = np.append(0, ends).astype(np.int32)
            decoded = pa.array([codec.decode(ids[a:b]) for a, b in zip(ends, ends[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), decoded], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens and digests of ids and decoded text."""
    return encoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
