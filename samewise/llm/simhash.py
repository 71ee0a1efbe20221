"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints at most `radius` bits apart must agree on one of a few sets of bits (of blocks + radius
equal blocks, on some `blocks` of them), so classes of equal fingerprints are dealt by those bits.
Where they meet they are stored as bit planes, 64 fingerprints to a word of each plane; the distances
of a fingerprint to 64 others grow together in counter planes, fed by carry-save adders two bit planes at a
time. The counters start so that they overflow just beyond the radius; blocks in which every lane has
overflowed are abandoned. A meeting returns a spanning forest of the links it found, never its pairs.

Texts whose word shingles are alike (near_texts) need a radius so wide that no bits need agree. They meet at
shingles instead: in any one order of all shingles, two sets of similarity 0.8 or more share one among the first
fifth (and one) of each. The order puts shingles that a sketch of the corpus has seen often last; it decides what
meets, never what is found. Where texts meet, the same planes and counters compare their fingerprints, first
with the one next to the majority of all, then those that are left with all others. What is joined so is a group of candidates, in
which whole sets are compared; each text goes to the one group it is in, whatever the number of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, pieces, small, tidied

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
SEED, SHINGLE, RADIUS = 42, 3, 3
#: Of near_texts: words in a shingle, least similarity as a fraction of whole numbers, and a radius beyond which one
#: pair in ten thousand lies at most, at that very similarity (a bit then differs with a chance of 0.19 at most).
WORDS, OVER, UNDER, WIDE = 5, 4, 5, 24
#: Slots of the sketch of shingles, slots that a task reports at most, and members of one row of a meeting.
SLOTS, MOST_HOT, BLOCK = 1 << 20, 20_000, 4096
MEMBERS = "array<struct<c: long, fp: long, n: long>>"
#: More bits of each class, for a second look at pairs by 64-bit words, and how many of them may differ: four deviations
#: above the mean of the smallest sets at the least similarity. Shingles of the texts of a part of a group of candidates.
MORE, FARTHEST, MOST_SHINGLES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), 58, 150_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED, at_once: int = 1 << 16) -> int:
    """64 bits: each the majority of that bit over the hashes of the text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []  # of bytes, these know ASCII alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    n, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    for a in range(0, n, at_once):
        own = starts[a : a + at_once + shingle]
        h = np.array([xxh64_intdigest(joined[i : j - 1], seed) for i, j in zip(own, own[shingle:])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp long); one narrow pass over whole texts. Texts without words have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words): word w of plane b holds bit b of fingerprints 64w to 64w + 63."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    padded = np.zeros((64, -(-len(fps) // 64) * 64), np.uint8)
    padded[:, : len(fps)] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


class Counters:
    """Vertical counters of many distances at once; `over` marks the lanes that have passed the radius."""

    def __init__(self, radius: int, shape: tuple[int, ...]) -> None:
        size = radius.bit_length()
        begin = (1 << size) - 1 - radius
        self.planes = [np.full(shape, FULL if begin >> i & 1 else 0, np.uint64) for i in range(size)]
        self.over = np.zeros(shape, np.uint64)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Counts the bits of two planes: a carry-save adder into the lowest counter plane, and its carry up the others."""
        carry = x & y
        x = x ^ y
        carry |= x & self.planes[0]
        self.planes[0] ^= x
        for plane in self.planes[1:]:
            more = plane & carry
            plane ^= carry
            carry = more
        self.over |= carry

    def keep(self, of) -> None:
        self.planes, self.over = [p[of] for p in self.planes], self.over[of]


def links(fps: np.ndarray, radius: int = RADIUS, at_once: int = 256, first: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each fingerprint (of the `first` ones) with any, the indices after its own of those at most `radius` bits away."""
    planes = planes_of(fps)
    order, until = np.arange(64), len(fps) if first is None else first
    for q0 in range(0, until, at_once):
        queries = np.arange(q0, min(q0 + at_once, until))
        words = np.arange(q0 // 64, planes.shape[1])
        flip = np.where((fps[queries][None, :] >> order[:, None].astype(np.uint64)) & np.uint64(1), FULL, np.uint64(0))
        own = planes[:, words]
        count = Counters(radius, (len(queries), len(words)))
        for b in range(0, 64, 2):
            count.add(own[b] ^ flip[b][:, None], own[b + 1] ^ flip[b + 1][:, None])
            if b % 8 == 6:
                live = count.over != FULL
                rows, cols = live.any(1), live.any(0)
                if not rows.any():
                    break
                if rows.mean() < 0.75:
                    queries, flip = queries[rows], flip[:, rows]
                    count.keep(rows)
                if cols.mean() < 0.75:
                    words, own = words[cols], own[:, cols]
                    count.keep((slice(None), cols))
        else:
            near = ~count.over
            for i in np.flatnonzero(near.any(1)):
                at = np.flatnonzero(near[i])
                lanes = np.flatnonzero(np.unpackbits(near[i, at].view(np.uint8), bitorder="little"))
                found = words[at[lanes // 64]] * 64 + lanes % 64
                found = found[(found > queries[i]) & (found < len(fps))]
                if len(found):
                    yield int(queries[i]), found


def within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether a[i] and b[i] are at most `radius` bits apart, 64 pairs to a word."""
    x = planes_of(a) ^ planes_of(b)
    count = Counters(radius, x.shape[1:])
    for i in range(0, 64, 2):
        count.add(x[i], x[i + 1])
    return np.unpackbits((~count.over).view(np.uint8), bitorder="little")[: len(a)].astype(bool)


def forest(ids: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join just the ids whose fingerprints are linked, each to the least id of its set."""
    order = np.argsort(ids, kind="stable")
    ids, fps = ids[order], fps[order]
    label = np.arange(len(ids))
    for i, found in links(fps):
        sets = np.unique(label[np.append(found, i)])
        if len(sets) > 1:
            label[np.isin(label, sets)] = sets[0]
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def key_masks(n: int, per_bin: int) -> list[int]:
    """The sets of bits that deal n fingerprints into bins of about per_bin, as masks; one set agrees for any two within RADIUS.

    Four blocks of 16 bits up to 2^28 fingerprints; beyond, five or six blocks of which two or three are kept.
    """
    keep = 1 if n <= 1 << 28 else 2 if n <= 1 << 37 else 3
    blocks = np.array_split(np.arange(64), keep + RADIUS)
    need = max(0, int(np.ceil(np.log2(max(n, 1) / per_bin))))
    masks = []
    for own in combinations(blocks, keep):
        masks.append(sum(1 << int(b) for b in np.concatenate(own)[:need]))
    return masks


def as_long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, per_bin: int = 512, most: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp, component_id): the smallest id reachable over links of at most RADIUS differing bits.

    Null texts count as empty; texts without words share fingerprint zero. A null id links nothing and
    gets the component of the others with its fingerprint, if any. Repeated rows stay; other columns go.
    Exact: a bin of more than `most` classes is cut in parts, and each pair of parts meets in a task of its own.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col))
    classes = checkpointed(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").cast("long").alias("rep")))
    masks = key_masks(classes.count(), per_bin)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("set"), F.col("fp").bitwiseAND(F.lit(as_long(m))).alias("key")) for i, m in enumerate(masks)]))
    dealt = classes.select("rep", "fp", keys.alias("k")).select("rep", "fp", "k.set", "k.key")
    parts = dealt.groupBy("set", "key").agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col("set").alias("s"), F.col("key").alias("k"), F.ceil(F.col("n") / most).cast("int").alias("parts"))
    dealt = dealt.join(parts, F.expr("set = s AND key = k"), "left").withColumn("part", F.expr("pmod(xxhash64(fp, set), coalesce(parts, 1))"))
    other = F.expr("CASE WHEN parts IS NULL THEN array(0L) ELSE filter(sequence(0L, cast(parts - 1 AS long)), x -> x <> part) END")
    dealt = dealt.select("rep", "fp", "set", "key", "part", F.explode(other).alias("other"))
    meeting = dealt.groupBy("set", "key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = forest(rows["rep"].to_numpy(), rows["fp"].to_numpy().view(np.uint64))
        return pd.DataFrame({"a": a, "b": b})

    joined = components(meeting.applyInPandas(compare, "a long, b long"))
    named = classes.join(joined, classes.rep == joined.node, "left").select(F.col("fp").alias("f"), F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, F.expr("fp = f"), "left").select("doc_id", "fp", "component_id").withColumnRenamed("doc_id", id_col)


def as_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of the text's word shingles, in order; of a text of fewer words, the hash of them all."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []  # of bytes, these know ASCII alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    ends = starts[WORDS:] or starts[-1:]
    return np.unique(np.fromiter((xxh64_intdigest(joined[i : j - 1], SEED) for i, j in zip(starts, ends)), np.uint64, len(ends)))


def fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be alike."""
    return UNDER * np.minimum(n, m) >= OVER * np.maximum(n, m)


def digest(own: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(own.tobytes(), SEED) if len(own) else 0


def majority(own: np.ndarray) -> int:
    """64 bits: each the majority of that bit over the hashes."""
    ones = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(own), bitorder="little").tobytes(), "little")


def more_bits(own: np.ndarray) -> list[int]:
    """Fingerprints of the same set by other hashes."""
    mixed = ((own ^ (own >> np.uint64(29))) * np.uint64(odd) for odd in MORE)
    return [majority(x ^ (x >> np.uint64(32))) for x in mixed]


def longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, t, c, n, f0, f1, f2): c the digest of the set, n its size, more bits; at the end (slot, n) of the slots that the task saw most."""
    names, seen, total = ["doc_id", "t", "c", "n", "f0", "f1", "f2", "slot"], np.zeros(SLOTS, np.int64), 0
    for batch in pieces(batches, "text"):
        found = []
        for text in batch.column("text").to_pylist():
            own = shingles(text)
            found.append((digest(own), len(own), *more_bits(own)))
            np.add.at(seen, (own & np.uint64(SLOTS - 1)).astype(np.int64), 1)
            total += len(own)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), *map(longs, zip(*found)), pa.nulls(len(found), pa.int64())], names)
    hot = np.flatnonzero(seen >= 16 + 4 * total // SLOTS)
    none = pa.nulls(len(hot), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, pa.array(seen[hot]), none, none, none, pa.array(hot)], names)


def prefixes(docs: DataFrame, hot: list[tuple[int, int]]) -> DataFrame:
    """Rows (key, c, fp, n): the shingles of each set that any set alike has a share in; its digest, fingerprint and size."""
    slots, counts = np.array([s for s, _ in hot], np.int64), np.array([n for _, n in hot], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, done = np.zeros(SLOTS, np.int64), set()
        often[slots] = counts
        for batch in pieces(batches, "text"):
            keys, found = [np.zeros(0, np.uint64)], []
            for text in batch.column("text").to_pylist():
                own = shingles(text)
                c, n = digest(own), len(own)
                if c in done or not n:
                    continue
                done.add(c)
                keys.append(own[np.argsort(often[(own & np.uint64(SLOTS - 1)).astype(np.int64)], kind="stable")][: n + 1 + -OVER * n // UNDER])
                found.append((c, majority(own), n))
            size = [len(k) for k in keys[1:]]
            columns = [np.repeat(np.array(x, np.uint64).view(np.int64), size) for x in zip(*found)] or [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *map(pa.array, columns)], ["key", "c", "fp", "n"])

    return docs.select("text").mapInArrow(tidied(run), "key long, c long, fp long, n long")


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ordered by key and c: the members of each key that has two or more. Keys with more than BLOCK members
    get several rows (key, part, m), the others one with a null key, and only one for all keys with the same members."""
    from xxhash import xxh64_intdigest

    left, cut, seen = np.zeros((4, 0), np.int64), (None, 0), set()

    def rows(own: np.ndarray, whole: bool) -> Iterator[pa.RecordBatch]:
        """own: the rows of one key or more, the first of which may be the rest of a key cut before."""
        edge = np.flatnonzero(np.append(True, own[0, 1:] != own[0, :-1])) if own.shape[1] else np.zeros(0, np.int64)
        out = []
        for a, b in zip(edge, np.append(edge[1:], own.shape[1])):
            key = own[0, a]
            first = cut[1] if cut[0] == key else 0
            if first or b - a > BLOCK or not whole:
                out += [(key, first + i, x, min(x + BLOCK, b)) for i, x in enumerate(range(a, b, BLOCK))]
            elif b - a > 1 and (same := xxh64_intdigest(own[1, a:b].tobytes())) not in seen:
                seen.add(same)
                out.append((None, 0, a, b))
        if out:
            at = np.concatenate([np.arange(a, b) for _, _, a, b in out])
            ends = np.cumsum([0, *(b - a for _, _, a, b in out)])
            member = pa.StructArray.from_arrays([pa.array(own[i, at]) for i in (1, 2, 3)], ["c", "fp", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), member)], ["key", "part", "m"])

    for batch in batches:
        if batch.num_rows:
            left = np.hstack([left, np.array([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)])])
            left = left[:, np.append(True, (left[:2, 1:] != left[:2, :-1]).any(0))]
            whole = int(np.searchsorted(left[0], left[0, -1]))
            yield from rows(left[:, :whole], True)
            left = left[:, whole:]
            if whole:
                cut = None, 0
            while left.shape[1] > BLOCK:
                yield from rows(left[:, :BLOCK], False)
                cut, left = (left[0, 0], 1 + (cut[1] if cut[0] == left[0, 0] else 0)), left[:, BLOCK:]
    yield from rows(left, True)


def lists_of(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each list of a batch begins (and the last one ends), and the fields of all members."""
    m = batch.column("m")
    offsets = m.offsets.to_numpy()
    flat = m.flatten()
    return offsets - offsets[0], [flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)]


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join, in each list, just the members with a chain of pairs that may be alike between them.

    Members near the one next to the majority of the list's bits go with it, in all lists of a batch at once; the others are compared with all.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, (c, fp, n, *more) = lists_of(batch)
        fp, more = fp.view(np.uint64), np.array(more, np.int64).view(np.uint64)
        begin, size = offsets[:-1].astype(np.int64), np.diff(offsets)

        def alike_at_all(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return fits(n[i], n[j]) & (np.bitwise_count(more[:, i] ^ more[:, j]).sum(axis=0, dtype=np.int64) <= FARTHEST)

        group = np.repeat(np.arange(len(size)), size)
        bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        middle = np.packbits(2 * np.add.reduceat(bits, begin, axis=0, dtype=np.int64) > size[:, None], axis=1, bitorder="little").view("<u8").ravel()
        center = np.lexsort((c, np.bitwise_count(fp ^ middle[group]), group))[begin]
        own = center[group]
        near = within(fp, fp[own], WIDE) & alike_at_all(np.arange(len(c)), own)
        near[center] = True
        taken = near & (own != np.arange(len(c)))
        a, b = [c[own[taken]]], [c[taken]]
        for g in np.flatnonzero((size > 2) & (np.bincount(group[~near], minlength=len(size)) > 0)).tolist():
            at = np.arange(begin[g], begin[g] + size[g])
            at, joined = np.append(at[~near[at]], at[near[at]]), near[at].sum()
            label = np.arange(len(at))
            label[len(at) - joined :] = len(at) - joined
            for i, found in links(fp[at], WIDE, first=len(at) - int(joined)):
                found = found[alike_at_all(at[found], np.full(len(found), at[i]))]
                for j in np.unique(label[found]).tolist():
                    if j != label[i]:
                        a.append(c[at[[i]]])
                        b.append(c[at[[j]]])
                        label[label == j] = label[i]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], ["a", "b"])


def texts_of(need: DataFrame, docs: DataFrame) -> DataFrame:
    """(c, text): a text of each class. The other texts are read past: they are shuffled only if the classes are too many to broadcast."""
    texts = checkpointed(docs.join(small(need.select("c", "i", "h")), F.expr("doc_id = i AND t = h")).select("c", "text"))
    return texts if texts.count() == need.count() else checkpointed(texts.groupBy("c").agg(F.min("text").alias("text")))


def verify(rows: pa.Table) -> pa.Table:
    """Links (a, b) that join all texts of a group (in its part q the smaller ones) whose whole sets are alike, each to the first of its set."""
    rows = rows.sort_by("c")
    c, own = rows.column("c").to_numpy(), [shingles(t) for t in rows.column("text").to_pylist()]
    size = np.array([len(x) for x in own])
    owner = np.repeat(np.arange(len(own)), size)
    names, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]), return_inverse=True)
    order = np.argsort(place, kind="stable")
    held, begin = owner[order], np.searchsorted(place[order], np.arange(len(names) + 1))
    ends, label, a, b = np.append(0, np.cumsum(size)), np.arange(len(own)), [], []
    for i in range(len(own)):
        mine = place[ends[i] : ends[i + 1]]
        lists = [held[begin[u] : begin[u + 1]] for u in mine if begin[u + 1] - begin[u] > 1]
        if lists:
            both = np.bincount(np.concatenate(lists), minlength=len(own))
            found = np.flatnonzero(UNDER * both >= OVER * (size + size[i] - both))
            found = found[(found > i) & (label[found] != label[i])]
            for j in found.tolist():
                if label[j] != label[i]:
                    low, high = sorted((label[i], label[j]))
                    label[label == high] = low
                    a.append(c[i])
                    b.append(c[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def verified(groups: DataFrame, docs: DataFrame, first: DataFrame) -> DataFrame:
    """Links that join the classes of each group of candidates (node, component) that are alike.

    Groups of more than MOST_SHINGLES are cut in parts, and each two parts meet in a task of their own.
    """
    need = checkpointed(groups.select(F.col("node").alias("c"), F.col("component").alias("k")).join(first, "c"))
    texts = texts_of(need, docs)
    large = need.groupBy("k").agg(F.ceil(F.sum("n") / MOST_SHINGLES).cast("int").alias("parts")).where("parts > 1").withColumnRenamed("k", "g")
    dealt = need.select("c", "k").join(large, F.expr("k = g"), "left").withColumn("part", F.expr("pmod(xxhash64(c, k), coalesce(parts, 1))"))
    other = F.expr("CASE WHEN parts IS NULL THEN array(0L) ELSE filter(sequence(0L, cast(parts - 1 AS long)), x -> x <> part) END")
    dealt = dealt.select("k", "c", "part", F.explode(other).alias("other")).join(texts, "c")
    return checkpointed(dealt.groupBy("k", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q")).applyInArrow(verify, "a long, b long"))


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, t, component, component_id): the smallest id reachable over links of similarity OVER / UNDER or more
    between sets of WORDS-word shingles; t hashes the text. Where ids repeat, components can share their smallest id;
    `component` tells them apart.

    Exact but for pairs beyond the radius (see WIDE and FARTHEST) and equal 64-bit hashes. Texts without words, null ones among
    them, are copies of each other. A null id links nothing and has no component. Repeated rows stay; other columns go.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    rows = checkpointed(own.mapInArrow(tidied(classed), "doc_id long, t long, c long, n long, f0 long, f1 long, f2 long, slot long"))
    hot = rows.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "slot").limit(MOST_HOT).collect()
    rows, known = rows.where("slot IS NULL"), own.where("doc_id IS NOT NULL")
    keys = prefixes(known, [(r["slot"], r["n"]) for r in hot])
    lists = checkpointed(keys.repartition("key").sortWithinPartitions("key", "c").mapInArrow(tidied(met), f"key long, part int, m {MEMBERS}").select("key", "part", F.xxhash64("m").alias("own"), "m"))
    parts = lists.where("key IS NOT NULL").select("key", "part", "own")
    lists = checkpointed(lists.groupBy("own").agg(F.min("m").alias("m")))
    least = F.min(F.struct("doc_id", "t", "n", "f0", "f1", "f2")).alias("r")
    first = checkpointed(rows.where("doc_id IS NOT NULL").groupBy("c").agg(least).select("c", F.col("r.doc_id").alias("i"), F.col("r.t").alias("h"), "r.n", "r.f0", "r.f1", "r.f2"))

    wide = F.struct("x.c", "x.fp", "x.n", "f0", "f1", "f2").alias("x")
    member = lists.select("own", F.explode("m").alias("x")).join(first.select(F.col("c").alias("d"), "f0", "f1", "f2"), F.expr("x.c = d")).select("own", wide)
    member = checkpointed(member.groupBy("own").agg(F.collect_list("x").alias("m")))
    # parts of a key meet pairwise, each two once whatever the keys they share
    two = parts.alias("x").join(parts.alias("y"), F.expr("x.key = y.key AND x.part < y.part")).select(F.least("x.own", "y.own").alias("p"), F.greatest("x.own", "y.own").alias("q")).distinct()
    x, y = (member.select(F.col("own").alias(i), F.col("m").alias(f"m{i}")) for i in "pq")
    crossed = two.join(x, "p").join(y, "q").select(F.concat("mp", "mq").alias("m"))
    groups = components(member.select("m").union(crossed).mapInArrow(tidied(candidates), "a long, b long"))
    joined = components(verified(checkpointed(groups), known, first))
    named = checkpointed(rows.join(joined, F.expr("c = node"), "left").selectExpr("doc_id", "t", "coalesce(component, c) AS k"))
    least = named.where("doc_id IS NOT NULL").groupBy("k").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("k", "g")
    return named.join(least, F.expr("k = g"), "left").select(F.col("doc_id").alias(id_col), "t", F.col("k").alias("component"), "component_id")
