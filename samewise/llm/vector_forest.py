"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the unit vectors again and again: a random direction (one of a pool, so that a node is five
numbers and a batch is projected once), and on it the widest gap in the middle part of the projections, so that a clump
of near copies is not cut where there is room beside it. Rows within a margin of the cut go to both sides (spill). The
trees are fitted on a sample bounded in rows and bytes (`sample_of`), and have so many nodes at most as fit into a broadcast
of known size; every row is then dealt to its leaves in every tree, rows of a leaf are compared in
double precision, and links below the threshold do not count. A pair that meets in several leaves
counts in the first. Leaves return link counts and a spanning forest, never pairs; a leaf of more than
`most` rows is cut in parts of which each two meet in a task of their own, so its links stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components

TREES, SPILL, LEAF, MOST, POOL = 10, 0.08, 500, 1024, 256
#: Bounds of what the driver holds of the sample, as numbers of 32 bits, and of what is broadcast of the trees.
SAMPLE_BYTES, FOREST_BYTES = 64 << 20, 16 << 20
NODE = np.dtype([("of", "<i4"), ("left", "<i4"), ("low", "<f8"), ("high", "<f8")])


def sample_of(n: int, width: int = 1) -> int:
    """Vectors that the trees are fitted on: all up to 20,000, then a fiftieth, 400,000 at most; fewer if so many don't fit into SAMPLE_BYTES."""
    return min(n, max(20_000, min(n // 50, 400_000)), max(1000, SAMPLE_BYTES // (4 * max(width, 1))))


def pool_of(width: int, rng: np.random.Generator) -> np.ndarray:
    return rng.standard_normal((width, POOL))


def grow(x: np.ndarray, pool: np.ndarray, least: int, rng: np.random.Generator, deepest: int = 40) -> np.ndarray:
    """Nodes of one tree over the unit vectors x, the root first: direction in the pool (-1 for a leaf), left child (the right one is next to it), low and high.

    Rows at or below `high` go left, those at or above `low` right.
    """
    nodes: list = [(-1, 0, 0.0, 0.0)]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        if len(rows) <= least or depth >= deepest:
            continue
        of = int(rng.integers(POOL))
        p = x[rows] @ pool[:, of]
        order = np.sort(p)
        a, b = len(order) // 4, len(order) - len(order) // 4
        gaps = np.diff(order[a:b])
        if not len(gaps) or gaps.max() <= 1e-12:
            a, b = 0, len(order)
            gaps = np.diff(order)
        if gaps.max() <= 1e-12:
            continue
        k = a + int(gaps.argmax())
        margin = SPILL * float(p.std())
        cut = (order[k] + order[k + 1]) / 2
        low, high = cut - margin, cut + margin
        left, right = rows[p <= high], rows[p >= low]
        if len(left) == len(rows) or len(right) == len(rows):
            low = high = cut
            left, right = rows[p <= high], rows[p > high]
        nodes[at] = (of, len(nodes), low, high)
        nodes += [(-1, 0, 0.0, 0.0)] * 2
        todo += [(len(nodes) - 2, left, depth + 1), (len(nodes) - 1, right, depth + 1)]
    return np.array(nodes, NODE)


def route(projected: np.ndarray, nodes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows) for every leaf of one tree that any row reaches; projected: rows by directions of the pool."""
    todo = [(0, np.arange(len(projected)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        of, left, low, high = nodes[at].item()
        if of < 0:
            yield at, rows
            continue
        p = projected[rows, of]
        goes_left = p <= high
        todo += [(left, rows[goes_left]), (left + 1, rows[(p >= low) & ~goes_left] if low == high else rows[p >= low])]


def unit(values: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Rows of length one in double precision, filled up with zeros to `width`, from the components of all rows and their numbers."""
    if (sizes == width).all():
        out = values.reshape(-1, width).astype(np.float64)
    else:
        out = np.zeros((len(sizes), width))
        place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        inside = place < width
        out[np.repeat(np.arange(len(sizes)), sizes)[inside], place[inside]] = values[inside]
    top = np.abs(out).max(axis=1, keepdims=True, initial=0)
    out /= np.where(top > 0, top, 1)  # against overflow of the squares
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def units(column: pa.ListArray, width: int) -> np.ndarray:
    offsets = column.offsets.to_numpy()
    return unit(column.flatten().to_numpy(zero_copy_only=False), np.diff(offsets), width)


def meet(rows: pd.DataFrame, width: int, threshold: float, leaf: int, p: int, q: int) -> pd.DataFrame:
    """Link counts (a, null, n) and forest links (a, b, 0) of the rows of one leaf, or of two parts of it."""
    rows = rows.sort_values("rep", kind="stable")
    ids, weight, part = rows["rep"].to_numpy(), rows["copies"].to_numpy(), rows["part"].to_numpy()
    size = np.array([len(v) for v in rows["vector"]])
    x = unit(np.concatenate(rows["vector"].tolist()), size, width)
    owner, key = np.repeat(np.arange(len(ids)), [len(k) for k in rows["leaves"]]), np.concatenate(rows["leaves"].tolist())
    owner, key = owner[key < leaf], key[key < leaf]
    shared, count = np.unique(key, return_counts=True)
    shared = shared[count > 1]
    belongs = np.zeros((len(shared), len(ids)), bool)
    at = np.searchsorted(shared, key)
    inside = at < len(shared)
    inside[inside] = shared[at[inside]] == key[inside]
    belongs[at[inside], owner[inside]] = True
    label, n = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    for a in range(0, len(ids), 256):
        own = slice(a, a + 256)
        hit = x[own] @ x.T >= threshold
        hit &= (size[own][:, None] == size) & (np.arange(len(ids)) > np.arange(a, a + len(hit))[:, None])
        if p != q:
            hit &= part[own][:, None] != part
        if not hit.any():
            continue
        for of in belongs[belongs[:, own].any(axis=1)]:
            hit[of[own]] &= ~of
        n[own] += hit @ weight
        n += weight[own] @ hit
        for i in np.flatnonzero(hit.any(axis=1)):
            sets = np.unique(label[np.append(np.flatnonzero(hit[i]), a + i)])
            if len(sets) > 1:
                label[np.isin(label, sets)] = sets[0]
    linked, moved = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(ids)))
    return pd.DataFrame({"a": np.append(ids[linked], ids[moved]), "b": pd.array([*[None] * len(linked), *ids[label[moved]]], "Int64"), "n": np.append(n[linked], 0 * moved)})


def near_vectors(vectors: DataFrame, threshold: float = 0.9, trees: int = TREES, leaf: int = LEAF, most: int = MOST, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id_col, n_links, component_id, kept), one per vector.

    Null and zero vectors, and those with null or non-finite components, link with nothing; so do
    vectors of different lengths with each other, and null ids. Equal vectors are one class, whose
    members link with each other and with all that the class links with. Repeated ids are vectors of
    their own; ids are cast to long. Other columns go; an empty table gives an empty one. Vectors of 32-bit numbers travel
    as such and are compared in double precision.
    """
    spark = vectors.sparkSession
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    v = F.col(vector_col).cast(f"array<{kind}>")
    good = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")).cast(kind))) & F.exists(v, lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(good & F.col(id_col).isNotNull(), F.transform(v, lambda c: c + F.lit(0.0).cast(kind))).alias("vector"))
    classes = checkpointed(rows.where("vector IS NOT NULL").groupBy("vector").agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("copies")))
    n, width = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return vectors.select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    chosen = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample_of(n, width)).select("vector").toArrow()
    sample = np.concatenate([units(chunk, width) for chunk in chosen.column("vector").chunks])
    rng = np.random.default_rng(seed)
    pool = pool_of(width, rng)
    least = max(12, leaf * len(sample) // n, 4 * len(sample) * trees * NODE.itemsize // FOREST_BYTES)
    fitted = spark.sparkContext.broadcast([grow(sample, pool, least, rng) for _ in range(trees)])
    first = np.cumsum([0, *map(len, fitted.value)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = units(batch.column("vector"), width)
            projected = x @ pool
            met = [(int(first[t]) + at, own) for t, nodes in enumerate(fitted.value) for at, own in route(projected, nodes)]
            row, key = np.concatenate([own for _, own in met]), np.repeat([k for k, _ in met], [len(own) for _, own in met])
            order = np.lexsort((key, row))
            ends = np.searchsorted(row[order], np.arange(len(x) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(key[order].astype(np.int64)))], [*batch.schema.names, "leaves"])

    dealt = checkpointed(classes.select("rep", "copies", "vector").mapInArrow(deal, f"rep long, copies long, vector array<{kind}>, leaves array<long>"))
    keyed = dealt.select("*", F.explode("leaves").alias("leaf"))
    large = dealt.select(F.explode("leaves").alias("k")).groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > most).select("k", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    keyed = keyed.join(large, F.expr("leaf = k"), "left").withColumn("part", F.expr("pmod(xxhash64(rep, leaf), coalesce(parts, 1))"))
    keyed = keyed.withColumn("other", F.explode(F.expr("sequence(0L, cast(coalesce(parts, 1) - 1 AS long))")))
    meeting = keyed.select("rep", "copies", "vector", "leaves", "leaf", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q")).groupBy("leaf", "p", "q")

    def compare(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        return meet(own, width, threshold, *map(int, key))

    found = checkpointed(meeting.applyInPandas(compare, "a long, b long, n long"))
    joined = components(found.where("b IS NOT NULL").select("a", "b"))
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    named = classes.join(joined, F.expr("rep = node"), "left").join(counts, F.expr("rep = a"), "left")
    named = named.select(F.col("vector").alias("v"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(named, F.expr("vector = v"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
