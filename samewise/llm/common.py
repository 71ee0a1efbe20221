"""Helpers shared by the corpus operators: tables, checkpoints, Arrow batches, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder the cluster names in spark.checkpoint.dir.

    Only where that setting is absent on a single machine (as in tests) is a folder made here; elsewhere that is an error.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows written as Parquet in the shared folder and read again, and their path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, most_rows: int = 1 << 18) -> DataFrame:
    """The right side of an equi-join, of a few numbers a row: broadcast if it has few rows, else hashed after a shuffle, so that the other side is never sorted."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df.hint("shuffle_hash")


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose `column` holds about `most_bytes` bytes each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)


def give_back() -> None:
    """Memory that this process has freed goes back to the system.

    Spark keeps some Python workers of one stage for the next ones and deals tasks to them in turn, so what Arrow's pool and the C
    library hold back for later in each of them adds up in an executor.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(value):
    """The value, after memory that has been freed went back: for what a group comes to."""
    give_back()
    return value


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same for mapInArrow, which gives back what it has freed when a task ends."""

    def until_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return until_the_end


class Memo:
    """A bounded memo of two generations: when the younger is full, it takes the place of the older, so what is often asked for stays."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most // 2, {}, {}

    def known(self, keys: list[str]) -> list[bytes | None]:
        found, young, old = list(map(self.young.get, keys)), self.young, self.old
        for i, value in enumerate(found):
            if value is None and (value := old.get(keys[i])) is not None:
                found[i] = young[keys[i]] = value
        return found

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def add(self, keys: Iterable[str], values: Iterable[bytes]) -> None:
        self.young.update(zip(keys, values))
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young


def gathered(entries: list[bytes], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries (numbers of 32 bits) at the places, one after another, and where each of them ends."""
    size = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
    first = np.cumsum(size) - size
    own = size[places]
    ends = np.cumsum(own)
    pool = np.frombuffer(b"".join(entries), "<u4")
    return pool[np.repeat(first[places] - (ends - own), own) + np.arange(int(own.sum()))], ends


def split_up(texts: list[str], by: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct parts of the texts between `by`, the place of every part among them, and where each text's parts end."""
    lists = pc.split_pattern(pa.array(texts, pa.string()), by)
    parts = lists.flatten().dictionary_encode()
    return parts.dictionary.to_numpy(zero_copy_only=False).tolist(), parts.indices.to_numpy(), lists.offsets.to_numpy()[1:]


def quoted(text: str) -> str:
    """A SQL string constant."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str, at_once: int = 500, gaps: bool = False) -> str:
    """SQL for the matches of a regular expression, leftmost and not overlapping: structs (start, end, text), in code points.

    The texts between matches, got by splitting, give the places. Sums run in blocks of `at_once`
    matches, so that appending to arrays stays cheap where a text has thousands. No match may be empty.
    With `gaps`, the texts between matches, empty ones too, take the place of the matches.
    """
    p = quoted(pattern)
    none = "cast(array() AS array<struct<start: int, end: int, text: string>>)"
    match = "named_struct('start', a.at + length(q.g[i]), 'end', a.at + length(q.g[i]) + length(q.m[i]), 'text', q.m[i])"
    if gaps:
        match = "named_struct('start', a.at, 'end', a.at + length(q.g[i]), 'text', q.g[i])"
    step = f"named_struct('at', a.at + length(q.g[i]) + length(q.m[i]), 'out', concat(a.out, array({match})))"
    block = f"aggregate(sequence(b * {at_once}, least(size(q.m), (b + 1) * {at_once}) - 1), named_struct('at', o.at, 'out', {none}), (a, i) -> {step})"
    joined = f"transform(array({block}), x -> named_struct('at', x.at, 'out', concat(o.out, x.out)))[0]"
    whole = f"aggregate(sequence(0, cast(floor((size(q.m) - 1) / {at_once}) AS int)), named_struct('at', 0, 'out', {none}), (o, b) -> {joined}, o -> o.out)"
    placed = f"transform(array(named_struct('m', r.m, 'g', split({text}, {p}, -1))), q -> {whole})[0]"
    if gaps:
        return f"transform(array(named_struct('m', concat(regexp_extract_all({text}, {p}, 0), array('')))), r -> {placed})[0]"
    return f"transform(array(named_struct('m', regexp_extract_all({text}, {p}, 0))), r -> CASE WHEN size(r.m) = 0 THEN {none} ELSE {placed} END)[0]"


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all links in the batches."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            low, high = sorted((root(parent.setdefault(u, u)), root(parent.setdefault(v, v))))
            parent[high] = low
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in list(parent)], pa.int64())], ["node", "component"])


def components(edges: DataFrame, most_rounds: int = 64, few: int = 1 << 17) -> DataFrame:
    """Connected components of the undirected links (a, b): rows (node, component), component the least node.

    Up to `few` links, counted first, are a few megabytes and are joined in one task, which spares the
    driver some dozens of jobs. Beyond that it alternates large-star and small-star steps, each of which replaces a link by one link to the
    least neighbour. The least neighbours are written out before they are joined, so that both sides of the
    join are dealt anew and Spark can split a node with a great many links.
    Nodes without a link do not appear. Every round is checkpointed, so a lost executor costs one round.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = checkpointed(e)
    if e.count() <= few:
        return checkpointed(e.selectExpr("cast(u AS long) AS u", "cast(v AS long) AS v").coalesce(1).mapInArrow(united, "node long, component long"))
    seen = None
    for _ in range(most_rounds):
        # large star: of each node, the larger neighbours move to its least neighbour or itself
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        least = checkpointed(least)
        e = both.join(least, both.u == least.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: of each node, the smaller neighbours and itself move to the least
        e = checkpointed(e)
        least = checkpointed(e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"))
        moved = e.join(least, e.u == least.k)
        e = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        e = checkpointed(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
