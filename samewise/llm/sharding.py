"""Shards by rendezvous hashing: each key goes to the shard whose hash of key and shard weighs most.

A shard's bid for a key is weight / -ln(u), u in (0, 1) taken from md5("key:shard"), so a shard gets
keys in proportion to its weight, and a shard that joins takes keys only into itself. Only built-in
functions run. Slots within a shard come from ranks within (shard, salt) and the sums of the salts
before, so no task ever holds a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the first 13 hex digits (52 bits) of md5."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0 up) of the highest bid; the lower number wins a tie. A null key counts as an empty one."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    key = F.coalesce(key.cast("string"), F.lit(""))
    if len(set(weights)) == 1:  # the order of the bids is that of u
        bids = [F.struct(uniform(key, s).alias("bid"), F.lit(-s).alias("shard")) for s in range(len(weights))]
    else:
        bids = [F.struct((F.lit(w) / -F.log(uniform(key, s))).alias("bid"), F.lit(-s).alias("shard")) for s, w in enumerate(weights)]
    best = F.greatest(*bids) if len(bids) > 1 else bids[0]
    return (-best["shard"]).cast("int")


def slots(rows: DataFrame, shard: str, salt: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Adds a gapless number from 0 within each shard: by salt, then by `order` within it."""
    within = Window.partitionBy(shard, salt)
    counts = rows.groupBy(shard, salt).agg(F.count("*").alias("_n"))
    before = counts.select(F.col(shard).alias("_shard"), F.col(salt).alias("_salt"), (F.sum("_n").over(Window.partitionBy(shard).orderBy(salt)) - F.col("_n")).alias("_before"))
    ranked = rows.withColumn("_rank", F.row_number().over(within.orderBy(*order)) - 1)
    return ranked.join(before, (ranked[shard] == before["_shard"]) & (ranked[salt] == before["_salt"])).withColumn(slot, F.col("_before") + F.col("_rank")).drop("_shard", "_salt", "_before", "_rank", "_n")


def sharded(docs: DataFrame, weights: list[float], grown: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text", salts: int = 1024) -> DataFrame:
    """Rows (id_col, size, text_crc32, law, shard, slot, grown_shard); only the key and the weights decide.

    size: UTF-8 bytes of the text and 1 more (null text: as if empty). Repeated keys share a shard and get
    slots of their own; an empty table gives an empty one; other columns go, whatever their names. Texts stay in the scan: the shuffled rows are a few numbers.
    """
    grown = grown or [*weights, weights[-1]]
    text = F.coalesce(F.col(text_col), F.lit(""))
    salt = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(salts)).cast("int")
    rows = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), rendezvous(F.col(id_col), weights).alias("shard"), rendezvous(F.col(id_col), grown).alias("grown_shard"), salt.alias("_salt0"))
    out = slots(rows, "shard", "_salt0", [id_col, "text_crc32", "size"])
    return out.select(id_col, "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
