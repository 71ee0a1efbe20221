"""Readers and writers of records, link lists and results: tab-separated files without quoting, and Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalised

COLUMNS = ("entity_id", "business_name", "business_address", "country")
NORMALISED = ("entity_id", "country_key", "n_name", "s_name", "n_addr", "postal", "name_acr")


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as trimmed strings, blanks as empty ones; header names are trimmed too."""
    raw = spark.read.option("sep", "\t").option("quote", "").option("escape", "").option("header", True).option("mode", "PERMISSIVE").csv(path)
    return raw.select(*[F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c.strip()) for c in raw.columns])


def source(spark: SparkSession, path: str) -> DataFrame:
    """Records of one source with country_key; a missing column is an error."""
    df = tsv(spark, path)
    if missing := [c for c in COLUMNS if c not in df.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df.select(*COLUMNS, F.lower("country").alias("country_key"))


def split_sources(spark: SparkSession, folder: str, split: str = "train") -> dict[int, DataFrame]:
    return {k: source(spark, f"{folder}/{split}_source{k}.tsv") for k in (1, 2, 3)}


def id_list(s: Column) -> Column:
    """The distinct ids of a comma list, trimmed, without blanks."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != ""))


def id_text(ids: Column) -> Column:
    """A comma list of the distinct ids in order."""
    return F.concat_ws(",", F.array_sort(F.array_distinct(ids)))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(source1_entity_id, matched array<string>); the second column may have any name."""
    df = tsv(spark, path)
    return df.select(F.col(df.columns[0]).alias("source1_entity_id"), id_list(F.col(df.columns[1])).alias("matched"))


def links(truth: DataFrame) -> DataFrame:
    return truth.select("source1_entity_id", F.explode("matched").alias("cand_id"))


def prepared(records: DataFrame) -> DataFrame:
    return normalised(records).select(*NORMALISED)


def prepare(spark: SparkSession, path: str, out: str) -> None:
    """Normalises a source file to Parquet, split by country; leaves what is there already."""
    prepared(source(spark, path)).write.mode("ignore").option("compression", "zstd").partitionBy("country_key").parquet(out)


def country_records(spark: SparkSession, path: str, country: str | None = None, columns: tuple[str, ...] = NORMALISED) -> DataFrame:
    """Normalised records, of one country only its folder is read."""
    df = spark.read.parquet(path).select(*columns)
    return df if country is None else df.where(F.col("country_key") == country)


def restricted(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """Records that some pair refers to as a candidate."""
    return records.join(pairs.select(F.col("cand_id").alias("entity_id")).distinct(), "entity_id", "left_semi")


def encoded(entity_id: Column) -> Column:
    """S<k>-<number> as k * 2^32 + number. Zeros before the number are lost, so ids stay strings elsewhere."""
    return F.shiftleft(F.substring(entity_id, 2, 1).cast("long"), 32).bitwiseOR(F.substring_index(entity_id, "-", -1).cast("long"))


def decoded(code: Column) -> Column:
    return F.concat(F.lit("S"), F.shiftright(code, 32).cast("string"), F.lit("-"), code.bitwiseAND(F.lit((1 << 32) - 1)).cast("string"))


def results(entities: DataFrame, right: DataFrame, predicted: DataFrame, candidates: DataFrame) -> DataFrame:
    """(source1_entity_id, matched_entity_ids, candidate_entity_ids) for every entity, in order of id.

    Ids that the right side lacks go, and predictions that are no candidates.
    """
    known = right.select(F.col("entity_id").alias("cand_id")).distinct()
    c = candidates.select("source1_entity_id", "cand_id").distinct().join(known, "cand_id", "left_semi")
    p = predicted.select("source1_entity_id", "cand_id").distinct().withColumn("p", F.lit(1))
    lists = c.join(p, ["source1_entity_id", "cand_id"], "left").groupBy("source1_entity_id").agg(id_text(F.collect_list(F.when(F.col("p") == 1, F.col("cand_id")))).alias("matched_entity_ids"), id_text(F.collect_list("cand_id")).alias("candidate_entity_ids"))
    ids = entities.select(F.col("entity_id").alias("source1_entity_id")).distinct()
    return ids.join(lists, "source1_entity_id", "left").fillna("", ["matched_entity_ids", "candidate_entity_ids"]).orderBy("source1_entity_id")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("quote", "").option("emptyValue", "").option("header", True).csv(path)


def write_results(rows: DataFrame, matching: str, candidate: str) -> None:
    write_tsv(rows.select("source1_entity_id", "matched_entity_ids"), matching)
    write_tsv(rows.select("source1_entity_id", "candidate_entity_ids"), candidate)


def subset(left: DataFrame, right: DataFrame, truth: DataFrame, n: int, least: int = 20_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first n left records by id, all their links, and the first max(3n, least) other right records."""
    own = left.orderBy("entity_id").limit(n)
    some = truth.join(own.select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", "left_semi")
    linked = some.select(F.col("cand_id").alias("entity_id")).distinct()
    others = right.join(linked, "entity_id", "left_anti").orderBy("entity_id").limit(max(3 * n, least))
    return own, right.join(linked, "entity_id", "left_semi").unionByName(others).dropDuplicates(["entity_id"]), some
