"""Checks of result files: one table of violations (rule, severity, key, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADERS = {"matching": "source1_entity_id\tmatched_entity_ids", "candidate": "source1_entity_id\tcandidate_entity_ids"}


def found(df: DataFrame, rule: str, severity: str, key, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Violations of the file's form: missing, empty, header, lines without a tab."""
    try:
        text = spark.read.text(path).withColumn("no", F.monotonically_increasing_id())
        first = text.orderBy("no").limit(1).collect()
    except Exception as e:  # a path that is not there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return found(spark.range(1), "missing_file", "fatal", F.lit(path), F.lit(""))
    if not first:
        return found(spark.range(1), "empty_file", "fatal", F.lit(path), F.lit(""))
    header = found(spark.range(1).where(F.lit(first[0]["value"] != HEADERS[kind])), "header", "fatal", F.lit(path), F.lit(first[0]["value"]))
    untabbed = text.where((F.col("no") > first[0]["no"]) & (F.col("value") != "") & ~F.contains("value", F.lit("\t")))
    return header.unionByName(found(untabbed, "no_tab", "error", F.col("value"), F.lit("")))


def lists(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """(source1_entity_id, id) of comma lists; ids are not trimmed, empty parts go."""
    return rows.select("source1_entity_id", F.explode(F.filter(F.split(F.coalesce(ids, F.lit("")), ","), lambda x: x != "")).alias("id"))


def check_lists(rows: DataFrame, entities: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Violations among rows (source1_entity_id, ids). known: (entity_id) of all candidates, to look ids up."""
    flat = lists(rows)
    of, i = F.col("source1_entity_id"), F.col("id")
    twice = rows.groupBy("source1_entity_id").count().where("count > 1")
    repeated = flat.groupBy("source1_entity_id", "id").count().where("count > 1")
    own = entities.select("source1_entity_id").distinct()
    out = found(twice, "duplicate_row", "error", of, F.col("count"))
    out = out.unionByName(found(repeated, "duplicate_id", "error", of, i))
    out = out.unionByName(found(flat.where(i.startswith("S1-")), "self_match", "error", of, i))
    out = out.unionByName(found(flat.where(~i.startswith("S1-") & ~i.rlike("^S[23]-")), "bad_prefix", "error", of, i))
    out = out.unionByName(found(own.join(rows, "source1_entity_id", "left_anti"), "missing_entity", "error", of, F.lit("")))
    out = out.unionByName(found(rows.join(own, "source1_entity_id", "left_anti").distinct(), "extra_entity", "error", of, F.lit("")))
    if known is not None:
        lost = flat.where(i.rlike("^S[23]-")).join(known.select(F.col("entity_id").alias("id")), "id", "left_anti")
        out = out.unionByName(found(lost, "unknown_id", "error", of, i))
    return out


def check_subset(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Warnings for matched ids that are not candidates of their entity."""
    lost = lists(matches).join(lists(candidates), ["source1_entity_id", "id"], "left_anti")
    return found(lost, "not_a_candidate", "warning", F.col("source1_entity_id"), F.col("id"))


def summary(violations: DataFrame, examples: int = 5) -> DataFrame:
    """(rule, severity, n, examples): counts and up to five keys, in order."""
    from pyspark.sql import Window

    w = Window.partitionBy("rule", "severity")
    ranked = violations.select("rule", "severity", "key").withColumns({"_k": F.dense_rank().over(w.orderBy("key"))})
    return ranked.groupBy("rule", "severity").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("_k") <= examples, F.col("key")))), ",").alias("examples"))


def exit_code(violations: DataFrame) -> int:
    return int(violations.where("severity <> 'warning'").limit(1).count() > 0)
