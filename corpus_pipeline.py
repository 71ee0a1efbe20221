"""From raw documents to training sequences: five of the corpus operators one after another.

Documents of low quality go; of near-copies one stays; byte strings that an earlier document has are cut;
secrets are masked; what is left is packed. Each stage works on all that the one before has kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.llm import packing, quality_model, secrets, simhash, suffix_dedup
from samewise.llm.common import checkpointed, remove, small, stored, table
from samewise.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
N_CHARS = "cast(length(text) AS bigint) AS n_chars"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; it learns from labels of rows that are not held out.

    Null and empty texts and rows without an id are scored like others. Columns that documents lack go, here and in all stages; repeated rows stay.
    """
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return quality_model.scored(docs, model, keep=COLUMNS[1:]).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies (5-word shingles, similarity 0.8 or more), the document with the smallest id, once.

    Rows of one id are told apart by their text. Rows without an id stay; a null text is an empty one here. What goes, or
    is there more than once, is worked out from ids and hashes alone and then taken from the texts in one join.
    """
    groups = simhash.near_texts(docs).where("doc_id IS NOT NULL").groupBy("doc_id", "t", "component", "component_id").agg(F.count("*").alias("n"))
    groups = checkpointed(groups)
    first = groups.where("doc_id = component_id").groupBy("component").agg(F.min("t").alias("first"))
    odd = groups.join(first, "component").selectExpr("doc_id AS id", "t", "doc_id = component_id AND t = first AS stays", "n").where("n > 1 OR NOT stays")
    marked = docs.select(*COLUMNS).join(small(checkpointed(odd.select("id", "t", "stays"))), F.expr("doc_id = id AND xxhash64(text) = t"), "left")
    repeated = marked.where("stays").select(*COLUMNS).dropDuplicates(["doc_id", "text"])
    return marked.where("id IS NULL").select(*COLUMNS).unionByName(repeated)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that a document with a smaller id has; documents of which nothing is left go.

    Null texts come out empty; empty texts and rows without an id stay as they are.
    """
    out = suffix_dedup.deduplicated(docs, keep=("lang", "source")).where("n_removed = 0 OR kept_text <> ''")
    return out.withColumnRenamed("kept_text", "text").selectExpr("doc_id", "text", "lang", "source", N_CHARS)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of each secret; all documents stay, null and empty texts as they are."""
    out = secrets.scanned(docs, keep=("text", "lang", "source")).withColumn("text", secrets.redacted("text", "all"))
    return out.selectExpr("doc_id", "text", "lang", "source", N_CHARS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their places in sequences of 2048 tokens. A null or empty text is its end id alone."""
    return packing.packed(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("secret scans", masked_secrets),
    ("packing", packed),
]

#: The classifier, the components and the packing plan are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each but the last is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
