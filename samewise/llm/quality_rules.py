"""Quality rules whose thresholds come from the corpus: quantile sketches per language and source.

Each rule watches one ratio of a document. Its sketch is a histogram over values rounded down to six
significant bits (a relative error below 1/32 at any size), so sketches merge by adding counts: those of a source
give those of its language, and these the one of the corpus. A fence lies beyond a tail quantile of the sketch by
a multiple of that quantile's distance from the median, so where documents spread more, more is let pass. Fences of a group are
means of its own and its language's, weighted by its documents against PRIOR, and those of a language of its own
and the corpus's. A document fails a rule if its count lies beyond the fence by more than counting noise (Z standard
errors of such a count), so that short texts are not judged by one odd line. Nothing is collected; what is shuffled are counts per bucket.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, pieces

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SPACES = " \t\n\v\f\r"
#: Rule: (count, what it is a share of, scale of the ratio, words or lines that come at once, lower fence wanted).
RULES = {
    "word_length": ("word_chars", "n_words", 100, 1, True),
    "symbols": ("n_symbols", "n_words", 10_000, 1, False),
    "dup_lines": ("n_dup_lines", "n_lines", 10_000, 1, False),
    "repeats": ("n_repeat_words", "n_words", 10_000, 5, False),
}
#: The tail quantile of a fence in hundredths, fence distance in distances of it from the median, documents that a
#: parent's fence counts for, and standard errors by which a document must pass a fence.
TAIL, SPREAD, PRIOR, Z = 85, 2, 100, 3


def counts_of(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text. Words are runs of anything but ASCII white space."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode().split()  # of bytes, split() knows just the six ASCII white spaces
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) < len(windows):
        often, until = Counter(windows), 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 5 - max(i, until)
                until = i + 5
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeated, len(lines))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (doc_id, lang, source, COUNTS, base_failed); one narrow pass over whole texts, null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = zip(*map(counts_of, batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "lang", "source")] + [pa.array(x, pa.int64()) for x in found], ["doc_id", "lang", "source", *COUNTS])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))
    return out.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n): the mergeable sketch of each rule's ratio over the documents with words.

    The bucket of a value is the value with all but its six leading bits cleared.
    """
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.expr(f"{scale} * {count} DIV greatest({of}, 1)").alias("v")) for k, (count, of, scale, _, _) in RULES.items()]))
    flat = rows.where("n_words > 0").select("lang", "source", values.alias("x")).select("lang", "source", "x.rule", "x.v")
    low = "greatest(length(bin(v)) - 6, 0)"
    return flat.groupBy("lang", "source", "rule", F.expr(f"shiftleft(shiftright(v, {low}), {low})").alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], tail: int = TAIL) -> DataFrame:
    """(keys, rule, low, mid, high, rows): of each group and rule, the smallest buckets with a share of 1 - tail, a half and tail of the rows at or below them."""
    merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "rule")
    runs = merged.withColumns({"below": F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)), "rows": F.sum("n").over(by)})
    cut = [F.min(F.expr(f"CASE WHEN 100 * below >= {share} * rows THEN bucket END")).alias(name) for name, share in (("low", 100 - tail), ("mid", 50), ("high", tail))]
    return runs.groupBy(*keys, "rule").agg(*cut, F.max("rows").alias("rows"))


def fences(rows: DataFrame, tail: int = TAIL, spread: int = SPREAD, prior: int = PRIOR) -> DataFrame:
    """(lang, source, <rule>_low, <rule>_high) for every group."""
    sketch = checkpointed(sketches(rows))
    ends = [f"low - {spread} * (mid - low) AS low", f"high + {spread} * (high - mid) AS high"]
    own, lang, whole = (quantiles(sketch, keys, tail).selectExpr(*keys, "rule", "rows", *ends) for keys in (["lang", "source"], ["lang"], []))
    mean = "(o.rows * o.{0} + {1} * p.{0}) / (o.rows + {1}) AS {0}"
    both = [mean.format(c, prior) for c in ("low", "high")]
    lang = lang.alias("o").join(whole.alias("p"), F.expr("o.rule = p.rule")).selectExpr("o.lang", "o.rule", *both)
    own = own.alias("o").join(lang.alias("p"), F.expr("o.lang <=> p.lang AND o.rule = p.rule")).selectExpr("o.lang", "o.source", "o.rule", *both)
    found = [F.max(F.expr(f"CASE WHEN rule = '{k}' THEN {side} END")).alias(f"{k}_{side}") for k, rule in RULES.items() for side in ("low", "high") if rule[4] or side == "high"]
    return own.groupBy("lang", "source").agg(*found)


def fails(rule: str, z: int = Z) -> str:
    """SQL for whether a document with words fails a rule, given the columns of fences()."""
    count, of, scale, unit, lower = RULES[rule]
    beyond = "({0} {1} {2} AND ({0} - {2}) * ({0} - {2}) > {3} * {4})"
    high, low = f"{rule}_high * {of} / {scale}", f"{rule}_low * {of} / {scale}"
    over = beyond.format(count, ">", f"({high})", z * z * unit, count)
    return f"n_words > 0 AND ({over}" + (f" OR {beyond.format(count, '<', f'({low})', z * z * unit, f'({low})')}" if lower else "") + ")"


def quality_rules(docs: DataFrame, tail: int = TAIL, spread: int = SPREAD, prior: int = PRIOR, z: int = Z, **columns: str) -> DataFrame:
    """Every document with its counts, `base_failed`, `failed` (names of the rules it breaks) and `kept`.

    Null texts have no words and fail the base rule; null languages and sources are groups of their
    own; repeated rows count each time and stay; other columns go, whatever their names; an empty table gives an empty one.
    The counts are checkpointed, so texts are read once though the thresholds need a pass before the filter. The join
    with the fences is an ordinary one that Spark may broadcast by measured size or split where skewed.
    """
    rows = checkpointed(measured(docs, **columns))
    limits = fences(rows, tail, spread, prior).alias("f")
    tests = [F.expr(f"CASE WHEN {fails(k, z)} THEN '{k}' END") for k in RULES]
    out = rows.alias("r").join(limits, F.expr("r.lang <=> f.lang AND r.source <=> f.source"), "left")
    out = out.select("r.*", F.concat_ws(",", *tests).alias("failed"))
    return out.withColumn("kept", F.expr("NOT base_failed AND failed = ''"))
