"""Secrets in texts: known forms, and strings that a character model takes for random.

Two first-order Markov models of characters are counted from labelled samples, one of random strings and
one of ordinary identifiers. A token's log-likelihood ratio is the sum of the ratios of its transitions, so
the models come down to one table over pairs of characters. All of it is built-in functions; a token's
transitions are looked up in an array constant.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import matches, quoted

#: Kind, pattern, least length of the match (of group 2 for assign).
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"AKIA[A-Z0-9]+", 20),
    ("hex", r"[0-9a-f]+", 24),
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Tokens that the models judge, and the log odds from which one is taken for random.
TOKEN, LEAST_RATIO = r"[A-Za-z0-9+/_=-]{16,}", 12.0
SAMPLES = 4096
MASK = "[REDACTED]"
#: Words that identifiers are made of, in the labelled sample of ordinary ones.
PARTS = "get set user name id list item index file path data base value key node tree table row column count size type class string number array buffer cache config option error event handler manager service client server request response message session account order product report image test build version update create delete insert select filter default system process thread queue stack map view model main index page form button label text color width height start end first last next prev http https www com org html src lib util helper common internal public static final".split()


def samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """Labelled rows (text, random): random hex, base64 and capital strings from digests of counters; identifiers in the usual styles."""
    made = spark.range(n).withColumn("h", F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")).cast("binary"), 256))
    capitals = F.translate(F.upper(F.regexp_replace(F.base64(F.unhex("h")).cast("string"), "[^A-Za-z0-9]", "")), "10", "AB")
    random = made.select(F.explode(F.array(F.substring("h", 1, 40), F.regexp_replace(F.base64(F.unhex("h")).cast("string"), "=+$", ""), F.substring(capitals, 1, 24))).alias("text"), F.lit(True).alias("random"))
    part = F.array(*[F.lit(p) for p in PARTS])

    def word(k: int) -> Column:
        return F.element_at(part, (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(PARTS))) + 1).cast("int"))

    w = [word(k) for k in range(5)]
    title = [F.initcap(x) for x in w]
    number = F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(100)).cast("string")
    styles = [F.concat_ws("_", *w[:4]), F.concat(w[0], *title[1:4]), F.concat(*title[:4]), F.concat_ws("-", *w[:4]), F.upper(F.concat_ws("_", *w[:3])), F.concat_ws("/", *w), F.concat(*w[:4]), F.concat(F.concat_ws("_", *w[:3]), F.lit("_"), number), F.concat(*title[:3], number), F.upper(F.concat(*w[:4])), F.concat_ws("=", w[0], w[1])]
    plain = made.select(F.explode(F.array(*styles)).alias("text"), F.lit(False).alias("random"))
    return random.unionByName(plain)


def codes(text: str) -> str:
    """SQL for the numbers (1 up) of a token's characters in ALPHABET."""
    place = json.dumps([ALPHABET.find(chr(c)) + 1 for c in range(128)])
    return f"transform(split({text}, ''), c -> from_json('{place}', 'array<int>')[ascii(c)])"


def ratios(labelled: DataFrame) -> list[float]:
    """Table over (character before, character), 0 for none before: the log of the ratio of smoothed transition shares.

    Counted in Spark; what is collected is bounded by the alphabet. Samples with other characters, nulls
    and empty ones don't count.
    """
    n = len(ALPHABET) + 1
    own = labelled.where(F.col("text").rlike(r"^[A-Za-z0-9+/_=-]+\z")).select("random", F.expr(codes("text")).alias("c"))
    pairs = own.select("random", F.explode(F.expr(f"transform(c, (x, i) -> CASE WHEN i = 0 THEN 0 ELSE c[i - 1] END * {n} + x)")).alias("pair"))
    counts = pairs.groupBy("pair").agg(*[F.sum(F.when(F.col("random") == r, 1).otherwise(0)).alias(name) for name, r in (("a", True), ("b", False))])
    every = labelled.sparkSession.range(n * n).join(F.broadcast(counts), F.expr("id = pair"), "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in "ab"])
    sums = every.groupBy((F.col("id") / n).cast("int").alias("k")).agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    table = every.join(F.broadcast(sums), F.expr(f"cast(id / {n} AS int) = k")).select("id", F.expr(f"round(ln((a + 0.5) / (sa + {n / 2})) - ln((b + 0.5) / (sb + {n / 2})), 4)").alias("r"))
    return [r["r"] for r in table.orderBy("id").collect()]


def ratio(token: str, table: list[float]) -> str:
    """SQL for the log-likelihood ratio of a token over ALPHABET."""
    pairs = f"a.p * {len(ALPHABET) + 1} + c"
    step = f"named_struct('p', c, 's', a.s + from_json('{json.dumps(table)}', 'array<double>')[{pairs}])"
    return f"aggregate({codes(token)}, named_struct('p', 0, 's', 0D), (a, c) -> {step}, a -> a.s)"


def found(pattern: str, order: int, keep: str) -> str:
    """SQL for the kept matches of a pattern in `_text`, as structs (start, kind, end) in code points."""
    return f"transform(filter({matches('_text', pattern)}, x -> {keep}), x -> named_struct('start', x.start, 'kind', {order}, 'end', x.end))"


def scanned(docs: DataFrame, table: list[float] | None = None, least_ratio: float = LEAST_RATIO, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id_col, *keep, base, all): arrays of (start, kind, end), ordered; kind is a place in KINDS, or 3 for markov.

    Null texts count as empty. Base matches are leftmost and do not overlap within a kind; kinds may
    overlap each other. Random tokens that a base match covers are not added again. Repeated rows stay; an empty
    table gives an empty one; columns not in `keep` go, whatever their names. Tokens without a digit or without a letter are not judged by the models.
    """
    table = table or ratios(samples(docs.sparkSession))
    text = f"coalesce(`{text_col}`, '')"
    base = []
    for k, (kind, pattern, least) in enumerate(KINDS):
        if kind == "assign":
            base.append(found(pattern, k, f"length(regexp_extract(x.text, {quoted(pattern)}, 2)) >= {least}"))
        else:  # a run is as long as it can be, so a longer one is never lost by asking for its length at once
            base.append(found(pattern[:-1] + "{%d,}" % (least - 4 * (kind == "access")), k, "true"))
    mixed = "x.text rlike '[0-9]' AND x.text rlike '[A-Za-z]'"
    tokens = found(TOKEN, 3, f"{mixed} AND {ratio('x.text', table)} >= {least_ratio}")
    rows = docs.select(id_col, *keep, F.expr(text).alias("_text"))
    rows = rows.select(id_col, *keep, F.expr(f"array_sort(concat({', '.join(base)}))").alias("base"), F.expr(tokens).alias("more"))
    added = "filter(more, t -> NOT exists(base, b -> b.start <= t.start AND b.end >= t.end))"
    return rows.select(id_col, *keep, "base", F.expr(f"array_sort(concat(base, {added}))").alias("all"))


def listed(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k, _, _ in KINDS) + ", 'markov'"
    return F.expr(f"array_join(transform({spans}, s -> concat(array({names})[s.kind], ':', s.start, ':', s.end)), ',')")


def redacted(text: str, spans: str) -> Column:
    """The text with MASK in place of each span; spans that overlap are one."""
    step = "named_struct('end', greatest(a.end, s.end), 'left', CASE WHEN s.start >= a.end THEN concat(a.left, array(named_struct('a', a.end, 'b', s.start))) ELSE a.left END)"
    gaps = f"aggregate({spans}, named_struct('end', 0, 'left', cast(array() AS array<struct<a: int, b: int>>)), (a, s) -> {step}, a -> concat(a.left, array(named_struct('a', a.end, 'b', length({text})))))"
    return F.expr(f"CASE WHEN size({spans}) = 0 THEN {text} ELSE array_join(transform({gaps}, g -> substring({text}, g.a + 1, g.b - g.a)), '{MASK}') END")


def digests(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_assign, n_access, n_hex, base_sha256 and spans."""
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) AS long)").alias(f"n_{kind}") for k, (kind, _, _) in enumerate(KINDS)]
    return rows.select(id_col, *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("all").alias("spans"))
