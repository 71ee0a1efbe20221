"""Documents that every operator must take: nulls, empty and long texts, copies, clashing columns."""

WORDS = "the of and to in that with for was is on as by at from thing thereon ander wherein tion".split()


def texts(seed: int = 7, n: int = 40) -> list[str | None]:
    import random

    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) + r.choice(["", "er", "s", "ing"]) for _ in range(r.randint(1, 120))) for _ in range(n)]
    passage = "This passage of well over fifty bytes is found in a good many of the documents here."
    near = base[5] + " and one more word"
    odd = [None, "", "   \t\n", "one", "one two", "é ü 😀 ▁ \x00 <s>\x0bx", base[0], base[0], base[1], near, near.replace("word", "term")]
    shared = [f"{base[i]}\n{passage}\n{base[i + 1]}" for i in range(8)]
    long = " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(20_000))
    return base + odd + shared + [long, "x" * 9_000, "line\nline\nother\nline\n\n"]


def documents(spark, rows=None, extra=True):
    """rows: (doc_id, text, lang, source); doc ids are spread, and one of them is null."""
    rows = rows if rows is not None else [(i * 3 if i != 4 else None, t, None if i % 7 == 3 else "en" if i % 3 else "de", None if i % 11 == 5 else f"src{i % 4 // 2}") for i, t in enumerate(texts())]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) AS n_chars")
    if extra:
        out = out.selectExpr("*", "1 AS n_words", "'a' AS size", "2.5 AS shard", "'x' AS ids", "0 AS id", "0 AS length", "'s' AS spans", "'k' AS kept", "'f' AS fingerprint", "1 AS a", "2 AS b", "'u' AS _salt")
    return out.repartition(5)


def write_tables(spark, path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)
