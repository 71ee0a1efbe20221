import collections
import random

import corpus_pipeline
from samewise.llm import quality_model
from tests.llm.fixtures import documents, write_tables
from tests.llm.test_near_texts import brute_components
from tests.llm.test_op3_op4 import brute_base


def corpus(spark, path):
    r = random.Random(12)
    word = lambda: "".join(r.choice(["the", "er", "in", "th", "an", "re", "on", "ü"]) for _ in range(r.randint(1, 4)))
    passage = " ".join(word() for _ in range(40))
    rows, labels = [], []
    for i in range(240):
        w = [word() for _ in range(r.randint(5, 120))]
        good = i % 4 > 0
        text = " ".join(w if good else [x + r.choice(["***", "###", "%%%"]) for x in w])
        if i % 9 == 1:
            text += f"\ntoken = \"{r.getrandbits(160):040x}\" end"
        if i % 7 == 2:
            text = text[: len(text) // 2] + "\n" + passage + "\n" + text[len(text) // 2 :]
        rows.append((i, text, "en", f"s{i % 3}"))
        if i % 3:
            labels.append((i, int(good), 0))
    rows += [(300 + i, rows[4 * i + 1][1] + (" more" if i % 2 else ""), "en", "s") for i in range(20)] + [(5, rows[5][1], "en", "s"), (400, None, None, None), (401, "", "en", "s"), (None, rows[1][1], "en", "s")]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return write_tables(spark, path, documents=documents(spark, rows, extra=False), labels=table)


def brute_cut(rows, width=50):
    least, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - width + 1) if i is not None else ():
            least[b[k : k + width]] = min(least.get(b[k : k + width], i), i)
    for i, t in rows:
        b, gone = (t or "").encode(), set()
        for k in range(len(b) - width + 1) if i is not None else ():
            if least[b[k : k + width]] < i:
                gone.update(range(k, k + width))
        text, at = "", 0
        for c in t or "":
            n = len(c.encode())
            if not gone.intersection(range(at, at + n)):
                text += c
            at += n
        if not gone or text:
            out.append((i, text))
    return out


def brute_mask(t):
    spans = sorted(tuple(map(int, s.split(":")[1:])) for s in brute_base(t))
    out, end = [], 0
    for a, b in spans:
        if a >= end:
            out.append(t[end:a])
        end = max(end, b)
    return "[REDACTED]".join([*out, t[end:]])


def test_pipeline_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    path = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = quality_model.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    rows = [(i, t) for i, t in rows if model.score(quality_model.indicators(t)) >= 0.5]
    comp = brute_components(rows)
    kept, seen = [], set()
    for i, t in rows:
        if i is None or comp[i] == i and i not in seen:
            seen.add(i)
            kept.append((i, t))
    texts = [(i, brute_mask(t)) for i, t in brute_cut(kept)]
    tok = Tokenizer.from_file(corpus_pipeline.tokenizer("word_bpe_49k.json"))
    want = collections.Counter((i, len(tok.encode(t, add_special_tokens=False).ids) + 1) for i, t in texts)
    got = corpus_pipeline.run(spark, path).collect()
    assert collections.Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == want
    held = [i for i, _ in texts if i is not None and i < 240]
    assert sum(i % 4 > 0 for i in held) == len(held) and len(held) > 150


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    path = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.selectExpr("*", "1 AS id", "2 AS n"), path)
        assert out.dtypes == docs.dtypes
        assert out.where("text IS NOT NULL AND n_chars <> length(text)").count() == 0
        assert stage(spark, docs.where("1 = 0"), path).count() == 0
