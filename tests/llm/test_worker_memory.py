"""Python workers outlive their tasks: what one stage leaves in them counts while the next one runs."""

import re

import numpy as np
import pyarrow as pa

from samewise.llm import common, packing
from samewise.llm.queries import tokenizer


def held() -> int:
    """MB of this process."""
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) >> 10


def test_packing_leaves_no_words_in_a_worker(spark):
    path = tokenizer("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, " ".join(f"word{i}x{j}" for j in range(50))) for i in range(40)], "doc_id long, text string").coalesce(1)
    assert packing.cut(docs, path, 2048, 1).count() == 40

    def probe(batches):
        memo = packing.word_ids(path).memo
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(memo.young) + len(memo.old)], pa.int64())], ["n"])

    assert [r["n"] for r in spark.range(0, 12, 1, 12).mapInArrow(probe, "n long").collect()] == [0] * 12


def test_freed_memory_goes_back_when_a_task_ends():
    def run(batches):
        some = [np.ones(12_000) for _ in range(2000)]  # below the size that the C library maps apart
        kept.append(some[-1])
        del some
        yield from batches

    kept, before = [], held()
    assert list(common.tidied(run)(iter([1, 2]))) == [1, 2] and held() < before + 60
    assert common.released([3]) == [3]
