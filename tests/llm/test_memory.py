"""What tasks hold at once, and what workers keep between tasks."""

import os
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from querykiln.llm.common import gives_back

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_stages_of_the_pipeline_pass_small_batches(spark, monkeypatch):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"texts": [batch.num_rows], "bytes": [batch.nbytes]})

    spark.conf.unset(LIMIT)
    docs = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("word "), 400).alias("text"))
    monkeypatch.setattr(corpus_pipeline.mixing, "mix", lambda d: d.mapInArrow(sizes, "texts long, bytes long"))
    try:
        got = corpus_pipeline.mixed(spark, docs, "").collect()
        assert sum(r["texts"] for r in got) == 6000
        assert max(r["bytes"] for r in got) < 5 << 20
        monkeypatch.setattr(corpus_pipeline, "small_batches", lambda spark: 1 / 0)
        for _, stage in corpus_pipeline.STAGES:
            with pytest.raises(ZeroDivisionError):
                stage(spark, docs, "")
    finally:
        spark.conf.unset(LIMIT)


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_memory_of_a_task_goes_back():
    last = []

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGESIZE") >> 20

    def run(batches):
        held = [b"x" * (60_000 + i % 7) for i in range(4000)]
        last.append(b"y" * 60_000)  # stays, above all that goes
        for batch in batches:
            yield batch + len(held)

    before = resident()
    assert list(gives_back(run)(iter([1, 2]))) == [4001, 4002]
    assert resident() - before < 120
