"""Results do not depend on how a table is split from one scan to the next."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from oncekeep.llm import substring_arrays, substring_automata

from .helpers import prose

STEPS = {
    "op6": (lambda spark, docs: substring_automata.remove_repeated_passages(docs), "n_removed"),
    "op10": (lambda spark, docs: substring_arrays.remove_repeated_bytes(docs), "n_removed"),
    "near copies": (lambda spark, docs: dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, ""), "text"),
}


@pytest.mark.parametrize("name", list(STEPS))
def test_splits_that_change_between_scans(spark, tmp_path, name):
    texts = [prose(i, 120) for i in range(300)]
    for i in range(0, 300, 3):
        texts[i + 1] = texts[i]
    table = pa.table({"doc_id": range(300), "text": texts, "lang": ["en"] * 300, "source": ["s"] * 300, "n_chars": [len(t) for t in texts]})
    pq.write_table(table, tmp_path / "docs.parquet", row_group_size=10)
    docs, (step, column) = spark.read.parquet(str(tmp_path / "docs.parquet")), STEPS[name]
    want = sorted((r.doc_id, r[column]) for r in step(spark, docs).collect())
    got, size = step(spark, docs), "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, "20k")
        assert docs.rdd.getNumPartitions() > 1
        assert sorted((r.doc_id, r[column]) for r in got.collect()) == want
    finally:
        spark.conf.set(size, before)
