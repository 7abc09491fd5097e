"""What the stages leave on disk: no numbered copy of a stored table, no shuffle files, no tables of finished rounds."""

import os

import pytest

import corpus_pipeline
from oncekeep.llm.common import DOCUMENT_COLUMNS, numbered
from oncekeep.llm.components import connected
from oncekeep.session import FREE_SHUFFLES, scratch_dir

from .helpers import DOCS, prose

STAGES = dict(corpus_pipeline.STAGES)


def tables(spark):
    folder = os.path.join(scratch_dir(spark), "tables")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(i % 7, prose(i // 2, 90), "en", "s", 1) for i in range(60)]
    spark.createDataFrame(rows, DOCS).select(*DOCUMENT_COLUMNS).repartition(4).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def test_rows_of_a_scan_are_numbered_without_a_copy(spark, stored):
    before, rows = tables(spark), numbered(stored, "_row")
    want = sorted(tuple(r) for r in rows.collect())
    assert len({r[-1] for r in want}) == stored.count() and tables(spark) == before
    assert rows.columns == [*stored.columns, "_row"]
    size = "spark.sql.files.maxPartitionBytes"
    kept = spark.conf.get(size)
    try:
        spark.conf.set(size, "2k")
        assert sorted(tuple(r) for r in rows.collect()) == want
    finally:
        spark.conf.set(size, kept)


@pytest.mark.parametrize("change", ["filter", "union", "join", "columns"])
def test_other_rows_are_written_with_their_numbers(spark, stored, change):
    docs = {"filter": lambda d: d.filter("doc_id > 2"), "union": lambda d: d.unionByName(d), "join": lambda d: d.join(d.select("doc_id").withColumnRenamed("doc_id", "x"), d.doc_id > 3), "columns": lambda d: d.select("text", "doc_id")}[change](stored)
    before, rows = tables(spark), numbered(docs, "_row")
    assert len(tables(spark) - before) == 1
    assert rows.count() == rows.select("_row").distinct().count() == docs.count()


def test_components_keep_their_last_table_only(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    before, found = tables(spark), connected(edges)
    assert len(tables(spark) - before) == 1
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(21)}


@pytest.mark.parametrize("name", ["language_id", "simhash_dedup", "substring_dedup"])
def test_stages_keep_no_copy_of_their_input(spark, stored, name):
    spark.conf.set(FREE_SHUFFLES, "false")
    before = tables(spark)
    STAGES[name](spark, stored, "").count()
    assert not [t for t in tables(spark) - before if t.startswith("numbered-")]
    assert spark.conf.get(FREE_SHUFFLES) == "true"


def test_repeated_bytes_of_a_table_need_no_numbered_copy(spark, stored, tmp_path):
    from oncekeep.llm.queries import QUERIES

    stored.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    before = tables(spark)
    got = QUERIES["op10_suffix_array_dedup"](spark, str(tmp_path / "sf"))
    assert got.count() == stored.count() and got.filter("n_removed > 0").count() > 0
    assert not [t for t in tables(spark) - before if t.startswith("numbered-")]
