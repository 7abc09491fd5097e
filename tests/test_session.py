"""Stored tables: written once, deleted on request, nothing else deleted."""

import os

import pytest

from oncekeep.session import discard, written


def test_a_stored_table_can_be_discarded(spark):
    kept, gone = written(spark.range(5), "kept"), written(spark.range(7), "gone")
    later = written(gone.join(kept, "id"), "later")
    folder = os.path.dirname(gone.inputFiles()[0]).removeprefix("file:").replace("///", "/")
    discard(gone)
    assert not os.path.exists(folder)
    assert later.count() == 5 and kept.count() == 5


def test_other_tables_are_refused(spark, tmp_path):
    path = str(tmp_path / "own")
    spark.range(3).write.parquet(path)
    own = spark.read.parquet(path)
    with pytest.raises(ValueError):
        discard(own)
    assert own.count() == 3


def test_an_empty_table(spark):
    discard(written(spark.range(0), "empty"))
