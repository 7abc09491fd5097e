from collections import Counter, defaultdict

from pyspark.sql import functions as F

from oncekeep.llm import sharding

from .helpers import DOCS, awkward_docs


def test_slots_and_sizes(spark):
    docs = spark.createDataFrame(awkward_docs(), DOCS).withColumns({"shard": F.lit("clash"), "size": F.lit("clash")})
    got = sharding.shard_documents(docs, sharding.even_tree()).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == len(awkward_docs()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.size for r in got if r.text_crc32 == 0} == {16}
    assert len({r.shard for r in got if r.doc_id == 5}) == 1 and all(r.grown_shard is None for r in got)


def test_weights_and_growth(spark):
    tree = [[[(0, 1.0), (1, 3.0)], [(2, 2.0)]], [[(3, 2.0), (4, 0.0)]]]
    rows = spark.range(40_000).withColumnRenamed("id", "doc_id")
    new = sharding.Added(shard=9, weight=2.0, region=0, rack=1)
    both = sharding.assign(sharding.assign(rows, "doc_id", tree), "doc_id", tree, [new], "g_").collect()
    share = Counter(r.shard for r in both)
    for shard, weight in ((0, 1), (1, 3), (2, 2), (3, 2)):
        assert abs(share[shard] / 40_000 - weight / 8) < 0.015
    assert 4 not in share
    moved = [r for r in both if r.shard != r.g_shard]
    assert {r.g_shard for r in moved} == {9} and abs(len(moved) / 40_000 - 0.2) < 0.015
    assert {(r.g_region, r.g_rack) for r in moved} == {(0, 1)}


def test_weight_change_stays_in_its_subtree(spark):
    before = [[[(0, 1.0), (1, 1.0)], [(2, 2.0)]], [[(3, 4.0)]]]
    after = [[[(0, 1.5), (1, 0.5)], [(2, 2.0)]], [[(3, 4.0)]]]
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    both = sharding.assign(sharding.assign(rows, "doc_id", before), "doc_id", after, prefix="g_").collect()
    assert {(r.shard, r.g_shard) for r in both if r.shard != r.g_shard} == {(1, 0)}


def test_empty_table(spark):
    assert sharding.shard_documents(spark.createDataFrame([], DOCS), sharding.even_tree()).count() == 0
