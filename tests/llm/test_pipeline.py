"""The pipeline stage by stage against plain versions, and the registered queries."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline

from .helpers import DOCS, awkward_docs, components
from .test_near_copies import plain_set
from .test_quality import plain_measures
from .test_substrings import plain_words

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The stored result of every stage over the smallest documents."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
    return dict(zip([*STAGES, "result"], [*out, docs], strict=True))


def test_names_and_columns(stages):
    assert list(STAGES) == ["quality_rules", "language_id", "simhash_dedup", "substring_dedup", "best_fit_packing"]
    for name in STAGES:
        assert stages[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage(stages):
    def kept(text):
        n, chars, symbols, dup, repeated = plain_measures(text)
        lines = [x for x in text.split("\n") if x.encode().split()]
        upper, ascii_ = sum("A" <= c <= "Z" for c in text), sum(c.isascii() and c.isalpha() for c in text)
        return not (n < 50 or 2 * repeated > n or 10 * symbols > n or chars < 3 * n or chars > 10 * n or 10 * dup > 3 * len(lines) or 2 * upper > ascii_ or 5 * text.count("!") > n or 2 * sum(c.isalpha() for c in text) < chars)

    before = {r.doc_id: r.text for r in stages["quality_rules"].collect()}
    assert {r.doc_id for r in stages["language_id"].collect()} == {d for d, t in before.items() if kept(t)}


def test_language_stage_keeps_clean_text(stages):
    assert stages["simhash_dedup"].count() == stages["language_id"].count()


def test_language_stage_drops_what_no_known_language_explains(spark):
    """Planted texts declare a language of the corpus and go all the same; without any label nothing is known, so nothing stays."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    like = docs.filter("lang IS NOT NULL").first()
    texts = ["ქართული ენა არის დამწერლობა და სხვა ენები " * 20, "qzjwvkxq vzkqjx wqxzv jkqxz " * 60, "12 34 56 " * 60, None]
    planted = spark.createDataFrame([(-i - 1, t, like.lang, like.source, 1) for i, t in enumerate(texts)], docs.schema)
    stage = STAGES["language_id"]
    kept = [r.doc_id for r in stage(spark, docs.unionByName(planted), SF).collect()]
    assert sorted(kept) == sorted(r.doc_id for r in docs.filter("text IS NOT NULL AND text RLIKE '[A-Za-z]'").collect())
    assert stage(spark, docs.withColumn("lang", F.lit(None).cast("string")), SF).count() == 0


def test_near_copy_stage(stages):
    """One document of each group that five-word Jaccard similarities of 0.8 and more connect, by brute force."""
    rows = sorted((r.doc_id, r.text) for r in stages["simhash_dedup"].collect())
    sets = [plain_set(text) for _, text in rows]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = components(len(rows), links)
    place = {doc_id: i for i, (doc_id, _) in enumerate(rows)}
    assert links and Counter(root[place[r.doc_id]] for r in stages["substring_dedup"].collect()) == Counter(set(root))


def test_passage_stage(stages):
    rows = [tuple(r) for r in stages["substring_dedup"].collect()]
    got = {r.doc_id: r for r in stages["best_fit_packing"].collect()}
    for doc_id, _, removed, words in plain_words(rows, 35):
        assert b" ".join(got[doc_id].text.encode().split()).decode() == words
        assert not removed or got[doc_id].n_chars == len(got[doc_id].text)


def test_packing_stage(stages):
    assert {r.doc_id for r in stages["result"].collect()} == {r.doc_id for r in stages["best_fit_packing"].collect()}


@pytest.mark.parametrize("name", list(STAGES))
@pytest.mark.parametrize("rows", ["awkward", "empty", "null"])
def test_stages_take_any_rows(spark, name, rows):
    data = {"awkward": awkward_docs(), "empty": [], "null": [(None, None, None, None, None)] * 3}[rows]
    docs = spark.createDataFrame(data, DOCS + ", kept string, _row2 int" if not data else DOCS)
    out = STAGES[name](spark, docs, SF)
    assert out.count() <= max(len(data), 1) * 60 and (name == "best_fit_packing" or out.columns == ["doc_id", "text", "lang", "source", "n_chars"])


def test_repeated_rows_leave_one(spark):
    row = awkward_docs()[11]
    docs = spark.createDataFrame([row] * 5, DOCS)
    assert STAGES["simhash_dedup"](spark, docs, SF).count() == 1


def test_run_equals_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").exceptAll(stages["result"].drop("sequence_id", "offset")).count() == 0


@pytest.mark.parametrize("number", range(1, 11))
def test_registered_queries(spark, number):
    name = next(n for n in entry_point.queries() if n.startswith(f"op{number}_"))
    table = {1: "pages", 4: "embeddings", 8: "pages"}.get(number, "documents")
    got = entry_point.queries()[name](spark, SF)
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert got.count() >= rows if number == 7 else got.count() == rows
    if sql := entry_point.oracle_sql().get(name):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)
