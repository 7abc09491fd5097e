import math

from pyspark.sql import functions as F

from oncekeep.llm import language

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy_of_the_text_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit_text_model(docs.filter("doc_id % 2 = 0"))
    rows = language.document_evidence(docs.filter("doc_id % 2 = 1"), "doc_id").withColumns({c: F.lit(None).cast("string") for c in ("declared", "host")})
    told = language.identify(rows, model, ["doc_id"]).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()
    assert sum(r.text_lang == r.truth for r in told) >= 0.97 * len(told)


def model():
    """Two languages of one letter each."""
    import numpy as np

    logs = np.full((language.BUCKETS, 2), -10.0, dtype=np.float32)
    for i, letter in enumerate("ab"):
        logs[np.unique(language.trigrams(letter * 9)), i] = -1.0
    return language.TextModel(["aa", "bb"], logs)


FIELDS = "id long, text string, declared string, suffix string, domain string, host string"


def test_fusion_equals_the_formula(spark):
    rows = [
        (0, "aaaa", "aa", "x", "d", "h1"), (1, "aaa", "aa", "x", "d", "h1"), (2, "bbbb", "bb", "y", "d", "h2"), (3, "ab", "bb", "y", "d", "h2"),
        (4, None, None, None, None, None), (5, "", "aa", "y", "e", "h3"), (6, "123", "zz", "q", "e", "h3"), (6, "123", "zz", "q", "e", "h3"),
    ]
    m, w = model(), language.WEIGHT

    def soft(z):
        e = [math.exp(v - max(z)) for v in z]
        return [v / sum(e) for v in e]

    text = [[0.0, 0.0] if not any(c.isalpha() for c in r[1] or "") else [float(x) / language.OVERLAP for x in m.logs[language.trigrams(r[1])].sum(axis=0, dtype=float)] for r in rows]
    q, n = [soft(t) for t in text], len(rows)
    mass = [sum(x[i] for x in q) for i in (0, 1)]
    key = lambda r: (r[4] or "", r[5] or "")
    expected = []
    for k, r in enumerate(rows):
        z = []
        for i in (0, 1):
            base = (mass[i] + 1) / (n + 2)
            domain = [x for x, o in zip(q, rows, strict=True) if key(o)[0] == key(r)[0]]
            host = [x for x, o in zip(q, rows, strict=True) if key(o) == key(r)]
            above = (sum(x[i] for x in domain) - q[k][i] + w * base) / (len(domain) - 1 + w)
            prior = (sum(x[i] for x in host) - q[k][i] + w * above) / (len(host) - 1 + w)
            score = math.log(prior) + text[k][i]
            for c in (2, 3):
                if r[c] is not None:
                    same = [x for x, o in zip(q, rows, strict=True) if o[c] == r[c]]
                    score += math.log((sum(x[i] for x in same) + w * len(same) / n) / (mass[i] + w))
            z.append(score)
        p = soft(z)
        letters = any(c.isalpha() for c in r[1] or "")
        expected.append((r[0], ["aa", "bb"][p.index(max(p))], round(max(p), 9), letters and max(p) >= 0.5))
    got = language.identify(spark.createDataFrame(rows, FIELDS).withColumn("q0", F.lit("clash")), m, ["id"]).collect()
    assert sorted((r.id, r.lang, round(r.confidence, 9), r.kept) for r in got) == sorted(expected)


def test_evidence_outweighs_a_text_that_says_nothing(spark):
    rows = [(i, "aaaaaa", "aa", "x", "d", "h") for i in range(20)] + [(100 + i, "bbbbbb", "bb", "y", "e", "g") for i in range(20)]
    rows += [(50, None, "bb", "y", "e", "g"), (51, None, None, None, "d", "h")]
    got = {r.id: r for r in language.identify(spark.createDataFrame(rows, FIELDS), model(), ["id"]).collect()}
    assert got[50].lang == "bb" and got[51].lang == "aa" and not got[50].kept and got[50].text_lang is None


def test_pages_without_url_or_markup(spark):
    pages = [
        (1, None, None), (2, "nonsense", "aaaa"), (3, "http://X.Example.COM/a", "<HTML class=k LANG='AA-us'><script>bbb</script><style>bb</style><!-- bbb --><p>aaa&amp;aaa</p>"),
        (4, "http://h", ""), (4, "http://h", ""),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    evidence = {r.page_id: r for r in language.page_evidence(frame).collect()}
    assert (evidence[3].declared, evidence[3].suffix, evidence[3].domain, evidence[3].host) == ("aa", "com", "example.com", "x.example.com")
    assert "b" not in evidence[3].text and evidence[1].host is None
    got = language.identify_pages(frame, model()).collect()
    assert len(got) == 5 and {r.page_id: r.lang for r in got}[3] == "aa"


def test_empty_tables_and_no_labels(spark):
    nothing = language.fit_text_model(spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string"))
    assert nothing.languages == []
    assert not language.identify(spark.createDataFrame([(1, "aaa", None, None, None, None)], FIELDS), nothing, ["id"]).first().kept
    assert language.identify(spark.createDataFrame([], FIELDS), model(), ["id"]).count() == 0


def test_no_label_is_left_out(spark):
    """Three hundred labels, one of them on half of the rows, some on two rows: each is known, told and weighed."""
    letters = "abcdefghijklmnopqrst"
    word = lambda i: f"{letters[i % 20]}{letters[i // 20]}{letters[(7 * i) % 20]}"
    rows = [(i, f"{word(i % 300)} " * 12, f"l{i % 300:03d}") for i in range(600)] + [(1000 + i, "zzyx zyxx " * 9, "hot") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = language.training_rows(docs, "doc_id", "lang", 900).groupBy("lang").count().collect()
    assert len(few) == 301 and all(r["count"] == 2 for r in few if r.lang != "hot")
    model = language.fit_text_model(docs)
    assert len(model.languages) == 301 and model.logs.size <= language.CELLS
    none = {c: F.lit(None).cast("string") for c in ("declared", "host", "suffix", "domain")}
    told = language.identify(docs.withColumns(none), model, ["doc_id"]).join(docs, "doc_id").select("text_lang", docs.lang.alias("truth"), "kept").collect()
    assert len(told) == 1200 and all(r.text_lang == r.truth for r in told)


def test_more_labels_than_the_sample(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.col("id").cast("string").alias("lang"))
    assert 0 < language.training_rows(docs, "doc_id", "lang", 50).count() < 120


def test_text_in_an_unknown_language_is_not_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    model = language.fit_text_model(docs)
    first = docs.filter("lang IS NOT NULL").limit(1).first()
    strange = [(-1, "ᚠᛇᚻ᛫ᛒᛦᚦ᛫ᚠᚱᚩᚠᚢᚱ᛫ᚠᛁᚱᚪ᛫ᚷᛖᚻᚹᛦᛚᚳᚢᛗ " * 20), (-2, "ქართული ენა არის დამწერლობა და სხვა ენები " * 20), (-3, "12 34"), (-4, "x" * 3 + "qzjwvkxq vzkqjx wqxzv jkqxz " * 2000)]
    planted = spark.createDataFrame([(i, t, first.lang, first.source) for i, t in strange], docs.schema)
    told = {r.doc_id: r for r in language.identify(language.document_evidence(docs.unionByName(planted), "doc_id"), model, ["doc_id"]).collect()}
    assert not any(told[i].kept or told[i].text_lang for i, _ in strange)
    clean = docs.filter("length(text) > 200").select("doc_id").collect()
    assert clean and all(told[r.doc_id].kept for r in clean)
