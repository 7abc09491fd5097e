from collections import Counter

from oncekeep.llm import quality

from .helpers import DOCS, awkward_docs

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def plain_measures(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


def test_measures_equal_plain_ones(spark):
    rows = awkward_docs()
    rows += [(90, "a b c a b c\n\nx\nx\n x\nx", "en", "s", 1), (91, "#*$% |<>& ok", "en", "s", 1), (92, "a b a b a b a", "en", "s", 1)]
    got = quality.measure(spark.createDataFrame(rows, DOCS)).select("doc_id", "text", *NAMES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[2:]) == plain_measures(r.text), r.text


def test_verdicts_do_not_depend_on_the_order(spark):
    docs = spark.createDataFrame(awkward_docs(), DOCS)
    out = [sorted(map(str, quality.judge_quality(docs, rules).select("doc_id", "kept", "base_failed").collect())) for rules in (quality.RULES, quality.RULES[::-1])]
    assert out[0] == out[1]


def test_rules_are_ordered_by_rejections_per_second():
    a, b, c = (quality.Rule(x, "true") for x in "abc")
    assert quality.order_rules([(a, 2.0, 0.5), (b, 1.0, 0.5), (c, 0.1, 0.0)]) == [b, a, c]


def test_kept_documents_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x " * 30, "old", 5), (2, " ".join(f"word{i}" for i in range(80)), "old", 5)], "doc_id long, text string, kept string, n_words int")
    judged = {r.doc_id: r for r in quality.judge_quality(docs).collect()}
    assert not judged[1].kept and judged[2].kept and judged[2].n_words == 80
    assert judged[1].base_failed and judged[1].rejected_by in ("too_short", "repetitive", "word_length")
    assert [r.doc_id for r in quality.kept_documents(docs).collect()] == [2]


def test_empty_table(spark):
    assert quality.judge_quality(spark.createDataFrame([], DOCS)).count() == 0
