"""Language ID: text likelihoods fused with declared language, address suffix and host priors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import attach, small
from .common import text_of, written
from .url_filter import url_parts

# Labelled rows that the text model is fitted on, about: of each label the same number at most, chosen by a hash of the id.
TRAIN_ROWS = 8_000
# Hash buckets of byte trigrams at most, and cells (buckets times languages) of the model at most.
BUCKETS = 1 << 16
CELLS = 1 << 24
# Overlapping trigrams repeat each other's evidence about so many times.
OVERLAP = 3.0
# Log odds against a text being in none of the known languages, before it is read.
KNOWN_ODDS = 7.0
# Words that tell a language: letters without digits, so no numbers, keys or hashes.
PLAIN_WORD = re.compile(r"(?<!\S)[^\d\s]*[^\W\d_][^\d\s]*(?!\S)")
# Rows that a parent's share counts for, below a host or domain.
WEIGHT = 5.0


@dataclass(frozen=True)
class TextModel:
    """Log probabilities (bucket x language) of byte trigrams.

    ``totals`` are the trigrams of each language, ``trained`` (key, trained: the label) the rows that were counted.
    """

    languages: list[str]
    logs: np.ndarray
    totals: np.ndarray | None = None
    trained: DataFrame | None = None

    def log_likelihoods(self, text: str, counted: str = "", label: str | None = None) -> np.ndarray:
        """Of ``text`` in each language; where ``counted`` was counted under ``label``, without that."""
        buckets = len(self.logs)
        found = trigrams(text, buckets)
        sums = self.logs[found].sum(axis=0, dtype=np.float64)
        if label is not None:
            own, i = np.bincount(trigrams(counted, buckets), minlength=buckets), self.languages.index(label)
            left = np.maximum(np.exp(self.logs[found, i].astype(np.float64)) * self.totals[i] - own[found], 0.5)
            sums[i] = np.log(left / max(self.totals[i] - own.sum(), 0.5 * buckets)).sum()
        return sums


def trigrams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text with a space around it; ``buckets`` is a power of two."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    mixed = (data[:-2] * np.uint32(0x1F123BB5)) ^ (data[1:-1] * np.uint32(0x05491333)) ^ (data[2:] * np.uint32(0x9E3779B1))
    return (((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)) & np.uint32(buckets - 1)


def training_rows(labelled: DataFrame, key: str, label: str, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """About ``train_rows`` of the labelled rows: of each label about the same number at most, one at least; a rare one has all of its rows.

    Where there are more labels than ``train_rows``, each takes part with a probability of
    ``train_rows`` / labels, by a hash of its name.
    """
    draw = lambda *columns: F.pmod(F.xxhash64(*columns, F.lit("language")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    counts = written(labelled.groupBy(label).agg(F.count("*").alias("_rows"), F.min(draw(key)).alias("_least")), "labels")
    known = counts.count()
    chosen = counts.filter(draw(label) < train_rows / known) if known > train_rows else counts
    quota = max(1, train_rows // max(1, known))
    within = (draw(key) * F.col("_rows") < quota) | (draw(key) == F.col("_least"))
    return labelled.join(small(chosen, "chosen-labels"), label).filter(within).drop("_rows", "_least")


def fit_text_model(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", train_rows: int = TRAIN_ROWS) -> TextModel:
    """Trigram model of about ``train_rows`` labelled rows; counts are summed by Spark.

    Every label of these rows is a language. The more there are, the fewer buckets each has, so
    that the model stays within ``CELLS``. Rows without label or text are left out.
    """
    rows = labelled.select(key, F.col(label).cast("string").alias("_label"), F.col(text).cast("string").alias("_body")).filter("_label IS NOT NULL AND _body IS NOT NULL")
    chosen = written(training_rows(rows, key, "_label", train_rows).select("_label", "_body", key), "training")
    languages = sorted(r["_label"] for r in chosen.select("_label").distinct().collect())
    buckets = BUCKETS
    while buckets * len(languages) > CELLS:
        buckets //= 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist(), dtype=object)
            for language in sorted(set(labels)):
                total = np.zeros(buckets, dtype=np.int64)
                for i in np.flatnonzero(labels == language):
                    total += np.bincount(trigrams(batch.column(1)[int(i)].as_py(), buckets), minlength=buckets)
                at = np.flatnonzero(total)
                columns = [pa.array([language] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "bucket", "n"])

    counts = written(chosen.select("_label", "_body").mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    table, place = np.full((buckets, len(languages)), 0.5), {name: i for i, name in enumerate(languages)}
    for r in counts.toLocalIterator():
        table[r["bucket"], place[r["label"]]] += r["n"]
    totals = table.sum(axis=0)
    return TextModel(languages, np.log(table / totals).astype(np.float32), totals, chosen.select(key, F.col("_label").alias("trained")))


def foreign(body: str, model: TextModel, label: str | None = None) -> bool:
    """Whether evenly drawn trigrams explain the plain words of a text so much better than any language that none is likely."""
    plain = " ".join(PLAIN_WORD.findall(body))
    if not plain:
        return False
    evenly = -len(trigrams(plain)) * np.log(len(model.logs))
    return evenly - model.log_likelihoods(plain, body, label).max() > KNOWN_ODDS * OVERLAP


def _softmax(scores: np.ndarray) -> np.ndarray:
    parts = np.exp(scores - scores.max(axis=1, keepdims=True))
    return parts / parts.sum(axis=1, keepdims=True)


def _vectors(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))


def _text_evidence(rows: DataFrame, model: TextModel) -> DataFrame:
    """``rows`` with the text replaced by its log likelihoods ``loglik``, their posteriors ``q``, and ``told``, whether it says anything.

    A text says nothing if it has no letters, or if it is ``foreign`` to the model.
    """
    names = [c for c in rows.columns if c not in ("text", "trained")]
    kinds = dict(rows.dtypes)
    languages = len(model.languages)
    model = replace(model, trained=None)  # tasks need the numbers alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, told = np.zeros((batch.num_rows, languages)), np.zeros(batch.num_rows, dtype=bool)
            for i, (body, label) in enumerate(zip(batch.column("text").to_pylist(), batch.column("trained").to_pylist(), strict=True)):
                told[i] = any(c.isalpha() for c in body) and not foreign(body, model, label)
                if told[i]:
                    values[i] = model.log_likelihoods(body, body, label) / OVERLAP
            columns = [*(batch.column(c) for c in names), _vectors(values), _vectors(_softmax(values)), pa.array(told)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "loglik", "q", "told"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", loglik array<double>, q array<double>, told boolean"
    return rows.mapInArrow(run, schema)


def identify(rows: DataFrame, model: TextModel, keys: list[str]) -> DataFrame:
    """``keys`` with text_lang, lang, confidence and kept.

    ``rows`` has the keys and text, declared, suffix, domain and host, each of which may be null
    and then says nothing. A column ``trained`` names the label under which the model counted the
    row, which is then judged without its own trigrams. With p(language) taken from the host,

        p(language | all) ~ p(language | host) p(text | language) p(declared | language) p(suffix | language)

    All but the text model comes from grouped sums of the text posteriors over all rows: the host's
    share is smoothed towards its domain's and that towards the whole table's, without the row
    itself, and the tables of declared languages and suffixes towards their own frequency. A text
    without letters, or in a language unlike all that the model knows (``foreign``), has no text evidence: its text_lang is null. ``kept`` means that the text
    has evidence and that one language has at least half of the probability; with a model of no
    language nothing is kept. Of equally likely languages the first one is named.
    Repeated rows count as often as they come; extra columns are left out; empty in, empty out.
    """
    languages = model.languages
    if not languages:
        return rows.select(*keys, F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    size = len(languages)
    trained = (F.col("trained") if "trained" in rows.columns else F.lit(None)).cast("string").alias("trained")
    evidence = rows.select(*keys, text_of().alias("text"), "declared", "suffix", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("host", F.lit("")).alias("host"), trained)
    scored = written(_text_evidence(evidence, model), "language")
    total = lambda prefix: [F.count("*").alias(f"{prefix}n"), F.array(*[F.sum(F.col("q")[i]) for i in range(size)]).alias(f"{prefix}q")]

    def sums(by: list[str], prefix: str) -> DataFrame:
        return written(scored.groupBy(*by).agg(*total(prefix)), f"language-{prefix}")

    whole = scored.agg(*total("")).first()
    n, mass = whole["n"], np.array([x or 0.0 for x in whole["q"]])
    out = attach(scored, sums(["domain"], "d_"), ["domain"], "d_n", n)
    out = attach(out, sums(["host", "domain"], "h_"), ["host", "domain"], "h_n", n)
    out = out.join(small(sums(["declared"], "l_").filter("declared IS NOT NULL"), "declared"), "declared", "left")
    out = out.join(small(sums(["suffix"], "s_").filter("suffix IS NOT NULL"), "suffix"), "suffix", "left")
    absent = F.array_repeat(F.lit(0.0), size)
    out = out.select(
        *keys, "loglik", "q", "told", "d_n", "d_q", "h_n", "h_q",
        *[c for p in ("l_", "s_") for c in (F.coalesce(f"{p}n", F.lit(0)).alias(f"{p}n"), F.coalesce(f"{p}q", absent).alias(f"{p}q"))],
    )
    kinds, base = dict(out.dtypes), (mass + 1.0) / (n + size)

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(languages, dtype=object)
        for batch in batches:
            vector = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            number = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
            q, told = vector("q"), batch.column("told").to_numpy(zero_copy_only=False)
            above = (vector("d_q") - q + WEIGHT * base) / (number("d_n") - 1 + WEIGHT)
            prior = (vector("h_q") - q + WEIGHT * above) / (number("h_n") - 1 + WEIGHT)
            scores = np.log(np.maximum(prior, 1e-12)) + vector("loglik")
            for p in ("l_", "s_"):
                rows_ = number(f"{p}n")
                share = (vector(f"{p}q") + WEIGHT * rows_ / n) / (mass + WEIGHT)
                scores += np.log(np.where(rows_ > 0, share, 1.0))
            fused = _softmax(scores)
            # argmax names the first of equal ones.
            best, text_best = fused.argmax(axis=1), q.argmax(axis=1)
            confidence = fused.max(axis=1)
            columns = [*(batch.column(k) for k in keys), pa.array(names[text_best], pa.string(), mask=~told), pa.array(names[best], pa.string()), pa.array(confidence), pa.array(told & (confidence >= 0.5))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "text_lang", "lang", "confidence", "kept"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", text_lang string, lang string, confidence double, kept boolean"
    return out.mapInArrow(fuse, schema)


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, text, declared, suffix, domain, host) of web pages.

    The text is the markup without scripts, styles, comments, tags and character references; the
    declared language is the one of the ``html`` tag; the domain is the host's last two labels.
    """
    host = F.nullif(url_parts(F.col(url))[0], F.lit(""))
    labels = F.split(host, r"\.")
    bare = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&#?\w{1,10};", " ")
    declared = F.lower(F.regexp_extract(F.col(html), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return pages.select(
        "page_id", bare.alias("text"), F.nullif(declared, F.lit("")).alias("declared"), F.element_at(labels, -1).alias("suffix"),
        F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), F.lit(2)), ".").alias("domain"), host.alias("host"),
    )


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """(page_id, text_lang, lang, confidence, kept) of web pages; null urls and null html say nothing."""
    return identify(page_evidence(pages), model, ["page_id"])


def document_evidence(docs: DataFrame, key: str) -> DataFrame:
    """(key, text, declared, suffix, domain, host) of documents: the declared language is ``lang``, the host is ``source``."""
    none = F.lit(None).cast("string")
    return docs.select(key, "text", F.col("lang").cast("string").alias("declared"), none.alias("suffix"), none.alias("domain"), F.col("source").cast("string").alias("host"))
