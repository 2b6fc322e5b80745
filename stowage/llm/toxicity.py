"""Toxicity by cumulative-link ordinal regression over sparse text features.

Grades are ordered: 0 clean, 1 toxic, 2 severely toxic. One weight for each
feature is shared by all thresholds, P(grade >= k) = sigmoid(w.x - t_k) with
t_1 < t_2, and the expected severity is the sum of these over k.

Features are hashed words and their beginnings (insults are inflected). Each
counts twice: by how often a text has it, and by its share of the text, as what
is rare by chance is there in any long text.

The labels tell toxic from clean only: they are the ground truth of grade 1. There is none for
grade 2, which is derived: of the toxic training texts, those count as severe whose share of
words that mark toxic texts is above the median. An expected severity above 1 therefore
says how densely toxic a text is, not how a person would grade it.

The model is fitted on at most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled
documents (the bound of the sample, drawn by a hash of doc_id). Spark counts their features and
chooses the ``KEPT`` that tell most; one task fits the weights to the counts of those,
so the driver only gets the weights. Scoring reads every document whole.

Edge cases. Null and empty texts have no features and severity by the
thresholds alone, which is close to 0. Labels that are null, or whose document is missing, are
not used, and of several the highest counts; without toxic or without clean labels everything has
severity 0. Repeated rows are scored each; of the texts of one labelled doc_id the last in
order of bytes is fitted to. An empty table gives an empty result. Very long texts
are read in one piece. Extra columns are ignored, also those with names of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, prepare, table
from .words import U, hash_spans, rounds, spans, strings

MAX_TOXIC, MAX_CLEAN = 2000, 4000
#: Bits of the feature space; bytes of the beginnings of words; a document is toxic from this severity.
BITS, STARTS, TOXIC = 20, (4, 5, 7), 0.5
#: Log-likelihood ratio that a feature needs, the most features that are kept, rounds of fitting.
GAIN, KEPT, ROUNDS = 20.0, 4000, 400
#: A share is counted in this many words and beginnings, of a text with so many more.
SHARE, MORE = 300, 60
PENALTY = 1e-4

#: Bytes that are no part of a word: ASCII, but for letters and digits.
BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Model:
    """Features in order, the weights of their counts and of their shares, and the thresholds of the grades."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, row: np.ndarray, feature: np.ndarray, total: np.ndarray) -> np.ndarray:
        """The weighted sum of each text's features; ``total`` has the number of all of them, known or not."""
        out = np.zeros(len(total))
        if not len(self.features):
            return out
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        inside = self.features[at] == feature
        row, at, n = counted(row[inside], at[inside])
        count, share = measured(n, total[row])
        return np.bincount(row, weights=self.weights[0, at] * count + self.weights[1, at] * share, minlength=len(total))

    def severity(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each k, as columns."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -50, 50)))


#: Says nothing: everything is clean.
BLANK = Model(np.empty(0, np.int64), np.zeros((2, 0)), np.array([30.0, 60.0]))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature number of every word and word beginning, with repeats."""
    starts, ends, counts = spans(data, offsets, BREAK)
    row = np.repeat(np.arange(len(counts)), counts)
    rows, out = [row], [hash_spans(data, starts, ends) >> U(64 - BITS)]
    for k, n in enumerate(STARTS, 1):
        long = ends - starts > n
        rows.append(row[long])
        out.append((hash_spans(data, starts[long], starts[long] + n) * U(2 * k + 1)) >> U(64 - BITS))
    return np.concatenate(rows), np.concatenate(out).astype(np.int64)


def counted(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, feature) with their counts."""
    key, n = np.unique((row << BITS) | feature, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), n


def measured(n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two values of features that texts of ``total`` features have ``n`` times."""
    return np.log1p(n), np.log1p(n * SHARE / (total + MORE))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, toxic = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, offsets = strings(batch.column(2))
        for lo, hi in rounds(offsets):
            part = offsets[lo : hi + 1]
            row, feature = features(data[part[0] : part[-1]], part - part[0])
            total = np.bincount(row, minlength=hi - lo)
            row, feature, n = counted(row, feature)
            for at in range(0, len(row), 1 << 18):
                r = row[at : at + (1 << 18)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo + r]), pa.array(toxic[lo + r]), pa.array(total[r]), pa.array(feature[at : at + (1 << 18)]), pa.array(n[at : at + (1 << 18)])],
                    names=["doc_id", "toxic", "total", "feature", "n"],
                )


def choose(counts: DataFrame, toxic: int, clean: int) -> DataFrame:
    """The features that tell most, by the log-likelihood ratio of what chance alone would hardly give: ``feature, marks``."""
    p, q = (F.col("yes") + 0.5) / (toxic + 1), (F.col("no") + 0.5) / (clean + 1)
    both = (F.col("yes") + F.col("no") + 1) / (toxic + clean + 2)
    by = counts.groupBy("feature").agg(F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no"))
    gain = by.withColumn("gain", 2 * (F.col("yes") * F.log(p / both) + F.col("no") * F.log(q / both))).where(F.col("gain") >= GAIN)
    return gain.orderBy(F.desc("gain"), "feature").limit(KEPT).select("feature", (p > 4 * q).alias("marks"))


def fit(toxic: np.ndarray, share: np.ndarray, rows: np.ndarray, feature: np.ndarray, n: np.ndarray, total: np.ndarray) -> Model:
    """Fits weights and thresholds to labelled texts.

    ``toxic`` and ``share`` (of words that mark toxic texts) are by text; the others by text and
    kept feature: number of the text, feature, its count, and the number of all features of the text.
    """
    docs = len(toxic)
    kept, c = np.unique(feature, return_inverse=True)
    grade = np.where(toxic == 1, 1 + (share > np.median(share[toxic == 1])), 0)
    r, c, x = np.tile(rows, 2), np.concatenate([c, c + len(kept)]), np.concatenate(measured(n, total))
    # L2 penalty, Adam on the full sample
    params, m, v = np.concatenate([np.zeros(2 * len(kept)), [2.0, np.log(2.0)]]), 0.0, 0.0
    for k in range(1, ROUNDS + 1):
        w, t = params[:-2], np.array([params[-2], params[-2] + np.exp(params[-1])])
        score = np.bincount(r, weights=w[c] * x, minlength=docs)
        at_least = 1 / (1 + np.exp(-np.clip(score[:, None] - t, -50, 50)))
        # P(grade) = P(>= grade) - P(>= grade + 1)
        upper = np.column_stack([np.ones(docs), at_least])
        lower = np.column_stack([at_least, np.zeros(docs)])
        i = np.arange(docs)
        chance = np.maximum(upper[i, grade] - lower[i, grade], 1e-12)
        slope = at_least * (1 - at_least)
        up = np.where(grade[:, None] == [1, 2], slope, 0) / chance[:, None]
        down = np.where(grade[:, None] == [0, 1], slope, 0) / chance[:, None]
        by_threshold = (up - down) / docs
        d_score = by_threshold.sum(axis=1)
        d_t = -by_threshold.sum(axis=0)
        grad = np.concatenate([-np.bincount(c, weights=d_score[r] * x, minlength=len(w)) + PENALTY * w, [-d_t.sum(), -d_t[1] * np.exp(params[-1])]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params = params - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Model(kept, params[:-2].reshape(2, -1), np.array([params[-2], params[-2] + np.exp(params[-1])]))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task: the texts' kept features, in any order, to the model's weights."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    # sums depend on their order in the last digits: sorted, the model is always the same
    got = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("feature", "ascending")])
    text, toxic, total, feature, n, marks = (got[c].to_numpy() for c in ("doc_id", "toxic", "total", "feature", "n", "marks"))
    known = feature >= 0
    _, first, rows = np.unique(text, return_index=True, return_inverse=True)
    share = np.bincount(rows[known], weights=(n * marks)[known], minlength=len(first)) / np.maximum(total[first], 1)
    model = fit(toxic[first].astype(np.int64), share, rows[known], feature[known], n[known], total[known])
    yield pa.RecordBatch.from_arrays([pa.array([x.tolist()]) for x in (model.features, *model.weights, model.thresholds)], names=["features", "counts", "shares", "thresholds"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits the model to a bounded sample of the labelled documents."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    sample = known.where("toxic = 1").orderBy(order, "doc_id").limit(MAX_TOXIC).union(known.where("toxic = 0").orderBy(order, "doc_id").limit(MAX_CLEAN))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))  # at most 6,000
    counts = cut(rows.mapInArrow(_count, "doc_id long, toxic int, total long, feature long, n long"))
    by = {r.toxic: r.n for r in counts.groupBy("toxic").agg(F.count_distinct("doc_id").alias("n")).collect()}
    if not by.get(0) or not by.get(1):
        return BLANK
    # a text without kept features still is one of the sample: it comes once, without a feature
    kept = counts.join(F.broadcast(choose(counts, by[1], by[0])), "feature").select("doc_id", "toxic", "total", "feature", "n", F.col("marks").cast("long").alias("marks"))
    every = counts.select("doc_id", "toxic", "total").distinct().select("*", F.lit(-1).cast("long").alias("feature"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("marks"))
    got = kept.union(every).coalesce(1).mapInArrow(_fit, "features array<long>, counts array<double>, shares array<double>, thresholds array<double>").first()
    return Model(np.array(got.features, np.int64), np.array([got.counts, got.shares]), np.array(got.thresholds)) if got.features else BLANK


def severities(model: Model, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """P(grade >= k) of the texts lo to hi - 1."""
    part = offsets[lo : hi + 1]
    row, feature = features(data[part[0] : part[-1]], part - part[0])
    return model.severity(model.score(row, feature, np.bincount(row, minlength=hi - lo)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, expected_severity, p_toxic, p_severe, grade, toxic`` for every document."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)  # KEPT features at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = sent.value
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for lo, hi in rounds(offsets):
                p = severities(own, data, offsets, lo, hi)
                expected = p.sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(expected), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array((p >= 0.5).sum(axis=1).astype(np.int32)), pa.array(expected >= TOXIC)],
                    names=["doc_id", "expected_severity", "p_toxic", "p_severe", "grade", "toxic"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, expected_severity double, p_toxic double, p_severe double, grade int, toxic boolean")


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, with all their columns, that are not toxic."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)  # KEPT features at most
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(text))
            kept = [severities(sent.value, data, offsets, lo, hi).sum(axis=1) < TOXIC for lo, hi in rounds(offsets)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)


def op6_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
