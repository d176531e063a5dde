"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(severity >= k) = F(w . x - theta_k), F the logistic function, with one weight vector for all thresholds
theta_1 < theta_2 < ...; the output is the expected severity, the sum of these probabilities. Training maximises
the likelihood of whole grades, P(severity = k) = F(w . x - theta_k) - F(w . x - theta_k+1). Features are the
distinct lower-cased words of a text and their prefixes of 4 and 5 letters, present or absent.

Training reads the TRAIN_DOCS labelled rows with the lowest hash of their id (a documented bound). Labels are 0
or 1; toxic rows get GRADES grades by how far a model that wasn't trained on them puts them from the other
rows: the sample is halved, a model with one threshold is fitted on either half, and the scores that the other
half's toxic rows get from it are cut at their quantiles. The ordinal model is then fitted to these grades on
the whole sample. Features are the MOST_FEATURES that differ most between toxic and other sampled rows.

Defined results: null texts have no feature and get the base rate's severity; rows without a label don't
train, of several labels of one id the largest counts; with no toxic row to learn from every severity is 0;
repeated rows repeat; texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored

TRAIN_DOCS = 12_000
MOST_FEATURES, LEAST_DOCS, LEAST_Z = 4096, 4, 5.0
GRADES = 3
PREFIXES = (4, 5)
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """The distinct words of a text and their prefixes."""
    words = set(_WORD.findall((text or "").lower()))
    return words.union(w[:k] + "-" for w in words for k in PREFIXES if len(w) > k)


@dataclass
class Ordinal:
    """Weights by feature and ascending thresholds."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def score(self, text: str | None) -> float:
        known = self.weights
        return math.fsum(known[f] for f in features(text) if f in known)

    def at_least(self, text: str | None) -> list[float]:
        """P(severity >= k) for k = 1, 2, ..."""
        s = self.score(text)
        return [1 / (1 + math.exp(min(60.0, t - s))) for t in self.thresholds]


@dataclass
class Sample:
    """Rows as (row, feature) entries, and their grades."""

    row: np.ndarray
    feature: np.ndarray
    grade: np.ndarray
    n_features: int

    def only(self, rows: np.ndarray) -> Sample:
        """The rows where `rows` is true."""
        keep = rows[self.row]
        return Sample((np.cumsum(rows) - 1)[self.row[keep]], self.feature[keep], self.grade[rows], self.n_features)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.feature], minlength=len(self.grade))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def thresholds_of(params: np.ndarray, n_features: int) -> np.ndarray:
    """Thresholds from parameters: the first, then logarithms of the gaps, so that they stay ordered."""
    own = params[n_features:]
    return own[0] + np.concatenate([[0.0], np.cumsum(np.exp(own[1:]))])


def loss(params: np.ndarray, sample: Sample, ridge: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the grades, plus ridge / 2 times the weights' squares, and its gradient.

    A row of grade k has the probability p = F(high) - F(low), where high = s - theta_k and low = s - theta_k+1
    (infinite at either end). As F' = F (1 - F), d log p / ds = 1 - F(high) - F(low).
    """
    n, k, rows = sample.n_features, sample.grade, max(1, len(sample.grade))
    weights, theta = params[:n], thresholds_of(params, n)
    edges = np.concatenate([[-np.inf], theta, [np.inf]])
    score = sample.scores(weights)
    with np.errstate(invalid="ignore"):
        high, low = _logistic(score - edges[k]), _logistic(score - edges[k + 1])
    p = np.maximum(high - low, 1e-300)
    by_score = (1 - high - low) / rows
    by_theta = np.zeros(len(edges))
    np.add.at(by_theta, k, high * (1 - high) / p / rows)
    np.add.at(by_theta, k + 1, -low * (1 - low) / p / rows)
    by_theta = by_theta[1:-1]
    later = np.cumsum(by_theta[::-1])[::-1]  # a gap moves all thresholds above it
    by_weight = np.bincount(sample.feature, weights=by_score[sample.row], minlength=n)
    gradient = np.concatenate([ridge * weights - by_weight, [later[0]], later[1:] * np.exp(params[n + 1 :])])
    return float(-np.log(p).mean() + ridge / 2 * (weights**2).sum()), gradient


def fit(sample: Sample, steps: int = 1000, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, by Adam. Grades must be 0 to some top without gaps."""
    top = int(sample.grade.max())
    params = np.concatenate([np.zeros(sample.n_features), [1.0], np.zeros(top - 1)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        _, gradient = loss(params, sample, ridge)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-12)
    return params[: sample.n_features], thresholds_of(params, sample.n_features)


def graded(sample: Sample, half: np.ndarray) -> Sample:
    """The sample of grades 0 and 1 with toxic rows graded 1 to GRADES by scores of the half they aren't in."""
    margin = np.zeros(len(sample.grade))
    for own in (half, ~half):
        learnt = sample.only(~own)
        if len(set(learnt.grade.tolist())) == 2:
            weights, threshold = fit(learnt, 300)
            margin[own] = (sample.scores(weights) - threshold[0])[own]
    toxic = sample.grade > 0
    cuts = np.unique(np.quantile(margin[toxic], np.arange(1, GRADES) / GRADES))
    _, grade = np.unique(np.searchsorted(cuts, margin[toxic], side="left"), return_inverse=True)
    new = np.zeros_like(sample.grade)
    new[toxic] = 1 + grade
    return Sample(sample.row, sample.feature, new, sample.n_features)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> Ordinal:
    """The model from a bounded sample of labelled rows."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    sample = known.withColumn("h", F.xxhash64(F.col("id").cast("string"))).orderBy("h", "id").limit(train_docs).select("id", "y")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")  # train_docs rows at most

    def listed(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [features(t) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array([sorted(f) for f in own], pa.list_(pa.string()))], names=["y", "features"])

    seen = stored(map_batches(texts.select("text", "y"), listed, "y int, features array<string>"), "toxicity")
    sizes = {r[0]: r[1] for r in seen.groupBy(F.col("y") > 0).count().collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        return Ordinal({}, [60.0 if not n1 else -60.0])
    counts = seen.select((F.col("y") > 0).cast("long").alias("y"), F.explode("features").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(F.col("a") + F.col("b") >= LEAST_DOCS)
    rate = n1 / (n0 + n1)
    z = (F.col("a") - (F.col("a") + F.col("b")) * rate) / F.sqrt((F.col("a") + F.col("b")) * (rate * (1 - rate)))
    best = counts.select("f", z.alias("z")).where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "f").limit(MOST_FEATURES).collect()
    names = [r[0] for r in best]
    index = {f: i for i, f in enumerate(names)}
    shared = docs.sparkSession.sparkContext.broadcast(index)  # MOST_FEATURES

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = shared.value
        found = [sorted(index[f] for f in own if f in index) for own in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["y", "found"])

    got = map_batches(seen, rows, "y int, found array<int>").collect()  # train_docs rows of MOST_FEATURES numbers at most
    got.sort(key=lambda r: (r[0], r[1]))  # the same halves whatever the partitions
    sample = Sample(np.repeat(np.arange(len(got)), [len(r[1]) for r in got]), np.array([f for r in got for f in r[1]], dtype=np.int64), np.array([int(r[0] > 0) for r in got]), len(names))
    weights, theta = fit(graded(sample, np.arange(len(got)) % 2 == 0))
    return Ordinal(dict(zip(names, weights.tolist())), theta.tolist())


def severity(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, p_toxic (severity >= 1), expected_severity, grade (the median) and toxic (p_toxic >= 0.5) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [shared.value.at_least(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got]), pa.array([sum(g) for g in got]), pa.array([sum(p >= 0.5 for p in g) for g in got], pa.int32()), pa.array([g[0] >= 0.5 for g in got])], names=[id_col, "p_toxic", "expected_severity", "grade", "toxic"])

    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, p_toxic double, expected_severity double, grade int, toxic boolean")
