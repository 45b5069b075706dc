"""Toxicity by non-negative positive-unlabelled learning.

Positives are texts confirmed as toxic; unlabelled texts are a sample of all training
texts, whatever their labels. With class prior p, the risk of a classifier g is
p R+(g) + max(0, Ru(g) - p R-(g)): the risk of the negatives is what is left of the
unlabelled risk after the share of the positives is taken out, and it is not
allowed to fall below zero. The classifier is linear over the presence of words and word
starts and ends, trained in numpy with the logistic loss, so its sigmoid is an estimate of
the probability of the label.

The classifier is fitted on bounded samples (``positives``, ``unlabelled``: at most about so many
documents, by a hash of their ids) and keeps at most ``features`` features; scoring runs
over every whole text, and a text's score needs nothing but the text.

Defined results: a null or empty text gets the score of a text without any known
feature; rows without an id are never held out and never train; null labels are no labels;
repeated rows are scored one by one; without features that tell positives apart every score is the prior, at most a half, so that nothing is
rejected without evidence (0 if there are no positives at all); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import _work
from ._text import small

_WORD = re.compile(r"\w+")
THRESHOLD = 0.7


def word_features(word: str) -> list[str]:
    """The word itself, its starts of 3 to 8 and its ends of 3 to 5 characters."""
    return ["=" + word, *("^" + word[:k] for k in range(3, min(8, len(word)) + 1)), *("$" + word[-k:] for k in range(3, min(5, len(word)) + 1))]


def word_set(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def held_out(doc_id: Column) -> Column:
    """Rows whose label is for testing only."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def _document_features(text: str | None) -> set[str]:
    return {f for w in word_set(text) for f in word_features(w)}


def _pick_features(sample: DataFrame, n_pos: int, n_unl: int, features: int, least: int, z: float) -> list[str]:
    """Features of at least ``least`` positives whose share among them is clearly above that of all texts, clearest first."""

    def count(batches):
        pos, unl = Counter(), Counter()
        for batch in small(batches):
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (pos if y else unl).update(_document_features(t))
        # also what a task sees once: only sums over all tasks say what is rare
        keys = list({*pos, *unl})
        for at in range(0, len(keys), 20_000):
            own = keys[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([pos[k] for k in own], pa.int64()), pa.array([unl[k] for k in own], pa.int64())], names=["f", "pos", "unl"])

    counts = sample.select("text", "positive").mapInArrow(count, "f string, pos long, unl long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))
    p, u = F.col("pos") / F.lit(float(max(n_pos, 1))), F.col("unl") / F.lit(float(max(n_unl, 1)))
    # distance in standard errors
    apart = (p - u) / F.sqrt((p * (1 - p) + F.lit(0.01)) / max(n_pos, 1) + (u * (1 - u) + F.lit(0.01)) / max(n_unl, 1))
    best = counts.where(F.col("pos") >= least).withColumn("z", F.round(apart, 6)).where(F.col("z") >= z).orderBy(F.desc("z"), "f").limit(features)
    return [r.f for r in best.select("f").collect()]


class SparseRows:
    """Rows of feature indexes as one flat array; products with dense vectors only."""

    def __init__(self, lists: list[np.ndarray]):
        self.n = len(lists)
        self.row = np.repeat(np.arange(self.n), [len(x) for x in lists])
        self.col = np.concatenate([*lists, np.empty(0, np.int64)]).astype(np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], minlength=self.n)

    def transposed_dot(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.col, r[self.row], minlength=size)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def risk_step(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """What a step goes down along, as derivatives by the outputs on positives and unlabelled texts.

    Usually the whole risk, prior R+ + (Ru - prior R-); where the risk of the negatives, Ru - prior R-, is below zero, that risk
    alone, upwards.
    """
    sp, su = _sigmoid(zp), _sigmoid(zu)
    if np.mean(np.logaddexp(0, zu)) >= prior * np.mean(np.logaddexp(0, zp)):
        return np.full(len(zp), -prior / len(zp)), su / len(zu)
    return prior * sp / len(zp), -su / len(zu)


def fit(pos: SparseRows, unl: SparseRows, size: int, prior: float, *, rounds: int = 300, rate: float = 0.05, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam on the full samples.

    Where the risk of the negatives falls below zero, a step goes up that risk instead, as in
    the published algorithm; the result is the mean over the second half of the steps.
    """
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v, total, n = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1), 0
    for step in range(1, rounds + 1):
        rp, ru = risk_step(pos.dot(w) + b, unl.dot(w) + b, prior)
        g = np.append(pos.transposed_dot(rp, size) + unl.transposed_dot(ru, size) + l2 * w, rp.sum() + ru.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        d = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= d[:-1]
        b -= float(d[-1])
        if step > rounds // 2:
            total, n = total + np.append(w, b), n + 1
    return total[:-1] / n, float(total[-1] / n)


class Model:
    """A linear classifier over features of words; unknown features weigh nothing."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self._of_word: dict[str, tuple[str, ...]] = {}

    def score(self, text: str | None) -> float:
        known, weights, found = self._of_word, self.weights, set()
        if len(known) > 500_000:
            known.clear()
        for w in word_set(text):
            own = known.get(w)
            if own is None:
                own = known[w] = tuple(f for f in word_features(w) if f in weights)
            if own:
                found.update(own)
        z = self.bias + sum(weights[f] for f in sorted(found))
        return float(_sigmoid(np.float64(z)))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", positives: int = 4000, unlabelled: int = 8000, features: int = 2000, least: int = 5, z: float = 2.5, **options) -> Model:
    """Fit on the confirmed toxic and a sample of all rows outside the held-out fold."""
    rows = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IS NOT NULL AND l_id IS NOT NULL").where(~held_out(F.col("l_id")))
    marks = marks.groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    n_known, n_toxic = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n_rows = rows.count()
    if not n_toxic or not n_rows:
        return Model({}, -50.0)
    prior = (n_toxic + 1) / (n_known + 2)  # Laplace's rule: a few labels of one kind prove nothing about all
    part = lambda c, seed, n, of: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, n / of) * (1 << 30))
    chosen = marks.where("toxic = 1").where(part("l_id", 11, positives, n_toxic)).select("l_id")
    # about ``positives`` ids by the filter above, so the side is small and the texts are not shuffled
    pos = rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["l_id"], "left_semi").withColumn("positive", F.lit(True))
    unl = rows.where(part("doc_id", 12, unlabelled, n_rows)).withColumn("positive", F.lit(False))
    sample = spread(_work.keep(pos.unionByName(unl), "toxicity"))
    n_pos, n_unl = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not n_pos or not n_unl:
        return Model({}, min(0.0, float(np.log(prior / (1 - prior)))))
    names = _pick_features(sample, n_pos, n_unl, features, least, z)
    index = {f: i for i, f in enumerate(names)}

    def encode(batches):
        for batch in small(batches):
            lists = [sorted(index[f] for f in _document_features(t) if f in index) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "positive", "f"])

    table = sample.select("doc_id", "text", "positive").mapInArrow(encode, "doc_id long, positive boolean, f array<int>").orderBy("positive", "doc_id").toArrow()
    lists, y = table.column("f").to_pylist(), np.asarray(table.column("positive").to_pylist(), bool)
    arrays = [np.asarray(x, np.int64) for x in lists]
    w, b = fit(SparseRows([a for a, p in zip(arrays, y, strict=True) if p]), SparseRows([a for a, p in zip(arrays, y, strict=True) if not p]), len(names), prior, **options)
    weights = {f: float(w[i]) for f, i in index.items() if w[i]}
    return Model(weights, b if weights else min(0.0, b))


def score(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    weights, bias = model.weights, model.bias

    def rate(batches):
        own = Model(weights, bias)
        for batch in small(batches):
            s = [own.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    return rows.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(rate, "doc_id long, held_out boolean, score double, predicted int")


def non_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns unchanged."""
    model = train(docs, labels, **options)
    weights, bias = model.weights, model.bias

    def verdict(batches):
        own = Model(weights, bias)
        for batch in small(batches):
            keep = pa.array([own.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_())
            yield batch.filter(keep)

    at = docs.columns.index(options.get("text_col", "text"))
    return spread(docs).mapInArrow(verdict, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels))
