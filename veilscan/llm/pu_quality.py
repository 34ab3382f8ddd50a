"""Quality classifier from trusted positives and unlabelled web text (positive-unlabelled learning).

Only rows known to be good are labelled; the rest of the web text is a mixture of good and bad. The classifier minimises
the non-negative unbiased risk: with class prior pi and loss l, ``pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)])``;
while the second part is below zero its gradient is followed the other way, so that the model can't gain by
overfitting the positives. The prior is estimated first: a plain positive-against-unlabelled model ranks both, and over
its upper ranges the smallest ratio of unlabelled to positive mass bounds the share of positives.

Features are figures of the text alone: shares of byte classes, word and line shape, repetition. They are
computed once for every whole text, in one narrow pass, and written; sampling, fitting and scoring read that table.
The model is fitted on the driver on a bounded sample: at most about ``SAMPLE`` positives and ``SAMPLE``
unlabelled rows, drawn evenly by a hash of the id from all training rows (the documented bound of the sample).

Defined results: null and empty texts have features and a score like any other; without positives or unlabelled rows every
score is 0.5; rows that repeat are scored each; a null id is not learned from; an empty table gives an empty table;
labels, language, source and id are never features; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import words as W
from veilscan.llm.quality_rules import covered
from veilscan.llm.shared import written

SAMPLE = 20_000
FOLDS = 5
THRESHOLD = 0.3
STEPS, RATE, DECAY = 600, 0.05, 1e-4

_CLASS = np.full(256, 0, dtype=np.int64)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[128:] = 4
_CLASS[[9, 10, 11, 12, 13]] = 5
_MARKS = [c for c in range(32, 127) if not chr(c).isalnum()]
_CLASS[_MARKS] = np.arange(6, 6 + len(_MARKS))
CLASSES = 6 + len(_MARKS)
SHAPE = 12
WIDTH = CLASSES + SHAPE


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of ``WIDTH`` figures per text of a slice."""
    texts = len(offs) - 1
    size = np.diff(offs)
    kinds = _CLASS[data]
    owner = np.repeat(np.arange(texts), size)
    shares = np.bincount(owner * CLASSES + kinds, minlength=texts * CLASSES).reshape(texts, CLASSES) / np.maximum(size, 1)[:, None]
    starts, ends, firsts = W.spans(data, offs)
    n = np.diff(firsts)
    some = np.maximum(n, 1)
    word_owner = W.owners(firsts)
    hashes = W.word_hashes(data, starts, ends)
    lengths = ends - starts

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(word_owner, weights=flag, minlength=texts) / some

    # words with marks at the end, in the middle, all in capitals, of one letter
    run = np.zeros((3, len(data) + 1), dtype=np.int64)
    np.cumsum(kinds >= 6, out=run[0, 1:])
    np.cumsum(kinds == 2, out=run[1, 1:])
    np.cumsum(data == 10, out=run[2, 1:])
    marks, capitals = run[0][ends] - run[0][starts], run[1][ends] - run[1][starts]
    twice = W.repeated(hashes, word_owner) if len(hashes) else np.zeros(0, dtype=bool)
    out = np.zeros((texts, SHAPE))
    out[:, 0] = np.log1p(n)
    out[:, 1] = share(lengths) / 10
    out[:, 2] = share(marks > 0)
    out[:, 3] = share(marks >= 2)
    out[:, 4] = share(capitals * 2 > lengths)
    out[:, 5] = share(lengths <= 1)
    out[:, 6] = share(twice)
    out[:, 7] = (run[2][offs[1:]] - run[2][offs[:-1]]) / some
    out[:, 8] = share(marks == lengths)
    for k, (_, flag) in enumerate(covered(hashes, firsts, [3, 5, 8])):
        out[:, 9 + k] = share(flag)
    return np.concatenate([np.sqrt(shares), out], axis=1).astype(np.float32)


def featurise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``x``, the features of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = W.texts(batch.column(1))
            for first, end, part, cuts in W.slices(data, offs):
                x = features(part, cuts)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), WIDTH).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:end], rows], ["id", "x"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, x array<float>")


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def _descend(gradient, width: int) -> np.ndarray:
    """Adam from zero; ``gradient`` maps weights to a direction."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for step in range(1, STEPS + 1):
        d = gradient(w)
        m = 0.9 * m + 0.1 * d
        v = 0.999 * v + 0.001 * d * d
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among unlabelled rows, from a model that tells the two samples apart."""

    def gradient(w: np.ndarray) -> np.ndarray:
        return -p.T @ (1 - _sigmoid(p @ w)) / len(p) + u.T @ _sigmoid(u @ w) / len(u) + DECAY * 10 * w

    w = _descend(gradient, p.shape[1])
    ranks_p, ranks_u = p @ w, u @ w
    cuts = np.quantile(ranks_p, np.linspace(0.05, 0.7, 27))
    ratios = [(ranks_u >= c).mean() / (ranks_p >= c).mean() for c in cuts]
    return float(np.clip(min(ratios), 0.05, 0.99))


def fit(p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Weights of the least non-negative unbiased risk, logistic loss."""

    def gradient(w: np.ndarray) -> np.ndarray:
        gp, gu = p @ w, u @ w
        sp, su = _sigmoid(gp), _sigmoid(gu)
        as_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        if risk < 0:
            return -as_negative
        return prior * (-p.T @ (1 - sp)) / len(p) + as_negative + DECAY * w

    return _descend(gradient, p.shape[1])


class Model:
    """Scales features and scores them."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray):
        self.weights, self.mean, self.scale, self.prior = np.zeros(WIDTH + 1), np.zeros(WIDTH), np.ones(WIDTH), 0.5
        if len(positive) and len(unlabelled):
            self.mean, self.scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
            p, u = self._scaled(positive), self._scaled(unlabelled)
            self.prior = estimate_prior(p, u)
            self.weights = fit(p, u, self.prior)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._scaled(x) @ self.weights)


def _sampled(rows: DataFrame, most: int) -> np.ndarray:
    """Features of about ``most`` rows at the most, drawn by a hash of the id, in order of the id."""
    count = rows.count()
    keep = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(count, 1)))
    table = rows.where(keep).select("id", "x").toArrow().sort_by("id")
    return np.array(table["x"].combine_chunks().values, dtype=np.float64).reshape(-1, WIDTH)


def train(featured: DataFrame, positives: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """Fit on rows of ``featured`` where ``learn`` holds; ``positives`` has the ids of trusted rows."""
    rows = featured.where(learn)
    good = rows.join(positives.select("id").distinct(), "id", "left_semi")
    return Model(_sampled(good, sample), _sampled(rows, sample))


def score(featured: DataFrame, model: Model) -> DataFrame:
    """``id`` and ``score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).values, dtype=np.float64).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["id", "score"])

    return featured.select("id", "x").mapInArrow(run, f"id {featured.schema['id'].dataType.simpleString()}, score double")


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text of ``documents``, learned from labelled good rows outside the held-out fold."""
    featured = written(featurise(spark.read.parquet(f"{sf_dir}/documents.parquet")), "features")
    fold = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(FOLDS))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("id"))
    model = train(featured, labels, fold != 0)
    return score(featured, model).select(
        F.col("id").alias("doc_id"),
        F.coalesce(fold == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
