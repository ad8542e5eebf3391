"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

A linear classifier over the presence of words and word beginnings is trained with numpy from confirmed toxic
texts and unlabelled texts. Its risk estimator corrects the unlabelled loss by the
class prior and is kept from going negative, which is what stops over-fitting:

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]),   l(z) = 1 / (1 + exp(z))

Training data are bounded samples; scoring reads every whole text in Arrow batches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, read

WORD = re.compile(r"[^\W\d_]+")
#: Most positive and unlabelled texts that are trained on (about 3 kB each).
MAX_POSITIVE, MAX_UNLABELLED = 1_500, 4_000
#: Characters of a training text that are learned from.
FIT_CHARS = 65_536
#: Words whose presence differs this many standard errors between the samples are features.
MIN_Z, MIN_TEXTS = 4.0, 4
STEPS, RATE, DECAY = 400, 0.1, 1e-5
THRESHOLD = 0.7
#: Letters of a word's beginning; inflected forms of a word share it.
HEAD = 4


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case words of a text and their beginnings (``^`` and HEAD letters)."""
    words = set(WORD.findall((text or "").lower()))
    return words | {"^" + w[:HEAD] for w in words}


def score_of(weights: dict[str, float], bias: float, text: str | None) -> float:
    g = bias + sum(map(weights.__getitem__, weights.keys() & words_of(text)))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, g))))


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        return score_of(self.weights, self.bias, text)


def _uniform(key: Column, seed: int = 5) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _indexed(texts: Iterable[str | None], index: dict[str, int]) -> list[np.ndarray]:
    """The features of each text as numbers; a text is let go once it is numbered."""
    return [np.array([index.setdefault(w, len(index)) for w in words_of(x)], dtype=np.int32) for x in texts]


def gradient(w: np.ndarray, b: float, rows: np.ndarray, cols: np.ndarray, n_p: int, n: int, prior: float) -> tuple[float, np.ndarray, float]:
    """Risk, and the gradient by which it is walked, of texts 0 to n_p (positive) and n_p
    to n (unlabelled), whose features are the pairs (rows, cols). Where the unlabelled
    part is below zero, the walk is back up its slope."""
    g = np.bincount(rows, weights=w[cols], minlength=n) + b
    low = 1 / (1 + np.exp(np.clip(g, -60, 60)))  # l(g); l(-g) = 1 - low
    slope = low * (1 - low)  # d l(-g) / dg = -d l(g) / dg
    positive, negative = prior * low[:n_p].mean(), (1 - low[n_p:]).mean() - prior * (1 - low[:n_p]).mean()
    pos, unl = prior * slope[:n_p] / n_p, slope[n_p:] / (n - n_p)
    push = np.concatenate([-2 * pos, unl] if negative >= 0 else [pos, -unl])
    return positive + max(0.0, negative), np.bincount(cols, weights=push[rows], minlength=len(w)), push.sum()


def train(positive: Iterable[str | None], unlabelled: Iterable[str | None], prior: float) -> Model:
    """nnPU with the sigmoid loss, full batches and Adam. Without positive texts the
    model scores everything near 0."""
    index: dict[str, int] = {}
    p, u = _indexed(positive, index), _indexed(unlabelled, index)
    if not p or not u:
        return Model({}, -5.0)
    none = np.zeros(0, dtype=np.int32)
    cp, cu = (np.bincount(np.concatenate([none, *x]), minlength=len(index)) for x in (p, u))
    m = (cp + cu) / (len(p) + len(u))
    error = np.sqrt(m * (1 - m) * (1 / len(p) + 1 / len(u)))
    error[error == 0] = 1.0
    good = (cp >= MIN_TEXTS) & (np.abs(cp / len(p) - cu / len(u)) >= MIN_Z * error)
    names = sorted(w for w, i in index.items() if good[i])
    column = np.full(len(index), -1, dtype=np.int32)
    column[[index[w] for w in names]] = np.arange(len(names))
    del index
    seen = [np.sort(c[c >= 0]) for c in (column[x] for x in p + u)]
    rows, cols = np.repeat(np.arange(len(seen)), [len(x) for x in seen]), np.concatenate([none, *seen])
    w, b = np.zeros(len(names)), -1.0
    m1, m2 = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, STEPS + 1):
        _, by_w, by_b = gradient(w, b, rows, cols, len(p), len(seen), prior)
        grad = np.append(by_w + DECAY * w, by_b)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model({n: float(x) for n, x in zip(names, w, strict=True)}, float(b))


def _texts(df: DataFrame) -> Iterator[str | None]:
    """A bounded column of texts in order of id and text, so that sums do not follow the partitions; one by one from
    Arrow batches."""
    for batch in df.orderBy("_id", "_text").select("_text").toArrow().to_batches(256):
        yield from batch.column(0).to_pylist()


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train from the texts that ``labels`` confirms as toxic and from all texts of
    ``docs`` as the unlabelled ones. ``prior``: share of toxic texts; by default that
    of the labelled rows. Bounded by MAX_POSITIVE, MAX_UNLABELLED and the first FIT_CHARS
    characters of each; the driver holds the sampled texts in columns and their words as
    numbers."""
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.substring(F.col(f"`{text_col}`"), 1, FIT_CHARS).alias("_text"))
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_label_id")).agg(F.max("toxic").alias("_toxic"))
    seen = marks.agg(F.count("*").alias("n"), F.sum(F.col("_toxic")).alias("k")).first()
    n, k = seen["n"] or 0, seen["k"] or 0
    if not k:
        return train([], [], prior or 0.1)
    hit = marks.where("_toxic = 1").where(_uniform(F.col("_label_id")) < MAX_POSITIVE / k)
    ids = [r[0] for r in hit.select("_label_id").limit(2 * MAX_POSITIVE).collect()]
    # the ids are a bounded list, so their texts come from one filtered scan without a join
    positive = texts.where(F.col("_id").isin(ids)).limit(2 * MAX_POSITIVE)
    unlabelled = texts.where(_uniform(F.col("_id")) < MAX_UNLABELLED / max(texts.count(), 1)).limit(2 * MAX_UNLABELLED)
    return train(_texts(positive), _texts(unlabelled), prior if prior is not None else k / n)


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` and ``name``, the score of each whole text (an input column of that name is
    replaced, all others stay). Null and empty texts get the score of the bias alone;
    repeated rows are scored each; an empty table gives an empty result."""
    batched(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def score(texts):
        weights, bias = held.value
        return texts.map(lambda x: score_of(weights, bias, x), na_action=None)

    return docs.withColumn(name, score(F.col(f"`{text_col}`")))


def fold(id_: Column, n: int) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % n


def model_of(spark: SparkSession, sf_dir: str) -> Model:
    """The production model: trained on the rows outside the held-out fold."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").where(fold(F.col("doc_id"), 3) != 1)
    labels = read(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1)
    return fit(docs, labels)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(read(spark, sf_dir, "documents").select("doc_id", "text"), model_of(spark, sf_dir))
    return out.select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
