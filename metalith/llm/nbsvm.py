"""Quality classifier: naive Bayes support vectors (Wang & Manning, 2012).

A text is the set of its n-grams: lower-case words, pairs of them, and runs of up to three shapes (a word's case,
digits and signs). Each indicator is scaled by the log ratio of the n-gram's smoothed shares in
the two classes; on these a linear hinge-loss model is fitted by dual coordinate descent (Hsieh et al., 2008).
The weights are drawn towards their mean size, and margins of held-out folds give the logistic curve that
turns a margin into a score.

Training reads a bounded sample of labelled texts; scoring reads every whole text in Arrow batches.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, read
from .toxicity import _uniform, fold

#: Most texts of each class in training (twice that at most), and the most bytes of one of them.
MAX_TEXTS, MAX_BYTES = 2_500, 1 << 16
#: N-grams in fewer training texts are left out; most that are kept, the frequent ones first.
MIN_TEXTS, MAX_FEATURES = 4, 200_000
#: Smoothing of the counts, box of the dual variables, share of the fitted weights against their mean size.
ALPHA, BOX, BETA = 1.0, 0.02, 0.5
EPOCHS, FOLDS, BUCKETS = 12, 3, 1 << 20
THRESHOLD = 0.3

RUN = re.compile(r"(.)\1+")
#: Characters of a text that are looked at together; bounds what a long text needs.
PART = 1 << 17
#: Shapes of so many words are remembered by a worker.
MEMORY = 1 << 16


class _Marks(dict):
    """Mark of a character, by code point: a, A, 9 or itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = mark = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        return mark


_marks = _Marks()


def shape(word: str) -> str:
    """Case and signs of a word: ``a``, ``AA``, ``Aa``, ``a,``, ``9``; runs of a sign count as two."""
    if word.islower() and word.isalpha():
        return "a"
    return RUN.sub(r"\1\1", word.translate(_marks)).replace("aa", "a")


class _Shapes(dict):
    def __missing__(self, word: str) -> str:
        if len(self) >= MEMORY:
            self.clear()
        if len(word) > 64:
            return shape(word)
        self[word] = found = shape(word)
        return found


_shapes = _Shapes()


def parts(text: str) -> Iterator[str]:
    """A text in parts of PART characters or less, cut before a blank where there is one."""
    at = 0
    while len(text) - at > PART:
        cut = text.rfind(" ", at + PART // 2, at + PART)
        cut = cut if cut > 0 else at + PART
        yield text[at:cut]
        at = cut
    yield text[at:]


def grams(text: str | None, known: dict[str, str] | None = None) -> Iterator[set]:
    """The n-grams of a text, a set for each part of it: lower-case words (what stands between
    white space) and pairs of them, and as ``("~", ...)`` one to three neighbouring shapes; ``"=="``
    and ``"==="`` mark a word that follows itself. The last words of a part stand before the next, so
    no n-gram is cut. Words that ``known`` hasn't may be left out with it."""
    before: list[str] = []
    for part in parts(text or ""):
        words = before + part.split()
        before = words[-2:]
        low = list(map(str.lower, words))
        found = set()
        if any(map(eq, low, low[1:])):
            found.add("==")
            if any(a == b == c for a, b, c in zip(low, low[1:], low[2:])):
                found.add("===")
        low = low if known is None else list(map(known.get, low))
        found.update(low, zip(low, low[1:]))
        shapes = list(map(_shapes.__getitem__, words))
        three = set(zip(shapes, shapes[1:], shapes[2:]))
        two = {x[1:] for x in three} | set(zip(shapes[:2], shapes[1:2]))
        found.update(("~", *x) for x in three | two | {(x,) for x in set(shapes)})
        yield found


@dataclass
class Model:
    """Weights of the n-grams, bias of the margin, and the curve of the score."""

    weights: dict[str | tuple, float]
    bias: float
    slope: float
    offset: float
    known: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.known = {w: w for g in self.weights for w in ((g,) if isinstance(g, str) else g if g[0] != "~" or len(g) == 2 else ())}

    def margin(self, text: str | None) -> float:
        keys, seen = self.weights.keys(), set()
        for part in grams(text, self.known):
            seen |= keys & part
        return self.bias + math.fsum(map(self.weights.__getitem__, seen))

    def score(self, text: str | None) -> float:
        return float(_logistic(self.slope * self.margin(text) + self.offset))


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def log_ratio(counts_1: np.ndarray, counts_0: np.ndarray) -> np.ndarray:
    """Log of the n-grams' smoothed shares in class 1 against class 0."""
    p, q = counts_1 + ALPHA, counts_0 + ALPHA
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, box: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """``min |w|^2 / 2 + sum box_i max(0, 1 - y_i (w x_i + b))`` with the bias as one more
    feature of value 1. ``rows`` name each text's n-grams, whose values are ``scale``.
    One dual variable at a time moves to its best place in [0, box_i]; w follows."""
    w, b = np.zeros(len(scale)), 0.0
    a, norm = np.zeros(len(rows)), np.array([1.0 + np.square(scale[r]).sum() for r in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x = scale[rows[i]]
            gradient = y[i] * (w[rows[i]] @ x + b) - 1
            new = min(max(a[i] - gradient / norm[i], 0.0), box[i])
            if new != a[i]:
                step = (new - a[i]) * y[i]
                a[i] = new
                w[rows[i]] += step * x
                b += step
    return w, b


def _margins(rows: list[np.ndarray], w: np.ndarray, b: float) -> np.ndarray:
    return np.array([b + w[r].sum() for r in rows])


def _fitted(rows: list[np.ndarray], y: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Weight of each n-gram's presence, and the bias."""
    flat = np.concatenate([np.zeros(0, dtype=np.int32), *rows])
    of = np.repeat(y, [len(r) for r in rows])
    ratio = log_ratio(np.bincount(flat[of > 0], minlength=n), np.bincount(flat[of < 0], minlength=n))
    share = np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    w, b = dual_coordinate_descent(rows, ratio, y, BOX * len(y) / (2.0 * share))
    w = (1 - BETA) * np.abs(w).mean() * np.sign(w) + BETA * w if len(w) else w
    return w * ratio, b


def _curve(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt's logistic curve of margins by Newton's method, targets drawn in a little."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target, z = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), np.zeros(2)
    unit = max(margins.std(), 1e-9)
    x = np.stack([margins / unit, np.ones(len(y))])
    for _ in range(50):
        p = _logistic(z @ x)
        slope = x @ (weight * (p - target)) + 1e-3 * z
        bend = (x * (weight * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        move = np.linalg.solve(bend, slope)
        z = z - move * min(1.0, 4.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-9:
            break
    return float(max(z[0], 0.0) / unit), float(z[1])


def train(texts: list[str | None], labels: list[int], share: float | None = None) -> Model:
    """Fit from texts and their classes 0 and 1. ``share``: of class 1 where scores are
    made, by default that of the sample. With one class or none, every score is ``share``."""
    y = np.where(np.array(labels, dtype=int) > 0, 1.0, -1.0)
    share = min(max(float((y > 0).mean()) if share is None and len(y) else share if share is not None else 0.5, 1e-3), 1 - 1e-3)
    if not len(y) or abs(y.sum()) == len(y):
        return Model({}, 0.0, 0.0, float(np.log(share / (1 - share))))
    # texts by bucket first, so that no dictionary ever holds the n-grams that are rare
    texts_in = np.zeros(BUCKETS, dtype=np.int32)
    name = lambda g: g if isinstance(g, str) else "\t".join(g)
    bucket = lambda g: zlib.crc32(name(g).encode("utf-8", "replace")) & (BUCKETS - 1)
    every = lambda text: set().union(*grams(text))
    for text in texts:
        texts_in[list({bucket(g) for g in every(text)})] += 1
    index: dict[str | tuple, int] = {}
    rows = [np.array([index.setdefault(g, len(index)) for g in sorted(every(text), key=name) if texts_in[bucket(g)] >= MIN_TEXTS], dtype=np.int32) for text in texts]
    counts = np.bincount(np.concatenate([np.zeros(0, dtype=np.int32), *rows]), minlength=len(index))
    names = sorted(index, key=lambda g: (-counts[index[g]], name(g)))
    names = [g for g in names[:MAX_FEATURES] if counts[index[g]] >= MIN_TEXTS]
    column = np.full(len(index) + 1, -1, dtype=np.int32)
    column[[index[g] for g in names]] = np.arange(len(names))
    rows = [np.sort(c[c >= 0]) for c in (column[r] for r in rows)]
    part, held = np.arange(len(y)) % FOLDS, np.zeros(len(y))
    for k in range(FOLDS):
        inside = [i for i in range(len(y)) if part[i] != k]
        if abs(y[inside].sum()) < len(inside):
            w, b = _fitted([rows[i] for i in inside], y[inside], len(names))
            out = np.flatnonzero(part == k)
            held[out] = _margins([rows[i] for i in out], w, b)
    weight = np.where(y > 0, share * len(y) / (y > 0).sum(), (1 - share) * len(y) / (y < 0).sum())
    slope, offset = _curve(held, y, weight)
    w, b = _fitted(rows, y, len(names))
    return Model({g: float(x) for g, x in zip(names, w, strict=True) if x}, float(b), slope, offset)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Train from the labelled texts of ``docs``: of each class those whose ids hash lowest,
    about MAX_TEXTS, each of MAX_BYTES at most. Of several labels of an id the highest counts;
    null ids and labels are passed over. Rows of one id are all read."""
    marks = labels.where(F.col(f"`{label_col}`").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.expr(f"int(`{label_col}` > 0)")).alias("_y"))
    share = {r["_y"]: r["n"] for r in marks.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    ids = {}
    for y, n in share.items():
        some = marks.where(F.col("_y") == y).where(_uniform(F.col("_id"), 13) < MAX_TEXTS / n).select("_id").limit(2 * MAX_TEXTS)
        ids |= dict.fromkeys((r["_id"] for r in some.collect()), y)
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    # the ids are a bounded list, so their texts come from one filtered scan without a join
    texts = texts.where(F.col("_id").isin(list(ids)) & (F.octet_length("_text") <= MAX_BYTES)).limit(4 * MAX_TEXTS)
    found = sorted((i, t) for b in texts.toArrow().to_batches(256) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    found.sort(key=lambda r: zlib.crc32(str(r[0]).encode()))
    total = sum(share.values())
    return train([t for _, t in found], [ids[i] for i, _ in found], share.get(1, 0) / total if total else None)


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` and ``name``, the score of each whole text (an input column of that name is
    replaced, all others stay). Null and empty texts get the score of the bias alone;
    repeated rows are scored each; an empty table gives an empty result."""
    batched(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        return texts.map(held.value.score, na_action=None)

    return docs.withColumn(name, score(F.col(f"`{text_col}`")))


def model_of(spark: SparkSession, sf_dir: str) -> Model:
    """The production model: trained on the rows outside the held-out fold."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").where(fold(F.col("doc_id"), 5) != 0)
    labels = read(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    return fit(docs, labels)


def op13_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(read(spark, sf_dir, "documents").select("doc_id", "text"), model_of(spark, sf_dir))
    return out.select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
