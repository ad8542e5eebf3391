"""Language identification with string kernels.

Kernel: blended-spectrum presence kernel. Two texts share as many features as they
have byte n-grams of 2 to 4 in common, over the geometric mean of their own counts.
Nyström: a bounded set of landmark texts spans the feature map
``phi(x) = k(x, landmarks) K^(-1/2)``, on which one-versus-rest kernel ridge
regression is solved in closed form. Since the kernel is linear in gram presence,
``k(x, landmarks) K^(-1/2) W`` is the product of a batch's presence matrix with one
grams-by-languages matrix that is multiplied out beforehand; whole texts are scored
in such batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, free, read
from .toxicity import fold

SIZES = (2, 3, 4)
#: Texts per language that are trained on, and landmarks over all languages.
PER_LANGUAGE, LANDMARKS = 400, 160
#: The sample as a whole: the most languages, texts and characters of a text that are learned from.
LANGUAGES, SAMPLE, FIT_CHARS = 128, 3_200, 65_536
RIDGE = 1e-3
BATCH = 64
UNKNOWN = "und"



def has_letter(text: str) -> bool:
    """Whether a character of the text is a letter (signs, numbers and fractions are not)."""
    return any(map(str.isalpha, text))


_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[[c for c in range(128) if not chr(c).isalpha()]] = 32


def grams(text: str) -> np.ndarray:
    """Sorted distinct n-grams of a whole text as numbers; other ASCII than letters is space."""
    a = _SPACE[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)].astype(np.uint64)
    a = a[np.append(True, (a[1:] != 32) | (a[:-1] != 32))]
    out, code = [], a
    for n in range(2, SIZES[-1] + 1):
        if len(a) < n:
            break
        code = (code[:-1] << np.uint64(8)) | a[n - 1 :]
        if n in SIZES:
            out.append(np.unique(code) | np.uint64(n << 40))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


@dataclass
class Model:
    langs: list[str]
    vocabulary: np.ndarray  # sorted grams of the landmarks
    weights: np.ndarray  # grams x languages: landmarks' presence, K^(-1/2) and ridge weights, multiplied out
    bias: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        presence = np.zeros((len(texts), len(self.vocabulary)), dtype=np.float32)
        norm = np.ones(len(texts))
        for i, x in enumerate(texts):
            presence[i, :], norm[i] = _presence(grams(x), self.vocabulary)
        return presence @ self.weights / norm[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [i for i, x in enumerate(texts) if x is not None and self.langs and has_letter(x)]
        langs, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for k in range(0, len(known), BATCH):
            part = known[k : k + BATCH]
            s = self.scores([texts[i] for i in part])
            best = s.argmax(axis=1)
            for i, b, v in zip(part, best, s.max(axis=1), strict=True):
                langs[i], score[i] = self.langs[b], float(min(1.0, max(0.0, (1 + v) / 2)))
        return langs, score


def _presence(g: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, float]:
    row = np.zeros(len(vocabulary), dtype=np.float32)
    if len(g) and len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, g), len(vocabulary) - 1)
        row[at[vocabulary[at] == g]] = 1
    return row, float(np.sqrt(max(len(g), 1)))


def train(texts: list[str], langs: list[str], landmarks: int = LANDMARKS) -> Model:
    """Nyström map and one-versus-rest ridge regression; landmarks are dealt evenly to the languages."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros(0, dtype=np.uint64), np.zeros((0, 0), dtype=np.float32), np.zeros(0))
    by = {n: [i for i, x in enumerate(langs) if x == n] for n in names}
    chosen = [i for n in names for i in by[n][: max(1, landmarks // len(names))]]
    sets = [grams(x) for x in texts]
    vocabulary = np.unique(np.concatenate([sets[i] for i in chosen] + [np.zeros(0, dtype=np.uint64)]))
    marks = np.zeros((len(chosen), len(vocabulary)), dtype=np.float32)
    for r, i in enumerate(chosen):
        row, norm = _presence(sets[i], vocabulary)
        marks[r] = row / norm
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.zeros((len(texts), int(good.sum())))
    for i in range(0, len(texts), BATCH):
        block = np.stack([np.divide(*_presence(g, vocabulary)) for g in sets[i : i + BATCH]])
        phi[i : i + BATCH] = (block @ marks.T) @ root
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    middle, level = phi.mean(axis=0), y.mean(axis=0)
    a = phi - middle
    w = np.linalg.solve(a.T @ a + RIDGE * len(texts) * np.eye(a.shape[1]), a.T @ (y - level))
    return Model(names, vocabulary, (marks.T @ (root @ w)).astype(np.float32), level - middle @ w)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from a bounded sample: about PER_LANGUAGE texts of each non-null language, fewer where there are many
    languages, chosen by a hash of the id. Learned are the LANGUAGES with most texts; the driver holds at most
    2 * SAMPLE texts, of each the first FIT_CHARS characters. An empty table gives a model that answers ``und``."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.substring(F.col(f"`{text_col}`"), 1, FIT_CHARS).alias("_text"), F.col(f"`{lang_col}`").alias("_lang"))
    rows = rows.where(F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    top = rows.groupBy("_lang").count().orderBy(F.col("count").desc(), "_lang").limit(LANGUAGES).collect()
    counts = {r["_lang"]: r["count"] for r in top}
    each = min(PER_LANGUAGE, SAMPLE // max(1, len(counts)))
    u = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = F.lit(False)
    for lang, n in sorted(counts.items()):
        wanted = wanted | ((F.col("_lang") == lang) & (u < each / n))
    got = rows.where(wanted).withColumn("_u", u).limit(2 * each * max(1, len(counts))).collect()
    got.sort(key=lambda r: (r["_u"], str(r["_id"]), r["_text"]))
    return train([r["_text"] for r in got], [r["_lang"] for r in got])


def identified(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "_lang_pred", score_name: str = "_score") -> DataFrame:
    """``docs`` with ``lang_name`` and ``score_name`` (input columns of these names are
    replaced, all others stay). Null texts and texts without a letter are ``und`` with
    score 0; ties go to the first language in order; repeated rows are judged each; an
    empty table gives an empty result."""
    batched(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model.vocabulary, model.weights, model.bias))

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(*held.value)
        for texts in batches:
            langs, score = model.predict([None if x is None else x for x in texts])
            yield pd.DataFrame({"lang": langs, "score": score})

    held_name = free(docs, "_predicted")
    out = docs.withColumn(held_name, predict(F.col(f"`{text_col}`")))
    return out.withColumns({lang_name: F.col(held_name)["lang"], score_name: F.col(held_name)["score"]}).drop(held_name)


def held_out(id_: Column) -> Column:
    return fold(id_, 4) == 2


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))))
    out = identified(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))
