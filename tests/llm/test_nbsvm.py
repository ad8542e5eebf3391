"""The quality classifier: against plain Python, on held-out labels, and on odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from metalith.llm import nbsvm

from .test_llm import DATA, none, odd  # noqa: F401  (fixtures)


def test_held_out_labels(spark):
    sf = DATA.replace("sf0.001", "sf0.01")
    got = {r["doc_id"]: r for r in nbsvm.op13_quality_nbsvm(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in labels if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_grams_are_those_of_plain_python():
    text = "The the THE cat, sat!! on Ünder 4x4 a a a"
    words = text.lower().split()
    plain = set(words) | set(zip(words, words[1:], strict=False)) | {"==", "==="}
    shapes = ["Aa", "a", "AA", "a,", "a!!", "a", "Aa", "9a9", "a", "a", "a"]
    for n in (1, 2, 3):
        plain |= {("~", *shapes[i : i + n]) for i in range(len(shapes) - n + 1)}
    assert list(nbsvm.grams(text)) == [plain]
    assert list(nbsvm.grams(None)) == list(nbsvm.grams("")) == [set()]


def test_no_gram_is_cut_between_parts(monkeypatch):
    text = " ".join(f"w{i * i % 97} X{i}!" for i in range(400))
    whole = set().union(*nbsvm.grams(text))
    monkeypatch.setattr(nbsvm, "PART", 64)
    assert len(list(nbsvm.grams(text))) > 20 and set().union(*nbsvm.grams(text)) == whole


def test_long_texts_count_whole():
    model = nbsvm.Model({"bad": -3.0, ("so", "bad"): -2.0}, 0.5, 1.0, 0.0)
    assert model.margin("x " * 300_000 + "so bad") == -4.5 and model.margin("bad so") == -2.5


def test_descent_finds_the_minimum():
    """The dual's optimum: no small step in the primal lowers the objective."""
    rng = np.random.default_rng(1)
    n, m = 60, 12
    scale = rng.normal(size=m)
    rows = [np.sort(rng.choice(m, 5, replace=False)) for _ in range(n)]
    y, box = np.where(rng.random(n) < 0.5, 1.0, -1.0), rng.uniform(0.05, 0.3, n)
    w, b = nbsvm.dual_coordinate_descent(rows, scale, y, box, epochs=3000)
    x = np.zeros((n, m + 1))
    for i, r in enumerate(rows):
        x[i, r], x[i, m] = scale[r], 1
    cost = lambda v: v @ v / 2 + (box * np.maximum(0, 1 - y * (x @ v))).sum()
    best = np.append(w, b)
    assert all(cost(best) <= cost(best + 1e-3 * rng.normal(size=m + 1)) + 1e-9 for _ in range(300))


def test_ratio_is_of_smoothed_shares():
    r = nbsvm.log_ratio(np.array([3, 0]), np.array([1, 1]))
    assert r == pytest.approx([math.log((4 / 5) / (2 / 4)), math.log((1 / 5) / (2 / 4))])


def test_one_class_or_none():
    assert nbsvm.train([], []).score("x") == pytest.approx(0.5)
    assert nbsvm.train(["a", None], [1, 1]).score("x") == pytest.approx(0.999)


def test_odd_rows(odd, none):  # noqa: F811
    good, bad = ["a calm line of words", "some other calm words"] * 6, ["### BAD!! BAD!!", "BAD!! ###", None, ""] * 3
    model = nbsvm.train(good + bad, [1] * 12 + [0] * 12)
    assert model.score(good[0]) > 0.5 > model.score("BAD!! ###")
    got = nbsvm.scored(odd, model).collect()
    assert len(got) == 12 and all(0 <= r["score"] <= 1 and r["_w"] == "_w" for r in got)
    base = {r["score"] for r in got if not (r["text"] or "").strip()}
    assert len(base) == 1
    assert nbsvm.scored(none, model).collect() == []


def test_fit_passes_over_nulls(odd, spark):  # noqa: F811
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 0), (8, 0), (99, 1)], "doc_id long, quality int")
    model = nbsvm.fit(odd, labels)
    assert 0 <= model.score("alpha beta") <= 1
    assert nbsvm.fit(odd.limit(0), labels).weights == {} and nbsvm.fit(odd, labels.limit(0)).score("x") == pytest.approx(0.5)
