"""Experiments beside models, and typed Debye-Waller metrics with their guard, against plain Python."""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import pytest

from metalith.operators import matching, spectra


def test_experiments_match_by_any_key_once(spark):
    experiments = ["d/9QQT_exp_1.dat", "d/9qqt.dat", "d/cons-exp.dat", "d/chls_a_1abc.dat", "d/XXXX.dat", "d/my_9qqt-EXP.dat", "d/expo.dat", "d/9QQT_exp_1.dat"]
    models = ["9qqt_cons", "model_1ABC_h-only", "CONS", "xxxx_cluster1", "MY_9QQT", "9qqt_cons"]

    def token(name):
        return next((t.upper() for t in re.findall("[A-Za-z0-9]+", name) if len(t) == 4 and not re.fullmatch("[CHLSchls]{4}|[Xx]{4}", t)), None)

    want = set()
    for m in models:
        keys = {token(m)} - {None} | ({"CONS"} if "cons" in [t.lower() for t in re.findall("[A-Za-z0-9]+", m)] else set())
        for e in experiments:
            stem = e.split("/")[1].rsplit(".", 1)[0]
            hit = re.match(r"(?i)^(.+?)[_-]exp(?:$|[_-].*)", stem)
            key = hit[1].strip("_-").upper() if hit and hit[1].strip("_-") else token(stem)
            if key in keys:
                want.add((m, e))
    got = matching.matched(spark.createDataFrame([(m,) for m in models], "prefix string"), spark.createDataFrame([(e,) for e in experiments], "path string")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) >= 6


def test_typed_metrics_and_their_guard(spark):
    rng, rows, want = np.random.default_rng(5), [], {}
    for s, (first, carbons) in {"a": (4, 4), "b": (4, 6), "c": (3, 4), "d": (4, 3), "e": (5, 5)}.items():
        atoms = [(("S", "S", "N", "N", "N")[i], rng.normal(size=3) * 2, float(rng.random()), ("S", "S", "ND", "NE", "NE")[i]) for i in range(first)]
        ca = [("C", rng.normal(size=3) * 4, float(rng.random()), "C") for _ in range(carbons)]
        rows += [(s, i, el, *map(float, p), dw, kind) for i, (el, p, dw, kind) in enumerate(atoms + ca)] + [(s, 99, "H", 0.0, 0.0, 0.0, 1.0, "H")]
        if first == 4 and carbons >= 4:
            best = min(permutations(range(carbons), 4), key=lambda o: sum(((atoms[i][1] - ca[j][1]) ** 2).sum() for i, j in enumerate(o)))
            for kind in {a[3] for a in atoms} | {"all"}:
                for part, chosen in (("first", atoms), ("ca", [ca[j] for j in best])):
                    own = [c for a, c in zip(atoms, chosen, strict=True) if kind in ("all", a[3])]
                    d = [np.linalg.norm(c[1]) for c in own]
                    want[s, kind, part] = (len(own), np.mean([c[2] for c in own]), np.var(d), np.mean([c[2] for c in own]) + np.var(d))
    df = spark.createDataFrame(rows, "source string, line_no long, element string, x double, y double, z double, dw double, kind string")
    got = {(r["source"], r["kind"], r["part"]): (r["n"], r["mean_dw"], r["var_d"], r["total"]) for r in spectra.shell_metrics(df).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    reasons = {r["source"]: r["reason"] for r in spectra.paired_shells(df).collect()}
    assert reasons == {"a": None, "b": None, "c": "4 S or N with dw are needed, 3 found", "d": "4 C with dw are needed, 3 found", "e": "4 S or N with dw are needed, 5 found"}
