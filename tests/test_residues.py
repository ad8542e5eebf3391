"""Inferred coordinators, declared sequences, B-factor groups, ring turns and path alignment on small cases."""

from __future__ import annotations

import math
import random
from itertools import permutations

import numpy as np
import pytest

from metalith.operators import bfactor, coordinators, graph

from .test_units import rows


def test_coordinators_of_a_planted_site(spark):
    """A cysteine and two histidines, one bound by each nitrogen, without any names; a lone nitrogen gives nothing."""
    ring = {"CG": (0, 0), "ND1": (0.75, 1.15), "CE1": (2.05, 0.85), "NE2": (2.05, -0.5), "CD2": (0.75, -0.95), "CB": (-1.3, 0.75), "CA": (-2.6, 0.1)}

    def his(donor, far):
        c = np.array(ring[donor])
        out = c - np.mean([ring[k] for k in ("CG", "ND1", "CE1", "NE2", "CD2")], axis=0)
        turn = math.atan2(out[1], out[0])
        rot = np.array([[math.cos(-turn), -math.sin(-turn)], [math.sin(-turn), math.cos(-turn)]])
        return {k: (*(rot @ (np.array(v) - c)) * np.array([1, 1]), 0.0) for k, v in ring.items()}

    atoms, want = [("ZN", "ZN", 0, 0, 0)], {}
    for resseq, donor, axis in ((101, "ND1", 0), (102, "NE2", 1)):
        for k, (x, y, z) in his(donor, 2).items():
            p = (x - 2.05 - 0.02 * axis, y, z)  # the ring points away from the metal along -x, then is turned onto its axis
            p = p if axis == 0 else (p[1], p[0], p[2])
            want[len(atoms)] = (resseq, k, k == donor)
            atoms.append((k, k[0], *p))
    for k, p in {"SG": (0, 0, 2.3), "CB": (0, 0, 4.1), "CA": (1.4, 0, 4.6), "N": (0, 0, -3.0)}.items():
        if k != "N":
            want[len(atoms)] = (1, k, k == "SG")
        atoms.append((k, k[0], *p))
    got = coordinators.coordinators(rows(spark, atoms).drop("resname", "atom_name")).collect()
    names = {}
    for r in got:
        if r["resname"] != "ZN" and (r["line_no"] not in names or r["coord"]):
            names[r["line_no"]] = (r["resseq"], r["atom_name"], r["coord"])
    assert names == want
    assert [(r["resname"], r["resseq"], r["x"]) for r in got if r["resname"] == "ZN"] == [("ZN", 0, 0.0)]
    assert {r["resname"] for r in got if r["resseq"] > 100} == {"HIS"} and len(got) == 1 + 3 + 2 * 8


def test_declared_positions_equal_a_plain_fold(spark):
    rng = random.Random(4)
    names, observed, declared, want = ["GLY", "ALA", "CYS"], [], [], {}
    for s in range(6):
        for chain in "AB":
            row = [rng.choice(names) for _ in range(rng.randint(0, 25))]
            seen = {(n, c) for n in range(-2, 30) for c in ("", "A") if rng.random() < 0.4}
            named = {k: rng.choice(names) for k in seen}
            observed += [(str(s), 1, chain, v.lower() if s else v, f"{n}{c}") for (n, c), v in named.items()]
            if s < 5:
                declared.append((str(s), 1, chain, row))
            at = 0
            for n, c in sorted(seen):
                places = [i for i in range(at, len(row)) if row[i] == named[n, c]]
                want[str(s), chain, f"{n}{c}"] = places[0] if places and s < 5 else None
                at = places[0] + 1 if places else at
    df = spark.createDataFrame(observed, "structure_id string, model int, chain string, resname string, resseq string")
    d = spark.createDataFrame(declared, "structure_id string, model int, chain string, residues array<string>")
    got = bfactor.declared_positions(df, d).collect()
    assert {(r["structure_id"], r["chain"], r["resseq"]): r["seq_index"] for r in got} == want and len(got) == len(want)


def test_declared_neighbors_fall_back_to_the_order_seen(spark):
    p = spark.createDataFrame(
        [("s", 1, "A", "GLY", "1", 0, False), ("s", 1, "A", "CYS", "2", 5, True), ("s", 1, "A", "ALA", "3", 7, False), ("s", 1, "A", "ALA", "4", 9, False), ("s", 1, "B", "HIS", "8", None, True), ("s", 1, "B", "GLY", "9", 4, False), ("s", 1, "B", "GLY", "12", 11, False), ("s", 1, "B", "GLY", "13", 12, False)],
        "structure_id string, model int, chain string, resname string, resseq string, seq_index int, hit boolean",
    )
    assert sorted(r["resseq"] for r in bfactor.declared_neighbors(p, "hit").collect()) == ["12", "2", "3", "8", "9"]


def test_metal_groups(spark):
    a = lambda name, seq, x, b, res="CYS", **m: dict(atom_name=name, element=name[0], resname=res, resseq=seq, record="ATOM", x=float(x), y=0.0, z=0.0, bfac=float(b)) | m
    df = rows(spark, [
        dict(atom_name="ZN", element="ZN", resname="ZN", resseq="99", x=0.0, y=0.0, z=0.0, bfac=5.0), a("N", "1", 4, 1, "GLY"), a("CA", "2", 6, 2, "GLY"), a("SG", "3", 2.3, 10), a("CB", "3", 3.2, 20), a("N", "3", 4.4, 900),
        a("CA", "4", 8, 4, "ALA"), a("H", "4", 2, 900, "ALA"), a("O", "5", 2.0, 900, "HOH", record="HETATM"), a("NE2", "6", -2.1, 7, "HIS"), a("CA", "7", -30, 8, "ALA"),
    ])
    got = {(r["ord"], r["label"]): (r["n"], r["mean"], r["std"]) for r in bfactor.metal_groups(df, df.where("element = 'ZN'")).collect()}
    assert got == {
        (0, "Zn"): (1, 5.0, 0.0), (1, "CYS3"): (2, 15.0, 5.0), (2, "near3"): (3, pytest.approx(7 / 3), pytest.approx(np.std([1, 2, 4]))), (3, "HIS6"): (1, 7.0, 0.0),
        (4, "near6"): (2, 6.0, 2.0), (1_000_000, "Pocket"): (4, pytest.approx(907 / 4), pytest.approx(np.std([1, 2, 4, 900]))),
    }
    alone = bfactor.metal_groups(df.where("element = 'ZN'"), df.where("element = 'ZN'")).collect()
    assert {(r["label"], r["n"], r["mean"], r["std"]) for r in alone} == {("Zn", 1, 5.0, 0.0), ("Pocket", 0, -1.0, 0.0)}


def test_frames_and_turns(spark):
    """Frames are orthonormal with y from metal to nitrogen and z across the ring; turns equal matrices about the nitrogen."""
    rng = np.random.default_rng(2)
    point = "struct<x: double, y: double, z: double>"
    rings, every = [], []
    for i in range(4):
        metal, n = rng.normal(size=3), rng.normal(size=3) + 3
        u, v = np.linalg.qr(rng.normal(size=(3, 2)))[0].T
        ring = [n] + [n + 1.2 * (math.cos(t) - 1) * u + 1.2 * math.sin(t) * v for t in (1.2, 2.5, 3.8, 5.0)]
        if i == 3:  # the normal lies along y
            metal = n - 2 * np.cross(u, v)
        rings.append((i, tuple(map(float, metal)), tuple(map(float, n)), [tuple(map(float, p)) for p in ring]))
        every.append((metal, n, ring, u, v))
    df = spark.createDataFrame(rings, f"i int, m {point}, n {point}, ring array<{point}>")
    frames = graph.ring_frames(df, ["i"])
    axes = {}
    for r in frames.collect():
        x, y, z = (np.array(r[k]) for k in ("ux", "uy", "uz"))
        metal, n, ring, u, v = every[r["i"]]
        assert np.allclose(np.array([x, y, z]) @ np.array([x, y, z]).T, np.eye(3)) and np.allclose(np.cross(z, y), x)
        assert np.allclose(y, (n - metal) / np.linalg.norm(n - metal))
        if r["i"] < 3:
            flat = np.cross(u, v) - (np.cross(u, v) @ y) * y
            assert abs(z @ flat) == pytest.approx(np.linalg.norm(flat))
        axes[r["i"]] = (x, y, z)
    sets = graph.angle_sets([10.0, 20.0], [30.0], [-50.0, 5.0])
    assert sets == [(10.0, 30.0, -50.0), (20.0, 30.0, 5.0)]
    with pytest.raises(ValueError):
        graph.angle_sets([1.0, 2.0], [1.0, 2.0, 3.0], [1.0])
    atoms = spark.createDataFrame([(i, k, *map(float, p)) for i, (_, _, ring, _, _) in enumerate(every) for k, p in enumerate(ring)], "i int, k int, x double, y double, z double")
    for r in graph.turned(atoms, frames, ["i"], sets).collect():
        _, n, ring, _, _ = every[r["i"]]
        p = ring[r["k"]] - n
        for axis, angle in zip((axes[r["i"]][1], axes[r["i"]][0], axes[r["i"]][2]), sets[r["nth"]], strict=True):
            t, q = math.radians(angle), np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
            p = (np.eye(3) + math.sin(t) * q + (1 - math.cos(t)) * q @ q) @ p
        assert np.allclose((r["x"], r["y"], r["z"]), p + n)


def _site(rng, kinds):
    """Residues of a made site: name, donor, places of atoms."""
    out = []
    for kind in kinds:
        names = ["SG", "CB", "CA"] if kind == "CYS" else ["ND1", "NE2", "CG", "CB", "CA"]
        base = rng.normal(size=3)
        base *= 2.2 / np.linalg.norm(base)
        out.append((kind, {n: base * (1 + 0.3 * i) + rng.normal(size=3) * 0.3 * (i > 0) for i, n in enumerate(names)}))
    return out


def test_paths_align_by_the_least_total(spark):
    rng = np.random.default_rng(8)
    sites = {"r": _site(rng, ["CYS", "CYS", "HIS", "HIS"])}
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    sites["same"] = [(k, {n: turn @ p for n, p in m.items()}) for k, m in sites["r"]]
    for i, kinds in enumerate((["CYS", "CYS", "HIS", "HIS"], ["CYS", "HIS", "HIS", "HIS"], ["HIS", "CYS", "CYS", "CYS"], ["CYS"] * 4, ["HIS"] * 4, ["HIS", "CYS"], ["CYS"] * 5)):
        sites[f"s{i}"] = _site(rng, kinds)
    line = iter(range(10_000))
    flat = [(s, next(line), "A", str(j), kind, n, *map(float, p)) for s, site in sites.items() for j, (kind, m) in enumerate(site) for n, p in m.items()]
    df = spark.createDataFrame(flat, "source string, line_no long, chain string, resseq string, resname string, atom_name string, x double, y double, z double")
    got = graph.aligned_paths(graph.coordinating(df), "r").collect()

    def picked(site):
        donors = [(min(("SG",) if k == "CYS" else ("ND1", "NE2"), key=lambda n: m[n] @ m[n]), k, str(j), m) for j, (k, m) in enumerate(site)]
        return sorted(donors, key=lambda r: (r[3][r[0]] @ r[3][r[0]], r[2]))[:4]

    def frame(r):
        a = r[3][r[0]] / np.linalg.norm(r[3][r[0]])
        other = next(r[3][n] for n in graph.FRAME_ATOMS if n in r[3] and n != r[0])
        b = other - (other @ a) * a
        b /= np.linalg.norm(b)
        return np.column_stack([a, b, np.cross(a, b)])

    ref = picked(sites["r"])
    lead = next(r for r in ref if r[1] == "CYS")
    ref = [lead, *(r for r in ref if r is not lead)]
    for name, site in sites.items():
        own = [r for r in got if r["source"] == name]
        assert len(own) == min(4, len(site))
        if name == "r":
            assert {r["total"] for r in own} == {0.0}
            continue
        cur, best = picked(site)[: len(ref)], None
        kinds = [c[1] for c in cur]
        alone = "CYS" if kinds.count("CYS") == 1 else "HIS" if kinds.count("HIS") == 1 or "CYS" not in kinds else "CYS"
        for seed in (i for i, k in enumerate(kinds) if k == alone):
            rot = frame(lead) @ frame(cur[seed]).T
            for order in permutations(range(len(cur))):
                if order[0] == seed:
                    total = sum(((ref[a][3][n] - rot @ cur[c][3][n]) ** 2).sum() for a, c in enumerate(order) for n in ref[a][3].keys() & cur[c][3].keys())
                    best = min(best or (math.inf,), (total, [cur[c][2] for c in order]), key=lambda t: t[0])
        assert all(r["total"] == pytest.approx(best[0]) for r in own)
        assert [r["resseq"] for r in sorted(own, key=lambda r: r["against"])] == best[1]
    assert {round(r["total"], 9) for r in got if r["source"] == "same"} == {0.0}
    with pytest.raises(ValueError):
        graph.aligned_paths(graph.coordinating(df), "nowhere")
    assert graph.aligned_paths(graph.coordinating(df).where("source = 'r'"), "r").count() == 4
