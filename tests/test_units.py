"""Hand-checked cases of single operators."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metalith.functions import geometry as G
from metalith.operators import atoms as A
from metalith.operators import clusters as C
from metalith.operators import neighbors as N
from metalith.operators import record as R
from metalith.operators import sites as S
from metalith.sources import catalog, mmcif, pdb, xyz

KEYS = dict(structure_id="s", model=1)


def rows(spark, atoms):
    """Atoms from (name, element, x, y, z) or dicts, with defaults for the rest."""
    base = dict(KEYS, record="HETATM", altloc="", resname="LIG", chain="A", icode="", occ=1.0, bfac=0.0)
    out = []
    for i, a in enumerate(atoms):
        if not isinstance(a, dict):
            a = dict(atom_name=a[0], element=a[1], x=float(a[2]), y=float(a[3]), z=float(a[4]))
        out.append(base | dict(serial=i + 1, line_no=i, resseq=str(i)) | a)
    ddl = "structure_id string, model int, line_no long, record string, serial int, atom_name string, altloc string, resname string, chain string, resseq string, icode string, x double, y double, z double, occ double, bfac double, element string"
    return spark.createDataFrame([[r[c.split()[0]] for c in ddl.split(", ")] for r in out], ddl)


def shell_label(spark, points):
    df = rows(spark, [("ZN", "ZN", 0, 0, 0)] + [(f"N{i}", "N", *p) for i, p in enumerate(points)])
    center = df.where("atom_name = 'ZN'").select(*A.STRUCTURE, "line_no", "serial", "x", "y", "z")
    return S.geometry(N.coordination(center, df)).first()


@pytest.mark.parametrize(
    ("points", "label"),
    [
        ([(2.1, 0, 0), (-2.1, 0, 0)], "LIN"),
        ([(2.1, 0, 0), (-1.05, 1.8187, 0)], "BEN"),
        ([(2.1, 0, 0), (-1.05, 1.8187, 0), (-1.05, -1.8187, 0)], "TP"),
        ([(2.1 / 3**0.5 * a, 2.1 / 3**0.5 * b, 2.1 / 3**0.5 * c) for a, b, c in ((1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1))], "TD"),
        ([(2.1, 0, 0), (-2.1, 0, 0), (0, 2.1, 0), (0, -2.1, 0)], "SQP_d"),
        ([(2.1, 0, 0), (-2.1, 0, 0), (0, 2.1, 0), (0, -2.1, 0), (0, 0, 2.1), (0, 0, -2.1)], "OH_d"),
    ],
)
def test_ideal_shells(spark, points, label):
    assert shell_label(spark, points)["label"] == label


def test_elongated_octahedron_is_jahn_teller(spark):
    r = shell_label(spark, [(2.1, 0, 0), (-2.1, 0, 0), (0, 2.1, 0), (0, -2.1, 0), (0, 0, 2.5), (0, 0, -2.5)])
    assert r["JT"] and r["label"].startswith("OH")


def test_plane_equals_svd(spark):
    rng = np.random.default_rng(1)
    for n in (4, 5, 6):
        p = rng.normal(size=(n, 3))
        p = 2.4 * p / np.linalg.norm(p, axis=1)[:, None]
        r = shell_label(spark, p.tolist())
        _, size, axes = np.linalg.svd(p - p.mean(axis=0))
        assert r["RMS_plane"] == pytest.approx(size[-1] / math.sqrt(n), abs=1e-9)
        assert r["h_max"] == pytest.approx(np.abs((p - p.mean(axis=0)) @ axes[-1]).max(), abs=1e-7)


def test_donors_and_window_are_inclusive(spark):
    df = rows(spark, [("ZN", "ZN", 0, 0, 0), ("N", "N", 2.0, 0, 0), ("S", "S", 0, 2.8, 0), ("C", "C", 0, 0, 2.2), ("X", "", 0, 0, -2.2), ("O", "O", 2.81, 0, 0)])
    got = N.coordination(df.where("atom_name = 'ZN'").select(*A.STRUCTURE, "line_no", "serial", "x", "y", "z"), df)
    assert {r["atom_name"] for r in got.collect()} == {"N", "S", "X"}


def test_components_equal_closure(spark):
    random.seed(3)
    points = [(random.uniform(0, 20), random.uniform(0, 20), random.uniform(0, 20)) for _ in range(60)]
    df = rows(spark, [("ZN", "ZN", *p) for p in points])
    got = {r["line_no"]: r["root"] for r in C.components(df, 4.0).collect()}
    root = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                if sum((a - b) ** 2 for a, b in zip(points[i], points[j])) <= 16.0:
                    root[i] = root[j] = min(root[i], root[j])
    assert got == dict(enumerate(root))


def test_grid_join_equals_plain_join(spark):
    random.seed(4)
    df = rows(spark, [("ZN" if i % 9 == 0 else "C", "ZN", *(random.uniform(-9, 9) for _ in range(3))) for i in range(150)])
    c = df.where("atom_name = 'ZN'")
    pair = lambda d: {(r["c_line_no"], r["line_no"]) for r in d.collect()}
    assert pair(N.within(c, df, 3.0)) == pair(N.within(c, df, 3.0, cell=3.0))


def test_must_have_language():
    assert S.parse_must_have("ALL:N,S") == S.MustHave("all", ("N", "S"), ())
    assert S.parse_must_have("S>=2, N").min_counts == (("S", 2),)
    assert S.parse_must_have("S=4") == S.MustHave()
    assert str(S.parse_must_have("none")) == "none" and str(S.parse_must_have("S>=2")) == "S>=2"


def test_ligand_count_is_exact(spark):
    atoms = [dict(atom_name="ZN", element="ZN", x=0.0, y=0.0, z=0.0)]
    atoms += [dict(atom_name="SG", element="S", resname="CYS", record="ATOM", x=2.3 * math.cos(a), y=2.3 * math.sin(a), z=0.0) for a in (0, 2, 4)]
    atoms += [dict(atom_name="NE2", element="N", resname="HIS", record="ATOM", x=0.0, y=0.0, z=2.1), dict(atom_name="O", element="O", resname="HOH", x=0.0, y=0.0, z=-2.2)]
    df = rows(spark, atoms)
    c = df.where("atom_name = 'ZN'")
    shell = N.coordination(c.select(*A.STRUCTURE, "line_no", "serial", "x", "y", "z"), df)
    reason = lambda *q: S.verdicts(c, shell, ligands=q).first()["reason"]
    three, one = S.LigandRequirement(("CYS",), 3, ("SG",)), S.LigandRequirement(("HIS",), 1)
    assert reason(three, one) is None
    assert reason(S.LigandRequirement(("CYS",), 2, ("SG",))) == "ligand_requirements"
    assert reason(S.LigandRequirement((), 0)) == "ligand_requirements"
    d = S.ligand_diagnostics(shell, S.LigandRequirement(("CYS",), 3, ("SD",))).first()
    assert d["missing"] and d["naming_mismatch"]


def test_altloc_collapse_policies(spark):
    a = lambda alt, occ: dict(atom_name="CA", element="C", altloc=alt, occ=occ, resseq="1", x=0.0, y=0.0, z=0.0)
    df = rows(spark, [a("B", 0.6), a("C", 0.7), a("A", 0.1)])
    pick = lambda p: A.collapse_altloc(df, p).first()["altloc"]
    assert (pick("default"), pick("best_occupancy"), pick("first")) == ("A", "C", "B")


@pytest.mark.parametrize(
    ("center", "neighbour", "case", "labels"),
    [(["A", "B"], ["A", "B"], 1, {"A", "B"}), (["A", "B"], ["A"], 2, {"A", "B"}), ([""], ["A", "B"], 3, {"A", "B"}), ([""], [""], None, {None})],
)
def test_altloc_cases(spark, center, neighbour, case, labels):
    atoms = [dict(atom_name="ZN", element="ZN", altloc=x, resseq="1", x=0.0, y=0.0, z=0.0) for x in center]
    atoms += [dict(atom_name="N", element="N", altloc=x, resseq="2", x=2.1, y=0.0, z=0.0) for x in neighbour]
    raw = rows(spark, atoms)
    got = R.variants(R.selected(raw, S.SiteConfig()), S.SiteConfig()).collect()
    assert {r["altloc_case"] for r in got} == {case} and {r["altloc_label"] for r in got} == labels


def test_backbone_rule(spark):
    r = lambda name, seq, x: dict(atom_name=name, element=name[0], resname="CYS", resseq=seq, record="ATOM", x=x, y=0.0, z=0.0)
    df = rows(spark, [dict(atom_name="ZN", element="ZN", x=0.0, y=0.0, z=0.0), r("N", "1", 2.0), r("CA", "1", 3.5), r("N", "2", 8.0), r("CA", "2", 9.0)])
    kept = {(x["resseq"], x["atom_name"]) for x in N.backbone_filtered(df, "ZN").collect()}
    assert ("1", "N") in kept and ("2", "N") not in kept and ("2", "CA") in kept


PDB = """REMARK   2 RESOLUTION.    1.90 ANGSTROMS.
HELIX    1   1 GLY A   10  ALA A    4  1                                   6
SEQRES   1 A    3  GLY ALA CYS
MODEL
HETATM    1 ZN    ZN A 301      11.000  12.000  13.000  1.00 10.00          ZN
ENDMDL
MODEL        2
ATOM      x  N   CYS A  10       1.000   2.000   3.000                       N
ATOM      3  SG ACYS A  10       1.000   bad     3.000
ENDMDL
HETATM    9  O   HOH A 400       0.000   0.000   0.000
"""


def test_fixed_width_text(spark):
    lines = spark.createDataFrame([("s", i, l) for i, l in enumerate(PDB.split("\n"))], "structure_id string, line_no long, line string")
    got = pdb.parse_atoms(pdb.model_number(lines)).orderBy("line_no").collect()
    assert [(r["serial"], r["element"], r["model"], r["occ"], r["bfac"]) for r in got] == [(1, "ZN", 1, 1.0, 10.0), (0, "N", 2, 1.0, 0.0), (9, "O", 2, 1.0, 0.0)]
    assert pdb.resolution(lines).first()["resolution"] == 1.9
    assert [tuple(r)[1:] for r in pdb.secondary_ranges(lines).collect()] == [("A", "HELIX", 4, 10)]
    assert [r["resname"] for r in pdb.seqres(lines).orderBy("pos").collect()] == ["GLY", "ALA", "CYS"]
    blocks = pdb.model_blocks(lines).where(F.col("line").rlike("^(ATOM|HETATM)"))
    assert sorted((r["model"], r["line_no"]) for r in blocks.collect()) == [(1, 4), (2, 7), (2, 8)]


CIF = """data_1ABC
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.auth_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
HETATM 1 Zn ZN . ZN B . 301 1.0 2.0 3.0 1.00
ATOM 2 O "O5'" A DA A 1 7 1.5 ? 3.0 0.50
ATOM 3 N 'N 1' A DA A 1 7 1.5 2.5 3.5 0.50
#
_cell.length_a 10.0
"""


def test_mmcif(spark, tmp_path):
    (tmp_path / "1abc.cif").write_text(CIF)
    got = mmcif.read_mmcif(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["serial"], r["atom_name"], r["altloc"], r["resseq"], r["element"]) for r in got] == [(1, "ZN", "", ".", "ZN"), (3, "N 1", "A", "1", "N")]
    assert mmcif.atom_rows("x", CIF, auth_ids=True)[0]["resseq"] == "301"
    assert mmcif.atom_rows("x", "not a file") == []


def test_xyz_comments(spark):
    d = spark.createDataFrame([("RES=A RES=B word =x SEC=H K=",)], "c string")
    r = d.select(xyz.comment_map(F.col("c")).alias("m"), xyz.upsert(F.col("c"), "SEC", F.lit("E"), ("RES",)).alias("u")).first()
    assert r["m"] == {"RES": "B", "SEC": "H", "K": ""} and r["u"] == "word =x K= SEC=E"


def test_search_terms():
    s = catalog.Search("HEM", 1.2, "ALL", "protein")
    assert [t[0] for t in s.terms()] == ["component", "resolution", "polymer"] and '"logical_operator": "and"' in s.body()


def test_rotation_keeps_length(spark):
    v = spark.range(1).select(*[c.alias(n) for c, n in zip(G.rotated(tuple(map(F.lit, (1.0, 2.0, 3.0))), tuple(map(F.lit, (0.0, 0.0, 1.0))), 90.0), "xyz")]).first()
    assert tuple(v) == pytest.approx((-2.0, 1.0, 3.0))


def test_stream_keeps_latest(spark, tmp_path):
    from metalith.plans.state import latest
    from metalith.streaming.batches import latest_status

    for k in range(3):
        spark.createDataFrame([(i, k * 10 + i, f"s{k}") for i in range(k + 1)], "id long, seq long, status string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "id long, seq long, status string"
    q = latest_status(spark, str(tmp_path / "in"), schema, str(tmp_path / "ck"), str(tmp_path / "out"), "id", ["seq"])
    q.awaitTermination()
    got = latest(spark.read.parquet(str(tmp_path / "out")), "id", ["batch", "seq"]).orderBy("id").collect()
    assert [(r["id"], r["status"]) for r in got] == [(0, "s2"), (1, "s2"), (2, "s2")]


def test_fetch_falls_back_and_reports(spark):
    import gzip

    from metalith.sources.fetch import FetchError, fetch_entry

    def get(url):
        if url.endswith(".cif.gz"):
            return gzip.compress(b"data_x")
        raise FileNotFoundError(url)

    assert fetch_entry("1ABC", get, "http://host") == ("cif", "data_x")
    tries = []

    def broken(url):
        tries.append(url)
        raise OSError("down")

    with pytest.raises(FetchError):
        fetch_entry("1ABC", broken, "http://host", wait=lambda s: None)
    assert len(tries) == 9
    with pytest.raises(FetchError, match="not an entry id"):
        fetch_entry("abcd", get, "http://host")


def test_report_columns(spark, tmp_path):
    from metalith.operators import report
    from metalith.schema import CLUSTER_FIELDS

    df = rows(spark, [("ZN", "ZN", 0, 0, 0), ("N1", "N", 2.1, 0, 0), ("N2", "N", -2.1, 0, 0), ("FE", "FE", 0, 3, 0)])
    out = report.cluster_csv(df, S.SiteConfig(cutoff=5.0))
    assert tuple(out.columns) == CLUSTER_FIELDS
    r = out.first()
    assert (r["GEOM"], r["COORD"], r["OTHER_METALS"], r["CLUSTER_TYPE"], r["RESOLUTION_A"]) == ("LIN", "2N", "FE:1", "multi_hetero", "NA")
    report.write_csv(out, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 1


def test_places_number_every_row(spark):
    from metalith.plans.graph_queries import places

    rng = random.Random(3)
    data = [(i, rng.choice([None, 0.0, -1.5, float(rng.randint(0, 40))]), rng.choice([None, "a", "b"])) for i in range(3000)]
    df = spark.createDataFrame(data, "i long, v double, s string").repartition(7)
    order = sorted(data, key=lambda r: (r[1] is None, r[1] or 0.0, r[2] is None, r[2] or "", r[0]))
    assert {r["i"]: r["place"] for r in places(df, "v", "s", "i").collect()} == {r[0]: k for k, r in enumerate(order, 1)}
    assert places(df.limit(0), "v", "s", "i").count() == 0


def test_volume_order_has_all_customers(spark):
    from metalith.plans import registry

    from .conftest import DATA

    n = spark.read.parquet(f"{DATA}/customer.parquet").count()
    assert n > 50 and sorted(r["place"] for r in registry.QUERIES["volume_order"](spark, DATA).collect()) == list(range(1, n + 1))


def test_markdown_cells_are_whole(spark, tmp_path):
    from metalith.plans import registry

    texts = ["a|b" * 200, "|", "", None, "x" * 250 + "|"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["cell"] for r in registry.QUERIES["markdown_escape"](spark, str(tmp_path)).collect()}
    assert got == {i: t if t is None else t.replace("|", "\\|") for i, t in enumerate(texts)}


def test_greedy_match_equals_plain_loop(spark):
    from metalith.operators.graph import greedy_match

    rng = random.Random(5)
    place = lambda: tuple(float(rng.randint(0, 6)) for _ in range(3))
    a = [(g, i, *place()) for g in ("u", "v", "w") for i in range(40)]
    b = [(g, i, *place()) for g in ("u", "v", "x") for i in range(30)]
    want = set()
    for g in "uvwx":
        free = {r[1]: r[2:] for r in b if r[0] == g}
        for _, i, *p in [r for r in a if r[0] == g]:
            near = min(((sum((s - t) ** 2 for s, t in zip(p, q, strict=True)), k) for k, q in free.items()), default=(9.0, 0))
            if near[0] <= 4.0:
                want.add((g, i, near[1], round(math.sqrt(near[0]), 9)))
                del free[near[1]]
    side = lambda rows, p: spark.createDataFrame(rows, f"g string, {p}id long, {p}x double, {p}y double, {p}z double").repartition(3)
    got = greedy_match(side(a, "a_"), side(b, "b_"), ["g"], 2.0).collect()
    assert len(want) > 40 and len(got) == len(want) and {(r["g"], r["a_id"], r["b_id"], round(r["d"], 9)) for r in got} == want


def test_spectrum_transform_equals_plain_sums(spark):
    import cmath

    from metalith.operators.spectra import transform_to_r

    step, size, kmin, kmax, dk = 0.1, 256, 3.0, 9.0, 2.0
    traces = {s: [(0.37 * i, math.sin(2 * (s + 1) * 0.37 * i) / (1 + i)) for i in range(1, 40)] for s in range(3)}
    df = spark.createDataFrame([(s, k, v) for s, t in traces.items() for k, v in t], "s long, k double, chi double").repartition(4)
    got = {(r["s"], round(r["r"], 6)): r for r in transform_to_r(df, "s", "k", "chi", kmin, kmax, dk, 2, step, 4.0, size).collect()}

    def bessel(x):
        return sum((x / 2) ** (2 * m) / math.factorial(m) ** 2 for m in range(40))

    def chi(t, k):
        for (a, u), (b, v) in zip(t, t[1:], strict=False):
            if a <= k <= b:
                return u + (v - u) * (k - a) / (b - a)
        return 0.0

    lo, hi, seen = kmin - dk / 2, kmax + dk / 2, 0
    for s, t in traces.items():
        f = []
        for j in range(size):
            k = j * step
            at = (k - (lo + hi) / 2) / ((hi - lo) / 2)
            f.append(chi(t, k) * k**2 * bessel(dk * math.sqrt(max(0.0, 1 - at * at))) / bessel(dk) if lo <= k <= hi else 0.0)
        for n in range(size // 2):
            r = math.pi * n / (step * size)
            if r <= 4.0:
                z = sum(v * cmath.exp(-2j * math.pi * j * n / size) for j, v in enumerate(f)) * step / math.sqrt(math.pi)
                row, seen = got[s, round(r, 6)], seen + 1
                assert abs(complex(row["re"], row["im"]) - z) < 1e-9 and abs(row["mag"] - abs(z)) < 1e-9
    assert seen == len(got)


def test_both_formats_load_as_one(spark, tmp_path):
    from metalith.schema import ATOM
    from metalith.sources.structures import load_atoms

    atom = lambda n, x: f"HETATM{n:5d} ZN    ZN A{n:4d}    {x:8.3f}{0:8.3f}{0:8.3f}  1.00  5.00          ZN"
    (tmp_path / "1abc.cif").write_text(CIF)
    (tmp_path / "2abc.txt").write_text(CIF)
    (tmp_path / "3abc.pdb").write_text("\n".join([atom(1, 0.5), "MODEL        1", atom(2, 1.0), "ENDMDL", "MODEL        2", atom(3, 2.0), "ENDMDL", ""]))
    (tmp_path / "4abc.pdb").write_text("\n".join(["MODEL        2", atom(4, 1.0), "ENDMDL", "MODEL        1", atom(5, 1.0), "ENDMDL"]))
    (tmp_path / "5abc.pdb").write_text("")
    serials = lambda df: sorted((r["structure_id"], r["serial"]) for r in df.collect())
    cif = [(s, n) for s in ("1abc", "2abc") for n in (1, 3)]
    every = load_atoms(spark, str(tmp_path))
    assert every.columns == ATOM.fieldNames()
    assert serials(every) == cif + [("3abc", 1), ("3abc", 2), ("3abc", 3), ("4abc", 4), ("4abc", 5)]
    assert serials(load_atoms(spark, str(tmp_path), first_model_only=True)) == cif + [("3abc", 1), ("3abc", 2)]


def test_tagged_rows_and_first_shell(spark):
    from metalith.operators.spectra import value_summary

    text = ["3", "title", "N 0 0 1 # dw=0.004 q=1", "S 0 0 2 # q=1", "C 0 0 x # dw=1", "ZN 0 0 0", "N 0 1 0 # DW = 1e-3"]
    lines = spark.createDataFrame([("a", i, t) for i, t in enumerate(text)], "source string, line_no long, line string")
    assert [(r["element"], r["z"], r["dw"]) for r in xyz.dw_tagged(lines).orderBy("line_no").collect()] == [("N", 1.0, 0.004), ("N", 0.0, 0.001)]
    rows = ["group symbol x y z distance sig2 i", "NEAREST N 0 0 0 2.0 0.004 1", "nearest S 0 0 0 3.0 0.006 2", "far C 0 0 0 9.0 0.1 3"]
    dw = spark.createDataFrame([("a", i, t) for i, t in enumerate(rows)], "source string, line_no long, line string")
    got = value_summary(xyz.nearest_rows(xyz.parse_dw(dw)), "source", "distance").collect()
    assert [(r["source"], r["n"], r["mean"], round(r["std"], 9)) for r in got] == [("a", 2, 2.5, 0.5)]


def test_preferred_altloc(spark):
    from metalith.operators.report import preferred_altloc

    names = spark.createDataFrame([("a_cluster1.xyz", "1abc", "1"), ("b_cluster2.xyz", "1abc", "2"), ("c_cluster3.xyz", "1abc", "3"), ("d_cluster4.xyz", "2abc", "4")], "xyz_name string, pdb_id string, cluster_id string")
    clusters = spark.createDataFrame([(0, "x/a_cluster1.xyz", ""), (1, "x/a_cluster1.xyz", "b"), (2, "y/a_cluster1.xyz", "A"), (3, None, "C")], "n int, XYZ_PATH string, ALTLOC string")
    altlocs = spark.createDataFrame([("1ABC", 1, "C"), ("1abc", 2, "d"), ("1abc", 2, "D"), ("1abc", 3, "A"), ("1abc", 3, "B"), (None, 4, "A")], "pdb_id string, cluster_id int, altloc string")
    got = {r["xyz_name"][0]: r["altloc"] for r in preferred_altloc(names, clusters, altlocs, "n").collect()}
    assert got == {"a": "B", "b": "D", "c": "", "d": ""}
