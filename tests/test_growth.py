"""Steps whose work must grow with the input alone: copies, candidates and results against plain loops."""

from __future__ import annotations

import random

from metalith.operators import graph as R
from metalith.operators import neighbors as N

ATOM = "structure_id string, model int, line_no long, element string, x double, y double, z double"


def _atoms(spark, n, side, seed=1):
    rng = random.Random(seed)
    rows = [(s, 1, i, rng.choice("CNOS"), *(round(rng.uniform(-side, side), 2) for _ in range(3))) for s in "ab" for i in range(n)]
    return rows, spark.createDataFrame(rows, ATOM).repartition(3)


def test_pairs_need_few_copies_and_lose_none(spark):
    rows, df = _atoms(spark, 150, 9.0)
    # corners of blocks, at zero and below, and two atoms of one place
    rows += [("c", 1, 0, "C", 0.0, 0.0, 0.0), ("c", 1, 1, "C", -1.0, 0.0, -1.0), ("c", 1, 2, "C", 8.0, 8.0, 8.0), ("c", 1, 3, "C", 7.0, 9.0, 7.5), ("c", 1, 4, "C", 8.0, 8.0, 8.0)]
    df = spark.createDataFrame(rows, ATOM).repartition(3)
    want = {(p[0], p[2], q[2]) for p in rows for q in rows if p[0] == q[0] and p[2] < q[2] and sum((s - t) ** 2 for s, t in zip(p[4:], q[4:], strict=True)) <= 4.0}
    got = [(r["structure_id"], r["a_line_no"], r["b_line_no"]) for r in N._pairs(df, 2.0).collect()]
    assert len(want) > 100 and len(got) == len(want) and set(got) == want
    assert N._copies(df, 2.0).count() < 4 * len(rows)


def test_edges_both_ways_read_the_edges_once(spark):
    edges = spark.createDataFrame([("a", 1, 1, 2), ("a", 1, 2, 3)], "structure_id string, model int, i long, j long")
    both = R.both_ways(edges)
    assert sorted((r["i"], r["j"]) for r in both.collect()) == [(1, 2), (2, 1), (2, 3), (3, 2)]
    assert "Union" not in both._jdf.queryExecution().optimizedPlan().toString()


def test_greedy_match_of_large_group_and_odd_places(spark):
    nan = float("nan")
    a = [(None, 1, 0.0, 0.0, 0.0), ("g", 1, 0.0, 0.0, 0.0), ("g", 2, 0.5, 0.0, 0.0), ("g", 3, nan, 0.0, 0.0), ("g", 4, 0.0, None, 0.0)]
    b = [(None, 9, 1.0, 0.0, 0.0), ("g", 7, nan, 0.0, 0.0), ("g", 8, 2.0, 0.0, 0.0), ("g", 9, -2.0, 0.0, 0.0)]
    side = lambda rows, p: spark.createDataFrame(rows, f"g string, {p}id long, {p}x double, {p}y double, {p}z double")
    got = R.greedy_match(side(a, "a_"), side(b, "b_"), ["g"], 2.0)
    # a place that is no number takes nobody's match away; ties go to the smaller id
    assert {(r["g"], r["a_id"], r["b_id"], r["d"]) for r in got.collect()} == {(None, 1, 9, 1.0), ("g", 1, 8, 2.0)}
    # one group of a line of atoms: candidates are neighbours, not all pairs
    line = spark.range(30000).selectExpr("'h' g", "id a_id", "id * 3D a_x", "0D a_y", "0D a_z")
    other = line.selectExpr("g", "a_id b_id", "a_x + 1 b_x", "a_y b_y", "a_z b_z")
    assert R.greedy_match(line, other, ["g"], 2.0).where("a_id = b_id").count() == 30000


def test_collapse_carries_its_keys_once(spark):
    from metalith.operators import atoms as A

    rows = [("a", 1, i, "A", "5", "", "CA", alt, 0.5) for i, alt in ((3, "B"), (1, "C"), (2, "A"))]
    df = spark.createDataFrame(rows, "structure_id string, model int, line_no long, chain string, resseq string, icode string, atom_name string, altloc string, occ double")
    out = A.collapse_altloc(df)
    assert out.columns == [*df.columns, "group_ord"]
    assert [tuple(r) for r in out.collect()] == [(*rows[2], 1)]
    assert "chain, chain#" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_letters_and_words_are_learned_from_all_texts(spark):
    from metalith.llm import secrets

    # one text in 3,000 holds the rare word three times; no sample of texts may miss it
    docs = spark.range(9000).selectExpr("CASE WHEN id = 17 THEN 'qzqzqz qzqzqz qzqzqz' ELSE concat('plain text ', id) END AS text").repartition(3)
    language = secrets.learn(docs)
    assert "qzqzqz" in language.words and "plain" in language.words
    letters = " abcdefghijklmnopqrstuvwxyz"
    assert ord(language.table[27 * letters.index("q") + letters.index("z")]) > 45


def test_sets_of_a_site_meet_their_structure_once(spark):
    from pyspark.sql import functions as F

    from metalith.operators import xyz_sets
    from metalith.scratch import stored
    from metalith.sources.derived import atoms

    raw = stored(atoms(spark, "/root/testdata/sf0.001"), "raw")
    sets = xyz_sets.annotated_sets(stored(xyz_sets.bases(raw), "bases"), raw)
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    # no row per site and atom is joined or gathered: the sites meet one row per structure
    assert plan.count("Join ") == 1 and plan.count("Aggregate [") == 2
    values = [0.0, -0.0, 1e-9, -4e-7, 0.0000005, 1.0000005, -2.0000015, 12.3456785, 998.9999996, 999.9999996, -99999.5, 1234567.1]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for got, want in df.select(xyz_sets._fixed(F.col("v"), 6), F.format_string("%.6f", "v")).collect():
        assert got == want


def test_kept_sites_and_their_sets_need_one_shuffle_of_lines(spark):
    from pyspark.sql import functions as F

    from metalith.operators import xyz_sets
    from metalith.plans import registry
    from metalith.scratch import stored
    from metalith.sources.derived import atoms

    out = registry.QUERIES["annotated_sets"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # the lines' own grouping and that by structure; no site, metal or place is joined, and no table is read but lineitem
    assert plan.count("Join ") == 0 and plan.count("Aggregate [") == 2
    assert [f for f in out.inputFiles() if not f.endswith("/lineitem.parquet")] == []
    raw = stored(atoms(spark, "/root/testdata/sf0.001"), "raw")
    apart = xyz_sets.annotated_sets(stored(xyz_sets.bases(raw), "bases"), raw).select("name", "set", "n", F.md5("xyz_text").alias("text_md5"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, apart.collect())) and apart.count() > 500


def test_sites_of_one_row_are_those_of_joins(spark):
    from metalith.operators import record
    from metalith.operators.sites import SiteConfig

    rng = random.Random(4)
    line = lambda s, i: (s, 1 if s != "c" else None, i, i % 40, "HETATM", *rng.choice((("ZN", "ZN"), ("FE", "FE"), ("ZN", "FE"), ("N", "N"))), rng.choice(["", "A", "B"]), "LIG", "A", str(rng.randrange(25)), "", *(rng.choice([None, 1.0]) if rng.random() < 0.05 else round(rng.uniform(0, 16), 2) for _ in range(3)), rng.random(), 1.0)
    ddl = "structure_id string, model int, line_no long, serial int, record string, element string, atom_name string, altloc string, resname string, chain string, resseq string, icode string, x double, y double, z double, occ double, bfac double"
    raw = spark.createDataFrame([line(s, i) for s in "abc" for i in range(60)], ddl).repartition(3)
    cols = ["structure_id", "root", "cluster_number", "cluster_type", "n_metals", "center", "c_alts", "siblings", "near"]
    rows = lambda df: sorted(((*(r[c] for c in cols), *(None if r[k] is None else round(r[k], 9) for k in ("cx", "cy", "cz"))) for r in df.collect()), key=lambda r: (r[0], r[5]["line_no"]))
    got, want = rows(record.selected_in(record.with_places(record.structures(raw)), SiteConfig(cutoff=4.0))), rows(record.selected(raw, SiteConfig(cutoff=4.0)))
    assert got == want and len(want) > 15 and max(r[4] for r in want) > 2 and {r[0] for r in want} == {"a", "b"}


def test_targets_meet_their_structure_once(spark):
    from metalith.operators import record
    from metalith.operators.sites import SiteConfig
    from metalith.sources.derived import atoms

    raw = atoms(spark, "/root/testdata/sf0.001")
    selected = record.selected(raw, SiteConfig())
    plan = selected._jdf.queryExecution().optimizedPlan().toString()
    # joins of a few metals each, then one with a row per structure; a place of one line is carried once
    assert plan.count("Join ") == 3 and plan.count("LeftSemi") == 0
    place = record.places(raw)
    assert place.where("alts is not null and size(alts) = 0").count() == 0 < place.where("alts is null").count() < place.count()


def test_means_do_not_depend_on_the_order_of_rows(spark):
    from metalith.operators import bfactor

    # 57.54 / 64 ends in a 5 behind six digits: a sum in another order may fall short of it
    values = [0.01, 0.29, 0.57, 3.14, 20.03, 8.2, 25.3] + [0.0] * 57
    df = spark.createDataFrame([("g", v) for v in sorted(values)] + [("h", v) for v in sorted(values, reverse=True)] + [("n", float("nan")), ("e", None)], "g string, bfac double").coalesce(1)
    got = {r["g"]: r["mean"] for r in bfactor.group_stats(df, ["g"]).collect()}
    assert got["g"] == got["h"] == 57.54 / 64 and got["n"] != got["n"] and got["e"] == -1.0


def test_nearest_meet_one_row_per_structure(spark):
    rows, df = _atoms(spark, 60, 5.0)
    centers = df.where("line_no < 5")
    out = R.closest(df, centers, 3)
    want = {(c[0], c[2], k + 1, a[2]) for c in rows if c[2] < 5 for k, a in enumerate(sorted((a for a in rows if a[0] == c[0] and a[2] != c[2] and a[3] in "NS"), key=lambda a: (sum((s - t) ** 2 for s, t in zip(a[4:], c[4:], strict=True)), a[2]))[:3])}
    assert {(r["structure_id"], r["c_line_no"], r["rank"], r["line_no"]) for r in out.collect()} == want
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_coordinators_meet_their_bonds_twice(spark):
    from metalith.operators import coordinators as C

    rows = [("a", 1, i, e, float(x), float(y), 0.0) for i, (e, x, y) in enumerate([("ZN", 0, 0), ("S", 2.3, 0), ("C", 3.9, 0), ("C", 5.4, 0), ("N", 0, 9)])]
    out = C.coordinators(spark.createDataFrame(rows, ATOM))
    assert sorted((r["resname"], r["atom_name"], r["line_no"]) for r in out.collect()) == [("CYS", "CA", 3), ("CYS", "CB", 2), ("CYS", "SG", 1), ("ZN", "ZN", 0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_verdicts_collapse_the_atoms_once(spark):
    from metalith.plans import registry

    for name in ("must_have_min", "rejection_counts"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan  # the query starts from stored atoms


def test_paths_of_many_sources_are_aligned_at_once(spark):
    flat = [(s, i, "A", str(i), kind, name, x + 0.1 * s * i, y, z) for s in range(40) for i, kind in enumerate(("CYS", "HIS", "HIS", "CYS")[: 1 + (s + 3) % 4]) for name, x, y, z in ((("SG", 2.0 + i, 0.0, 0.5), ("CB", 3.0, 1.0 + i, 0.0)) if kind == "CYS" else (("ND1", 0.0, 2.0 + i, 1.0), ("CG", 1.0, 3.0, 1.0)))]
    df = spark.createDataFrame(flat, "source int, line_no int, chain string, resseq string, resname string, atom_name string, x double, y double, z double").withColumn("source", R.F.col("source").cast("string"))
    out = R.aligned_paths(R.coordinating(df), "0")
    # no Python call for each source: the planner hands batches of sources on
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.collect()
    assert {s: sorted(r["against"] for r in got if r["source"] == str(s)) for s in range(40)} == {s: list(range(1 + (s + 3) % 4)) for s in range(40)}
    # a turn keeps lengths, also where a source has fewer residues than the reference
    for r in got:
        own = {f[5]: sum(v * v for v in f[6:]) for f in flat if str(f[0]) == r["source"] and f[3] == r["resseq"]}
        assert all(abs(sum(v * v for v in p) - own[n]) < 1e-9 for n, p in zip(r["names"], r["places"], strict=True))


def test_near_copies_shuffle_sets_and_prefixes_once(spark, monkeypatch):
    import re

    from metalith.llm import jaccard
    from metalith.llm.common import Scratch

    plans, put = {}, Scratch.put

    def logged(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return put(self, df, name)

    rng = random.Random(2)
    texts = [[rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(60)] for _ in range(12)]
    near = [[*t[:i], "new", *t[i + 1 :]] for t in texts for i in (5, 30)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts + near)], "doc_id long, text string")
    monkeypatch.setattr(Scratch, "put", logged)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(r["doc_id"] for r in jaccard.one_of_each(docs).collect()) == list(range(12))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # of tables that may not be broadcast: the sets are dealt by signature alone, their classes come to them
    assert len(re.findall(r"Exchange hashpartitioning\(sig#", plans["sets"])) == 2 and "Exchange hashpartitioning(cid#" not in plans["sets"]
    # prefixes go out by token once, with their class and group alone; the few classes in groups come to them
    assert "BroadcastHashJoin [cid#" in plans["queries"] and "comp#" not in plans["queries"].split("Window [")[1].split("Generate")[0]


def test_a_rendered_line_is_made_once(spark):
    from metalith.plans import registry
    from metalith.sources import pdb

    plan = registry.QUERIES["fixed_width_parse"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("format_string(") == 1  # else each filter on a parsed column makes the text again
    short = spark.createDataFrame([("a", 1, "ATOM      1  CA  GLY A   1       1.000   2.000   3.000"), ("a", 2, "HETATM"), ("a", 3, None)], "structure_id string, line_no long, line string")
    got = pdb.parse_atoms(short).collect()
    assert [(r["serial"], r["z"], r["occ"], r["bfac"], r["element"], r["charge"]) for r in got] == [(1, 3.0, 1.0, 0.0, "C", "")]


def test_a_comment_is_split_once_and_atoms_are_dealt_once(spark):
    from pyspark.sql import functions as F

    from metalith.plans import registry
    from metalith.sources import xyz

    query = registry.QUERIES["xyz_round_trip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    # lines to atoms, then atoms by structure for the collapse and the texts
    assert query.executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 2
    # a text into lines, a line into words, a comment into words
    assert query.optimizedPlan().toString().count("split(") <= 4
    df = spark.createDataFrame([("A=1 B=2\tA=3  word =x C= B=4=5",), ("",), (None,), ("A=1\x0bB=2",)], "c string")
    got = [r["m"] for r in df.select(xyz.comment_map(F.col("c")).alias("m")).collect()]
    assert got == [{"A": "3", "C": "", "B": "4=5"}, {}, None, {"A": "1", "B": "2"}]
