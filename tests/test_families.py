"""File names, metadata and site strings on small rows, against plain Python or by hand."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from metalith.operators import families as Y
from metalith.operators import report
from metalith.sources import metadata as M
from metalith.sources import names

STEMS = [
    "fam-1ab2-cluster3-h-only", "fam-1ab2-w-n", "1ab2", "fam-XXXX-H-Only-W-N", "fam-x-w-n_w_dw", "xxxx", "", "-", "a-0CHL-Cluster12", "chls-2abc-3def-cluster1",
    "fam-h-only", "fam-1ab2-clusterx-rest", None,
]


def plain_parts(stem):
    if stem is None:
        return None
    base = stem.removesuffix("_w_dw")
    tokens = [t for t in base.split("-") if t and t.lower() != "xxxx"]
    if not tokens:
        return base, None, None, ""
    for n, t in enumerate(tokens):
        if re.fullmatch("[0-9][A-Za-z0-9]{3}", t):
            c = re.fullmatch("(?i)cluster([0-9]+)", tokens[n + 1]) if n + 1 < len(tokens) else None
            end = n + (2 if c else 1)
            return "-".join(tokens[:end]), t.lower(), c and c[1], "-".join(tokens[end:])
    whole = "-".join(tokens)
    m = re.search("(?i)-(h-only-w-n|h-only|w-n)$", whole)
    return (whole[: m.start()], None, None, m[1]) if m else (whole, None, None, "")


def test_stem_parts_equal_plain_python(spark):
    df = spark.createDataFrame([(s,) for s in STEMS], "stem string")
    for r in df.select("stem", names.stem_parts(F.col("stem")).alias("p")).collect():
        assert (tuple(r["p"]) if r["p"] is not None else None) == plain_parts(r["stem"]), r["stem"]


def test_suffix_key_orders_variants(spark):
    df = spark.createDataFrame([("w-n",), ("",), ("H-only-w-n",), (None,), ("a",)], "s string")
    assert [r["s"] for r in df.orderBy(names.suffix_key(F.col("s")), "s").collect()] == ["H-only-w-n", None, "", "a", "w-n"]


def test_resolved_means_first_pattern_path_and_name(spark):
    files = spark.createDataFrame([(p,) for p in ("d/1ab2_a.xyz", "d/1ab2_b.XYZ", "e/1ab2_a.xyz", "d/1ab2.pdb", "d/z(1).xyz", "d/z(1).xyz")], "path string")
    args = spark.createDataFrame([(a,) for a in (None, "1ab2*", "e/1ab2*", "d/1ab2_a.xyz", "z(1).xyz", "1ab?_[!b].xyz", "none", "1ab2.pdb")], "argument string")
    got = {}
    for r in names.resolved(files, args).collect():
        got.setdefault(r["argument"], []).append(r["path"])
    assert {k: sorted(v) for k, v in got.items()} == {
        None: ["d/1ab2_a.xyz"], "1ab2*": ["d/1ab2_a.xyz", "d/1ab2_b.XYZ", "e/1ab2_a.xyz"], "e/1ab2*": ["e/1ab2_a.xyz"], "d/1ab2_a.xyz": ["d/1ab2_a.xyz"],
        "z(1).xyz": ["d/z(1).xyz"], "1ab?_[!b].xyz": ["d/1ab2_a.xyz", "e/1ab2_a.xyz"],
    }
    assert names.resolved(files.limit(0), args).count() == 0


ANSWER = """{"struct": {"title": " A | b "}, "struct_keywords": {"pdbx_keywords": null}, "rcsb_accession_info": {"deposit_date": "2001-02-03T00:00:00Z"},
  "polymer_entities": [{"rcsb_entity_source_organism": [{"ncbi_scientific_name": "Homo"}, {"ncbi_scientific_name": ""}, {}]}, {"rcsb_entity_source_organism": null},
  {"rcsb_entity_source_organism": [{"ncbi_scientific_name": "Mus"}, {"ncbi_scientific_name": "Homo"}]}]}"""


def test_metadata_and_notes(spark):
    answers = spark.createDataFrame([("1ab2", ANSWER), ("2ab2", "{}"), ("3ab2", '{"struct": {"title": "cut'), ("4ab2", None)], "entry_id string, answer string")
    meta = M.entry_metadata(answers, "answer")
    rows = {r[0]: tuple(r)[1:] for r in meta.collect()}
    assert rows == {"1ab2": ("A | b", "N/A", "Homo; Mus", "2001-02-03"), "2ab2": ("N/A",) * 4, "3ab2": (None,) * 4, "4ab2": (None,) * 4}
    texts = spark.createDataFrame([(1, "see `1AB2_x.xyz`, `9zzz_y.xyz` and `2ab2_z.xyz`\n`1ab2.xyz`"), (2, "none"), (3, None), (4, "")], "id long, text string")
    got = {r["id"]: r["text"] for r in M.annotated(texts, "id", "text", meta).collect()}
    assert got[1] == (
        "see `1AB2_x.xyz` — **A \\| b**; Classification: N/A; Organism: Homo; Mus; Deposited: 2001-02-03, `9zzz_y.xyz`" + M.UNKNOWN
        + " and `2ab2_z.xyz` — **N/A**; Classification: N/A; Organism: N/A; Deposited: N/A\n`1ab2.xyz`"
    )
    assert (got[2], got[3], got[4]) == ("none", None, "")


def test_site_strings_and_report(spark):
    rows = [
        (1, "A", 5, "CYS", "CA", 1, "HELIX"), (1, "A", 8, "HIS", "CA", 2, "loop"), (1, "A", 8, "GLY", "CA", 3, "SHEET"), (1, "A", None, "CYS", "CA", 4, None), (1, "A", 9, "CYS", "SG", 5, None),
        (2, " ", 5, "CYS", "CA", 6, None), (2, "B", 1, "ASP", "CA", 7, "S"), (2, "B", 2, "CYS", "CA", 8, "H"), (3, "A", 2, "CYS", "CA", 9, "H"), (3, "A", 5, "HIS", "CA", 10, "L"),
    ]
    df = spark.createDataFrame(rows, "site long, chain string, resi long, resname string, atom_name string, line_no long, sec string")
    got = Y.site_strings(df, ["site"])
    assert {r["site"]: (r["sequence"], r["secstruct"]) for r in got.collect()} == {1: ("Cx2H", "HL"), 2: ("(AC)(C)", "(SH)(?)"), 3: ("Cx2H", "HL")}
    assert {r["line"] for r in Y.sequence_report(got).collect()} == {"Cx2H 2 HL:2", "(AC)(C) 1 (SH)(?):1"}
    assert Y.site_strings(df.limit(0), ["site"]).count() == 0


def test_sinks_can_be_read_back(spark, tmp_path):
    texts = spark.createDataFrame([("1ab2", "2\nh\nZN 0 0 0\nS 1 0 0\n"), ("2ab2", "1\nh\nFE 0 0 0\n")], "structure_id string, xyz_text string")
    report.write_xyz(texts, str(tmp_path / "xyz"))
    back = spark.read.text(str(tmp_path / "xyz"), wholetext=True)
    assert {(r["structure_id"], r["value"].strip()) for r in back.collect()} == {(a, t.strip()) for a, t in texts.collect()}
    report.write_json(texts, str(tmp_path / "json"))
    report.write_json(texts, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).select(*texts.columns).exceptAll(texts).exceptAll(texts).count() == 0


def test_consistency_of_families(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0 + 1e-13), ("b", 1.0), ("b", 2.0), ("b", None), ("c", None)], "f string, v double")
    assert {r["f"]: (r["n"], r["same"]) for r in Y.consistency(df, ["f"], "v").collect()} == {"a": (2, True), "b": (2, False)}
