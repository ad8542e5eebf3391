"""Queries on residues, texts, B-factors, spectra, state and search, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from metalith.functions import geometry as G
from metalith.operators import atoms as A
from metalith.operators import bfactor as B
from metalith.operators import residues as R
from metalith.operators import spectra as P
from metalith.plans import state
from metalith.sources import catalog, pdb, xyz
from metalith.sources.derived import ATOMS_SQL, atoms

from .site_queries import _PARTS, KEY, _base

QUERIES, ORACLES = {}, {}
BY = ["site"]

_NEAR = "(a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) + (a.z - c.z) * (a.z - c.z)"
_CTE = {k: _PARTS[k] for k in ("atoms", "col", "metals")} | {
    "ar": f"""SELECT c.line_no AS site, a.line_no, a.resname, a.chain, a.resseq, a.resi, a.atom_name, a.element, a.bfac, a.x - c.x AS x, a.y - c.y AS y, a.z - c.z AS z
        FROM metals c JOIN col a ON a.structure_id = c.structure_id AND a.line_no <> c.line_no AND {_NEAR} <= 64.0e0 WHERE c.atom_name = 'ZN'""",
    "fa": "SELECT *, x * x + y * y + z * z AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY site, chain, resseq, atom_name ORDER BY line_no) AS k FROM ar) WHERE k = 1",
    "cys": """SELECT g.*, row_number() OVER (PARTITION BY site ORDER BY sg.d2, chain, resseq) AS rk FROM (SELECT site, chain, resseq,
        max(CASE WHEN atom_name = 'SG' THEN {'x': x, 'y': y, 'z': z, 'd2': d2} END) AS sg, max(CASE WHEN atom_name = 'CB' THEN {'x': x, 'y': y, 'z': z, 'd2': d2} END) AS cb,
        max(CASE WHEN atom_name = 'CA' THEN {'x': x, 'y': y, 'z': z, 'd2': d2} END) AS ca FROM fa WHERE resname = 'CYS' GROUP BY site, chain, resseq) g WHERE sg IS NOT NULL""",
    "h0": """SELECT site, chain, resseq, max(CASE WHEN atom_name = 'ND1' THEN {'x': x, 'y': y, 'z': z, 'd2': d2} END) AS nd, max(CASE WHEN atom_name = 'NE2' THEN {'x': x, 'y': y, 'z': z, 'd2': d2} END) AS ne,
        max(CASE WHEN atom_name = 'CG' THEN {'x': x, 'y': y, 'z': z, 'd2': d2} END) AS cg, max(CASE WHEN atom_name = 'CB' THEN {'x': x, 'y': y, 'z': z, 'd2': d2} END) AS cb,
        max(CASE WHEN atom_name = 'CA' THEN {'x': x, 'y': y, 'z': z, 'd2': d2} END) AS ca FROM fa WHERE resname = 'HIS' GROUP BY site, chain, resseq""",
    "his": """SELECT h.*, row_number() OVER (PARTITION BY site ORDER BY n.d2, chain, resseq) AS rk FROM (SELECT *, CASE WHEN ne IS NULL OR nd.d2 <= ne.d2 THEN nd ELSE ne END AS n,
        CASE WHEN ne IS NULL OR nd.d2 <= ne.d2 THEN 'ND1' ELSE 'NE2' END AS n_name FROM h0 WHERE nd IS NOT NULL OR ne IS NOT NULL) h""",
    "lig": """SELECT *, row_number() OVER (PARTITION BY site ORDER BY q, chain, resseq) AS rk FROM (
        SELECT site, chain, resseq, 'CYS' AS kind, sg.d2 AS q, ca FROM cys UNION ALL SELECT site, chain, resseq, n_name, n.d2, ca FROM his) WHERE ca IS NOT NULL""",
}


def sql(body: str, last: str = "lig") -> str:
    names = list(_CTE)[: list(_CTE).index(last) + 1]
    return "WITH " + ", ".join(f"{n} AS ({_CTE[n]})" for n in names) + " " + body


def query(name: str, oracle: str | None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def _around(spark, d):
    _, col, metals = _base(spark, d)
    return R.around(metals.where("atom_name = 'ZN'"), col, KEY, 8.0)


def _dist(a: str, b: str) -> str:
    return f"sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y) + ({a}.z - {b}.z) * ({a}.z - {b}.z))"


def _rounded(df, keys, values, n=6):
    return df.select(*keys, *[(F.round(v, n) + 0.0).alias(v) for v in values])


@query("nearest_sg_distances", sql("SELECT site, chain, resseq, round(sqrt(sg.d2), 6) + 0e0 AS d_sg, round(sqrt(cb.d2), 6) + 0e0 AS d_cb, round(sqrt(ca.d2), 6) + 0e0 AS d_ca, "
       f"round({_dist('sg', 'ca')}, 6) + 0e0 AS sg_ca, round({_dist('cb', 'ca')}, 6) + 0e0 AS cb_ca, round({_dist('sg', 'cb')}, 6) + 0e0 AS sg_cb FROM cys WHERE rk <= 4", "cys"))
def nearest_sg_distances(spark, d):
    return _rounded(R.cys_distances(_around(spark, d), BY), ["site", "chain", "resseq"], ["d_sg", "d_cb", "d_ca", "sg_ca", "cb_ca", "sg_cb"])


@query("his_nearest_n", sql("SELECT site, chain, resseq, n_name, round(sqrt(n.d2), 6) + 0e0 AS d_n FROM his WHERE rk <= 4", "his"))
def his_nearest_n(spark, d):
    return _rounded(R.his_distances(_around(spark, d), BY), ["site", "chain", "resseq", "n_name"], ["d_n"])


def _ang(u: str, v: str) -> str:
    """Angle of two 3-vectors given as comma-separated SQL terms."""
    a, b = u.split("|"), v.split("|")
    dot = lambda p, q: " + ".join(f"({x}) * ({y})" for x, y in zip(p, q, strict=True))
    n = f"(sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"
    return f"CASE WHEN {n} > 0 THEN round(degrees(acos(least(1e0, greatest(-1e0, ({dot(a, b)}) / {n})))), 4) + 0e0 END"


def _v(a: str, b: str | None = None) -> str:
    return "|".join(f"{a}.{k} - {b}.{k}" if b else f"{a}.{k}" for k in "xyz")


def _tor(p0: str | None, p1: str, p2: str, p3: str) -> str:
    """Torsion of four points, the first the origin if None, rounded to 4 places."""
    def cr(a, b):
        return [f"(({a[1]}) * ({b[2]}) - ({a[2]}) * ({b[1]}))", f"(({a[2]}) * ({b[0]}) - ({a[0]}) * ({b[2]}))", f"(({a[0]}) * ({b[1]}) - ({a[1]}) * ({b[0]}))"]

    dot = lambda p, q: "(" + " + ".join(f"({x}) * ({y})" for x, y in zip(p, q, strict=True)) + ")"
    b1 = (_v(p1) if p0 is None else _v(p1, p0)).split("|")
    b2, b3 = _v(p2, p1).split("|"), _v(p3, p2).split("|")
    n1, n2 = cr(b1, b2), cr(b2, b3)
    return f"CASE WHEN {dot(n1, n1)} > 0 AND {dot(n2, n2)} > 0 THEN round(degrees(atan2(sqrt({dot(b2, b2)}) * {dot(b1, n2)}, {dot(n1, n2)})), 4) + 0e0 END"


@query("cys_angles", sql(f"SELECT site, chain, resseq, {_ang(_v('sg'), _v('cb', 'sg'))} AS zn_sg_cb, {_ang(_v('cb', 'sg'), _v('ca', 'cb'))} AS sg_cb_ca FROM cys WHERE rk <= 4", "cys"))
def cys_angles(spark, d):
    return _rounded(R.cys_angles(_around(spark, d), BY), ["site", "chain", "resseq"], ["zn_sg_cb", "sg_cb_ca"], 4)


@query("his_angles", sql(f"SELECT site, chain, resseq, n_name, {_ang('-n.x|-n.y|-n.z', _v('cg', 'n'))} AS zn_n_cg, {_ang(_v('n', 'cg'), _v('cb', 'cg'))} AS n_cg_cb, {_ang(_v('cg', 'cb'), _v('ca', 'cb'))} AS cg_cb_ca FROM his WHERE rk <= 4", "his"))
def his_angles(spark, d):
    return _rounded(R.his_angles(_around(spark, d), BY), ["site", "chain", "resseq", "n_name"], ["zn_n_cg", "n_cg_cb", "cg_cb_ca"], 4)


@query("residue_dihedrals", sql(f"SELECT site, chain, resseq, {_tor(None, 'sg', 'cb', 'ca')} AS torsion FROM cys WHERE rk <= 4", "cys"))
def residue_dihedrals(spark, d):
    return _rounded(R.cys_angles(_around(spark, d), BY), ["site", "chain", "resseq"], ["torsion"], 4)


@query("mean_distance", sql("SELECT site, count(*) AS n, round(avg(sqrt(q)), 6) AS mean_d FROM (SELECT site, q, row_number() OVER (PARTITION BY site ORDER BY q, chain, resseq) AS k FROM (SELECT site, chain, resseq, sg.d2 AS q FROM cys UNION ALL SELECT site, chain, resseq, n.d2 FROM his)) WHERE k <= 4 GROUP BY site", "his"))
def mean_distance(spark, d):
    return R.mean_distance(_around(spark, d), BY).select("site", "n", F.round("mean_d", 6).alias("mean_d"))


@query("ca_pair_categories", sql(f"SELECT a.site, least(a.kind, b.kind) || '-' || greatest(a.kind, b.kind) AS pair, round({_dist('a.ca', 'b.ca')}, 6) AS d FROM lig a JOIN lig b ON a.site = b.site AND a.rk < b.rk AND b.rk <= 4"))
def ca_pair_categories(spark, d):
    return R.ca_pairs(_around(spark, d), BY).select("site", "pair", F.round("d", 6).alias("d"))


_DET = """abs((a.x - d.x) * ((b.y - d.y) * (c.z - d.z) - (b.z - d.z) * (c.y - d.y)) + (a.y - d.y) * ((b.z - d.z) * (c.x - d.x) - (b.x - d.x) * (c.z - d.z)) + (a.z - d.z) * ((b.x - d.x) * (c.y - d.y) - (b.y - d.y) * (c.x - d.x))) / 6"""


@query("tetra_volume", sql(f"SELECT site, round({_DET}, 6) AS volume FROM (SELECT p.site, p.ca AS a, q.ca AS b, r.ca AS c, s.ca AS d FROM lig p JOIN lig q USING (site) JOIN lig r USING (site) JOIN lig s USING (site) WHERE p.rk = 1 AND q.rk = 2 AND r.rk = 3 AND s.rk = 4)"))
def tetra_volume(spark, d):
    return R.tetra_volume(_around(spark, d), BY).select("site", F.round("volume", 6).alias("volume"))


@query("donor_counts", sql("SELECT site, CAST(count(*) FILTER (n_name = 'ND1') AS BIGINT) AS n_nd1, CAST(count(*) FILTER (n_name = 'NE2') AS BIGINT) AS n_ne2 FROM his WHERE rk <= 4 GROUP BY site", "his"))
def donor_counts(spark, d):
    return R.donor_counts(_around(spark, d), BY)


@query("complete_cysteines", sql("SELECT site, CAST(sum(CASE WHEN f = 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_complete, sum(CASE WHEN f = 3 THEN 1 ELSE 0 END) <> 4 AS outlier FROM (SELECT site, chain, resseq, count(DISTINCT atom_name) FILTER (atom_name IN ('CA', 'CB', 'SG')) AS f FROM ar WHERE resname = 'CYS' GROUP BY site, chain, resseq) GROUP BY site", "ar"))
def complete_cysteines(spark, d):
    return R.complete_cysteines(_around(spark, d), BY)


_LETTER = "CASE resname WHEN 'CYS' THEN 'C' WHEN 'HIS' THEN 'H' WHEN 'ASP' THEN 'D' WHEN 'GLY' THEN 'G' ELSE 'X' END"


@query("sequence_gap_string", sql(f"""SELECT site, CASE WHEN count(*) = 1 THEN min(s) ELSE string_agg('(' || s || ')', '' ORDER BY chain) END AS sequence FROM (
  SELECT site, chain, string_agg(CASE WHEN resi - prev > 1 THEN 'x' || CAST(resi - prev - 1 AS VARCHAR) ELSE '' END || l, '' ORDER BY resi) AS s FROM (
    SELECT *, lag(resi) OVER (PARTITION BY site, chain ORDER BY resi) AS prev FROM (SELECT DISTINCT site, chain, resi, {_LETTER} AS l FROM ar WHERE resname IN ('CYS', 'HIS'))) GROUP BY site, chain) GROUP BY site""", "ar"))
def sequence_gap_string(spark, d):
    return R.gap_string(_around(spark, d).where("resname in ('CYS', 'HIS')"), BY)


@query("metric_summary", sql("""SELECT 'd_sg' AS key, CAST(sum(k) AS BIGINT) AS n, round(min(lo), 6) AS min, round(max(hi), 6) AS max, round(sum(s) / sum(k), 6) AS mean, CAST(sum(CASE WHEN k < 4 THEN 1 ELSE 0 END) AS BIGINT) AS short_sources
  FROM (SELECT site, count(*) AS k, min(sqrt(sg.d2)) AS lo, max(sqrt(sg.d2)) AS hi, sum(sqrt(sg.d2)) AS s FROM cys WHERE rk <= 4 GROUP BY site)""", "cys"))
def metric_summary(spark, d):
    m = R.cys_distances(_around(spark, d), BY).select(F.lit("d_sg").alias("key"), F.col("site").alias("source"), F.col("d_sg").alias("value"))
    return R.metric_summary(m, 4).select("key", "n", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean")], "short_sources")


@query("pair_histogram", sql("SELECT CAST(least(floor((v - 2e0) / 0.5e0), 11) AS INTEGER) AS bin, count(*) AS n, string_agg(DISTINCT CAST(site AS VARCHAR), ',' ORDER BY CAST(site AS VARCHAR)) AS sources FROM (SELECT site, sqrt(sg.d2) AS v FROM cys WHERE rk <= 4) WHERE v BETWEEN 2e0 AND 8e0 GROUP BY 1", "cys"))
def pair_histogram(spark, d):
    v = R.cys_distances(_around(spark, d), BY).select(F.col("site").cast("string").alias("source"), "d_sg")
    return R.histogram(v, "d_sg", "source", 2.0, 8.0, 12).select("bin", "n", F.array_join("sources", ",").alias("sources"))


@query("family_exemplar", sql("SELECT resname, chain, min(structure_id || '/' || resseq) AS path, count(*) AS n FROM atoms GROUP BY resname, chain", "atoms"))
def family_exemplar(spark, d):
    rows = atoms(spark, d).withColumn("path", F.concat_ws("/", "structure_id", "resseq"))
    return R.exemplars(rows, ["resname", "chain"], "path")


# -- B-factors ------------------------------------------------------------------------------------


@query("bfactor_groups", sql("SELECT structure_id, resname, count(*) AS n, round(avg(bfac), 8) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_pop(bfac) ELSE 0e0 END, 8) AS std FROM col GROUP BY structure_id, resname", "col"))
def bfactor_groups(spark, d):
    return B.group_stats(_base(spark, d)[1], ["structure_id", "resname"]).select("structure_id", "resname", "n", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"))


_RES = "SELECT structure_id, chain, resi, bool_or(atom_name = 'SG') AS marked FROM col GROUP BY structure_id, chain, resi"


@query("sequence_neighbours", sql(f"SELECT structure_id, chain, resi FROM (SELECT *, max(CASE WHEN marked THEN 1 ELSE 0 END) OVER (PARTITION BY structure_id, chain ORDER BY resi ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM ({_RES})) WHERE m = 1 AND NOT marked", "col"))
def sequence_neighbours(spark, d):
    r = _base(spark, d)[1].groupBy("structure_id", "chain", "resi").agg(F.bool_or(F.col("atom_name") == "SG").alias("marked"))
    return B.sequence_neighbors(r, ["structure_id", "chain"], "resi", "marked").select("structure_id", "chain", "resi")


@query("bfactor_lookup", sql("""SELECT a.line_no, coalesce(o.v, t.v, h.v, -1e0) AS b_factor FROM (SELECT *, CASE WHEN serial % 3 = 0 THEN 'OTHER' ELSE record END AS rec FROM col) a
  LEFT JOIN (SELECT structure_id, chain, resseq, atom_name, record, arg_min(bfac, line_no) AS v FROM atoms GROUP BY ALL) o ON o.structure_id = a.structure_id AND o.chain = a.chain AND o.resseq = a.resseq AND o.atom_name = a.atom_name AND o.record = a.rec
  LEFT JOIN (SELECT structure_id, chain, resseq, atom_name, arg_min(bfac, line_no) AS v FROM atoms WHERE record = 'ATOM' GROUP BY ALL) t ON t.structure_id = a.structure_id AND t.chain = a.chain AND t.resseq = a.resseq AND t.atom_name = a.atom_name
  LEFT JOIN (SELECT structure_id, chain, resseq, atom_name, arg_min(bfac, line_no) AS v FROM atoms WHERE record = 'HETATM' GROUP BY ALL) h ON h.structure_id = a.structure_id AND h.chain = a.chain AND h.resseq = a.resseq AND h.atom_name = a.atom_name""", "col"))
def bfactor_lookup(spark, d):
    raw, col, _ = _base(spark, d)
    rows = col.withColumn("record", F.when(F.col("serial") % 3 == 0, "OTHER").otherwise(F.col("record"))).select("line_no", "record", "structure_id", "chain", "resseq", "atom_name")
    return B.lookup(rows, raw, ["structure_id", "chain", "resseq", "atom_name"]).select("line_no", "b_factor")


_RANGES = "SELECT DISTINCT structure_id, chain, CASE WHEN resi % 3 = 0 THEN 'HELIX' ELSE 'SHEET' END AS kind, resi AS start, resi + 4 AS stop FROM col WHERE resi % 7 = 0 AND CAST(structure_id AS BIGINT) % 5 <> 0"


@query("secstruct_interval", sql(f"""SELECT r.structure_id, r.chain, r.resi, CASE WHEN r.structure_id NOT IN (SELECT structure_id FROM ({_RANGES})) THEN 'XXXX' ELSE coalesce(min(g.kind), 'LOOP') END AS sec
  FROM (SELECT DISTINCT structure_id, chain, resi FROM col) r LEFT JOIN ({_RANGES}) g ON g.structure_id = r.structure_id AND g.chain = r.chain AND r.resi BETWEEN g.start AND g.stop GROUP BY r.structure_id, r.chain, r.resi""", "col"))
def secstruct_interval(spark, d):
    col = _base(spark, d)[1]
    res = col.select("structure_id", "chain", "resi").distinct()
    ranges = col.where("resi % 7 = 0 and cast(structure_id as bigint) % 5 <> 0").select("structure_id", "chain", F.when(F.col("resi") % 3 == 0, "HELIX").otherwise("SHEET").alias("kind"), (F.col("resi") + 4).alias("start"), F.col("resi").alias("stop")).distinct()
    return B.secondary_structure(res, ranges, ["structure_id"], "resi").select("structure_id", "chain", "resi", "sec")


# -- texts ----------------------------------------------------------------------------------------


@query("fixed_width_parse", f"SELECT structure_id, CAST(serial % 100000 AS INTEGER) AS serial, record, atom_name, altloc, resname, chain, resseq, x, y, z, occ, bfac, element FROM ({ATOMS_SQL})")
def fixed_width_parse(spark, d):
    lines = pdb.render_atom(atoms(spark, d)).select("structure_id", "line_no", "line")
    return pdb.parse_atoms(lines).select("structure_id", "serial", "record", "atom_name", "altloc", "resname", "chain", "resseq", "x", "y", "z", "occ", "bfac", "element")


@query("xyz_lines", sql("""SELECT line_no, printf('%-2s  % .6f  % .6f  % .6f  # RES=%s CHAIN=%s RESSEQ=%s ATOM=%s REC=%s', CASE WHEN length(element) = 1 THEN upper(element) ELSE upper(element[1]) || lower(element[2:]) END, x, y, z, resname, chain, resseq, atom_name, record) AS line FROM col""", "col"))
def xyz_lines(spark, d):
    return _base(spark, d)[1].select("line_no", xyz.xyz_line().alias("line"))


@query("xyz_round_trip", sql("SELECT structure_id AS source, element, round(x, 6) AS x, resname, atom_name FROM (SELECT structure_id, CASE WHEN length(element) = 1 THEN element ELSE element[1] || lower(element[2:]) END AS element, x, resname, atom_name FROM col)", "col"))
def xyz_round_trip(spark, d):
    # dealt by structure once, for the collapse and the texts; only what is read of an atom is carried
    raw = atoms(spark, d).select(*KEY, *A.SITE_KEY, "line_no", "altloc", "occ", "record", "element", "resname", "x", "y", "z").repartition("structure_id")
    col = A.collapse_altloc(raw).withColumn("ord", F.col("line_no"))
    text = xyz.render(col, ["structure_id"], F.concat(F.lit("PDB="), F.col("structure_id")))
    lines = text.select(F.col("structure_id").alias("source"), F.posexplode(F.split(F.rtrim("xyz_text"), "\n")).alias("line_no", "line"))
    out = xyz.parse_xyz(lines)
    return out.select("source", "element", F.round("x", 6).alias("x"), F.col("meta")["RES"].alias("resname"), F.col("meta")["ATOM"].alias("atom_name"))


@query("kv_comment_map", sql("SELECT line_no, resname AS res, chain, CAST(bfac AS VARCHAR) AS bf FROM col", "col"))
def kv_comment_map(spark, d):
    rows = _base(spark, d)[1].withColumn("c", F.concat_ws(" ", F.concat(F.lit("RES=OLD RES="), "resname"), F.concat(F.lit("CHAIN="), "chain"), F.lit("word =x"), F.concat(F.lit("BF="), F.col("bfac").cast("string"))))
    m = xyz.comment_map(F.col("c"))
    return rows.select("line_no", m["RES"].alias("res"), m["CHAIN"].alias("chain"), m["BF"].alias("bf"))


@query("comment_upsert", sql("SELECT line_no, 'RES=' || resname || ' CHAIN=' || chain || ' SEC=LOOP' AS comment FROM col", "col"))
def comment_upsert(spark, d):
    c = F.concat_ws(" ", F.concat(F.lit("RES="), "resname"), F.lit("SEC=HELIX SECSTRUCT=H"), F.concat(F.lit("CHAIN="), "chain"))
    return _base(spark, d)[1].select("line_no", xyz.upsert(c, "SEC", F.lit("LOOP"), ("SECSTRUCT",)).alias("comment"))


@query("regex_tokens", r"SELECT doc_id, regexp_extract(text, '([A-Za-z]+) ([A-Za-z]+)', 2) AS second_word, CAST(len(regexp_extract_all(text, '[A-Z][a-z]+')) AS BIGINT) AS n_capitals FROM documents")
def regex_tokens(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.regexp_extract("text", "([A-Za-z]+) ([A-Za-z]+)", 2).alias("second_word"), F.size(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).cast("long").alias("n_capitals"))


@query("json_props", "SELECT event_id, json_keys(props::JSON)[1] AS first_key, CAST(len(json_keys(props::JSON)) AS BIGINT) AS n_keys FROM events")
def json_props(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    keys = F.json_object_keys("props")
    return e.select("event_id", F.get(keys, F.lit(0)).alias("first_key"), F.size(keys).cast("long").alias("n_keys"))


@query("element_inference", sql("SELECT line_no, CASE WHEN substr(atom_name, 2, 1) BETWEEN 'a' AND 'z' THEN upper(substr(atom_name, 1, 2)) ELSE substr(atom_name, 1, 1) END AS element FROM col", "col"))
def element_inference(spark, d):
    return _base(spark, d)[1].select("line_no", pdb.infer_element(F.lit(""), F.col("atom_name")).alias("element"))


# -- spectra --------------------------------------------------------------------------------------


@query("dw_rollup", sql("SELECT structure_id AS source, kind, n, round(mean_dw, 6) AS mean_dw, round(var_d, 6) AS var_d, round(mean_dw + var_d, 6) AS total FROM (SELECT structure_id, CASE WHEN grouping(element) = 1 THEN 'all' ELSE element END AS kind, count(*) AS n, CAST(sum(CAST(occ AS DECIMAL(14, 6))) AS DOUBLE) / count(*) AS mean_dw, greatest(CAST(sum(CAST(bfac AS DECIMAL(14, 6)) * CAST(bfac AS DECIMAL(14, 6))) AS DOUBLE) / count(*) - (CAST(sum(CAST(bfac AS DECIMAL(14, 6))) AS DOUBLE) / count(*)) * (CAST(sum(CAST(bfac AS DECIMAL(14, 6))) AS DOUBLE) / count(*)), 0e0) AS var_d FROM col WHERE element IN ('N', 'S') GROUP BY GROUPING SETS ((structure_id), (structure_id, element)))", "col"))
def dw_rollup(spark, d):
    rows = _base(spark, d)[1].where("element in ('N', 'S')").select(F.col("structure_id").alias("source"), F.col("element").alias("kind"), "occ", "bfac")
    return P.dw_rollup(rows, "source", "kind", "occ", "bfac").select("source", "kind", "n", *[F.round(c, 6).alias(c) for c in ("mean_dw", "var_d", "total")])


_TRACE = "SELECT user_id % 5 AS source, CAST(event_id % 400 AS DOUBLE) / 25e0 AS k, arg_min(value, event_id) AS chi FROM events GROUP BY 1, 2"


@query("spectrum_average", f"""WITH t AS ({_TRACE}), s AS (SELECT greatest(max(a), 0e0) AS a, least(min(b), 13e0) AS b FROM (SELECT source, min(k) AS a, max(k) AS b FROM t GROUP BY source)),
  g AS (SELECT i, a + i * ((b - a) / 511) AS k FROM s, range(512) r(i)), seg AS (SELECT source, k AS k0, chi AS v0, lead(k) OVER (PARTITION BY source ORDER BY k) AS k1, lead(chi) OVER (PARTITION BY source ORDER BY k) AS v1 FROM t)
  SELECT g.i, round(avg(CASE WHEN k1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (g.k - k0) / (k1 - k0) END), 5) AS mean, count(*) AS n FROM g JOIN seg ON g.k >= k0 AND (k1 IS NULL OR g.k < k1) GROUP BY g.i""")
def spectrum_average(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 5).alias("source"), ((F.col("event_id") % 400).cast("double") / 25.0).alias("k"), "value", "event_id")
    t = P.first_per_k(e, ["source"], "k", "value", "event_id").withColumnRenamed("value", "chi")
    return P.average(t, "source", "k", "chi").select("i", F.round("mean", 5).alias("mean"), "n")


@query("mutual_match", sql(f"""SELECT structure_id, element, a_id, b_id, sqrt(q) AS d FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY q, b_id) AS ra, row_number() OVER (PARTITION BY b_id ORDER BY q, a_id) AS rb
  FROM (SELECT a.structure_id, a.element, c.line_no AS a_id, a.line_no AS b_id, {_NEAR} AS q FROM col c JOIN col a ON a.structure_id = c.structure_id AND a.element = c.element AND c.record = 'ATOM' AND a.record = 'HETATM') WHERE q <= 4.0e0) WHERE ra = 1 AND rb = 1""", "col"))
def mutual_match(spark, d):
    col = _base(spark, d)[1]
    side = lambda p, r: col.where(f"record = '{r}'").select("structure_id", "element", F.col("line_no").alias(p + "id"), *[F.col(k).alias(p + k) for k in "xyz"])
    return P.match_mutual(side("a_", "ATOM"), side("b_", "HETATM"), ["structure_id", "element"], 2.0)


@query("spectrum_to_r", None)
def spectrum_to_r(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 5).alias("source"), ((F.col("event_id") % 400).cast("double") / 25.0).alias("k"), "value", "event_id")
    return P.transform_to_r(P.first_per_k(e, ["source"], "k", "value", "event_id"), "source", "k", "value")


# -- state and search -------------------------------------------------------------------------------

_STATUS = "CASE value_rank % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'matched' WHEN 3 THEN 'rejected' WHEN 4 THEN 'error' ELSE 'download_failed' END"
_LATEST = f"SELECT user_id, arg_max(s, event_id) AS status FROM (SELECT user_id, event_id, {_STATUS} AS s FROM (SELECT *, event_id % 11 AS value_rank FROM events)) GROUP BY user_id"


def _log(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", (F.col("event_id") % 11).alias("value_rank"))
    return e.withColumn("status", F.element_at(F.array(*map(F.lit, state.STATUSES)), (F.col("value_rank") % 6 + 1).cast("int"))).drop("value_rank")


@query("checkpoint_latest", _LATEST)
def checkpoint_latest(spark, d):
    return state.latest(_log(spark, d), "user_id", ["event_id"]).select("user_id", "status")


@query("pending_ids", f"WITH l AS ({_LATEST}) SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM l WHERE status IN ('matched', 'rejected'))")
def pending_ids(spark, d):
    ids = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    return state.pending(ids, state.reset(state.latest(_log(spark, d), "user_id", ["event_id"])), "user_id")


@query("status_counts", f"WITH l AS ({_LATEST}) SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in state.STATUSES) + " FROM l")
def status_counts(spark, d):
    return state.stats(state.latest(_log(spark, d), "user_id", ["event_id"]))


@query("id_reconciliation", f"WITH l AS ({_LATEST}) SELECT DISTINCT e.user_id, l.user_id IS NOT NULL AS found FROM events e LEFT JOIN (SELECT * FROM l WHERE status = 'matched') l USING (user_id)")
def id_reconciliation(spark, d):
    ids = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    return state.reconcile(ids, state.latest(_log(spark, d), "user_id", ["event_id"]).where("status = 'matched'"), "user_id")


_SEARCH = catalog.Search(component="BUILDING", resolution=5000.0, polymer="1")
_COLUMNS = {"component": "c_mktsegment", "resolution": "c_acctbal", "polymer": "c_name"}


@query("catalogue_search", "SELECT c_custkey FROM customer WHERE upper(c_mktsegment) = 'BUILDING' AND c_acctbal <= 5000e0 AND contains(lower(c_name), '1')")
def catalogue_search(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").where(_SEARCH.condition(_COLUMNS)).select("c_custkey")


@query("search_explainer", "SELECT c_custkey, concat_ws(',', CASE WHEN NOT coalesce(upper(c_mktsegment) = 'BUILDING', false) THEN 'component' END, CASE WHEN c_acctbal > 5000e0 THEN 'resolution' END, CASE WHEN NOT coalesce(contains(lower(c_name), '1'), false) THEN 'polymer' END) AS failed FROM customer")
def search_explainer(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.array_join(_SEARCH.explain(_COLUMNS), ",").alias("failed"))


@query("ordered_distinct_ids", sql("SELECT structure_id, min(line_no) AS first_pos FROM col GROUP BY structure_id", "col"))
def ordered_distinct_ids(spark, d):
    return catalog.ordered_distinct(_base(spark, d)[1], "structure_id", "line_no")


@query("id_tokens", r"SELECT user_id, token, regexp_matches(token, '^[1-9][A-Za-z0-9]{3}$') AS valid FROM (SELECT user_id, unnest(['1abc', CAST(user_id % 10 AS VARCHAR) || 'xyz', '9qq']) AS token FROM (SELECT DISTINCT user_id FROM events))")
def id_tokens(spark, d):
    u = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    text = F.concat(F.lit("1ABC, "), (F.col("user_id") % 10).cast("string"), F.lit("xyz,\n 9qq "))
    return u.select("user_id", F.explode(catalog.split_ids(text)).alias("token")).withColumn("valid", catalog.valid_id(F.col("token")))


@query("retention_policy", "SELECT DISTINCT user_id, user_id % 2 = 0 AND user_id % 3 <> 0 AS deletable FROM events")
def retention_policy(spark, d):
    u = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    path = F.when(F.col("user_id") % 3 == 0, "/data/input/a.pdb").otherwise("/data/downloads/a.pdb")
    return u.select("user_id", state.deletable(path, "/data/downloads", F.col("user_id") % 2 == 0).alias("deletable"))


@query("file_formats", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'cif' WHEN 1 THEN 'pdb' WHEN 2 THEN 'cif' ELSE 'pdb' END AS format FROM customer")
def file_formats(spark, d):
    k = F.col("c_custkey") % 4
    path = F.when(k == 0, "a/b.CIF.gz").when(k == 1, "a/b.pdb").otherwise("a/b.txt")
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", pdb.file_format(path, F.when(k == 2, "data_1ABC").otherwise("HEADER")).alias("format"))


@query("model_numbers", sql("SELECT line_no, CAST(CASE WHEN resi < 30 THEN 1 ELSE 2 END AS INTEGER) AS model FROM atoms", "atoms"))
def model_numbers(spark, d):
    a = atoms(spark, d)
    lines = pdb.render_atom(a).select("structure_id", (F.col("line_no") * 2).alias("line_no"), "line")
    first = a.groupBy("structure_id", (F.col("resi") >= 30).alias("late")).agg(F.min("line_no").alias("l"))
    marks = first.select("structure_id", (F.col("l") * 2 - 1).alias("line_no"), F.when(F.col("late"), "MODEL        2").otherwise("MODEL        1").alias("line"))
    out = pdb.model_number(lines.unionByName(marks)).where(~F.col("line").startswith("MODEL"))
    return out.select((F.col("line_no") / 2).cast("long").alias("line_no"), "model")


@query("resolution_gate", sql("SELECT structure_id, CASE WHEN CAST(structure_id AS BIGINT) % 4 = 0 THEN 'resolution_na' WHEN CAST(structure_id AS BIGINT) % 4 = 1 THEN 'resolution_above_cutoff' END AS reason FROM (SELECT DISTINCT structure_id FROM atoms)", "atoms"))
def resolution_gate(spark, d):
    s = atoms(spark, d).select("structure_id").distinct().withColumn("k", F.col("structure_id").cast("long") % 4)
    text = F.when(F.col("k") == 0, "REMARK   2 RESOLUTION. NOT APPLICABLE.").otherwise(F.format_string("REMARK   2 RESOLUTION.    %.2f ANGSTROMS.", F.when(F.col("k") == 1, 3.5).otherwise(1.5)))
    lines = s.select("structure_id", F.lit(1).cast("long").alias("line_no"), text.alias("line"))
    r = pdb.resolution(lines)
    return r.select("structure_id", F.when(F.col("resolution").isNull(), "resolution_na").when(F.col("resolution") > 2.5, "resolution_above_cutoff").alias("reason"))


@query("embedding_nearest", """SELECT label, vec_id AS id, rk FROM (SELECT e.label, e.vec_id, row_number() OVER (PARTITION BY e.label ORDER BY round(list_sum(list_transform(list_zip(e.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6), e.vec_id) AS rk
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) e
  JOIN (SELECT label, list(m ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label) c ON c.label = e.label) WHERE rk <= 4""")
def embedding_nearest(spark, d):
    """Nearest four points to each group's centroid, in all dimensions."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    c = e.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    c = c.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("c"))
    d2 = F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, q: t + q)
    w = Window.partitionBy("label").orderBy("q", "vec_id")
    out = e.join(c, "label").withColumn("q", F.round(d2, 6)).withColumn("rk", F.row_number().over(w).cast("long")).where("rk <= 4")
    return out.select("label", F.col("vec_id").alias("id"), "rk")


@query("residue_sort_key", sql("SELECT DISTINCT resseq, CAST(resseq AS INTEGER) AS n FROM col", "col"))
def residue_sort_key(spark, d):
    return _base(spark, d)[1].select("resseq", A.residue_sort_key(F.col("resseq"))["n"].alias("n")).distinct()
