"""Queries on the site record, its altloc variants and the cascade of reasons, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from metalith.operators import record as R
from metalith.operators import sites as S
from metalith.sources.derived import atoms

from .site_queries import _AA, _PARTS

QUERIES, ORACLES = {}, {}

_SITE = "structure_id, chain, resseq, icode, atom_name"
_NEAR = "(c.x - a.x) * (c.x - a.x) + (c.y - a.y) * (c.y - a.y) + (c.z - a.z) * (c.z - a.z)"
#: Parts after ``cluster``; the key of a variant is its centre's line and its label.
_VARIANT_PARTS = {
    "near": f"SELECT DISTINCT c.structure_id, c.root, a.resname, a.chain, a.resseq FROM root c JOIN cluster t ON t.root = c.root JOIN col a ON a.structure_id = c.structure_id AND {_NEAR} <= 36.0e0",
    "sel": "SELECT n.root, a.* FROM near n JOIN col a ON a.structure_id = n.structure_id AND a.resname = n.resname AND a.chain = n.chain AND a.resseq = n.resseq",
    "alt": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_SITE}, altloc ORDER BY line_no DESC) AS k FROM atoms) WHERE k = 1",
    "lab": f"SELECT {_SITE}, list_sort(list(altloc) FILTER (altloc <> '')) AS labels FROM alt GROUP BY {_SITE}",
    "ctr": f"SELECT r.*, t.cluster_type, t.n_metals, coalesce(l.labels, []) AS labels FROM root r JOIN (SELECT root, cluster_type, n_metals FROM cluster) t ON t.root = r.root JOIN lab l USING ({_SITE}) WHERE r.atom_name = 'ZN'",
    "nb": f"SELECT c.line_no AS c_line_no, s.*, coalesce(l.labels, []) AS labels FROM ctr c JOIN sel s ON s.root = c.root AND s.serial <> c.serial JOIN lab l ON {' AND '.join(f'l.{k} = s.{k}' for k in _SITE.split(', '))}",
    "kind": """SELECT c.line_no AS c_line_no, any_value(c.labels) AS c_labels, list_sort(list_distinct(flatten(list(coalesce(n.labels, []))))) AS n_labels,
        coalesce(bool_and(len(n.labels) > 0 AND list_has_all(n.labels, c.labels)), true) AS every FROM ctr c LEFT JOIN nb n ON n.c_line_no = c.line_no GROUP BY c.line_no""",
    "variant": """SELECT *, concat(c_line_no, ':', altloc_label) AS key FROM (SELECT c_line_no, altloc_case, unnest(CASE WHEN altloc_case = 3 THEN n_labels WHEN altloc_case < 3 THEN c_labels ELSE [NULL] END) AS altloc_label
        FROM (SELECT *, CASE WHEN len(c_labels) > 0 THEN CASE WHEN every THEN 1 ELSE 2 END WHEN len(n_labels) > 0 THEN 3 END AS altloc_case FROM kind))""",
    "org": f"""SELECT v.*, c.root, o.line_no AS o_line, o.serial AS o_serial, o.x AS ox, o.y AS oy, o.z AS oz, c.n_metals FROM variant v JOIN ctr c ON c.line_no = v.c_line_no
        LEFT JOIN alt w ON {' AND '.join(f'w.{k} = c.{k}' for k in _SITE.split(', '))} AND w.altloc = v.altloc_label AND v.altloc_case < 3 JOIN atoms o ON o.line_no = coalesce(w.line_no, c.line_no)""",
    "picked": f"""SELECT o.key, n.group_ord AS ord, CASE WHEN o.altloc_case IS NULL THEN n.line_no WHEN o.altloc_case = 1 THEN w.line_no ELSE coalesce(w.line_no, b.line_no) END AS line_no
        FROM org o JOIN nb n ON n.c_line_no = o.c_line_no LEFT JOIN alt w ON {' AND '.join(f'w.{k} = n.{k}' for k in _SITE.split(', '))} AND w.altloc = o.altloc_label
        LEFT JOIN alt b ON {' AND '.join(f'b.{k} = n.{k}' for k in _SITE.split(', '))} AND b.altloc = ''""",
    "va": """SELECT o.key, o.ox, o.oy, o.oz, o.o_serial, p.ord, a.* FROM org o JOIN (SELECT * FROM picked UNION ALL SELECT key, -1, o_line FROM org) p ON p.key = o.key JOIN atoms a ON a.line_no = p.line_no
        WHERE o.altloc_case IS NULL OR p.ord = -1 OR EXISTS (SELECT 1 FROM near n WHERE n.root = o.root AND n.resname = a.resname AND n.chain = a.chain AND n.resseq = a.resseq)
        OR sqrt((a.x - o.ox) * (a.x - o.ox) + (a.y - o.oy) * (a.y - o.oy) + (a.z - o.oz) * (a.z - o.oz)) <= 6.0e0""",
    "shell": """SELECT structure_id, key AS c_line_no, ox AS c_x, oy AS c_y, oz AS c_z, line_no, element, resname, chain, resseq, icode, atom_name, x, y, z, sqrt((ox - x) * (ox - x) + (oy - y) * (oy - y) + (oz - z) * (oz - z)) AS d
        FROM va WHERE serial <> o_serial AND element IN ('N', 'O', 'S') AND sqrt((ox - x) * (ox - x) + (oy - y) * (oy - y) + (oz - z) * (oz - z)) BETWEEN 2.0e0 AND 2.8e0""",
}


def variant_sql(body: str) -> str:
    names = list(_PARTS)
    before, after = names[: names.index("cluster") + 1], names[names.index("coord") :]
    parts = {n: _PARTS[n] for n in before} | _VARIANT_PARTS | {n: _PARTS[n] for n in after}
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({q})" for n, q in parts.items()) + " " + body


def query(name: str, oracle: str):
    def put(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return put


@query("altloc_variants", variant_sql("SELECT c_line_no, CAST(altloc_case AS BIGINT) AS altloc_case, altloc_label, count(*) AS n, CAST(sum(va.line_no) AS BIGINT) AS lines FROM va JOIN variant USING (key) GROUP BY c_line_no, altloc_case, altloc_label"))
def altloc_variants(spark, d):
    v = R.variants(R.selected(atoms(spark, d), S.SiteConfig()), S.SiteConfig())
    lines = F.aggregate("atoms", F.lit(0).cast("long"), lambda t, a: t + a["line_no"])
    return v.select(F.col("center.line_no").alias("c_line_no"), F.col("altloc_case").cast("long").alias("altloc_case"), "altloc_label", F.size("atoms").cast("long").alias("n"), lines.alias("lines"))


_TEXT = f"""SELECT key, count(*) AS n_text, md5(string_agg(rpad(CASE WHEN length(element) = 1 THEN element ELSE element[1] || lower(element[2:]) END, 2, ' ') || printf('  % .6f  % .6f  % .6f  # RES=%s CHAIN=%s RESSEQ=%s ATOM=%s REC=%s', x - ox, y - oy, z - oz, resname, chain, resseq, atom_name, record), chr(10) ORDER BY ord)) AS text_md5
  FROM va e WHERE NOT (resname IN {_AA} AND atom_name IN ('N', 'C', 'O', 'OXT')) OR EXISTS (SELECT 1 FROM va a JOIN va c ON c.key = a.key AND c.element = 'ZN' AND c.serial <> a.serial
    WHERE a.key = e.key AND a.chain = e.chain AND a.resseq = e.resseq AND a.icode = e.icode AND a.resname IN {_AA} AND a.atom_name IN ('N', 'CA', 'C', 'O', 'OXT') AND {_NEAR} <= 9.0e0) GROUP BY key"""


@query("site_records", variant_sql(f"""SELECT v.c_line_no, CAST(v.altloc_case AS BIGINT) AS altloc_case, v.altloc_label, coalesce(g.label, 'UNK') AS label, CAST(coalesce(g.cn, 0) AS BIGINT) AS cn, round_even(coalesce(g.sigma, 0), 4) AS sigma,
  coalesce(c.coord_string, '') AS coord_string, coalesce(l.ligands, '') AS ligands, t.n_text, t.text_md5, CASE WHEN o.n_metals > 1 THEN 'centroid' ELSE 'single_center' END AS origin_kind
  FROM variant v JOIN org o USING (key) LEFT JOIN geo g ON g.c_line_no = v.key LEFT JOIN coord c ON c.c_line_no = v.key JOIN ({_TEXT}) t ON t.key = v.key
  LEFT JOIN (SELECT c_line_no, string_agg(DISTINCT concat_ws(' ', resname, chain, resseq, atom_name), ';' ORDER BY concat_ws(' ', resname, chain, resseq, atom_name)) AS ligands FROM shell WHERE resname NOT IN ('HOH', 'WAT') GROUP BY c_line_no) l ON l.c_line_no = v.key"""))
def site_records(spark, d):
    r = R.site_records(atoms(spark, d))
    body = F.array_join(F.slice(F.split(F.rtrim("xyz_text", F.lit("\n")), "\n"), 3, 100_000), "\n")
    return r.select(
        "c_line_no", F.col("altloc_case").cast("long").alias("altloc_case"), "altloc_label", "geometry.label", F.col("geometry.CN").cast("long").alias("cn"), F.col("geometry.sigma_d").alias("sigma"),
        "provenance.coord_string", F.array_join("ligand_residues", ";").alias("ligands"), F.size("atoms_meta").cast("long").alias("n_text"), F.md5(body).alias("text_md5"), F.col("provenance.origin_kind_in_cluster").alias("origin_kind"),
    )


#: Models and resolutions for the cascade: a structure is sixty orders, some of which have no atoms here.
_ENTRIES = """SELECT structure_id, 1 AS model, CASE WHEN pending = 0 THEN NULL ELSE resolution END AS resolution FROM (
  SELECT CAST(o_orderkey {div} 60 AS {text}) AS structure_id, round(avg(o_totalprice) / 50000, 2) AS resolution, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS pending FROM {orders} GROUP BY o_orderkey {div} 60
  UNION ALL SELECT concat('empty', CAST(n_nationkey AS {text})), 2.0e0, 1 FROM {nation})"""
_CASCADE = S.SiteConfig(must_have=S.MustHave("all", ("N",), (("S", 4),)), ligands=(S.LigandRequirement(("CYS", "HIS"), 1, ("SG", "ND1", "NE2", "CA", "CB")),), coord=("1N", "2N", "1N1O", "1O", "1S"))
_CUTOFF = 3.0
_GATE = f"""SELECT e.structure_id, CASE WHEN coalesce(n, 0) = 0 THEN 'no_atoms' WHEN resolution IS NULL THEN 'resolution_na' WHEN resolution > {_CUTOFF}e0 THEN 'resolution_above_cutoff' WHEN n_metals = 0 THEN 'no_metals' WHEN n_targets = 0 THEN 'no_target_component' END AS reason
  FROM ({_ENTRIES.format(div='//', text='VARCHAR', orders='orders', nation='nation')}) e LEFT JOIN (SELECT c.structure_id, count(*) AS n, count(m.line_no) AS n_metals, count(*) FILTER (m.atom_name = 'ZN') AS n_targets FROM col c LEFT JOIN metals m USING (line_no) GROUP BY c.structure_id) s ON s.structure_id = e.structure_id"""
_FILTERS = """SELECT o.structure_id, CASE WHEN r.nn = 0 OR r.ns < 4 THEN 'must_have' WHEN coalesce(h.k, 0) <> 1 THEN 'ligand_requirements' WHEN coalesce(c.coord_string, '') NOT IN ('1N', '2N', '1N1O', '1O', '1S') THEN 'coord_string' END AS reason
  FROM (SELECT v.key, c.structure_id FROM variant v JOIN ctr c ON c.line_no = v.c_line_no) o JOIN (SELECT key, count(*) FILTER (element = 'N') AS nn, count(*) FILTER (element = 'S') AS ns FROM (SELECT *, serial <> o_serial AS other FROM va) WHERE other GROUP BY key) r ON r.key = o.key
  LEFT JOIN (SELECT c_line_no, count(*) FILTER (resname IN ('CYS', 'HIS') AND atom_name IN ('SG', 'ND1', 'NE2', 'CA', 'CB')) AS k FROM shell GROUP BY c_line_no) h ON h.c_line_no = o.key LEFT JOIN coord c ON c.c_line_no = o.key"""


def _entries(spark, d):
    tables = {t: spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "nation")}
    return spark.sql(_ENTRIES.format(div="div", text="STRING", orders="{orders}", nation="{nation}"), **tables)


@query("elimination_cascade", variant_sql(f"SELECT structure_id, reason, count(*) AS n FROM (SELECT * FROM ({_GATE}) UNION ALL SELECT f.* FROM ({_FILTERS}) f JOIN ({_GATE}) g ON g.structure_id = f.structure_id AND g.reason IS NULL) WHERE reason IS NOT NULL GROUP BY structure_id, reason"))
def elimination_cascade(spark, d):
    return R.eliminations(atoms(spark, d), _entries(spark, d), _CASCADE, _CUTOFF)


@query("elimination_totals", "SELECT reason, CAST(sum(n) AS BIGINT) AS n FROM (" + ORACLES["elimination_cascade"] + ") GROUP BY reason")
def elimination_totals(spark, d):
    return R.most_common(R.eliminations(atoms(spark, d), _entries(spark, d), _CASCADE, _CUTOFF))


@query("rejected_distributions", variant_sql(f"""SELECT what, value, count(*) AS n FROM (SELECT 'CN' AS what, CAST(coalesce(g.cn, 0) AS VARCHAR) AS value, f.reason FROM (SELECT *, row_number() OVER () AS i FROM ({_FILTERS.replace('SELECT o.structure_id,', 'SELECT o.key,')})) f LEFT JOIN cov g ON g.c_line_no = f.key
  UNION ALL SELECT 'COORD', coalesce(c.coord_string, ''), f.reason FROM ({_FILTERS.replace('SELECT o.structure_id,', 'SELECT o.key,')}) f LEFT JOIN coord c ON c.c_line_no = f.key) WHERE reason IS NOT NULL GROUP BY what, value"""))
def rejected_distributions(spark, d):
    return R.rejected_distributions(R.judged(atoms(spark, d), _CASCADE))
