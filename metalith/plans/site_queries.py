"""Queries on metal sites over the derived atoms relation, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metalith.functions import geometry as G
from metalith.operators import atoms as A
from metalith.operators import clusters as C
from metalith.operators import neighbors as N
from metalith.operators import sites as S
from metalith.schema import COVALENT_RADII, METALS
from metalith.scratch import stored
from metalith.sources.derived import ATOMS_SQL, atoms

KEY = A.STRUCTURE
_METALS = ", ".join(f"'{m}'" for m in METALS)

#: Building blocks of the SQL, in order; ``sql`` picks what a query needs.
_PARTS = {
    "atoms": ATOMS_SQL,
    "col": """SELECT * EXCLUDE (rn, group_first), group_first AS group_ord FROM (
        SELECT *, row_number() OVER (PARTITION BY structure_id, chain, resseq, icode, atom_name
          ORDER BY CASE WHEN altloc IN ('', 'A') THEN 0 ELSE 1 END, CASE WHEN altloc IN ('', 'A') THEN 0 ELSE -occ END, line_no) AS rn,
          min(line_no) OVER (PARTITION BY structure_id, chain, resseq, icode, atom_name) AS group_first FROM atoms) WHERE rn = 1""",
    "metals": f"SELECT * FROM col WHERE record = 'HETATM' AND upper(element) IN ({_METALS})",
    "edge": """SELECT a.structure_id, a.line_no AS i, b.line_no AS j FROM metals a JOIN metals b ON a.structure_id = b.structure_id AND a.line_no <> b.line_no
        AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 25.0e0""",
    "reach": "SELECT line_no AS i, line_no AS j FROM metals UNION SELECT reach.i, edge.j FROM reach JOIN edge ON edge.i = reach.j",
    "root": "SELECT m.*, r.root FROM metals m JOIN (SELECT i, min(j) AS root FROM reach GROUP BY i) r ON r.i = m.line_no",
    "cluster": """SELECT structure_id, root, count(*) AS n_metals, CAST(sum(CASE WHEN atom_name = 'ZN' THEN 1 ELSE 0 END) AS BIGINT) AS n_targets,
        CASE WHEN count(*) = 1 THEN 'homo' WHEN bool_and(element = 'ZN') THEN 'multi_homo' ELSE 'multi_hetero' END AS cluster_type,
        avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM root GROUP BY structure_id, root HAVING sum(CASE WHEN atom_name = 'ZN' THEN 1 ELSE 0 END) > 0""",
    "shell": """SELECT c.structure_id, c.line_no AS c_line_no, c.x AS c_x, c.y AS c_y, c.z AS c_z, a.line_no, a.element, a.resname, a.chain, a.resseq, a.icode, a.atom_name, a.x, a.y, a.z,
        sqrt((c.x - a.x) * (c.x - a.x) + (c.y - a.y) * (c.y - a.y) + (c.z - a.z) * (c.z - a.z)) AS d
        FROM metals c JOIN col a ON a.structure_id = c.structure_id AND a.serial <> c.serial AND a.element IN ('N', 'O', 'S')
        AND sqrt((c.x - a.x) * (c.x - a.x) + (c.y - a.y) * (c.y - a.y) + (c.z - a.z) * (c.z - a.z)) BETWEEN 2.0e0 AND 2.8e0""",
    "coord": """SELECT structure_id, c_line_no, string_agg(part, '' ORDER BY part) AS coord_string FROM (
        SELECT structure_id, c_line_no, CAST(count(*) AS VARCHAR) || element AS part FROM shell GROUP BY structure_id, c_line_no, element) GROUP BY structure_id, c_line_no""",
    "angle": """SELECT p.structure_id, p.c_line_no, degrees(acos(greatest(-1e0, least(1e0, ((p.x - p.c_x) * (q.x - q.c_x) + (p.y - p.c_y) * (q.y - q.c_y) + (p.z - p.c_z) * (q.z - q.c_z))
        / (sqrt((p.x - p.c_x) * (p.x - p.c_x) + (p.y - p.c_y) * (p.y - p.c_y) + (p.z - p.c_z) * (p.z - p.c_z)) * sqrt((q.x - q.c_x) * (q.x - q.c_x) + (q.y - q.c_y) * (q.y - q.c_y) + (q.z - q.c_z) * (q.z - q.c_z))))))) AS a
        FROM shell p JOIN shell q ON p.structure_id = q.structure_id AND p.c_line_no = q.c_line_no AND p.line_no < q.line_no""",
    "ang": "SELECT c_line_no, list(a) AS av, max(a) AS amax, sqrt(avg((a - 109.47e0) * (a - 109.47e0))) AS rms, max(abs(a - 109.47e0)) AS dev FROM angle GROUP BY c_line_no",
    "cov": """SELECT structure_id, c_line_no, count(*) AS cn, stddev_pop(d) AS sigma, max(d) - min(d) AS delta, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(z, z) AS zz,
        covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM shell GROUP BY structure_id, c_line_no""",
    "pq": "SELECT *, (xx + yy + zz) / 3 AS q, sqrt((pow(xx - (xx + yy + zz) / 3, 2) + pow(yy - (xx + yy + zz) / 3, 2) + pow(zz - (xx + yy + zz) / 3, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM cov",
    "pl": """SELECT *, CASE WHEN cn <= 3 THEN 0e0 ELSE sqrt(greatest(0e0, CASE WHEN p > 0 THEN q + 2 * p * cos(acos(greatest(-1e0, least(1e0,
        ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (p * p * p) / 2))) / 3 + 2 * pi() / 3) ELSE q END)) END AS rms_plane FROM pq""",
    "geo": """SELECT g.*, CASE WHEN ideal IS NOT NULL AND (coalesce(sqrt(list_sum(list_transform(av, lambda v: (v - ideal) * (v - ideal))) / len(av)), 0) > 20 OR sigma > 0.15e0 OR (rms_plane > 0.35e0 AND base IN ('SQP', 'TP'))) THEN base || '_d' ELSE base END AS label
        FROM (SELECT b.*, CASE base WHEN 'LIN' THEN 180e0 WHEN 'BEN' THEN 120e0 WHEN 'TP' THEN 120e0 WHEN 'TS' THEN 90e0 WHEN 'SQP' THEN 90e0 WHEN 'TD' THEN 109.47e0 WHEN 'SPY' THEN 90e0 WHEN 'TBP' THEN 109.47e0 WHEN 'OH' THEN 90e0 END AS ideal
          FROM (SELECT pl.*, av, rms, dev, CASE WHEN cn = 2 THEN CASE WHEN amax >= 160 THEN 'LIN' ELSE 'BEN' END WHEN cn = 3 THEN CASE WHEN rms_plane <= 0.35e0 THEN 'TP' ELSE 'TS' END
            WHEN cn = 4 THEN CASE WHEN rms_plane <= 0.35e0 THEN 'SQP' ELSE 'TD' END WHEN cn = 5 THEN CASE WHEN amax >= 160 AND rms_plane <= 0.35e0 THEN 'SPY' ELSE 'TBP' END
            WHEN cn = 6 THEN 'OH' WHEN cn > 6 THEN 'HCN' ELSE 'UNK' END AS base FROM pl LEFT JOIN ang USING (c_line_no)) b) g""",
}


def sql(body: str, last: str) -> str:
    """``body`` after all parts up to ``last``."""
    names = list(_PARTS)[: list(_PARTS).index(last) + 1]
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({_PARTS[n]})" for n in names) + " " + body


def _base(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    raw = atoms(spark, d)
    col = A.collapse_altloc(raw)
    return raw, col, A.metals(col)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Atoms with what a collapse alone looks at; the planner does not drop columns inside an aggregate."""
    return atoms(spark, d).select(*KEY, *A.SITE_KEY, "line_no", "serial", "altloc", "occ")


def _shell(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    _, col, metals = _base(spark, d)
    centers = metals.select(*KEY, "line_no", "serial", "x", "y", "z")
    return metals, N.coordination(centers, A.water_toggle(col))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return C.components(_base(spark, d)[2], 5.0)


QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


@query("first_shell_coord_counts", sql("SELECT coord_string, count(*) AS n FROM coord GROUP BY coord_string", "coord"))
def first_shell_coord_counts(spark, d):
    return S.coord_string(_shell(spark, d)[1]).groupBy("coord_string").agg(F.count("*").alias("n"))


@query("altloc_collapse", sql("SELECT line_no, serial, atom_name, altloc, occ, group_ord FROM col", "col"))
def altloc_collapse(spark, d):
    return A.collapse_altloc(_lines(spark, d)).select("line_no", "serial", "atom_name", "altloc", "occ", "group_ord")


for _policy, _order in (("best_occupancy", "-occ, line_no"), ("first", "line_no")):
    QUERIES[f"altloc_collapse_{_policy}"] = lambda spark, d, p=_policy: A.collapse_altloc(_lines(spark, d), p).select("line_no", "serial", "altloc")
    ORACLES[f"altloc_collapse_{_policy}"] = sql(f"SELECT line_no, serial, altloc FROM (SELECT *, row_number() OVER (PARTITION BY structure_id, chain, resseq, icode, atom_name ORDER BY {_order}) AS k FROM atoms) WHERE k = 1", "atoms")


@query("metal_universe", sql("SELECT structure_id, element, count(*) AS n FROM metals GROUP BY structure_id, element", "metals"))
def metal_universe(spark, d):
    return _base(spark, d)[2].groupBy("structure_id", "element").agg(F.count("*").alias("n"))


@query("metals_excluded", sql("SELECT line_no, element FROM metals WHERE element <> 'FE'", "metals"))
def metals_excluded(spark, d):
    return A.metals(A.collapse_altloc(atoms(spark, d)), excluded=("FE",)).select("line_no", "element")


@query("altloc_metal_records", sql(f"SELECT structure_id, serial, atom_name, element, altloc, x, y, z FROM atoms WHERE record = 'HETATM' AND element IN ({_METALS}) AND altloc NOT IN ('', 'A')", "atoms"))
def altloc_metal_records(spark, d):
    return A.altloc_metals(atoms(spark, d)).select("structure_id", "serial", "atom_name", "element", "altloc", "x", "y", "z")


@query("best_atom", sql("SELECT structure_id, chain, resseq, atom_name, line_no, occ FROM (SELECT *, row_number() OVER (PARTITION BY structure_id, chain, resseq, atom_name ORDER BY CASE WHEN altloc IN ('', 'A') THEN 0 ELSE 1 END, CASE WHEN bfac >= 0 THEN 0 ELSE 1 END, -occ, line_no) AS k FROM atoms) WHERE k = 1", "atoms"))
def best_atom(spark, d):
    return A.best_atom(atoms(spark, d), ["structure_id", "chain", "resseq", "atom_name"]).select("structure_id", "chain", "resseq", "atom_name", "line_no", "occ")


@query("water_toggle", sql("SELECT resname, count(*) AS n FROM col WHERE element <> 'H' AND resname NOT IN ('HOH', 'WAT') GROUP BY resname", "col"))
def water_toggle(spark, d):
    return A.water_toggle(_base(spark, d)[1], False).groupBy("resname").agg(F.count("*").alias("n"))


@query("metal_pairs", sql("SELECT i, j FROM edge WHERE i < j", "edge"))
def metal_pairs(spark, d):
    return N.metal_pairs(_base(spark, d)[2], 5.0).select(F.col("a_line_no").alias("i"), F.col("b_line_no").alias("j"))


@query("metal_components", sql("SELECT line_no, root FROM root", "root"))
def metal_components(spark, d):
    return _labelled(spark, d).select("line_no", "root")


@query("cluster_types", sql("SELECT structure_id, root, n_metals, n_targets, cluster_type FROM cluster", "cluster"))
def cluster_types(spark, d):
    return C.cluster_table(_labelled(spark, d), "ZN").select("structure_id", "root", "n_metals", "n_targets", "cluster_type")


@query("cluster_centroids", sql("SELECT root, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz FROM cluster", "cluster"))
def cluster_centroids(spark, d):
    return C.cluster_table(_labelled(spark, d), "ZN").select("root", *[F.round(k, 6).alias(k) for k in ("cx", "cy", "cz")])


@query("cluster_numbering", sql("SELECT root, row_number() OVER (PARTITION BY structure_id ORDER BY root) AS cluster_number FROM cluster", "cluster"))
def cluster_numbering(spark, d):
    return C.cluster_table(_labelled(spark, d), "ZN").select("root", F.col("cluster_number").cast("long").alias("cluster_number"))


@query("sibling_targets", sql("SELECT r.serial, coalesce(string_agg(CAST(o.serial AS VARCHAR), ',' ORDER BY o.serial), '') AS siblings FROM root r LEFT JOIN root o ON o.root = r.root AND o.atom_name = 'ZN' AND o.serial <> r.serial WHERE r.atom_name = 'ZN' GROUP BY r.serial", "root"))
def sibling_targets(spark, d):
    return C.targets(_labelled(spark, d), "ZN").select("serial", F.array_join(F.col("siblings").cast("array<string>"), ",").alias("siblings"))


_OTHERS = "SELECT line_no, string_agg(el || ':' || n, ', ' ORDER BY el) AS other_metals FROM (SELECT r.line_no, o.element AS el, CAST(count(*) AS VARCHAR) AS n FROM root r JOIN root o ON o.root = r.root AND o.serial <> r.serial GROUP BY r.line_no, o.element) GROUP BY line_no"


@query("other_metals", sql(_OTHERS, "root"))
def other_metals(spark, d):
    return C.other_metals(_labelled(spark, d)).select("line_no", "other_metals")


_NEAR = "(c.x - a.x) * (c.x - a.x) + (c.y - a.y) * (c.y - a.y) + (c.z - a.z) * (c.z - a.z)"


@query("union_selection", sql(f"SELECT line_no FROM col a WHERE EXISTS (SELECT 1 FROM metals c WHERE c.structure_id = a.structure_id AND {_NEAR} <= 36.0e0)", "metals"))
def union_selection(spark, d):
    _, col, metals = _base(spark, d)
    return N.union_selection(col, metals, 6.0).select("line_no")


@query("neighbors_from", sql(f"SELECT c.line_no AS center, a.line_no AS line_no, round(sqrt({_NEAR}), 6) AS d FROM metals c JOIN col a ON c.structure_id = a.structure_id WHERE {_NEAR} <= 9.0e0", "metals"))
def neighbors_from(spark, d):
    _, col, metals = _base(spark, d)
    return N.neighbors_of(metals, col, 3.0).select(F.col("c_line_no").alias("center"), "line_no", F.round("d", 6).alias("d"))


@query("neighbors_grid", ORACLES["neighbors_from"])
def neighbors_grid(spark, d):
    _, col, metals = _base(spark, d)
    out = N.within(metals, col, 3.0, cell=3.0).withColumn("d", G.distance(G.at("c_"), G.at()))
    return out.select(F.col("c_line_no").alias("center"), "line_no", F.round("d", 6).alias("d"))


@query("residue_expansion", sql(f"SELECT line_no FROM col e WHERE EXISTS (SELECT 1 FROM col a JOIN metals c ON c.structure_id = a.structure_id WHERE {_NEAR} <= 9.0e0 AND a.structure_id = e.structure_id AND a.resname = e.resname AND a.chain = e.chain AND a.resseq = e.resseq)", "metals"))
def residue_expansion(spark, d):
    _, col, metals = _base(spark, d)
    return N.expand_by_residue(col, N.union_selection(col, metals, 3.0)).select("line_no")


@query("coordination", sql("SELECT c_line_no, line_no, element, round(d, 6) AS d FROM shell", "shell"))
def coordination(spark, d):
    return _shell(spark, d)[1].select("c_line_no", "line_no", "element", F.round("d", 6).alias("d"))


@query("shell_distances", sql("SELECT c_line_no, cn AS n, round(sigma, 6) AS sigma_d, round(delta, 6) AS delta_d FROM cov", "cov"))
def shell_distances(spark, d):
    return S.distances(_shell(spark, d)[1]).select("c_line_no", F.col("CN").alias("n"), F.round("sigma_d", 6).alias("sigma_d"), F.round("delta_d", 6).alias("delta_d"))


@query("shell_angles", sql("SELECT c_line_no, count(*) AS n, round(max(a), 4) AS top, round(avg(a), 4) AS mean FROM angle GROUP BY c_line_no", "angle"))
def shell_angles(spark, d):
    a = S.angles(_shell(spark, d)[1]).where(F.size("angles") > 0)
    return a.select("c_line_no", F.size("angles").cast("long").alias("n"), F.round(F.array_max("angles"), 4).alias("top"), F.round(F.aggregate("angles", F.lit(0.0), lambda x, y: x + y) / F.size("angles"), 4).alias("mean"))


@query("shell_planes", sql("SELECT c_line_no, round(rms_plane, 4) + 0.0e0 AS rms_plane FROM pl", "pl"))
def shell_planes(spark, d):
    return S.plane(_shell(spark, d)[1]).select("c_line_no", (F.round("RMS_plane", 4) + 0.0).alias("rms_plane"))


@query("geometry_labels", sql("SELECT c_line_no, cn AS n, label, round(sigma, 6) AS sigma_d, coalesce(round(rms, 4), 0e0) AS rms_theta, coalesce(round(dev, 4), 0e0) AS max_dev, round(rms_plane, 4) + 0.0e0 AS rms_plane FROM geo", "geo"))
def geometry_labels(spark, d):
    g = S.geometry(_shell(spark, d)[1])
    return g.select("c_line_no", F.col("CN").alias("n"), "label", F.round("sigma_d", 6).alias("sigma_d"), F.round("RMS_theta", 4).alias("rms_theta"), F.round("MAX_angle_dev", 4).alias("max_dev"), (F.round("RMS_plane", 4) + 0.0).alias("rms_plane"))


@query("coordination_summary", sql("SELECT c_line_no, element, count(*) AS n, bool_or(resname IN ('HOH', 'WAT')) AS is_water, string_agg(DISTINCT resname || ' ' || chain || ' ' || resseq || ' ' || atom_name, ';' ORDER BY resname || ' ' || chain || ' ' || resseq || ' ' || atom_name) AS residues FROM shell GROUP BY c_line_no, element", "shell"))
def coordination_summary(spark, d):
    s = S.coordination_summary(_shell(spark, d)[1])
    return s.select("c_line_no", "element", F.col("count").alias("n"), "is_water", F.array_join("residues", ";").alias("residues"))


#: Must-have elements may be in any residue with an atom so near to a metal of the cluster.
_NEAR_R = 2.5
_SELECTED = """SELECT m.line_no AS c_line_no, a.element FROM root m JOIN (SELECT DISTINCT r.structure_id, r.root, a.resname, a.chain, a.resseq FROM root r JOIN col a ON a.structure_id = r.structure_id
  AND (r.x - a.x) * (r.x - a.x) + (r.y - a.y) * (r.y - a.y) + (r.z - a.z) * (r.z - a.z) <= 6.25e0) n ON n.structure_id = m.structure_id AND n.root = m.root
  JOIN col a ON a.structure_id = n.structure_id AND a.resname = n.resname AND a.chain = n.chain AND a.resseq = n.resseq WHERE a.serial <> m.serial"""


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metals, first shells and selections, from atoms that are collapsed once and metals that are labelled once."""
    col = stored(A.collapse_altloc(atoms(spark, d)), "atoms")
    labelled = stored(C.components(A.metals(col), 5.0), "metals")
    wet = A.water_toggle(col)
    shell = N.coordination(labelled.select(*KEY, "line_no", "serial", "x", "y", "z"), wet)
    selection = S.around(labelled, S.cluster_selection(labelled, wet.select(*KEY, "serial", "element", "resname", "chain", "resseq", "x", "y", "z"), _NEAR_R))
    return labelled, shell, selection


def _must(name, text, condition):
    def run(spark, d):
        metals, shell, selection = _judged(spark, d)
        return S.verdicts(metals, shell, S.parse_must_have(text), selection=selection).where("reason is null").select("c_line_no")

    QUERIES[name] = run
    counts = ", ".join(f"count(*) FILTER (s.element = '{e}') AS {e.lower()}" for e in ("N", "S", "C", "FE"))
    n = f"SELECT m.line_no AS c_line_no, {counts} FROM metals m LEFT JOIN ({_SELECTED}) s ON s.c_line_no = m.line_no GROUP BY m.line_no"
    ORACLES[name] = sql(f"SELECT c_line_no FROM ({n}) WHERE {condition}", "shell")


_must("must_have_any", "N,S", "n > 0 OR s > 0")
_must("must_have_all", "ALL:N,S", "n > 0 AND s > 0")
_must("must_have_min", "S>=2", "s >= 2")
_must("must_have_carbon", "C>=3", "c >= 3")
_must("must_have_metal", "FE", "fe > 0")

_REQ = S.LigandRequirement(("CYS", "HIS"), 1, ("SG", "ND1", "NE2"))
_LIG = """SELECT m.line_no AS c_line_no, count(*) FILTER (s.resname IN ('CYS', 'HIS') AND s.atom_name IN ('SG', 'ND1', 'NE2')) AS k,
  count(*) FILTER (s.resname IN ('CYS', 'HIS')) AS anyk FROM metals m LEFT JOIN shell s ON s.c_line_no = m.line_no GROUP BY m.line_no"""


@query("ligand_requirements", sql(f"SELECT c_line_no FROM ({_LIG}) WHERE k = 1", "shell"))
def ligand_requirements(spark, d):
    metals, shell = _shell(spark, d)
    return S.verdicts(metals, shell, ligands=(_REQ,)).where("reason is null").select("c_line_no")


@query("ligand_diagnostics", sql(f"SELECT * FROM (SELECT c_line_no, k AS count_allowed, anyk AS count_any_resname, k <> 1 AS missing, k <> 1 AND anyk = 1 AS naming_mismatch FROM ({_LIG})) WHERE c_line_no IN (SELECT c_line_no FROM shell)", "shell"))
def ligand_diagnostics(spark, d):
    out = S.ligand_diagnostics(_shell(spark, d)[1], _REQ)
    return out.select("c_line_no", F.col("count_allowed").cast("long").alias("count_allowed"), F.col("count_any_resname").cast("long").alias("count_any_resname"), "missing", "naming_mismatch")


@query("coord_whitelist", sql("SELECT c_line_no, coord_string FROM coord WHERE coord_string IN ('1N1O', '2N', '1N')", "coord"))
def coord_whitelist(spark, d):
    metals, shell = _shell(spark, d)
    return S.verdicts(metals, shell, coord=("1N1O", "2N", "1N")).where("reason is null").select("c_line_no", "coord_string")


@query("rejection_counts", sql(f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l.nn = 0 THEN 'must_have' WHEN l.k <> 1 THEN 'ligand_requirements' WHEN coalesce(coord_string, '') NOT IN ('1N', '1N1O') THEN 'coord_string' END AS reason
  FROM (SELECT m.line_no AS c_line_no, any_value(coalesce(e.nn, 0)) AS nn, count(*) FILTER (s.resname IN ('CYS', 'HIS') AND s.atom_name IN ('SG', 'ND1', 'NE2')) AS k FROM metals m LEFT JOIN shell s ON s.c_line_no = m.line_no
    LEFT JOIN (SELECT c_line_no, count(*) FILTER (element = 'N') AS nn FROM ({_SELECTED}) GROUP BY 1) e ON e.c_line_no = m.line_no GROUP BY m.line_no) l
  LEFT JOIN coord USING (c_line_no)) WHERE reason IS NOT NULL GROUP BY reason""", "coord"))
def rejection_counts(spark, d):
    metals, shell, selection = _judged(spark, d)
    return S.rejections(S.verdicts(metals, shell, S.parse_must_have("N"), (_REQ,), ("1N", "1N1O"), selection))


@query("coord_distribution", sql("SELECT coord_string, count(*) AS n FROM coord GROUP BY coord_string ORDER BY n DESC, coord_string LIMIT 20", "coord"))
def coord_distribution(spark, d):
    c = S.coord_string(_shell(spark, d)[1]).groupBy("coord_string").agg(F.count("*").alias("n"))
    return c.orderBy(F.desc("n"), "coord_string").limit(20)


@query("sites", sql("SELECT r.line_no AS c_line_no, CAST(coalesce(g.cn, 0) AS BIGINT) AS cn, coalesce(g.label, 'UNK') AS label, coalesce(c.coord_string, '') AS coord_string, r.root, t.cluster_type FROM root r JOIN cluster t ON t.root = r.root LEFT JOIN geo g ON g.c_line_no = r.line_no LEFT JOIN coord c ON c.c_line_no = r.line_no WHERE r.atom_name = 'ZN'", "geo"))
def sites(spark, d):
    from metalith.operators.sites import SiteConfig

    out = S.sites(atoms(spark, d), SiteConfig())
    return out.select("c_line_no", F.col("CN").cast("long").alias("cn"), "label", "coord_string", "root", "cluster_type")


_NUMBERED = "(SELECT *, CAST(row_number() OVER (PARTITION BY structure_id ORDER BY root) AS INTEGER) AS num FROM cluster)"
#: Reported centres: all of a homo or multi_homo cluster, the first target of a multi_hetero one.
_REPORTED = f"""(SELECT * FROM (SELECT r.*, t.num, t.cluster_type, g.cn, g.label, g.sigma, g.delta, g.rms, g.dev, g.rms_plane, list_max(g.av) AS amax, coalesce(c.coord_string, '') AS coord_string, coalesce(o.other_metals, '') AS other_metals,
    row_number() OVER (PARTITION BY r.root ORDER BY r.line_no) AS nth FROM root r JOIN {_NUMBERED} t ON t.root = r.root LEFT JOIN geo g ON g.c_line_no = r.line_no LEFT JOIN coord c ON c.c_line_no = r.line_no
    LEFT JOIN ({_OTHERS}) o ON o.line_no = r.line_no WHERE r.atom_name = 'ZN')
  WHERE cluster_type <> 'multi_hetero' OR nth = 1)"""


@query("cluster_report", sql(f"SELECT structure_id, num AS cluster_number, cluster_type, line_no AS c_line_no, coord_string, coalesce(label, 'UNK') AS label, other_metals FROM {_REPORTED}", "geo").replace("<= 25.0e0", "<= 9.0e0"))
def cluster_report(spark, d):
    return S.cluster_rows(atoms(spark, d)).select("structure_id", "cluster_number", "cluster_type", "c_line_no", "coord_string", "label", "other_metals")


@query("altloc_report", sql(f"SELECT a.structure_id, a.serial, a.element, a.altloc, r.root FROM atoms a JOIN root r ON r.structure_id = a.structure_id AND r.chain = a.chain AND r.resseq = a.resseq AND r.icode = a.icode AND r.atom_name = a.atom_name WHERE a.record = 'HETATM' AND a.element IN ({_METALS}) AND a.altloc NOT IN ('', 'A')", "root"))
def altloc_report(spark, d):
    raw = atoms(spark, d)
    c = _labelled(spark, d).select(*KEY, *A.SITE_KEY, "root")
    return A.altloc_metals(raw).join(c, [*KEY, *A.SITE_KEY]).select("structure_id", "serial", "element", "altloc", "root")


_AA = "('ALA','ARG','ASN','ASP','CYS','GLN','GLU','GLY','HIS','ILE','LEU','LYS','MET','PHE','PRO','SER','THR','TRP','TYR','VAL')"


@query("backbone_keep_drop", sql(f"""SELECT line_no FROM col e WHERE NOT (resname IN {_AA} AND atom_name IN ('N', 'C', 'O', 'OXT')) OR EXISTS (
  SELECT 1 FROM col a JOIN col c ON c.structure_id = a.structure_id AND c.element = 'ZN' AND c.serial <> a.serial WHERE a.structure_id = e.structure_id AND a.resname = e.resname AND a.chain = e.chain AND a.resseq = e.resseq AND a.icode = e.icode
  AND a.resname IN {_AA} AND a.atom_name IN ('N', 'CA', 'C', 'O', 'OXT') AND {_NEAR} <= 9.0e0)""", "metals"))
def backbone_keep_drop(spark, d):
    return N.backbone_filtered(_base(spark, d)[1], "ZN", 3.0).select("line_no")


_RAD = "CASE {a}.element " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in COVALENT_RADII.items()) + " END"


@query("bond_graph", sql(f"SELECT a.line_no AS i, c.line_no AS j FROM col a JOIN col c ON a.structure_id = c.structure_id AND a.line_no < c.line_no WHERE a.element NOT IN ('H', 'ZN') AND c.element NOT IN ('H', 'ZN') AND sqrt({_NEAR}) BETWEEN 0.6e0 AND {_RAD.format(a='a')} + {_RAD.format(a='c')} + 0.45e0", "col"))
def bond_graph(spark, d):
    return N.bonds(_base(spark, d)[1], COVALENT_RADII).select(F.col("a_line_no").alias("i"), F.col("b_line_no").alias("j"))


@query("drop_near", sql(f"SELECT line_no FROM col a WHERE NOT (element = 'C' AND EXISTS (SELECT 1 FROM col c WHERE c.structure_id = a.structure_id AND c.element = 'ZN' AND {_NEAR} <= 4.0e0))", "col"))
def drop_near(spark, d):
    return N.drop_near(_base(spark, d)[1], "C", "ZN", 2.0).select("line_no")


@query("pocket", sql(f"SELECT c.root, count(*) AS n FROM col a JOIN (SELECT structure_id, root, cx AS x, cy AS y, cz AS z FROM cluster) c ON c.structure_id = a.structure_id WHERE {_NEAR} <= 100.0e0 GROUP BY c.root", "cluster"))
def pocket(spark, d):
    col = _base(spark, d)[1]
    t = C.cluster_table(_labelled(spark, d), "ZN").select(*KEY, "root", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    return N.pocket(col, t).groupBy(F.col("c_root").alias("root")).agg(F.count("*").alias("n"))


@query("multiplicity", sql("SELECT structure_id, CAST(sum(CASE element WHEN 'C' THEN 6 WHEN 'N' THEN 7 WHEN 'O' THEN 8 WHEN 'S' THEN 16 WHEN 'FE' THEN 26 WHEN 'ZN' THEN 30 ELSE 0 END) - 2 AS BIGINT) AS electrons, CAST((sum(CASE element WHEN 'C' THEN 6 WHEN 'N' THEN 7 WHEN 'O' THEN 8 WHEN 'S' THEN 16 WHEN 'FE' THEN 26 WHEN 'ZN' THEN 30 ELSE 0 END) - 2) % 2 + 1 AS BIGINT) AS multiplicity FROM col GROUP BY structure_id", "col"))
def multiplicity(spark, d):
    from metalith.schema import ATOMIC_NUMBERS

    z = F.create_map(*[F.lit(v) for kv in ATOMIC_NUMBERS.items() for v in kv])
    e = (F.sum(F.coalesce(F.element_at(z, F.upper("element")), F.lit(0))) - 2).cast("long")
    return _base(spark, d)[1].groupBy("structure_id").agg(e.alias("electrons"), (F.pmod(e, F.lit(2)) + 1).cast("long").alias("multiplicity"))


_YES = "CASE WHEN {} THEN 'Yes' ELSE 'No' END"


@query("cluster_csv", sql(f"""SELECT structure_id AS PDB, num AS CLUSTER, cluster_type AS CLUSTER_TYPE, serial AS CENTER_IDX, element AS CENTER_ELEM, atom_name AS CENTER_ATOMNAME, chain AS CHAIN, resseq AS RESSEQ, icode AS ICODE, resname AS RESNAME,
  altloc AS ALTLOC, occ AS OCC, coalesce(cn, 0) AS CN, coalesce(label, 'UNK') AS GEOM, coord_string AS COORD, round_even(coalesce(rms, 0), 4) AS RMS_theta, round_even(coalesce(dev, 0), 4) AS MAX_angle_dev, round_even(coalesce(sigma, 0), 4) AS sigma_d,
  round_even(coalesce(delta, 0), 4) AS delta_d, round_even(coalesce(rms_plane, 0), 4) + 0.0e0 AS RMS_plane, {_YES.format("coalesce(rms_plane <= 0.35e0, true)")} AS planar, {_YES.format("coalesce(amax >= 160, false)")} AS axial,
  {_YES.format("coalesce(label LIKE '%_d', false)")} AS distorted, {_YES.format("coalesce(cn = 6 AND delta >= 0.2e0, false)")} AS JT, other_metals AS OTHER_METALS, '' AS ALTLOC_CASE, '' AS ALTLOC_LABEL,
  concat(structure_id, '_cluster', num, '_Zn.xyz') AS XYZ_PATH, 'NA' AS RESOLUTION_A FROM {_REPORTED}""", "geo"))
def cluster_csv(spark, d):
    """All columns but h_max, whose normal SQL has no form for; a unit test holds that."""
    from metalith.operators import report

    return report.cluster_csv(atoms(spark, d), S.SiteConfig()).drop("h_max").withColumns({"CN": F.col("CN").cast("long"), "RMS_plane": F.col("RMS_plane") + 0.0})


@query("altloc_csv", sql(f"SELECT a.structure_id AS pdb_id, a.record, a.serial, a.atom_name, a.element, a.altloc, a.resname, a.chain, a.resseq, a.x, a.y, a.z, t.num AS cluster_id, t.cluster_type FROM atoms a JOIN root r ON r.structure_id = a.structure_id AND r.chain = a.chain AND r.resseq = a.resseq AND r.icode = a.icode AND r.atom_name = a.atom_name JOIN {_NUMBERED} t ON t.root = r.root WHERE a.record = 'HETATM' AND a.element IN ({_METALS}) AND a.altloc NOT IN ('', 'A')", "cluster"))
def altloc_csv(spark, d):
    from metalith.operators import report

    return report.altloc_csv(atoms(spark, d), S.SiteConfig())
