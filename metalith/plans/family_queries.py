"""Queries on families of sites, file names, metadata and sinks, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from metalith.operators import atoms as A
from metalith.operators import bfactor as B
from metalith.operators import clusters as C
from metalith.operators import families as Y
from metalith.operators import neighbors as N
from metalith.operators import report
from metalith.operators import residues as R
from metalith.sources import metadata as M
from metalith.sources import names, xyz

from .analysis_queries import _DET, BY, _tor
from .analysis_queries import ORACLES as _ANALYSIS
from .analysis_queries import QUERIES as _ANALYSED
from .analysis_queries import sql as near_sql
from .site_queries import KEY, _base, _labelled
from .site_queries import sql as site_sql

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str):
    def put(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return put


def after(head: str, body: str, **more: str) -> str:
    """``body`` after a list of common parts and ``more``."""
    return head.rstrip() + "".join(f", {k} AS ({v})" for k, v in more.items()) + " " + body


def _zinc(spark, d):
    """Sites: zinc atoms by line."""
    return _base(spark, d)[2].where("atom_name = 'ZN'")


def _near(spark, d):
    return R.around(_zinc(spark, d), _base(spark, d)[1], KEY, 8.0)


# -- sequences and structures of sites --------------------------------------------------------------

_SITES = "SELECT line_no AS site FROM metals WHERE atom_name = 'ZN'"
_STRINGS = {
    "sec": _ANALYSIS["secstruct_interval"][_ANALYSIS["secstruct_interval"].index("SELECT r.structure_id, r.chain, r.resi") :],
    "ca": """SELECT n.site, n.chain, n.resi, arg_min(left(n.resname, 1), n.line_no) AS l, arg_min(CASE s.sec WHEN 'HELIX' THEN 'H' WHEN 'SHEET' THEN 'S' WHEN 'LOOP' THEN 'L' ELSE '?' END, n.line_no) AS s
      FROM ar n JOIN metals m ON m.line_no = n.site JOIN sec s ON s.structure_id = m.structure_id AND s.chain = n.chain AND s.resi = n.resi WHERE n.atom_name = 'CA' GROUP BY n.site, n.chain, n.resi""",
    "strings": """SELECT site, CASE WHEN count(*) = 1 THEN min(p) ELSE string_agg('(' || p || ')', '' ORDER BY chain) END AS sequence, CASE WHEN count(*) = 1 THEN min(s) ELSE string_agg('(' || s || ')', '' ORDER BY chain) END AS secstruct
      FROM (SELECT site, chain, string_agg(CASE WHEN resi - prev > 1 THEN 'x' || (resi - prev - 1) ELSE '' END || l, '' ORDER BY resi) AS p, string_agg(s, '' ORDER BY resi) AS s
        FROM (SELECT *, lag(resi) OVER (PARTITION BY site, chain ORDER BY resi) AS prev FROM ca) GROUP BY site, chain) GROUP BY site""",
}


def _strings(spark, d):
    sec = _ANALYSED["secstruct_interval"](spark, d)
    atoms = _base(spark, d)[1].join(sec, ["structure_id", "chain", "resi"])
    return Y.site_strings(R.around(_zinc(spark, d), atoms, KEY, 8.0), BY)


@query("site_strings", after(near_sql("", "ar"), "SELECT * FROM strings", **_STRINGS))
def site_strings(spark, d):
    """Sequence and structure string of each site."""
    return _strings(spark, d)


@query("sequence_report", after(
    near_sql("", "ar"),
    "SELECT sequence, CAST(sum(k) AS BIGINT) AS n, sequence || ' ' || CAST(sum(k) AS VARCHAR) || ' ' || string_agg(secstruct || ':' || k, ', ' ORDER BY secstruct) AS line FROM (SELECT sequence, secstruct, count(*) AS k FROM strings GROUP BY ALL) GROUP BY sequence",
    **_STRINGS))
def sequence_report(spark, d):
    """The report of sequences and their structures, a line each."""
    return Y.sequence_report(_strings(spark, d))


_FOUR = f"""SELECT p.site, {_DET} AS volume, (sqrt(p.q) + sqrt(q.q) + sqrt(r.q) + sqrt(s.q)) / 4 AS mean_d FROM (SELECT site, q, rk, ca AS a FROM lig) p JOIN (SELECT site, q, rk, ca AS b FROM lig) q USING (site) JOIN (SELECT site, q, rk, ca AS c FROM lig) r USING (site)
  JOIN (SELECT site, q, rk, ca AS d FROM lig) s USING (site) WHERE p.rk = 1 AND q.rk = 2 AND r.rk = 3 AND s.rk = 4"""


def _volumes(spark, d):
    near = _near(spark, d)
    distances = R.ligands(near, BY).groupBy(*BY).agg(F.count("*").alias("n"), F.avg(F.sqrt("q")).alias("mean_d"))
    return R.tetra_volume(near, BY), distances


@query("family_means", after(
    near_sql("", "lig"),
    "SELECT sequence, count(*) AS n, count(volume) AS measured, round(avg(volume), 6) AS volume, round(avg(mean_d), 6) AS mean_d FROM strings LEFT JOIN four USING (site) GROUP BY sequence",
    four=_FOUR, **_STRINGS))
def family_means(spark, d):
    """Mean volume and distance of each sequence."""
    out = Y.sequence_means(_strings(spark, d), *_volumes(spark, d), BY)
    return out.select("sequence", "n", "measured", F.round("volume", 6).alias("volume"), F.round("mean_d", 6).alias("mean_d"))


@query("volume_consistency", after(
    near_sql("", "lig"),
    "SELECT secstruct, count(*) AS n, round(max(volume) - min(volume), 6) AS spread, max(volume) - min(volume) <= 1e-12 AS same FROM strings JOIN four USING (site) GROUP BY secstruct",
    four=_FOUR, **_STRINGS))
def volume_consistency(spark, d):
    """Spread of volumes among sites of one structure string."""
    rows = _strings(spark, d).join(_volumes(spark, d)[0], BY)
    return Y.consistency(rows, ["secstruct"], "volume").withColumn("spread", F.round("spread", 6))


@query("distance_consistency", after(
    near_sql("", "his"),
    "SELECT secstruct, count(*) AS n, round(max(m) - min(m), 6) AS spread, max(m) - min(m) <= 1e-12 AS same FROM strings JOIN means USING (site) GROUP BY secstruct",
    means="""SELECT site, avg(sqrt(q)) AS m FROM (SELECT site, q, row_number() OVER (PARTITION BY site ORDER BY q, chain, resseq) AS k
      FROM (SELECT site, chain, resseq, sg.d2 AS q FROM cys UNION ALL SELECT site, chain, resseq, n.d2 FROM his)) WHERE k <= 4 GROUP BY site""",
    **_STRINGS))
def distance_consistency(spark, d):
    """Spread of mean distances among sites of one structure string."""
    rows = _strings(spark, d).join(R.mean_distance(_near(spark, d), BY), BY)
    return Y.consistency(rows, ["secstruct"], "mean_d").withColumn("spread", F.round("spread", 6))


# -- donors and residues ----------------------------------------------------------------------------

_FLAGGED = {
    "bound": "SELECT DISTINCT a.line_no FROM col a JOIN metals m ON m.structure_id = a.structure_id AND m.line_no <> a.line_no AND (a.x - m.x) * (a.x - m.x) + (a.y - m.y) * (a.y - m.y) + (a.z - m.z) * (a.z - m.z) <= 16e0",
    "rings": """SELECT site, chain, resseq, max(CASE WHEN atom_name = 'ND1' THEN d2 END) AS nd, max(CASE WHEN atom_name = 'NE2' THEN d2 END) AS ne,
      coalesce(bool_or(b.line_no IS NOT NULL) FILTER (atom_name = 'ND1'), false) AS fd, coalesce(bool_or(b.line_no IS NOT NULL) FILTER (atom_name = 'NE2'), false) AS fe
      FROM fa LEFT JOIN bound b USING (line_no) WHERE resname = 'HIS' AND atom_name IN ('ND1', 'NE2') GROUP BY site, chain, resseq""",
    "named": "SELECT *, CASE WHEN fd THEN 'ND1' WHEN fe THEN 'NE2' WHEN ne IS NULL OR nd <= ne THEN 'ND1' ELSE 'NE2' END AS n_name FROM rings",
    "donors": "SELECT * FROM (SELECT site, chain, resseq, n_name, q, row_number() OVER (PARTITION BY site ORDER BY q, chain, resseq) AS rk FROM (SELECT *, CASE n_name WHEN 'ND1' THEN nd ELSE ne END AS q FROM named)) WHERE rk <= 4",
}


def _flagged(spark, d):
    """Histidine donors, nitrogens within 4 A of any metal before the nearer ones."""
    _, col, metals = _base(spark, d)
    hit = N.within(metals, col, 4.0, extra=F.col("line_no") != F.col("c_line_no")).select(*KEY, "line_no").distinct().withColumn("bound", F.lit(True))
    near = R.around(_zinc(spark, d), col.join(hit, [*KEY, "line_no"], "left"), KEY, 8.0)
    return Y.flagged_donors(near, BY, "bound")


@query("flagged_donors", after(near_sql("", "fa"), "SELECT site, chain, resseq, n_name, round(sqrt(q), 6) + 0e0 AS d_n FROM donors", **_FLAGGED))
def flagged_donors(spark, d):
    return _flagged(spark, d).select("site", "chain", "resseq", "n_name", (F.round("d_n", 6) + 0.0).alias("d_n"))


_LIST = "coalesce(string_agg(printf('%.6f', sqrt(q)), ',' ORDER BY q) FILTER (n_name = '{}'), '') AS {}"


@query("donor_split", after(near_sql("", "fa"), f"SELECT site, {_LIST.format('ND1', 'nd1')}, {_LIST.format('NE2', 'ne2')} FROM donors GROUP BY site", **_FLAGGED))
def donor_split(spark, d):
    """Distances by the donor that was chosen."""
    text = lambda c: F.array_join(F.transform(c, lambda v: F.format_string("%.6f", v)), ",").alias(c)
    return Y.by_donor(_flagged(spark, d), BY).select("site", text("nd1"), text("ne2"))


_BINS = "SELECT '{k}' AS kind, CAST(v AS INTEGER) AS value, (SELECT count(*) FROM per WHERE {k} = v) AS n FROM range(5) r(v)"


@query("donor_bincount", after(
    near_sql("", "fa"), " UNION ALL ".join(_BINS.format(k=k) for k in ("ND1", "NE2")), **_FLAGGED,
    per=f"SELECT s.site, count(*) FILTER (n_name = 'ND1') AS ND1, count(*) FILTER (n_name = 'NE2') AS NE2 FROM ({_SITES}) s LEFT JOIN donors USING (site) GROUP BY s.site"))
def donor_bincount(spark, d):
    """How many sites have 0 to 4 donors of each kind."""
    return Y.donor_bincount(_flagged(spark, d), _zinc(spark, d).select(F.col("line_no").alias("site")), BY)


@query("his_torsions", near_sql(f"SELECT site, chain, resseq, {_tor(None, 'n', 'cg', 'ca')} AS torsion FROM his WHERE rk <= 4", "his"))
def his_torsions(spark, d):
    return R.his_angles(_near(spark, d), BY).select("site", "chain", "resseq", (F.round("torsion", 4) + 0.0).alias("torsion"))


@query("all_ca_pairs", near_sql("SELECT a.site, a.line_no AS i, b.line_no AS j, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 6) AS d FROM ar a JOIN ar b ON a.site = b.site AND a.line_no < b.line_no WHERE a.atom_name = 'CA' AND b.atom_name = 'CA'", "ar"))
def all_ca_pairs(spark, d):
    return Y.all_ca_pairs(_near(spark, d), BY).withColumn("d", F.round("d", 6))


@query("completeness", after(
    near_sql("", "ar"), "SELECT count(*) AS sites, count(*) FILTER (k <> 4) AS outliers, count(*) FILTER (k = 3) AS one_less, count(*) FILTER (k = 5) AS one_more FROM (SELECT s.site, coalesce(c.k, 0) AS k FROM sites s LEFT JOIN whole c USING (site))",
    sites=_SITES, whole="SELECT site, count(*) FILTER (f = 3) AS k FROM (SELECT site, chain, resseq, count(DISTINCT atom_name) FILTER (atom_name IN ('CA', 'CB', 'SG')) AS f FROM ar WHERE resname = 'CYS' GROUP BY ALL) GROUP BY site"))
def completeness(spark, d):
    """Sites by their complete cysteines, those without any too."""
    return Y.completeness(R.complete_cysteines(_near(spark, d), BY), _zinc(spark, d).select(F.col("line_no").alias("site")), BY)


@query("metric_summary_all", after(
    near_sql("", "cys"), "SELECT 'd_sg' AS key, CAST(sum(k) AS BIGINT) AS n, round(min(lo), 6) AS min, round(max(hi), 6) AS max, round(sum(t) / sum(k), 6) AS mean, (SELECT count(*) FROM sites) - count(*) FILTER (k >= 4) AS short_sources FROM per",
    sites=_SITES, per="SELECT site, count(*) AS k, min(sqrt(sg.d2)) AS lo, max(sqrt(sg.d2)) AS hi, sum(sqrt(sg.d2)) AS t FROM cys WHERE rk <= 4 GROUP BY site"))
def metric_summary_all(spark, d):
    """Cysteine distances, sites without any counted as short of them."""
    m = R.cys_distances(_near(spark, d), BY).select(F.lit("d_sg").alias("key"), F.col("site").alias("source"), F.col("d_sg").alias("value"))
    out = R.metric_summary(m, 4, _zinc(spark, d).select(F.col("line_no").alias("source")))
    return out.select("key", "n", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean")], "short_sources")


@query("metric_fallback", after(
    near_sql("", "cys"), "SELECT site, round(sqrt(sg.d2), 6) AS value, 'tagged' AS origin FROM cys WHERE rk <= 4 UNION ALL SELECT site, round(sqrt(q), 6), 'inferred' FROM sulphur WHERE k <= 4 AND site NOT IN (SELECT site FROM cys)",
    sulphur="SELECT site, x * x + y * y + z * z AS q, row_number() OVER (PARTITION BY site ORDER BY x * x + y * y + z * z, line_no) AS k FROM ar WHERE element = 'S'"))
def metric_fallback(spark, d):
    """Cysteine distances by atom names; by the element where a site has none."""
    near = _near(spark, d)
    tagged = R.cys_distances(near, BY).select("site", F.col("d_sg").alias("value"))
    plain = R.nearest(near.where("element = 'S'"), BY, F.col("d2")).select("site", F.sqrt("d2").alias("value"))
    return Y.filled(tagged, plain, BY).withColumn("value", F.round("value", 6))


# -- sinks and spectra ------------------------------------------------------------------------------


@query("written_index", site_sql("SELECT line_no, CAST(row_number() OVER (PARTITION BY structure_id ORDER BY line_no) - 1 AS INTEGER) AS index FROM col", "col"))
def written_index(spark, d):
    """The place of an atom in its structure's text."""
    return A.number_in_order(_base(spark, d)[1], KEY, ["line_no"], "index").select("line_no", "index")


@query("run_cache", site_sql("""SELECT structure_id AS pdb_id, 'ZN' AS target, 5e0 AS cutoff, 6e0 AS selection_radius, string_agg(structure_id || '_' || k, ',' ORDER BY structure_id || '_' || k) AS paths
  FROM (SELECT structure_id, row_number() OVER (PARTITION BY structure_id ORDER BY root) AS k FROM cluster) GROUP BY structure_id""", "cluster"))
def run_cache(spark, d):
    """One record per structure: parameters and the paths of its clusters."""
    out = report.run_cache(C.cluster_table(_labelled(spark, d), "ZN"), "ZN", 5.0, 6.0)
    return out.select("pdb_id", "target", "cutoff", "selection_radius", F.array_join("clusters.xyz_path", ",").alias("paths"))


@query("spectrum_points", site_sql("SELECT structure_id AS source, occ AS k, arg_min(bfac, line_no) AS chi FROM col WHERE resname <> 'GLY' GROUP BY structure_id, occ", "col"))
def spectrum_points(spark, d):
    """Points of spectrum texts, in two columns or in six, comments left out."""
    rows = _base(spark, d)[1]
    wide = F.format_string("  %d 0.5 %.2f 1 2 %.2f", "serial", "occ", "bfac")
    text = F.when(F.col("chain") == "A", wide).otherwise(F.format_string("%.2f\t%.2f", "occ", "bfac"))
    line = F.when(F.col("resname") == "GLY", F.concat(F.lit(" # "), text)).otherwise(text)
    return xyz.parse_spectrum(rows.select(F.col("structure_id").alias("source"), "line_no", line.alias("line")))


# -- names and metadata -----------------------------------------------------------------------------


def _stem():
    """Names from clients: words, a token that is an id for most, cluster, variant."""
    none = F.lit(None).cast("string")
    return F.concat(
        F.concat_ws(
            "-", F.replace("name", F.lit(" "), F.lit("-")), F.when(F.col("city").startswith("P"), "XXXX"), F.substring(F.md5(F.col("client_id").cast("string").cast("binary")), 1, 4),
            F.when(F.col("nation_id") > 5, F.concat(F.lit("cluster"), F.col("nation_id").cast("string"))), F.when(F.col("balance") < 2000, "h-only").otherwise(none), F.when(F.col("balance") < 500, "w-n").when(F.col("balance") > 6000, F.col("segment")),
        ),
        F.when(F.col("source") == "web", "_w_dw").otherwise(""),
    )


_STEM = """concat(concat_ws('-', replace(name, ' ', '-'), CASE WHEN starts_with(city, 'P') THEN 'XXXX' END, left(md5(CAST(client_id AS VARCHAR)), 4), CASE WHEN nation_id > 5 THEN 'cluster' || nation_id END,
  CASE WHEN balance < 2000 THEN 'h-only' END, CASE WHEN balance < 500 THEN 'w-n' WHEN balance > 6000 THEN segment END), CASE WHEN source = 'web' THEN '_w_dw' ELSE '' END)"""
_PARTS = f"""WITH s AS (SELECT client_id, updated_at, {_STEM} AS stem FROM clients), b AS (SELECT *, CASE WHEN ends_with(stem, '_w_dw') THEN left(stem, length(stem) - 5) ELSE stem END AS base FROM s),
  t AS (SELECT *, array_to_string(list_filter(string_split(base, '-'), lambda x: x <> '' AND lower(x) <> 'xxxx'), '-') AS clean FROM b),
  u AS (SELECT *, regexp_extract(clean, '^((?:.*?-)??([0-9][A-Za-z0-9]{{3}})(?:-(?:cluster([0-9]+)))?)(?:-(.*))?$', ['left', 'id', 'cluster', 'rest']) AS m, regexp_extract(clean, '^(.*?)(?:-(h-only-w-n|h-only|w-n))?$', ['bare', 'variant']) AS v FROM t),
  p AS (SELECT client_id, updated_at, CASE WHEN clean = '' THEN base WHEN m.id <> '' THEN m."left" ELSE v.bare END AS prefix, CASE WHEN m.id <> '' THEN lower(m.id) END AS pdb_id, CASE WHEN m.id <> '' AND m.cluster <> '' THEN m.cluster END AS cluster, CASE WHEN clean = '' THEN '' WHEN m.id <> '' THEN m.rest ELSE v.variant END AS suffix FROM u)"""


def _parts(spark, d):
    c = spark.read.parquet(f"{d}/clients.parquet").withColumn("p", names.stem_parts(_stem()))
    return c.select("client_id", "updated_at", "p.prefix", F.col("p.id").alias("pdb_id"), "p.cluster", "p.suffix")


@query("file_name_parts", f"{_PARTS} SELECT client_id, prefix, pdb_id, cluster, suffix FROM p")
def file_name_parts(spark, d):
    """Prefix, id, cluster and variant of file stems."""
    return _parts(spark, d).drop("updated_at")


@query("suffix_order", f"{_PARTS} SELECT suffix, count(*) AS n, CAST(CASE WHEN lower(suffix) LIKE 'h-only%' THEN 0 WHEN suffix = '' THEN 1 ELSE 2 END AS INTEGER) AS rank FROM p GROUP BY suffix")
def suffix_order(spark, d):
    """Variants, how many names have them, and their rank."""
    return _parts(spark, d).groupBy("suffix").agg(F.count("*").alias("n")).withColumn("rank", names.suffix_key(F.col("suffix"))["rank"])


_META = M.Paths("$.device.os", "$.device.ver", "$.k", ("$.items", "$.sku"))
_GOOD = "CASE WHEN json_valid(props) THEN {} END"


@query("entry_metadata", f"""SELECT click_id, {_GOOD.format("coalesce(trim(json_extract_string(props, '$.device.os')), 'N/A')")} AS title, {_GOOD.format("coalesce(trim(json_extract_string(props, '$.device.ver')), 'N/A')")} AS classification,
  {_GOOD.format("coalesce(nullif(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '; '), ''), 'N/A')")} AS organism, {_GOOD.format("coalesce(left(json_extract_string(props, '$.k'), 10), 'N/A')")} AS deposit_date
  FROM (SELECT *, CASE WHEN json_valid(props) THEN json_extract_string(props, '$.items[*].sku') END AS l FROM clicks)""")
def entry_metadata(spark, d):
    """Values, names and dates of JSON answers, broken ones without any."""
    clicks = spark.read.parquet(f"{d}/clicks.parquet").select("click_id", "props")
    return M.entry_metadata(clicks, "props", _META)


_CODE = "'9' || left(md5(CAST({} AS VARCHAR)), 3)"


@query("annotated_names", site_sql(f"""SELECT r.structure_id, 'Found:' || string_agg(chr(10) || '- `' || r.code || '_ZN_' || r.chain || '.xyz`' || CASE WHEN i.code IS NULL THEN ' — *metadata unavailable*' ELSE ' — **' || coalesce(replace(i.name, ' ', '\\|'), 'N/A') || '**; Classification: ' || coalesce(i.brand, 'N/A')
  || '; Organism: ' || coalesce(i.kind, 'N/A') || '; Deposited: ' || CAST(i.price AS VARCHAR) END, '' ORDER BY r.chain) || chr(10) || 'end' AS text FROM (SELECT DISTINCT structure_id, chain, {_CODE.format('structure_id')} AS code FROM col) r
  LEFT JOIN (SELECT {_CODE.format('item_id')} AS code, min(name) AS name, min(brand) AS brand, min(kind) AS kind, CAST(count(*) AS VARCHAR) AS price FROM items GROUP BY 1) i ON i.code = r.code GROUP BY r.structure_id""", "col"))
def annotated_names(spark, d):
    """Lists of a structure's files with what is known of each entry."""
    code = lambda c: F.concat(F.lit("9"), F.substring(F.md5(F.col(c).cast("string").cast("binary")), 1, 3))
    col = _base(spark, d)[1]
    lines = F.transform(F.sort_array(F.collect_set("chain")), lambda c: F.concat(F.lit("\n- `"), code("structure_id"), F.lit("_ZN_"), c, F.lit(".xyz`")))
    texts = col.groupBy("structure_id").agg(F.concat(F.lit("Found:"), F.array_join(lines, ""), F.lit("\nend")).alias("text"))
    items = spark.read.parquet(f"{d}/items.parquet").withColumn("entry_id", code("item_id"))
    values = {"title": F.replace(F.min("name"), F.lit(" "), F.lit("|")), "classification": F.min("brand"), "organism": F.min("kind"), "deposit_date": F.count("*").cast("string")}
    return M.annotated(texts, "structure_id", "text", items.groupBy("entry_id").agg(*[v.alias(k) for k, v in values.items()]))
