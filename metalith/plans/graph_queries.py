"""Queries on rings, shells, assignments, file names and groupings, with DuckDB SQL."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metalith.functions import geometry as G
from metalith.operators import graph as R
from metalith.operators import neighbors as N
from metalith.schema import COVALENT_RADII
from metalith.scratch import stored

from .analysis_queries import sql as residue_sql
from .site_queries import _NEAR, _RAD, KEY, _base, sql

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


_BONDS = f"SELECT a.structure_id, a.line_no AS i, c.line_no AS j FROM col a JOIN col c ON a.structure_id = c.structure_id AND a.line_no < c.line_no WHERE a.element NOT IN ('H', 'ZN') AND c.element NOT IN ('H', 'ZN') AND sqrt({_NEAR}) BETWEEN 0.6e0 AND {_RAD.format(a='a')} + {_RAD.format(a='c')} + 0.45e0"
_BOTH = f"SELECT structure_id, i, j FROM ({_BONDS}) UNION ALL SELECT structure_id, j, i FROM ({_BONDS})"


def _bonds(spark, d):
    """Collapsed atoms and their bonds, found once: rings and walks read them in every step."""
    col = _base(spark, d)[1]
    return col, stored(N.bonds(col, COVALENT_RADII).select(*KEY, F.col("a_line_no").alias("i"), F.col("b_line_no").alias("j")), "bonds")


@query("five_rings", sql(f"""SELECT CAST(a.i AS VARCHAR) || '-' || a.j || '-' || b.j || '-' || c.j || '-' || d.j AS ring FROM ({_BOTH}) a JOIN ({_BOTH}) b ON b.i = a.j JOIN ({_BOTH}) c ON c.i = b.j JOIN ({_BOTH}) d ON d.i = c.j JOIN ({_BOTH}) e ON e.i = d.j AND e.j = a.i
  WHERE a.i < a.j AND a.i < b.j AND a.i < c.j AND a.i < d.j AND a.j < d.j AND b.j <> a.j AND c.j <> a.j AND c.j <> b.j AND d.j <> a.j AND d.j <> b.j AND d.j <> c.j""", "col"))
def five_rings(spark, d):
    _, e = _bonds(spark, d)
    return R.rings(e, 5).select(F.array_join(F.col("ring").cast("array<string>"), "-").alias("ring"))


_PARTNERS = f"""WITH both_ways AS MATERIALIZED ({_BOTH}), carbon AS (SELECT DISTINCT e.i, e.j FROM both_ways e JOIN col c ON c.line_no = e.j WHERE c.element = 'C'),
  outside AS (SELECT e.i, count(*) AS k FROM both_ways e JOIN (SELECT i FROM carbon GROUP BY i HAVING count(*) >= 2) g ON g.i = e.j GROUP BY e.i),
  shared AS (SELECT p.i AS n, q.i AS partner, count(*) AS shared FROM carbon p JOIN carbon q ON q.j = p.j AND q.i <> p.i GROUP BY p.i, q.i)
  SELECT s.*, coalesce(u.k, 0) AS ku, coalesce(v.k, 0) AS kv, row_number() OVER (PARTITION BY s.n ORDER BY s.shared DESC, {_NEAR}, s.partner) AS rk
  FROM shared s JOIN col a ON a.line_no = s.n AND a.element = 'N' JOIN col c ON c.line_no = s.partner AND c.element = 'N' LEFT JOIN outside u ON u.i = s.n LEFT JOIN outside v ON v.i = s.partner"""


@query("ring_nitrogens", sql(f"SELECT n, partner, CAST(shared AS INTEGER) AS shared, CASE WHEN ku > kv OR (ku = kv AND n < partner) THEN 'ND' ELSE 'NE' END AS kind FROM ({_PARTNERS}) WHERE rk = 1", "col"))
def ring_nitrogens(spark, d):
    col, e = _bonds(spark, d)
    return R.ring_nitrogens(col, e).select("n", "partner", "shared", "kind")


@query("imidazole_ring", sql(f"SELECT c_line_no, line_no, CASE WHEN k <= 2 THEN 'adjacent' ELSE 'opposite' END AS place FROM (SELECT c.line_no AS c_line_no, a.line_no, row_number() OVER (PARTITION BY c.line_no ORDER BY {_NEAR}, a.line_no) AS k FROM metals c JOIN col a ON a.structure_id = c.structure_id AND a.line_no <> c.line_no) WHERE k <= 4", "metals"))
def imidazole_ring(spark, d):
    _, col, metals = _base(spark, d)
    return R.imidazole_ring(col, metals).select("c_line_no", "line_no", "place")


@query("first_shell_closest", sql(f"SELECT c_line_no, line_no, element, round(sqrt(q), 6) AS d FROM (SELECT c.line_no AS c_line_no, a.line_no, a.element, {_NEAR} AS q, row_number() OVER (PARTITION BY c.line_no ORDER BY {_NEAR}, a.line_no) AS k FROM metals c JOIN col a ON a.structure_id = c.structure_id AND a.line_no <> c.line_no AND a.element IN ('S', 'N')) WHERE k <= 4", "metals"))
def first_shell_closest(spark, d):
    _, col, metals = _base(spark, d)
    return R.closest(col, metals).select("c_line_no", "line_no", "element", F.round("d", 6).alias("d"))


@query("bond_reach", sql(f"""SELECT s AS start, min(hops) AS hops FROM (WITH RECURSIVE both_ways AS MATERIALIZED ({_BOTH}), walk AS (SELECT i AS s, j AS t, 1 AS hops FROM both_ways WHERE i IN (SELECT line_no FROM col WHERE element = 'S')
  UNION SELECT walk.s, b.j, walk.hops + 1 FROM walk JOIN both_ways b ON b.i = walk.t WHERE walk.hops < 4) SELECT * FROM walk)
  WHERE t IN (SELECT line_no FROM col WHERE element = 'N') GROUP BY s""", "col"))
def bond_reach(spark, d):
    col, e = _bonds(spark, d)
    return R.reachable(e, col.where("element = 'S'"), col.where("element = 'N'")).select("start", "hops")


_DEG = f"SELECT i AS line_no, count(*) AS deg FROM ({_BOTH}) GROUP BY i"


@query("hydrogen_counts", sql(f"""SELECT c.line_no, CAST(CASE WHEN resname = 'HIS' AND element = 'N' AND atom_name IN ('ND1', 'NE2') THEN CASE WHEN altloc = 'B' THEN 0 ELSE 1 END WHEN resname = 'CYS' AND element = 'S' AND atom_name = 'SG' AND altloc = 'B' THEN 0
  ELSE greatest(0, CASE element WHEN 'C' THEN 4 WHEN 'N' THEN 3 WHEN 'O' THEN 2 WHEN 'S' THEN 2 ELSE 0 END - coalesce(deg, 0)) END AS BIGINT) AS n_h FROM col c LEFT JOIN ({_DEG}) g USING (line_no)""", "col"))
def hydrogen_counts(spark, d):
    col, e = _bonds(spark, d)
    return R.hydrogens(col, e, F.col("altloc") == "B").select("line_no", "n_h")


_K = 4


@query("shell_assignment", None)
def shell_assignment(spark, d):
    """Least total squared distance of each site's four nearest N or S to its four nearest C."""
    _, col, metals = _base(spark, d)
    near = N.within(metals.where("atom_name = 'ZN'"), col, 6.0, extra=F.col("line_no") != F.col("c_line_no")).withColumn("q", G.d2(G.at("c_"), G.at()))

    def top(kinds, p):
        w = Window.partitionBy("c_line_no").orderBy("q", "line_no")
        t = near.where(F.col("element").isin(*kinds)).withColumn("r", F.row_number().over(w) - 1).where(f"r < {_K}")
        return t.select("c_line_no", F.col("r").alias("i" if p == "a_" else "j"), *[F.col(k).alias(p + k) for k in "xyz"])

    costs = top(("N", "S"), "a_").join(top(("C",), "b_"), "c_line_no").withColumn("cost", G.d2(G.at("a_"), G.at("b_")))
    return R.assignment(costs, ["c_line_no"], _K).select("c_line_no", F.round("total", 6).alias("total"))


def _cost(a: int, b: int) -> str:
    return f"(n{a}.x - c{b}.x) * (n{a}.x - c{b}.x) + (n{a}.y - c{b}.y) * (n{a}.y - c{b}.y) + (n{a}.z - c{b}.z) * (n{a}.z - c{b}.z)"


_TOP = "SELECT site, x, y, z, row_number() OVER (PARTITION BY site ORDER BY q, line_no) AS r FROM (SELECT c.line_no AS site, a.line_no, a.x, a.y, a.z, a.element, " + _NEAR + " AS q FROM metals c JOIN col a ON a.structure_id = c.structure_id AND a.line_no <> c.line_no AND " + _NEAR + " <= 36.0e0 WHERE c.atom_name = 'ZN') WHERE element {kinds}"
_JOINED = " ".join(f"JOIN (SELECT * FROM ({_TOP.format(kinds=k)}) WHERE r = {i + 1}) {p}{i} USING (site)" for p, k in (("n", "IN ('N', 'S')"), ("c", "= 'C'")) for i in range(_K)).removeprefix("JOIN ").replace(" USING (site)", "", 1)
ORACLES["shell_assignment"] = sql(f"SELECT site AS c_line_no, round(least({', '.join('(' + ' + '.join('(' + _cost(i, p[i]) + ')' for i in range(_K)) + ')' for p in permutations(range(_K)))}), 6) AS total FROM {_JOINED}", "metals")


@query("greedy_match", None)
def greedy_match(spark, d):
    col = _base(spark, d)[1]
    side = lambda p, r: col.where(f"record = '{r}'").select("structure_id", "element", F.col("line_no").alias(p + "id"), *[F.col(k).alias(p + k) for k in "xyz"])
    return R.greedy_match(side("a_", "ATOM"), side("b_", "HETATM"), ["structure_id", "element"], 2.0)


_TURNED = """SELECT line_no, a, b, c, x2 * cos(radians(c)) - y2 * sin(radians(c)) AS x, x2 * sin(radians(c)) + y2 * cos(radians(c)) AS y, z2 AS z
  FROM (SELECT *, x1 AS x2, y1 * cos(radians(b)) - z1 * sin(radians(b)) AS y2, y1 * sin(radians(b)) + z1 * cos(radians(b)) AS z2
  FROM (SELECT *, x * cos(radians(a)) + z * sin(radians(a)) AS x1, y AS y1, z * cos(radians(a)) - x * sin(radians(a)) AS z1
  FROM metals, (VALUES (-15e0), (0e0), (30e0)) t(a), (VALUES (-10e0), (20e0)) u(b), (VALUES (0e0), (45e0)) v(c)))"""


@query("rotation_grid", sql(f"SELECT line_no, a AS alpha, b AS beta, c AS gamma, round(x, 6) + 0e0 AS x, round(y, 6) + 0e0 AS y, round(z, 6) + 0e0 AS z FROM ({_TURNED})", "metals"))
def rotation_grid(spark, d):
    out = R.rotations(_base(spark, d)[2].select("line_no", "x", "y", "z"), [-15, 0, 30], [-10, 20], [0, 45])
    return out.select("line_no", "alpha", "beta", "gamma", *[(F.round(k, 6) + 0.0).alias(k) for k in "xyz"])


# -- names, groups, fallbacks -----------------------------------------------------------------------

_KNOWN = ("4cys", "3cys1his", "2cys2his", "1cys3his", "4his")


def group_rank(name: Column) -> Column:
    """Place of the first known group in a name; others last."""
    out = F.lit(len(_KNOWN))
    for i, g in reversed(list(enumerate(_KNOWN))):
        out = F.when(F.lower(name).contains(g), i).otherwise(out)
    return out


def angle_token(token: Column) -> Column:
    """``neg15`` is -15, ``15`` is 15."""
    return F.when(token.startswith("neg"), -F.substring(token, 4, 10).try_cast("double")).otherwise(token.try_cast("double"))


def markdown_cell(value: Column) -> Column:
    """A value with its pipes escaped, whole."""
    return F.replace(value, F.lit("|"), F.lit("\\|"))


def places(df: DataFrame, *by: str, name: str = "place") -> DataFrame:
    """``df`` with the place of every row in ascending order of ``by``, nulls last.

    Rows go to ranges of the order, found from a sample by hash; a place is the rank in the
    range after the counts of the ranges before, so no task orders all rows. Equal ``by`` are
    in one range and placed in any order, so ``by`` should end in an id."""
    order = [c for k in by for c in (F.col(k).isNull(), F.col(k))]
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    bins, each = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 20
    one_in = max(1, df.count() // (bins * each))
    sample = df.where(F.pmod(F.xxhash64(*by), F.lit(one_in)) == 0).agg(F.sort_array(F.collect_list(key)).alias("_keys"))
    bounds = sample.select(F.filter("_keys", lambda _, i: i % each == each - 1).alias("_bounds"))
    ranged = df.crossJoin(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b <= key))).drop("_bounds")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_rank", rank).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_rank")).drop("_range", "_rank", "_before")


@query("group_order", "SELECT c_custkey, CAST(CASE c_custkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 5 END AS INTEGER) AS rank FROM customer")
def group_order(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    name = F.concat(F.lit("plots/"), F.element_at(F.array(*map(F.lit, (*_KNOWN, "rest"))), (F.col("c_custkey") % 6 + 1).cast("int")), F.lit("_x.png"))
    return c.select("c_custkey", group_rank(name).alias("rank"))


@query("angle_scan", "SELECT c_custkey, CAST(c_custkey % 31 - 15 AS DOUBLE) AS alpha, CAST(c_custkey % 7 AS DOUBLE) AS beta FROM customer")
def angle_scan(spark, d):
    """Angles read from folder names such as ``alpha_neg15_beta_3``."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    a, b = F.col("c_custkey") % 31 - 15, F.col("c_custkey") % 7
    name = F.concat(F.lit("alpha_"), F.when(a < 0, F.concat(F.lit("neg"), (-a).cast("string"))).otherwise(a.cast("string")), F.lit("_beta_"), b.cast("string"))
    part = lambda k: angle_token(F.regexp_extract(name, k + "_((?:neg)?[0-9]+)", 1))
    return c.select("c_custkey", part("alpha").alias("alpha"), part("beta").alias("beta"))


@query("volume_order", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_name, c_custkey) AS place FROM customer")
def volume_order(spark, d):
    """The place of every row."""
    return places(spark.read.parquet(f"{d}/customer.parquet"), "c_acctbal", "c_name", "c_custkey").select("c_custkey", "place")


@query("pair_match", "SELECT c.c_custkey, min(s.s_suppkey) AS s_suppkey FROM customer c JOIN supplier s ON s.s_nationkey = c.c_nationkey GROUP BY c.c_custkey")
def pair_match(spark, d):
    """Each model with the first experiment of its key."""
    c, s = spark.read.parquet(f"{d}/customer.parquet"), spark.read.parquet(f"{d}/supplier.parquet")
    first = s.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("s_suppkey"))
    return c.join(first, "c_nationkey").select("c_custkey", "s_suppkey")


@query("sequence_means", residue_sql("SELECT n, count(*) AS sites, round(avg(m), 6) AS mean FROM (SELECT site, count(*) AS n, avg(sqrt(sg.d2)) AS m FROM cys WHERE rk <= 4 GROUP BY site) GROUP BY n", "cys"))
def sequence_means(spark, d):
    from metalith.operators import residues as RS

    from .analysis_queries import _around

    m = RS.cys_distances(_around(spark, d), ["site"]).groupBy("site").agg(F.count("*").alias("n"), F.avg("d_sg").alias("m"))
    return m.groupBy("n").agg(F.count("*").alias("sites"), F.round(F.avg("m"), 6).alias("mean"))


@query("json_metadata", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_metadata(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("markdown_escape", r"SELECT doc_id, replace(text, '|', '\|') AS cell FROM documents")
def markdown_escape(spark, d):
    """Whole texts with their pipes escaped."""
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", markdown_cell(F.col("text")).alias("cell"))


@query("dw_nearest_summary", "SELECT l_suppkey % 7 AS source, count(*) AS n, CAST(sum(l_partkey % 4001) AS DOUBLE) / 1000e0 / count(*) AS mean FROM lineitem WHERE l_linenumber % 3 = 0 GROUP BY l_suppkey % 7")
def dw_nearest_summary(spark, d):
    """First-shell distances of Debye-Waller texts, per source."""
    from metalith.operators import spectra as P
    from metalith.sources import xyz as X

    i = spark.read.parquet(f"{d}/lineitem.parquet")
    group = F.when(F.col("l_linenumber") % 3 == 0, F.when(F.col("l_orderkey") % 2 == 0, "nearest").otherwise("Nearest")).otherwise("far")
    text = F.format_string("%s N 0.0 0.0 0.0 %.3f 0.004 %d", group, (F.col("l_partkey") % 4001).cast("double") / 1000, F.col("l_linenumber"))
    lines = i.select((F.col("l_suppkey") % 7).alias("source"), F.col("l_orderkey").alias("line_no"), text.alias("line"))
    return P.value_summary(X.nearest_rows(X.parse_dw(lines)), "source", "distance").select("source", "n", "mean")


@query("scan_group", "SELECT c_custkey, CAST(c_custkey % 3 - 1 AS DOUBLE) AS alpha, CAST(c_custkey % 5 - 2 AS DOUBLE) AS beta, CAST(c_custkey % 7 - 3 AS DOUBLE) AS gamma FROM customer WHERE c_custkey % 5 <> 2 OR (c_custkey % 3 = 1 AND c_custkey % 7 = 3)")
def scan_group(spark, d):
    """Rows turned about beta, and those not turned at all."""
    from metalith.operators import scans

    k = F.col("c_custkey")
    angles = [(k % m - m // 2).cast("double").alias(a) for m, a in ((3, "alpha"), (5, "beta"), (7, "gamma"))]
    return scans.scan_group(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", *angles), "beta")
