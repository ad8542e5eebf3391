"""Residue analytics around an absorber: nearest residues, angles, torsions, sequences.

Input rows are atoms relative to a centre: ``by`` names the site, ``d2`` is the squared
distance to it. An imidazole's donor is the nearer of ND1 and NE2, one flagged as
coordinating before the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metalith.functions import geometry as G
from metalith.schema import ONE_LETTER

POINT = ("x", "y", "z")


def around(centers: DataFrame, atoms: DataFrame, structure: list[str], radius: float) -> DataFrame:
    """Atoms within the radius of each centre, moved so that the centre is the origin."""
    from .neighbors import within

    out = within(centers, atoms, radius, extra=F.col("line_no") != F.col("c_line_no"))
    moved = {k: F.col(k) - F.col("c_" + k) for k in POINT}
    out = out.withColumns(moved)
    return out.select(*structure, F.col("c_line_no").alias("site"), *[c for c in atoms.columns if c not in structure]).withColumn("d2", G.dot(G.at(), G.at()))


def residues(atoms: DataFrame, by: list[str], resname: str, names: tuple[str, ...], extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per residue with the first atom of each name, as a struct with the columns ``extra``."""
    atom = F.struct("x", "y", "z", "d2", *extra)
    return atoms.where(F.upper("resname") == resname).groupBy(*by, "chain", "resseq", "icode").agg(
        *[F.min_by(atom, F.when(F.col("atom_name") == n, F.col("line_no"))).alias(n) for n in names]
    )


def donor(residue: DataFrame, flags: tuple[str, str] | None = None) -> DataFrame:
    """``N`` and ``n_name``: the nearer of ND1 and NE2, ND1 on ties; a flagged one first."""
    far = F.lit(float("inf"))
    nd, ne = F.coalesce(F.col("ND1.d2"), far), F.coalesce(F.col("NE2.d2"), far)
    first = nd <= ne
    if flags:
        a, b = F.coalesce(F.col(flags[0]), F.lit(False)), F.coalesce(F.col(flags[1]), F.lit(False))
        first = F.when(a, True).when(b, False).otherwise(first)
    some = F.col("ND1").isNotNull() | F.col("NE2").isNotNull()
    name = F.when(some, F.when(first, "ND1").otherwise("NE2"))
    return residue.withColumn("n_name", name).withColumn("N", F.when(F.col("n_name") == "ND1", F.col("ND1")).when(F.col("n_name") == "NE2", F.col("NE2")))


def nearest(df: DataFrame, by: list[str], d2: Column, k: int = 4) -> DataFrame:
    """The k rows of each group with the smallest d2; ties by chain, number."""
    w = Window.partitionBy(*by).orderBy(d2, "chain", "resseq", "icode")
    return df.where(d2.isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cys_distances(atoms: DataFrame, by: list[str], k: int = 4) -> DataFrame:
    """Distances of the k nearest cysteines by SG."""
    r = nearest(residues(atoms, by, "CYS", ("SG", "CB", "CA")), by, F.col("SG.d2"), k)
    o = lambda n: F.sqrt(F.col(n + ".d2"))
    d = lambda a, b: G.distance(G.of(F.col(a)), G.of(F.col(b)))
    return r.select(*by, "chain", "resseq", "rank", o("SG").alias("d_sg"), o("CB").alias("d_cb"), o("CA").alias("d_ca"), d("SG", "CA").alias("sg_ca"), d("CB", "CA").alias("cb_ca"), d("SG", "CB").alias("sg_cb"))


def his_distances(atoms: DataFrame, by: list[str], k: int = 4) -> DataFrame:
    r = donor(residues(atoms, by, "HIS", ("ND1", "NE2")))
    return nearest(r, by, F.col("N.d2"), k).select(*by, "chain", "resseq", "rank", "n_name", F.sqrt("N.d2").alias("d_n"))


def cys_angles(atoms: DataFrame, by: list[str], k: int = 4) -> DataFrame:
    """Angles of direction vectors (origin to SG with SG to CB, SG to CB with CB to CA) and
    the torsion origin-SG-CB-CA."""
    r = nearest(residues(atoms, by, "CYS", ("SG", "CB", "CA")), by, F.col("SG.d2"), k)
    zero = (F.lit(0.0),) * 3
    sg, cb, ca = (G.of(F.col(n)) for n in ("SG", "CB", "CA"))
    return r.select(*by, "chain", "resseq", G.angle(sg, G.minus(cb, sg)).alias("zn_sg_cb"), G.angle(G.minus(cb, sg), G.minus(ca, cb)).alias("sg_cb_ca"), G.dihedral(zero, sg, cb, ca).alias("torsion"))


def his_angles(atoms: DataFrame, by: list[str], k: int = 4) -> DataFrame:
    """Vertex angles at the donor, CG and CB, and the torsion origin-N-CG-CA."""
    r = nearest(donor(residues(atoms, by, "HIS", ("ND1", "NE2", "CG", "CB", "CA"))), by, F.col("N.d2"), k)
    zero = (F.lit(0.0),) * 3
    n, cg, cb, ca = (G.of(F.col(x)) for x in ("N", "CG", "CB", "CA"))
    return r.select(*by, "chain", "resseq", "n_name", G.vertex_angle(zero, n, cg).alias("zn_n_cg"), G.vertex_angle(n, cg, cb).alias("n_cg_cb"), G.vertex_angle(cg, cb, ca).alias("cg_cb_ca"), G.dihedral(zero, n, cg, ca).alias("torsion"))


def mean_distance(atoms: DataFrame, by: list[str], k: int = 4) -> DataFrame:
    """Mean of the k nearest SG or donor distances; sites without any are absent."""
    c = residues(atoms, by, "CYS", ("SG",)).select(*by, "chain", "resseq", "icode", F.col("SG.d2").alias("q"))
    h = donor(residues(atoms, by, "HIS", ("ND1", "NE2"))).select(*by, "chain", "resseq", "icode", F.col("N.d2").alias("q"))
    return nearest(c.unionByName(h), by, F.col("q"), k).groupBy(*by).agg(F.avg(F.sqrt("q")).alias("mean_d"), F.count("*").alias("n"))


def ligands(atoms: DataFrame, by: list[str], k: int = 4) -> DataFrame:
    """The k nearest CYS and HIS residues that have a CA, with their class (CYS, ND1, NE2)."""
    c = residues(atoms, by, "CYS", ("SG", "CA")).select(*by, "chain", "resseq", "icode", F.lit("CYS").alias("kind"), F.col("SG.d2").alias("q"), "CA")
    h = donor(residues(atoms, by, "HIS", ("ND1", "NE2", "CA"))).select(*by, "chain", "resseq", "icode", F.col("n_name").alias("kind"), F.col("N.d2").alias("q"), "CA")
    return nearest(c.unionByName(h).where(F.col("CA").isNotNull()), by, F.col("q"), k)


def ca_pairs(atoms: DataFrame, by: list[str], k: int = 4) -> DataFrame:
    """CA-CA distances of the nearest ligands by class pair; ND1-NE2 pairs are one class."""
    r = ligands(atoms, by, k).select(*by, "rank", "kind", "CA")
    a = r.select(*by, F.col("rank").alias("i"), F.col("kind").alias("ka"), F.col("CA").alias("a"))
    b = r.select(*by, F.col("rank").alias("j"), F.col("kind").alias("kb"), F.col("CA").alias("b"))
    pair = F.concat_ws("-", F.least("ka", "kb"), F.greatest("ka", "kb"))
    return a.join(b, by).where("i < j").select(*by, "i", "j", pair.alias("pair"), G.distance(G.of(F.col("a")), G.of(F.col("b"))).alias("d"))


def tetra_volume(atoms: DataFrame, by: list[str]) -> DataFrame:
    """Volume of the tetrahedron of the four nearest ligands' CA; fewer give no row."""
    r = ligands(atoms, by, 4).groupBy(*by).agg(F.count("*").alias("n"), *[F.max_by("CA", F.when(F.col("rank") == i, 1)).alias(f"p{i}") for i in (1, 2, 3, 4)])
    return r.where("n = 4").select(*by, G.tetra_volume(*[G.of(F.col(f"p{i}")) for i in (1, 2, 3, 4)]).alias("volume"))


def donor_counts(atoms: DataFrame, by: list[str], k: int = 4) -> DataFrame:
    """ND1 and NE2 among the k nearest histidine donors."""
    return his_distances(atoms, by, k).groupBy(*by).agg(F.sum((F.col("n_name") == "ND1").cast("int")).alias("n_nd1"), F.sum((F.col("n_name") == "NE2").cast("int")).alias("n_ne2"))


def complete_cysteines(atoms: DataFrame, by: list[str]) -> DataFrame:
    """Residues that have CA, CB and SG; a site is an outlier unless it has four."""
    full = F.size(F.array_except(F.array(F.lit("CA"), F.lit("CB"), F.lit("SG")), F.collect_set("atom_name"))) == 0
    r = atoms.where(F.upper("resname") == "CYS").groupBy(*by, "chain", "resseq").agg(full.alias("full"))
    out = r.groupBy(*by).agg(F.sum(F.col("full").cast("int")).alias("n_complete"))
    return out.withColumn("outlier", F.col("n_complete") != 4)


def gap_string(residues_: DataFrame, by: list[str], number: str = "resi") -> DataFrame:
    """``Cx2C``: one letter per residue in order, gaps over 1 as x and the residues between;
    chains in parentheses where there are several."""
    letters = F.create_map(*[F.lit(v) for kv in ONE_LETTER.items() for v in kv])
    r = residues_.select(*by, "chain", number, F.coalesce(F.element_at(letters, F.upper("resname")), F.lit("X")).alias("l")).distinct()
    r = r.groupBy(*by, "chain", number).agg(F.min("l").alias("l"))
    gap = F.col(number) - F.lag(number).over(Window.partitionBy(*by, "chain").orderBy(number))
    part = F.concat(F.when(gap > 1, F.concat(F.lit("x"), (gap - 1).cast("string"))).otherwise(F.lit("")), "l")
    r = r.withColumn("part", part)
    chain = r.groupBy(*by, "chain").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(number, "part"))), lambda s: s["part"]), "").alias("s"))
    many = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chain", "s"))), lambda s: F.concat(F.lit("("), s["s"], F.lit(")"))), "")
    return chain.groupBy(*by).agg(F.count("*").alias("n"), F.first("s").alias("one"), many.alias("many")).select(*by, F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("many")).alias("sequence"))


def metric_summary(metrics: DataFrame, expected: int, sources: DataFrame | None = None) -> DataFrame:
    """Per metric key with values: their number, range, mean, and sources with fewer than expected values. ``sources``
    (source) lists all of them, so that those without a value count too."""
    per = metrics.groupBy("key", "source").agg(F.count("value").alias("k"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("value").alias("s"))
    short, full = F.sum((F.col("k") < expected).cast("int")), F.sum((F.col("k") >= expected).cast("int"))
    out = per.groupBy("key").agg(F.sum("k").alias("n"), F.min("lo").alias("min"), F.max("hi").alias("max"), (F.sum("s") / F.sum("k")).alias("mean"), short.alias("short_sources"), full.alias("_full"))
    if sources is not None:
        total = sources.agg(F.count_distinct("source").alias("_total"))
        out = out.crossJoin(F.broadcast(total)).withColumn("short_sources", F.col("_total") - F.col("_full")).drop("_total")
    return out.where("n > 0").drop("_full")


def histogram(values: DataFrame, value: str, source: str, low: float, high: float, bins: int) -> DataFrame:
    """Fixed bins, the last closed on the right, with the sources of each bin."""
    b = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return values.where(F.col(value).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set(source)).alias("sources"))


def exemplars(items: DataFrame, keys: list[str], path: str) -> DataFrame:
    """First path of each family."""
    return items.groupBy(*keys).agg(F.min(path).alias(path), F.count("*").alias("n"))
