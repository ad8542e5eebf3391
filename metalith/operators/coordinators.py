"""Coordinating residues read off a bare structure: roles by bonds alone, without residue names.

The nearest sulphurs and nitrogens of a metal are its donors. From each, shortest bond paths lead to the atoms of a
cysteine (SG, CB, CA) or of a histidine (CG within four bonds, CB, CA, and the ring). A structure's
bonds meet its few donors once, in one row, and every step is read from there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metalith.functions import geometry as G
from metalith.schema import COVALENT_RADII
from metalith.scratch import stored

from . import graph
from .atoms import STRUCTURE, settled
from .neighbors import bonds

#: Bonds from a donor nitrogen within which the ring's root is looked for.
DEPTH = 4


def stars(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """``i`` and ``around``: its bonded atoms ``(j, el, x, y, z, n)`` in line order, n the nitrogens bonded to j."""
    at = atoms.select(*STRUCTURE, F.col("line_no").alias("j"), F.upper("element").alias("el"), "x", "y", "z")
    e = graph.both_ways(edges).join(at, [*STRUCTURE, "j"])
    n = e.groupBy(*STRUCTURE, F.col("i").alias("j")).agg(F.count_if(F.col("el") == "N").alias("n"))
    return e.join(n, [*STRUCTURE, "j"]).groupBy(*STRUCTURE, "i").agg(F.sort_array(F.collect_list(F.struct("j", "el", "x", "y", "z", "n"))).alias("around"))


def _of(array: Column, element: str, but: Column | None = None) -> Column:
    return F.filter(array, lambda a: (a["el"] == element) & (F.lit(True) if but is None else (a["j"] != but)))


def _nearest(array: Column, to: Column) -> Column:
    return F.array_min(F.transform(array, lambda a: F.struct(G.d2(G.of(a), G.of(to)).alias("q"), a["j"].alias("j"), a.alias("a"))))["a"]


def _farthest(array: Column, to: Column) -> Column:
    """The farthest, the first in line order on ties."""
    return F.array_max(F.transform(array, lambda a: F.struct(G.d2(G.of(a), G.of(to)).alias("q"), (-a["j"]).alias("j"), a.alias("a"))))["a"]


def coordinators(atoms: DataFrame, target: str = "ZN", k: int = 4, edges: DataFrame | None = None) -> DataFrame:
    """``structure, resname, resseq, atom_name, coord, line_no, element, x, y, z, ord``: the atoms of the residues that
    hold the first ``target`` of each structure, placed relative to it; the target itself is residue 0.

    A sulphur's CB is its nearest carbon, CA the carbon bonded to that which is farthest from the metal. A nitrogen's CG
    is the carbon with a nitrogen and with a carbon that has none, the fewest bonds away, then the nearest; CB is the
    nearest such carbon, CA as before. The ring is walked CG, CD2, NE2, CE1, ND1, or backwards from ND1 where that is all there is;
    names that cannot be reached stay out. The donor nitrogen is NE2 if the walk says so, else ND1; it has a row of its own with
    ``coord``, beside its row in the ring. Donors without such paths give no residue. Residues are numbered by distance:
    cysteines from 1, histidines from 101."""
    nodes = atoms.select(*STRUCTURE, "line_no", "element", F.upper("element").alias("el"), "x", "y", "z")
    star = (stars(nodes, edges if edges is not None else bonds(nodes, COVALENT_RADII).select(*STRUCTURE, F.col("a_line_no").alias("i"), F.col("b_line_no").alias("j"))))
    atom = F.struct(F.col("line_no").alias("j"), "el", "x", "y", "z")
    # a structure's stars are one row, from which its donors read every step
    star = star.join(nodes.select(*STRUCTURE, F.col("line_no").alias("i"), atom.alias("me")), [*STRUCTURE, "i"]).groupBy(*STRUCTURE).agg(F.collect_list(F.struct("i", "me", "around")).alias("_stars"))
    star = stored(star, "stars")
    zn = nodes.where(F.col("el") == target.upper()).groupBy(*STRUCTURE).agg(F.min_by(F.struct("line_no", "element", "x", "y", "z"), "line_no").alias("zn"))
    center = zn.select(*STRUCTURE, "zn.line_no", "zn.x", "zn.y", "zn.z")
    donor = graph.closest(nodes.select(*STRUCTURE, "line_no", "element", "x", "y", "z"), center, k).select(*STRUCTURE, "line_no", "rank")
    donor = stored(donor.join(nodes, [*STRUCTURE, "line_no"]).join(zn, STRUCTURE).select(*STRUCTURE, "rank", "zn", F.struct(F.col("line_no").alias("j"), "el", "x", "y", "z").alias("d")), "donors")

    def walk(df: DataFrame, at: str, name: str, how: str = "left") -> DataFrame:
        """``df`` with ``name``, the atoms around the atom ``at``."""
        out = settled(settled(df).withColumn(name, F.get(F.filter("_stars", lambda s: s["i"] == F.col(f"{at}.j")), F.lit(0))["around"]))
        return out if how == "left" else out.where(F.col(name).isNotNull())

    role = lambda name, atom, coord=False: F.struct(F.lit(name).alias("atom_name") if isinstance(name, str) else name.alias("atom_name"), F.lit(coord).alias("coord"), *[atom[c].alias(c) for c in ("j", "el", "x", "y", "z")])
    cys = walk(donor.where("d.el = 'S'").join(star, STRUCTURE), "d", "_s", "inner").withColumn("cb", _nearest(_of(F.col("_s"), "C"), F.col("d"))).where("cb is not null")
    cys = walk(cys, "cb", "_b", "inner").withColumn("ca", _farthest(_of(F.col("_b"), "C", F.col("d.j")), F.col("zn"))).where("ca is not null")
    cys = cys.select(*STRUCTURE, "rank", "zn", F.lit("CYS").alias("resname"), F.array(role("SG", F.col("d"), True), role("CB", F.col("cb")), role("CA", F.col("ca"))).alias("roles"))

    # shortest paths over carbons and nitrogens from each donor nitrogen
    n = donor.where("d.el = 'N'").join(star, STRUCTURE)
    n = n.withColumn("_0", F.array("d.j"))
    for depth in range(1, DEPTH + 1):
        seen, last = F.concat(*[f"_{k}" for k in range(depth)]), f"_{depth - 1}"
        ahead = F.flatten(F.transform(F.filter("_stars", lambda s: F.array_contains(last, s["i"])), lambda s: F.filter(s["around"], lambda a: a["el"].isin("C", "N"))["j"]))
        n = settled(n.withColumn(f"_{depth}", F.array_except(ahead, seen)))
    hops = lambda s: F.coalesce(*[F.when(F.array_contains(f"_{k}", s["i"]), k) for k in range(1, DEPTH + 1)])
    stem = lambda s: F.filter(s["around"], lambda a: (a["el"] == "C") & (a["n"] == 0))
    roots = F.filter("_stars", lambda s: (s["me"]["el"] == "C") & hops(s).isNotNull() & F.exists(s["around"], lambda a: a["el"] == "N") & (F.size(stem(s)) > 0))
    best = F.array_min(F.transform(roots, lambda s: F.struct(hops(s).alias("depth"), G.d2(G.of(s["me"]), G.of(F.col("d"))).alias("q"), s["i"].alias("i"), s["me"].alias("cg"), s["around"].alias("g"), stem(s).alias("s"))))
    his = settled(n.withColumn("r", best)).where("r is not null")
    his = his.select(*STRUCTURE, "rank", "zn", "d", "_stars", F.col("r.cg").alias("cg"), F.col("r.g").alias("g"), _nearest(F.col("r.s"), F.col("r.cg")).alias("cb"))
    his = walk(his, "cb", "_b", "inner").withColumn("ca", _farthest(_of(F.col("_b"), "C", F.col("cg.j")), F.col("zn"))).where("ca is not null")
    first, last = (lambda a: F.get(a, F.lit(0))), (lambda a: F.get(a, F.size(a) - 1))
    his = his.withColumns({"nd1": last(_of(F.col("g"), "N", F.col("cb.j"))), "cd2": last(_of(F.col("g"), "C", F.col("cb.j")))})
    his = walk(his, "cd2", "_1").withColumn("ne2", first(_of(F.col("_1"), "N")))
    his = walk(his, "ne2", "_2").withColumn("ce1", first(_of(F.col("_2"), "C", F.col("cd2.j"))))
    his = walk(his, "ce1", "_3").withColumn("nd1", F.coalesce(first(_of(F.col("_3"), "N", F.col("ne2.j"))), "nd1"))
    his = his.withColumn("_back", F.when(F.col("ne2").isNull(), F.col("nd1")))
    his = walk(his, "_back", "_4").withColumn("_ce1", first(_of(F.col("_4"), "C", F.col("cg.j"))))
    his = walk(his, "_ce1", "_5").withColumn("_ne2", first(_of(F.col("_5"), "N", F.col("nd1.j"))))
    his = walk(his, "_ne2", "_6").withColumn("_cd2", first(_of(F.col("_6"), "C", F.col("_ce1.j"))))
    his = his.withColumns({"ce1": F.coalesce("ce1", "_ce1"), "ne2": F.coalesce("ne2", "_ne2"), "cd2": F.coalesce("cd2", "_cd2")})
    own = F.when(F.col("d.j") == F.col("ne2.j"), "NE2").otherwise("ND1")
    ring = [F.when(F.col(name).isNotNull(), role(name.upper(), F.col(name))) for name in ("cd2", "ne2", "ce1", "nd1")]
    roles = F.filter(F.array(role(own, F.col("d"), True), role("CG", F.col("cg")), role("CB", F.col("cb")), role("CA", F.col("ca")), *ring), lambda a: a.isNotNull())
    his = his.select(*STRUCTURE, "rank", "zn", F.lit("HIS").alias("resname"), roles.alias("roles"))

    found = cys.unionByName(his)
    number = F.row_number().over(Window.partitionBy(*STRUCTURE, "resname").orderBy("rank"))
    found = found.withColumn("resseq", F.when(F.col("resname") == "HIS", number + 100).otherwise(number))
    rows = found.select(*STRUCTURE, "resname", "resseq", "zn", "rank", F.posexplode("roles").alias("p", "a"))
    out = rows.select(
        *STRUCTURE, "resname", "resseq", "a.atom_name", "a.coord", F.col("a.j").alias("line_no"), F.col("a.el").alias("element"),
        *[(F.col(f"a.{c}") - F.col(f"zn.{c}")).alias(c) for c in "xyz"], (F.col("rank") * 10 + F.col("p")).alias("ord"),
    )
    metal = zn.select(*STRUCTURE, F.lit(target.upper()).alias("resname"), F.lit(0).alias("resseq"), F.lit(target.upper()).alias("atom_name"), F.lit(False).alias("coord"), F.col("zn.line_no").alias("line_no"), F.upper("zn.element").alias("element"), *[F.lit(0.0).alias(c) for c in "xyz"], F.lit(0).alias("ord"))
    return metal.unionByName(out)
