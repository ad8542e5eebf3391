"""B-factor groups, sequence neighbours, lookups and secondary structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metalith.functions import geometry as G
from metalith.schema import AMINO_ACIDS

from . import atoms as A
from .atoms import STRUCTURE
from .neighbors import within


def group_stats(values: DataFrame, by: list[str], value: str = "bfac") -> DataFrame:
    """Mean and population deviation; no values give (-1, 0), one gives (v, 0).

    The mean is that of exact sums where all values are decimals, so it does not depend on the order of rows."""
    n, exact = F.count(value), F.col(value).try_cast("decimal(28,12)")
    mean = F.when(F.count(exact) == n, F.sum(exact).cast("double") / n).otherwise(F.avg(value))
    return values.groupBy(*by).agg(n.alias("n"), F.coalesce(F.when(n > 0, mean), F.lit(-1.0)).alias("mean"), F.when(n > 1, F.stddev_pop(value)).otherwise(F.lit(0.0)).alias("std"))


def sequence_neighbors(residues: DataFrame, by: list[str], number: str, marked: str, reach: int = 2) -> DataFrame:
    """Residues within ``reach`` places in chain order of a marked one, themselves unmarked."""
    w = Window.partitionBy(*by).orderBy(number)
    near = F.max(F.col(marked).cast("int")).over(w.rowsBetween(-reach, reach)) == 1
    return residues.withColumn("_near", near).where(F.col("_near") & ~F.col(marked)).drop("_near")


def lookup(rows: DataFrame, atoms: DataFrame, keys: list[str], value: str = "bfac") -> DataFrame:
    """Value of the atom with the row's record and keys, else an ATOM's, else a HETATM's, else -1."""
    best = atoms.groupBy("record", *keys).agg(F.min_by(value, "line_no").alias("v"))
    out = rows.join(best.withColumnRenamed("v", "_own"), ["record", *keys], "left")
    for record, name in (("ATOM", "_atom"), ("HETATM", "_het")):
        out = out.join(best.where(F.col("record") == record).select(*keys, F.col("v").alias(name)), keys, "left")
    return out.withColumn("b_factor", F.coalesce("_own", "_atom", "_het", F.lit(-1.0))).drop("_own", "_atom", "_het")


def secondary_structure(residues: DataFrame, ranges: DataFrame, by: list[str], number: str) -> DataFrame:
    """HELIX before SHEET, LOOP where no range covers a residue, XXXX for unknown structures.

    ``ranges``: by, chain, kind, start, stop (either order)."""
    r = ranges.select(*by, "chain", "kind", F.least("start", "stop").alias("_a"), F.greatest("start", "stop").alias("_b"))
    known = ranges.select(*by).distinct().withColumn("_known", F.lit(True))
    hit = residues.join(r, [*by, "chain"]).where(F.col(number).between(F.col("_a"), F.col("_b")))
    hit = hit.groupBy(*by, "chain", number).agg(F.min(F.when(F.col("kind") == "HELIX", 0).otherwise(1)).alias("_p"))
    out = residues.join(hit, [*by, "chain", number], "left").join(known, by, "left")
    name: Column = F.when(F.col("_known").isNull(), "XXXX").when(F.col("_p") == 0, "HELIX").when(F.col("_p") == 1, "SHEET").otherwise("LOOP")
    return out.withColumn("sec", name).drop("_p", "_known")


# -- declared sequences ---------------------------------------------------------------------------


def declared_positions(observed: DataFrame, declared: DataFrame, by: list[str] = STRUCTURE) -> DataFrame:
    """``observed`` residues (by, chain, resname, resseq) with ``seq_index``, their place from 0 in the declared
    sequence ``declared`` (by, chain, residues), or null.

    The alignment keeps order: residues are taken by number, then insertion letter, and each gets the first place of its
    name behind the last place given; one without such a place gets none and moves nothing. A chain is one fold over its
    residues, as the pointer makes it sequential; chains without a declared sequence get nulls."""
    key = A.residue_sort_key(F.col("resseq"))
    chain = observed.groupBy(*by, "chain").agg(F.sort_array(F.collect_list(F.struct(key.alias("k"), F.upper("resname").alias("name"), F.struct(*observed.columns).alias("row")))).alias("_o"))
    chain = chain.join(declared.select(*by, "chain", F.transform("residues", F.upper).alias("_d")), [*by, "chain"], "left")

    def place(state: Column, o: Column) -> Column:
        found = F.array_position(F.slice("_d", state["next"] + 1, F.greatest(F.size("_d") - state["next"], F.lit(0))), o["name"]).cast("int")
        at = F.when(found > 0, state["next"] + found - 1)
        return F.struct(F.coalesce(at + 1, state["next"]).alias("next"), F.concat(state["at"], F.array(at)).alias("at"))

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("at"))
    chain = chain.withColumn("_at", F.when(F.col("_d").isNotNull(), F.aggregate("_o", start, place)["at"]))
    rows = chain.select(F.posexplode("_o").alias("_p", "_r"), "_at")
    return rows.select("_r.row.*", F.get("_at", F.col("_p")).alias("seq_index"))


def declared_neighbors(positions: DataFrame, marked: str, reach: int = 2, by: list[str] = STRUCTURE) -> DataFrame:
    """Residues within ``reach`` places of a marked one, the marked ones among them: by declared index where the marked one has
    it, else by the order observed. ``positions``: as ``declared_positions`` gives it, with a flag ``marked``."""
    w = Window.partitionBy(*by, "chain").orderBy(A.residue_sort_key(F.col("resseq")), "resname")
    p = positions.withColumn("_seen", F.row_number().over(w))
    hits = []
    for at, which in (("seq_index", F.col("seq_index").isNotNull()), ("_seen", F.col("seq_index").isNull())):
        near = p.where(F.col(marked) & which).select(*by, "chain", F.explode(F.sequence(F.col(at) - reach, F.col(at) + reach)).alias(at)).distinct()
        hits.append(p.join(near, [*by, "chain", at], "left_semi").select(*p.columns))
    return hits[0].unionByName(hits[1]).drop("_seen").distinct()


# -- groups around a metal -------------------------------------------------------------------------


def metal_groups(atoms: DataFrame, centers: DataFrame, reach: float = 3.0, pocket: float = 10.0, places: int = 2) -> DataFrame:
    """``structure, c_line_no, ord, label, n, mean, std`` of the B-factors around each centre (line_no, x, y, z,
    bfac): the metal; each coordinator, a residue but metal and water with a heavy atom within ``reach``, without its N, C and
    O; ``near`` it, the amino acids within ``places`` of it in the chain's order of first lines, coordinators left out;
    and the pocket, heavy atoms within ``pocket`` that belong to no coordinator and no metal residue.

    Coordinators are ordered by chain and number. Every group has a row: without values (-1, 0), with one (v, 0)."""
    res = ["chain", "resseq", "resname"]
    heavy = atoms.where(F.upper("element") != "H").select(*STRUCTURE, "line_no", "record", "chain", "resseq", F.upper("resname").alias("resname"), F.upper("atom_name").alias("atom_name"), "x", "y", "z", "bfac")
    c = centers.select(*STRUCTURE, "line_no", "x", "y", "z", "bfac")
    close = within(c, heavy.select(*STRUCTURE, *res, "x", "y", "z"), reach + 1e-6).withColumn("d", G.distance(G.at("c_"), G.at()))
    metal_name = F.col("resname") == "ZN"
    own = close.where(~metal_name & (F.col("resname") != "HOH")).groupBy(*STRUCTURE, "c_line_no", *res).agg(F.min("d").alias("d")).where(F.col("d") <= reach).drop("d")
    number = A.residue_sort_key(F.col("resseq"))
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy(*STRUCTURE, "c_line_no").orderBy("chain", number, "resname")))
    values = own.join(heavy.where(~F.col("atom_name").isin("N", "C", "O")).select(*STRUCTURE, *res, "bfac"), [*STRUCTURE, *res], "left")
    key = [*STRUCTURE, "c_line_no", "ord", "label"]
    shells = [values.withColumns({"ord": F.col("nth") * 2 - 1, "label": F.concat("resname", "resseq")}).select(*key, "bfac")]
    # places in the chain, of the standard residues of ATOM lines
    chain = heavy.where((F.col("record") == "ATOM") & F.col("resname").isin(*AMINO_ACIDS) & (F.col("chain") != "") & (F.col("resseq") != ""))
    chain = chain.groupBy(*STRUCTURE, *res).agg(F.min("line_no").alias("_f")).withColumn("at", F.row_number().over(Window.partitionBy(*STRUCTURE, "chain").orderBy("_f"))).drop("_f")
    spots = own.join(chain, [*STRUCTURE, *res]).select(*STRUCTURE, "c_line_no", "nth", "chain", F.explode(F.sequence(F.col("at") - places, F.col("at") + places)).alias("at"))
    near = spots.join(chain, [*STRUCTURE, "chain", "at"]).join(own.select(*STRUCTURE, "c_line_no", *res), [*STRUCTURE, "c_line_no", *res], "left_anti")
    near = near.join(heavy.select(*STRUCTURE, *res, "bfac"), [*STRUCTURE, *res]).select(*STRUCTURE, "c_line_no", "nth", "bfac")
    near = own.select(*STRUCTURE, "c_line_no", "nth", "resseq").join(near, [*STRUCTURE, "c_line_no", "nth"], "left")
    shells.append(near.withColumns({"ord": F.col("nth") * 2, "label": F.concat(F.lit("near"), "resseq")}).select(*key, "bfac"))
    # the pocket is read off one row per structure, its centres beside it, and shuffles no pairs
    name = F.concat_ws("\x01", *res)
    whole = heavy.where(~metal_name).groupBy(*STRUCTURE).agg(F.collect_list(F.struct("x", "y", "z", "bfac", name.alias("res"))).alias("_all"))
    mine = own.groupBy(*STRUCTURE, "c_line_no").agg(F.collect_set(name).alias("_own"))
    every = c.withColumnRenamed("line_no", "c_line_no").join(mine, [*STRUCTURE, "c_line_no"], "left").join(whole, STRUCTURE, "left")
    free = F.filter("_all", lambda a: (G.d2((F.col("x"), F.col("y"), F.col("z")), G.of(a)) <= pocket * pocket) & ~F.coalesce(F.array_contains("_own", a["res"]), F.lit(False)))
    free = every.select(*STRUCTURE, "c_line_no", F.explode_outer(F.transform(free, lambda a: a["bfac"])).alias("bfac"))
    shells.append(c.select(*STRUCTURE, F.col("line_no").alias("c_line_no"), F.lit(0).alias("ord"), F.lit("Zn").alias("label"), "bfac"))
    out = shells[0]
    for s in shells[1:]:
        out = out.unionByName(s)
    rest = group_stats(free, [*STRUCTURE, "c_line_no"]).withColumns({"ord": F.lit(1_000_000), "label": F.lit("Pocket")})
    return group_stats(out, key).unionByName(rest)
