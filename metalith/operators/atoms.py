"""Row operators on atoms: altloc collapse, filters, best picks.

Atoms are identified by ``(structure_id, model, line_no)``; serial numbers may repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metalith.schema import METALS, WATERS

STRUCTURE = ["structure_id", "model"]
SITE_KEY = ["chain", "resseq", "icode", "atom_name"]
RESIDUE = ["chain", "resseq", "icode"]


def altloc_order(policy: str = "default", a: Column | None = None) -> Column:
    """What ranks the lines of one place, or ``a`` among them; the least is taken."""
    c = F.col if a is None else a.getField
    blank = c("altloc").isin("", "A")
    return {
        "default": F.struct((~blank).cast("int").alias("a"), F.when(blank, 0.0).otherwise(-c("occ")).alias("b"), c("line_no").alias("c")),
        "best_occupancy": F.struct((-c("occ")).alias("a"), c("line_no").alias("b")),
        "first": F.struct(c("line_no").alias("a")),
    }[policy]


def collapse_altloc(atoms: DataFrame, policy: str = "default") -> DataFrame:
    """One atom per (chain, resseq, icode, atom_name) and structure.

    ``default``: the first line with altloc blank or A, else the highest occupancy, else
    the first line; ``best_occupancy``: the highest occupancy, first line on ties;
    ``first``: the first line. ``group_ord`` keeps the place of the group's first line."""
    order = altloc_order(policy)
    keys = [*STRUCTURE, *SITE_KEY]
    picked = atoms.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in atoms.columns if c not in keys]), order).alias("_a"), F.min("line_no").alias("group_ord"))
    return picked.select(*[F.col(c if c in keys else f"_a.{c}").alias(c) for c in atoms.columns], "group_ord")


def is_metal(excluded: tuple[str, ...] = (), a: Column | None = None) -> Column:
    """Only HETATM records of a metal element count as metals."""
    c = F.col if a is None else a.getField
    return (c("record") == "HETATM") & F.upper(c("element")).isin(*[m for m in METALS if m not in excluded])


def metals(atoms: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    return atoms.where(is_metal(excluded))


def water_toggle(atoms: DataFrame, include_waters: bool = True) -> DataFrame:
    """Drop hydrogens always, waters if they are off."""
    kept = atoms.where(F.upper("element") != "H")
    return kept if include_waters else kept.where(~F.upper("resname").isin(*WATERS))


def altloc_metals(atoms: DataFrame) -> DataFrame:
    """Metal records with an alternate location other than blank or A, not collapsed."""
    return metals(atoms).where(~F.col("altloc").isin("", "A"))


def best_order(prefer: Column | None = None, a: Column | None = None) -> Column:
    """What ranks the lines of one atom for ``best_atom``, or ``a`` among them; the greatest is taken."""
    c = F.col if a is None else a.getField
    rank = F.when(prefer, 2).when(c("altloc") == "", 1).otherwise(0) if prefer is not None else F.when(c("altloc").isin("", "A"), 1).otherwise(0)
    return F.struct(rank.alias("a"), (c("bfac") >= 0).cast("int").alias("b"), c("occ").alias("c"), (-c("line_no")).alias("d"))


def best_atom(atoms: DataFrame, keys: list[str], prefer: Column | None = None) -> DataFrame:
    """Highest (preferred altloc, has a B-factor, occupancy), first line on ties."""
    return atoms.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in atoms.columns if c not in keys]), best_order(prefer)).alias("_a")).select(*keys, "_a.*")


def symbol(element: Column) -> Column:
    """Title case for two-letter symbols, upper case for one."""
    return F.when(F.length(element) == 1, F.upper(element)).otherwise(F.initcap(element))


def residue_label(prefix: str = "") -> Column:
    c = lambda n: F.col(prefix + n)
    return F.concat_ws(" ", c("resname"), c("chain"), F.concat(c("resseq"), c("icode")), c("atom_name"))


def number_in_order(df: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    """0-based position in each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def residue_sort_key(resseq: Column) -> Column:
    """Numbers by value, then letter; other texts behind all numbers."""
    number = F.regexp_extract(resseq, r"^(-?\d+)([A-Za-z]?)$", 1)
    return F.struct(F.coalesce(number.try_cast("int"), F.lit(1_000_000_000)).alias("n"), F.when(number == "", resseq).otherwise(F.regexp_extract(resseq, r"^(-?\d+)([A-Za-z]?)$", 2)).alias("t"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settled(df: DataFrame) -> DataFrame:
    """``df`` with all columns computed here, once. An array that a later lambda reads is otherwise an expression that the
    planner may put into that lambda, to be computed anew for each element, or once more below a filter."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_s")).select("_s.*")


def runs(array: Column, key: str = "key") -> Column:
    """The sorted ``array`` cut into one array for each value of its elements' field ``key``; nulls are one value."""

    def cut(x: Column) -> Column:
        new = F.transform(x, lambda e, i: F.when((i == 0) | ~e[key].eqNullSafe(F.get(x, i - 1)[key]), i))
        return let(F.filter(new, lambda i: i.isNotNull()), lambda starts: F.transform(starts, lambda s, i: F.slice(x, s + 1, F.coalesce(F.get(starts, i + 1), F.size(x)) - s)))

    return let(array, cut)
