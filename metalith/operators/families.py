"""Sites told apart by their residues: sequence and structure strings, counts per family, metrics by donor.

Rows are atoms around a site as in ``residues``; ``by`` names the site. A site holds a few residues, so what is
collected per site is short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metalith.functions import geometry as G

from . import residues as R


def sec_letter(sec: Column) -> Column:
    """H, S or L of a structure name or letter, else ``?``."""
    name = F.upper(F.trim(F.coalesce(sec, F.lit(""))))
    return F.when(name.isin("HELIX", "H"), "H").when(name.isin("SHEET", "S"), "S").when(name.isin("LOOP", "L"), "L").otherwise("?")


def site_strings(atoms: DataFrame, by: list[str], number: str = "resi", sec: str = "sec") -> DataFrame:
    """``by``, ``sequence`` (``Cx2C``: first letters of residues with a CA, in order, gaps as x and the residues between)
    and ``secstruct`` (their letters of structure), several chains each in parentheses.

    Of CA lines of one chain and number the first counts; a null number has no place; a blank chain is ``_``."""
    chain = F.when(F.trim(F.coalesce("chain", F.lit(""))) == "", "_").otherwise(F.col("chain"))
    ca = atoms.where((F.col("atom_name") == "CA") & F.col(number).isNotNull()).withColumn("chain", chain)
    letters = F.struct(F.substring(F.upper(F.trim("resname")), 1, 1).alias("l"), sec_letter(F.col(sec)).alias("s"))
    r = ca.groupBy(*by, "chain", number).agg(F.min_by(letters, "line_no").alias("_r"))
    gap = F.col(number) - F.lag(number).over(Window.partitionBy(*by, "chain").orderBy(number))
    part = F.concat(F.when(gap > 1, F.concat(F.lit("x"), (gap - 1).cast("string"))).otherwise(F.lit("")), F.col("_r.l"))
    r = r.select(*by, "chain", number, part.alias("p"), F.col("_r.s").alias("s"))

    def joined(rows: Column, field: str) -> Column:
        return F.array_join(F.transform(F.sort_array(rows), lambda x: x[field]), "")

    def bracketed(rows: Column, field: str) -> Column:
        text = F.transform(F.sort_array(rows), lambda x: F.concat(F.lit("("), x[field], F.lit(")")))
        return F.when(F.size(rows) == 1, F.get(rows, F.lit(0))[field]).otherwise(F.array_join(text, ""))

    rows = F.collect_list(F.struct(number, "p", "s"))
    chains = r.groupBy(*by, "chain").agg(joined(rows, "p").alias("p"), joined(rows, "s").alias("s"))
    per = chains.groupBy(*by).agg(F.collect_list(F.struct("chain", "p", "s")).alias("_c"))
    return per.select(*by, bracketed(F.col("_c"), "p").alias("sequence"), bracketed(F.col("_c"), "s").alias("secstruct"))


def sequence_report(strings: DataFrame) -> DataFrame:
    """Per sequence: ``n`` sites and ``line``, the report's text ``sequence n structure:n, ...``, structures in order."""
    one = strings.where("sequence <> ''").groupBy("sequence", "secstruct").agg(F.count("*").alias("k"))
    named = F.when(F.coalesce("secstruct", F.lit("")) != "", F.struct("secstruct", "k"))
    g = one.groupBy("sequence").agg(F.sum("k").alias("n"), F.sort_array(F.collect_list(named)).alias("_s"))
    parts = F.array_join(F.transform("_s", lambda s: F.concat_ws(":", s["secstruct"], s["k"].cast("string"))), ", ")
    return g.select("sequence", "n", F.rtrim(F.concat_ws(" ", "sequence", F.col("n").cast("string"), parts)).alias("line"))


def sequence_means(strings: DataFrame, volumes: DataFrame, distances: DataFrame, by: list[str], k: int = 4) -> DataFrame:
    """Per sequence: ``n`` sites, ``measured`` of them, and the means of volume and of mean distance over the measured ones:
    those with a volume and ``k`` distances (``distances``: by, n, mean_d)."""
    full = volumes.join(distances.where(F.col("n") == k), by).select(*by, "volume", "mean_d")
    rows = strings.join(full, by, "left")
    return rows.groupBy("sequence").agg(F.count("*").alias("n"), F.count("volume").alias("measured"), F.avg("volume").alias("volume"), F.avg("mean_d").alias("mean_d"))


def flagged_donors(atoms: DataFrame, by: list[str], flag: str | None = None, k: int = 4) -> DataFrame:
    """The k nearest histidines by their donor: ``n_name``, ``d_n``, ``rank``. A flagged nitrogen (boolean column ``flag``) is
    the donor before the nearer one, ND1 before NE2 if both are."""
    if flag is None:
        return R.his_distances(atoms, by, k)
    r = R.residues(atoms, by, "HIS", ("ND1", "NE2"), (flag,))
    r = r.withColumns({"_nd": F.col("ND1")[flag], "_ne": F.col("NE2")[flag]})
    return R.nearest(R.donor(r, ("_nd", "_ne")), by, F.col("N.d2"), k).select(*by, "chain", "resseq", "rank", "n_name", F.sqrt("N.d2").alias("d_n"))


def by_donor(donors: DataFrame, by: list[str]) -> DataFrame:
    """Distances of ``flagged_donors`` split by the chosen nitrogen: two sorted arrays a site."""
    pick = lambda n: F.sort_array(F.collect_list(F.when(F.col("n_name") == n, F.col("d_n")))).alias(n.lower())
    return donors.groupBy(*by).agg(pick("ND1"), pick("NE2"))


def donor_bincount(donors: DataFrame, sites: DataFrame, by: list[str], k: int = 4) -> DataFrame:
    """``kind, value, n``: how many of ``sites`` have 0 to k donors of each kind; sites without a histidine count as 0."""
    counts = donors.groupBy(*by).agg(*[F.count(F.when(F.col("n_name") == n, 1)).alias(n) for n in ("ND1", "NE2")])
    all_ = sites.select(*by).distinct().join(counts, by, "left")
    bins = [F.count(F.when(F.coalesce(n, F.lit(0)) == v, 1)).alias(f"{n}_{v}") for n in ("ND1", "NE2") for v in range(k + 1)]
    cells = F.array(*[F.struct(F.lit(n).alias("kind"), F.lit(v).alias("value"), F.col(f"{n}_{v}").alias("n")) for n in ("ND1", "NE2") for v in range(k + 1)])
    return all_.agg(*bins).select(F.explode(cells).alias("_c")).select("_c.*")


def all_ca_pairs(atoms: DataFrame, by: list[str]) -> DataFrame:
    """Distances of all pairs of a site's CA atoms, ``i < j`` in line order."""
    ca = atoms.where("atom_name = 'CA'").select(*by, F.struct("line_no", "x", "y", "z").alias("p"))
    ca = ca.groupBy(*by).agg(F.sort_array(F.collect_list("p")).alias("_p"))
    one = ca.select(*by, "_p", F.posexplode("_p").alias("_i", "a"))
    pairs = one.select(*by, "a", F.explode(F.slice("_p", F.col("_i") + 2, F.greatest(F.size("_p") - F.col("_i") - 1, F.lit(0)))).alias("b"))
    return pairs.select(*by, F.col("a.line_no").alias("i"), F.col("b.line_no").alias("j"), G.distance(G.of(F.col("a")), G.of(F.col("b"))).alias("d"))


def completeness(counts: DataFrame, sites: DataFrame, by: list[str], expected: int = 4) -> DataFrame:
    """One row over all ``sites``: those whose ``n_complete`` differs from ``expected``, with one less and one more apart.
    Sites that ``counts`` lacks have none."""
    n = F.coalesce("n_complete", F.lit(0))
    rows = sites.select(*by).distinct().join(counts.select(*by, "n_complete"), by, "left").select(n.alias("n"))
    tests = {"outliers": F.col("n") != expected, "one_less": F.col("n") == expected - 1, "one_more": F.col("n") == expected + 1}
    return rows.agg(F.count("*").alias("sites"), *[F.count(F.when(c, 1)).alias(k) for k, c in tests.items()])


def filled(tagged: DataFrame, inferred: DataFrame, keys: list[str]) -> DataFrame:
    """``tagged`` metrics, and ``inferred`` ones of the keys that have no tagged value."""
    have = tagged.where(F.col("value").isNotNull()).select(*keys).distinct()
    rest = inferred.join(have, keys, "left_anti")
    mark = lambda df, s: df.where(F.col("value").isNotNull()).select(*keys, "value", F.lit(s).alias("origin"))
    return mark(tagged, "tagged").unionByName(mark(rest, "inferred"))


def consistency(rows: DataFrame, by: list[str], value: str, atol: float = 1e-12) -> DataFrame:
    """Per family: ``n`` values, their ``spread`` and whether they are all the ``same`` within ``atol``; nulls do not count."""
    spread = F.max(value) - F.min(value)
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(value).alias("n"), spread.alias("spread"), (spread <= atol).alias("same"))
