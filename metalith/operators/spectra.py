"""Debye-Waller metrics and spectra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metalith.functions import geometry as G

from . import atoms as A


def dw_rollup(rows: DataFrame, source: str, kind: str, dw: str, distance: str) -> DataFrame:
    """Mean dw, population variance of the distance and their sum, per source and per
    source and atom type, in one pass of grouping sets.

    Values count to six decimals and are summed as decimals, so that the order of rows,
    which a shuffle does not keep, changes nothing."""
    w, d = (F.col(c).cast("decimal(14,6)") for c in (dw, distance))
    out = rows.rollup(source, kind).agg(F.grouping(kind).alias("_all"), F.grouping(source).alias("_top"), F.count("*").alias("n"), F.count(w).alias("_k"), F.sum(w).alias("_w"), F.count(d).alias("_m"), F.sum(d).alias("_d"), F.sum(d * d).alias("_q"))
    mean = lambda total, n: F.col(total).cast("double") / F.expr(f"nullif({n}, 0)")
    out = out.withColumns({"mean_dw": mean("_w", "_k"), "var_d": F.greatest(mean("_q", "_m") - mean("_d", "_m") * mean("_d", "_m"), F.lit(0.0))})
    out = out.where("_top = 0").withColumn(kind, F.when(F.col("_all") == 1, "all").otherwise(F.col(kind)))
    return out.select(source, kind, "n", "mean_dw", "var_d", (F.col("mean_dw") + F.col("var_d")).alias("total"))


def paired_shells(tagged: DataFrame) -> DataFrame:
    """``source, reason, pairs``: of each source's dw-tagged rows (source, line_no, element, x, y, z, dw, kind) the first
    shell, its S and N, each with a C of its own, so that the sum of squared distances is least.

    Exactly four S and N and at least four C must be tagged, else ``reason`` says what is missing and there are no
    pairs. Rows count in line order, and so does the first of equal choices. ``kind`` names the donor's type."""
    row = F.struct("line_no", F.upper("element").alias("el"), "x", "y", "z", "dw", "kind")
    g = tagged.groupBy("source").agg(F.sort_array(F.collect_list(row)).alias("r"))
    g = A.settled(g.select("source", F.filter("r", lambda a: a["el"].isin("S", "N")).alias("f"), F.filter("r", lambda a: a["el"] == "C").alias("c")))
    reason = F.when(F.size("f") != 4, F.format_string("4 S or N with dw are needed, %d found", F.size("f"))).when(F.size("c") < 4, F.format_string("4 C with dw are needed, %d found", F.size("c")))
    g = A.settled(g.withColumn("reason", reason).withColumn("cost", F.transform("f", lambda a: F.transform("c", lambda b: G.d2(G.of(a), G.of(b))))))

    def choices(used: Column, total: Column, k: int) -> Column:
        """All ways to go on, as (total, places)."""
        if k == 4:
            return F.array(F.struct(total.alias("total"), used.alias("at")))
        free = F.filter(F.sequence(F.lit(0), F.size("c") - 1), lambda j: ~F.array_contains(used, j))
        return F.flatten(F.transform(free, lambda j: choices(F.concat(used, F.array(j)), total + F.get(F.get("cost", F.lit(k)), j), k + 1)))

    best = F.when(F.col("reason").isNull(), F.array_min(choices(F.array().cast("array<int>"), F.lit(0.0), 0)))
    g = A.settled(g.withColumn("b", best))
    return g.select("source", "reason", F.transform("f", lambda a, i: F.when(F.col("b").isNotNull(), F.struct(a.alias("first"), F.get("c", F.get("b.at", i)).alias("ca")))).alias("pairs"))


def shell_metrics(tagged: DataFrame) -> DataFrame:
    """``source, kind, part, n, mean_dw, var_d, total`` over the pairs of each source: ``first`` and ``ca``, for all
    (``kind`` all) and for each type. Sources that miss atoms have no row. ``var_d`` is the population variance of the
    distance from the origin, ``total`` its sum with the mean."""
    pair = paired_shells(tagged).where("reason is null").select("source", F.explode("pairs").alias("p"))
    rows = pair.select("source", F.col("p.first.kind").alias("kind"), F.explode(F.array(F.struct(F.lit("first").alias("part"), F.col("p.first").alias("a")), F.struct(F.lit("ca").alias("part"), F.col("p.ca").alias("a")))).alias("r"))
    rows = rows.select("source", "kind", "r.part", F.col("r.a.dw").alias("dw"), G.norm(G.of(F.col("r.a"))).alias("d"))
    both = rows.unionByName(rows.withColumn("kind", F.lit("all")))
    return both.groupBy("source", "kind", "part").agg(F.count("*").alias("n"), F.avg("dw").alias("mean_dw"), F.var_pop("d").alias("var_d"), (F.avg("dw") + F.var_pop("d")).alias("total"))


def value_summary(rows: DataFrame, source: str, value: str) -> DataFrame:
    """``n``, mean and population deviation per source; sources without values have no row.
    Values count to six decimals and are summed as decimals."""
    v = F.col(value).cast("decimal(14,6)")
    out = rows.where(v.isNotNull()).groupBy(source).agg(F.count("*").alias("n"), F.sum(v).cast("double").alias("_v"), F.sum(v * v).cast("double").alias("_q"))
    mean = F.col("_v") / F.col("n")
    return out.select(source, "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("_q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def first_per_k(rows: DataFrame, by: list[str], k: str, value: str, order: str) -> DataFrame:
    return rows.groupBy(*by, k).agg(F.min_by(value, order).alias(value))


def average(traces: DataFrame, source: str, k: str, value: str, points: int = 512, low: float = 0.0, high: float = 13.0) -> DataFrame:
    """Mean of linear interpolations on an even grid over the range all traces share.

    Each trace becomes segments (this and the next point); a grid point belongs to one
    segment, found by index arithmetic, so points are exploded and never range-joined."""
    span = traces.groupBy(source).agg(F.min(k).alias("a"), F.max(k).alias("b")).agg(F.greatest(F.max("a"), F.lit(low)).alias("a"), F.least(F.min("b"), F.lit(high)).alias("b"))
    w = Window.partitionBy(source).orderBy(k)
    seg = traces.select(source, F.col(k).alias("k0"), F.col(value).alias("v0"), F.lead(k).over(w).alias("k1"), F.lead(value).over(w).alias("v1"))
    seg = seg.join(F.broadcast(span), F.lit(True)).where("a < b")  # one row
    step = (F.col("b") - F.col("a")) / (points - 1)
    first = F.greatest(F.ceil((F.col("k0") - F.col("a")) / step), F.lit(0))
    last = F.when(F.col("k1").isNull(), F.when(F.col("k0") >= F.col("b"), F.lit(points - 1)).otherwise(F.lit(-1))).otherwise(F.least(F.ceil((F.col("k1") - F.col("a")) / step) - 1, F.lit(points - 1)))
    seg = seg.withColumn("i", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    grid = F.col("a") + F.col("i") * step
    lerp = F.when(F.col("k1").isNull(), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (grid - F.col("k0")) / (F.col("k1") - F.col("k0")))
    return seg.groupBy("i").agg(F.avg(lerp).alias("mean"), F.count("*").alias("n"), F.min(grid).alias("k"))


def transform_to_r(spectra: DataFrame, source: str, k: str, chi: str, kmin: float = 3.0, kmax: float = 11.0, dk: float = 3.0, weight: int = 2, step: float = 0.05, rmax: float = 6.0, size: int = 2048) -> DataFrame:
    """Windowed Fourier transform of k-weighted spectra, one small group a source: needs
    an FFT, which no built-in function offers."""

    def one(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(k).drop_duplicates(k)
        grid = np.arange(size) * step
        values = np.interp(grid, pdf[k], pdf[chi], left=0.0, right=0.0) * grid**weight
        lo, hi = kmin - dk / 2, kmax + dk / 2
        at = np.clip((grid - (lo + hi) / 2) / ((hi - lo) / 2), -1, 1)
        inside = (grid >= lo) & (grid <= hi)
        window = np.where(inside, np.i0(dk * np.sqrt(1 - at**2)) / np.i0(dk), 0.0)
        out = np.fft.fft(values * window)[: size // 2] * step / np.sqrt(np.pi)
        r = np.pi / (step * size) * np.arange(size // 2)
        keep = r <= rmax
        return pd.DataFrame({source: pdf[source].iloc[0], "r": r[keep], "mag": np.abs(out)[keep], "re": out.real[keep], "im": out.imag[keep]})

    kind = dict(spectra.dtypes)[source]
    return spectra.select(source, k, chi).groupBy(source).applyInPandas(one, f"{source} {kind}, r double, mag double, re double, im double")


def match_mutual(a: DataFrame, b: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """Pairs that are each other's nearest within the tolerance (symbols equal): what a
    greedy match in row order gives where the tolerance leaves one partner each."""
    from metalith.functions import geometry as G

    pairs = a.join(b, by).withColumn("q", G.d2(G.at("a_"), G.at("b_"))).where(F.col("q") <= tolerance * tolerance)
    wa, wb = Window.partitionBy(*by, "a_id").orderBy("q", "b_id"), Window.partitionBy(*by, "b_id").orderBy("q", "a_id")
    pairs = pairs.withColumns({"_ra": F.row_number().over(wa), "_rb": F.row_number().over(wb)})
    return pairs.where("_ra = 1 and _rb = 1").select(*by, "a_id", "b_id", F.sqrt("q").alias("d"))
