"""Connected metal clusters: components, types, centroids, numbering, siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metalith.functions import geometry as G

from . import atoms as A
from .atoms import STRUCTURE
from .neighbors import metal_pairs


def _fold(nodes: Column, edges: Column) -> Column:
    """Union-find over sorted edges: each merge relabels, so one pass is exact."""

    def merge(label: Column, e: Column) -> Column:
        a = F.element_at(label, F.array_position(nodes, e["i"]).cast("int"))
        b = F.element_at(label, F.array_position(nodes, e["j"]).cast("int"))
        return F.transform(label, lambda v: F.when(v == F.greatest(a, b), F.least(a, b)).otherwise(v))

    return F.aggregate(edges, nodes, merge)


def components(metals: DataFrame, cutoff: float = 5.0) -> DataFrame:
    """``metals`` with ``root``: the first line of its component within the cutoff.

    One row per structure with an edge is folded in one expression; metals without a
    partner are their own root and never gathered."""
    pairs = metal_pairs(metals.select(*STRUCTURE, "line_no", "x", "y", "z"), cutoff)
    edges = pairs.groupBy(*STRUCTURE).agg(F.sort_array(F.collect_list(F.struct(F.col("a_line_no").alias("i"), F.col("b_line_no").alias("j")))).alias("_e"))
    edges = edges.withColumn("_n", F.array_sort(F.array_distinct(F.flatten(F.transform("_e", lambda e: F.array(e["i"], e["j"]))))))
    folded = edges.withColumn("_l", _fold(F.col("_n"), F.col("_e")))
    labels = folded.select(*STRUCTURE, F.explode(F.arrays_zip("_n", "_l")).alias("z")).select(*STRUCTURE, F.col("z._n").alias("line_no"), F.col("z._l").alias("root"))
    out = metals.join(labels, [*STRUCTURE, "line_no"], "left")
    return out.withColumn("root", F.coalesce("root", "line_no"))


def rooted(metals: Column, cutoff: float) -> Column:
    """The ``metals (atom, ...)`` of one structure, each with the ``root`` that ``components`` gives it."""
    line = lambda m: m["atom"]["line_no"]
    linked = lambda a, b: (line(a) < line(b)) & (G.d2(G.of(a["atom"]), G.of(b["atom"])) <= cutoff * cutoff)
    edges = lambda ms: F.sort_array(F.flatten(F.transform(ms, lambda a: F.transform(F.filter(ms, lambda b: linked(a, b)), lambda b: F.struct(line(a).alias("i"), line(b).alias("j"))))))
    nodes = lambda es: F.array_sort(F.array_distinct(F.flatten(F.transform(es, lambda e: F.array(e["i"], e["j"])))))
    root = lambda m, ns, roots: F.coalesce(F.get(roots, F.array_position(ns, line(m)).cast("int") - 1), line(m))
    with_roots = lambda ms, ns, es: A.let(_fold(ns, es), lambda roots: F.transform(ms, lambda m: m.withField("root", root(m, ns, roots))))
    return A.let(metals, lambda ms: A.let(edges(ms), lambda es: A.let(nodes(es), lambda ns: with_roots(ms, ns, es))))


def summary(metals: Column, target: str) -> dict[str, Column]:
    """``n_metals, cluster_type, cx, cy, cz`` of the metals of one cluster, as ``cluster_table`` has them."""
    same = F.forall(metals, lambda m: F.upper(m["atom"]["element"]) == target.upper())
    kind = F.when(F.size(metals) == 1, "homo").when(same, "multi_homo").otherwise("multi_hetero")

    def mean(k: str) -> Column:
        total = lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / F.size(v))
        return A.let(F.filter(F.transform(metals, lambda m: m["atom"][k]), lambda x: x.isNotNull()), total)

    return {"n_metals": F.size(metals).cast("long"), "cluster_type": kind, **{"c" + k: mean(k) for k in "xyz"}}


def cluster_table(labelled: DataFrame, target: str) -> DataFrame:
    """One row per component that holds a target atom (by atom name): number in order of
    first line, type, centroid, members."""
    is_target = F.upper("atom_name") == target.upper()
    c = labelled.groupBy(*STRUCTURE, "root").agg(
        F.count("*").alias("n_metals"),
        F.sum(is_target.cast("int")).alias("n_targets"),
        F.bool_and(F.upper("element") == target.upper()).alias("_same"),
        F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"),
        F.sort_array(F.collect_list("line_no")).alias("members"),
    )
    kind = F.when(F.col("n_metals") == 1, "homo").when(F.col("_same"), "multi_homo").otherwise("multi_hetero")
    c = c.where("n_targets > 0").withColumn("cluster_type", kind).drop("_same")
    return c.withColumn("cluster_number", F.row_number().over(Window.partitionBy(*STRUCTURE).orderBy("root")))


def targets(labelled: DataFrame, target: str) -> DataFrame:
    """Target atoms with the other target atoms of their component."""
    t = labelled.where(F.upper("atom_name") == target.upper())
    every = F.collect_list("serial").over(Window.partitionBy(*STRUCTURE, "root"))
    return t.withColumn("siblings", F.array_sort(F.array_except(every, F.array("serial"))))


def other_metals(labelled: DataFrame) -> DataFrame:
    """Per metal the elements of the other metals of its component, as ``EL:n, EL:n``."""
    a = labelled.select(*STRUCTURE, "root", "line_no", "serial")
    b = labelled.select(*STRUCTURE, "root", F.col("serial").alias("o_serial"), F.upper("element").alias("el"))
    n = a.join(b, [*STRUCTURE, "root"]).where("serial <> o_serial").groupBy(*STRUCTURE, "line_no", "el").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("el", "n"))), lambda s: F.concat_ws(":", s["el"], s["n"])), ", ")
    return n.groupBy(*STRUCTURE, "line_no").agg(text.alias("other_metals"))
