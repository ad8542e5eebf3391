"""Connected components of a link table, on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, new_path, removed

#: Up to so many ends of links their roots are broadcast (about 40 bytes each); beyond, joins shuffle.
BROADCAST_ENDS = 200_000


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for each node of the links, root the smallest node reachable.

    Each round takes the smallest root among the neighbours' and then the root's own
    root, so chains halve; rounds are written to the shared folder, which cuts the
    lineage and survives lost executors. A node costs one row a round, never a group.
    Where roots are broadcast, a round shuffles once: the driver keeps something of
    each stage and exchange that it has run."""
    spark = links.sparkSession
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct()
    at = new_path(spark, "edges")
    edges.write.parquet(at)
    edges = spark.read.parquet(at)
    few = edges.count() <= BROADCAST_ENDS
    side = lambda roots, *names: (F.broadcast if few else lambda x: x)(roots.select(*[F.col(c).alias(n) for c, n in zip(("node", "root"), names, strict=True)]))
    path = new_path(spark, "roots")
    edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("root"), F.lit(True).alias("moved")).write.parquet(path)
    while True:
        roots = spark.read.parquet(path)
        if roots.where("moved").isEmpty():
            removed(spark, at)
            return roots.select("node", "root")
        # a node's own root comes along with its neighbours'
        near = edges.join(side(roots, "y", "r"), "y").select(F.col("x").alias("node"), "r", F.lit(None).cast(roots.schema["root"].dataType).alias("old"))
        step = near.unionByName(roots.select("node", F.col("root").alias("r"), F.col("root").alias("old"))).groupBy("node").agg(F.min("r").alias("r"), F.max("old").alias("old"))
        step = step.join(side(roots, "r", "rr"), "r").select("node", F.least("r", "rr").alias("root"), (F.least("r", "rr") < F.col("old")).alias("moved"))
        later = new_path(spark, "roots")
        step.write.parquet(later)
        removed(spark, path)
        freed(spark)
        path = later
