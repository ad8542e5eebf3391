"""The wide report tables and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metalith.schema import CLUSTER_FIELDS

from . import atoms as A
from . import clusters as C
from . import sites as S
from .atoms import STRUCTURE


def yes_no(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), "Yes").otherwise("No")


def cluster_csv(raw: DataFrame, config: S.SiteConfig, resolution: DataFrame | None = None) -> DataFrame:
    """The 30 report columns, one row per reported centre. ``resolution``: structure_id and
    resolution; a missing one is ``NA``."""
    rows = S.cluster_rows(raw, config)
    if resolution is not None:
        rows = rows.join(resolution, "structure_id", "left")
    else:
        rows = rows.withColumn("resolution", F.lit(None).cast("double"))
    xyz = F.concat_ws("_", "structure_id", F.concat(F.lit("cluster"), F.col("cluster_number").cast("string")), A.symbol(F.col("element")))
    values = {
        "PDB": F.col("structure_id"), "CLUSTER": F.col("cluster_number"), "CLUSTER_TYPE": F.col("cluster_type"), "CENTER_IDX": F.col("serial"),
        "CENTER_ELEM": F.col("element"), "CENTER_ATOMNAME": F.col("atom_name"), "CHAIN": F.col("chain"), "RESSEQ": F.col("resseq"), "ICODE": F.col("icode"),
        "RESNAME": F.col("resname"), "ALTLOC": F.col("altloc"), "OCC": F.col("occ"), "CN": F.coalesce("CN", F.lit(0)), "GEOM": F.coalesce("label", F.lit("UNK")),
        "COORD": F.col("coord_string"), "OTHER_METALS": F.col("other_metals"), "ALTLOC_CASE": F.lit(""), "ALTLOC_LABEL": F.lit(""),
        "XYZ_PATH": F.concat(xyz, F.lit(".xyz")),
    }
    values["RESOLUTION_A"] = F.when(F.col("resolution").isNull(), "NA").otherwise(F.format_string("%.2f", "resolution"))
    values |= {k: F.bround(F.coalesce(k, F.lit(0.0)), 4) for k in ("RMS_theta", "MAX_angle_dev", "sigma_d", "delta_d", "RMS_plane", "h_max")}
    values |= {k: yes_no(F.col(k)) for k in ("planar", "axial", "distorted", "JT")}
    return rows.select(*[values[k].alias(k) for k in CLUSTER_FIELDS])


def altloc_csv(raw: DataFrame, config: S.SiteConfig) -> DataFrame:
    """Metal records with a further alternate location and the cluster of their site."""
    labelled = C.components(A.metals(A.collapse_altloc(raw), config.excluded), config.cutoff)
    table = C.cluster_table(labelled, config.target).select(*STRUCTURE, "root", "cluster_number", "cluster_type")
    site = labelled.select(*STRUCTURE, *A.SITE_KEY, "root").join(table, [*STRUCTURE, "root"])
    out = A.altloc_metals(raw).join(site, [*STRUCTURE, *A.SITE_KEY])
    return out.select(F.col("structure_id").alias("pdb_id"), "record", "serial", "atom_name", "element", "altloc", "resname", "chain", "resseq", "x", "y", "z", F.col("cluster_number").alias("cluster_id"), "cluster_type")


def preferred_altloc(names: DataFrame, clusters: DataFrame, altlocs: DataFrame, order: str) -> DataFrame:
    """``names`` (xyz_name, pdb_id, cluster_id) with ``altloc``: that of the first row by ``order``
    of the cluster report which names the file and has one; else the only label of the
    cluster in the altloc report; else ``''``."""
    label = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    named = clusters.select(F.element_at(F.split(F.trim("XYZ_PATH"), "/"), -1).alias("xyz_name"), label("ALTLOC").alias("_a"), F.col(order).alias("_o"))
    named = named.where("_a <> '' and xyz_name <> ''").groupBy("xyz_name").agg(F.min_by("_a", "_o").alias("_named"))
    only = altlocs.select(F.lower(F.trim("pdb_id")).alias("pdb_id"), F.trim(F.col("cluster_id").cast("string")).alias("cluster_id"), label("altloc").alias("_a")).where("_a <> ''")
    only = only.groupBy("pdb_id", "cluster_id").agg(F.min("_a").alias("_low"), F.max("_a").alias("_high")).where("_low = _high").select("pdb_id", "cluster_id", F.col("_low").alias("_only"))
    out = names.join(named, "xyz_name", "left").join(only, ["pdb_id", "cluster_id"], "left")
    return out.withColumn("altloc", F.coalesce("_named", "_only", F.lit(""))).drop("_named", "_only")


def run_cache(sites: DataFrame, target: str, cutoff: float, radius: float) -> DataFrame:
    """One JSON-ready row per structure: run parameters and the paths of its clusters."""
    path = F.struct(F.concat_ws("_", "structure_id", F.col("cluster_number").cast("string")).alias("xyz_path"))
    runs = sites.groupBy("structure_id").agg(F.sort_array(F.collect_set(path)).alias("clusters"))
    return runs.select(F.col("structure_id").alias("pdb_id"), F.lit(target).alias("target"), F.lit(cutoff).alias("cutoff"), F.lit(radius).alias("selection_radius"), "clusters")


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_xyz(texts: DataFrame, path: str, by: str = "structure_id", mode: str = "append") -> None:
    """One folder per structure with its texts, a text a row (blank line between)."""
    texts.select(by, F.col("xyz_text").alias("value")).write.mode(mode).partitionBy(by).text(path)
