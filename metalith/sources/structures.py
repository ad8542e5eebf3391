"""Structure files of either format as one atoms relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metalith.schema import ATOM

from .mmcif import mmcif_atoms
from .pdb import FILE, file_format, model_number, parse_atoms

STEM = r"([^/]+?)(\.[A-Za-z]+)?(\.gz)?$"


def first_model(lines: DataFrame) -> DataFrame:
    """Lines (with ``model``) of model 1 and before the first ENDMDL of their file."""
    end = lines.where(F.col("line").startswith("ENDMDL")).groupBy(*FILE).agg(F.min("line_no").alias("_end"))
    return lines.join(end, FILE, "left").where("model = 1 and (_end is null or line_no < _end)").drop("_end")


def load_atoms(spark: SparkSession, paths: str | list[str], first_model_only: bool = False, auth_ids: bool = False) -> DataFrame:
    """Atoms of fixed-width and mmCIF files, each read as its name or first line says.

    ``first_model_only`` concerns fixed-width files; mmCIF files keep all models. Empty and
    unreadable files have no atoms."""
    path = F.col("_metadata.file_path")
    files = spark.read.text(paths, wholetext=True).select(
        F.regexp_extract(path, STEM, 1).alias("structure_id"), "value", file_format(path, F.element_at(F.split("value", "\r?\n", 2), 1)).alias("format")
    )
    lines = files.where("format = 'pdb'").select("structure_id", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    lines = model_number(lines.withColumn("line_no", F.col("line_no").cast("long")))
    plain = parse_atoms(first_model(lines) if first_model_only else lines)
    cif = mmcif_atoms(files.where("format = 'cif'").select("structure_id", "value"), auth_ids)
    return plain.select(*[F.col(f.name).cast(f.dataType) for f in ATOM]).unionByName(cif)
