"""Where structures come from: six input modes as one relation of candidates in order.

``pos`` numbers the candidates; ``kind`` is ``id`` (to be fetched) or ``file`` (given by the user, never deleted by a run)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import catalog

MODES = ("ids", "paths", "folder", "list_file", "search", "mixed")
#: Statuses after which an id is not taken up again.
FINISHED = ("matched", "rejected", "error", "download_failed")
SCHEMA = "pos long, kind string, value string"


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path is a file, in whatever store Spark can read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def listing(spark: SparkSession, folder: str, pattern: str = "*.pdb") -> DataFrame:
    """``path, length`` of the files of a folder, none of them opened."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")


def _numbered(df: DataFrame, value: str) -> DataFrame:
    """Candidates by ``value``: files of one folder, as many as a driver can list."""
    return df.select((F.row_number().over(Window.orderBy(value)) - 1).cast("long").alias("pos"), F.lit("file").alias("kind"), F.col(value).alias("value"))


def resolve(spark: SparkSession, mode: str, data: list[str] | DataFrame | None = None, state: DataFrame | None = None, search: catalog.Search | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """``pos, kind, value`` of an input.

    ``ids``: a list of entry ids; ``list_file``: a text with ids between commas and white space; ``search``: the entries of the
    catalogue ``data`` (entry_id and the columns that ``columns`` names) that fit ``search``, by first row, each once. Ids are
    trimmed and lower-cased, blank ones go, and so do those that ``state`` (entry_id, status) has finished; repeats stay.
    ``paths``: files that exist; ``folder``: its ``*.pdb`` files by name. ``mixed``: files that exist, and items of four
    letters or digits as ids; these three do not look at ``state``. What does not exist gives nothing."""
    none = spark.createDataFrame([], SCHEMA)
    items = [x for x in data if x] if isinstance(data, list) else []
    if mode == "folder":
        folder = items[0] if items else "."
        return _numbered(listing(spark, folder), "path") if is_folder(spark, folder) else none
    if mode in ("paths", "mixed"):
        rows = []
        for i, x in enumerate(items):
            if is_file(spark, x):
                rows.append((i, "file", x))
            elif mode == "mixed" and len(x) == 4 and x.isalnum():
                rows.append((i, "id", x.lower()))
        return spark.createDataFrame(rows, SCHEMA)
    if mode == "ids":
        ids = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "pos long, value string")
    elif mode == "list_file":
        if not items or not is_file(spark, items[0]):
            return none
        ids = spark.read.text(items[0], wholetext=True).select(F.posexplode(catalog.split_ids(F.col("value"))).alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))
    elif mode == "search":
        found = data.withColumn("_row", F.monotonically_increasing_id()).where((search or catalog.Search()).condition(columns or {}))
        ids = found.groupBy(F.lower(F.trim("entry_id")).alias("value")).agg(F.min("_row").alias("pos")).select("pos", "value")
    else:
        raise ValueError(f"input mode {mode!r} is none of {', '.join(MODES)}")
    ids = ids.select("pos", F.lit("id").alias("kind"), F.lower(F.trim("value")).alias("value")).where("value <> ''")
    if state is not None:
        done = state.where(F.col("status").isin(*FINISHED)).select(F.lower("entry_id").alias("value"))
        ids = ids.join(done, "value", "left_anti").select("pos", "kind", "value")
    return ids
