"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch of rows that goes to a Python worker; texts may be long.
BATCH_BYTES = 4 << 20

# Python workers get this package's functions with their tasks and need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])

#: ASCII white space of the word contracts: space and \t \n \v \f \r.
WHITE_SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    batched(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def batched(spark: SparkSession) -> None:
    """Bound the batches of Python workers by bytes, unless the session has its own bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def free(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text in order; a null text has none."""
    spaced = F.coalesce(text, F.lit(""))
    for c in WHITE_SPACE[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``;
    a local folder only where the setting is missing (one machine, as in tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="metalith-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        top = "file://" + local
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/metalith/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and
    survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The intermediate tables of one call, in a folder of their own in the shared folder.

    Each is written, which cuts the lineage and survives lost executors, and dropped
    after its last reader."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top = spark, new_path(spark, name)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.top}/{name}")
        freed(self.spark)
        return self.spark.read.schema(df.schema).parquet(f"{self.top}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more, and the shuffles that wrote them."""
        for name in names:
            removed(self.spark, f"{self.top}/{name}")
        freed(self.spark)


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` with a row number that is the same whenever it is read.

    Numbers follow the partitions of a scan of files, which do not change; anything but
    filters and projections of a scan is written first, since a shuffle may deal its rows
    differently when other columns are asked for."""
    nodes = [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() not in ("Project", "Filter", "LogicalRelation"):
            df = stored(df, "numbered")
            break
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return df.withColumn(name, F.monotonically_increasing_id())


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and broadcasts of queries that nothing refers to any
    more; it does so only when the driver collects its garbage, which a quiet driver hardly does.
    The driver's heap also shrinks to what is in use."""
    gc.collect()
    spark._jvm.System.gc()


def removed(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
