"""Resumable batches: a status log, its latest state, what is pending, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DONE = ("matched", "rejected")
STATUSES = ("pending", "in_progress", "matched", "rejected", "error", "download_failed")


def latest(log: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """Last row of each id: the upsert of a keyed table."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("_r")).select(key, "_r.*")


def reset(state: DataFrame, status: str = "status") -> DataFrame:
    """A new run takes up what was in progress."""
    return state.withColumn(status, F.when(F.col(status) == "in_progress", "pending").otherwise(F.col(status)))


def pending(ids: DataFrame, state: DataFrame, key: str, done: tuple[str, ...] = DONE, status: str = "status") -> DataFrame:
    """Ids without a finished state, repeats kept."""
    return ids.join(state.where(F.col(status).isin(*done)).select(key), key, "left_anti")


def stats(state: DataFrame, status: str = "status") -> DataFrame:
    counts = [F.sum((F.col(status) == s).cast("long")).alias(s) for s in STATUSES]
    return state.agg(F.count("*").alias("total"), *counts)


def deletable(path: Column, download_dir: str, own: Column) -> Column:
    """Only own downloads inside the download folder may be deleted."""
    return own & path.startswith(download_dir.rstrip("/") + "/") & ~path.contains("..")


def reconcile(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Wanted ids with whether they were found."""
    f = found.select(key).distinct().withColumn("_f", F.lit(True))
    return wanted.join(f, key, "left").select(key, F.coalesce("_f", F.lit(False)).alias("found"))
