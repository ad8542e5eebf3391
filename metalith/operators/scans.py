"""Groups of an angle scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("alpha", "beta", "gamma")


def scan_group(entries: DataFrame, axis: str, zero: float = 1e-9) -> DataFrame:
    """Entries that turn about ``axis``, whatever the other angles, and those with no turn at
    all. In order of the angle, then ``name``, when shown."""
    flat = lambda k: F.abs(F.col(k)) <= zero
    base = flat(AXES[0]) & flat(AXES[1]) & flat(AXES[2])
    return entries.where(~flat(axis) | base)
