"""Fetching entries by id: a connector around a function that gets one URL.

The library itself opens no connection; ``get`` does (for instance with urllib)."""

from __future__ import annotations

import gzip
import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

ENTRY_ID = re.compile(r"^[1-9][A-Za-z0-9]{3}$")
MOST_BYTES, ATTEMPTS = 50 * 1024 * 1024, 3


class FetchError(Exception):
    """The entry is missing, too large, or could not be read in all attempts."""


def fetch_entry(entry: str, get: Callable[[str], bytes], base: str, most: int = MOST_BYTES, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> tuple[str, str]:
    """``(format, text)``: plain, then zipped fixed-width text, then zipped mmCIF."""
    if not ENTRY_ID.match(entry or ""):
        raise FetchError(f"not an entry id: {entry!r}")
    last: Exception | None = None
    for suffix, fmt in ((".pdb", "pdb"), (".pdb.gz", "pdb"), (".cif.gz", "cif")):
        for k in range(attempts):
            try:
                data = get(f"{base}/{entry.lower()}{suffix}")
            except FileNotFoundError as e:
                last = e
                break
            except OSError as e:
                last = e
                wait(2.0**k)
                continue
            if len(data) > most:
                raise FetchError(f"{entry}: over {most} bytes")
            return fmt, (gzip.decompress(data) if suffix.endswith(".gz") else data).decode("utf-8", "replace")
    raise FetchError(f"{entry}: {last}")


def fetch_all(ids: DataFrame, get: Callable[[str], bytes], base: str, column: str = "entry_id") -> DataFrame:
    """``entry_id, format, text, error`` of each id, fetched on the executors; a task holds one text at a time."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for entry in batch[column]:
                try:
                    row = (entry, *fetch_entry(entry, get, base), None)
                except FetchError as e:
                    row = (entry, None, None, str(e))
                yield pd.DataFrame([row], columns=["entry_id", "format", "text", "error"])

    return ids.select(column).mapInPandas(run, "entry_id string, format string, text string, error string")
