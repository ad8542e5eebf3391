from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TABLES += "clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.fixture
def same(spark, duck, tmp_path):
    """Compare a query with its SQL: schema and rows, in any order."""

    def check(query, sql):
        query(spark, DATA).write.parquet(str(tmp_path / "q"))
        duck.sql(f"CREATE OR REPLACE VIEW q AS SELECT * FROM '{tmp_path}/q/*.parquet'")
        duck.sql(f"CREATE OR REPLACE TABLE o AS {sql}")
        kind = lambda t: sorted(r[:2] for r in duck.sql(f"DESCRIBE {t}").fetchall())
        assert kind("q") == kind("o")
        cols = ", ".join(f'"{n}"' for n, _ in kind("q"))
        for a, b in (("q", "o"), ("o", "q")):
            assert duck.sql(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b}").fetchall() == []

    return check
