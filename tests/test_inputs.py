"""Input modes, the status table, keep-until-N with a restart, and fetching."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from metalith.sources import catalog, fetch, inputs
from metalith.streaming.batches import STATUS, StatusTable, keep_until


def got(df):
    return [(r["kind"], r["value"].rsplit("/", 1)[-1]) for r in df.orderBy("pos").collect()]


@pytest.fixture
def folder(tmp_path):
    for name in ("b.pdb", "a.pdb", "c.cif"):
        (tmp_path / name).write_text("X")
    (tmp_path / "ids.txt").write_text(" 9QQT,9qr3\n1abc  ,, 9QQT ")
    return tmp_path


def test_modes(spark, folder):
    state = spark.createDataFrame([("9QQT", "matched"), ("1abc", "in_progress"), ("2xyz", "error")], "entry_id string, status string")
    assert got(inputs.resolve(spark, "ids", [" 1ABC", "", "9qqt", "1abc", "2XYZ"])) == [("id", "1abc"), ("id", "9qqt"), ("id", "1abc"), ("id", "2xyz")]
    assert got(inputs.resolve(spark, "ids", ["1ABC", "9qqt", "1abc", "2XYZ"], state)) == [("id", "1abc"), ("id", "1abc")]
    assert got(inputs.resolve(spark, "list_file", [f"{folder}/ids.txt"], state)) == [("id", "9qr3"), ("id", "1abc")]
    assert got(inputs.resolve(spark, "list_file", [f"{folder}/none.txt"])) == got(inputs.resolve(spark, "list_file", [])) == []
    assert got(inputs.resolve(spark, "paths", [f"{folder}/b.pdb", f"{folder}/gone.pdb", str(folder), f"{folder}/c.cif"])) == [("file", "b.pdb"), ("file", "c.cif")]
    assert got(inputs.resolve(spark, "folder", [str(folder)])) == [("file", "a.pdb"), ("file", "b.pdb")]
    assert got(inputs.resolve(spark, "folder", [f"{folder}/nowhere"])) == []
    assert got(inputs.resolve(spark, "mixed", ["9QQT", f"{folder}/a.pdb", "toolong", "a!bc", "1ABC"], state)) == [("id", "9qqt"), ("file", "a.pdb"), ("id", "1abc")]
    with pytest.raises(ValueError, match="input mode"):
        inputs.resolve(spark, "nothing", [])


def test_search_mode_takes_each_entry_once_in_order(spark):
    entries = spark.createDataFrame([("9QQT", 1.5, "ZN"), ("1ABC", 2.5, "ZN"), ("9qqt", 1.0, "ZN"), ("3DEF", 1.1, "FE"), ("4GHI", 1.2, "zn")], "entry_id string, r double, c string").coalesce(1)
    search, columns = catalog.Search(component="ZN", resolution=2.0), {"component": "c", "resolution": "r"}
    assert got(inputs.resolve(spark, "search", entries, search=search, columns=columns)) == [("id", "9qqt"), ("id", "4ghi")]
    done = spark.createDataFrame([("9qqt", "rejected")], "entry_id string, status string")
    assert got(inputs.resolve(spark, "search", entries, done, search, columns)) == [("id", "4ghi")]


def test_keep_until_a_count_survives_a_restart(spark, tmp_path):
    candidates = inputs.resolve(spark, "ids", [f"{i}abc" for i in range(1, 10)] + ["1abc"])
    state = StatusTable(spark, str(tmp_path / "state"), "entry_id", ["seq"], STATUS, most=3)
    batches = []

    def process(now):
        ids = [r["value"] for r in now.orderBy("pos").collect()]
        batches.append(ids)
        if len(batches) == 2 and ids[0] == "3abc":
            raise RuntimeError("lost")
        # even entries are kept, the ninth gives no result at all
        return now.select(F.col("value").alias("entry_id"), F.when(F.substring("value", 1, 1).cast("int") % 2 == 0, "matched").otherwise("rejected").alias("status"), F.lit("coord").alias("reason")).where("entry_id <> '9abc'").distinct()

    with pytest.raises(RuntimeError):
        keep_until(candidates, process, state, target=3, batch=2)
    assert {r["entry_id"]: r["status"] for r in state.table().collect()} == {"1abc": "rejected", "2abc": "matched", "3abc": "in_progress", "4abc": "in_progress"}
    again = StatusTable(spark, str(tmp_path / "state"), "entry_id", ["seq"], STATUS, most=3)
    assert keep_until(candidates, process, again, target=3, batch=2) == 3
    assert batches == [["1abc", "2abc"], ["3abc", "4abc"], ["3abc", "4abc"], ["5abc", "6abc"]]
    assert keep_until(candidates, process, again, target=3, batch=2) == 3 and len(batches) == 4  # nothing left to do
    assert keep_until(candidates, process, again, target=100, batch=50) == 4
    assert {r["entry_id"]: r["status"] for r in again.table().collect()}["9abc"] == "error"
    assert len(again.numbers()) <= 3 and again.table().count() == 9


def test_status_table_keeps_the_latest_of_each_key(spark, tmp_path):
    t = StatusTable(spark, str(tmp_path / "t"), "id", ["seq"], "id long, seq long, status string", most=2)
    assert t.table().collect() == []
    for k in range(6):
        t.put(spark.createDataFrame([(i, k, f"s{k}") for i in range(6 - k)], "id long, seq long, status string"), k)
        t.put(spark.createDataFrame([(i, k, f"s{k}") for i in range(6 - k)], "id long, seq long, status string"), k)  # replayed
        assert len(t.numbers()) <= 2
    assert {r["id"]: r["status"] for r in t.table().collect()} == {i: f"s{5 - i}" for i in range(6)}


def test_fetch_all_reports_each_entry(spark):
    import gzip

    def get(url):
        if "1abc.pdb.gz" in url:
            return gzip.compress(b"ATOM")
        raise FileNotFoundError(url)

    df = spark.createDataFrame([("1abc",), ("2xyz",), ("bad",)], "entry_id string")
    out = {r["entry_id"]: (r["format"], r["text"], r["error"] is None) for r in fetch.fetch_all(df, get, "http://host").collect()}
    assert out == {"1abc": ("pdb", "ATOM", True), "2xyz": (None, None, False), "bad": (None, None, False)}
