"""Sessionisation against a plain loop over each client's clicks, and on odd rows."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from metalith.llm import sessions

EPOCH = datetime(1970, 1, 1)
DDL = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, cell long, part boolean, us long"


def at(us):
    return None if us is None else EPOCH + timedelta(microseconds=us)


def table(spark, rows):
    """Clicks with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, at(t), at(a), c, k, v, "{}", 5, True, 7) for i, t, a, c, k, v in rows], DDL)


def plain(rows, rule):
    """The contract, click by click."""
    best = {}
    for i, t, a, c, k, v in rows:
        if i is not None and t is not None and c is not None:
            cents = int(np.floor(100 * (v or 0.0) + 0.5))
            final = k == "error" and v is not None and v >= 60
            best.setdefault(i, []).append(((a is None, a or 0, t, c, cents, final), (i, t, a, c, cents, final)))
    clients = {}
    for group in best.values():
        row = min(group)[1]
        clients.setdefault(row[3], []).append(row)
    out = set()
    for c, group in clients.items():
        late = [r[1] for r in group if r[2] is not None and r[2] > r[1] + rule.late]
        runs, why = [], []
        for r in sorted((r for r in group if r[2] is None or r[2] <= r[1] + rule.late), key=lambda r: (r[1], r[0])):
            reason = None
            if runs:
                last = runs[-1]
                reason = "end" if last[-1][5] else "gap" if r[1] - last[-1][1] >= rule.gap else "length" if r[1] - last[0][1] > rule.length else None
            if not runs or reason:
                why += [reason] * bool(runs)
                runs.append([])
            runs[-1].append(r)
        if runs:
            why.append("end" if runs[-1][-1][5] else "none")
        for k, run in enumerate(runs):
            stop = runs[k + 1][0][1] if k + 1 < len(runs) else None
            n_late = sum(1 for t in late if t >= run[0][1] and (stop is None or t < stop))
            out.add((c, run[0][0], run[0][1], run[-1][1], len(run), n_late, sum(r[4] for r in run), why[k], ",".join(str(r[0]) for r in run)))
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


SMALL = sessions.Rule(gap=10, length=40, late=360, cell=70)


def made(seed, n=1500):
    """One client without a pause, one with many, one that often ends; ties, repeats, late, broken rows."""
    rng, rows, i = random.Random(seed), [], 0
    for client, steps, ends in ((7, (0, 1, 2, 3), 0.0), (8, (0, 3, 9, 10, 60, 300), 0.05), (9, (0, 1, 2, 5), 0.2), (-4, (1, 7, 9), 0.01)):
        t = rng.choice((-5_000, 0, 69, 70))
        for _ in range(n if client == 7 else n // 4):
            t += rng.choice(steps)
            kind = "error" if rng.random() < ends else rng.choice(("view", None))
            value = rng.choice((None, 59.99, 60.0, 1.005, -3.333, 90.0)) if kind != "error" else rng.choice((60.0, 75.5))
            arrived = t + rng.choice((0, 5, 360, 361, 900)) if rng.random() < 0.2 else rng.choice((t, None))
            rows.append((i, t, arrived, client, kind, value))
            i += 1
    rows += rng.sample(rows, 60)
    rows += [(i, t + 1, a, c, k, v) for i, t, a, c, k, v in rng.sample(rows, 20)]  # one id, other times
    rows += [(i + 1, None, 5, 7, "view", 1.0), (i + 2, 5, 5, None, "view", 1.0), (None, 5, 5, 7, "view", 1.0), (i + 3, 9, 9_000, 55, "view", 1.0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_sessions_equal_a_plain_loop(spark, seed):
    rows = made(seed)
    df = table(spark, rows).repartition(5)
    assert got(sessions.sessionise(df, rule=SMALL)) == plain(rows, SMALL)


def test_unbroken_clients_over_many_cells(spark, monkeypatch):
    """Islands over 60 cells, so that step functions are followed in several rounds; sparse steps leave little choice,
    dense ones much."""
    tables, put = [], sessions.Scratch.put
    monkeypatch.setattr(sessions.Scratch, "put", lambda self, df, name: tables.append(name) or put(self, df, name))
    rng, rows = random.Random(3), []
    for client, top in ((1, 1), (2, 4), (3, 9), (4, 8)):
        t = 11
        while t < 4200:
            rows.append((len(rows), t, t, client, "view", 1.0))
            t += rng.randint(0 if top < 9 else 8, top)
    want = plain(rows, SMALL)
    assert {r[7] for r in want} == {"length", "none"} and len(want) > 250
    assert got(sessions.sessionise(table(spark, rows), rule=SMALL)) == want
    assert 4 <= sum(t.startswith("state") for t in tables) - 1 <= 7  # rounds, for 60 cells in a row


def test_partition_is_cut_at_islands_only(monkeypatch):
    """Chunks of any size give the same pieces."""
    import pyarrow as pa

    rows = sorted((c, t // 70, t, i, 1, k == "error", False) for i, t, a, c, k, v in made(5, 400)[:300] if None not in (i, t, c))
    schema = sessions._arrow(sessions.PIECES)
    whole = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=list("abcdefg"))

    def pieces(chunk, step):
        monkeypatch.setattr(sessions, "CHUNK", chunk)
        out = sessions.split((whole.slice(i, step) for i in range(0, len(rows), step)), SMALL, schema)
        return sorted(map(repr, (r for b in out for r in b.to_pylist())))

    first = pieces(10_000, 10_000)
    assert len(first) > 20 and all(pieces(c, s) == first for c, s in ((1, 1), (7, 3), (50, 20)))


def test_hot_client_is_dealt_over_cells(spark):
    """No task gets more than a client's clicks of one cell."""
    rows = [(i, i * 3, i * 3, 7, "view", 1.0) for i in range(3000)]
    df = sessions.cleaned(table(spark, rows), F.lit(False), SMALL).withColumn("cell", F.expr("us div 70")).repartition(8, "client_id", "cell")
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 0.3 * 3000


def test_odd_tables(spark):
    assert got(sessions.sessionise(table(spark, []).limit(0), rule=SMALL)) == set()
    late = [(1, 5, 5000, 1, "view", 2.0), (2, 9, 5000, 1, None, None)]
    assert got(sessions.sessionise(table(spark, late), rule=SMALL)) == set()
    broken = [(None, 1, 1, 1, "a", 1.0), (1, None, 1, 1, "a", 1.0), (2, 1, 1, None, "a", 1.0), (3, 1, None, 4, None, None)]
    assert got(sessions.sessionise(table(spark, broken), rule=SMALL)) == {(4, 3, 1, 1, 1, 0, 0, "none", "3")}


def test_micros_do_not_depend_on_the_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        us = [0, -1, 1_710_054_900_123_456, -86_400_000_001]
        df = spark.createDataFrame([(at(x),) for x in us], "t timestamp_ntz")
        assert [r[0] for r in df.select(sessions.micros(df, "t")).collect()] == us
        zoned = spark.createDataFrame([(datetime(2024, 3, 10, 7, 15, tzinfo=UTC),)], "t timestamp")
        assert zoned.select(sessions.micros(zoned, "t")).first()[0] == 1_710_054_900_000_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rule_bounds():
    with pytest.raises(ValueError):
        sessions.Rule(cell=50 * sessions.MINUTE)
    with pytest.raises(ValueError):
        sessions.Rule(cell=1 << 37)
