"""Gap sessionisation, vectorised in lockstep.

A click opens a new session if the click before it is final (``end``) or too far back (``gap``), or if the session's
first click is too far back (``length``). The first two breaks are local: they cut a client's clicks into
islands. Inside an island sessions follow each other, which is sequential; but all islands of a partition
advance together, one session a step, by one ``searchsorted`` of their composite keys (island, time).

Clicks are dealt by client and cell, a fixed stretch of time, so that a client with any share of all rows is spread
over as many tasks as it has cells. Only islands that may go on over the edge of a cell are left open. They are linked
to their neighbours; what runs in from the cell before is one fact, the start of the session that is
under way. A fragment open at both ends carries a step function from what runs in to what runs out, and links that hang
together are resolved by pointer doubling, in a logarithmic number of rounds, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, batched, read

MINUTE = 60_000_000


@dataclass(frozen=True)
class Rule:
    """Microseconds: least gap that parts, most that a session's first click may be back, most
    that an arrival may be after the click; and the length of a cell."""

    gap: int = 10 * MINUTE
    length: int = 40 * MINUTE
    late: int = 360 * MINUTE
    cell: int = 240 * MINUTE

    def __post_init__(self):
        if not 0 < self.gap + self.length < self.cell - self.gap or self.cell + self.length >= 1 << BITS:
            raise ValueError("a cell must be longer than a gap, a session and a gap, and shorter than 19 hours")


#: Bits of a composite key that hold the time since the island's first click.
BITS = 36
#: Clicks that a task looks at together; an island is never cut.
CHUNK = 200_000

SESSION = "client_id long, session_id long, start_us long, end_us long, n_clicks long, value_cents long, closed_by string, path string"
FRAGMENT = "cell long, head_open boolean, us array<long>, ids array<long>, cents array<long>, out_us long, out_id long, map_at array<long>, map_us array<long>, map_id array<long>"
PIECES = f"kind int, {SESSION}, {FRAGMENT}"
WHOLE, OPEN, LATE = 0, 1, 2


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column; one without a zone is read as UTC whatever the session's zone is."""
    c = F.col(f"`{name}`")
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(c)
    day = F.unix_date(c.cast("date")).cast("long") * 86_400_000_000
    return day + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")


def cleaned(clicks: DataFrame, final: Column, rule: Rule) -> DataFrame:
    """``(client_id, click_id, us, cents, final, late)``, once per click_id."""
    c = clicks.where("click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL")
    c = c.select(
        "click_id", "client_id", micros(clicks, "ts").alias("us"), micros(clicks, "arrived_at").alias("at"),
        F.floor(F.coalesce(F.col("value"), F.lit(0.0)) * 100 + 0.5).cast("long").alias("cents"), F.coalesce(final, F.lit(False)).alias("final"),
    )
    first = Window.partitionBy("click_id").orderBy(F.asc_nulls_last("at"), "us", "client_id", "cents", "final")
    c = c.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return c.select("client_id", "click_id", "us", "cents", "final", F.coalesce(F.col("at") > F.col("us") + rule.late, F.lit(False)).alias("late"))


# -- the lockstep ---------------------------------------------------------------------------------


def keys(us: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Composite keys of clicks in islands: number of the island, time since its first click."""
    island = np.repeat(np.arange(len(starts), dtype=np.int64), lengths)
    return (island << BITS) | (us - us[starts][island])


def lockstep(key: np.ndarray, ends: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Positions at which sessions start, if in some islands one starts at each of ``at``: every
    active island advances one session a step."""
    found = [at]
    while len(at):
        after = np.searchsorted(key, key[at] + length, side="right")
        at = after[after < ends[key[at] >> BITS]]
        found.append(at)
    return np.sort(np.concatenate(found))


def last_starts(key: np.ndarray, ends: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """For each of ``at`` alone, the start of its island's last session if one starts there."""
    at, active = at.copy(), np.arange(len(at))
    while len(active):
        after = np.searchsorted(key, key[at[active]] + length, side="right")
        go = after < ends[key[at[active]] >> BITS]
        active = active[go]
        at[active] = after[go]
    return at


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, pa.int64()))


def cut(us, ids, cents, begin, stop):
    """``end_us, n_clicks, value_cents, path`` of runs of clicks [begin, stop), in order and apart."""
    n = stop - begin
    sums = np.concatenate([[0], np.cumsum(cents)])
    inside = np.zeros(len(us) + 1, dtype=np.int64)
    np.add.at(inside, begin, 1)
    np.add.at(inside, stop, -1)
    text = pa.array(ids[np.cumsum(inside[:-1]) > 0], pa.int64()).cast(pa.string())
    offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    path = pc.binary_join(pa.ListArray.from_arrays(offsets, text), ",")
    end = pa.array(us[np.maximum(stop - 1, 0)] if len(us) else us, pa.int64(), mask=n == 0)
    return end, n, sums[stop] - sums[begin], path


def batch(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    """A batch of a schema; columns that are not given are null."""
    arrays = [pa.nulls(n, f.type) if columns.get(f.name) is None else c.cast(f.type) if isinstance(c := columns[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def pieces_of(client, cell, us, ids, cents, final, fresh, goes_on, rule: Rule, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Whole sessions and open fragments of clicks in order. ``fresh``: the first click of its client
    and cell. ``goes_on``: the click after the last one has the same client and cell."""
    if not len(us):
        return
    part = fresh.copy()
    part[0] = True
    part[1:] |= final[:-1] | (us[1:] - us[:-1] >= rule.gap)
    s = np.flatnonzero(part)
    e = np.append(s[1:], len(us))
    last, size = e - 1, e - s
    head = fresh[s] & (us[s] - cell[s] * rule.cell < rule.gap)
    closed_here = np.append(~fresh[s[1:]], goes_on)
    tail = ~closed_here & ~final[last] & ((cell[s] + 1) * rule.cell - us[last] < rule.gap)
    key = keys(us, s, size)
    whole = ~head & ~tail
    begin = lockstep(key, e, s[whole], rule.length)
    of = key[begin] >> BITS
    stop = np.minimum(np.append(begin[1:], len(us)), e[of])
    end_us, n, value, path = cut(us, ids, cents, begin, stop)
    closed = np.where(stop < e[of], "length", np.where(final[last[of]], "end", "gap"))
    yield batch(schema, len(begin), kind=np.full(len(begin), WHOLE), client_id=client[begin], session_id=ids[begin], start_us=us[begin], end_us=end_us, n_clicks=n, value_cents=value, closed_by=closed, path=path)
    left = np.flatnonzero(~whole)
    if not len(left):
        return
    rows = np.repeat(~whole, size)
    out = last_starts(key, e, s[left], rule.length)
    maps = [[], [], []]
    for k in left:
        if not (head[k] and tail[k]):
            for m in maps:
                m.append(None)
            continue
        enter = np.arange(s[k], s[k] + np.searchsorted(us[s[k] : e[k]], cell[s[k]] * rule.cell + rule.gap + rule.length, side="right"))
        to = last_starts(key, e, enter, rule.length)
        keep = np.append(to[1:] != to[:-1], True)
        for m, x in zip(maps, (us[enter], us[to], ids[to]), strict=True):
            m.append(x[keep])
    yield batch(
        schema, len(left), kind=np.full(len(left), OPEN), client_id=client[s[left]], cell=cell[s[left]], head_open=head[left],
        closed_by=[None if t else "end" if f else "gap" for t, f in zip(tail[left], final[last[left]], strict=True)],
        us=lists(us[rows], size[left]), ids=lists(ids[rows], size[left]), cents=lists(cents[rows], size[left]),
        out_us=us[out], out_id=ids[out], map_at=maps[0], map_us=maps[1], map_id=maps[2],
    )


def split(batches: Iterator[pa.RecordBatch], rule: Rule, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Whole sessions, open fragments and late clicks of a partition, whose rows come by client and time."""
    held, before, wait = None, None, CHUNK

    def fresh_of(c):
        new = np.ones(len(c[0]), dtype=bool)
        new[1:] = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])
        if before is not None and len(new):
            new[0] = before != (c[0][0], c[1][0])
        return new

    waiting: list[list[np.ndarray]] = []
    for b in batches:
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        late = columns.pop()
        if late.any():
            yield batch(schema, int(late.sum()), kind=np.full(late.sum(), LATE), client_id=columns[0][late], start_us=columns[2][late])
        waiting.append([c[~late] for c in columns])
        if sum(len(x[0]) for x in waiting) < wait:
            continue
        held = [np.concatenate(c) for c in zip(*waiting, strict=True)]
        fresh = fresh_of(held)
        part = fresh.copy()
        part[1:] |= held[5][:-1] | (held[2][1:] - held[2][:-1] >= rule.gap)
        at = int(np.flatnonzero(part)[-1]) if part.any() else 0  # the last island may go on
        if at:
            yield from pieces_of(*(c[:at] for c in held), fresh[:at], not fresh[at], rule, schema)
            before = (held[0][at - 1], held[1][at - 1])
        waiting = [[c[at:] for c in held]]
        wait = max(CHUNK, 2 * (len(held[0]) - at))  # an island without a break is not looked at again and again
    if waiting:
        held = [np.concatenate(c) for c in zip(*waiting, strict=True)]
        yield from pieces_of(*held, fresh_of(held), False, rule, schema)


def joined(batches: Iterator[pa.RecordBatch], rule: Rule, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sessions of open fragments, given ``carry_us, carry_id``, the start of the session that runs in
    (null: none does). What goes on elsewhere is a part: ``cell`` orders the parts of a session."""
    for b in batches:
        col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        client, cell = (col[n].to_numpy() for n in ("client_id", "cell"))
        closed = np.array(col["closed_by"].to_pylist(), dtype=object)
        size = pc.list_value_length(col["us"]).to_numpy(zero_copy_only=False).astype(np.int64)
        us, ids, cents = (pc.list_flatten(col[n]).to_numpy() for n in ("us", "ids", "cents"))
        e = np.cumsum(size)
        s = e - size
        key = keys(us, s, size)
        runs_in = ~col["carry_us"].is_null().to_numpy(zero_copy_only=False)
        carry_us, carry_id = (pc.fill_null(col[n], 0).to_numpy() for n in ("carry_us", "carry_id"))
        bound = (np.arange(len(s), dtype=np.int64) << BITS) + np.where(runs_in, np.maximum(carry_us + rule.length - us[s], -1), -1)
        enter = np.searchsorted(key, bound, side="right")
        begin = lockstep(key, e, enter[enter < e], rule.length)
        of = key[begin] >> BITS
        stop = np.minimum(np.append(begin[1:], len(us)), e[of])
        end_us, n, value, path = cut(us, ids, cents, begin, stop)
        why = np.where(stop < e[of], "length", closed[of])
        yield batch(
            schema, len(begin), client_id=client[of], session_id=ids[begin], start_us=us[begin], end_us=end_us, n_clicks=n, value_cents=value,
            closed_by=why.tolist(), path=path, cell=cell[of], part=[w is None for w in why.tolist()],
        )
        k = np.flatnonzero(runs_in)
        end_us, n, value, path = cut(us, ids, cents, s[k], enter[k])
        why = np.where(enter[k] < e[k], "length", closed[k])
        yield batch(
            schema, len(k), client_id=client[k], session_id=carry_id[k], start_us=carry_us[k], end_us=end_us, n_clicks=n, value_cents=value,
            closed_by=why.tolist(), path=path, cell=cell[k], part=np.ones(len(k), dtype=bool),
        )


def followed(frames, rule: Rule):
    """A fragment's step function after that of the fragment it hangs on, or applied to what runs out there."""
    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            at, to_us, to_id = (np.asarray(x, dtype=np.int64) for x in (r.map_at, r.map_us, r.map_id))
            if r.known:
                i = np.searchsorted(at, int(r.p_us) + rule.length, side="right")
                out.append((r.client_id, r.cell, None, True, int(to_us[i]), int(to_id[i]), None, None, None))
            else:
                i = np.searchsorted(at, np.asarray(r.p_map_us, dtype=np.int64) + rule.length, side="right")
                keep = np.append(i[1:] != i[:-1], True)
                out.append((r.client_id, r.cell, int(r.p_on), False, None, None, np.asarray(r.p_map_at)[keep], to_us[i][keep], to_id[i][keep]))
        yield type(f)(out, columns=["client_id", "cell", "on", "known", "us", "id", "map_at", "map_us", "map_id"])


# -- the jobs -------------------------------------------------------------------------------------

STATE = "client_id long, cell long, `on` long, known boolean, us long, id long, map_at array<long>, map_us array<long>, map_id array<long>"


def carries(open_: DataFrame, rule: Rule, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(client_id, cell, carry_us, carry_id)`` of the fragments that a session runs into, and
    ``(client_id, cell)`` of those that run on."""
    tails = open_.where("closed_by IS NULL").select("client_id", (F.col("cell") + 1).alias("cell"), F.element_at("us", -1).alias("left"))
    heads = open_.where("head_open").select("client_id", "cell", F.element_at("us", 1).alias("right"))
    links = scratch.put(tails.join(heads, ["client_id", "cell"]).where(F.col("right") - F.col("left") < rule.gap).select("client_id", "cell"), "links")
    out = open_.where("closed_by IS NULL").select("client_id", "cell", "head_open", "out_us", "out_id", "map_at", "map_us", "map_id")
    out = out.join(links.withColumn("_in", F.lit(True)), ["client_id", "cell"], "left").withColumn("known", ~(F.col("head_open") & F.col("_in").isNotNull()))
    given = lambda c: F.when(F.col("known"), F.col(c))
    state = out.select(
        "client_id", "cell", F.expr("if(known, null, cell - 1)").alias("on"), "known", given("out_us").alias("us"), given("out_id").alias("id"),
        *(F.expr(f"if(known, null, {m})").alias(m) for m in ("map_at", "map_us", "map_id")),
    )
    state, n = scratch.put(state, "state0"), 0
    while state.where("NOT known").limit(1).count():
        prior = state.select("client_id", F.col("cell").alias("on"), F.col("known").alias("p_known"), F.col("us").alias("p_us"), F.col("on").alias("p_on"), F.col("map_at").alias("p_map_at"), F.col("map_us").alias("p_map_us"))
        step = state.where("NOT known").drop("known", "us", "id").join(prior.withColumnRenamed("p_known", "known"), ["client_id", "on"])
        step = step.select("client_id", "cell", "known", "map_at", "map_us", "map_id", "p_us", "p_on", "p_map_at", "p_map_us").mapInPandas(lambda fs: followed(fs, rule), STATE)
        later = scratch.put(state.where("known").unionByName(step), f"state{n + 1}")
        scratch.drop(f"state{n}")
        state, n = later, n + 1
    carry = state.select("client_id", (F.col("cell") + 1).alias("cell"), F.col("us").alias("carry_us"), F.col("id").alias("carry_id")).join(links, ["client_id", "cell"], "left_semi")
    return carry, links.select("client_id", (F.col("cell") - 1).alias("cell"))


def sessionise(clicks: DataFrame, final: Column | None = None, rule: Rule | None = None) -> DataFrame:
    """Sessions of ``clicks (click_id, ts, arrived_at, client_id, value)`` and what ``final`` names:
    ``client_id, session_id`` (its first click), ``start_us, end_us, n_clicks, n_late, value_cents, closed_by, path`` (its
    click_ids, comma-joined).

    Rows without click_id, client_id or ts are left out. Of rows of one click_id the first to
    arrive counts (ties: the smallest ts, client, value). A null arrival is timely, a null ``final`` is not final, a null
    value is 0. Late clicks belong to no session; they are counted at the one that began last before them, or not at
    all. Clients with late clicks only have no session; an empty table has none. Extra columns are ignored."""
    spark, rule = clicks.sparkSession, rule or Rule()
    final = ((F.col("kind") == "error") & (F.col("value") >= 60)) if final is None else final
    batched(spark)
    scratch = Scratch(spark, "sessions")
    rows = cleaned(clicks, final, rule).select("client_id", F.expr(f"us div {rule.cell} - if(us % {rule.cell} < 0, 1, 0)").alias("cell"), "us", "click_id", "cents", "final", "late")
    rows = rows.repartition("client_id", "cell").sortWithinPartitions("client_id", "us", "click_id")
    kinds = _arrow(PIECES)
    pieces = scratch.put(rows.mapInArrow(lambda bs: split(bs, rule, kinds), PIECES), "pieces")
    names = SESSION.replace(",", "").split()[::2]
    open_ = pieces.where(f"kind = {OPEN}")
    carry, runs_on = carries(open_, rule, scratch)
    some = open_.join(carry, ["client_id", "cell"], "left").join(runs_on.withColumn("_on", F.lit(True)), ["client_id", "cell"], "left")
    # of fragments that seemed open at their end, those without a neighbour end in a gap
    goes_on = F.when(F.col("closed_by").isNull() & F.col("_on").isNull(), F.lit("gap")).otherwise(F.col("closed_by"))
    is_in = F.col("head_open") & F.col("carry_us").isNotNull()
    some = some.select("client_id", "cell", goes_on.alias("closed_by"), "us", "ids", "cents", F.when(is_in, F.col("carry_us")).alias("carry_us"), F.when(is_in, F.col("carry_id")).alias("carry_id"))
    parts_ddl = f"{SESSION}, cell long, part boolean"
    part_types = _arrow(parts_ddl)
    parts = scratch.put(some.mapInArrow(lambda bs: joined(bs, rule, part_types), parts_ddl), "parts")
    paths = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("n_clicks") > 0, F.struct("cell", "path")))), lambda x: x["path"]), ",")
    merged = (
        parts.where("part").groupBy("client_id", "session_id", "start_us")
        .agg(F.max("end_us").alias("end_us"), F.sum("n_clicks").alias("n_clicks"), F.sum("value_cents").alias("value_cents"), F.max("closed_by").alias("closed_by"), paths.alias("path"))
    )
    whole = pieces.where(f"kind = {WHOLE}").select(names).unionByName(parts.where("NOT part").select(names)).unionByName(merged.select(names))
    late = pieces.where(f"kind = {LATE}").select("client_id", F.col("start_us").alias("us"))
    return _with_late(whole, late, rule).select("client_id", "session_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents", "closed_by", "path")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def _with_late(whole: DataFrame, late: DataFrame, rule: Rule) -> DataFrame:
    """Sessions with ``n_late``, and ``none`` for a client's last one instead of ``gap``.

    Late clicks find their session in their own cell; those before a cell's first session go, as one
    count a cell, to the last session of an earlier cell. That walk orders a client's cells, not its clicks."""
    cell = F.expr(f"us div {rule.cell} - if(us % {rule.cell} < 0, 1, 0)")
    begun = whole.select("client_id", F.col("start_us").alias("us"), "session_id", F.lit(0).alias("is_late"))
    events = begun.unionByName(late.select("client_id", "us", F.lit(None).cast("long").alias("session_id"), F.lit(1).alias("is_late"))).withColumn("cell", cell)
    running = Window.partitionBy("client_id", "cell").orderBy("us", "is_late", "session_id").rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("of", F.last("session_id", ignorenulls=True).over(running))
    latest = F.max(F.when(F.col("is_late") == 0, F.struct("us", "session_id")))
    # one row a session with late clicks in its cell, one row a cell
    per = events.where("is_late = 1 AND of IS NOT NULL").groupBy(F.col("of").alias("session_id")).agg(F.count("*").alias("n_late"))
    cells = events.groupBy("client_id", "cell").agg(latest["session_id"].alias("last"), F.count_if((F.col("is_late") == 1) & F.col("of").isNull()).alias("before"))
    walk = Window.partitionBy("client_id").orderBy("cell")
    cells = cells.withColumn("prior", F.last("last", ignorenulls=True).over(walk.rowsBetween(Window.unboundedPreceding, -1)))
    cells = cells.withColumn("final_cell", F.max(F.when(F.col("last").isNotNull(), F.col("cell"))).over(Window.partitionBy("client_id")))
    carried = cells.where("before > 0 AND prior IS NOT NULL").select(F.col("prior").alias("session_id"), F.col("before").alias("n_late"), F.lit(False).alias("is_last"))
    ends = cells.where("cell = final_cell").select(F.col("last").alias("session_id"), F.lit(0).cast("long").alias("n_late"), F.lit(True).alias("is_last"))
    facts = per.withColumn("is_last", F.lit(False)).unionByName(carried).unionByName(ends).groupBy("session_id").agg(F.sum("n_late").alias("n_late"), F.max("is_last").alias("is_last"))
    out = whole.join(facts, "session_id", "left")
    closed = F.when(F.col("is_last") & (F.col("closed_by") == "gap"), F.lit("none")).otherwise(F.col("closed_by"))
    return out.withColumn("closed_by", closed).withColumn("n_late", F.coalesce("n_late", F.lit(0).cast("long")))


def op12_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sessionise(read(spark, sf_dir, "clicks"))
    return out.withColumn("path_sha256", F.sha2(F.col("path"), 256)).drop("path")


OP12_SQL = """
WITH RECURSIVE once AS (
  SELECT *, epoch_us(ts) AS us FROM (
    SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY arrived_at NULLS LAST, ts, client_id, value, kind) AS k
    FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL)
  WHERE k = 1),
timely AS (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY client_id) AS n,
    CASE WHEN lag(final) OVER w THEN 'end' WHEN us - lag(us) OVER w >= 600000000 THEN 'gap' END AS broke,
    1 + count(*) OVER (PARTITION BY client_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 2400000000 FOLLOWING) AS by_length
  FROM (SELECT click_id, client_id, us, CAST(floor(100 * coalesce(value, 0) + 0.5) AS BIGINT) AS cents, coalesce(kind = 'error' AND value >= 60, false) AS final
        FROM once WHERE NOT coalesce(arrived_at > ts + INTERVAL 360 MINUTE, false))
  WINDOW w AS (PARTITION BY client_id ORDER BY us, click_id)),
hop AS (
  SELECT client_id, rn, n, least(by_length, coalesce(min(CASE WHEN broke IS NOT NULL THEN rn END)
    OVER (PARTITION BY client_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n + 1)) AS nxt FROM timely),
starts AS (
  SELECT client_id, rn, nxt, n FROM hop WHERE rn = 1
  UNION ALL
  SELECT h.client_id, h.rn, h.nxt, h.n FROM starts s JOIN hop h ON h.client_id = s.client_id AND h.rn = s.nxt),
s AS (
  SELECT s.client_id, s.rn, s.nxt, f.us AS start_us, f.click_id AS session_id,
    CASE WHEN l.final THEN 'end' WHEN s.nxt > s.n THEN 'none' ELSE coalesce(t.broke, 'length') END AS closed_by,
    lead(f.us) OVER (PARTITION BY s.client_id ORDER BY s.rn) AS next_us
  FROM starts s JOIN timely f ON f.client_id = s.client_id AND f.rn = s.rn JOIN timely l ON l.client_id = s.client_id AND l.rn = s.nxt - 1
  LEFT JOIN timely t ON t.client_id = s.client_id AND t.rn = s.nxt),
late AS (
  SELECT s.client_id, s.rn, count(*) AS n_late FROM s JOIN once o ON o.client_id = s.client_id AND o.us >= s.start_us AND (s.next_us IS NULL OR o.us < s.next_us)
  WHERE o.arrived_at > o.ts + INTERVAL 360 MINUTE GROUP BY ALL)
SELECT s.client_id, s.session_id, s.start_us, max(t.us) AS end_us, count(*) AS n_clicks, coalesce(any_value(l.n_late), 0) AS n_late, CAST(sum(t.cents) AS BIGINT) AS value_cents,
  any_value(s.closed_by) AS closed_by, sha256(string_agg(CAST(t.click_id AS VARCHAR), ',' ORDER BY t.rn)) AS path_sha256
FROM s JOIN timely t ON t.client_id = s.client_id AND t.rn >= s.rn AND t.rn < s.nxt LEFT JOIN late l ON l.client_id = s.client_id AND l.rn = s.rn
GROUP BY s.client_id, s.session_id, s.start_us, s.rn
"""
