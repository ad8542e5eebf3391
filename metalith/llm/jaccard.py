"""N-gram Jaccard join with a token-group matrix; exact components of near copies.

1. A text's set is its distinct word shingles, hashed to 64 bits. Texts of one set are
   one class; classes, not rows, are compared.
2. Similar classes are partitioned into groups around a leader (classes that share a
   pair of min-hashes with it and differ in half as many tokens as they have).
3. Inside a group a member A is stored as its difference to the leader L. For members
   A, B the symmetric difference of A and B is that of their differences, and if the
   differences together are within the allowed distance then both are linked to L.
   All other links need common difference tokens, so a prefix filter on the
   differences finds them, rare tokens first, without visiting all pairs.
4. Across groups the token-group matrix holds, per group, the union of its members'
   prefix tokens, by which queries look groups up. The tokens that a query has in common
   with the union of a group's whole sets bound its overlap with every member; only
   groups that reach the bound are opened, and their members verified with whole sets.
   Groups that the links so far join into one component count as one.
5. Components of the links give the smallest document id.

Prefixes are ordered by a rarity class from a fixed-size count sketch over all texts;
any order gives the same links, a better one fewer candidates. With overlap
o >= ceil(T n / 100), the first n - o + l tokens of two linked sets share l at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, batched, freed, numbered, read, stored
from .components import components

WORDS, PERCENT = 3, 90
#: Counters of the rarity sketch (one byte each goes to every task).
SKETCH, PARTS = 1 << 20, 64
#: Min-hash pairs per class that bring it to a leader.
PAIRS = 4
#: Up to so many ids are broadcast to pick texts from a scan, and so many classes with their groups (about 40 bytes each); beyond, a join shuffles.
BROADCAST_IDS = 200_000
#: Hits by its rarer tokens that a query asks of a group before all tokens are compared.
HITS = 4
#: Rows that a Python worker gathers before it hands them on.
ROWS = 20_000

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_SALTS = [pow(0xD1342543DE82EF95, k + 1, 1 << 64) | 1 for k in range(64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as the longest text needs."""

    def __init__(self):
        self.up, self.down = np.ones(1, dtype=_U), np.ones(1, dtype=_U)

    def to(self, n: int):
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 1 << 14)
            self.up = np.multiply.accumulate(np.append(_U(1), np.full(n - 1, _U(_BASE))))
            self.down = np.multiply.accumulate(np.append(_U(1), np.full(n - 1, _U(_BACK))))
        return self.up, self.down


def shingles(text: str | None, k: int, powers: Powers) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; a text of fewer words, but not none, is one."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    gap = np.concatenate([[True], _GAP[raw], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    first, last = edge[0::2], edge[1::2]
    if not len(first):
        return np.zeros(0, dtype=_U)
    up, down = powers.to(len(raw) + 1)
    total = np.concatenate([np.zeros(1, dtype=_U), np.cumsum((_LOWER[raw].astype(_U) + _U(1)) * up[: len(raw)])])
    w = _mixed((total[last] - total[first]) * down[first] + (last - first).astype(_U) * _U(_SALTS[0]))
    if len(w) < k:
        h = w[:1] * _U(_SALTS[1])
        for j in range(1, len(w)):
            h = _mixed(h) + w[j : j + 1] * _U(_SALTS[1 + j])
        return _mixed(h + _U(len(w)))
    h = np.zeros(len(w) - k + 1, dtype=_U)
    for j in range(k):
        h += w[j : len(w) - k + 1 + j] * _U(_SALTS[1 + j])
    return np.unique(_mixed(h))


def ranked(h: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Tokens that sort by rarity class, then hash: 7 bits of class and 56 bits of hash."""
    return np.sort((rarity[(h & _U(SKETCH - 1)).astype(np.int64)].astype(_U) << _U(56)) | (h >> _U(8)))


def signature(h: np.ndarray) -> bytes:
    return len(h).to_bytes(4, "big") + b"".join(int(_mixed(h ^ _U(s)).sum(dtype=_U)).to_bytes(8, "big") for s in _SALTS[10:12])


def min_hashes(h: np.ndarray) -> np.ndarray:
    return np.array([_mixed(h * _U(s)).min() for s in _SALTS[20 : 20 + 2 * PAIRS]], dtype=_U).astype(np.int64)


def slack(n: int, percent: int) -> int:
    """Tokens of a set of n that a linked set may lack."""
    return n - -(-percent * n // 100)


def least(n: int) -> int:
    """Prefix tokens in common that a set of n asks for."""
    return 1 + n // 20


def distance(n: int, m: int, percent: int) -> int:
    """Largest symmetric difference of linked sets of n and m."""
    return (n + m) * (100 - percent) // (100 + percent)


# -- passes over the texts ----------------------------------------------------------------------


def _sketch(k: int):
    """Counters of one task, cut into PARTS rows: small ones, however many tasks there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, powers, held, n = np.zeros(SKETCH, dtype=np.int64), Powers(), [], 0
        for batch in batches:
            for x in batch.column(0):
                held.append((shingles(x.as_py(), k, powers) & _U(SKETCH - 1)).astype(np.int64))
                n += len(held[-1])
                if n > SKETCH:
                    count, held, n = count + np.bincount(np.concatenate(held), minlength=SKETCH), [], 0
        if held:
            count += np.bincount(np.concatenate(held), minlength=SKETCH)
        if count.any():
            parts = count.reshape(PARTS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in parts], pa.binary())], ["part", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(counts.as_buffer(), dtype="<i8")
            sums[part] = sums[part] + x if part in sums else x
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])


def rarities(texts: DataFrame, k: int) -> np.ndarray:
    """Rarity class of each slot of the sketch over the shingles of all texts: a byte each."""
    parts = texts.select("_text").mapInArrow(_sketch(k), "part int, counts binary").repartition(PARTS, "part")
    table = np.zeros((PARTS, SKETCH // PARTS), dtype=np.int64)
    for r in parts.mapInArrow(_summed, "part int, counts binary").collect():  # PARTS rows, 8 bytes a counter
        table[r["part"]] = np.frombuffer(r["counts"], dtype="<i8")
    return np.minimum(2 * np.log2(np.maximum(table.reshape(-1), 1)), 127).astype(np.uint8)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short batches, so that what a worker makes of one stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _described(k: int, percent: int, rarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, table = Powers(), rarity.value
        for batch in _slices(batches):
            out = {"n": [], "sig": [], "prefix": [], "mins": [], "central": []}
            for x in batch.column(1):
                h = shingles(x.as_py(), k, powers)
                n = len(h)
                out["n"].append(n)
                out["sig"].append(signature(h))
                alone = n * (100 - percent) < percent  # only equal sets can be linked
                tokens = None if alone else ranked(h, table)
                out["prefix"].append([] if alone else tokens[: slack(n, percent) + least(n)].astype(np.int64))
                out["central"].append(0 if alone else int((tokens >> _U(56)).mean() * 1000))
                out["mins"].append([] if alone else min_hashes(h))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out["n"], pa.int64()), pa.array(out["sig"], pa.binary()), pa.array(out["prefix"], pa.list_(pa.int64())), pa.array(out["mins"], pa.list_(pa.int64())), pa.array(out["central"], pa.int64())],
                ["_id", "n", "sig", "prefix", "mins", "central"],
            )

    return run


def _sets(k: int, rarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, table = Powers(), rarity.value
        for batch in _slices(batches):
            hs = [shingles(x.as_py(), k, powers) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([signature(h) for h in hs], pa.binary()), pa.array([ranked(h, table).tobytes() for h in hs], pa.binary())], ["sig", "set"]
            )

    return run


def sets_of(work: Scratch, texts: DataFrame, wanted: DataFrame, classes: DataFrame, k: int, rarity, name: str) -> DataFrame:
    """``(cid, set)`` of the classes in ``wanted`` (column cid), read anew from the texts of
    their first documents: only these texts are hashed again, and no other set is stored."""
    ids = classes.select("cid", "sig", F.col("doc").alias("_want")).join(wanted.distinct(), "cid", "left_semi")
    ids = work.put(ids, name + "-wanted")
    picked = ids.select("_want").distinct()
    if picked.count() <= BROADCAST_IDS:
        picked = F.broadcast(picked)
    rows = texts.join(picked, texts["_id"].eqNullSafe(picked["_want"]), "left_semi").select("_text")
    found = rows.mapInArrow(_sets(k, rarity), "sig binary, set binary")
    # sets are shuffled once: a class has one signature, so what is grouped by it meets its class where it lies
    found = work.put(found.groupBy("sig").agg(F.first("set").alias("set")).join(ids.select("sig", "cid"), "sig").select("cid", "set"), name)
    work.drop(name + "-wanted")
    return found


# -- inside groups ------------------------------------------------------------------------------

_DELTA = pa.schema([("leader", pa.int64()), ("cid", pa.int64()), ("n", pa.int64()), ("linked", pa.bool_()), ("near", pa.bool_()), ("size", pa.int64()), ("delta", pa.list_(pa.int64()))])


def _deltas(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out = []
            for leader, cid, mine, other in zip(*batch.columns, strict=True):
                a, b = (np.frombuffer(x.as_buffer(), dtype=_U) for x in (mine, other))
                d = np.setxor1d(a, b, assume_unique=True)
                linked, near = len(d) <= distance(len(a), len(b), percent), 2 * len(d) <= len(a)
                out.append({"leader": leader.as_py(), "cid": cid.as_py(), "n": len(a), "linked": linked, "near": near, "size": len(d), "delta": d.astype(np.int64) if near else []})
            yield pa.RecordBatch.from_pylist(out, schema=_DELTA)

    return run


def _bucket(size: int) -> int:
    return int(4 * np.log2(size + 1))


def _floor_of(bucket: int) -> int:
    low = max(0, int(2 ** (bucket / 4)) - 2)
    while _bucket(low) < bucket:
        low += 1
    return low


_PROBE = pa.schema([("leader", pa.int64()), ("token", pa.int64()), ("bucket", pa.int32()), ("small", pa.bool_()), ("cid", pa.int64()), ("size", pa.int64()), ("n", pa.int64()), ("place", pa.int64()), ("linked", pa.bool_())])


def _probes(percent: int):
    """Prefix tokens of differences. The smaller of a pair probes in its own size bucket,
    the larger in each bucket that a smaller partner may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in (row for part in _slices([batch]) for row in part.to_pylist()):
                s, alone, shared = x["size"], x["size"] - len(x["shared"]), x["shared"]
                most = distance(x["n"], 100 * x["n"] // percent, percent)

                def add(bucket, small, overlap, x=x, s=s, alone=alone, shared=shared):
                    for place, token in enumerate(shared[: max(0, s - max(1, overlap) + 1 - alone)], alone):
                        out.append({"leader": x["leader"], "token": token, "bucket": bucket, "small": small, "cid": x["cid"], "size": s, "n": x["n"], "place": place, "linked": x["linked"]})

                add(_bucket(s), True, -(-(2 * s - most) // 2))
                for q in range(_bucket(max(0, s - most)), _bucket(s) + 1):
                    add(q, False, -(-(max(_floor_of(q), s - most) + s - most) // 2))
                if len(out) > ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=_PROBE)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=_PROBE)

    return run


def _inside(work: Scratch, members: DataFrame, percent: int) -> DataFrame:
    """Links between members of one group of which not both are linked to the leader."""
    loose = members.where("near and not linked").select("leader").distinct()
    m = members.where("near and size > 0").join(loose, "leader", "left_semi")
    tokens = m.select("leader", "cid", "linked", F.explode("delta").alias("token"))
    # a token that no loose member has is as good as one that no other member has
    counts = tokens.groupBy("leader", "token").agg(F.count("*").alias("c"), F.sum((~F.col("linked")).cast("int")).alias("k")).where("c > 1 and k > 0")
    shared = tokens.join(counts, ["leader", "token"]).groupBy("leader", "cid").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "token"))), lambda x: x["token"]).alias("shared"))
    rows = m.select("leader", "cid", "n", "size", "linked").join(shared, ["leader", "cid"])
    probes = rows.mapInArrow(_probes(percent), "leader long, token long, bucket int, small boolean, cid long, size long, n long, place long, linked boolean")
    probes = work.put(probes, "probes")
    side = lambda x: [F.col(k).alias(k[0] + x) for k in ("size", "n", "place", "linked")]
    a = probes.where("small").select("leader", "token", "bucket", F.col("cid").alias("a"), *side("a"))
    b = probes.where("not small").select("leader", "token", "bucket", F.col("cid").alias("b"), *side("b"))
    fits = ((F.col("sa") < F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b")))) & ~(F.col("la") & F.col("lb"))
    # positional: at best all tokens from the match on are common to both differences
    apart = F.col("sa") + F.col("sb") - 2 * F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb"))
    fits = fits & (apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))
    pairs = a.join(b, ["leader", "token", "bucket"]).where(fits).select("leader", "a", "b").distinct()
    d = m.select("leader", "cid", "n", "delta")
    pairs = pairs.join(d.select("leader", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("delta").alias("da")), ["leader", "a"])
    pairs = pairs.join(d.select("leader", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("delta").alias("db")), ["leader", "b"])
    apart = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
    return pairs.where(apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b")


# -- across groups ------------------------------------------------------------------------------


def _reaches(percent: int) -> Column:
    """Prefix tokens that the smallest linkable partner of a query still asks for."""
    return 1 + F.floor(F.ceil(F.col("n") * percent / 100) / 20)


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), dtype=_U) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _grouped(leaders: DataFrame, roots: DataFrame) -> DataFrame:
    """``cid, grp, size, comp``: group, its number of classes and the component so far, of the
    classes that have company. All others are a group of their own, numbered -1 - cid.

    A leader's group whose members are all linked already is merged with all others of
    its component (numbered below 0): the answer is components, so nothing inside one
    is compared any more."""
    none = F.lit(None).cast("long")
    c = leaders.select("cid", "leader", none.alias("comp")).unionByName(leaders.select(F.col("leader").alias("cid"), none.alias("leader"), none.alias("comp")))
    c = c.unionByName(roots.select(F.col("node").alias("cid"), none.alias("leader"), F.col("root").alias("comp"))).groupBy("cid").agg(F.max("leader").alias("leader"), F.max("comp").alias("comp"))
    c = c.select("cid", F.coalesce("leader", "cid").alias("led"), F.coalesce("comp", "cid").alias("comp"))
    one = c.groupBy("led").agg((F.min("comp") == F.max("comp")).alias("one"))
    c = c.join(one, "led").select("cid", "comp", F.when(F.col("one"), -1 - F.col("comp")).otherwise(F.col("led")).alias("grp"))
    return c.join(c.groupBy("grp").agg(F.count("*").alias("size")), "grp").where((F.col("size") > 1) | (F.col("grp") != -1 - F.col("cid")))


def _looked_up(work: Scratch, cand: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``(queries, looked-up)``: classes with the tokens that they share with other groups,
    and the groups that each must be compared with (cid, g).

    A query must meet ``need`` of its tokens in a group. Without its need - h most frequent
    tokens it still meets h of them, so groups are looked up by the others. The class of
    the smaller group asks, so a class far from a large family asks it once, not each of
    its members. Pairs inside a component add nothing to it and are left out; so are those
    inside a leader's group, which are settled."""
    # the one shuffle of all prefix tokens carries the class and, if it has company, its group; the rest is added to what is left
    rows = cand.select("cid", F.when(F.col("grp") != -1 - F.col("cid"), F.col("grp")).alias("_g"), F.explode("prefix").alias("token"))
    # tokens of one group alone meet no other; the rest are the rows of the matrix
    of_token, grp = Window.partitionBy("token"), F.coalesce("_g", -1 - F.col("cid"))
    rows = rows.withColumns({"_low": F.min(grp).over(of_token), "_high": F.max(grp).over(of_token), "c": F.count("*").over(of_token)})
    rows = rows.where("_low < _high").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("met"))
    rows = rows.join(cand.select("cid", "grp", "size", "comp", F.col("n").cast("int").alias("n")), "cid")
    rows = rows.withColumn("need", _reaches(percent).cast("int")).where(F.size("met") >= F.col("need"))
    rows = work.put(rows.select("cid", "grp", "size", "comp", "n", "need", F.transform("met", lambda t: t["token"]).alias("met")), "queries")
    freed(work.spark)
    matrix = rows.select(F.col("grp").alias("g"), F.col("size").alias("gs"), "n", F.explode("met").alias("token")).groupBy("token", "g", "gs").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    hits = F.least(F.col("need"), F.lit(HITS))
    probe = rows.select("cid", "grp", "size", "comp", "n", hits.alias("hits"), F.explode(F.slice("met", F.lit(1), F.size("met") - F.col("need") + hits)).alias("token"))
    asks = (F.col("size") < F.col("gs")) | ((F.col("size") == F.col("gs")) & (F.col("grp") < F.col("g")))
    fits = asks & (F.col("g") != -1 - F.col("comp")) & (100 * F.col("n") >= percent * F.col("low")) & (percent * F.col("n") <= 100 * F.col("high"))
    met = probe.join(matrix, "token").where(fits).groupBy("cid", "hits", "g", "gs").agg(F.count("*").alias("k")).where(F.col("k") >= F.col("hits"))
    return rows, work.put(met.select("cid", "g", "gs"), "looked-up")


def _tokens_of(sets: DataFrame, key: str) -> DataFrame:
    """``key, token``: whole sets as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 64):
            size = np.array([len(x.as_buffer()) // 8 for x in batch.column(1)], dtype=np.int64)
            tokens = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.int64) for x in batch.column(1)]) if len(size) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), size)), pa.array(tokens)], [key, "token"])

    return sets.select(key, "set").mapInArrow(run, f"{key} long, token long")


def _qualified(work: Scratch, asked: DataFrame, rows: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the groups of several classes that queries look up, those whose token union has
    as many of the query's tokens in common as its smallest linkable member asks for."""
    union = groups.join(asked.select(F.col("g").alias("grp")).distinct(), "grp", "left_semi").join(sets, "cid").select("grp", "set")
    union = _tokens_of(union, "grp").distinct()
    low = rows.groupBy(F.col("grp").alias("g")).agg(F.min("n").alias("low"))
    queries = asked.join(sets, "cid").select(F.struct("cid", "g").alias("k"), "set")
    number = work.put(queries.withColumn("q", F.monotonically_increasing_id()), "asked")
    met = _tokens_of(number, "q").join(number.select("q", "k.g"), "q").join(union.withColumnRenamed("grp", "g"), ["g", "token"])
    bound = met.groupBy("q").agg(F.count("*").alias("bound"))
    found = number.select("q", "k.cid", "k.g").join(bound, "q").join(rows.select("cid", "n"), "cid").join(low, "g")
    ask = F.greatest(F.ceil(percent * F.col("n") / 100), F.ceil(percent * (F.col("n") + F.col("low")) / (100 + percent)))
    found = work.put(found.where(F.col("bound") >= ask).select("cid", "g"), "qualified")
    work.drop("asked")
    return found


def _opened(work: Scratch, rows: DataFrame, qualified: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of a query and a member of a group that qualifies: not of one
    component yet, of sizes that can be linked, with enough prefix tokens in common."""
    members = rows.select(F.col("grp").alias("g"), F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    apart = (F.col("comp") != F.col("cb")) & (100 * F.col("n") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("n"))
    pairs = qualified.join(rows.select("cid", "n", "comp", "need"), "cid").join(members, "g").where(apart).select(F.col("cid").alias("a"), "b", "need")
    side = lambda x: rows.select(F.col("cid").alias(x), F.col("met").alias("m" + x))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    return work.put(pairs.where(F.size(F.array_intersect("ma", "mb")) >= F.col("need")).select("a", "b"), "opened")


# -- the join -----------------------------------------------------------------------------------


def _leaders(work: Scratch, cand: DataFrame) -> DataFrame:
    """``(cid, leader)``: of the classes that share a key with a class and half of its
    min-hashes, the most central one leads it, the one whose tokens are least rare and so
    most shared; or that one's own leader, if alike too. Other classes stay alone, which
    is always right."""
    mins, rank = F.col("mins"), F.struct("central", (-F.col("cid")).alias("m"))
    alike = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, v: n + v) >= PAIRS
    key = cand.select("cid", "mins", rank.alias("r"), F.explode(F.array(*[F.xxhash64(mins[2 * j], mins[2 * j + 1], F.lit(j)) for j in range(PAIRS)])).alias("key"))
    first = key.groupBy("key").agg(F.max(F.struct("r", "mins")).alias("top"), F.count("*").alias("c")).where("c > 1").drop("c")
    tries = key.join(first, "key").where((F.col("top.r") != F.col("r")) & alike("mins", "top.mins"))
    near = work.put(tries.groupBy("cid").agg(F.first("mins").alias("mins"), F.max("top").alias("top")), "near")
    again = near.select((-F.col("cid")).alias("m"), F.col("top").alias("up"))
    led = near.withColumn("m", F.col("top.r.m")).join(again, "m", "left")
    leader = F.when(F.col("up").isNotNull() & alike("mins", "up.mins"), F.col("up")).otherwise(F.col("top"))
    led = work.put(led.select("cid", (-leader["r"]["m"]).alias("leader")), "led")
    work.drop("near")
    return led


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, work: Scratch | None = None) -> DataFrame:
    """``_id, n, sig, component``: per input row the size of its set, its class, and the
    smallest id it reaches by links (100 * intersection >= percent * union).

    Null, empty and blank texts have an empty set and are their own component; a null
    id is larger than any other; repeated rows are equal sets and so one component; an
    empty table gives an empty result. Links are exact up to hash collisions of 56 bits."""
    spark = docs.sparkSession
    batched(spark)
    work = work or Scratch(spark, "near-copies")
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    id_type = dict(texts.dtypes)["_id"]
    rarity = spark.sparkContext.broadcast(rarities(texts, words))
    rows = texts.mapInArrow(_described(words, percent, rarity), f"_id {id_type}, n long, sig binary, prefix array<long>, mins array<long>, central long")
    described = work.put(rows, "described")
    classes = described.where("n > 0").groupBy("sig").agg(F.min("_id").alias("doc"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("mins").alias("mins"), F.first("central").alias("central"))
    # the number of a class is fixed by being written
    classes = work.put(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    rows = work.put(described.select("_id", "n", "sig"), "rows")
    work.drop("described")
    cand = classes.where(F.size("prefix") > 0).select("cid", "n", "prefix", "mins", "central")

    leaders = _leaders(work, cand)
    wanted = leaders.select("cid").union(leaders.select(F.col("leader").alias("cid")))
    sets = sets_of(work, texts, wanted, classes, words, rarity, "sets")
    pairs = leaders.join(sets, "cid").join(sets.select(F.col("cid").alias("leader"), F.col("set").alias("other")), "leader").select("leader", "cid", "set", "other")
    members = work.put(pairs.mapInArrow(_deltas(percent), "leader long, cid long, n long, linked boolean, near boolean, size long, delta array<long>"), "members")
    work.drop("led")
    links = members.where("linked").select(F.col("leader").alias("a"), F.col("cid").alias("b")).unionByName(_inside(work, members, percent))
    inner = components(links, "a", "b")
    work.drop("probes")

    # across groups; a leader is in its own group unless it is near another leader
    groups = work.put(_grouped(members.where("near").select("cid", "leader"), inner), "groups")
    work.drop("members")
    # most classes are a group of their own, so few rows go to all prefixes, which stay where they are
    placed = cand.select("cid", "n", "prefix").join(F.broadcast(groups) if groups.count() <= BROADCAST_IDS else groups, "cid", "left")
    placed = placed.withColumns({"grp": F.coalesce("grp", -1 - F.col("cid")), "size": F.coalesce("size", F.lit(1)), "comp": F.coalesce("comp", "cid")})
    rows_, met = _looked_up(work, placed, percent)
    alone = met.where("gs = 1").select("cid", F.col("g").alias("grp")).join(groups.select("grp", F.col("cid").alias("other")), "grp", "left").withColumn("other", F.coalesce("other", -1 - F.col("grp")))
    wanted = met.select("cid").union(alone.select(F.col("other").alias("cid"))).distinct().join(sets.select("cid"), "cid", "left_anti")
    sets = sets.unionByName(sets_of(work, texts, wanted, classes, words, rarity, "more-sets"))
    qualified = _qualified(work, met.where("gs > 1").select("cid", "g"), rows_, groups, sets, percent)
    pairs = _opened(work, rows_, qualified.unionByName(met.where("gs = 1").select("cid", "g")), percent)
    work.drop("qualified", "looked-up", "queries", "groups")
    checked = pairs.join(sets.select(F.col("cid").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("cid").alias("b"), F.col("set").alias("sb")), "b")
    links = checked.select("a", "b", "sa", "sb").mapInArrow(_verified(percent), "a long, b long")
    # of each component so far only its root goes on
    root = lambda x: inner.select(F.col("node").alias(x), F.col("root").alias("r" + x))
    links = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    outer = components(links, "a", "b")
    work.drop("opened", "more-sets", "sets")

    rooted = classes.select("cid", "sig", "doc").join(inner.select(F.col("node").alias("cid"), F.col("root").alias("r1")), "cid", "left")
    rooted = rooted.withColumn("r1", F.coalesce("r1", "cid")).join(outer.select(F.col("node").alias("r1"), F.col("root").alias("r2")), "r1", "left")
    rooted = rooted.select("sig", "doc", F.coalesce("r2", "r1").alias("root"))
    ends = rooted.groupBy("root").agg(F.min("doc").alias("component"))
    of = work.put(rooted.join(ends, "root").select("sig", "component"), "components")
    work.drop("classes")
    # empty sets have one signature, however many they are, and join nothing
    out = rows.where("n > 0").join(of, "sig").select("_id", "n", "sig", "component")
    return out.unionByName(rows.where("n = 0").select("_id", "n", "sig", F.col("_id").alias("component")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, the one with its smallest id, same columns.

    Texts with an empty set all stay. Rows are told apart by number, so ids may be null
    or repeat: a null id is larger than any other, and of rows that repeat the smallest
    id in one component the one with the least hash of its text stays, then the first."""
    names = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    inner = numbered(docs.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()]), "_row")
    i, t = F.col(names[id_col]), F.col(names[text_col])
    # no two rows have the same key, so a component is named by the one row that stays
    key = F.struct(i.isNull().alias("absent"), i.alias("id"), F.xxhash64(t).alias("text"), F.col("_row").alias("row"))
    work = Scratch(docs.sparkSession, "one-of-each")
    found = near_copies(inner.select(key.alias("_key"), t.alias("_text")), "_key", "_text", words, percent, work)
    keep = stored(found.where((F.col("n") == 0) | (F.col("_id") == F.col("component"))).select(F.col("_id.row").alias("_row")), "keep")
    work.drop("rows", "components")
    return inner.join(keep, "_row", "inner").select(*[F.col(a).alias(c) for c, a in names.items()])


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_copies(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) END AS s
  FROM d),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS cm, any_value(a.n) AS nx, any_value(b.n) AS ny
  FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p WHERE 100 * cm >= 90 * (nx + ny - cm)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.y, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON m.x = s.doc_id
"""
