"""Conversation prefix trie, its subtree totals by leaf-peeling message passing.

A node is a distinct sequence of first turns. It is named by 128 bits, the running exclusive or of its turns' hashes, each
taken with its position, so that all prefixes of a conversation come from one window; texts are hashed where they are read
and never shuffled. Nodes are what grouping these prefixes gives.

Subtree totals go upwards: every node holds a counter of children that have not reported. Nodes that are complete send their
totals to their parents, as one sum a parent; a parent whose counter falls to zero is complete in the next round,
until the root is. A node whose members all end at one node below has no branch under it and is complete from the start, so the
rounds are as many as the deepest branching has turns, however long the conversations go on after it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, batched, read

KEY = ["k1", "k2", "depth"]
#: Member ids that are joined into one text before a node's texts meet.
IDS = 4096


def ordered(conversations: DataFrame) -> DataFrame:
    """``(conv_id, n, turn_hash, n_bytes)``: the turns of each conversation from 1 in order of ``turn``,
    null first, ties by the SHA-256 of role and text. A null role or text is empty. Rows
    without conv_id belong to no conversation and are left out."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("turn_hash"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    return turns.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "turn_hash"))).drop("turn")


def share_openings(turns: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """``turns`` rebuilt: of each conversation c the first h turns are those of c - c % every (all if fewer, none
    if it is absent), and its own follow after its first h; h = crc32(c in decimal) % most."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    names = ["conv_id", "part", "n", "turn_hash", "n_bytes"]
    own = turns.where(F.col("n") > h).select("conv_id", F.lit(1).alias("part"), "n", "turn_hash", "n_bytes")
    to = turns.where("n = 1").select(F.col("conv_id").alias("to"), (F.col("conv_id") - F.col("conv_id") % every).alias("conv_id"), h.alias("h"))
    base = turns.where((F.col("conv_id") % every == 0) & (F.col("n") < most)).join(to, "conv_id").where("n <= h")
    first = base.select(F.col("to").alias("conv_id"), F.lit(0).alias("part"), "n", "turn_hash", "n_bytes")
    return first.select(names).unionByName(own.select(names))


def _hash(seed: int) -> Column:
    return F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "turn_hash")).otherwise(F.lit(0).cast("long"))


def occurrences(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Each conversation's prefixes, the empty one too: ``conv_id``, the node's key and its parent's, the bytes of its last
    text and of that and all later texts, and the key of the node where the conversation ends."""
    root = conversations.select("conv_id", F.lit(-1).alias("part"), F.lit(0).alias("n"), F.lit(None).cast("binary").alias("turn_hash"), F.lit(0).cast("long").alias("n_bytes"))
    path = Window.partitionBy("conv_id").orderBy("part", "n")
    upto, whole = path.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("conv_id")
    o = root.unionByName(turns.select(root.columns)).withColumn("depth", (F.row_number().over(path) - 1).cast("long"))
    o = o.withColumns({"x1": _hash(1), "x2": _hash(2)})
    o = o.withColumns({"k1": F.bit_xor("x1").over(upto), "k2": F.bit_xor("x2").over(upto), "before": F.sum("n_bytes").over(upto)})
    o = o.withColumns({"e1": F.bit_xor("x1").over(whole), "e2": F.bit_xor("x2").over(whole), "ends": F.max("depth").over(whole), "all_bytes": F.sum("n_bytes").over(whole)})
    return o.select(
        "conv_id", *KEY, F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "n_bytes",
        (F.col("all_bytes") - F.col("before") + F.col("n_bytes")).alias("bytes_on"), "e1", "e2", "ends",
    )


def peeled(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``nodes`` with ``n_leaves`` and ``saved_tokens`` of their subtrees."""
    done = nodes.where("single")
    out = [done.select(*nodes.columns, F.lit(1).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes_on")).alias("saved_tokens"))]
    waiting = nodes.where("NOT single").select(*nodes.columns, F.lit(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"), F.col("n_children").alias("remaining"))
    frontier, k = out[0], 0
    while k == 0 or waiting.limit(1).count():
        told = frontier.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth"))
        told = told.agg(F.count("*").alias("_n"), F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
        heard = waiting.join(told, KEY, "left").select(
            *nodes.columns, (F.col("n_leaves") + F.coalesce("_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("_saved", F.lit(0))).alias("saved_tokens"),
            (F.col("remaining") - F.coalesce("_n", F.lit(0))).alias("remaining"),
        )
        heard = scratch.put(heard, f"round{k}")
        frontier, waiting, k = heard.where("remaining = 0").drop("remaining"), heard.where("remaining > 0"), k + 1
        out.append(frontier)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of ``turns (conv_id, part, n, turn_hash, n_bytes)``, in order of part and n; every conv_id
    of ``conversations`` is a member of the root, with turns or without.

    The first table has a row a node: its key (``k1, k2, depth``), ``conv_id`` (smallest member), ``parent_conv_id`` (the
    parent's; null at the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``. The second has a row a conversation: the key
    of the node where it ends, ``conv_id``. No conversation at all, no node. A conversation is ordered in one task, whatever
    others share with it; nodes with many members or children are grouped by partial sums."""
    scratch = Scratch(turns.sparkSession, "trie")
    seen = scratch.put(occurrences(turns, conversations), "occurrences")
    nodes = seen.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.max("bytes_on").alias("bytes_on"), F.first("p1").alias("p1"), F.first("p2").alias("p2"),
        ((F.min("e1") == F.max("e1")) & (F.min("e2") == F.max("e2")) & (F.min("ends") == F.max("ends"))).alias("single"),
    )
    nodes = scratch.put(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    # a parent may have any share of all nodes as children: left to the adaptive split of skewed joins, so nothing else is in this job
    nodes = scratch.put(nodes.join(parents, ["p1", "p2", "depth"], "left"), "parents")
    nodes = scratch.put(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "children")
    return peeled(nodes, scratch), seen.where("depth = ends").select(*KEY, "conv_id")


def id_digests(ends: DataFrame) -> DataFrame:
    """``ends_sha256`` of each node's member ids, ascending and comma-joined. IDS neighbouring ids are joined at a time;
    a node's texts run through one hash in order, batch by batch, and are never held together."""
    texts = ends.groupBy(*KEY, F.expr(f"conv_id div {IDS}").alias("run")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    texts = texts.repartition(*KEY).sortWithinPartitions(*KEY, "run").select(*KEY, "ids")
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            out = []
            for *k, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k == key:
                    sha.update(b",")
                else:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                sha.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, schema, strict=True)], schema=schema)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, sha.hexdigest()), schema, strict=True)], schema=schema)

    return texts.mapInArrow(digests, "k1 long, k2 long, depth long, ends_sha256 string")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra columns of the table are ignored. Repeated rows are turns of their own."""
    conversations = read(spark, sf_dir, "conversations")
    batched(spark)
    scratch = Scratch(spark, "turns")
    turns = scratch.put(ordered(conversations.select("conv_id", "turn", "role", "text")), "ordered")
    nodes, ends = prefix_trie(share_openings(turns), turns.where("n = 1"))
    out = nodes.join(id_digests(ends), KEY, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    )


OP11_SQL = """
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 5 AS base, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, n) AS d, r, t FROM (
    SELECT v.c, 0 AS part, b.n, b.r, b.t FROM convs v JOIN turns b ON b.c = v.base AND b.n <= v.h
    UNION ALL SELECT c, 1, n, r, t FROM turns JOIN convs USING (c) WHERE n > h)),
occ AS (
  SELECT c, d, sha256(string_agg(sha256(concat(length(r), ':', r, t)), '') OVER (PARTITION BY c ORDER BY d)) AS k, strlen(t) AS bytes FROM rebuilt
  UNION ALL SELECT c, 0, '', 0 FROM convs),
chain AS (SELECT *, lag(k) OVER w AS parent, lead(k) OVER w IS NULL AS is_end FROM occ WINDOW w AS (PARTITION BY c ORDER BY d)),
nodes AS (
  SELECT k, d, min(c) AS conv_id, any_value(parent) AS parent, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (is_end), '')) AS ends_sha256 FROM chain GROUP BY k, d),
kids AS (SELECT parent AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY parent),
below AS (SELECT DISTINCT a.k, b.k AS under FROM occ a JOIN occ b ON a.c = b.c AND b.d >= a.d),
totals AS (
  SELECT b.k, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.bytes) AS saved
  FROM below b JOIN nodes u ON u.k = b.under LEFT JOIN kids ON kids.k = b.under GROUP BY b.k)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(kids.n, 0) AS n_children, t.n_leaves,
  CAST(t.saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM nodes v JOIN totals t USING (k) LEFT JOIN nodes p ON p.k = v.parent LEFT JOIN kids ON kids.k = v.k
"""
