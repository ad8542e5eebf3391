"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents of equal text form a group, and groups are what is placed. Each group with
more than 1/SINGLE of all bytes, tokens or rows is placed for itself, in a table of fewer
than SINGLE rows every group is; the light rest is gathered by text hash into a fixed
number of bundles, so the packing problem on the driver has a bounded size whatever the
corpus. A group too heavy for one task is dealt into chunks; these are packed as one, so
that the group stays whole, unless it is large against a shard; then each chunk is packed
for itself. Units go, heaviest first, to the shard where the dot product of their
vector with the shard's residual capacity is highest. Positions in a shard follow from
bundle offsets and ranks inside each bundle, so no task sorts a shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, numbered, read
from .mixing import n_words

SHARDS = 24
#: Bundles of light groups that the driver packs (40 bytes each).
BUNDLES = 16_384
#: A group over 1/SINGLE of all bytes, tokens or rows is placed for itself; fewer than 3 * SINGLE are.
SINGLE = 16_384
#: A group over 1/HEAVY of all bytes or rows is dealt into chunks of about that share.
HEAVY = 4_096
#: How much bytes, tokens and rows weigh in the last pass.
WEIGHTS = np.array([4.0, 1.0, 1.0])
ADDED = ("_size", "_crc", "_shard", "_slot")
#: A group over 1/SPLIT of a shard's share of bytes or rows is split over shards; all others stay whole.
SPLIT = 2


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each vector (rows: bytes, tokens, rows). Vectors are taken heaviest
    first; each goes to the shard with the highest dot product between the vector
    and the residual capacity, both relative to all that is to be placed. Ties go to
    the lowest shard. A last pass moves vectors from the shard with most bytes to that
    with least while that brings the two closer to equal parts, all measures weighed."""
    total = np.maximum(vectors.sum(axis=0), 1).astype(float)
    share = vectors / total
    left = np.full((shards, vectors.shape[1]), 1.0 / shards)
    where = np.zeros(len(vectors), dtype=np.int64)
    order = np.lexsort((np.arange(len(vectors)), -share.max(axis=1)))
    for k in order:
        s = int(np.argmax(left @ share[k]))
        where[k] = s
        left[s] -= share[k]
    # off: what each shard has over its equal part; bytes are the law and weigh most
    off = (1.0 / shards - left) * WEIGHTS
    weighed = share * WEIGHTS
    for _ in range(4 * shards):
        high, low = int(off[:, 0].argmax()), int(off[:, 0].argmin())
        mine = np.flatnonzero(where == high)
        gain = ((off[high] - weighed[mine]) ** 2 + (off[low] + weighed[mine]) ** 2).sum(axis=1) - (off[high] ** 2 + off[low] ** 2).sum()
        if not len(mine) or gain.min() >= 0:
            break
        k = mine[gain.argmin()]
        where[k] = low
        off[high] -= weighed[k]
        off[low] += weighed[k]
    return where


def shards(docs: DataFrame, n: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None, added: tuple[str | None, ...] = ADDED) -> DataFrame:
    """``docs`` (``keep``: the columns kept) and ``_size, _crc, _shard, _slot`` of each row;
    ``added`` names these otherwise, or leaves them out where it is None.

    Null texts are a group of their own with 8 bytes a row; repeated rows are placed
    each for itself; an empty table gives an empty result. Input columns named like an
    added one are replaced; all others stay, whatever their names."""
    spark = docs.sparkSession
    work = Scratch(spark, "shards")
    columns = docs.columns
    names = {c: f"_in_{i}" for i, c in enumerate(columns)}
    inner = numbered(docs.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()]))
    i, text = F.col(names[id_col]), F.col(names[text_col])
    kept = {c: a for c, a in names.items() if (keep is None or c in keep) and c not in added}
    group = F.struct(F.xxhash64(text), F.xxhash64(F.lit(1), text))
    measured = inner.select(i.alias("_id"), "_row", group.alias("_group"), n_bytes(text).alias("_size"), n_words(text).alias("_tokens"))
    measured = work.put(measured, "measured")
    totals = measured.agg(F.sum("_size").alias("b"), F.sum("_tokens").alias("t"), F.count("*").alias("r")).first()
    if not totals["r"]:
        empty = inner.withColumns({"_size": n_bytes(text), "_crc": F.lit(0).cast("long"), "_shard": F.lit(0), "_slot": F.lit(0).cast("long")})
        return _named(empty, kept, added)
    groups = measured.groupBy("_group").agg(F.sum("_size").alias("b"), F.sum("_tokens").alias("t"), F.count("*").alias("r"))
    weight = F.greatest(F.col("b") / totals["b"], F.col("r") / totals["r"])
    most = F.greatest(weight, F.col("t") / max(totals["t"], 1))
    # one row stays whole in any case
    chunks = F.when(F.col("r") > 1, F.greatest(F.ceil(weight * HEAVY), F.lit(1))).otherwise(F.lit(1)).cast("int")
    # fewer than 3 * SINGLE groups can be this heavy, and they have fewer than 2 * HEAVY chunks more
    single = work.put(groups.where(most > 1 / SINGLE).select("_group", chunks.alias("_chunks"), (weight > 1 / (SPLIT * n)).alias("_large")), "single")

    def bundle(df: DataFrame) -> DataFrame:
        df = df.join(F.broadcast(single.withColumnRenamed("_group", "_heavy")), F.col("_group") == F.col("_heavy"), "left")
        light = F.pmod(F.col("_group")["col1"], F.lit(BUNDLES))
        chunk = F.pmod(F.xxhash64("_id", "_row"), F.coalesce(F.col("_chunks"), F.lit(1)))
        key = F.when(F.col("_chunks").isNull(), light).otherwise(F.xxhash64("_group", chunk))
        unit = F.when(F.col("_large"), key).when(F.col("_chunks").isNull(), light).otherwise(F.xxhash64("_group"))
        return df.withColumns({"_light": F.col("_chunks").isNull(), "_bundle": key, "_unit": unit}).drop("_heavy", "_chunks", "_large")

    sums = bundle(measured).groupBy("_light", "_bundle", "_unit").agg(F.sum("_size").alias("b"), F.sum("_tokens").alias("t"), F.count("*").alias("r"))
    rows = sorted(sums.collect(), key=lambda x: (x["_light"], x["_bundle"]))  # bounded, see above
    work.drop("measured")
    vectors = np.array([[x["b"], x["t"], x["r"]] for x in rows], dtype=np.int64)
    units: dict[tuple[bool, int], int] = {}
    unit = np.array([units.setdefault((x["_light"], x["_unit"]), len(units)) for x in rows])
    whole = np.zeros((len(units), vectors.shape[1]), dtype=np.int64)
    np.add.at(whole, unit, vectors)
    where = pack(whole, n)[unit]
    offset = np.zeros(len(rows), dtype=np.int64)
    filled = [0] * n
    for k, s in enumerate(where):
        offset[k], filled[s] = filled[s], filled[s] + int(vectors[k, 2])
    table = spark.createDataFrame(
        [(x["_light"], x["_bundle"], int(where[k]), int(offset[k])) for k, x in enumerate(rows)],
        "_l boolean, _b long, _shard int, _offset long",
    )
    out = inner.withColumns({"_id": i, "_group": group, "_size": n_bytes(text), "_crc": F.crc32(F.coalesce(text, F.lit("")).cast("binary"))})
    out = bundle(out.select(*kept.values(), "_id", "_row", "_group", "_size", "_crc"))
    out = out.join(F.broadcast(table), (F.col("_light") == F.col("_l")) & (F.col("_bundle") == F.col("_b")), "inner")
    rank = Window.partitionBy("_light", "_bundle").orderBy("_group", "_id")
    return _named(out.withColumn("_slot", F.col("_offset") + F.row_number().over(rank) - 1), kept, added)


def _named(out: DataFrame, kept: dict[str, str], added: tuple[str | None, ...]) -> DataFrame:
    return out.select(*[F.col(a).alias(c) for c, a in kept.items()], *[F.col(a).alias(c) for a, c in zip(ADDED, added, strict=True) if c])


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=("doc_id",))
    return out.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
