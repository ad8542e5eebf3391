"""Benchmark decontamination against a broadcast set of test n-grams.

A document is scanned in one projection: a byte map over hashes of the first and of the
last words of all windows leaves few start positions, only these become window strings,
and an equi-join with the windows verifies them exactly. The map has a fixed size
bound and is used however many windows there are. The windows themselves are a hash
table that every task holds while they are few enough, else only what the map
left is shuffled to them. Texts are never shuffled by the scan.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii, numbered, read, stored

#: Characters that separate words once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a text as it is, before lower-casing.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Words at either end of a window that the byte map looks at.
HEAD = 3
#: The byte map has at most 2^MOST_SLOTS bytes.
MOST_SLOTS = 24
#: Up to so many windows are broadcast (about 100 bytes each); beyond, the join shuffles.
BROADCAST_WINDOWS = 200_000
#: Up to so many ids of hit rows are broadcast (8 bytes each).
BROADCAST_ROWS = 200_000


def norm_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _slot(w: Column, i: Column | int, k: int, slots: int, end: bool) -> Column:
    """Slot (from 1) of a window's first or last words in a byte map."""
    n = min(HEAD, k)
    at = k - n if end else 0
    return F.pmod(F.xxhash64(*[w[i + at + j] for j in range(n)], F.lit(k + 100 * end)), F.lit(slots)).cast("int") + 1


def _marked(seen: Column, w: Column, k: int, slots: int):
    one = lambda i, end: F.substring(seen, _slot(w, i, k, slots, end), F.lit(1)) == F.lit(b"\x01")
    return lambda i: one(i, False) & one(i, True)


def _byte_map(table: DataFrame, ks: list[int], slots: int) -> bytes:
    """A byte for each slot, 1 for those that the windows' first or last words take. The
    driver gets one bitmap of 4 kB for each 32,768 slots."""
    at = None
    for k in ks:
        one = table.where(F.col("k") == k)
        one = one.select(F.explode(F.array(*[_slot(F.col("w"), 0, k, slots, end).cast("long") for end in (False, True)])).alias("s"))
        at = one if at is None else at.unionByName(one)
    maps = at.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    seen = np.zeros(-(-slots // 32_768) * 32_768, dtype=np.uint8)
    for r in maps.collect():
        seen[(r["b"] - 1) * 32_768 : r["b"] * 32_768] = np.unpackbits(np.frombuffer(r["m"], dtype=np.uint8), bitorder="little")
    return seen[:slots].tobytes()


def _window(w: Column, k: int):
    return lambda i: F.struct(i.alias("p"), F.array_join(F.slice(w, i + 1, F.lit(k)), " ").alias("key"))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(k, key, w, items)``: each distinct window, its words and its items' ids as strings."""
    w = F.col("w")
    k = F.least(F.size(w), F.lit(size))
    rows = (
        items.select(F.col("item_id").cast("string").alias("item"), norm_words(F.col("text")).alias("w"))
        .where(F.size("w") > 0)
        .select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.slice(w, i, k))).alias("w"))
    )
    return rows.groupBy(F.array_join("w", " ").alias("key")).agg(
        F.first("w").alias("w"), F.sort_array(F.collect_set("item")).alias("items")
    ).select(F.size("w").alias("k"), "key", "w", "items")


def starts(df: DataFrame, table: DataFrame, text_col: str) -> tuple[DataFrame, bool]:
    """``df`` with ``_w`` (words) and ``_c`` (possible windows with their start); and
    whether the window table is small enough to broadcast."""
    n = table.count()
    small = n <= BROADCAST_WINDOWS
    ks = sorted(r.k for r in table.select("k").distinct().collect())  # WINDOW values at most
    df = df.withColumn("_w", norm_words(F.col(text_col)))
    w, parts = F.col("_w"), []
    slots = 1 << max(16, min(MOST_SLOTS, (8 * n).bit_length()))
    empty = F.array().cast("array<struct<p:int,key:string>>")
    if not ks:
        return df.withColumn("_c", empty), small

    def scan(seen: Column) -> Column:
        for k in ks:
            places = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(F.filter(places, _marked(seen, w, k, slots)), _window(w, k)))
        return F.concat(*parts)

    # by let the map is in the plan, and in what Spark prints of it, only once
    return df.withColumn("_c", let(F.lit(_byte_map(table, ks, slots)), scan)), small


def hits(df: DataFrame, items: DataFrame, text_col: str = "text", keep: tuple[str, ...] = (), row: str | None = None) -> DataFrame:
    """Per input row: ``keep`` columns, ``n_words``, ``n_hit``, ``spans`` (sorted
    starts and lengths in words), ``item_ids`` (sorted distinct strings). ``row``: a
    column that numbers the rows, if there is one.

    Null and empty texts have no words and no hits; null and empty items have no window,
    and items of null id hit but are not listed; repeated rows have their hits each; an
    empty table gives an empty result. Other columns than ``keep`` are not read."""
    df = df.select(*keep, text_col, *([row] if row else []))
    table = stored(windows(items), "windows")
    scan, small = starts(df.withColumnRenamed(row, "_row") if row else numbered(df), table, text_col)
    found = table.select("key", "k", "items")
    rows = scan.select(*keep, "_row", F.size("_w").cast("long").alias("n_words"), F.explode_outer("_c").alias("_c"))
    rows = rows.select(*keep, "_row", "n_words", F.col("_c.p").alias("p"), F.col("_c.key").alias("key"))
    if not small:  # rows without a possible window meet nothing, and not each other in one task
        rows = rows.withColumn("key", F.coalesce("key", F.concat(F.lit("\0"), F.col("_row").cast("string"))))
    rows = rows.join(F.broadcast(found) if small else found, "key", "left")
    span = F.when(F.col("k").isNotNull(), F.struct("p", "k"))
    per = rows.groupBy("_row", "n_words", *keep).agg(
        F.sort_array(F.collect_list(span)).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    n_hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["p"] + s["k"] - F.greatest(a["end"], s["p"]), F.lit(0))).alias("n"),
            F.greatest(a["end"], s["p"] + s["k"]).alias("end"),
        ),
        lambda a: a["n"].cast("long"),
    )
    return per.withColumn("n_hit", n_hit)


def decontaminate(docs: DataFrame, items: DataFrame, mode: str = "documents", text_col: str = "text") -> DataFrame:
    """``docs`` without benchmark passages, same columns.

    ``documents`` drops each document with a hit; ``spans`` cuts the hit words and
    the separators after them. Null, empty and clean texts stay as they are; so do
    repeated rows, each judged for itself. An empty benchmark removes nothing."""
    names = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    rows = numbered(docs.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()]))
    text = names[text_col]
    hit = stored(hits(rows.select(text, "_row"), items, text, row="_row").where(F.size("spans") > 0).select("_row", "spans"), "hits")
    if hit.count() <= BROADCAST_ROWS and mode == "documents":
        hit = F.broadcast(hit.select("_row"))
    if mode == "documents":
        out = rows.join(hit, "_row", "left_anti")
    else:
        out = rows.join(hit, "_row", "left")
        word, gap = F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0)), F.split(F.col(text), RAW_WORD, -1)
        cut = F.array_join(
            F.concat(
                F.slice(gap, 1, 1),
                F.transform(word, lambda x, i: F.when(F.exists("spans", lambda s: (s["p"] <= i) & (i < s["p"] + s["k"])), F.lit("")).otherwise(F.concat(x, gap[i + 1]))),
            ),
            "",
        )
        out = out.withColumn(text, F.when(F.col("spans").isNull(), F.col(text)).otherwise(cut))
    return out.select(*[F.col(a).alias(c) for c, a in names.items()])


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = hits(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), keep=("doc_id",))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS key
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (
  SELECT rid, k, p, array_to_string(w[p:p + k - 1], ' ') AS key
  FROM (SELECT rid, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS p FROM d, ks WHERE len(w) >= k)),
h AS (SELECT rid, p, dw.k, item_id FROM dw JOIN win ON win.key = dw.key AND win.k = dw.k),
n AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)
"""
