"""Mixing sources to target weights by Pareto order sampling.

A source's target divided by its size gives the copies that its documents are expected
to have. The whole part is certain. For the rest f, each document has an inclusion
probability p of its own, f times 0.5 to 1.5, that grows with its size against the mean
of its source, and draws a fixed uniform u from its id. Documents are ranked by the
random odds u/(1-u) divided by the inclusion odds p/(1-p), and the first ones are taken
until the source's target of words is met.

The ranking never sorts a whole source in one task: words are summed by
(source, rank bin), the bin in which a source's target falls is found from those
sums, and only documents of that bin are ordered exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, read, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2.0
#: Rank bins of a source: one task orders about 1/BINS of a source's documents.
BINS = 4096
SEED = 17
#: Inclusion probabilities are kept between these.
LEAST, MOST = 1e-9, 1.0 - 1e-9
#: Up to so many sources their table is broadcast (about 100 bytes each).
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def uniform(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone, for a null id on the
    text: 52 bits of MD5."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), name)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def rank(u: Column, size: Column) -> Column:
    """Random odds over inclusion odds, q, as q/(1+q) in (0, 1); of a row that has its
    source's ``f`` and mean size ``mean`` beside it."""
    share = F.coalesce(size / F.expr("nullif(mean, 0)"), F.lit(0.0))
    p = F.greatest(F.least(F.col("f") * (0.5 + share / (share + 1.0)), F.lit(MOST)), F.lit(LEAST))
    q = (u / (1.0 - u)) * ((1.0 - p) / p)
    return q / (q + 1.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """``sizes (source, source_size)`` and its other columns with ``target``.

    Sources in code point order, null last, have the weights in turn. They share
    ``share`` of all words by weight; none gets over ``ceiling`` times its size, and
    what is over goes to the others by weight. Sorted by size/weight, the sources
    at their ceiling are a prefix (water filling), so running sums suffice."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", weight.cast("double"))
    everything = Window.partitionBy(F.lit(0))
    by = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("_total", share * F.sum("source_size").over(everything))
    # the level per unit of weight if all sources before this one are at their ceiling
    level = (F.col("_total") - ceiling * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(after)
    s = s.withColumn("_level", level)
    s = s.withColumn("_open", F.col("_level") * F.col("w") <= ceiling * F.col("source_size"))
    s = s.withColumn("_water", F.min(F.when(F.col("_open"), F.struct(F.col("source_size") / F.col("w"), F.col("_level").alias("l"))))
                     .over(everything)["l"])
    free = F.coalesce(F.col("_water") * F.col("w"), F.lit(float("inf")))
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(free, ceiling * F.col("source_size")))
    return s.withColumn("target", target).drop("w", "_total", "_level", "_open", "_water")


def decisions(docs: DataFrame, id_col: str, text_col: str, source_col: str,
              weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, seed: int = SEED) -> tuple[DataFrame, DataFrame, Scratch]:
    """``(rows, plan, work)``: ids, sources, sizes and uniforms of all rows, written; and per
    source its size, target, certain copies ``whole`` and the last rank taken beyond those."""
    spark = docs.sparkSession
    work = Scratch(spark, "mix")
    text = F.col(f"`{text_col}`")
    rows = work.put(
        docs.select(
            F.col(f"`{id_col}`").alias("_id"),
            F.col(f"`{source_col}`").cast("string").alias("_source"),
            n_words(text).alias("size"),
            uniform(F.col(f"`{id_col}`"), text, seed).alias("_u"),
        ),
        "sizes",
    )
    sums = rows.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    s = targets(sums, weights, share, ceiling)
    whole = F.coalesce(F.least(F.floor(F.col("target") / F.expr("nullif(source_size, 0)")), F.lit(int(ceiling))), F.lit(0)).cast("long")
    s = s.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    s = s.withColumns({"f": F.coalesce(F.col("rest") / F.expr("nullif(source_size, 0)"), F.lit(0.0)), "mean": F.col("source_size") / F.col("n")})
    s = work.put(s, "targets")
    ranked = with_plan(rows, s, "_source").withColumn("_r", rank(F.col("_u"), F.col("size")))
    ranked = ranked.withColumn("_bin", F.least(F.floor(F.col("_r") * BINS), F.lit(BINS - 1)).cast("int"))
    bins = ranked.groupBy("_source", "_bin", "rest").agg(F.sum("size").alias("n"))
    run = Window.partitionBy("_source").orderBy("_bin")
    bins = bins.withColumn("_before", F.sum("n").over(run) - F.col("n"))
    bins = bins.where((F.col("_before") < F.col("rest")) & (F.col("_before") + F.col("n") > 0))
    # the last bin that begins within the rest; all earlier bins are taken whole
    edge = bins.groupBy(F.col("_source").alias("source")).agg(F.max_by("_bin", "_bin").alias("_b2"), F.max_by("_before", "_bin").alias("_before"))
    edge = work.put(edge, "edges")
    last = with_plan(ranked, edge, "_source").where(F.col("_bin") == F.col("_b2"))
    exact = Window.partitionBy("_source").orderBy("_r", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("_run", F.col("_before") + F.sum("size").over(exact))
    # a document is taken while the words so far, with half of its own, stay within the target
    fits = F.col("_run") - F.col("size") / 2 <= F.col("rest")
    cut = last.where(fits).groupBy(F.col("_source").alias("_s3")).agg(F.max(F.struct("_r", "_id")).alias("_cut"))
    all_before = edge.select(F.col("source").alias("_s2"), (F.col("_b2") / F.lit(BINS)).alias("_floor"))
    plan = s.join(all_before, s["source"].eqNullSafe(all_before["_s2"]), "left").drop("_s2")
    plan = plan.join(cut, plan["source"].eqNullSafe(cut["_s3"]), "left").drop("_s3")
    plan = work.put(plan, "plan")
    work.drop("targets", "edges")
    return rows, plan, work


def with_plan(rows: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    """Join the per-source table; it is broadcast only while it is known to be small."""
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    plan = plan.withColumnRenamed("source", "_plan_source")
    return rows.join(plan, rows[source].cast("string").eqNullSafe(plan["_plan_source"]), "inner").drop("_plan_source")


def with_copies(rows: DataFrame, id_: str, ceiling: float = CEILING) -> DataFrame:
    """``rows (_u, size, ...)`` with their sources' plan beside them, and their ``copies``."""
    # columns of their own, so that no rank is computed twice
    rows = rows.withColumn("_r", rank(F.col("_u"), F.col("size")))
    i, r, cut = F.col(id_), F.col("_r"), F.col("_cut")
    at = (r < F.coalesce(cut["_r"], F.lit(-1.0))) | ((r == cut["_r"]) & (i.eqNullSafe(cut["_id"]) | (i < cut["_id"]) | i.isNull()))
    taken = F.coalesce(r < F.col("_floor"), F.lit(False)) | F.coalesce(at, F.lit(False))
    return rows.withColumn("copies", F.least(F.col("whole") + taken.cast("long"), F.lit(int(ceiling))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, seed: int = SEED) -> DataFrame:
    """``_id, _source, size, source_size, target, copies, taken`` per input row.

    Null sources form one source, last in order. Null or empty texts have size 0. Rows of
    one id and size are decided alike, as are rows of null id with equal texts. Ties in
    rank go by id, nulls first. An empty table gives an empty result. Reruns agree."""
    rows, plan, _ = decisions(docs, id_col, text_col, source_col, weights, share, ceiling, seed)
    out = with_copies(with_plan(rows, plan, "_source"), "_id", ceiling)
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("_id", "_source", "size", "source_size", "target", "copies", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, seed: int = SEED) -> DataFrame:
    """The documents of the mix, each repeated as often as it is taken, same columns.
    Texts are not shuffled while the per-source table is small. Odd rows as in ``mix``."""
    names = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()])
    i, t, s = names[id_col], names[text_col], names[source_col]
    _, plan, work = decisions(inner, i, t, s, weights, share, ceiling, seed)
    work.drop("sizes")
    sized = inner.withColumns({"size": n_words(F.col(t)), "_u": uniform(F.col(i), F.col(t), seed)})
    out = with_copies(with_plan(sized, plan, s), i, ceiling).where("copies > 0")
    out = out.withColumn("_k", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(a).alias(c) for c, a in names.items()])


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken")


OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM d GROUP BY source),
w AS (
  SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS w, 1.5e0 * sum(source_size) OVER () AS total
  FROM s),
l AS (
  SELECT *, source_size / w AS q,
    (total - 2e0 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0e0 ELSE least(coalesce((SELECT arg_min(level, q) FROM l WHERE level * w <= 2e0 * source_size) * w, 1e300), 2e0 * source_size) END AS target
  FROM l),
f AS (SELECT *, CAST(coalesce(least(floor(target / nullif(source_size, 0)), 2), 0) AS BIGINT) AS whole FROM t),
p AS (
  SELECT d.doc_id, d.source, d.size, d.u, f.source_size, f.target, f.whole, f.target - f.whole * f.source_size AS rest,
    coalesce((f.target - f.whole * f.source_size) / nullif(f.source_size, 0), 0e0) AS f, coalesce(d.size / nullif(f.source_size / f.docs, 0), 0e0) AS share
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
o AS (SELECT *, greatest(least(f * (0.5e0 + share / (share + 1e0)), {MOST!r}), {LEAST!r}) AS p FROM p),
q AS (SELECT *, (u / (1e0 - u)) * ((1e0 - p) / p) AS q FROM o),
r AS (
  SELECT doc_id, size, source_size, target, whole, rest,
    sum(size) OVER (PARTITION BY source ORDER BY q / (q + 1e0), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM q)
SELECT doc_id, size, source_size, target,
  CAST(size * least(2, whole + CASE WHEN rest > 0 AND run - size / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
