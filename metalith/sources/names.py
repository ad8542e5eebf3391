"""File names as data: prefix, id, cluster and variant of a stem, their order, and which files an argument means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: patterns of tokens and the variants that names may end in
ID, CLUSTER, PLACEHOLDER = "^[0-9][A-Za-z0-9]{3}$", "^(?i)cluster[0-9]+$", "^[Xx]{4}$"
VARIANTS = ("h-only-w-n", "h-only", "w-n")

MOST_PATTERNS = 1000


def stem_parts(stem: Column) -> Column:
    """Struct ``prefix, id, cluster, suffix`` of a stem such as ``fam-1ab2-cluster3-h-only``.

    A final ``_w_dw`` and placeholder tokens do not count. The first id token, with the cluster token behind it, ends the
    prefix and the rest is the suffix; without an id the longest known variant at the end is. A stem of no other tokens
    is all prefix; ids are lower case; a null stem has null parts."""
    base = F.regexp_replace(stem, "_w_dw$", "")
    tokens = F.filter(F.split(base, "-"), lambda t: (t != "") & ~t.rlike(PLACEHOLDER))
    at = F.array_position(F.transform(tokens, lambda t: t.rlike(ID)), True).cast("int")
    cluster = F.when((at > 0) & F.get(tokens, at).rlike(CLUSTER), F.get(tokens, at))
    end = at + F.when(cluster.isNotNull(), 1).otherwise(0)
    left = F.array_join(F.slice(tokens, F.lit(1), end), "-")
    right = F.array_join(F.slice(tokens, end + 1, F.greatest(F.size(tokens) - end, F.lit(0))), "-")
    whole = F.array_join(tokens, "-")
    variant = F.regexp_extract(whole, "(?i)-(" + "|".join(VARIANTS) + ")$", 1)
    bare = F.when(variant == "", whole).otherwise(F.substring(whole, F.lit(1), F.length(whole) - F.length(variant) - 1))
    empty, named = F.size(tokens) == 0, at > 0
    return F.when(
        stem.isNotNull(),
        F.struct(
            F.when(empty, base).when(named, left).otherwise(bare).alias("prefix"),
            F.when(named, F.lower(F.get(tokens, at - 1))).alias("id"),
            F.regexp_extract(cluster, "[0-9]+$", 0).alias("cluster"),
            F.when(empty, "").when(named, right).otherwise(variant).alias("suffix"),
        ),
    )


def suffix_key(suffix: Column) -> Column:
    """Order of variants: ``h-only`` and what begins so, then none, then the others by name."""
    s = F.lower(F.trim(F.coalesce(suffix, F.lit(""))))
    rank = F.when(s.startswith("h-only"), 0).when(s == "", 1).otherwise(2)
    return F.struct(rank.alias("rank"), F.when(rank == 2, s).otherwise("").alias("text"))


def resolved(files: DataFrame, arguments: DataFrame, path: str = "path", argument: str = "argument") -> DataFrame:
    """``argument, path``: the ``.xyz`` files each argument means, of a listing.

    A null argument is the first file; one with ``*``, ``?`` or ``[...]`` is a pattern for names, in its folder if it names
    one; another is the file of that path or, if none is listed, of that name. One that means no file has no row.
    Patterns are tried on every file, so there may be at most MOST_PATTERNS of them."""
    f = files.where(F.lower(path).endswith(".xyz")).select(path, F.regexp_extract(path, "([^/]*)$", 1).alias("_name"), F.regexp_extract(path, "^(.*)/", 1).alias("_dir")).distinct()
    a = arguments.select(argument).distinct()
    has = F.col(argument).rlike(r"[*?\[]")
    kind = F.when(F.col(argument).isNull(), "first").when(has, "pattern").otherwise("name")
    quoted = F.regexp_replace(F.regexp_extract(argument, "([^/]*)$", 1), r"([.+^${}()|\\])", r"\\$1")
    glob = F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, r"\[!", "[^"), r"\*", ".*"), r"\?", ".")
    a = a.select(argument, kind.alias("_kind"), F.concat(F.lit("^"), glob, F.lit("$")).alias("_glob"), F.regexp_extract(argument, "^(.*)/", 1).alias("_in"))
    if a.where("_kind = 'pattern'").limit(MOST_PATTERNS + 1).count() > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS} patterns")
    first = a.where("_kind = 'first'").select(argument).crossJoin(f.agg(F.min(path).alias(path)).where(F.col(path).isNotNull()))
    match = (F.col("_in").isin("", ".") | (F.col("_in") == F.col("_dir"))) & F.rlike("_name", F.col("_glob"))
    pattern = f.join(F.broadcast(a.where("_kind = 'pattern'")), match).select(argument, path)
    plain = a.where("_kind = 'name'").select(argument)
    exact = plain.join(f.select(path), plain[argument] == f[path]).select(argument, path)
    by_name = plain.join(exact.select(argument), argument, "left_anti").join(f, F.col(argument) == F.col("_name")).select(argument, path)
    return first.unionByName(pattern).unionByName(exact).unionByName(by_name)
