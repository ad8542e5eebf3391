"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over the whole text, so the scan, the
measures and the verdict are a single projection without shuffle or user code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_SPACE, free, let, words

SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "des",
    "de", "la", "le", "les", "et", "des", "un", "une", "que", "en",
    "el", "los", "las", "y", "del", "se", "por", "con", "es", "una",
)


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``; ``None`` leaves a side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Production thresholds.
RULES = (
    Rule("mean_word_length", 2.0, 12.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("shout_ratio", None, 0.5),
    Rule("stop_words", 2, None),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.4),
)


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, first included.

    Windows are compared by a 64-bit hash, sorted with their position; runs of
    equal hashes are the repeated ones, and the union of their 3-word spans is
    counted from the sorted starts."""
    n = F.size(w)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("p")),
    )

    def starts(s: Column) -> Column:
        last = F.size(s) - 1
        hit = F.transform(
            s,
            lambda x, i: F.when(
                ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == x["h"]))
                | ((i < last) & (s[F.least(i + 1, last)]["h"] == x["h"])),
                x["p"],
            ),
        )
        return F.sort_array(F.filter(hit, lambda p: p.isNotNull()))

    def covered(r: Column) -> Column:
        return F.aggregate(
            r,
            F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last")),
            lambda a, p: F.struct(
                (a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum"), p.alias("last")
            ),
            lambda a: a["sum"],
        )

    return F.when(n < 4, F.lit(0)).otherwise(let(let(F.sort_array(windows), starts), covered))


def measures(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """Adds a struct ``name`` of all measures. Null and empty texts measure 0."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    held = free(df, "_words")
    df = df.withColumn(held, words(text))
    own_lines = free(df, "_lines")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, WHITE_SPACE, "")) > 0)
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    lower = F.length(text) - F.length(F.regexp_replace(text, "[a-z]", ""))
    df = df.withColumn(own_lines, lines)
    w, n = F.col(held), F.size(held)
    word_chars = F.length(F.translate(text, WHITE_SPACE, ""))
    n_symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    n_lines = F.size(own_lines)
    n_dup = n_lines - F.size(F.array_distinct(own_lines))
    stop = F.size(F.filter(w, lambda x: x.isin(*sorted(set(STOP_WORDS)))))
    some = F.greatest(n, F.lit(1))
    df = df.withColumn(
        name,
        F.struct(
            n.cast("long").alias("n_words"),
            word_chars.cast("long").alias("word_chars"),
            n_symbols.cast("long").alias("n_symbols"),
            n_dup.cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            stop.cast("long").alias("stop_words"),
            n_lines.cast("long").alias("n_lines"),
            (upper / F.greatest(upper + lower, F.lit(1))).alias("shout_ratio"),
            (word_chars / some).alias("mean_word_length"),
            (n_symbols / some).alias("symbol_ratio"),
            (stop / some).alias("stop_word_ratio"),
            (n_dup / F.greatest(n_lines, F.lit(1))).alias("dup_line_ratio"),
        ),
    )
    return df.drop(held, own_lines)


def compile_rules(rules: tuple[Rule, ...], q: Column) -> Column:
    """The threshold table as one boolean expression over the measures."""
    verdict = F.lit(True)
    for r in rules:
        if r.low is not None:
            verdict = verdict & (q[r.measure] >= r.low)
        if r.high is not None:
            verdict = verdict & (q[r.measure] <= r.high)
    return verdict


def quality(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row, input columns first, then the measures and verdicts.

    Null text counts as empty: no words, hence ``base_failed``. Repeated rows
    each keep their row; an empty table gives an empty result. Input columns
    named like an added one are replaced; all others stay, whatever their names."""
    held = free(df, "_measures")
    q = F.col(held)
    base = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    out = measures(df, text_col, held)
    added = {k: q[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    added |= {"base_failed": base, "kept": ~base & compile_rules(rules, q)}
    added |= {k: q[k] for k in ("stop_words", "shout_ratio")}
    return out.withColumns(added).drop(held)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return quality(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_STOP_SQL = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d),
g AS (
  SELECT *, CASE WHEN len(w) < 3 THEN [] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) END AS g
  FROM m),
x AS (SELECT row_number() OVER () AS rid, * FROM g),
e AS (SELECT rid, unnest(g) AS gram, generate_subscripts(g, 1) AS p FROM x),
r AS (SELECT rid, p FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS c FROM e) WHERE c > 1),
rw AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p+1, p+2]) AS q FROM r) GROUP BY rid),
q AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
    CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(w, lambda x: x IN ({_STOP_SQL}))) AS stop,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS up,
    length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS lo
  FROM x LEFT JOIN rw USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 12
  AND n_symbols / greatest(n_words, 1) <= 0.1e0
  AND up / greatest(up + lo, 1) <= 0.5e0
  AND stop >= 2 AND stop / greatest(n_words, 1) >= 0.02e0
  AND n_dup_lines / greatest(n_lines, 1) <= 0.4e0 AS kept
FROM b
"""
