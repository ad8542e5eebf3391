"""Metadata of entries from JSON answers, and their notes beside file names in markdown texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "N/A"
UNKNOWN = " — *metadata unavailable*"


@dataclass(frozen=True)
class Paths:
    """Where an answer holds what; ``names``: arrays from the outside in, then the name in an element."""

    title: str = "$.struct.title"
    classification: str = "$.struct_keywords.pdbx_keywords"
    date: str | None = "$.rcsb_accession_info.deposit_date"
    names: tuple[str, ...] = ("$.polymer_entities", "$.rcsb_entity_source_organism", "$.ncbi_scientific_name")


def names_at(value: Column, paths: tuple[str, ...]) -> Column:
    """Distinct non-empty names by first appearance, through nested arrays."""

    def inner(rows: Column, path: str) -> Column:
        return F.flatten(F.filter(F.transform(rows, lambda x: F.try_variant_get(x, path, "array<variant>")), lambda a: a.isNotNull()))

    level = F.array(value)
    for p in paths[:-1]:
        level = inner(level, p)
    names = F.transform(level, lambda x: F.try_variant_get(x, paths[-1], "string"))
    return F.array_distinct(F.filter(names, lambda s: s.isNotNull() & (s != "")))


def day(date: Column) -> Column:
    """The first ten characters of a date, ``N/A`` without one."""
    return F.when(F.coalesce(date, F.lit("")) == "", MISSING).otherwise(F.substring(date, 1, 10))


def entry_metadata(df: DataFrame, answer: str, paths: Paths = Paths()) -> DataFrame:  # noqa: B008
    """``df`` with ``title, classification, organism, deposit_date`` in place of ``answer``: ``N/A`` where a value is
    missing, all four null where the answer is null or no JSON. Each answer is parsed once."""
    rows = df.withColumn("_v", F.try_parse_json(answer)).drop(answer)
    at = lambda p: F.try_variant_get("_v", p, "string") if p else F.lit(None).cast("string")
    text = lambda p: F.coalesce(F.trim(at(p)), F.lit(MISSING))
    names = F.array_join(names_at(F.col("_v"), paths.names), "; ")
    values = {"title": text(paths.title), "classification": text(paths.classification), "organism": F.when(names == "", MISSING).otherwise(names), "deposit_date": day(at(paths.date))}
    return rows.withColumns({k: F.when(F.col("_v").isNotNull(), v) for k, v in values.items()}).drop("_v")


def note(title: Column, classification: Column, organism: Column, date: Column) -> Column:
    """The text behind a file name: its metadata with pipes escaped, or that there are none."""
    cell = lambda c: F.replace(F.when(F.coalesce(c, F.lit("")) == "", MISSING).otherwise(c), F.lit("|"), F.lit("\\|"))
    text = F.concat(F.lit(" — **"), cell(title), F.lit("**; Classification: "), cell(classification), F.lit("; Organism: "), cell(organism), F.lit("; Deposited: "), cell(date))
    return F.when(title.isNull() & classification.isNull() & organism.isNull() & date.isNull(), UNKNOWN).otherwise(text)


def annotated(texts: DataFrame, key: str, text: str, metadata: DataFrame) -> DataFrame:
    """``key, text`` with a note behind each file name in back quotes that begins with an entry id.

    ``key`` is unique; ``metadata``: entry_id (lower case, unique) and the four columns. Texts are cut behind their names,
    the pieces are joined to the metadata by id and put together again; a text without names, or null, stays."""
    # a file name has at most 255 bytes, which bounds the look behind
    cut = F.split(text, r"(?<=`[1-9][A-Za-z0-9]{3}_[^`\n]{0,255}\.xyz`)")
    pieces = texts.select(key, F.posexplode_outer(cut).alias("_i", "_p"))
    found = F.lower(F.regexp_extract("_p", "`([1-9][A-Za-z0-9]{3})_[^`\\n]*\\.xyz`$", 1))
    pieces = pieces.withColumn("entry_id", F.when(found != "", found)).join(metadata, "entry_id", "left")
    own = note(*(F.col(c) for c in ("title", "classification", "organism", "deposit_date")))
    pieces = pieces.select(key, "_i", F.concat("_p", F.when(F.col("entry_id").isNotNull(), own).otherwise(F.lit(""))).alias("_p"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_p"))), lambda s: s["_p"]), "")
    return pieces.groupBy(key).agg(F.when(F.count("_p") > 0, whole).alias(text))
