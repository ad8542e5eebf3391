"""Measured spectra beside the models they belong to, by keys in their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is no entry id though it has four letters or digits.
NO_ID = r"^[CHLSchls]{4}$|^[Xx]{4}$"
CONSENSUS = "CONS"


def words(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit("[A-Za-z0-9]+"), F.lit(0))


def id_token(name: Column) -> Column:
    """The first word of four letters or digits that may be an entry id, upper-case; null without one."""
    return F.upper(F.get(F.filter(words(name), lambda w: (F.length(w) == 4) & ~w.rlike(NO_ID)), F.lit(0)))


def experiment_key(stem: Column) -> Column:
    """What stands before ``_exp`` or ``-exp``, upper-case, else the entry id; null without either."""
    before = F.regexp_extract(stem, r"(?i)^(.+?)[_-]exp(?:$|[_-].*)", 1)
    return F.coalesce(F.upper(F.nullif(F.regexp_replace(before, "^[_-]+|[_-]+$", ""), F.lit(""))), id_token(stem))


def model_keys(prefix: Column) -> Column:
    """The keys that a model answers to: its entry id, and CONS where a word of its name is that."""
    cons = F.when(F.exists(words(prefix), lambda w: F.upper(w) == CONSENSUS), F.lit(CONSENSUS))
    return F.array_distinct(F.filter(F.array(id_token(prefix), cons), lambda k: k.isNotNull()))


def matched(models: DataFrame, experiments: DataFrame) -> DataFrame:
    """``prefix, path``: each group of models (prefix) with the experiments (path) of one of its keys, a file once a group
    however many keys or rows name it. Files without a key and groups without a file are left out."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    keyed = experiments.select("path", experiment_key(stem).alias("key")).where("key is not null").distinct()
    asked = models.select("prefix", F.explode(model_keys(F.col("prefix"))).alias("key")).distinct()
    return asked.join(keyed, "key").select("prefix", "path").distinct()
