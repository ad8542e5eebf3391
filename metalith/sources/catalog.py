"""Entry search and ids: one list of predicates, as a request body or as a filter."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Search:
    """An entry holds a component, has a resolution, a method and a polymer type."""

    component: str | None = None
    resolution: float | None = None
    method: str | None = None
    polymer: str | None = None

    def terms(self) -> list[tuple[str, str, object]]:
        out = []
        if self.component:
            out.append(("component", "exact", self.component))
        if self.resolution is not None:
            out.append(("resolution", "less_or_equal", self.resolution))
        if self.method and self.method.upper() != "ALL":
            out.append(("method", "exact", self.method))
        if self.polymer and self.polymer.upper() != "ALL":
            out.append(("polymer", "contains", self.polymer))
        return out

    def body(self, start: int = 0, rows: int = 1000) -> str:
        """A JSON AND-group of the terms with paging."""
        nodes = [{"type": "terminal", "attribute": a, "operator": o, "value": v} for a, o, v in self.terms()]
        return json.dumps({"query": {"type": "group", "logical_operator": "and", "nodes": nodes}, "paginate": {"start": start, "rows": rows}}, sort_keys=True)

    def condition(self, columns: dict[str, str]) -> Column:
        """The same predicates over a catalogue; ``columns`` names its columns."""
        out = F.lit(True)
        for a, o, v in self.terms():
            c = F.col(columns[a])
            out = out & (c <= v if o == "less_or_equal" else F.lower(c).contains(str(v).lower()) if o == "contains" else F.upper(c) == str(v).upper())
        return out

    def explain(self, columns: dict[str, str]) -> Column:
        """Names of the criteria that a row fails; a missing resolution is not a failure."""
        tests = []
        for a, o, v in self.terms():
            c = F.col(columns[a])
            ok = c.isNull() | (c <= v) if o == "less_or_equal" else F.coalesce(F.lower(c).contains(str(v).lower()) if o == "contains" else F.upper(c) == str(v).upper(), F.lit(False))
            tests.append(F.when(~ok, F.lit(a)))
        return F.filter(F.array(*tests), lambda x: x.isNotNull())


def valid_id(c: Column) -> Column:
    return c.rlike("^[1-9][A-Za-z0-9]{3}$")


def split_ids(text: Column) -> Column:
    """Lower-case ids of a text, by commas and white space."""
    return F.filter(F.split(F.lower(text), r"[\s,]+"), lambda x: x != "")


def ordered_distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values by first appearance."""
    return df.groupBy(value).agg(F.min(order).alias("first_pos"))
