"""Annotated XYZ, Debye-Waller and spectrum texts as relations, and XYZ rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metalith.operators.atoms import let, settled, symbol


def _words(text: Column) -> Column:
    """What stands between white space, without a pattern to be matched at each place."""
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def comment_map(comment: Column) -> Column:
    """``K=V`` words of a comment as a map; the last of a key wins, other words are left out."""
    pairs = F.filter(_words(comment), lambda t: F.instr(t, "=") > 1)
    entry = lambda t: F.struct(F.substring_index(t, "=", 1).alias("key"), F.substring(t, F.instr(t, "=") + 1, F.length(t)).alias("value"))
    # bound once: lambdas inside would split the comment anew for each of its words; words are compared only where a key repeats
    last = lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda o: o["key"] == e["key"]))
    once = lambda all_: F.size(F.array_distinct(all_["key"])) == F.size(all_)
    return let(F.transform(pairs, entry), lambda all_: F.map_from_entries(F.when(once(all_), all_).otherwise(last(all_))))


def upsert(comment: Column, key: str, value: Column, drop: tuple[str, ...] = ()) -> Column:
    """The comment without old ``key=`` words (and those of ``drop``), then ``key=value``."""
    kept = F.filter(F.split(F.trim(comment), r"\s+"), lambda t: (t != "") & ~F.substring_index(t, "=", 1).isin(key, *drop))
    return F.concat_ws(" ", F.array_join(kept, " "), F.concat(F.lit(key + "="), value))


def parse_xyz(lines: DataFrame) -> DataFrame:
    """Atoms of XYZ lines ``(source, line_no, line)``: the two header lines are skipped, rows
    need a symbol and three numbers; ``meta`` is the comment's map."""
    body = lines.where("line_no >= 2").withColumns({"_t": _words(F.substring_index("line", "#", 1)), "comment": F.when(F.instr("line", "#") > 0, F.trim(F.expr("substring(line, instr(line, '#') + 1)"))).otherwise(F.lit(""))})
    n = lambda i: F.get("_t", F.lit(i)).try_cast("double")
    body = settled(body.select("source", "line_no", "_t", "comment")).where(F.size("_t") >= 4).select("source", "line_no", F.get("_t", F.lit(0)).alias("element"), n(1).alias("x"), n(2).alias("y"), n(3).alias("z"), "comment")
    return body.where("x is not null and y is not null and z is not null").withColumn("meta", comment_map(F.col("comment")))


def parse_dw(lines: DataFrame) -> DataFrame:
    """Rows of at least eight words: group, symbol, x, y, z, distance, sig2_tot, atom_index;
    a header row has no numbers and goes."""
    t = lines.withColumn("_t", F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")).where(F.size("_t") >= 8)
    n = lambda i: F.get("_t", F.lit(i)).try_cast("double")
    t = t.select("source", "line_no", F.get("_t", F.lit(0)).alias("group"), F.get("_t", F.lit(1)).alias("symbol"), n(2).alias("x"), n(3).alias("y"), n(4).alias("z"), n(5).alias("distance"), n(6).alias("sig2_tot"), F.get("_t", F.lit(7)).try_cast("int").alias("atom_index"))
    return t.where("x is not null and sig2_tot is not null")


def nearest_rows(rows: DataFrame) -> DataFrame:
    """First-shell rows of a Debye-Waller table."""
    return rows.where(F.lower("group") == "nearest")


def dw_tagged(lines: DataFrame) -> DataFrame:
    """``source, line_no, element, x, y, z, dw`` of XYZ rows whose comment has a ``dw=`` number;
    other rows are left out."""
    tag = F.regexp_extract("comment", r"(?i)\bdw\s*=\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    rows = parse_xyz(lines).withColumn("dw", tag.try_cast("double")).where("dw is not null")
    return rows.select("source", "line_no", "element", "x", "y", "z", "dw")


def parse_spectrum(lines: DataFrame) -> DataFrame:
    """``source, k, chi``: columns 3 and 6 of wide rows, else 1 and 2; first value of each k."""
    t = lines.where(~F.trim("line").startswith("#")).withColumn("_t", F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != ""))
    n = lambda i: F.get("_t", F.lit(i)).try_cast("double")
    wide = F.size("_t") >= 6
    t = t.select("source", "line_no", F.when(wide, n(2)).otherwise(n(0)).alias("k"), F.when(wide, n(5)).otherwise(n(1)).alias("chi")).where("k is not null and chi is not null")
    return t.groupBy("source", "k").agg(F.min_by("chi", "line_no").alias("chi"))


def xyz_line(title: bool = True) -> Column:
    """One atom line: symbol, coordinates with six decimals and a sign place, provenance."""
    sym = symbol(F.col("element")) if title else F.col("element")
    place = F.trim(F.concat("resseq", "icode"))
    return F.format_string("%-2s  % .6f  % .6f  % .6f  # RES=%s CHAIN=%s RESSEQ=%s ATOM=%s REC=%s", sym, "x", "y", "z", "resname", "chain", place, "atom_name", "record")


def render(atoms: DataFrame, by: list[str], header: Column, title: bool = True) -> DataFrame:
    """XYZ text per group, atoms by ``ord``; coordinates are used as they are."""
    rows = atoms.withColumns({"_line": xyz_line(title), "_head": header})
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ord", "_line"))), lambda s: s["_line"])
    g = rows.groupBy(*by).agg(lines.alias("_l"), F.first("_head").alias("_h"))
    return g.select(*by, F.concat(F.array_join(F.concat(F.array(F.size("_l").cast("string"), F.col("_h")), F.col("_l")), "\n"), F.lit("\n")).alias("xyz_text"))
