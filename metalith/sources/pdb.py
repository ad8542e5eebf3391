"""Fixed-width structure text: lines, atoms, models, resolution, secondary structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metalith.operators.atoms import settled
from metalith.schema import PDB_COLUMNS

FILE = ["structure_id"]


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``structure_id, line_no, line`` of text files; line order within a file is kept."""
    files = spark.read.text(paths, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+?)(\.[A-Za-z]+)?(\.gz)?$", 1).alias("structure_id"), "value")
    return files.select("structure_id", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def file_format(path: Column, first_line: Column) -> Column:
    """By extension, else by a first line that begins a data block; else pdb."""
    low = F.lower(path)
    return F.when(low.rlike(r"\.(cif|mmcif)(\.gz)?$"), "cif").when(low.rlike(r"\.(pdb|ent)(\.gz)?$"), "pdb").when(F.lower(F.trim(first_line)).startswith("data_"), "cif").otherwise("pdb")


def field(line: Column, a: int, b: int) -> Column:
    """Columns a to b (from 0, end excluded) of a line, stripped; columns behind its end are blank."""
    return F.trim(F.substring(line, a + 1, b - a))


def infer_element(element: Column, atom_name: Column) -> Column:
    """A blank element comes from the name: two letters if the second is lower case."""
    bare = F.regexp_replace(atom_name, "^[0-9]+", "")
    two = F.substring(bare, 1, 2)
    return F.upper(F.when(element != "", element).when(two.rlike("^[A-Za-z][a-z]$"), two).otherwise(F.substring(bare, 1, 1)))


def parse_atoms(lines: DataFrame) -> DataFrame:
    """Atom rows of ATOM and HETATM lines; rows without three coordinates go, an unreadable
    serial is 0, occupancy 1, B-factor 0. Other columns of ``lines`` stay."""
    f = {name: field(F.col("line"), a, b) for name, a, b in PDB_COLUMNS}
    # the filters below would otherwise make a computed line anew for each of their columns
    rows = settled(lines).where(F.substring("line", 1, 6).isin("ATOM  ", "HETATM", "ATOM"))
    number = lambda c, kind: F.expr(f"try_cast(`{c}` as {kind})")
    rows = rows.withColumns({n: v for n, v in f.items()})
    rows = rows.withColumn("element", infer_element(F.col("element"), F.col("atom_name")))
    rows = rows.withColumns({
        "serial": F.coalesce(number("serial", "int"), F.lit(0)), "occ": F.coalesce(number("occ", "double"), F.lit(1.0)), "bfac": F.coalesce(number("bfac", "double"), F.lit(0.0)),
        "x": number("x", "double"), "y": number("y", "double"), "z": number("z", "double"),
    })
    return rows.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()).withColumnRenamed("line", "raw_line")


def with_models(lines: DataFrame) -> DataFrame:
    """Adds ``model`` (ordinal of MODEL lines, 0 before the first) and ``closed`` (an ENDMDL
    came since). One window per file in line order."""
    w = Window.partitionBy(*FILE).orderBy("line_no")
    begins, ends = F.col("line").startswith("MODEL "), F.col("line").startswith("ENDMDL")
    begins = begins | (F.trim("line") == "MODEL")
    out = lines.withColumn("model", F.sum(begins.cast("int")).over(w))
    return out.withColumn("closed", F.sum(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))


def model_number(lines: DataFrame) -> DataFrame:
    """Atom lines with the number on their MODEL line; a bad one, or none, is 1."""
    w = Window.partitionBy(*FILE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_model = F.col("line").startswith("MODEL")
    number = F.when(is_model, F.coalesce(F.expr("try_cast(trim(substring(line, 7)) as int)"), F.lit(1)))
    return lines.withColumn("model", F.coalesce(F.last(number, ignorenulls=True).over(w), F.lit(1)))


def model_blocks(lines: DataFrame) -> DataFrame:
    """Header lines (model 0) and lines of each model block; text after the last ENDMDL goes."""
    m = with_models(lines).where(~F.col("line").rlike("^(MODEL|ENDMDL)"))
    total = m.groupBy(*FILE).agg(F.max("model").alias("_n"))
    m = m.join(total, FILE)
    return m.where((F.col("_n") == 0) | (F.col("model") == 0) | (F.coalesce("closed", F.lit(0)) < F.col("model"))).drop("_n", "closed")


def resolution(lines: DataFrame) -> DataFrame:
    """First ``REMARK   2`` resolution before the first atom line; null if not applicable."""
    atom = F.col("line").rlike("^(ATOM  |HETATM)")
    first = F.min(F.when(atom, F.col("line_no"))).over(Window.partitionBy(*FILE))
    value = F.expr(r"try_cast(regexp_extract(line, 'RESOLUTION\\.\\s+([0-9.]+)', 1) as double)")
    r = lines.withColumn("_first", first).where(F.coalesce(F.col("line_no") < F.col("_first"), F.lit(True)))
    r = r.where(F.col("line").startswith("REMARK   2") & F.col("line").contains("RESOLUTION"))
    found = r.groupBy(*FILE).agg(F.min_by(value, "line_no").alias("resolution"))
    return lines.select(*FILE).distinct().join(found, FILE, "left")


def secondary_ranges(lines: DataFrame) -> DataFrame:
    """``chain, kind, start, stop`` of HELIX and SHEET lines, in either order of ends."""
    helix, l = F.col("line").startswith("HELIX"), F.col("line")
    rows = lines.where(F.col("line").rlike("^(HELIX|SHEET)"))
    chain = F.when(helix, field(l, 19, 20)).otherwise(field(l, 21, 22))
    rows = rows.select(*FILE, chain.alias("chain"), F.when(helix, "HELIX").otherwise("SHEET").alias("kind"), F.when(helix, field(l, 21, 25)).otherwise(field(l, 22, 26)).alias("a"), field(l, 33, 37).alias("b"))
    a, b = F.expr("try_cast(a as int)"), F.expr("try_cast(b as int)")
    return rows.select(*FILE, "chain", "kind", F.least(a, b).alias("start"), F.greatest(a, b).alias("stop")).where("start is not null and stop is not null")


def seqres(lines: DataFrame) -> DataFrame:
    """``chain, pos, resname`` of SEQRES lines in order, pos from 0."""
    rows = lines.where(F.col("line").startswith("SEQRES"))
    rows = rows.select(*FILE, "line_no", field(F.col("line"), 11, 12).alias("chain"), F.posexplode(F.filter(F.split(F.substring("line", 20, 51), r"\s+"), lambda x: x != "")).alias("p", "resname"))
    w = Window.partitionBy(*FILE, "chain").orderBy("line_no", "p")
    return rows.withColumn("pos", F.row_number().over(w) - 1).select(*FILE, "chain", "pos", "resname")


def render_atom(df: DataFrame) -> DataFrame:
    """``line``: fixed-width text of atom rows."""
    text = F.format_string(
        "%-6s%5d %-4s%1s%3s %1s%4s%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s%2s",
        "record", F.col("serial") % 100000, "atom_name", "altloc", "resname", "chain", "resseq", "icode", "x", "y", "z", "occ", "bfac", "element", F.lit(""),
    )
    return df.withColumn("line", text)
