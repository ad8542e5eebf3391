"""An atoms relation derived from ``lineitem``, for tests and benchmarks on tables.

Coordinates are whole thousandths of an Angstrom divided by 1000, so both engines hold
the same doubles. A residue is an order, a structure sixty orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BODY = """
SELECT CAST(sid AS STRING) AS structure_id, CAST(serial AS BIGINT) AS serial, CAST(serial AS BIGINT) AS line_no,
  CAST(resseq AS STRING) AS resseq, CAST(resseq AS BIGINT) AS resi, CASE WHEN resseq % 2 = 0 THEN 'A' ELSE 'B' END AS chain, '' AS icode,
  CAST(xi AS DOUBLE) / 1000.0e0 AS x, CAST(yi AS DOUBLE) / 1000.0e0 AS y, CAST(zi AS DOUBLE) / 1000.0e0 AS z,
  CASE WHEN k = 0 THEN 'ZN' WHEN k = 1 THEN 'FE' WHEN k < 14 THEN 'N' WHEN k < 24 THEN 'O' WHEN k < 30 THEN 'S' ELSE 'C' END AS element,
  CASE WHEN k < 2 OR pk % 5 = 0 THEN 'HETATM' ELSE 'ATOM' END AS record,
  CASE resmod WHEN 0 THEN 'CYS' WHEN 1 THEN 'HIS' WHEN 2 THEN 'HIS' WHEN 3 THEN 'ASP' WHEN 4 THEN 'GLY' WHEN 5 THEN 'HOH' WHEN 6 THEN 'CYS' ELSE 'LIG' END AS resname,
  CASE WHEN k = 0 THEN 'ZN' WHEN k = 1 THEN 'FE' WHEN amod = 0 THEN 'N' WHEN amod = 1 THEN 'CA' WHEN amod = 2 THEN 'C' WHEN amod = 3 THEN 'O'
    WHEN amod = 4 THEN 'CB' WHEN amod = 5 THEN 'SG' WHEN amod = 6 THEN 'ND1' WHEN amod = 7 THEN 'NE2' ELSE 'CG' END AS atom_name,
  CASE WHEN sk % 10 < 8 THEN '' WHEN sk % 10 = 8 THEN 'A' ELSE 'B' END AS altloc,
  CAST(1 + sk % 100 AS DOUBLE) / 100.0e0 AS occ, CAST(pk % 8000 AS DOUBLE) / 100.0e0 AS bfac
FROM (SELECT l_orderkey {div} 60 AS sid, l_orderkey * 8 + l_linenumber AS serial, l_orderkey % 60 AS resseq, pk, sk,
        (pk * 7919 + sk * 104729 + l_linenumber * 31) % 16000 AS xi, (pk * 6151 + sk * 3571 + l_orderkey * 17) % 16000 AS yi,
        (l_orderkey * 4099 + sk * 769 + l_linenumber * 7001) % 16000 AS zi,
        (pk + l_linenumber) % 40 AS k, l_orderkey % 8 AS resmod, (pk + 3 * sk) % 9 AS amod
      FROM (SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
              CAST(min(l_partkey) AS BIGINT) AS pk, CAST(min(l_suppkey) AS BIGINT) AS sk
            FROM {table} GROUP BY l_orderkey, l_linenumber) t) u
"""
#: The relation for DuckDB.
ATOMS_SQL = _BODY.format(div="//", table="lineitem").replace("STRING", "VARCHAR")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atom rows: model 1 of each structure, line order by serial."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return spark.sql(_BODY.format(div="div", table="{lines}"), lines=lines).withColumn("model", F.lit(1))
