"""Interval views over the given tables; the same text runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "fx_db": "select cast(l_suppkey % 10 as int) as sid, concat('chr', cast(20 + l_orderkey % 3 as string)) as chrom, (l_orderkey * 7919 + l_linenumber * 104729) % 40000000 as start, (l_orderkey * 7919 + l_linenumber * 104729) % 40000000 + 1 + (l_partkey * 31) % 9973 as stop from lineitem",
    "fx_query": "select cast(o_custkey % 4 as int) as sid, concat('chr', cast(20 + o_custkey % 3 as string)) as chrom, (o_orderkey * 6101) % 40000000 as start, (o_orderkey * 6101) % 40000000 + 1 + (o_custkey * 17) % 4999 as stop from orders",
    "fx_snp": "select cast(c_custkey % 3 as int) as sid, concat('chr', cast(20 + c_nationkey % 3 as string)) as chrom, (c_custkey * 7907) % 40000000 as start, (c_custkey * 7907) % 40000000 + 1 as stop from customer",
    "fx_mask": "select 0 as sid, concat('chr', cast(20 + p_size % 3 as string)) as chrom, cast((p_partkey * 19937) % 40000000 as bigint) as start, cast((p_partkey * 19937) % 40000000 + 500 + (p_size * 211) % 20011 as bigint) as stop from part",
}
BASE = {"fx_db": "lineitem", "fx_query": "orders", "fx_snp": "customer", "fx_mask": "part"}
GENOME = {"chr20": 64444167, "chr21": 46709983, "chr22": 50818468}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame, without registering names in the session."""
    text = VIEWS[name]
    columns = text[len("select ") : text.rindex(" from ")]
    parts, depth, last = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(columns[last:i])
            last = i + 1
    d = load(spark, sf_dir, BASE[name]).selectExpr(*parts, columns[last:])
    return d.select(F.col("sid").cast("int"), "chrom", F.col("start").cast("long"), F.col("stop").cast("long"))


def ctes(*names: str) -> str:
    return "with recursive " + ", ".join(f"{n} as ({VIEWS[n]})" for n in names)
