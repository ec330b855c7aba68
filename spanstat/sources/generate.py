"""Made interval sets, and the size and speed of a database."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanstat.schema import HG38, genome_map


def generate(spark: SparkSession, n: int, files: int = 1, least: int = 100, most: int = 10_000, seed: int = 42, genome: dict[str, int] = HG38) -> DataFrame:
    """sid, chrom, start and stop: uniform chromosome, length and place.

    Every value is a hash of seed, set and row, so it is the same under any partitioning.
    """
    names = sorted(genome)
    draw = lambda k, below: F.pmod(F.xxhash64(F.lit(seed) + F.col("sid"), F.col("row"), F.lit(k)), below)
    d = spark.range(n * files).select((F.col("id") % files).cast("int").alias("sid"), F.expr(f"id div {files}").alias("row"))
    d = d.withColumn("chrom", F.element_at(F.array(*[F.lit(c) for c in names]), (draw(0, F.lit(len(names))) + 1).cast("int")))
    d = d.withColumn("len", draw(1, F.lit(most - least + 1)) + least).withColumn("size", genome_map(genome, F.col("chrom")))
    d = d.withColumn("start", draw(2, F.greatest(F.col("size") - F.col("len"), F.lit(1))))
    return d.select("sid", "chrom", "start", (F.col("start") + F.col("len")).alias("stop"))


def size_report(spark: SparkSession, db: str) -> DataFrame:
    """layer, files, bytes, intervals and bytes_per_interval of a database."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{db}/intervals").select("path", "length")
    at = F.regexp_extract("path", r"layer=(\d+)", 1).cast("int").alias("layer")
    sizes = files.groupBy(at).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    rows = spark.read.parquet(f"{db}/intervals").groupBy("layer").agg(F.count("*").alias("intervals"))
    return sizes.join(rows, "layer").withColumn("bytes_per_interval", F.col("bytes") / F.col("intervals"))


def timings(runs: dict[str, Callable[[], None]], times: int = 3, rows: int | None = None) -> list[dict]:
    """name, average and best seconds, and rows a second, of each run."""
    out = []
    for name, run in runs.items():
        took = []
        for _ in range(times):
            at = time.perf_counter()
            run()
            took.append(time.perf_counter() - at)
        out.append({"name": name, "average_s": sum(took) / times, "best_s": min(took), "rows_per_s": rows / min(took) if rows else None})
    return out
