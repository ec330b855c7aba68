"""One BED set per trait, or per cell and state, from wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanstat.functions.names import safe_name


def by_trait(rows: DataFrame, trait: str, chrom: str, pos: str) -> DataFrame:
    """trait (a safe name), chrom, start and stop: one base pair per row.

    A number that a spreadsheet wrote as a decimal loses its .0 and nothing else;
    rows without a trait, chromosome or position are left out.
    """
    c = F.regexp_replace(F.trim(F.col(chrom).cast("string")), r"\.0$", "")
    at = F.trim(F.col(pos).cast("string")).try_cast("double").cast("long")
    d = rows.select(safe_name(F.col(trait)).alias("trait"), F.when(c.startswith("chr"), c).otherwise(F.concat(F.lit("chr"), c)).alias("chrom"), at.alias("start"), c.alias("_c"))
    d = d.where("trait <> '' and _c <> '' and start is not null").drop("_c")
    return d.withColumn("stop", F.col("start") + 1)


def by_state(rows: DataFrame, cells: DataFrame, states: DataFrame) -> DataFrame:
    """name (cell_state), chrom, start and stop of a segmentation.

    ``rows`` has sample, chrom, start, stop and state; ``cells`` maps sample to cell
    and ``states`` state to label (tables of some hundred rows). An unknown sample or
    state fails the job.
    """
    j = rows.join(F.broadcast(cells), "sample", "left").join(F.broadcast(states), "state", "left")
    known = lambda c, what: F.coalesce(c, F.raise_error(F.concat(F.lit(f"unknown {what} "), F.coalesce(what, F.lit("null")))).cast("string"))
    return j.select(F.concat(known(F.col("cell"), "sample"), F.lit("_"), known(F.col("label"), "state")).alias("name"), "chrom", "start", "stop")


def write_split(rows: DataFrame, name: str, path: str) -> None:
    """BED text under ``path``/name=...; a name's rows are spread over the tasks that have them."""
    line = F.concat_ws("\t", "chrom", "start", "stop").alias("value")
    rows.select(name, line).write.mode("overwrite").partitionBy(name).text(path)
