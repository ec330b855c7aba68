"""Natural order and sorting of BED lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanstat.sources.bed import fields


def natural_key(name: Column) -> Column:
    """A string whose order is the names' order with digit runs taken as numbers."""
    plain = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    # A number goes by its count of digits, then by them.
    number = lambda x: F.concat(F.lpad(F.length(plain(x)).cast("string"), 5, "0"), plain(x))
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d+$"), number(x)).otherwise(x)), "")


def sort_bed(lines: DataFrame, natural: bool = False) -> DataFrame:
    """Lines (column value) by chromosome, start and stop, headers first.

    The chromosome is the first token that isn't a number, start and stop the first two
    that are. Blank lines, and lines without all three, are dropped; lines keep their text.
    """
    plain = F.ltrim(F.regexp_replace("value", r"^\s+", ""))
    header = plain.rlike(r"^(#|track |browser )")
    chrom, start, stop = fields(F.filter(F.split(plain, r"\s+"), lambda t: t != ""))
    d = lines.select("value", header.alias("h"), chrom.alias("chrom"), start.alias("start"), stop.alias("stop"))
    d = d.where("h or (chrom is not null and stop is not null)")
    key = natural_key(F.col("chrom")) if natural else F.col("chrom")
    return d.orderBy(F.desc("h"), F.when(~F.col("h"), key), F.when(~F.col("h"), F.col("start")), F.when(~F.col("h"), F.col("stop")), "value").select("value")


def sort_file(spark: SparkSession, source: str, target: str, natural: bool = False) -> None:
    """Sort a BED file, plain or gz, into the text files of ``target``, in order of their names."""
    sort_bed(spark.read.text(source), natural).write.mode("overwrite").text(target)
