"""BED text as intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanstat.schema import U32_MAX


def parsed(value: Column) -> Column:
    """struct(chrom, start, stop, error) of a line; null for blank lines and comments.

    The first token that isn't an unsigned 32-bit number is the chromosome, the first
    two that are, start and stop. A line without a chromosome is on ``default``.
    """
    tokens = F.filter(F.split(value, r"(?U)\s+"), lambda t: t != "")
    found = fields(tokens)
    chrom, start, stop = F.coalesce(found[0], F.lit("default")), found[1], found[2]
    error = F.when(stop.isNull(), "InvalidFormat").when(start >= stop, "InvalidRange")
    skip = (F.size(tokens) == 0) | F.get(tokens, F.lit(0)).startswith("#")
    return F.when(~skip, F.struct(chrom.alias("chrom"), start.alias("start"), stop.alias("stop"), error.alias("error")))


def fields(tokens: Column) -> tuple[Column, Column, Column]:
    """chrom, start and stop among the tokens of a line; null where there is none."""
    number = lambda t: F.coalesce(t.rlike(r"^\+?[0-9]+$") & (t.try_cast("decimal(38,0)") <= U32_MAX), F.lit(False))
    nums = F.transform(F.filter(tokens, number), lambda t: t.try_cast("long"))
    chrom = F.get(F.filter(tokens, lambda t: ~number(t)), F.lit(0))
    return chrom, F.get(nums, F.lit(0)), F.get(nums, F.lit(1))


def intervals(lines: DataFrame, strict: bool = True) -> DataFrame:
    """chrom, start, stop of lines (column value) and their other columns.

    Strict: a bad line fails the job, with its kind, its file where there is a column
    ``file``, and its text. Otherwise it is left out.
    """
    place = F.concat(F.lit(" in "), F.col("file")) if "file" in lines.columns else F.lit(" in a BED line")
    told = F.concat(F.lit(": "), F.substring("value", 1, 80))
    d = lines.withColumn("_p", parsed(F.col("value"))).withColumn("_e", F.concat(F.col("_p.error"), place, told)).where("_p is not null").drop("value")
    if strict:
        fail = F.raise_error(F.col("_e")).cast("string")
        chrom = F.when(F.col("_p.error").isNull(), F.col("_p.chrom")).otherwise(fail)
    else:
        d, chrom = d.where("_p.error is null"), F.col("_p.chrom")
    return d.withColumn("chrom", chrom).withColumn("start", F.col("_p.start")).withColumn("stop", F.col("_p.stop")).drop("_p", "_e")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and file of all .bed and .bed.gz files in a folder, or of one file of any name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory()
    reader = spark.read.option("pathGlobFilter", "*.{bed,bed.gz}") if folder else spark.read
    lines = reader.text(path)
    return lines.select("value", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """file and bytes of the .bed and .bed.gz files of a folder, or of one file.

    From the file system's listing, as Spark's readers leave out empty files.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(at) if s.isFile()]
    return spark.createDataFrame([f for f in found if f[0].endswith((".bed", ".bed.gz"))], "file string, bytes long")


def read_bed(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return intervals(read_lines(spark, path), strict)
