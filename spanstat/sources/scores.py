"""Score files of tools, and the engine's own JSON results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanstat.functions.names import strip_bed


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A table of tab-separated strings; its header may begin with #.

    Rows with too few fields are left out, further fields ignored.
    """
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    first = lines.first()
    if first is None:
        return spark.createDataFrame([], "value string")
    header = first.value.rstrip("\n\t").lstrip("#").split("\t")
    parts = F.split(F.regexp_replace(F.regexp_replace("value", r"\t+$", ""), "^#+", ""), "\t")
    rows = lines.where(F.col("value") != first.value).withColumn("p", parts).where(F.size("p") >= len(header))
    return rows.select(*[F.col("p")[i].alias(c) for i, c in enumerate(header)])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The records of a JSON result: a list, or an object whose first list holds them."""
    d = spark.read.option("multiLine", True).json(path)
    lists = [c for c, t in d.dtypes if t.startswith("array<struct")]
    return d.select(F.explode(F.col(f"`{lists[0]}`")).alias("r")).select("r.*") if lists else d


def write_results(df: DataFrame, path: str, key: str = "results") -> None:
    """One JSON object {key: [rows]}, nulls left out (key hits for intervals).

    Rows come to the driver a partition at a time and go on to the file, so it
    never holds them all; large results are better kept as Parquet.
    """
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at, True)
    try:
        out.write(bytearray(f'{{"{key}":['.encode()))
        rows = df.select(F.to_json(F.struct(*df.columns)).alias("j"))
        for i, r in enumerate(rows.toLocalIterator()):
            out.write(bytearray(("," * (i > 0) + "\n" + r.j).encode()))
        out.write(bytearray(b"\n]}\n"))
    finally:
        out.close()


def milestones(lines: DataFrame, order: str) -> DataFrame:
    """name, milestone and p of a test's report (column value, in the order of ``order``).

    A section begins with "# milestone=N trials=N"; its rows are name, observed, p.
    The header, blank lines and rows without a number are left out. The running
    section is found within a file, which is bounded by sources times milestones.
    """
    by = ["file"] if "file" in lines.columns else []
    mark = F.regexp_extract("value", r"^# milestone=\d+ trials=(\d+)", 1)
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumn("milestone", F.last(F.when(mark != "", mark.cast("int")), ignorenulls=True).over(w))
    t = F.split("value", "\t")
    d = d.where((mark == "") & F.col("milestone").isNotNull() & ~F.col("value").startswith("db_name"))
    d = d.select(*by, strip_bed(F.regexp_extract(F.get(t, F.lit(0)), r"([^/]*)$", 1)).alias("name"), "milestone", F.get(t, F.lit(2)).try_cast("double").alias("p"))
    return d.where("p is not null")


def read_milestones(spark: SparkSession, path: str) -> DataFrame:
    """file, name, milestone and p of reports; a report is read whole, so its lines keep their order."""
    whole = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return milestones(whole, "line")
