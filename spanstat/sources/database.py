"""A database of sources: Parquet tables ``sources``, ``intervals`` and ``moments``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanstat.operators import moments as mo
from spanstat.operators.overlap import overlap_counts, overlap_join
from spanstat.schema import HG38, LayerConfig
from spanstat.sources.bed import list_files, read_bed


class AddError(ValueError):
    """Nothing to add."""


class QueryError(ValueError):
    """A query that the database can't answer."""


def _table(spark: SparkSession, db: str, name: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{db}/{name}")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return spark.read.parquet(f"{db}/{name}") if fs.exists(path) else None


def _numbered(files: DataFrame, first: int = 0) -> DataFrame:
    """sid of each file, by name: one row per file, so a single window is small."""
    return files.select((F.row_number().over(Window.orderBy("file")) - 1 + first).cast("int").alias("sid"), F.col("file").alias("name"))


def add(spark: SparkSession, path: str, db: str, stats: bool = False, chroms: list[str] | None = None, genome: dict[str, int] = HG38, layers: LayerConfig = LayerConfig()) -> None:
    """Append the BED files of ``path``; an empty file takes a source id too."""
    files = list_files(spark, path)
    if files.isEmpty():
        raise AddError(f"no BED files in {path}")
    known = _table(spark, db, "sources")
    first = 0 if known is None else known.agg(F.coalesce(F.max("sid") + 1, F.lit(0))).first()[0]
    sources = _numbered(files, first)
    rows = read_bed(spark, path).join(F.broadcast(sources), F.col("file") == F.col("name")).select("sid", "chrom", "start", "stop")
    rows = rows.withColumn("layer", layers.layer(F.col("stop") - F.col("start")))
    rows.repartition("chrom", "layer", F.expr("start div 4194304")).sortWithinPartitions("chrom", "layer", "start").write.mode("append").partitionBy("chrom", "layer").parquet(f"{db}/intervals")
    if stats:
        used = {k: v for k, v in genome.items() if chroms is None or k in chroms}
        mo.moments(rows, used).write.mode("append").parquet(f"{db}/moments")
    sources.write.mode("append").parquet(f"{db}/sources")


def layers(spark: SparkSession, db: str, config: LayerConfig = LayerConfig()) -> DataFrame:
    """chrom, layer, its largest size and its intervals, of all shards."""
    steps = F.array(*[F.lit(config.max_size(k)).cast("long") for k in range(16)])
    d = _need(spark, db, "intervals").groupBy("chrom", F.col("layer").cast("int").alias("layer")).agg(F.count("*").alias("n"))
    return d.select("chrom", "layer", F.get(steps, F.col("layer")).alias("max_size"), "n").orderBy("chrom", "layer")


def info(spark: SparkSession, db: str) -> DataFrame:
    """sid and name of all sources."""
    return _need(spark, db, "sources").orderBy("sid")


def _need(spark: SparkSession, db: str, name: str) -> DataFrame:
    found = _table(spark, db, name)
    if found is None:
        raise QueryError(f"{db} has no table {name}")
    return found


def query(spark: SparkSession, db: str, path: str, mode: str = "counts", genome: dict[str, int] = HG38) -> DataFrame:
    """Results of the BED files of ``path``: mode counts, stats or intervals."""
    q = read_bed(spark, path)
    names = _numbered(q.select("file").distinct())
    q = q.join(F.broadcast(names), F.col("file") == F.col("name")).select("sid", "chrom", "start", "stop")
    d = _need(spark, db, "intervals").select("sid", "chrom", "start", "stop")
    dn = _need(spark, db, "sources").select(F.col("sid").alias("d_sid"), F.col("name").alias("db_name"))
    qn = names.select(F.col("sid").alias("q_sid"), F.col("name").alias("query_name"))
    if mode == "intervals":
        out = overlap_join(q, d).select("q_sid", "d_sid", F.col("q_chrom").alias("chrom"), F.col("q_start").alias("query_start"), F.col("q_stop").alias("query_end"), F.col("d_start").alias("db_start"), F.col("d_stop").alias("db_end"), F.col("bp").alias("intersection_bp"))
    elif mode == "stats":
        store = _table(spark, db, "moments")
        # A database without moments has no scores.
        store = spark.createDataFrame([], mo.MOMENTS) if store is None else store
        out = mo.score(q, d, store, genome).select("q_sid", "d_sid", "overlap_count", "observed_bins", "p_value", "llr")
    elif mode == "counts":
        out = overlap_counts(q, d).select("q_sid", "d_sid", "overlap_count")
    else:
        raise QueryError(f"no mode {mode}")
    out = out.join(F.broadcast(qn), "q_sid", "left").join(F.broadcast(dn), "d_sid", "left").drop("q_sid", "d_sid").fillna("", ["query_name", "db_name"])
    if mode == "stats":
        return out.orderBy(F.asc_nulls_last("p_value"), "query_name", "db_name")
    return out if mode == "intervals" else out.orderBy(F.desc("overlap_count"), "query_name", "db_name")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, nulls left out."""
    df.write.mode("overwrite").json(path)
