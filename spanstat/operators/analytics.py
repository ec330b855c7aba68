"""Corpus statistics, ranks, correlations, pivots and ROC curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (25, 50, 75, 90, 95, 99)


def corpus_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, total, mean, population std, least, largest and exact percentiles."""
    v = F.col(value)
    aggs = [F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("largest")]
    return df.groupBy(*by).agg(*aggs, *[F.percentile(v, p / 100).alias(f"p{p}") for p in PERCENTILES])


def top(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The ``n`` most common keys; ties by key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def histogram(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """bucket (from 0) and n over equal bins from the least to the largest value."""
    d = df.select(value.cast("double").alias("v")).where("v is not null")
    ends = d.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return d.join(F.broadcast(ends)).groupBy(at.cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def zscores(df: DataFrame, cell: str, state: str, value: str) -> DataFrame:
    """Mean over states of each cell's z-score within its state; missing scores 0."""
    w = Window.partitionBy(state)
    std = F.stddev_pop(value).over(w)
    z = (F.col(value) - F.avg(value).over(w)) / F.when(std == 0, 1.0).otherwise(std)
    states = df.agg(F.count_distinct(state).alias("k"))
    scored = df.select(cell, F.coalesce(z, F.lit(0.0)).alias("z")).groupBy(cell).agg(F.sum("z").alias("z"))
    return scored.join(F.broadcast(states)).select(cell, (F.col("z") / F.col("k")).alias("z"))


def pivot(df: DataFrame, row: str, col: str, value: str, cols: Sequence[str], fill: float = 0.0) -> DataFrame:
    return df.groupBy(row).pivot(col, list(cols)).agg(F.first(value, ignorenulls=True)).fillna(fill)


def average_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Ranks from 1, ties with their mean rank. Values are counted first, so the
    ordered window holds distinct values, not rows."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(value)
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn(out, before + (F.col("_n") + 1) / 2).drop("_n")
    return df.join(ranks, [*by, value])


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """r; null for fewer than three pairs."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return d.agg(F.count("*").alias("n"), F.corr(x, y).alias("r")).select(F.when(F.col("n") > 2, F.col("r")).alias("r"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """r of average ranks; null for fewer than five pairs."""
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    d = average_rank(average_rank(d, "x", "rx"), "y", "ry")
    return d.agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("r")).select(F.when(F.col("n") >= 5, F.col("r")).alias("r"))


def least_squares(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """The slope of y = slope * x."""
    return df.agg((F.sum(x * y) / F.sum(x * x)).alias("slope"))


def roc(df: DataFrame, by: str, score: str, label: str, tie: str) -> DataFrame:
    """Curve points per row, highest score first: fpr and tpr, with the area so far."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(by)
    lab = F.col(label).cast("int")
    d = df.withColumn("tpr", F.sum(lab).over(w) / F.sum(lab).over(whole)).withColumn("fpr", F.sum(1 - lab).over(w) / F.sum(1 - lab).over(whole))
    o = Window.partitionBy(by).orderBy(F.desc(score), tie)
    step = (F.col("fpr") - F.coalesce(F.lag("fpr").over(o), F.lit(0.0))) * (F.col("tpr") + F.coalesce(F.lag("tpr").over(o), F.lit(0.0))) / 2
    return d.withColumn("area", step)


def auc(df: DataFrame, by: str, score: str, label: str, tie: str) -> DataFrame:
    return roc(df, by, score, label, tie).groupBy(by).agg(F.sum("area").alias("auc"))


def rank_share(df: DataFrame, by: str, score: str, tie: str) -> DataFrame:
    """1 - rank / n, ranks from 0 and highest score first."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie)) - 1
    return df.withColumn("share", 1 - rank / F.count("*").over(Window.partitionBy(by)))


def first_category(name: Column, words: dict[str, str]) -> Column:
    """The category of the first keyword that the name holds, in any case."""
    return F.coalesce(*[F.when(F.upper(name).contains(k.upper()), F.lit(c)) for k, c in words.items()])


def all_categories(name: Column, words: dict[str, str]) -> Column:
    """The sorted categories of all keywords that the name holds."""
    found = F.array_compact(F.array(*[F.when(F.upper(name).contains(k.upper()), F.lit(c)) for k, c in words.items()]))
    return F.sort_array(F.array_distinct(found))
