"""Comparison of the scores of several tools, and the order of matrix rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanstat.functions.stats import minus_log10
from spanstat.operators.analytics import spearman

#: Cells of a grid with fewer names have no correlation.
MIN_NAMES = 5


def aligned(a: DataFrame, b: DataFrame, name: str, score: str) -> DataFrame:
    """name and the scores x and y of the names that both tools have."""
    x, y = (d.select(name, F.col(score).alias(c)) for d, c in ((a, "x"), (b, "y")))
    return x.join(y, name)


def with_counts(scores: DataFrame, counts: DataFrame, keys: Sequence[str] = ("q_sid", "d_sid")) -> DataFrame:
    """All scores with their overlap counts, 0 where there is none."""
    return scores.join(counts.select(*keys, "overlap_count"), list(keys), "left").withColumn("overlap_count", F.coalesce("overlap_count", F.lit(0).cast("long")))


def correlation_grid(scores: DataFrame, trials: DataFrame, thresholds: Sequence[float], name: str = "name") -> DataFrame:
    """milestone, threshold, n and the rank correlation of -log10 p (null under five names).

    ``scores`` has name and p, ``trials`` name, milestone and p. A cell takes the
    names that both have and whose p in ``scores`` is at most the threshold; there
    are as many cells as milestones times thresholds, each a rank of its own.
    """
    both = scores.select(name, minus_log10(F.col("p")).alias("x")).join(trials.select(name, "milestone", minus_log10(F.col("p")).alias("y")), name)
    marks = [r.milestone for r in trials.select("milestone").distinct().orderBy("milestone").collect()]  # milestones of a test, not rows
    out = None
    for m in marks:
        for t in thresholds:
            cell = both.where((F.col("milestone") == m) & (F.col("x") >= minus_log10(F.lit(t))))
            one = cell.agg(F.count("*").alias("n")).join(spearman(cell, "x", "y")).select(F.lit(m).alias("milestone"), F.lit(t).alias("threshold"), "n", "r")
            out = one if out is None else out.unionByName(one)
    return out


def category_place(category: Column, order: Sequence[str]) -> Column:
    """A sort key: the place of the category in the fixed order, others behind."""
    known = F.array(*[F.lit(c) for c in order])
    at = F.array_position(known, category)
    return F.when(at > 0, at).otherwise(len(order) + 1).cast("int")


def best_similar(sims: DataFrame, n: int | None = None) -> DataFrame:
    """Cosines clamped to [-1, 1], best first; ties by d_sid; the first n of all."""
    d = sims.withColumn("cosine", F.least(F.greatest("cosine", F.lit(-1.0)), F.lit(1.0))).orderBy(F.desc("cosine"), "d_sid")
    return d if n is None else d.limit(n)
