"""Row filters and corrections that the comparison of results uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SIZE = 190
#: The least positive normal double, as a floor under p-values.
TINY = 2.2250738585072014e-308


def min_size(df: DataFrame, size: int = MIN_SIZE) -> DataFrame:
    """Intervals of ``size`` base pairs or more."""
    return df.where(F.col("stop") - F.col("start") >= size)


def normal_chromosomes(df: DataFrame) -> DataFrame:
    """Rows on chromosomes named by a number, X or Y (anything may follow)."""
    return df.where(F.col("chrom").rlike("^chr[0-9XY]+"))


def significant(df: DataFrame, p: str, most: float) -> DataFrame:
    """Rows with a p-value of ``most`` or less, compared as -log10 with a floor."""
    return df.where(-F.log10(F.greatest(F.col(p), F.lit(TINY))) >= -F.log10(F.greatest(F.lit(most), F.lit(TINY))))


def directed(p: Column, alternative: Column) -> Column:
    """The one-sided p-value of more overlap: 1 - p where the test was for less."""
    return F.greatest(F.when(alternative == "l", 1 - p).otherwise(p), F.lit(TINY))
