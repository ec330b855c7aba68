"""Moments of windowed coverage, and the analytic null built from them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanstat.functions import stats
from spanstat.operators.overlap import overlap_counts
from spanstat.operators.regions import coverage_dot, spikes
from spanstat.schema import BIN, HG38, bins_of

MOMENTS = "sid int, chrom string, n_bins long, l long, slot int, mean double, var double"


def sampled_lengths(n_bins: int) -> list[int]:
    """Every window length to 100, then growing by one percent, below ``n_bins``."""
    out = list(range(1, min(stats.EXACT, n_bins - 1) + 1))
    at = float(out[-1]) if out else float(n_bins)
    while True:
        at *= stats.STEP
        l = math.ceil(at)
        if l > n_bins - 1:
            return out
        if l > out[-1]:
            out.append(l)


def slot_of(l: int) -> int:
    return l - 1 if l <= stats.EXACT else stats.EXACT + int(math.log(l / stats.EXACT) / math.log(stats.STEP)) - 1


def window_moments(g: np.ndarray, lengths: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population variance of the sums of all windows of each length.

    The coverage is taken less its mean; its own autocorrelation, one FFT, gives the
    squares of all windows, those cut by an end included, which are taken off. The
    FFT's error then is relative to the coverage, not to its running sum, which is far
    larger. Windows over half of the chromosome are few, and summed one by one.
    """
    n, mean = len(g), float(g.mean())
    centred = g - mean
    prefix = np.concatenate(([0.0], np.cumsum(centred, dtype=np.longdouble)))
    one = np.concatenate(([0.0], np.cumsum(prefix)))
    prefix = prefix.astype(float)
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(centred, size)
    auto = np.fft.irfft(f.real**2 + f.imag**2, size)[:n]
    auto[1:] *= 2
    every = np.concatenate(([0.0], np.cumsum(np.cumsum(auto))))
    cut = np.concatenate(([0.0], np.cumsum(prefix[1:] ** 2 + (prefix[n] - prefix[n - 1 :: -1]) ** 2)))
    l = np.asarray(lengths, dtype=np.int64)
    w = n - l + 1
    m = (((one[n + 1] - one[l]) - one[w]) / w).astype(float)
    v = (every[l] - cut[l - 1]) / w - m * m
    for i in np.flatnonzero(2 * l > n):
        v[i] = (prefix[l[i] :] - prefix[: w[i]]).var()
    return m + l * mean, np.maximum(v, 0.0)


def moments(df: DataFrame, genome: dict[str, int] = HG38, lengths: Sequence[int] | None = None) -> DataFrame:
    """One row per source, chromosome and sampled window length.

    A group is a source's steps on one chromosome, summed per bin before, so it is
    bounded by the chromosome's bins whatever the number of intervals.
    """
    sizes = {k: bins_of(v) for k, v in genome.items()}
    names = [c.split()[0] for c in MOMENTS.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sid, chrom = int(rows["sid"].iloc[0]), rows["chrom"].iloc[0]
        n = sizes[chrom]
        d = np.zeros(n)
        d[rows["bin"].to_numpy()] = rows["d"].to_numpy()
        ls = [l for l in lengths if l < n] if lengths else sampled_lengths(n)
        mean, var = window_moments(np.cumsum(d) / BIN, ls)
        out = {"sid": sid, "chrom": chrom, "n_bins": n, "l": ls, "slot": [slot_of(l) for l in ls], "mean": mean, "var": var}
        return pd.DataFrame(out, columns=names)

    return spikes(df, genome).groupBy("sid", "chrom").applyInPandas(run, MOMENTS)


def grouped_lengths(df: DataFrame, genome: dict[str, int] = HG38) -> DataFrame:
    """Per sid, chrom and whole-bin length: sums of l/l_int and its square, and rows."""
    l = (F.col("stop") - F.col("start")) / F.lit(float(BIN))
    li = F.greatest(F.ceil(l), F.lit(1)).cast("long")
    d = df.where(F.col("chrom").isin(*genome)).select("sid", "chrom", li.alias("l_int"), (l / li).alias("s"))
    return d.groupBy("sid", "chrom", "l_int").agg(F.sum("s").alias("sum_scale"), F.sum(F.col("s") * F.col("s")).alias("sum_scale2"), F.count("*").alias("n"))


def null_moments(q: DataFrame, store: DataFrame, genome: dict[str, int] = HG38) -> DataFrame:
    """q_sid, d_sid, mu, var and mu_raw of every query set against every source."""
    g = grouped_lengths(q, genome).withColumn("slot", stats.compact_index(F.col("l_int")))
    j = g.withColumnRenamed("sid", "q_sid").join(store.withColumnRenamed("sid", "d_sid"), ["chrom", "slot"]).where("l_int < n_bins")
    return j.groupBy("q_sid", "d_sid").agg(
        F.sum(F.col("mean") * F.col("sum_scale")).alias("mu"),
        F.sum(F.col("var") * F.col("sum_scale2")).alias("var"),
        F.sum(F.col("mean") / F.col("l_int") * F.col("n")).alias("mu_raw"),
    )


def with_scores(df: DataFrame) -> DataFrame:
    mu, var, raw, o = (F.col(c) for c in ("mu", "var", "mu_raw", "observed_bins"))
    return df.withColumn("llr", stats.llr(mu, var, raw, o)).withColumn("p_value", stats.p_value(F.col("llr"), mu, o))


def score(q: DataFrame, d: DataFrame, store: DataFrame, genome: dict[str, int] = HG38) -> DataFrame:
    """Counts, null and p-value of all pairs with an overlap whose source has moments."""
    c = overlap_counts(q, d).withColumn("observed_bins", F.col("overlap_bp") / F.lit(float(BIN)))
    return with_scores(c.join(null_moments(q, store, genome), ["q_sid", "d_sid"]))


def pairwise(a: DataFrame, b: DataFrame, genome: dict[str, int] = HG38, lengths: Sequence[int] | None = None) -> DataFrame:
    """Score of sets ``a`` against sets ``b`` by the product of their coverages."""
    o = coverage_dot(a, b, genome).withColumnRenamed("dot", "observed_bins")
    return with_scores(o.join(null_moments(a, moments(b, genome, lengths) if lengths else moments(b, genome), genome), ["q_sid", "d_sid"]))


def diagnostics(store: DataFrame) -> DataFrame:
    """Per length: upper median of var/mean and the share of overdispersed sources."""
    r = store.where("mean > 1e-10").withColumn("r", F.col("var") / F.col("mean"))
    mid = F.expr("get(sort_array(collect_list(r)), cast(count(r) div 2 as int))")
    return r.groupBy("l").agg(mid.alias("median_ratio"), F.avg((F.col("r") > 1).cast("double")).alias("overdispersed"))
