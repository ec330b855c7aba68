"""Analytic null of overlaps as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slots 0..99 are exact lengths 1..100; beyond, lengths grow by one percent.
EXACT, STEP = 100, 1.01

# Abramowitz and Stegun 7.1.26.
ERFC_P = 0.3275911
ERFC_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def compact_index(l: Column) -> Column:
    """The slot of a window length."""
    far = F.lit(EXACT) + F.floor(F.ln(F.greatest(l, F.lit(1)) / float(EXACT)) / F.ln(F.lit(STEP))) - 1
    return F.when(l <= EXACT, l - 1).otherwise(far).cast("int")


def erfc(x: Column) -> Column:
    """Complementary error function, off by less than 1.5e-7."""
    a = F.abs(x)
    t = 1.0 / (1.0 + ERFC_P * a)
    poly = F.lit(0.0)
    for c in reversed(ERFC_A):
        poly = (poly + c) * t
    y = poly * F.exp(-a * a)
    return F.when(x < 0, 2.0 - y).otherwise(y)


def poisson_llr(mu: Column, o: Column) -> Column:
    return F.when((mu > 0) & (o > 0), o * F.ln(o / mu) - (o - mu))


def nb_llr(mu: Column, var: Column, o: Column) -> Column:
    """Negative-binomial saddlepoint exponent; null where the fit is infeasible."""
    r, p = mu * mu / (var - mu), mu / var
    po = r / (r + o)
    ok = (mu > 0) & (var > mu) & (p > 0) & (p < 1) & (po > 0) & (po < 1)
    return F.when(ok, o * F.ln((1 - po) / (1 - p)) + r * F.ln(po / p))


def llr(mu: Column, var: Column, mu_raw: Column, o: Column) -> Column:
    scale = F.when(mu_raw > 0, mu / mu_raw).otherwise(1.0)
    return F.when(var > mu, nb_llr(mu, var, o)).otherwise(F.when(scale > 0, poisson_llr(mu_raw, o / scale)))


def p_value(llr_: Column, mu: Column, o: Column) -> Column:
    """One-sided tail; 1 where the exponent is null or not positive."""
    tail = erfc(F.sqrt(llr_)) / 2.0
    return F.when(llr_ > 0, F.when(o >= mu, tail).otherwise(1.0 - tail)).otherwise(1.0)


def minus_log10(p: Column, tiny: float = 1e-300) -> Column:
    return -F.log10(F.greatest(p, F.lit(tiny)))
