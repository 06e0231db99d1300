"""Scalar statistics as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1024 * 1024
SUMMARY_PROBS = (0.25, 0.5, 0.75)


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, NULL on a zero denominator."""
    return F.when(denominator != 0, numerator / denominator)


def runtime_ratio(selected: Column, best: Column) -> Column:
    return selected / best


def normalized_regret(selected: Column, best: Column) -> Column:
    """``(selected - best) / best``; the plain ratio is :func:`runtime_ratio`."""
    return (selected - best) / best


def mib(bytes_: Column) -> Column:
    return bytes_ / F.lit(float(MIB))


def us(nanoseconds: Column) -> Column:
    return nanoseconds / F.lit(1e3)


def pct(fraction: Column) -> Column:
    return fraction * F.lit(100.0)


def geomean(value: Column) -> Column:
    """Geometric mean aggregate of positive values."""
    return F.exp(F.avg(F.ln(value)))


def close(a: Column, b: Column, rel: float, abs_: float = 0.0) -> Column:
    """Symmetric closeness: ``|a-b| <= max(rel*max(|a|,|b|), abs)``."""
    bound = F.lit(rel) * F.greatest(F.abs(a), F.abs(b))
    return F.abs(a - b) <= F.greatest(bound, F.lit(abs_))


def relative_error(a: Column, b: Column, kind: str) -> Column:
    """Three named definitions that must not be mixed.

    ``reference``: against ``b`` with a 1e-300 floor; ``symmetric``: against the
    larger magnitude, zero when both are zero; ``floored``: symmetric with floor.
    """
    diff = F.abs(a - b)
    larger = F.greatest(F.abs(a), F.abs(b))
    if kind == "reference":
        return diff / F.greatest(F.abs(b), F.lit(1e-300))
    if kind == "symmetric":
        return F.when(larger == 0, F.lit(0.0)).otherwise(diff / larger)
    if kind == "floored":
        return diff / F.greatest(larger, F.lit(1e-300))
    raise ValueError(f"unknown relative error kind {kind!r}")


def finite(value: Column) -> Column:
    """True for a non-NULL, non-NaN, finite number."""
    number = value.cast("double")
    return F.coalesce(
        ~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), F.lit(False)
    )


def is_true(value: Column) -> Column:
    """Strict test: NULL is not true."""
    return F.coalesce(value, F.lit(False))


def is_false(value: Column) -> Column:
    """Strict test: NULL is not false."""
    return F.coalesce(~value, F.lit(False))
