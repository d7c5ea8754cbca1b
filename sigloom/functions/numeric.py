"""Scalar helpers with the conventions of the measurement operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The floor inside logarithms, and the amplitude from which a sample counts as clipped.
EPS = 1e-12
CLIPPED = 0.999969
SILENCE_DB = -45.0


def db(amplitude: Column) -> Column:
    """20 log10; minus infinity where the amplitude is 0 or missing (Spark's own logarithm gives null)."""
    return F.when(amplitude > 0, 20 * F.log10(amplitude)).otherwise(F.lit(float("-inf")))


def power_db(power: Column) -> Column:
    return 10 * F.log10(power + F.lit(EPS))


def rms_db(power: Column) -> Column:
    """Level of a mean square, with the floor added to the amplitude."""
    return 20 * F.log10(F.sqrt(power) + F.lit(EPS))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def first_best(value: Column, score: Column, position: Column) -> Column:
    """Aggregate: the value with the highest score, the first position on ties."""
    return F.max_by(value, F.struct(score.alias("s"), (-position).alias("p")))


def correlation(a: str, b: str) -> Column:
    """Aggregate: Pearson correlation from sums, null where a side doesn't vary."""
    n = F.count("*")
    cov = F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b) / n
    va, vb = F.sum(F.col(a) * F.col(a)) - F.sum(a) * F.sum(a) / n, F.sum(F.col(b) * F.col(b)) - F.sum(b) * F.sum(b) / n
    return F.when((va > 1e-12) & (vb > 1e-12), cov / F.sqrt(va * vb))


def r(x: Column, places: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(x, places) + F.lit(0.0)


def setting_number(raw: Column, default: float) -> Column:
    """A setting's text as a double; the default where it is null, blank or no decimal number."""
    text = F.trim(raw)
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double")).otherwise(F.lit(float(default)))


def setting_whole(raw: Column, default: int) -> Column:
    """A setting's number without its fraction."""
    return setting_number(raw, default).cast("long")


def setting_flag(raw: Column, default: bool) -> Column:
    """True for 1, true, yes and on in any case, false for other text, the default where it is null or blank."""
    text = F.lower(F.trim(raw))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(default)).otherwise(text.isin("1", "true", "yes", "on"))


def setting_text(raw: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(raw), F.lit("")), F.lit(default))
