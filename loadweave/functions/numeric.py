"""Safe numeric columns: ratios, logs, scaling, keys of the same order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Division that yields null instead of an error or an infinity."""
    return F.try_divide(top, bottom)


def finite(value: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def log_forward(value: Column) -> Column:
    """log1p of the value floored at zero."""
    return F.log1p(F.greatest(value, F.lit(0.0)))


def log_inverse(value: Column) -> Column:
    return F.expm1(value)


def standardise(value: Column, mean: Column, std: Column) -> Column:
    """Z-score; a zero or missing spread counts as one."""
    return (value - mean) / F.coalesce(F.nullif(finite(std), F.lit(0.0)), F.lit(1.0))


def destandardise(value: Column, mean: Column, std: Column) -> Column:
    return value * F.coalesce(F.nullif(finite(std), F.lit(0.0)), F.lit(1.0)) + mean


def order_key(value: Column) -> Column:
    """Whole number of 64 bits that orders as the double does; equal doubles, and both zeros, have equal keys.

    The number is the IEEE 754 pattern of the magnitude, negated below zero,
    put together from exponent and fraction: scaling by a power of two is exact,
    so no bit is lost. NaN and null give null. One expression that repeats its
    steps many times over: for whole tables use ``with_order_key``.
    """
    size = F.abs(value)
    guess = _guess(size)
    scaled = _scaled(size, guess)
    return _order_bits(value, size, guess, scaled)


def with_order_key(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with ``order_key`` of a column, every step a column of its own that is worked out once per row."""
    steps = df.withColumn("_size", F.abs(F.col(value)))
    steps = steps.withColumn("_guess", _guess(F.col("_size")))
    steps = steps.withColumn("_scaled", _scaled(F.col("_size"), F.col("_guess")))
    bits = _order_bits(*[F.col(c) for c in (value, "_size", "_guess", "_scaled")])
    return steps.withColumn(name, bits).drop("_size", "_guess", "_scaled")


def _guess(size: Column) -> Column:
    """Exponent of a magnitude, at most one off."""
    least = F.lit(2.0**-1022)  # below, numbers share the smallest exponent
    guess = F.floor(F.log2(F.greatest(F.least(size, F.lit(1.7976931348623157e308)), least)))
    return F.least(F.greatest(guess, F.lit(-1022)), F.lit(1023)).cast("int")


def _scaled(size: Column, guess: Column) -> Column:
    return F.when(guess < 0, size * F.pow(F.lit(2.0), -guess)).otherwise(size / F.pow(F.lit(2.0), guess))


def _order_bits(value: Column, size: Column, guess: Column, scaled: Column) -> Column:
    over, under = scaled >= 2, (scaled < 1) & (guess > -1022)  # the logarithm was rounded across a power of two
    exponent = guess + F.when(over, 1).when(under, -1).otherwise(0)
    fraction = F.when(over, scaled / 2).when(under, scaled * 2).otherwise(scaled) - 1
    unit = 1 << 52
    bits = (exponent + 1023).cast("long") * F.lit(unit) + (fraction * float(unit)).cast("long")
    bits = F.when(size == float("inf"), F.lit(2047 * unit)).otherwise(bits)
    return F.when(value.isNotNull() & ~F.isnan(value), F.when(value < 0, -bits).otherwise(bits))
