"""De-duplication, filters, type profile, resampling and gap filling."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loadweave.functions.numeric import safe_ratio
from loadweave.functions.timeparts import NTZ, first_parsed, slot
from loadweave.operators.quantiles import exact_quantiles
from loadweave.operators.series import fill_gaps

# Fixed list: columns a profile does not need, as spelled after lower-casing.
DROP_CANDIDATES = (
    "ref",
    "row",
    "quarter",
    "aggregate_year",
    "aggregate_month",
    "aggregate_day",
    "aggregate_hour",
    "period_over_which_rainfall_was_measured_days",
    "days_of_accumulation_of_maximum_temperature",
    "days_of_accumulation_of_minimum_temperature",
)

AGGREGATES = {
    "mean": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
}


def _combine(df: DataFrame, keys: Sequence[str], how: str, y: str) -> DataFrame:
    if how == "median":
        return exact_quantiles(df, keys, y, {y: 0.5})
    return df.groupBy(*keys).agg(AGGREGATES[how](y).alias(y))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order``.

    An aggregate, not a window: copies of one key are combined before the
    shuffle, so a key that fills a third of the table costs one row per task.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def drop_known(df: DataFrame, protect: Iterable[str] = ()) -> DataFrame:
    """Drop the known bookkeeping columns that are not protected."""
    kept = {c.lower() for c in protect if c}
    return df.drop(*[c for c in df.columns if c.lower() in DROP_CANDIDATES and c.lower() not in kept])


def numeric_only(df: DataFrame, protect: Iterable[str] = ()) -> DataFrame:
    """Keep numeric and boolean columns plus the protected ones."""
    keep = set(protect)
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    return df.select(*[c for c, t in df.dtypes if c in keep or t in numeric or t.startswith("decimal")])


def select_meters(df: DataFrame, meters: Sequence[str], id_col: str = "id", check: bool = False) -> DataFrame:
    """Keep the named meters; with ``check`` an empty result is an error."""
    chosen = df.where(F.col(id_col).cast("string").isin([str(m) for m in meters]))
    if check and chosen.isEmpty():
        raise ValueError(f"No rows for meters {list(meters)}")
    return chosen


def exclude_meters(df: DataFrame, meters: Sequence[str], id_col: str = "id") -> DataFrame:
    return df.where(~F.col(id_col).cast("string").isin([str(m) for m in meters])) if meters else df


def exclude_listed(df: DataFrame, listed: DataFrame, id_col: str = "id") -> DataFrame:
    """Anti join against a table of ids, for lists too long for a literal."""
    return df.join(listed.select(id_col), id_col, "left_anti")


def require_one_series(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Return ``df`` if it holds exactly one meter, else raise."""
    first_two = df.select(id_col).distinct().limit(2).count()
    if first_two != 1:
        raise ValueError("Expected exactly one meter in the data.")
    return df


def until(df: DataFrame, focus: str, ts: str = "ts") -> DataFrame:
    """Rows up to a focus time, which must be present in the data."""
    moment = F.lit(focus).cast(NTZ)
    seen = df.agg(F.max(ts).alias("last"), F.bool_or(F.col(ts) == moment).alias("hit")).select(
        (moment > F.col("last")).alias("beyond"), "hit"
    ).first()
    if seen.beyond is None or seen.beyond:
        raise ValueError(f"The focus time {focus} lies after the last reading.")
    if not seen.hit:
        raise ValueError(f"There is no reading at the focus time {focus}.")
    return df.where(F.col(ts) <= moment)


DATE_FORMATS = (None, "d/M/yyyy H:mm", "d/M/yyyy")

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def type_profile(
    df: DataFrame, threshold: float = 0.9, date_formats: Sequence[str | None] = DATE_FORMATS
) -> DataFrame:
    """Per text or number column: shares that parse as number or date, and the
    type to cast to, from one pass.

    Text named like a date is tried as a date first. Text that is mostly
    numeric becomes an integer if all whole, else a double; a column of zeros
    and ones becomes a boolean; short or repetitive text is a category.
    """
    kinds = {c: t for c, t in df.dtypes if t == "string" or t in _NUMERIC}
    aggs: list[Column] = [F.count("*").alias("rows")]
    for c, kind in kinds.items():
        number = F.expr(f"try_cast(`{c}` AS double)")
        aggs += [
            F.count(number).alias(f"{c}__numeric"),
            F.bool_and(F.try_mod(number, F.lit(1.0)) == 0).alias(f"{c}__whole"),
            F.bool_and(number.isin(0.0, 1.0)).alias(f"{c}__binary"),
        ]
        if kind == "string":
            aggs += [
                F.count(first_parsed(F.col(c), date_formats)).alias(f"{c}__date"),
                F.approx_count_distinct(c).alias(f"{c}__distinct"),
            ]

    def verdict(c: str, kind: str) -> Column:
        rows = F.col("rows")
        if kind != "string":
            return F.when(F.col(f"{c}__binary"), "boolean").otherwise(kind)
        mostly_number = safe_ratio(F.col(f"{c}__numeric"), rows) > threshold
        dated = F.lit("date" in c.lower() or "timestamp" in c.lower()) & (safe_ratio(F.col(f"{c}__date"), rows) > threshold)
        few = (F.col(f"{c}__distinct") < 50) | (safe_ratio(F.col(f"{c}__distinct"), rows) < 0.5)
        return (
            F.when(dated, "timestamp")
            .when(mostly_number & F.col(f"{c}__binary"), "boolean")
            .when(mostly_number & F.col(f"{c}__whole"), "bigint")
            .when(mostly_number, "double")
            .when(few, "category")
            .otherwise("string")
        )

    parts = [
        F.struct(
            F.lit(c).alias("column"),
            safe_ratio(F.col(f"{c}__numeric"), F.col("rows")).alias("numeric_share"),
            (safe_ratio(F.col(f"{c}__date"), F.col("rows")) if kind == "string" else F.lit(0.0)).alias("date_share"),
            verdict(c, kind).alias("target_type"),
        )
        for c, kind in kinds.items()
    ]
    return df.agg(*aggs).select(F.inline(F.array(*parts)))


def apply_types(
    df: DataFrame, types: dict[str, str], date_formats: Sequence[str | None] = DATE_FORMATS
) -> DataFrame:
    """Cast the named columns; text that does not parse becomes null."""
    out = {}
    for c, t in types.items():
        if t == "timestamp":
            out[c] = first_parsed(F.col(c), date_formats)
        elif t == "boolean":
            out[c] = F.expr(f"try_cast(`{c}` AS double)") == 1
        elif t in ("bigint", "double"):
            out[c] = F.expr(f"try_cast(try_cast(`{c}` AS double) AS {t})")
    return df.withColumns(out) if out else df


def resample(
    df: DataFrame, unit: str, how: str = "sum", keys: Sequence[str] = ("id",), ts: str = "ts", y: str = "y"
) -> DataFrame:
    """One row per (meter, time slot); partial sums are combined map-side."""
    return _combine(df.select(*keys, slot(ts, unit).alias(ts), y), [*keys, ts], how, y)


def across_meters(df: DataFrame, how: str = "mean", ts: str = "ts", y: str = "y") -> DataFrame:
    """One community series: the meters' values combined per timestamp."""
    return _combine(df, [ts], how, y)


def time_spine(df: DataFrame, interval: str, keys: Sequence[str] = ("id",), ts: str = "ts") -> DataFrame:
    """Every slot between a meter's first and last reading.

    Generated in stretches of a thousand slots, so that no row ever carries a
    whole history however fine the interval; months and years are few and are
    generated in one go.
    """
    step = f"INTERVAL {interval}"
    ends = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    if interval.strip().upper().rstrip("S").endswith(("MONTH", "YEAR", "QUARTER")):
        return ends.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(step))).alias(ts))
    stretches = ends.select(*keys, "_hi", F.explode(F.expr(f"sequence(_lo, _hi, {step} * 1000)")).alias("_s"))
    slots = F.expr(f"sequence(_s, least(_s + {step} * 999, _hi), {step})")
    return stretches.select(*keys, F.explode(slots).alias(ts))


def regularise(df: DataFrame, interval: str, keys: Sequence[str] = ("id",), ts: str = "ts") -> DataFrame:
    """Fill missing slots with rows whose values are null."""
    return time_spine(df, interval, keys, ts).join(df, [*keys, ts], "left")


def align_exogenous(
    spine: DataFrame,
    exog: DataFrame,
    expected: Sequence[str],
    keys: Sequence[str] = ("id",),
    ts: str = "ts",
    grain: str | None = None,
) -> DataFrame:
    """Exogenous columns on the spine's rows, filled both ways; absent ones are 0."""
    present = [c for c in expected if c in exog.columns]
    joined = spine.join(exog.select(*keys, ts, *present), [*keys, ts], "left")
    filled = fill_gaps(joined, keys, ts, present, grain, default=0.0) if present else joined
    return filled.withColumns({c: F.lit(0.0) for c in expected if c not in present})
