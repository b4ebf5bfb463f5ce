"""Column-expression helpers shared by operators (all built-in functions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.schema import DEFAULTS, UNIFIED_FIELDS


def micros_between(start: Column, end: Column) -> Column:
    """end − start in microseconds (NTZ-safe, no time-zone dependence)."""
    return F.timestamp_diff("MICROSECOND", start, end)


def seconds_between(start: Column, end: Column) -> Column:
    return micros_between(start, end).cast("double") / F.lit(1e6)


def align_to_unified(df: DataFrame, fill_defaults: bool = True) -> DataFrame:
    """Add missing unified columns with their defaults, order, drop extras."""
    cols = []
    present = set(df.columns)
    for name, dtype in UNIFIED_FIELDS:
        if name in present:
            cols.append(F.col(name).cast(dtype).alias(name))
        elif isinstance(dtype, T.TimestampNTZType) or not fill_defaults:
            cols.append(F.lit(None).cast(dtype).alias(name))
        else:
            cols.append(F.lit(DEFAULTS[type(dtype)()]).cast(dtype).alias(name))
    return df.select(*cols)


# Presentation rounding for oracle comparison: 6 decimals below 1e3, 9
# significant digits from 1e3 to 1e12, unchanged above.  Written as a CASE
# ladder over literal powers of ten so that the DuckDB twin
# (``sql_fragments.r6``) performs the very same IEEE operations.
ROUND_LADDER = [(1e3, 1e6, True), (1e4, 1e5, True), (1e5, 1e4, True), (1e6, 1e3, True),
                (1e7, 1e2, True), (1e8, 1e1, True), (1e9, 1.0, True), (1e10, 1e1, False),
                (1e11, 1e2, False), (1e12, 1e3, False)]


def _ladder_pick(ax: Column, mul: bool) -> Column:
    """The ladder's scale for |x| (multiplier arms or divisor arms)."""
    expr = None
    for bound, p, m in ROUND_LADDER:
        if m != mul:
            continue
        expr = F.when(ax < F.lit(bound), F.lit(p)) if expr is None else expr.when(ax < F.lit(bound), F.lit(p))
    return expr


def round6(c: Column, digits: int = 6) -> Column:
    """Deterministic rounding used only to present results for comparison.
    Same IEEE operations as the ladder: floor(x·p + ½)/p for the multiplier
    arms, floor(x/p + ½)·p for the divisor arms (one floor each, so the
    generated code stays small)."""
    ax = F.abs(c)
    last_mul = max(b for b, _, m in ROUND_LADDER if m)
    last = max(b for b, _, _ in ROUND_LADDER)
    pm, pd_ = _ladder_pick(ax, True), _ladder_pick(ax, False)
    return (F.when(ax < F.lit(last_mul), (F.floor(c * pm + F.lit(0.5)) / pm).cast("double"))
             .when(ax < F.lit(last), (F.floor(c / pd_ + F.lit(0.5)) * pd_).cast("double"))
             .otherwise(c.cast("double")))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (used for oracle comparison only)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(round6(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """M1: numeric (non-boolean) columns of a frame, in order."""
    num = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, num) and f.name not in exclude]


def col(name: str) -> Column:
    """Column reference that tolerates names starting with a digit."""
    return F.col(f"`{name}`")
