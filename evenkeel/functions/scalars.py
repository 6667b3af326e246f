"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

SEED = 42
DRAW_SPACE = 1 << 60


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str) -> Column:
    """Double, or NULL where the text is no number; NaN counts as missing."""
    x = as_column(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def safe_ratio(num: Column, den: Column) -> Column:
    return num / F.nullif(den, F.lit(0).cast("double"))


def draw(seed: int | Column, *keys: Column | str) -> Column:
    """Seeded uniform integer in [0, 2^60) that depends only on the keys.

    md5 keeps it the same in any engine and under any partitioning.
    """
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws("|", head.cast("string"), *[as_column(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def unit_draw(seed: int | Column, *keys: Column | str) -> Column:
    return draw(seed, *keys) / F.lit(float(DRAW_SPACE))


def is_near_integer(v: Column) -> Column:
    """Relative-tolerance test, so 100000.5 passes (kept on purpose)."""
    r = F.bround(v)
    return F.abs(v - r) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(r)


def nearest_of(x: Column, values: list[float]) -> Column:
    """Nearest listed value, the lower one on a tie; NULL stays NULL."""
    options = F.array(*[F.lit(float(v)) for v in values])
    best = F.array_min(F.transform(options, lambda v: F.struct(F.abs(v - x).alias("d"), v.alias("v"))))
    return F.when(x.isNotNull(), best["v"])


def digamma(n: Column) -> Column:
    """psi(n) for n >= 1: shift by six, then the asymptotic series."""
    x = n.cast("double")
    shift = sum((1.0 / (x + i) for i in range(1, 6)), 1.0 / x)
    z = x + 6.0
    inv2 = 1.0 / (z * z)
    series = inv2 * (1 / 12.0 - inv2 * (1 / 120.0 - inv2 * (1 / 252.0 - inv2 / 240.0)))
    return F.log(z) - 0.5 / z - series - shift


def kind_of(dtype: T.DataType) -> str:
    """numeric, boolean, text, time or other."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "other"


def epoch_seconds(field: T.StructField) -> Column:
    """Seconds since 1970; a time without zone is taken as it reads, whatever the session's zone."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.TimestampType):
        return F.unix_micros(c) / 1e6
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, c.cast("timestamp_ntz")) / 1e6


def missing(field: T.StructField) -> Column:
    """NULL, or NaN in a floating column."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()
