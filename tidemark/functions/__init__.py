"""Column functions: rounding, safe division, time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From here on a double has no eighth decimal left to round; floor() would saturate.
_WHOLE = float(2**53) / 1e8


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_away(x: Column | str, places: int = 8) -> Column:
    """Round half away from zero on the binary value, as floor(x * 10**places + 0.5) does; not F.round's shortest decimal."""
    x, scale = _column(x), float(10**places)
    up = F.floor(F.abs(x) * scale + 0.5) / scale
    return F.when(F.isnan(x) | (F.abs(x) >= _WHOLE), x).otherwise(F.signum(x) * up + 0.0)


def r8(x: Column | str) -> Column:
    """The rounding of every reported figure."""
    return round_half_away(x, 8)


def product_of(rows: DataFrame) -> list[Column]:
    """The product of a report, for an aggregate of its rows; none where the rows don't name it."""
    return [F.min("product").alias("product")] if "product" in rows.columns else []


def named(rows: DataFrame) -> list[str]:
    """["product"] where product_of() has given one."""
    return ["product"] if "product" in rows.columns else []


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero."""
    a, b = _column(a), _column(b)
    return F.when(b != 0, a / b)


def bucket_of(ts: Column | str, bucket_ns: int) -> Column:
    """Start of the time bucket, floored for negative times too."""
    ts = _column(ts)
    return ts - F.pmod(ts, F.lit(bucket_ns))


def round_report(df: DataFrame, places: int = 6) -> DataFrame:
    """Round all double columns of a flat report."""
    return df.select(*[round_half_away(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def require(df: DataFrame, checks: dict[str, Column]) -> None:
    """Raise ValueError with the first message whose violation occurs; one aggregate for all checks."""
    row = df.agg(*[F.count(F.when(c, 1)).alias(f"c{i}") for i, c in enumerate(checks.values())]).first()
    for n, message in zip(row, checks):
        if n:
            raise ValueError(message)


def check_grid(values: list[float], name: str, least: int = 2, low: float | None = 0.0, high: float | None = None, low_open: bool = True) -> list[float]:
    """A strictly increasing grid of numbers in range."""
    values = [float(v) for v in values]
    if len(values) < least:
        raise ValueError(f"{name} needs at least {least} values")
    if any(v != v or v in (float("inf"), float("-inf")) for v in values):
        raise ValueError(f"{name} must be finite")
    if low is not None and any(v < low or low_open and v == low for v in values) or high is not None and any(v > high for v in values):
        raise ValueError(f"{name} is out of range")
    if any(b <= a for a, b in zip(values, values[1:])):
        raise ValueError(f"{name} must be strictly increasing")
    return values
