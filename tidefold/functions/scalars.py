"""Column helpers whose semantics differ from Spark's defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType


def saturating_unsigned(x: Column) -> Column:
    """A float cut to an unsigned 64-bit value: negatives and NaN become 0.

    Results are BIGINT, so values past the signed range stay at its end.
    """
    top = F.lit(9223372036854775807)
    whole = F.when(x >= F.lit(9.2e18), top).otherwise(x.try_cast("bigint"))
    return F.when(F.isnan(x.cast("double")), F.lit(0)).otherwise(F.greatest(F.coalesce(whole, F.lit(0)), F.lit(0)))


def wrapping_u8(x: Column) -> Column:
    """The lowest byte of an integer."""
    return x.bitwiseAND(F.lit(0xFF))


def saturating_sub(a: Column, b: Column) -> Column:
    """``a - b``, 0 at least."""
    return F.greatest(a - b, F.lit(0))


def bucket(ts: Column, width: int) -> Column:
    """The start of the tumbling bucket that an integer time lies in."""
    return ts - F.pmod(ts, F.lit(width))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, in any session zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts)


def same_record(a: Sequence[Column], b: Sequence[Column], schema: StructType) -> Column:
    """Whether two records are equal field by field; NaN equals nothing, null equals null."""
    out = F.lit(True)
    for x, y, field in zip(a, b, schema.fields, strict=True):
        out = out & x.eqNullSafe(y)
        if isinstance(field.dataType, (DoubleType, FloatType)):
            out = out & ~F.coalesce(F.isnan(x), F.lit(False))
    return out
