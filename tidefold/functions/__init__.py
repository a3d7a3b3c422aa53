"""Scalar helpers: conversions, equality and formatting."""

from tidefold.functions.format import format_duration, format_number
from tidefold.functions.scalars import (
    bucket,
    micros,
    saturating_sub,
    saturating_unsigned,
    same_record,
    wrapping_u8,
)

__all__ = [
    "bucket",
    "format_duration",
    "format_number",
    "micros",
    "same_record",
    "saturating_sub",
    "saturating_unsigned",
    "wrapping_u8",
]
