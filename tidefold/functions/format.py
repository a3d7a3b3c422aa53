"""Text forms of numbers and durations."""

from __future__ import annotations


def format_number(x: float) -> str:
    """Below a thousand as it is (two decimals if not whole), else k, m, b or t with two."""
    if x < 1000:
        return str(int(x)) if float(x).is_integer() else f"{x:.2f}"
    for limit, unit in ((1e6, "k"), (1e9, "m"), (1e12, "b")):
        if x < limit:
            return f"{x / limit * 1000:.2f}{unit}"
    return f"{x / 1e12:.2f}t"


def format_duration(ns: float) -> str:
    """ns, us and ms with one decimal, s with two."""
    if ns < 1e3:
        return f"{ns:.1f}ns"
    if ns < 1e6:
        return f"{ns / 1e3:.1f}us"
    return f"{ns / 1e6:.1f}ms" if ns < 1e9 else f"{ns / 1e9:.2f}s"
