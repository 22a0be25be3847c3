"""Scalar column helpers (all built-in expressions, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(x: Column, digits: int) -> Column:
    """NumPy-style rounding of the binary value: rint(x * 10^d) / 10^d.

    ``F.round``/``F.bround`` round the decimal expansion instead, which
    differs on values such as 2.675; reports and scores use this form."""
    scale = float(10 ** digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def fmt(x: Column, digits: int) -> Column:
    """Fixed-point text with ``digits`` decimals, rounding half-even first
    so 2.25 renders as 2.2 (as Python/DuckDB ``%.1f`` do)."""
    return F.format_string(f"%.{digits}f", round_half_even(x, digits))


def safe_div(num: Column, den: Column) -> Column:
    """NULL instead of a division-by-zero error (ANSI mode safe)."""
    return F.when(den != 0, num / den)


def py_list_repr(names: Column) -> Column:
    """Render an array<string> like a Python list literal: ['a', 'b']."""
    quoted = F.transform(names, lambda s: F.concat(F.lit("'"), s, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
