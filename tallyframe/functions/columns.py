"""Scalar column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str | float) -> Column:
    """Names become columns, numbers become literals."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def safe_ln(x: Column | str) -> Column:
    """Natural log, NULL where it is not defined."""
    x = as_col(x)
    return F.when(x > 0, F.ln(x))


def safe_log10(x: Column | str) -> Column:
    """Log base 10, NULL where it is not defined."""
    x = as_col(x)
    return F.when(x > 0, F.log10(x))


def x_ln_x(x: Column | str) -> Column:
    """x * ln(x), 0 at x = 0: the entropy summand."""
    x = as_col(x)
    return F.when(x > 0, x * F.ln(x)).when(x == 0, F.lit(0.0))


def normalise_name(name: Column | str) -> Column:
    """Every blank of a name becomes an underscore."""
    return F.translate(as_col(name), " ", "_")


def genus_label(genus: Column | str) -> Column:
    """The label of a prey identified to genus only."""
    return F.concat(as_col(genus), F.lit(" sp"))


def genus_of(name: Column | str) -> Column:
    """First word of a name."""
    return F.split_part(as_col(name), F.lit(" "), F.lit(1))


def functional_response(x: Column | str, a: Column | str | float, h: Column | str | float) -> Column:
    """Saturating intake: a*x / (1 + h*a*x)."""
    ax = as_col(a) * as_col(x)
    return ax / (1 + as_col(h) * ax)


def unit_scale(x: Column | str, factor: float = 1e5) -> Column:
    """Convert a rate to the unit of the published rates."""
    return as_col(x) * F.lit(factor)


def flag_count(columns: Sequence[str], mark: str = "X") -> Column:
    """Number of flag columns that carry the mark."""
    total = F.lit(0)
    for name in columns:
        total = total + F.when(F.col(name) == mark, 1).otherwise(0)
    return total
