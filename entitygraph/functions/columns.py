"""Column expressions used across operators.

Every function returns a ``Column`` built from built-in functions, so the
expressions stay inside whole-stage code generation.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import (METRICS, OTHER_TYPE, PERCENT_DECIMALS, SIZE_MAX, SIZE_MIN,
                      TYPE_VOCABULARY)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_date(x) -> Column:
    """Text or timestamp to date; malformed text gives null (no ANSI error).

    ``2024-03`` reads as 2024-03-01, like ``to_date``.
    """
    return _c(x).try_cast("date")


def to_number(x) -> Column:
    """A finite double, else 0 (null, NaN, +-Inf, junk text, and text with a
    type suffix such as ``1.5d``, which a cast would accept)."""
    d = _c(x).try_cast("double")
    finite = (d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
              & ~_c(x).cast("string").rlike("[dDfF]\\s*$"))
    return F.when(finite, d).otherwise(F.lit(0.0))


def metric_column(mode: str = "static") -> str:
    """Metric selector: ``temporal`` -> temporal percent, anything else static."""
    return METRICS.get(mode, METRICS["static"])


def percent_of(x, total: Column, decimals: int = PERCENT_DECIMALS) -> Column:
    """``round(x / total * 100, decimals)``; a zero or null total gives 0.0."""
    share = F.try_divide(_c(x), total)
    return F.coalesce(F.round(share * F.lit(100.0), decimals), F.lit(0.0))


def recency_weight_col(last_seen, as_of, half_life_days: float) -> Column:
    """``0.5 ** (age_days / half_life)``; unknown date -> 1.0.

    ``as_of`` is a date/ISO string fixed by the caller (never ``current_date``
    inside a query, so every action of a job sees the same day).
    """
    if isinstance(as_of, (_dt.date, str)):
        as_of = F.lit(str(as_of)).cast("date")
    age = F.datediff(as_of, as_date(last_seen)).cast("double")
    w = F.pow(F.lit(0.5), age / F.lit(float(half_life_days)))
    return F.when(age.isNotNull(), w).otherwise(F.lit(1.0))


def normalise_type(t) -> Column:
    """Known vocabulary lower-cased, anything else ``other``."""
    low = F.lower(_c(t))
    return F.when(low.isin(*TYPE_VOCABULARY), low).otherwise(F.lit(OTHER_TYPE))


def sqrt_scale_col(x, max_value: Column) -> Column:
    """Square-root scale ``[0, max] -> [5, 28]``; a zero/null max counts as 1."""
    m = F.when(max_value.isNull() | (max_value == 0), F.lit(1.0)).otherwise(max_value)
    return F.lit(SIZE_MIN) + F.lit(SIZE_MAX - SIZE_MIN) * F.sqrt(to_number(x) / m)


def percent_text(x) -> Column:
    """Fixed three-decimal percent text, e.g. ``5.529 %`` (rounded half-up
    to 3 decimals first, so the text never depends on binary tie-breaking)."""
    return F.format_string("%.3f %%", F.round(to_number(x), 3))


def display_label(label, id_) -> Column:
    """``label || id`` with empty text treated as missing."""
    return F.coalesce(F.nullif(_c(label), F.lit("")), _c(id_))


def display_type(t) -> Column:
    """``t || '-'`` with empty text treated as missing."""
    return F.coalesce(F.nullif(_c(t), F.lit("")), F.lit("-"))


def edge_key(src="src", dst="dst") -> Column:
    return F.concat_ws("->", _c(src), _c(dst))
