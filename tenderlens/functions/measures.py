"""Derived measures (P7-P17) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MILLION, BILLION = 1e6, 1e9


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def share_pct(part, total, digits: int | None = 2) -> Column:
    """part / total * 100, null when part is null or zero or total is not positive."""
    part, total = _column(part), _column(total)
    share = F.try_divide(part, total) * 100
    return F.when((part != 0) & (total > 0), share if digits is None else F.round(share, digits))


def spread(high, low) -> Column:
    return _column(high) - _column(low)


def fed_total(fima, soma) -> Column:
    return F.coalesce(_column(fima), F.lit(0.0)) + F.coalesce(_column(soma), F.lit(0.0))


def approx_tendered(accepted, btc, digits: int = 2) -> Column:
    return F.round(_column(accepted) * _column(btc), digits)


def btc_ratio(tendered, accepted) -> Column:
    return F.try_divide(_column(tendered).cast("double"), F.nullif(_column(accepted), F.lit(0)).cast("double"))


def auction_status(btc) -> Column:
    return F.when(_column(btc).isNull(), "PENDING").otherwise("RESULTS")


def correlation_strength(r) -> Column:
    size = F.abs(_column(r))
    return F.when(size > 0.5, "Strong").when(size > 0.3, "Moderate").otherwise("Weak")


def correlation_direction(r) -> Column:
    return F.when(_column(r) > 0, "Positive").otherwise("Negative")


def scaled(c, unit: float) -> Column:
    return _column(c) / F.lit(unit)


def mean_of(c) -> Column:
    return F.avg(_column(c).cast("double"))


def total_of(c) -> Column:
    """Sum that is 0, not null, over all-null input (the data-frame convention)."""
    return F.coalesce(F.sum(_column(c).cast("double")), F.lit(0.0))


def pair_correlation(x, y) -> Column:
    """Pearson r over rows where both are present; null for constant input or fewer than 2 rows."""
    x, y = _column(x).cast("double"), _column(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def pair_count(x, y) -> Column:
    return F.count(F.when(_column(x).isNotNull() & _column(y).isNotNull(), 1))
