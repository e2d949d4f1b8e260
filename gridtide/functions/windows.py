"""Window expressions; `w` is the order window of a series (or of one of its blocks)."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lag(c, w: WindowSpec, k: int = 1) -> Column:
    return F.lag(col(c), k).over(w)


def lead(c, w: WindowSpec, k: int = 1) -> Column:
    return F.lead(col(c), k).over(w)


def difference(c, w: WindowSpec, k: int = 1) -> Column:
    return col(c) - lag(c, w, k)


def relative_change(c, w: WindowSpec, k: int = 1) -> Column:
    """Change over k rows; NULL where the earlier value is zero."""
    return F.try_divide(col(c), lag(c, w, k)) - 1


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(1 - n, 0)


def rolling_mean(c, w: WindowSpec, n: int) -> Column:
    return F.avg(col(c)).over(last_rows(w, n))


def rolling_std(c, w: WindowSpec, n: int) -> Column:
    return F.stddev_samp(col(c)).over(last_rows(w, n))


def full_only(value: Column, c, frame: WindowSpec, n: int) -> Column:
    """`value` where the frame holds n non-null values of c, else NULL."""
    return F.when(F.count(col(c)).over(frame) == n, value)


def range_position(c, w: WindowSpec, n: int) -> Column:
    """Place of the value between the lowest and highest of the last n rows."""
    low, high = F.min(col(c)).over(last_rows(w, n)), F.max(col(c)).over(last_rows(w, n))
    return F.when(high - low > 0, (col(c) - low) / (high - low)).otherwise(F.lit(0.5))


def rolling_slope(c, w: WindowSpec, n: int, place: str = "idx") -> Column:
    """Least-squares slope of the value against its position over the last n rows."""
    frame = last_rows(w, n)
    return full_only(F.regr_slope(col(c), F.col(place).cast("double")).over(frame), c, frame, n)


def sorted_values(c, w: WindowSpec, n: int) -> Column:
    """The values of the last n rows in rising order, fewer where some are missing."""
    return F.sort_array(F.collect_list(col(c)).over(last_rows(w, n)))  # at most n values


def percentiles_of(values: str, n: int, low: float, high: float) -> Column:
    """Array of two interpolated percentiles of a column of n sorted values, NULL where it has fewer.

    The values are a column of their own: an expression of a window would be collected again for each use.
    """
    def at(percent: float) -> Column:
        place = percent / 100.0 * (n - 1)
        below = int(place)
        under, over = F.get(values, F.lit(below)), F.get(values, F.lit(min(below + 1, n - 1)))
        return under + (over - under) * F.lit(place - below)

    return F.when(F.size(values) == n, F.array(at(low), at(high)))
