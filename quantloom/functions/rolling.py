"""Window expressions with the null rules of rolling statistics, and a `let` for expressions used more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(w: WindowSpec, n: int, lag: int = 0) -> WindowSpec:
    """The n rows that end `lag` rows before the current one."""
    return w.rowsBetween(-(n - 1) - lag, -lag)


def gated(agg: Column, over: WindowSpec, n: int, *needed: Column | str) -> Column:
    """agg over the frame, null unless all of `needed` are present in n rows of it (Spark's aggregates skip nulls)."""
    ok = None
    for c in needed:
        each = F.count(c).over(over) >= n
        ok = each if ok is None else ok & each
    return F.when(ok, agg.over(over))


def rolling_mean(x: str, w: WindowSpec, n: int, lag: int = 0, least: int | None = None) -> Column:
    return gated(F.avg(x), trailing(w, n, lag), least or n, x)


def rolling_std(x: str, w: WindowSpec, n: int, lag: int = 0, least: int | None = None) -> Column:
    """Sample deviation; an exact 0 is missing."""
    return F.nullif(gated(F.stddev_samp(x), trailing(w, n, lag), least or n, x), F.lit(0.0))


def guarded_corr(x: str, y: str, over: WindowSpec) -> Column:
    """Correlation, null where a side is constant (the built-in one raises there under ANSI)."""
    spread = F.stddev_pop(x).over(over) * F.stddev_pop(y).over(over)
    return F.try_divide(F.covar_pop(x, y).over(over), F.nullif(spread, F.lit(0.0)))


def finite(x: Column) -> Column:
    """x, or null where it is not a number or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: an inlined expression would be repeated wherever it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rounded(x: Column, digits: int) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)
