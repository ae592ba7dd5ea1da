"""What a trade costs, as expressions of a position's size (a weight): shared by the simulation and by queries of costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantloom.params import YEAR, Params


def explicit(size: Column, p: Params) -> Column:
    """Commission and spread of both legs, once."""
    return 2 * p.cost_bps / 1e4 * size


def impact(size: Column, factor: Column) -> Column:
    """Square-root market impact; factor: see signals.impact_factor."""
    return F.sqrt(size) * factor


def borrow(size: Column, p: Params) -> Column:
    """A day's fee of the short leg."""
    return F.lit(p.borrow_apr_bps / 1e4 / YEAR) * F.abs(size)
