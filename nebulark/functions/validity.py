"""Which samples count: four rules that operators choose between, never mixed.

Nulls are invalid under every rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values up to this are padding.
PADDING = 1e-7


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def valid(x: Column | str) -> Column:
    """Finite and beyond padding: statistics, histograms, stretches."""
    return finite(x) & (col(x) > PADDING)


def nonzero(x: Column | str) -> Column:
    """Finite and not 0: collapsing whole cubes."""
    return finite(x) & (col(x) != 0)


def positive(x: Column | str) -> Column:
    """Finite and above 0: flats, backgrounds, masked medians."""
    return finite(x) & (col(x) > 0)
