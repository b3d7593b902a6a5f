"""Exact money arithmetic.

Money is DECIMAL(12,2), rates DECIMAL(4,4).  Results leave the library as
BIGINT cents so that engines with different decimal widening rules agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
WIDE_MONEY = "decimal(18,2)"
TOTAL_MONEY = "decimal(30,2)"  # running totals and balances of a state
RATE = "decimal(4,4)"


def to_money(c: Column) -> Column:
    return c.cast(MONEY)


def to_rate(c: Column) -> Column:
    return c.cast(RATE)


def round_cents(c: Column) -> Column:
    """HALF_UP to cents, once, at the end of a computation."""
    return F.round(c, 2).cast(WIDE_MONEY)


def cents(c: Column) -> Column:
    """Exact decimal money -> BIGINT cents."""
    return (c * 100).cast("bigint")
