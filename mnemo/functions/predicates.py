"""The dialect's NULL rules and arithmetic as Columns.

Comparisons, AND, OR and NOT are three-valued as in Spark.  Two rules differ from ANSI SQL: NULL items of an IN list are
ignored, and LIKE never gives NULL (a NULL or non-text operand does not match, so NOT LIKE is true for it).  Integer
division truncates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_list(col: Column, values: list, negated: bool = False) -> Column:
    """[NOT] IN over literals; NULL items are ignored, a NULL operand gives NULL."""
    known = [v for v in values if v is not None]
    hit = col.isin(known) if known else F.when(col.isNotNull(), F.lit(False))
    return ~hit if negated else hit


def like(col: Column, pattern: str, negated: bool = False) -> Column:
    """[NOT] LIKE with % and _, case-sensitive, without an escape character; never NULL."""
    hit = F.coalesce(col.like(pattern.replace("\\", "\\\\")), F.lit(False))
    return ~hit if negated else hit


def between(col: Column, low, high, negated: bool = False) -> Column:
    hit = (col >= low) & (col <= high)
    return ~hit if negated else hit


def divide(a: Column, b: Column, integers: bool) -> Column:
    """Truncating for integers, exact otherwise."""
    if integers:
        return F.call_function("div", a, b)
    return a.cast("double") / b.cast("double")


def now_millis() -> Column:
    """NOW() in the unit of all timestamps here, epoch milliseconds, constant within a query."""
    return F.unix_millis(F.current_timestamp())


def order(col: Column, descending: bool = False) -> Column:
    """Sort key with the dialect's placement: NULLs last when ascending, first when descending."""
    return col.desc_nulls_first() if descending else col.asc_nulls_last()
