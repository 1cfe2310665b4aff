"""Window expressions that state machines are made of: run lengths, latches, last values."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY, ORDER = "signal_id", "scan_ord"


def by_signal(key: str | list[str] = KEY, order: str = ORDER) -> WindowSpec:
    """Rows of a key in scan order: the one window that all per-signal operators share."""
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the ``n - 1`` before it."""
    return w.rowsBetween(-(n - 1), 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def run_length(predicate: Column, w: WindowSpec) -> Column:
    """How many rows up to this one satisfy ``predicate`` without a break."""
    n = F.row_number().over(w)
    broken = F.max(F.when(~F.coalesce(predicate, F.lit(False)), F.struct(n.alias("n")))).over(so_far(w))
    return n - F.coalesce(broken["n"], F.lit(0))


def run_length_of(predicate: str, ordinal: str, w: WindowSpec) -> Column:
    """``run_length`` over columns: a boolean and the row's number in its key."""
    broken = F.max(F.when(~F.coalesce(F.col(predicate), F.lit(False)), F.col(ordinal))).over(so_far(w))
    return F.col(ordinal) - F.coalesce(broken, F.lit(0))


def latch(on: Column, off: Column, w: WindowSpec) -> Column:
    """True from a row where ``on`` holds until one where ``off`` does (``on`` wins)."""
    return F.coalesce(F.last(F.when(on, True).when(off, False), ignorenulls=True).over(so_far(w)), F.lit(False))
