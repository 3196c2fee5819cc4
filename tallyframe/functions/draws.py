"""Draws of rows by a hash, alike for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def drawn(hashed: Column, wanted: int, rows: int | Column) -> Column:
    """Whether a row of this 64-bit hash is among ``wanted`` of ``rows`` in expectation; all are if there are no more.

    The hash is compared with a share of its range, so that no number of rows overflows.
    """
    share = F.lit(float(wanted)) / (F.greatest(rows, F.lit(1)) if isinstance(rows, Column) else F.lit(float(max(rows, 1))))
    return F.pmod(hashed, F.lit(1 << 32)) < share * F.lit(float(1 << 32))
