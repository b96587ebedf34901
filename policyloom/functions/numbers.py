"""Rounding that does not depend on the order in which a sum was added up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def settled(value: Column, digits: int) -> Column:
    """Half-up on the binary value, after the noise of summation (past nine places) is taken off."""
    scale = 10**digits
    return F.floor(F.round(value, 9) * scale + 0.5) / scale
