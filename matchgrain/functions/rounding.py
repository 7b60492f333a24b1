"""Rounding of doubles to decimal places by their exact value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchgrain.functions.columns import once


def exact_round(x: Column, places: int) -> Column:
    """x to so many places: the nearest by the exact value of the double, ties to the even digit.

    Spark's own rounding takes the shortest decimal text of a double for its value, so that 2.675, which is a little
    less, rounds up. Here the value is cut into two halves of its bits, whose products with the scale are exact, and their
    sum has the right sign of the distance to the tie. Values are below 2**40; null stays null.
    """
    scale = 10**places

    def of(v: Column) -> Column:
        wide = v * 134217729.0
        high = wide - (wide - v)
        low = v - high
        down = F.floor(v * scale).cast("double")
        side = (high * (2.0 * scale) - (down * 2 + 1)) + low * (2.0 * scale)
        return (F.when((side > 0) | ((side == 0) & (down % 2 != 0)), down + 1).otherwise(down)) / float(scale)

    return once(x.cast("double"), of)
