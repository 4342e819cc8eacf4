"""Decimal text of doubles, rounded on their exact binary value.

Java's formatter rounds the shortest decimal of a double instead, which gives
another digit when that decimal ends in 5 (0.425 is stored as 0.42499...).
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def two_places(x: Column, ties_up: bool = False) -> Column:
    """Two decimals of a value; see :func:`decimals`."""
    return decimals(x, 2, ties_up)


def decimals(x: Column, places: int, ties_up: bool = False) -> Column:
    """Text with ``places`` decimals, seven at most, as C's printf writes it.

    A value that is exactly halfway goes to the even digit, or away from zero
    with ``ties_up``. From 2 ** 39 units of the last place on (2 ** 32 whole
    ones at two places), the formatter's own rounding stands.
    """
    scale = float(10 ** places)
    size = F.abs(x)
    units = size * scale
    whole = F.floor(units)
    over = units - whole - 0.5
    near_tie = (units < float(1 << 39)) & (F.abs(over) < 1e-3)

    # the product of the leading 26 bits and the scale is exact, and so is that of the rest: what ``units`` lost
    lead = size * 134217729.0 - (size * 134217729.0 - size)
    lost = (lead * scale - units) + (size - lead) * scale
    half = F.lit(True) if ties_up else whole % 2 == 1
    up = (over + lost > 0) | ((over + lost == 0) & half)
    n = whole + F.when(up, 1).otherwise(0)
    exact = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / scale).cast("string"), F.lit("."),
                     F.lpad((n % 10 ** places).cast("string"), places, "0"))
    return F.when(near_tie, exact).otherwise(F.format_string(f"%.{places}f", x))


def on_product(x: Column, places: int) -> Column:
    """A double rounded by its units of the last place, halves away from zero, as SQL's round() of a double does in DuckDB.

    The units may be a half where the shortest decimal is not, or the other way round.
    """
    scale = float(10 ** places)
    return F.round(x * scale) / scale
