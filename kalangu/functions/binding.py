"""Bind a value once inside a column expression."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(fn: Callable[..., Column], *values: Column) -> Column:
    """``fn`` of the values, each computed once per row.

    Array functions evaluate whatever their lambda mentions again for every
    element. A value bound here is a lambda variable, so it is not recomputed.
    """
    pack = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.get(F.transform(F.array(pack), lambda s: fn(*[s[f"v{i}"] for i in range(len(values))])), F.lit(0))
