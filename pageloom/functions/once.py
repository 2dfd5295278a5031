"""Values that an expression names more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once a row, however often f names it; f may not call a Python UDF."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
