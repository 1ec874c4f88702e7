"""Running sums along ordered rows of a key, without a window over a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, key: str, block: str, order: str, values: dict[str, Column]) -> DataFrame:
    """Add sums of ``values`` up to and with each row, along ``block`` and then ``order`` of each ``key``.

    Rows are ordered within a block only; along a key there is one row a block.
    """
    total = df.groupBy(key, block).agg(*(F.sum(v).alias(f"__{n}") for n, v in values.items()))
    before = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(key, block, *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in values))
    inside = Window.partitionBy(key, block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({n: F.sum(v).over(inside) for n, v in values.items()}).join(total, [key, block])
    return out.withColumns({n: F.col(n) + F.col(f"__{n}") for n in values}).drop(*(f"__{n}" for n in values))
