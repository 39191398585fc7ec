"""Order-dependent operators without one long window a key.

Rows of a key are dealt into blocks of ``width`` places of a whole-number order.  Only blocks
are ordered over a whole key, one row each; rows are ordered inside their block.  So a key
that holds most rows is spread over its blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WIDTH = 1 << 16


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _joined(rows: DataFrame, blocks: DataFrame, on: list[str], names: list[str]) -> DataFrame:
    """``rows`` with the columns ``names`` of their block; null keys meet."""
    here = {c: fresh(rows, f"of_{k}") for k, c in enumerate(on)}
    side = blocks.select(*(F.col(c).alias(n) for c, n in here.items()), *names)
    met = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(n)) for c, n in here.items()))
    return rows.join(side, met, "left").drop(*here.values())


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, name: str, width: int = WIDTH) -> DataFrame:
    """``df`` with the column ``name``: the sum of ``value`` over the rows of its key before it in
    ``order``, a whole number without ties in a key.  Null values count as 0."""
    block, part = fresh(df, "block"), fresh(df, "part")
    rows = df.withColumn(block, F.floor(F.col(order) / width).cast("long"))
    blocks = rows.groupBy(*keys, block).agg(F.sum(value).alias(part))
    before = F.sum(part).over(W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1))
    rows = _joined(rows, blocks.withColumn(part, before), [*keys, block], [part])
    inside = F.sum(value).over(W.partitionBy(*keys, block).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn(name, (F.coalesce(inside, F.lit(0)) + F.coalesce(F.col(part), F.lit(0))).cast("long")).drop(block, part)


def previous(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """``df`` with the column ``name``: ``value`` of the row of its key before it in ``order``; null
    at the first."""
    block, last, now = fresh(df, "block"), fresh(df, "last"), fresh(df, "now")
    rows = df.withColumn(now, value).withColumn(block, F.floor(F.col(order) / width).cast("long"))
    blocks = rows.groupBy(*keys, block).agg(F.max_by(F.struct(now), order).alias(last))
    blocks = blocks.withColumn(last, F.lag(last).over(W.partitionBy(*keys).orderBy(block)))
    rows = _joined(rows, blocks, [*keys, block], [last])
    inside = W.partitionBy(*keys, block).orderBy(order)
    first = F.row_number().over(inside) == 1
    return rows.withColumn(name, F.when(first, F.col(last)[now]).otherwise(F.lag(now).over(inside))).drop(block, last, now)
