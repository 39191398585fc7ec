"""Operators over extents and ranges: rows of (keys, ord, start, length)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranges import WIDTH, previous, running_sum

Order = str | list[str]


def _prefix(keys: list[str], order: Order, length: str) -> Column:
    """What stands before each extent of its list; ``order`` must leave no ties."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(length).over(w), F.lit(0))


def truncate(df: DataFrame, keys: list[str], order: Order, length: str, most: Column) -> DataFrame:
    """The first ``most`` bytes of every list; extents left without any go."""
    kept = F.greatest(F.lit(0), F.least(F.col(length), most - _prefix(keys, order, length)))
    return df.withColumn(length, kept.cast("long")).where(F.col(length) > 0)


def trim(df: DataFrame, keys: list[str], order: Order, start: str, length: str, skip: Column) -> DataFrame:
    """Every list without its first ``skip`` bytes."""
    cut = F.least(F.col(length), F.greatest(F.lit(0), skip - _prefix(keys, order, length)))
    out = df.withColumn("_cut", cut.cast("long"))
    return out.withColumn(start, F.col(start) + F.col("_cut")).withColumn(length, F.col(length) - F.col("_cut")).drop("_cut").where(F.col(length) > 0)


def merge_adjacent(df: DataFrame, keys: list[str], order: str, start: str, length: str, width: int = WIDTH) -> DataFrame:
    """(keys, ord, start, length) with extents joined where one ends as the next starts.
    ``order`` is a whole number without ties in a list."""
    x = previous(df.select(*keys, order, start, length), keys, order, F.col(start) + F.col(length), "before", width)
    x = x.withColumn("new", F.when(F.col("before") == F.col(start), 0).otherwise(1))
    runs = running_sum(x, keys, order, "new", "ord", width).withColumn("ord", F.col("ord") + F.col("new"))
    return runs.groupBy(*keys, "ord").agg(F.min(start).alias(start), F.sum(length).cast("long").alias(length))


def chunks(df: DataFrame, size: Column, step: int = 262_144) -> DataFrame:
    """A row for each chunk of at most ``step`` bytes: columns at and n; none for size 0."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), size.cast("long") - 1, F.lit(step).cast("long")))
    return df.where(size > 0).withColumn("at", at).withColumn("n", F.least(F.lit(step), size - F.col("at")).cast("long"))


def overlaps(extents: DataFrame, ranges: DataFrame, by: str, width: int) -> DataFrame:
    """Extents (by, id, start, length) with the parts (bad_start, bad_length) that ranges
    (by, start, length) cover.

    Both sides are dealt into cells of ``width`` addresses and joined on them, so no pair
    is tried but those that share a cell; a pair counts in the cell where its overlap starts.
    """
    def cells(df: DataFrame, start: str, length: str) -> DataFrame:
        cell = lambda x: F.floor(x / width).cast("long")
        return df.where(F.col(length) > 0).withColumn("cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(start) + F.col(length) - 1))))

    a = cells(extents, "start", "length")
    b = cells(ranges.select(F.col(by).alias("b_by"), F.col("start").alias("b_start"), F.col("length").alias("b_length")), "b_start", "b_length").withColumnRenamed("cell", "b_cell")
    met = a.join(b, F.col(by).eqNullSafe(F.col("b_by")) & (F.col("cell") == F.col("b_cell")))
    lo = F.greatest("start", "b_start")
    hi = F.least(F.col("start") + F.col("length"), F.col("b_start") + F.col("b_length"))
    met = met.where((lo < hi) & (F.floor(lo / width).cast("long") == F.col("cell")))
    return met.select(by, "id", "start", "length", lo.alias("bad_start"), (hi - lo).alias("bad_length"))


def segments(extents: DataFrame, ranges: DataFrame, by: str, width: int) -> DataFrame:
    """(by, id, seg_start, seg_length, status): every extent cut into bad parts and the good
    ones around them, in order.  Ranges of one ``by`` don't overlap."""
    bad = overlaps(extents, ranges, by, width)
    w = W.partitionBy(by, "id").orderBy("bad_start")
    before = F.coalesce(F.lag(F.col("bad_start") + F.col("bad_length")).over(w), F.col("start"))
    bad = bad.withColumn("_from", before).withColumn("_last", F.lead("bad_start").over(w).isNull())
    row = lambda s, n, what: F.struct(s.cast("long").alias("seg_start"), n.cast("long").alias("seg_length"), F.lit(what).alias("status"))
    end = F.col("bad_start") + F.col("bad_length")
    tail = F.when(F.col("_last"), F.col("start") + F.col("length") - end).otherwise(0)
    parts = F.array(row(F.col("_from"), F.col("bad_start") - F.col("_from"), "good"), row(F.col("bad_start"), F.col("bad_length"), "bad"), row(end, tail, "good"))
    cut = bad.select(by, "id", F.explode(F.filter(parts, lambda p: p["seg_length"] > 0)).alias("p")).select(by, "id", "p.*")
    hit = bad.select(F.col(by).alias("h_by"), F.col("id").alias("h_id")).distinct()
    whole = extents.where("length > 0").join(hit, F.col(by).eqNullSafe(F.col("h_by")) & (F.col("id") == F.col("h_id")), "left_anti")
    return cut.union(whole.select(by, "id", F.col("start").alias("seg_start"), F.col("length").cast("long").alias("seg_length"), F.lit("good").alias("status")))


def marker(n: Column) -> Column:
    """Text of ``n`` characters for bad sectors; it restarts with each segment."""
    return F.substr(F.repeat(F.lit("BAD SECTOR! "), (F.floor(n / 12) + 1).cast("int")), F.lit(1), n.cast("int"))
