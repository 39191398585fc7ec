"""Connected components over edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def _least(pairs: DataFrame) -> DataFrame:
    """The least neighbour of each node ``u``, itself included; combined before the shuffle."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v) with u > v.

    Large: every node links its larger neighbours to its least neighbour.  Small: every
    node links its smaller neighbours and itself to its least neighbour.  Both keep the
    components; a node with many neighbours costs one row each, never all pairs.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        out = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = edges.join(_least(edges), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.union(_least(edges).select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: bigint); root is the least node.

    Nulls and loops are dropped; no edges give no rows.  Each round is a written table,
    so an executor lost in a late round costs that round only.
    """
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        after = stage(_star(_star(now, True), False), "edges")
        # Equal row counts and hash sums: the star forest no longer changes.
        is_now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        unstage(now)
        now = after
        if is_now == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        before = is_now
    raise RuntimeError("components did not settle")
