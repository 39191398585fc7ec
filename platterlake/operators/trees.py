"""Tree walks over edge tables: of known depth, or to the end with a visited set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes found last that a walk sends to every executor.
FEW = 100_000


def walk(levels: list[DataFrame], root: str = "$") -> DataFrame:
    """(id, path, depth): the root and all below it.  Each level is an edge table (id, parent,
    leaf) joined to the one above by parent; a row whose parent was not reached is not."""
    spark = levels[0].sparkSession
    at = spark.range(1).select(F.lit(root).alias("id"), F.lit(root).alias("path"), F.lit(0).alias("depth"))
    out = [at]
    for k, level in enumerate(levels, 1):
        up = at.select(F.col("id").alias("parent"), F.col("path").alias("above"))
        at = level.join(up, "parent").select("id", F.concat_ws(".", "above", "leaf").alias("path"), F.lit(k).alias("depth"))
        out.append(at)
    return reduce(DataFrame.union, out)


def reach(edges: DataFrame, root: str | int, kind: str = "string", most: int = 10_000) -> DataFrame:
    """(id, depth): what can be reached from ``root`` over ``edges`` (parent, child), and by how
    many steps at least.  A node is visited once, so cycles end.

    A step reads all edges and joins the nodes found last: up to ``FEW`` of them, by count, are
    sent to every executor; more meet their edges by a shuffle, so nothing that grows with the
    graph passes the driver.  A node found again keeps its least depth.  Each step is checkpointed
    where the session has a checkpoint folder, so plans stay short and a lost executor costs a step.
    """
    spark = edges.sparkSession
    keep = (lambda df: df.checkpoint()) if spark.sparkContext.getCheckpointDir() else (lambda df: df)
    seen, found = spark.range(1).select(F.lit(root).cast(kind).alias("id"), F.lit(0).alias("depth")), 1
    for k in range(1, most + 1):
        last = seen.where(F.col("depth") == k - 1).select(F.col("id").alias("parent"))
        step = edges.join(last.hint("broadcast" if found <= FEW else "merge"), "parent").select(F.col("child").cast(kind).alias("id"), F.lit(k).alias("depth"))
        seen = keep(seen.union(step).groupBy("id").agg(F.min("depth").alias("depth")))
        found = seen.where(F.col("depth") == k).count()
        if not found:
            return seen
    raise RuntimeError("the walk did not end")
