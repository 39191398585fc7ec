"""Helpers shared by the training-data operators.

Words are the runs of ``[^\\x20\\x09-\\x0D]``.  In Python that is ``bytes.split()`` on
UTF-8; in Spark it is :data:`GAP` as a separator.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir`` (any path that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a cluster
    a missing setting is an error, as a machine-local folder would lose files.
    """
    conf = spark.sparkContext.getConf()
    if at := conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    global _local
    if _local is None:
        _local = tempfile.mkdtemp(prefix="platterlake-")
        atexit.register(shutil.rmtree, _local, ignore_errors=True)
    return _local


_local: str | None = None


#: Whether shuffle files are removed when the query that wrote them ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, at: str) -> None:
    """Write ``df`` as Parquet; nothing but the result stays on the executors' disks."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN, None)
    conf.set(CLEAN, "true")
    try:
        df.write.parquet(at)
    finally:
        conf.unset(CLEAN) if before is None else conf.set(CLEAN, before)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage is cut and a
    lost executor costs only a reread.  Shuffle files of the write go when it ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    write(df, at)
    out = spark.read.schema(df.schema).parquet(at)
    out._staged_at = at
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete tables written by :func:`stage` that no later plan reads."""
    for df in frames:
        at = getattr(df, "_staged_at", None)
        if at:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, whatever the optimizer collapses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP, -1), "")


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def about(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` of the rows, or all if they are fewer, by hash of ``key``: the same rows
    in every run, without an order or a limit over all of them."""
    share = min(1.0, most / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64(F.lit("about"), F.col(key)), F.lit(1 << 30)) < int(share * (1 << 30)))
