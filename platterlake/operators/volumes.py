"""Operators over tables of volumes, zones, objects and faults.  Every aggregate is combined
before it is dealt out, so a volume that holds most rows costs one row a task."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def counted(condition: Column) -> Column:
    """How many rows meet ``condition``; a null does not."""
    return F.count(F.when(condition, 1))


def chosen_copy(primary_ok: Column, backup_ok: Column) -> Column:
    """(used, ok): which copy of a zone serves: the primary unless only its backup is good."""
    backup = ~primary_ok & F.coalesce(backup_ok, F.lit(False))
    return F.struct(F.when(backup, "backup").otherwise("primary").alias("used"), (primary_ok | backup).alias("ok"))


def cross_checks(zones: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, cross_check, zones, ok): the bytes of a map xor to 255."""
    got = zones.groupBy(*keys).agg(F.bit_xor(value).alias("cross_check"), F.bit_xor(F.col(value).bitwiseAND(F.lit(255))).alias("low"), F.count("*").alias("zones"))
    return got.select(*keys, "cross_check", "zones", (F.col("low") == 255).alias("ok"))


def zone_counts(zones: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """(keys, zones_ok, zones, all_ok)."""
    got = zones.groupBy(*keys).agg(counted(ok).alias("zones_ok"), F.count("*").alias("zones"))
    return got.withColumn("all_ok", F.col("zones_ok") == F.col("zones"))


def plausible(entries: DataFrame, keys: list[str], bad: Column) -> DataFrame:
    """(keys, entries, bad, plausible): a catalogue stands unless most of its entries are bad."""
    got = entries.groupBy(*keys).agg(F.count("*").alias("entries"), counted(bad).alias("bad"))
    return got.withColumn("plausible", 2 * F.col("bad") <= F.col("entries"))


def totals(objects: DataFrame, keys: list[str], length: str) -> DataFrame:
    """(keys, files, bytes) of volumes, of their parts, and of all (keys null)."""
    return objects.rollup(*keys).agg(F.count("*").alias("files"), F.sum(length).cast("long").alias("bytes"))


def tally(reports: DataFrame, kinds: list[str]) -> DataFrame:
    """(kinds, discs): how many discs there are of each kind, as map and directory type."""
    return reports.groupBy(*kinds).agg(F.count("*").alias("discs"))


def fragmented(extents: DataFrame, disc: list[str], object_: list[str]) -> DataFrame:
    """(disc, files, fragmented): objects with extents, and those with more than one."""
    got = extents.groupBy(*disc, *object_).agg((F.count("*") > 1).alias("several"))
    return got.groupBy(*disc).agg(F.count("*").alias("files"), counted(F.col("several")).alias("fragmented"))


def unique_labels(volumes: DataFrame, order: str, label: Column) -> DataFrame:
    """(order, label): the second volume of a label is label-1, the next label-2."""
    x = volumes.select(order, label.alias("label"))
    # Volumes of one label stand on one image, of which there are a handful.
    n = F.row_number().over(W.partitionBy("label").orderBy(order)) - 1
    return x.withColumn("n", n).select(order, F.when(F.col("n") == 0, F.col("label")).otherwise(F.concat_ws("-", "label", "n")).alias("label"))


def first_visits(directories: DataFrame, id_: str, fingerprint: Column) -> DataFrame:
    """(id, first_id, revisited): the first directory with the same extents."""
    x = directories.select(id_, fingerprint.alias("print"))
    first = x.groupBy("print").agg(F.min(id_).alias("first_id"))
    return x.join(first, "print").select(id_, "first_id", (F.col(id_) != F.col("first_id")).alias("revisited"))


def chain_lengths(links: DataFrame, chain: str, at: str, head: int = 0) -> DataFrame:
    """(chain, reached, last): the nodes that a walk visits from ``head`` over links to the next
    number, each once however often it is stored, and where it ends.  Linked nodes are islands
    of consecutive numbers; the head's island is the walk."""
    nodes = links.select(F.col(chain).alias("c"), F.col(at).alias("n")).where(F.col(at) >= head).distinct()
    nodes = nodes.withColumn("i", F.row_number().over(W.partitionBy("c").orderBy("n")) - 1 + head).where("n = i")
    return nodes.groupBy(F.col("c").alias(chain)).agg(F.count("*").alias("reached"), F.max("n").alias("last"))


def mismatches(pairs: DataFrame, image: Column, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(image, field, boot, zone0): a row for each field that two records of a disc differ in."""
    rows = F.array(*(F.struct(F.lit(n).alias("field"), a.cast("string").alias("boot"), b.cast("string").alias("zone0")) for n, (a, b) in fields.items()))
    return pairs.select(image.alias("image"), F.explode(F.filter(rows, lambda r: r["boot"] != r["zone0"])).alias("f")).select("image", "f.*")


def sniffed(head: Column, signatures: Iterable[tuple[str, str]], other: str) -> Column:
    """The kind of the first signature that ``head`` starts with."""
    return F.coalesce(*(F.when(head.startswith(s), kind) for s, kind in signatures), F.lit(other))


def own_directories(objects: DataFrame, label: str, wanted: list[str]) -> DataFrame:
    """(label, files, own_directory) of the partitions asked for."""
    got = objects.where(F.col(label).isin(wanted)).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("files"))
    return got.withColumn("own_directory", F.col("files") > 1)


#: Labels of the text report, padded to 17: fixed values.
LABELS = {"filesystem": "Filesystem:", "disc_name": "Disc name:", "disc_size": "Disc size:"}


def report_lines(**values: Column) -> Column:
    """The text report of the values that are not null, a line each."""
    lines = [F.concat(F.rpad(F.lit(LABELS[n]), 17, " "), v.cast("string")) for n, v in values.items()]
    return reduce(lambda a, b: F.concat_ws("\n", a, b), lines)
