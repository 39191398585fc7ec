"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits.  For a radius of r, every bit gets a vector of r+1 bits and
every nonzero vector v of r+1 bits makes a mask: the bits whose own vector has an odd
product with v.  The vectors of r differing bits span at most r dimensions, so some v is
orthogonal to all of them: its mask leaves those bits out, and the pair has equal masked
values in that table.  Every pair within the radius thus meets in one of 2^(r+1) - 1 tables.

Equal fingerprints are one node.  Each node goes to each table once.  A bucket emits the
links of a spanning forest, never its pairs.  A bucket beyond ``BUCKET`` fingerprints is
not compared at all but linked through midpoints: two fingerprints are within 4 bits
exactly if some point is within 2 bits of both, so linking every member to the points
around it gives the same components with rows in proportion to the members.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other;
repeated rows and ids come back as often as they came; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .graph import components

SEED, RADIUS, BUCKET = 42, 4, 20_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_STEP = 1 << 16  # hashes unpacked to bits at once


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit SimHash of the text's word shingles, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends))[:n].tolist()
    digest, at = xxhash.xxh64_intdigest, ends[len(ends) - n :].tolist()
    hashes = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, at, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _STEP):
        ones += np.unpackbits(hashes[i : i + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp) for every row of ``df``; fp is the fingerprint as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int = RADIUS) -> list[int]:
    """The 2^(radius+1) - 1 masks of a covering of 64 bits, as signed integers."""
    n = (1 << (radius + 1)) - 1
    found = [sum(1 << i for i in range(64) if ((i % n + 1) & v).bit_count() & 1) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def forest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among distinct fingerprints (uint64).

    Each fingerprint is compared once, with those that no tree has reached yet.
    """
    u: list[int] = []
    v: list[int] = []
    rest, front = fps, fps[:0]
    while len(rest) or len(front):
        if not len(front):
            front, rest = rest[:1], rest[1:]
        at, front = front[-1], front[:-1]
        near = np.bitwise_count(rest ^ at) <= radius
        if near.any():
            met, rest = rest[near], rest[~near]
            u += [int(at.view(np.int64))] * len(met)
            v += met.view(np.int64).tolist()
            front = np.concatenate((front, met))
    return u, v


def _linker(radius: int, bucket: int):
    """Over rows (t, key, fp) sorted by table, key and fp: links, and (fp, null) for the
    members of buckets too large.  No more than a batch and a bucket are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint64)]  # of the group not yet ended
        over = None  # the (table, key) of a group found too large

        def out(u: list[int], v: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        def link(group: np.ndarray, too_large: bool) -> tuple[list[int], list]:
            if too_large or len(group) > bucket:
                return group.view(np.int64).tolist(), [None] * len(group)
            return forest(group, radius)

        for b in batches:
            new = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)]
            t, key, fps = (np.concatenate(x) for x in zip(held, new, strict=True))
            if not len(fps):
                continue
            starts = np.concatenate(([0], np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1))
            sizes = np.diff(np.append(starts, len(fps)))
            u, v = [], []
            for i in np.flatnonzero((sizes[:-1] > 1) | (starts[:-1] == 0)).tolist():
                a = int(starts[i])
                x, y = link(fps[a : a + int(sizes[i])], over == (t[a], key[a]))
                u += x
                v += y
            a = int(starts[-1])
            if len(fps) - a > bucket or over == (t[a], key[a]):
                over = (t[a], key[a])
                x, y = link(fps[a:], True)
                u += x
                v += y
                a = len(fps)
            held = [t[a:], key[a:], fps[a:]]
            if u:
                yield out(u, v)
        u, v = link(held[2], False)
        if u:
            yield out(u, v)

    return run


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that give all components within the radius.

    Fingerprints of an oversized bucket come as rows to midpoints, which are nodes as well;
    only an even radius has midpoints, so an odd one raises.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))])
    dealt = fps.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp").repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    return dealt.mapInArrow(_linker(radius, bucket), "u long, v long")


def _midpoint_links(members: DataFrame, radius: int) -> DataFrame:
    """Links between members that share a point within half the radius: each point's members
    link to the least of them, which the point's group gives by a combined minimum."""
    half = radius // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = [0]
        for _ in range(half):
            flips = sorted({f ^ (1 << i) for f in flips for i in range(64)} | set(flips))
        flip = np.array(flips, np.uint64)
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fps), 64):
                part = fps[i : i + 64]
                points = (part[:, None] ^ flip[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, len(flip)).view(np.int64)), pa.array(points.view(np.int64))], ["u", "point"])

    points = members.mapInArrow(run, "u long, point long")
    least = points.groupBy("point").agg(F.min("u").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    return points.join(least, "point").where("u <> v").select("u", "v").distinct()


def cluster(df: DataFrame, text: str = "text", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the least doc_id reachable."""
    docs = stage(with_fingerprints(df, text), "fingerprints")
    nodes = docs.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    found = stage(links(nodes.select("fp"), radius, bucket), "links")
    edges = found.where("v is not null")
    members = found.where("v is null").select("u").distinct()
    if not members.isEmpty():
        edges = edges.union(_midpoint_links(members, radius))
    roots = components(edges)
    rooted = stage(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "roots")
    group = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return docs.join(rooted.join(group, "root").select("fp", "component_id"), "fp")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = cluster(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
