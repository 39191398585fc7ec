"""Running sums, previous rows and merges over blocks, against plain loops."""

import random

from platterlake.operators.extents import merge_adjacent
from platterlake.operators.ranges import previous, running_sum
from platterlake.operators.volumes import chain_lengths
from pyspark.sql import functions as F


def test_blocks_equal_loops(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "b", None]), k, rnd.choice([None, 1, 2, 3]), 0) for k in rnd.sample(range(-50, 200), 150)]
    df = spark.createDataFrame(rows, "key string, at long, n long, block int")
    total, last, want = {}, {}, {}
    for key, at, n, _ in sorted(rows, key=lambda r: r[1]):
        want[at] = (total.get(key, 0), last.get(key))
        total[key] = total.get(key, 0) + (n or 0)
        last[key] = n
    got = previous(running_sum(df, ["key"], "at", "n", "before", 7), ["key"], "at", F.col("n"), "prev", 7)
    assert got.columns == ["key", "at", "n", "block", "before", "prev"]
    assert {r["at"]: (r.before, r.prev) for r in got.collect()} == want
    assert running_sum(df.limit(0), ["key"], "at", "n", "before").count() == 0


def test_merge_over_blocks(spark):
    rnd = random.Random(2)
    rows, start = [], 0
    for k in range(90):
        length = rnd.randrange(1, 4)
        rows.append((0, k, start, length))
        start += length + rnd.choice([0, 0, 0, 5])
    want, ends = [], None
    for _, _, s, n in rows:
        if s == ends:
            want[-1][1] += n
        else:
            want.append([s, n])
        ends = s + n
    got = merge_adjacent(spark.createDataFrame(rows, "disc int, at long, start long, length long"), ["disc"], "at", "start", "length", 8).orderBy("ord").collect()
    assert [[r.start, r.length] for r in got] == want


def test_chain_visits_repeated_nodes_once(spark):
    rows = [(1, n) for n in (0, 1, 1, 2, 4, 5)] + [(2, n) for n in (1, 2)] + [(3, 0)] * 3
    got = chain_lengths(spark.createDataFrame(rows, "c int, n int"), "c", "n").collect()
    assert sorted(map(tuple, got)) == [(1, 3, 2), (3, 1, 0)]
