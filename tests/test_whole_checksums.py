"""Checksums over whole texts against the worker's forms, on texts longer than a sector."""

import random

from platterlake.plans.catalog import QUERIES
from platterlake.sources import filecore as fc


def test_checksums_read_whole_texts(spark, tmp_path):
    rnd = random.Random(3)
    texts = {i: "".join(chr(rnd.randrange(32, 127)) for _ in range(n)) for i, n in enumerate([0, 1, 255, 256, 257, 259, 512, 513, 1300, 5001])}
    spark.createDataFrame(list(texts.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: {tuple(r)[:-1]: r.check_byte for r in QUERIES[name](spark, str(tmp_path)).collect()}
    cut = lambda t, n: [t[i : i + n].ljust(n, "~").encode() for i in range(0, max(1, len(t)), n)]
    sectors = {(i, k): d for i, t in texts.items() for k, d in enumerate(cut(t, 512))}
    assert run("checksum_boot_sectors") == {k: fc.boot_check(d) for k, d in sectors.items()}
    assert run("checksum_zone_sectors") == {k: fc.zone_check(d) for k, d in sectors.items()}
    assert set(run("checksum_oldmap_sectors")) == {(i, k) for i, t in texts.items() for k in range(len(cut(t, 256)))}
    assert run("checksum_dir_whole") == {(i,): fc.dir_check(fc.words_then_bytes(t.encode())) for i, t in texts.items()}
