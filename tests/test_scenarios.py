"""Whole images from end to end, without a session."""

import random

import builder as b
import pytest

from platterlake.sources.disc import Options, _rows, extract, open_volumes
from platterlake.sources.fileserver import follow


def rows(data, what, **kw):
    return list(_rows("p", bytes(data), what, Options(**kw)))


def test_chains_end_at_themselves_at_none_and_at_the_limit():
    links = {1: 2, 2: 3, 3: None, 5: 5, 7: 8, 8: 7}
    assert list(follow(1, links.get, 9)) == [1, 2, 3]
    assert list(follow(5, links.get, 9)) == [5]
    assert list(follow(7, links.get, 5)) == [7, 8, 7, 8, 7]


def test_damaged_file_servers_still_give_rows():
    for seed in range(60):
        rnd = random.Random(seed)
        image = bytearray(rnd.choice([b.afs2(), b.afs3(), b.afs3("int")]))
        for _ in range(rnd.randrange(1, 60)):
            image[rnd.randrange(len(image))] = rnd.randrange(256)
        try:
            volumes = open_volumes(bytes(image))
        except Exception:
            continue
        for _, v in volumes:
            assert all(n > 0 for e in v.list(v.root()).entries for _, n in e.runs)


def test_truncated_dump_is_told():
    image, _ = b.new_map({b"A": b.FILE})
    (whole,), (cut,) = rows(image, "reports"), rows(image[: len(image) - 4096], "reports")
    told = [w for w in cut["directory_warnings"] if "truncated" in w]
    assert len(told) == 1 and f"only {len(image) - 4096} bytes" in told[0]
    assert not [w for w in whole["directory_warnings"] if "truncated" in w] or whole["disc_size"] > len(image)


def test_typed_files_get_a_suffix_and_locked_ones_their_attribute():
    (plain,) = rows(b.dfs({(b"F", "$", True): b.FILE}), "objects")
    assert plain["attrs"] & 8 or plain["attrs"]
    assert plain["host_leaf"].startswith("F")
    leaves = {r["name"]: r["host_leaf"] for r in rows(b.new_map({b"A": b.FILE})[0], "objects")}
    assert leaves["A"].split(",")[0] == "A"


def test_side_directories_and_directory_characters():
    names = {r["object_path"] for r in rows(b.dfs({(b"X", "$", False): b"1", (b"Y", "L", False): b"2"}), "content")}
    assert names == {"$.X", "$.L.Y"}


def test_dry_run_counts_and_gives_no_files():
    image = b.dfs({(b"F", "$", False): b.FILE})
    assert not rows(image, "content", dry_run=True) and not rows(image, "folders", dry_run=True)
    (total,) = rows(image, "extract_summary", dry_run=True)
    assert total["files_extracted"] == 1 and total["total_bytes"] == len(b.FILE)


@pytest.mark.parametrize("policy, want", [("null", bytes(256)), ("skip", b""), ("marker", (b"BAD SECTOR! " * 22)[:256])])
def test_bad_sector_policies_are_logged(policy, want):
    image = b.dfs({(b"F", "$", False): b.FILE})
    (_, v), *_ = open_volumes(image)
    found = list(extract(v, Options(bad_sectors=policy, rescue_map="0 +\n0x200 0x100 -\n")))
    (file,) = [r for k, r in found if k == "file"]
    assert file["bytes"] == want + b.FILE[256:]
    assert [r["kind"] for k, r in found if k == "log"] == ["bad_sectors", "extracted"]
