"""The command line, end to end over images of our own."""

import json
import zlib

import builder as b
import pytest

from platterlake.cli import main
from platterlake.sources import dfs
from platterlake.sources.disc import Options, decode, open_volumes, read_images

DISC = {(b"!BOOT", "$", False): b"*RUN X\r", (b"CODE", "L", True): b.FILE}


def broken() -> bytes:
    """A new-map image whose root directory fails its check byte."""
    image = bytearray(b.new_map({b"A": b.FILE}, nzones=1)[0])
    image[open_volumes(bytes(image))[0][1].root_runs[0][0] + 0x7FF] ^= 255
    return bytes(image)


def put(folder, **images):
    for name, data in images.items():
        (folder / name).write_bytes(data)
    return folder


def test_json_is_one_array_of_partitions(spark, tmp_path, capsys):
    at = str(put(tmp_path, a=b.dfs(DISC)) / "a")
    assert main(["info", at]) == 0
    (info,) = json.loads(capsys.readouterr().out)
    assert info["partition"] and info["disc_name"] == "TESTDISC" and "path" not in info and "status" not in info
    assert main(["extract", at, "--output", str(tmp_path / "out")]) == 0
    (got,) = json.loads(capsys.readouterr().out)
    assert got == info | {"files_extracted": 2, "files_skipped": 0, "dirs_created": 1, "total_bytes": 7 + len(b.FILE)}
    assert main(["verify", at, "--format", "json"]) == 0
    (got,) = json.loads(capsys.readouterr().out)
    assert got == {"partition": info["partition"], "directories": 1, "files": 2, "unreadable": 0}


def test_text_has_headings_and_totals(spark, tmp_path, capsys):
    at = str(put(tmp_path, a=b.dfs(DISC)) / "a")
    assert main(["info", at, "--format", "text"]) == 0
    text = capsys.readouterr().out
    assert text.startswith("Partition ") and "Disc name:       TESTDISC" in text
    assert main(["verify", at]) == 0
    first, total = capsys.readouterr().out.splitlines()
    assert first.startswith("partition ") and first.endswith("directories=1 files=2 unreadable=0") and total == "total: directories=1 files=2 unreadable=0"
    assert main(["extract", at, "--output", str(tmp_path / "out"), "--format", "text", "--dry-run"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert "Files extracted: 2" in lines and "Dirs created:    1" in lines and not (tmp_path / "out").exists()


def test_broken_directory_policies(spark, tmp_path, capsys):
    at = str(put(tmp_path, a=broken()) / "a")
    out = tmp_path / "out"
    assert main(["extract", at, "--output", str(out)]) == 0  # recovered unless told otherwise
    assert [f.read_bytes() for f in out.glob("A*")] == [b.FILE]
    assert main(["extract", at, "--output", str(tmp_path / "skip"), "--on-broken-directory", "skip"]) == 0
    assert (tmp_path / "skip").is_dir() and not any((tmp_path / "skip").iterdir())
    capsys.readouterr()
    assert main(["extract", at, "--output", str(tmp_path / "fail"), "--on-broken-directory", "fail"]) == 1
    assert "error: " in capsys.readouterr().err and not (tmp_path / "fail").exists()


def test_images_of_a_folder_stay_apart(spark, tmp_path, capsys):
    images = tmp_path / "images"
    images.mkdir()
    put(images, one=b.dfs({(b"F", "$", False): b"first"}), two=b.dfs({(b"F", "$", False): b"second"}), bad=b"\x01" * 600, broken=broken())
    out = tmp_path / "out"
    assert main(["extract", str(images), "--output", str(out), "--log", str(tmp_path / "logs" / "l.txt"), "--format", "text"]) == 0
    assert (out / "one" / "F").read_bytes() == b"first" and (out / "two" / "F").read_bytes() == b"second" and [f.read_bytes() for f in (out / "broken").glob("A*")] == [b.FILE]
    assert "Total: 3 files extracted, 0 files skipped, 3 dirs," in capsys.readouterr().out
    log = (tmp_path / "logs" / "l.txt").read_text()
    assert "extracted  $.F (6 bytes)" in log and "broken-dir $ action=recover" in log


def test_empty_directories_are_made(spark, tmp_path):
    image, _ = b.new_map({b"A": b.FILE})
    folders = decode(read_images(spark, str(put(tmp_path, a=image) / "a")), "folders").collect()
    assert [r.host_path for r in folders] == [""]
    from platterlake.cli import write_folders

    write_folders(spark.createDataFrame([("x/empty",), ("",)], "host_path string"), str(tmp_path / "made"))
    assert (tmp_path / "made" / "x" / "empty").is_dir()
    with pytest.raises(Exception, match="leaves the output folder"):
        write_folders(spark.createDataFrame([("../out",)], "host_path string"), str(tmp_path / "made"))


def test_failures_are_never_silent(spark, tmp_path, capsys, monkeypatch):
    at = str(put(tmp_path, a=b.dfs(DISC)) / "a")
    images = read_images(spark, at)
    assert decode(images, "failures").count() == 0
    from platterlake.sources import disc

    volume = ("DFS", dfs.Dfs(open_volumes(b.dfs(DISC))[0][1].image))
    monkeypatch.setattr(disc, "open_volumes", lambda data: [volume])
    monkeypatch.setattr(dfs.Dfs, "info", lambda self: 1 // 0)
    (row,) = disc._rows("p", b"", "reports", Options())
    assert row["status"] == "error" and "ZeroDivisionError" in row["error"]
    found = {r["task"] for r in disc._rows("p", b"", "failures", Options())}
    assert "reports" in found and "extract_summary" not in found
    assert [zlib.crc32(r["bytes"]) == r["crc32"] for r in disc._rows("p", b"", "content", Options())] == [True, True]


def test_errors(spark, tmp_path, capsys):
    at = str(put(tmp_path, a=b.dfs(DISC), d=b"\x01" * 600) / "a")
    assert main(["info", str(tmp_path / "d")]) == 2 and json.loads(capsys.readouterr().out) == {"recognized": False}
    assert main(["info", str(tmp_path / "d"), "--format", "text"]) == 2
    assert capsys.readouterr().out == "not a recognised disc image (FileCore, AFS or DFS)\n"
    (tmp_path / "map").write_text("0 +\n1 2\n")
    assert main(["extract", at, "--output", str(tmp_path / "o"), "--rescue-map", str(tmp_path / "map")]) == 1
    assert main(["extract", at, "--output", str(tmp_path / "o"), "--rescue-map", str(tmp_path / "none")]) == 1
    assert main(["verify", at, "--diagnostics", str(tmp_path / "none" / "x.jsonl")]) == 1
