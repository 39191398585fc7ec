"""Decoders over images of our own, as pure functions and as DataFrames."""

import random
import zlib

import builder as b
import pytest

from platterlake.sources import filecore as fc
from platterlake.sources.dfs import Dfs, place
from platterlake.sources.disc import SCHEMAS, BrokenDirectory, Options, decode, extract, open_volumes, read_images, walk
from platterlake.sources.fileserver import date
from platterlake.sources.fileserver import place as afs_place
from platterlake.sources.model import Entry, Image, NotRecognised, Unsupported, clip
from platterlake.sources.names import host_leaf, inf_line, inf_name
from platterlake.sources.rescue import Ranges, RescueMapError, literal

DISC = {(b"!BOOT", "$", False): b"*RUN X\r", (b"CODE", "L", True): b.FILE}


def files(data, **kw):
    (label, v), *_ = open_volumes(data)
    return {r["object_path"]: r["bytes"] for kind, r in extract(v, Options(**kw)) if kind == "file"}


def summary(data, **kw):
    return [r for kind, r in extract(open_volumes(data)[0][1], Options(**kw)) if kind == "summary"][0]


def test_dfs_single_side():
    assert files(b.dfs(DISC)) == {"$.!BOOT": b"*RUN X\r", "$.L.CODE": b.FILE}
    v = Dfs(Image(b.dfs(DISC)))
    e = v.list(v.root()).entries[1]
    assert (e.load, e.exec, e.attrs) == (0x1900, 0x8023, 4)
    assert v.info()["disc_name"] == "TESTDISC" and v.info()["directory_warnings"] == []


def test_dfs_double_sided_file_across_tracks():
    cat = b.dfs_catalogue(b"TWO", [(b"A", "$", False, 0, 0, 6 * 256, 2), (b"B", "$", False, 0, 0, len(b.FILE), 8)], 800)
    image, want = bytearray(800 * 512), {}
    for side in (0, 1):
        for start, data in ((0, cat), (8 * 256, b.FILE)):
            at = 0
            for a, n in place(True, side, start, len(data)):
                b.put(image, a, data[at : at + n])
                at += n
        want[f"$.Side{side}.B"] = b.FILE
    got = files(bytes(image))
    assert {k: got[k] for k in want} == want
    v = open_volumes(bytes(image))[0][1]
    assert len(v.list(Entry("", side=1)).entries[1].runs) == 2


def test_dfs_bad_entry_policies_and_watford():
    data = bytearray(b.dfs(DISC))
    data[0x117] = 250  # the second file
    data[0x116] |= 3
    with pytest.raises(BrokenDirectory):
        files(bytes(data))
    assert len(files(bytes(data), broken_dirs="recover")) == 1 and not files(bytes(data), broken_dirs="skip")
    rows = [(b"F%d" % i, "$", False, 0, 0, 10, 4 + i) for i in range(40)]
    image = bytearray(800 * 256)
    b.put(image, 0, b.dfs_catalogue(b"WAT", rows[:31], 800, rows[31:]))
    assert len(files(bytes(image))) == 40


@pytest.mark.parametrize("total", [640, 1280, 2560])
def test_old_map_floppies(total):
    tracks, heads = fc.FLOPPY[total]
    v = fc.FileCore.__new__(fc.FileCore)
    v.map_type, v.tracks, v.dir_size, v.dir_type = "old", (tracks, heads), fc.SMALL, "old"
    e = Entry("F", length=len(b.FILE))
    runs = v._runs(e, 15, None)
    root = b.large_dir([(b"Fred", 0xFFFFEB00, 5, len(b.FILE), 15, 7)], 0, small=True)
    data = b.old_map(total, root, [(runs, b.FILE)], total * 256)
    assert files(data) == {"$.Fred": b.FILE}
    assert (len(runs) > 1) == (total == 2560)
    got = open_volumes(data)[0][1]
    assert got.info()["disc_name"] == "OldDiscNam" and got.info()["disc_size"] == total * 256
    assert got.list(got.root()).entries[0].attrs == 7


def test_old_map_hard_disc_and_large_directories():
    root = b.large_dir([(b"One", 1, 2, 300, 40, 3)], 0, small=True)
    assert files(b.old_map(5000, root, [([(40 * 256, 300)], b.FILE[:300])], 100_000)) == {"$.One": b.FILE[:300]}
    root = b.large_dir([(b"Two", 1, 2, 300, 40, 3)], 0)
    assert files(b.old_map(3200, root, [([(40 * 256, 300)], b.FILE[:300])], 100_000, 0x400)) == {"$.Two": b.FILE[:300]}


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("nzones", [1, 2, 3])
def test_new_map_random_fragments(big, nzones):
    for seed in range(20):
        rnd = random.Random(seed)
        names = sorted({b"F%d" % rnd.randrange(100) for _ in range(4)}, key=bytes.lower)
        data = {n: rnd.randbytes(rnd.randrange(1, 30_000)) for n in names}
        image, want = b.new_map(data, {n: rnd.randrange(1, 6) for n in names}, big, nzones)
        assert files(image) == {f"$.{k}": v for k, v in want.items()}
        v = open_volumes(image)[0][1]
        assert v.faults() == [] and v.info()["dir_type"] == ("big" if big else "new")


def test_new_map_faults():
    image, _ = b.new_map({b"A": b.FILE}, nzones=1)
    v = open_volumes(image)[0][1]
    at = v.record.map_addr
    one = bytearray(image)
    one[at + 200] ^= 1  # the backup serves
    assert open_volumes(bytes(one))[0][1].faults() == [] and files(bytes(one)) == {"$.A": b.FILE}
    two = bytearray(one)
    two[at + 1024 + 200] ^= 1
    assert [c for c, *_ in open_volumes(bytes(two))[0][1].faults()] == ["zone_checksum_mismatch"]
    broken = bytearray(image)
    broken[v.root_runs[0][0] + 0x7FF] ^= 255
    with pytest.raises(BrokenDirectory):
        files(bytes(broken))
    assert files(bytes(broken), broken_dirs="recover") == {"$.A": b.FILE}
    with pytest.raises(Unsupported):
        open_volumes(b.new_map({b"A": b.FILE}, low=0x40)[0])


def test_new_map_wrong_parent_is_a_warning():
    image, _ = b.new_map({b"A": b.FILE})
    v = open_volumes(image)[0][1]
    at = v.root_runs[0][0]
    raw = b.large_dir([(b"A", 0, 0, len(b.FILE), 3 << 8, 3)], 0)
    data = bytearray(image)
    b.put(data, at, raw)
    x = next(walk(open_volumes(bytes(data))[0][1]))
    assert not x.listing.broken and "parent SIN mismatch" in x.listing.warnings[0]
    assert files(bytes(data)) == {"$.A": b.FILE}


def test_file_server_levels_and_orders():
    assert files(b.afs2()) == {"$.DATA": b.FILE[:259], "$.HELLO": b"Hello, world!"}
    for order in ("seq", "int", "mux"):
        (_, v), *_ = open_volumes(b.afs3(order))
        assert v.order == order
        assert files(b.afs3(order)) == {"$.DATA": b.FILE[:259], "$.HELLO": b"Hello, world!"}


def test_bad_sectors():
    data = b.dfs({(b"F", "$", False): b.FILE})
    half = "# map\n0 +\n0x200 0x100 -\n"
    assert files(data, rescue_map=half, bad_sectors="null")["$.F"] == bytes(256) + b.FILE[256:]
    assert files(data, rescue_map=half, bad_sectors="skip")["$.F"] == b.FILE[256:]
    assert files(data, rescue_map=half, bad_sectors="marker")["$.F"][:24] == b"BAD SECTOR! BAD SECTOR! "
    assert summary(data, rescue_map="0 +\n0 0x100000 -\n") == {"files_extracted": 0, "files_skipped": 1, "dirs_created": 1, "total_bytes": 0}


def test_golden_values():
    sector = bytearray((i * 31) & 255 for i in range(512))
    sector[0:4] = b"\0\x18\x80\x42"
    assert fc.zone_check(bytes(sector)) == 0xA0
    assert fc.boot_check((0x20000000).to_bytes(4, "little") + bytes(508)) == 0x20
    assert place(True, 1, 0x300, 256) == [(0xD00, 256)]
    assert place(True, 0, 9 * 256, 1024) == [(9 * 256, 256), (20 * 256, 768)]
    assert place(True, 1, 9 * 256, 1024) == [(19 * 256, 256), (30 * 256, 768)]
    assert [afs_place(16, 16, o) for o in ("int", "mux", "seq")] == [32, 1280, 16]
    day = lambda y, m, d: (__import__("datetime").date(y, m, d).toordinal() - 719163) * 86400
    assert [date(x) for x in (0x910F, 0x323D, 5, 0x1F02)] == [day(1990, 1, 15), day(2000, 2, 29), None, None]
    runs = [(0, 10), (100, 10)]
    assert clip(runs, 15) == [(105, 5)] and clip(runs, 0, 15) == [(0, 10), (100, 5)]
    e = Entry("File", b"File", 0xFFF00FEB, 0x12345678, attrs=3, stamped=0)
    assert inf_line(e, 0x100, 0xDEADBEEF) == "File fff00feb 12345678 00000100 03 CRC32=DEADBEEF DATETIME=19700101000000"
    assert inf_name(b"My File") == '"My%20File"' and inf_name(b"Caf\xe9") == '"Caf%E9"'
    leaf = lambda n, load=0, d=False: host_leaf(Entry(n, load=load, is_dir=d))
    assert leaf("Fred/Bloggs?Was<Here>Ok+Now=Then;Now") == ("Fred.Bloggs#Was$Here^Ok&Now@Then%Now", False)
    assert [leaf(n) for n in ("//", "/", "")] == [("_dotdot_", True), ("_dot_", True), ("_empty_name_", True)]
    assert leaf("File", 0xFFFFEB00)[0] == "File,feb" and leaf("Dir", 0xFFFFEB00, True)[0] == "Dir"
    got = Ranges.parse("# c\n\n0x0 +\n0 0x117000 +\n0x117000 0x200 -\n").segments(0x116F00, 0x400)
    assert got == [(0x116F00, 0x100, True), (0x117000, 0x200, False), (0x117200, 0x100, True)]
    assert [literal(x) for x in ("0x1F", "017", "1_0", "0")] == [31, 15, 10, 0]
    with pytest.raises(RescueMapError):
        Ranges.parse("0 +\n1 2\n")


@pytest.mark.parametrize("seed", range(40))
def test_noise_never_crashes_a_decoder(seed):
    rnd = random.Random(seed)
    image = bytearray(rnd.choice([b.dfs(DISC), b.afs2(), b.afs3(), b.new_map({b"A": b.FILE})[0], b.new_map({b"A": b.FILE}, big=True)[0], bytes(5000), rnd.randbytes(5000)]))
    for _ in range(rnd.randrange(200)):
        image[rnd.randrange(min(len(image), 4096))] = rnd.randrange(256)
    try:
        for _, v in open_volumes(bytes(image)):
            list(extract(v, Options(broken_dirs="recover")))
    except Exception as e:  # refused, in a way that becomes a row
        assert isinstance(e, NotRecognised | Unsupported | ValueError | IndexError), e


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("images")
    images = {"a.ssd": b.dfs(DISC), "b.adf": b.new_map({b"A": b.FILE * 9, b"B": b"x"}, {b"A": 3})[0], "c.img": b.afs3("mux"), "d.bin": b"\x01" * 600}
    for n, d in images.items():
        (at / n).write_bytes(d)
    return at


def test_tables(spark, folder):
    images = read_images(spark, str(folder))
    volumes = {r.path.rsplit("/", 1)[1]: r.status for r in decode(images, "volumes").collect()}
    assert volumes == {"a.ssd": "ok", "b.adf": "ok", "c.img": "ok", "d.bin": "not_recognised"}
    for what in SCHEMAS:
        assert decode(images, what).schema == spark.createDataFrame([], SCHEMAS[what]).schema
        decode(images, what).count()
    content = decode(images, "content").collect()
    assert len(content) == 6 and all(zlib.crc32(r.bytes) == r.crc32 for r in content)
    v = decode(images, "verify").groupBy().sum("directories", "files", "unreadable").first()
    assert tuple(v) == (3, 6, 0)
    runs = decode(images, "extents").where("object_path = '$.A'").count()
    assert runs == 3


def test_source_and_stream(spark, folder, tmp_path):
    from platterlake.sources.spark_source import register
    from platterlake.streaming.arrivals import stream

    register(spark)
    got = spark.read.format("disc_image").option("path", str(folder)).option("table", "objects").load()
    assert got.where("not is_directory").count() == 6
    q = stream(spark, str(folder), "objects").writeStream.format("memory").queryName("arrived").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from arrived").count() == 6


def test_cli(spark, folder, tmp_path, capsys):
    from platterlake.cli import main

    assert main(["info", str(folder), "--format", "text"]) == 0
    assert "Disc name:       TESTDISC" in capsys.readouterr().out
    out = tmp_path / "out"
    assert main(["extract", str(folder / "a.ssd"), "--output", str(out), "--inf", "--log"]) == 0
    assert (out / "L.CODE").read_bytes() == b.FILE and (out / "!BOOT.inf").read_text().startswith("!BOOT 00001900")
    assert "extracted  $.!BOOT (7 bytes)" in (out / "extract.log").read_text()
    assert main(["info", str(folder / "d.bin")]) == 2 and main(["verify", str(folder / "a.ssd"), "--partition", "x"]) == 1
