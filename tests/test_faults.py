"""What tables tell of damaged maps and records."""

import builder as b
import mmap

from platterlake.sources import filecore as fc
from platterlake.sources.disc import Options, _rows, open_volumes


def rows(data, what):
    return list(_rows("p", data, what, Options()))


def test_zones_tell_which_copy_served():
    image, _ = b.new_map({b"A": b.FILE}, nzones=2)
    record = open_volumes(image)[0][1].record
    zones = rows(image, "zones")
    assert [(z["check_ok"], z["used_backup"]) for z in zones] == [(True, False)] * 2
    assert zones[0]["cross_check"] ^ zones[1]["cross_check"] == 255
    bad = bytearray(image)
    bad[record.map_addr + 200] ^= 1
    assert [(z["check_ok"], z["used_backup"]) for z in rows(bytes(bad), "zones")] == [(True, True), (True, False)]


def test_old_maps_tell_their_checksums():
    root = b.large_dir([(b"One", 1, 2, 300, 40, 3)], 0, small=True)
    image = bytearray(b.old_map(5000, root, [([(40 * 256, 300)], b.FILE[:300])], 100_000))
    for at in (0, 256):
        image[at + 255] = fc.old_map_check(bytes(image[at : at + 256]))
    (row,) = rows(bytes(image), "old_maps")
    assert row["sector0_checksum_ok"] and row["sector1_checksum_ok"] and row["total_sectors"] == 5000
    image[3] ^= 1
    (row,) = rows(bytes(image), "old_maps")
    assert not row["sector0_checksum_ok"] and row["sector1_checksum_ok"]
    assert len(rows(bytes(image), "free_extents")) == row["free_extents"]


def test_diagnostics_carry_what_they_tell():
    image, _ = b.new_map({b"A": b.FILE}, nzones=2)
    record = open_volumes(image)[0][1].record
    bad = bytearray(image)
    for copy in (0, record.nzones):
        bad[record.map_addr + copy * record.sector + 200] ^= 1
    found = {r["code"]: r for r in rows(bytes(bad), "diagnostics")}
    assert found["zone_checksum_mismatch"]["zone"] == 0 and found["zone_checksum_mismatch"]["severity"] == "warning"
    if open_volumes(image)[0][1].boot is not None:
        bad = bytearray(image)
        bad[0xC00 + 511] ^= 1
        fault = {r["code"]: r for r in rows(bytes(bad), "diagnostics")}["boot_block_checksum_mismatch"]
        assert fault["stored"] ^ fault["computed"] == 1


def test_images_are_read_by_seeking(tmp_path):
    (tmp_path / "a").write_bytes(b.dfs({(b"F", "$", False): b.FILE}))
    with open(tmp_path / "a", "rb") as f:
        image = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    assert [r["bytes"] for r in _rows("p", image, "content", Options())] == [b.FILE]
