"""Old-map and new-map discs with small, large and big directories."""

from __future__ import annotations

import struct
from collections import defaultdict
from dataclasses import dataclass, replace

from .model import DIRECTORY, Entry, Image, Listing, NotRecognised, Run, Unsupported, Volume, by_tracks, clip, number, text, until

# Fixed values of the formats.
SMALL, LARGE = 0x500, 0x800
TAIL = {
    SMALL: {"start": 0x4CB, "parent": 0x4D6, "title": 0x4D9, "seq": 0x4FA, "name": 0x4FB, "check": 0x4FF},
    LARGE: {"start": 0x7D7, "parent": 0x7DA, "title": 0x7DD, "seq": 0x7FA, "name": 0x7FB, "check": 0x7FF},
}
MOST = {SMALL: 47, LARGE: 77}
FLOPPY = {640: (40, 1), 1280: (80, 1), 2560: (80, 2)}
SIGNATURES = (b"Hugo", b"Nick")
GEOMETRY = ("log2_sector_size", "sectors_per_track", "heads", "idlen", "log2_bpmb", "low_sector", "nzones", "zone_spare", "disc_size")
MERGED = ("disc_id", "disc_name", "boot_option", "share_size", "format_version", "root_size")
_RECORD = struct.Struct("<10BHII H10sII 4B II8x")


@dataclass(frozen=True)
class Record:
    """A disc record, 60 bytes."""

    log2_sector_size: int
    sectors_per_track: int
    heads: int
    idlen: int
    log2_bpmb: int
    boot_option: int
    low_sector: int
    nzones: int
    zone_spare: int
    root_dir: int
    disc_size: int
    disc_id: int
    disc_name: bytes
    share_size: int
    format_version: int
    root_size: int

    @classmethod
    def parse(cls, raw: bytes) -> Record:
        ss, spt, heads, _, idlen, bpmb, _, boot, low, zones, spare, root, size, id_, name, _, size2, share, _, zones_hi, _, version, root_size = _RECORD.unpack(raw)
        return cls(ss, spt, heads, idlen, bpmb, boot, low, zones | zones_hi << 8, spare, root, size | size2 << 32, id_, name, share, version, root_size)

    def plausible(self) -> bool:
        return 8 <= self.log2_sector_size <= 12 and self.log2_bpmb <= 20 and bool(self.sectors_per_track or self.heads or self.root_dir)

    @property
    def sector(self) -> int:
        return 1 << self.log2_sector_size

    @property
    def sharing_unit(self) -> int:
        return self.sector << self.share_size

    def zone_bits(self, zone: int) -> int:
        return self.sector * 8 - self.zone_spare - (480 if zone == 0 else 0)

    def zone_base(self, zone: int) -> int:
        """Units before a zone."""
        return zone * (self.sector * 8 - self.zone_spare) - (480 if zone else 0)

    @property
    def map_addr(self) -> int:
        return self.zone_base(self.nzones // 2) << self.log2_bpmb


def zone_check(sector: bytes) -> int:
    total = carry = 0
    for (w,) in reversed(list(struct.iter_unpack("<I", sector))):
        total, carry = (total + w + carry) & 0xFFFFFFFF, (total + w + carry) >> 32
    return _folded(total - sector[0] & 0xFFFFFFFF)


def old_map_check(sector: bytes) -> int:
    """The check byte of one sector of an old map: from its end, with the carry added back."""
    total = 255
    for x in reversed(sector[:255]):
        total = (total + 1 & 255 if total > 255 else total) + x
    return total & 255


def boot_check(block: bytes) -> int:
    s = 0
    for b in block[:511]:
        s += b
        s = s + 1 & 255 if s > 255 else s
    return s


def dir_check(parts: list[int]) -> int:
    c = 0
    for x in parts:
        c = x ^ (c >> 13 | (c & 0x1FFF) << 19)
    return _folded(c)


def _folded(c: int) -> int:
    c ^= c >> 16
    return (c ^ c >> 8) & 255


def words_then_bytes(raw: bytes) -> list[int]:
    cut = len(raw) // 4 * 4
    return [*(w for (w,) in struct.iter_unpack("<I", raw[:cut])), *raw[cut:]]


def bytes_then_words(raw: bytes, at: int) -> list[int]:
    """``raw`` stands at ``at``: bytes up to a word's start, then whole words alone."""
    lead = min(-at % 4, len(raw))
    body = raw[lead:]
    return [*raw[:lead], *(w for (w,) in struct.iter_unpack("<I", body[: len(body) // 4 * 4]))]


class ZoneMap:
    """The new map: zones with their checks, and runs by fragment number.

    A zone is one whole number, bit 0 first, so a fragment's end is found by the lowest set
    bit instead of a walk over bits.
    """

    def __init__(self, image: Image, r: Record) -> None:
        self.record, self.ok, self.backups, self.checks, zones = r, [], [], [], []
        for z in range(r.nzones):
            copies = [image.read(r.map_addr + k * r.sector, r.sector) for k in (z, r.nzones + z)]
            good = [zone_check(c) == c[0] for c in copies]
            self.ok.append(any(good))
            self.backups.append(good[1] and not good[0])
            zones.append(copies[self.backups[-1]])
            self.checks.append(zones[-1][3])
        self.cross = 0
        for check in self.checks:
            self.cross ^= check
        self.zone0 = Record.parse(zones[0][4:64])
        self.runs: dict[int, list[Run]] = defaultdict(list)
        self._decode(zones)

    def _decode(self, zones: list[bytes]) -> None:
        r, open_ = self.record, None  # open_: a fragment that goes on in the next zone
        found: list[list[int]] = []  # id, unit, units
        for z, raw in enumerate(zones):
            bits, end = int.from_bytes(raw, "little"), len(raw) * 8
            head = 512 if z == 0 else 32
            free = self._free(bits, end, number(raw[1:3]))
            at = head
            if open_ is not None:
                stop = min(end, head + r.zone_spare)
                rest = bits >> at & (1 << stop - at) - 1
                step = (rest & -rest).bit_length() if rest else stop - at
                at += step
                open_[2] += step
                open_ = None
            while at + r.idlen <= end:
                id_ = bits >> at & (1 << r.idlen) - 1
                rest = bits >> at + r.idlen
                size = r.idlen + ((rest & -rest).bit_length() if rest else end - at - r.idlen)
                if not rest and at >= head + r.zone_bits(z):
                    break  # what is left over
                piece = [0 if at in free else id_, r.zone_base(z) + at - head, size]
                found.append(piece)
                if not rest:
                    open_ = piece if z + 1 < len(zones) else None
                    break
                at += size
        for id_, unit, units in found:
            if id_:
                self.runs[id_].append((unit << r.log2_bpmb, units << r.log2_bpmb))

    def _free(self, bits: int, end: int, link: int) -> set[int]:
        """Where the free chain's fragments start."""
        seen: set[int] = set()
        at = 8 + (link & 0x7FFF)
        while link != 0x8000 and at not in seen:
            seen.add(at)
            step = bits >> at & (1 << self.record.idlen) - 1
            if not step or at + self.record.idlen > end:
                break
            at += step
        return seen

    def resolve(self, id_: int, offset: int) -> list[Run] | None:
        """Runs of a fragment, from a sharing offset on; None if there is no such."""
        if id_ not in self.runs:
            return None
        return clip(self.runs[id_], (offset - 1) * self.record.sharing_unit if offset else 0)


class FileCore(Volume):
    label = "FileCore"

    def __init__(self, image: Image) -> None:
        self.image, self.record, self.map, self.boot = image, None, None, None
        self.tracks = None
        if image.read(0x201, 4) in SIGNATURES:
            self._old(0x200, SMALL)
        elif image.read(0x401, 4) in SIGNATURES:
            self._old(0x400, LARGE)
        else:
            self._new()

    def _old(self, root: int, size: int) -> None:
        self.map_type, self.dir_type, self.dir_size = "old", "old" if size == SMALL else "new", size
        s0, s1 = self.image.read(0, 256), self.image.read(256, 256)
        self.total, self.map_ok = number(s0[0xFC:0xFF]), [old_map_check(x) == x[0xFF] for x in (s0, s1)]
        name = bytes(x for pair in zip(s0[0xF7:0xFC], s1[0xF6:0xFB], strict=True) for x in pair)
        self.name, self.id, self.option = text(until(name, b"\0")), number(s1[0xFB:0xFD]), s1[0xFD]
        self.free = [(number(s0[k : k + 3]), number(s1[k : k + 3])) for k in range(0, min(s1[0xFE] // 3, 82) * 3, 3)]
        self.free = [x for x in self.free if x[1]]
        # Only these totals are floppies with their sides one behind the other.
        self.tracks = FLOPPY.get(self.total) if size == SMALL else None
        self.root_runs = [(root, size)]

    def _new(self) -> None:
        block = self.image.read(0xC00, 512)
        r = Record.parse(block[0x1C0:0x1FC])
        if r.plausible():
            self.boot = block
        else:
            r = Record.parse(self.image.read(4, 60))
            if not r.plausible():
                raise NotRecognised
        # Records that no map can follow are not this format, whatever else they say.
        if not r.idlen or not r.nzones or r.zone_bits(0) <= 0:
            raise NotRecognised
        if r.low_sector & 0x40:
            raise Unsupported("a new-map disc whose tracks are in sequence")
        self.map_type, self.map = "new", ZoneMap(self.image, r)
        self.record = r = replace(r, **{f: getattr(self.map.zone0, f) for f in MERGED})
        self.map.record = r
        self.dir_type, self.dir_size = ("big", r.root_size) if r.format_version == 1 else ("new", LARGE)
        id_, offset = r.root_dir >> 8 & 0xFFFF, r.root_dir & 255
        if id_ == 2:
            self.root_runs = [(r.map_addr + max(0, offset - 1) * r.sharing_unit, self.dir_size)]
        else:
            runs = self.map.resolve(id_, offset)
            if runs is None:
                raise Unsupported("root directory fragment not found in zone map")
            self.root_runs = runs if self.dir_type == "big" else clip(runs, 0, LARGE)

    def root(self) -> Entry:
        return Entry("$", b"$", attrs=DIRECTORY, is_dir=True, runs=self.root_runs, sin=self.record.root_dir if self.record else None)

    def _runs(self, e: Entry, sin: int, out: Listing) -> list[Run]:
        """Where an entry's bytes are; what can't be found is noted."""
        if self.map_type == "old":
            size = self.dir_size if e.is_dir else e.length
            if not self.tracks:
                return clip([(sin * 256, size)])
            tracks, heads = self.tracks
            side = lambda s: divmod(s // 16, tracks)
            return by_tracks(sin * 256, size, 16, lambda s: s % 16 + (side(s)[1] * heads + side(s)[0]) * 16)
        id_ = sin >> 8 if self.dir_type == "big" else sin >> 8 & 0xFFFF
        if not id_ and not e.is_dir:
            return []
        runs = self.map.resolve(id_, sin & 255)
        if runs is None:
            out.anomalies.append(f"{e.name}: {'subdirectory ' if e.is_dir else ''}fragment id {id_} not found in zone map")
            return []
        if self.dir_type == "big":
            if id_ > 0xFFFF:
                out.anomalies.append(f"{e.name}: big-dir fragment id {id_:#x} exceeds 16 bits")
            return runs if e.is_dir else clip(runs, 0, e.length)
        return clip(runs, 0, LARGE if e.is_dir else e.length)

    def list(self, of: Entry, parent_sin: int | None = None) -> Listing:
        raw, out = self.image.gather(of.runs, 1 << 28), Listing()
        parent = self._big(raw, out) if self.dir_type == "big" else self._fixed(raw, out)
        if parent is None:
            out.broken = True
            return out
        keys = [e.raw.lower() for e in out.entries]
        if keys != sorted(keys):
            out.warnings.append("directory entries are not in case-insensitive collation order")
        if self.map_type == "new" and parent_sin is not None and parent != parent_sin:
            width = 8 if self.dir_type == "big" else 6
            out.warnings.append(f"directory parent SIN mismatch: stored {parent:#0{width}x}, expected {parent_sin:#0{width}x}")
        return out

    def _add(self, out: Listing, e: Entry, sin: int) -> None:
        e.is_dir = bool(e.attrs & DIRECTORY)
        if self.map_type == "new":
            e.sin = sin
            id_ = sin >> 8 if self.dir_type == "big" else sin >> 8 & 0xFFFF
            if not e.is_dir and not e.length and id_:
                out.warnings.append(f"{e.name}: zero-length file recorded with fragment id {id_} (must be 0, no disc space)")
        e.runs = self._runs(e, sin, out)
        out.entries.append(e)

    def _checked(self, out: Listing, seq: tuple[int, int], names: list[tuple[bool, str]], stored: int, computed: int, zero_passes: bool) -> None:
        """Notes what is wrong at a directory's ends and whether that breaks it."""
        wrong = [what for ok, what in names if not ok]
        if seq[0] != seq[1]:
            wrong.append(f"sequence number mismatch: header={seq[0]:#04x} tail={seq[1]:#04x}")
        if stored != computed and not (zero_passes and stored == 0):
            wrong.append(f"directory check byte mismatch: computed={computed:#04x} stored={stored:#04x}")
        out.anomalies += wrong
        out.broken = out.broken or bool(wrong)

    def _fixed(self, raw: bytes, out: Listing) -> int | None:
        size = self.dir_size
        small, t = size == SMALL, TAIL[size]
        if len(raw) < size:
            out.anomalies.append(f"directory data truncated: expected {size} bytes, got {len(raw)}")
            return None
        used = next((i for i in range(MOST[size]) if raw[5 + 26 * i] == 0), MOST[size])
        for i in range(used):
            field, load, exec_, length, sin, attrs = struct.unpack("<10sIII3sB", raw[5 + 26 * i : 31 + 26 * i])
            if small:  # attributes are the name's top bits
                attrs = sum((b >> 7) << k for k, b in zip((0, 1, 2, 3, 6), field, strict=False))
                field = bytes(b & 0x7F for b in field)
            name = until(field, b"\0\r")
            self._add(out, Entry(text(name), name, load, exec_, length, attrs), number(sin))
        if raw[t["start"]]:
            out.anomalies.append("tail end-marker byte is not 0x00")
        head, tail = raw[: 5 + 26 * used], raw[t["start"] + 1 : size - 4]
        check = dir_check(words_then_bytes(head) + bytes_then_words(tail, t["start"] + 1))
        same = raw[1:5] == raw[t["name"] : t["name"] + 4]
        self._checked(out, (raw[0], raw[t["seq"]]), [(same, "start/end validation name mismatch (Broken directory)")], raw[t["check"]], check, True)
        out.title = text(until(raw[t["title"] : t["title"] + 19], b"\0"))
        return number(raw[t["parent"] : t["parent"] + 3])

    def _big(self, raw: bytes, out: Listing) -> int | None:
        if len(raw) < 28:
            out.anomalies.append(f"directory data too short to contain a header: expected at least 28 bytes, got {len(raw)}")
            return None
        name_size, size, count, heap_size, parent = struct.unpack("<5I", raw[8:28])
        out.title = text(raw[28 : 28 + name_size])
        first = 28 + (name_size + 4) // 4 * 4
        heap = first + 28 * count
        end, tail = heap + heap_size, max(0, size - 8)
        if len(raw) >= end:  # else the count is no guide to what is there
            for i in range(count):
                load, exec_, length, sin, attrs, n, at = struct.unpack("<7I", raw[first + 28 * i : first + 28 * i + 28])
                name = raw[heap + at : heap + at + n]
                if heap + at + n > len(raw):
                    name = b""
                    out.anomalies.append(f"entry {i}: name heap offset out of range")
                self._add(out, Entry(text(name), name, load, exec_, length, attrs), sin)
        else:
            out.anomalies.append(f"directory data truncated: need {end} bytes for entries+heap, got {len(raw)}")
        start = (raw[4:8] == b"SBPr", 'big directory start signature is not "SBPr"')
        if len(raw) >= max(size, 8) and tail >= end:
            check = dir_check(words_then_bytes(raw[:end]) + words_then_bytes(raw[tail : tail + 7]))
            ends = [start, (raw[tail : tail + 4] == b"oven", 'big directory end signature is not "oven"')]
            self._checked(out, (raw[0], raw[tail + 4]), ends, raw[tail + 7], check, False)
        else:
            self._checked(out, (0, 0), [start, (False, "directory data too short to contain a valid tail")], 0, 0, False)
        return parent

    def info(self) -> dict:
        out = {"filesystem": "FileCore", "map_type": self.map_type, "dir_type": self.dir_type, "boot_block_present": self.boot is not None}
        if self.map_type == "old":
            return out | {"disc_name": self.name, "disc_id": self.id, "boot_option": self.option, "disc_size": self.total * 256 if self.total in FLOPPY else self.image.size}
        r, m = self.record, self.map
        boot_ok = None if self.boot is None else boot_check(self.boot) == self.boot[511]
        return out | {"disc_name": text(until(r.disc_name, b"\0")), "disc_id": r.disc_id, "disc_size": r.disc_size, "sector_size": r.sector, "boot_option": r.boot_option, "boot_block_checksum_ok": boot_ok, "zone_checksum_ok_count": sum(m.ok), "zone_checksum_total": len(m.ok), "cross_check_ok": m.cross == 255}

    def faults(self) -> list[tuple[str, str, dict]]:
        out = []
        if self.map:
            out += [("zone_checksum_mismatch", f"zone {z} checksum mismatch", {"zone": z}) for z, ok in enumerate(self.map.ok) if not ok]
            if self.map.cross != 255:
                out.append(("zone_cross_check_mismatch", f"zone CrossCheck XOR is {self.map.cross:#04x}, expected 0xff", {"stored": self.map.cross, "computed": 255}))
            for f in GEOMETRY:
                a, b = getattr(self.record, f), getattr(self.map.zone0, f)
                if a != b:
                    what = f"disc record {f} differs between boot block ({a}) and zone 0 ({b}); keeping boot-block geometry"
                    out.append(("disc_record_geometry_mismatch", what, {"field": f, "boot": str(a), "zone0": str(b)}))
        if self.boot is not None and boot_check(self.boot) != self.boot[511]:
            stored, computed = self.boot[511], boot_check(self.boot)
            out.append(("boot_block_checksum_mismatch", f"boot block checksum mismatch: stored {stored:#04x}, computed {computed:#04x}", {"stored": stored, "computed": computed}))
        return out
