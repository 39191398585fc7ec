"""Small images of every format, built byte by byte."""

import struct

from platterlake.sources import filecore as fc

FILE = bytes(i % 251 for i in range(3 * 256 + 40))


def put(image: bytearray, at: int, data: bytes) -> None:
    if len(image) < at + len(data):
        image.extend(bytes(at + len(data) - len(image)))
    image[at : at + len(data)] = data


def dfs_catalogue(title: bytes, files, sectors: int, watford=()) -> bytes:
    """files: (name, dir, locked, load, exec, length, sector)."""

    def block(rows):
        names, info = b"", b""
        for name, letter, locked, load, exec_, length, sector in rows:
            names += name.ljust(7) + bytes((ord(letter) | (0x80 if locked else 0),))
            high = (load >> 16 & 3) << 2 | (exec_ >> 16 & 3) << 6 | (length >> 16) << 4 | sector >> 8
            info += struct.pack("<HHHBB", load & 0xFFFF, exec_ & 0xFFFF, length & 0xFFFF, high, sector & 255)
        return names.ljust(248, b"\0"), info.ljust(248, b"\0")

    t = title.ljust(12, b"\0")
    n, i = block(files)
    out = t[:8] + n + t[8:] + bytes((1, len(files) * 8, sectors >> 8, sectors & 255)) + i
    if watford:
        n, i = block(watford)
        out += b"\xaa" * 8 + n + bytes(5) + bytes((len(watford) * 8, 0, 0)) + i
    return out


def dfs(files: dict, sectors=800, title=b"TESTDISC") -> bytes:
    image, rows, at = bytearray(sectors * 256), [], 2
    for (name, letter, locked), data in files.items():
        rows.append((name, letter, locked, 0x1900, 0x8023, len(data), at))
        put(image, at * 256, data)
        at += -(-len(data) // 256)
    put(image, 0, dfs_catalogue(title, rows, sectors))
    return bytes(image)


def large_dir(entries, parent: int, small=False, title=b"Title") -> bytes:
    """entries: (name, load, exec, length, sin, attrs), in order."""
    size = fc.SMALL if small else fc.LARGE
    t, raw = fc.TAIL[size], bytearray(size)
    raw[0:5] = b"\x07Hugo"
    for k, (name, load, exec_, length, sin, attrs) in enumerate(entries):
        field = bytearray(name.ljust(10, b"\r"))
        if small:
            for bit in range(4):
                field[bit] |= 0x80 if attrs >> bit & 1 else 0
        put(raw, 5 + 26 * k, bytes(field) + struct.pack("<III", load, exec_, length) + sin.to_bytes(3, "little") + bytes((0 if small else attrs,)))
    put(raw, t["parent"], parent.to_bytes(3, "little"))
    put(raw, t["title"], title.ljust(19, b"\0"))
    raw[t["seq"]] = 7
    put(raw, t["name"], b"Hugo")
    used = len(entries)
    raw[t["check"]] = fc.dir_check(fc.words_then_bytes(bytes(raw[: 5 + 26 * used])) + fc.bytes_then_words(bytes(raw[t["start"] + 1 : size - 4]), t["start"] + 1))
    return bytes(raw)


def big_dir(entries, parent: int, size=0x800, name=b"$") -> bytes:
    raw, heap, table = bytearray(size), b"", b""
    for n, load, exec_, length, sin, attrs in entries:
        table += struct.pack("<7I", load, exec_, length, sin, attrs, len(n), len(heap))
        heap += n + b"\r" + bytes(-(len(n) + 1) % 4)
    put(raw, 0, b"\x03\0\0\0SBPr" + struct.pack("<5I", len(name), size, len(entries), len(heap), parent))
    put(raw, 28, name + b"\r" + bytes(-(len(name) + 1) % 4))
    first = 28 + (len(name) + 4) // 4 * 4
    put(raw, first, table + heap)
    end = first + len(table) + len(heap)
    put(raw, size - 8, b"oven\x03\0\0")
    raw[size - 1] = fc.dir_check(fc.words_then_bytes(bytes(raw[:end])) + fc.words_then_bytes(bytes(raw[size - 8 : size - 1])))
    return bytes(raw)


def old_map(total: int, root: bytes, files: list, size: int, root_at=0x200) -> bytes:
    """files: (image runs, data)."""
    image = bytearray(size)
    s0, s1 = bytearray(256), bytearray(256)
    s0[0:3], s1[0:3], s1[0xFE] = (100).to_bytes(3, "little"), (50).to_bytes(3, "little"), 3
    for k, c in enumerate(b"OldDiscNam"):
        (s0 if k % 2 == 0 else s1)[(0xF7 if k % 2 == 0 else 0xF6) + k // 2] = c
    s0[0xFC:0xFF] = total.to_bytes(3, "little")
    s1[0xFB:0xFD] = (0x1234).to_bytes(2, "little")
    s1[0xFD] = 2
    put(image, 0, bytes(s0 + s1))
    put(image, root_at, root)
    for runs, data in files:
        at = 0
        for a, n in runs:
            put(image, a, data[at : at + n])
            at += n
    return bytes(image)


def record(log2ss=10, idlen=15, log2bpmb=7, nzones=1, spare=0, root=0x203, size=0, version=0, root_size=0, low=0, name=b"TestDisc  ") -> bytes:
    return struct.pack("<10BHIIH10sII4BII8x", log2ss, 5, 2, 2, idlen, log2bpmb, 0, 1, low, nzones, spare, root, size, 0xABCD, name, 0, 0, 0, int(version), 0, 0, version, root_size)


def new_map(files: dict, pieces=None, big=False, nzones=1, low=0, spare=32) -> tuple[bytes, dict]:
    """A disc whose root has ``files``; pieces: how many fragments each has, dealt in turn.
    Returns the image and the contents by name."""
    ss, log2bpmb, idlen = 1024, 7, 12
    bpmb = 1 << log2bpmb
    r = fc.Record.parse(record(idlen=idlen, log2bpmb=log2bpmb, nzones=nzones, spare=spare))
    size = (r.zone_base(nzones - 1) + r.zone_bits(nzones - 1)) * bpmb
    map_units = -(-(2 * nzones * ss + 0x800) // bpmb)
    entries, content, plan = [], {}, []
    base_unit = r.zone_base(nzones // 2)
    if base_unit:
        plan.append((1, idlen + 1))
        fill = base_unit - (idlen + 1)
        plan.append((0, fill)) if fill > idlen else None
    for k, (name, data) in enumerate(files.items()):
        n = (pieces or {}).get(name, 1)
        unit = max(idlen + 1, -(-len(data) // bpmb // n) + 1)
        content[name] = (3 + k, [unit] * n, data)
    rounds = max((len(c[1]) for c in content.values()), default=0)
    order = [(c[0], c[1][i]) for i in range(rounds) for c in content.values() if i < len(c[1])]
    # The map and the root lie in zone nzones // 2; objects follow it there.
    bits = [0] * nzones
    placed, at_zone, at = {}, nzones // 2, 0

    def mark(zone, unit, id_, units):
        head = 512 if zone == 0 else 32
        bits[zone] |= id_ << head + unit | 1 << head + unit + units - 1

    for z in range(nzones):
        if z != at_zone:
            mark(z, 0, 2 if z == 0 and at_zone else 1, r.zone_bits(z))
    mark(at_zone, 0, 2, map_units)
    at = map_units
    image = bytearray(size)
    for id_, units in order:
        mark(at_zone, at, id_, units)
        placed.setdefault(id_, []).append(((r.zone_base(at_zone) + at) * bpmb, units * bpmb))
        at += units
    left = r.zone_bits(at_zone) - at
    free = 0x8000
    if left > idlen:
        mark(at_zone, at, 0, left)
        free = ((512 if at_zone == 0 else 32) + at - 8) | 0x8000
    root_sin = 2 << 8 | (2 * nzones + 1)
    for name, (id_, _, data) in content.items():
        rest = data
        for a, n in placed[id_]:
            put(image, a, rest[:n])
            rest = rest[n:]
        entries.append((name, 0xFFFFFF00 | 0x12, 0x34567890, len(data), id_ << 8, 3))
    root = big_dir(entries, root_sin) if big else large_dir(entries, root_sin)
    rec = record(idlen=idlen, log2bpmb=log2bpmb, nzones=nzones, spare=spare, root=root_sin, size=size, version=int(big), root_size=0x800 if big else 0, low=low)
    for copy in range(2):
        for z in range(nzones):
            raw = bytearray(bits[z].to_bytes(ss + 8, "little")[:ss])
            raw[1:3] = (free if z == at_zone else 0x8000).to_bytes(2, "little")
            raw[3] = 0xFF if z == 0 else 0
            if z == 0:
                raw[4:64] = rec
            raw[0] = fc.zone_check(bytes(raw))
            put(image, r.map_addr + (copy * nzones + z) * ss, bytes(raw))
    put(image, r.map_addr + 2 * nzones * ss, root)
    if nzones > 1 or r.map_addr:
        boot = bytearray(512)
        boot[0x1C0:0x1FC] = rec
        boot[511] = fc.boot_check(bytes(boot))
        put(image, 0xC00, bytes(boot))
    return bytes(image[:size]), {n.decode(): c[2] for n, c in content.items()}


def afs_dir(title: bytes, entries) -> bytes:
    """entries: (name, load, exec, nfs, date, sin)."""
    raw = bytearray(512)
    raw[3:13] = title.ljust(10)
    raw[15] = len(entries)
    at = 0x40
    raw[0:2] = (at if entries else 0).to_bytes(2, "little")
    for k, (name, load, exec_, nfs, day, sin) in enumerate(entries):
        after = 0 if k == len(entries) - 1 else at + 40
        put(raw, at, struct.pack("<H10sIIBH", after, name.ljust(10), load, exec_, nfs, day) + sin.to_bytes(3, "little"))
        at += 40
    return bytes(raw)


def afs3(order="seq", spt=16) -> bytes:
    from platterlake.sources.fileserver import place

    image = bytearray(256 * 2600)
    sector = lambda s, d: put(image, place(s, spt, order) * 256, d)
    s0 = bytearray(256)
    s0[0xF6:0xF9] = (1).to_bytes(3, "little")
    put(image, 0, bytes(s0))
    info = bytearray(256)
    info[0:20] = b"AFS0" + b"Level3".ljust(16)
    info[0x16:0x19] = (1000).to_bytes(3, "little")
    info[0x1A:0x1C] = spt.to_bytes(2, "little")
    info[0x1F:0x22] = (52).to_bytes(3, "little")
    sector(1, bytes(info))

    def jes(groups, low):
        raw = bytearray(256)
        raw[0:6], raw[8] = b"JesMap", low
        for k, (s, n) in enumerate(groups):
            raw[10 + 5 * k : 15 + 5 * k] = s.to_bytes(3, "little") + n.to_bytes(2, "little")
        return bytes(raw)

    sector(52, jes([(53, 1), (54, 1)], 0))
    d = afs_dir(b"$", [(b"DATA", 0xFF0E00, 0xFF802B, 0x0C, 0x910F, 20), (b"HELLO", 1, 2, 0x1F, 0, 30)])
    sector(53, d[:256])
    sector(54, d[256:])
    sector(20, jes([(21, 1), (40, 1)], 3))
    sector(21, FILE[:256])
    sector(40, FILE[256:512])
    sector(30, jes([(31, 1)], 13))
    sector(31, b"Hello, world!")
    return bytes(image)


def afs2() -> bytes:
    image = bytearray(256 * 40)
    info = b"AFS0" + b"Level2".ljust(16) + (20).to_bytes(2, "little") + (5).to_bytes(3, "little") + bytes(2) + (1).to_bytes(3, "little") + (2).to_bytes(3, "little") + b"\1"
    put(image, 0, info)
    for copy, current in ((1, 1), (2, 0)):
        m = bytearray(85)
        m[0] = current
        chain = {5: 6, 6: 0x4000, 10: 11, 11: 0x4000 | 3, 12: 0x4000 | 13}
        for s, e in chain.items():
            m[s * 2 + 5 : s * 2 + 7] = e.to_bytes(2, "little")
        put(image, copy * 256, bytes(m))
    put(image, 5 * 256, afs_dir(b"$", [(b"DATA", 1, 2, 0x0C, 0x323D, 10), (b"HELLO", 3, 4, 0x03, 5, 12)]))
    put(image, 10 * 256, FILE[:259])
    put(image, 12 * 256, b"Hello, world!")
    return bytes(image)
