"""Level 2 and level 3 file-server discs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from itertools import takewhile

from .model import DIRECTORY, Entry, Image, Listing, NotRecognised, Run, Volume, clip, number, text, until

ORDERS = ("seq", "int", "mux")
MAPS_FOLLOWED = 8


def place(s: int, spt: int, order: str) -> int:
    """The image sector of a logical one."""
    if order == "seq" or not spt:
        return s
    t, r = divmod(s, spt)
    side, track = (t // 80, t % 80) if order == "int" else divmod(t, 2)
    return (track * 2 + side if order == "int" else (t % 2) * 80 + t // 2) * spt + r


def date(packed: int) -> int | None:
    low, high = packed & 255, packed >> 8
    try:
        return int(datetime(1981 + (low >> 5) * 16 + (high >> 4), high & 15, low & 31, tzinfo=UTC).timestamp())
    except ValueError:
        return None


def access(nfs: int) -> int:
    return (nfs & 3) << 4 | nfs >> 2 & 3 | (nfs & 16) >> 2 | (nfs & 32) >> 2


def decode_directory(raw: bytes) -> Listing:
    """The linked list of a directory; entries have their number but no runs yet."""
    if len(raw) < 16:
        return Listing(broken=True, anomalies=["directory data truncated"])
    count, at = raw[15], number(raw[:2])
    out = Listing(title=text(until(raw[3:13], b" \0")))
    if count and not at:
        out.broken = True
        out.anomalies.append("directory declares entries but has a zero first-entry pointer")
        return out
    for _ in range(count + 1):
        if not at:
            break
        if at + 26 > len(raw):
            out.broken = True
            out.anomalies.append(f"entry at offset &{at:X} lies beyond directory data (&{len(raw):X})")
            break
        e = raw[at : at + 26]
        at, name, attrs = number(e[:2]), until(e[2:12], b" \0"), access(e[20])
        if name and at != 0xFFFF:
            out.entries.append(Entry(text(name), name, number(e[12:16]), number(e[16:20]), 0, attrs, bool(attrs & DIRECTORY), [], number(e[23:26]), date(number(e[21:23]))))
        if at == 0xFFFF:
            break
    return out


#: Parts of a level 2 map entry: fixed values of the format.
LINK, EMPTY, LAST = 0xFFF, 0x1000, 0x4000


def follow(first: int, after: Callable[[int], int | None], most: int) -> Iterator[int]:
    """``first`` and the nodes behind it, up to one that has none or links to itself.  ``most``
    ends a circle; how often a circle is gone round decides results, so the two numbers given
    here are fixed values: twice a side's sectors and 4, and MAPS_FOLLOWED."""
    at: int | None = first
    for _ in range(most):
        yield at
        to = after(at)
        if to is None or to == at:
            return
        at = to


class FileServer(Volume):
    """``level`` 2 follows a chain of 12-bit map entries, 3 follows allocation maps."""

    def __init__(self, image: Image, level: int, block: bytes, spt: int, order: str) -> None:
        self.image, self.level, self.spt, self.order = image, level, spt, order
        self.title, self.label = text(until(block[4:20], b" \0")), f"AFS{level}"
        self.map = b""
        if level == 2:
            self.per_side, self.root_sin = number(block[0x14:0x16]), number(block[0x16:0x19])
            self.size = self.per_side * 512
            copies = [self._map(number(block[k : k + 3])) for k in (0x1B, 0x1E)]
            self.map = max(copies, key=lambda m: m[0])  # the first where both say the same
        else:
            self.root_sin, self.size = number(block[0x1F:0x22]), number(block[0x16:0x19]) * 256

    def _sector(self, s: int) -> bytes:
        return self.image.read(place(s, self.spt, self.order) * 256, 256)

    def _map(self, sin: int) -> bytes:
        size = self.per_side * 4 + 5
        return b"".join(self._sector(sin + i) for i in range(-(-size // 256)))[:size]

    def _runs(self, sin: int, is_dir: bool) -> list[Run]:
        return self._chain(sin & LINK, is_dir) if self.level == 2 else self._maps(sin, is_dir)

    def _chain(self, first: int, is_dir: bool) -> list[Run]:
        """Runs of a level 2 object: the sectors of its chain of map entries."""
        links = memoryview(self.map)[5 : 5 + (len(self.map) - 5) // 2 * 2]
        table = [number(links[k : k + 2]) for k in range(0, len(links), 2)] if self.map else []
        entry = lambda at: table[at] if at < len(table) else 0

        def used(e: int) -> int:
            if e & LAST and not is_dir:
                return e & 255 or 256
            return 0 if e & EMPTY else 256

        chain = follow(first, lambda at: None if entry(at) & LAST else entry(at) & LINK, self.per_side * 2 + 4)
        return [(place(at, self.spt, self.order) * 256, used(entry(at))) for at in chain if used(entry(at))]

    def _maps(self, sin: int, is_dir: bool) -> list[Run]:
        """Runs of a level 3 object: the groups of its allocation maps, less what the last sector lacks."""
        maps = [self._sector(at) for at in follow(sin, lambda at: number(self._sector(at)[0xFA:0xFD]) or None, MAPS_FOLLOWED)]
        runs: list[Run] = []
        for block in (m for m in maps if m[:6] == b"JesMap"):
            groups = ((number(block[p : p + 3]), number(block[p + 3 : p + 5])) for p in range(10, 0xF6, 5))
            runs += [(place(at, self.spt, self.order) * 256, n * 256) for at, n in takewhile(all, groups)]
        lacking = 256 - maps[0][8] if maps[0][8] and not is_dir else 0
        return clip(runs, 0, max(0, sum(n for _, n in runs) - lacking)) if lacking else runs

    def root(self) -> Entry:
        return Entry("$", b"$", attrs=DIRECTORY, is_dir=True, runs=self._runs(self.root_sin, True), sin=self.root_sin)

    def list(self, of: Entry, parent_sin: int | None = None) -> Listing:
        out = decode_directory(self.image.gather(of.runs))
        for e in out.entries:
            e.runs = self._runs(e.sin, e.is_dir)
            e.length = sum(n for _, n in e.runs)
        return out

    def credible(self) -> bool:
        """Its root decodes and has a title or entries, which zeros read as a root have not."""
        top = self.list(self.root())
        return not top.broken and bool(top.title or top.entries)

    def info(self) -> dict:
        return {"filesystem": self.label, "map_type": "allocation-map" if self.level == 2 else "jesmap", "dir_type": "sequential", "disc_name": self.title, "disc_size": self.size, "sector_size": 256}


def open_fileserver(image: Image) -> FileServer:
    """Level 2 if sector 0 is its block, else level 3 where the free map points; sector
    orders are tried until the root is credible."""
    first = image.read(0, 256)
    if first[:4] == b"AFS0":
        tried = [FileServer(image, 2, first, 10, o) for o in ORDERS]
        return next((v for v in tried if v.credible()), tried[0])
    at = number(first[0xF6:0xF9])
    for order in ORDERS:
        for spt in (16, 10):
            block = image.read(place(at, spt, order) * 256, 256)
            if block[:4] == b"AFS0":
                v = FileServer(image, 3, block, number(block[0x1A:0x1C]) or spt, order)
                if v.credible():
                    return v
    raise NotRecognised
