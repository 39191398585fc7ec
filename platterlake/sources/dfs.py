"""Single- and double-sided catalogue discs, with the 62-file extension."""

from __future__ import annotations

from .model import DIRECTORY, LOCKED, Entry, Image, Listing, NotRecognised, Run, Volume, by_tracks, number, text, until

PER_TRACK, BLOCK = 10, 31


def place(double: bool, side: int, start: int, length: int) -> list[Run]:
    """Image runs of a side's logical run; the sides of a double-sided disc alternate by track."""
    if not double:
        return [(start, length)] if length else []
    return by_tracks(start, length, PER_TRACK, lambda s: s % PER_TRACK + (s // PER_TRACK * 2 + side) * PER_TRACK)


class Catalogue:
    def __init__(self, image: Image, double: bool, side: int) -> None:
        s = [image.gather(place(double, side, k * 256, 256)) for k in range(4)]
        self.head, self.blank = s[:2], not any(s[0] + s[1])
        self.title = text(s[0][:8] + s[1][:4]).rstrip("\0 ")
        self.boot, self.declared = s[1][6] >> 4 & 3, (s[1][6] & 7) << 8 | s[1][7]
        self.sectors = self.declared or 0x320
        self.watford = s[2][:8] == b"\xaa" * 8 and s[3][:4] == bytes(4)
        self.files = self._files(s[0], s[1])
        if self.watford:
            self.files += self._files(s[2], s[3])

    @staticmethod
    def _files(names: bytes, info: bytes) -> list[tuple[Entry, int]]:
        """(entry, first sector); the entry has no runs yet."""
        out = []
        for at in range(8, 8 + 8 * min(info[5] // 8, BLOCK), 8):
            n, e = names[at : at + 8], info[at : at + 8]
            high = e[6]
            wide = lambda v, two: (two * 0x55) << 16 | v  # noqa: E731  the two high bits fill a byte
            letter, raw, plain = n[7] & 0x7F, until(n[:7], b"\0 "), text(n[:7]).rstrip("\0 ")
            if letter not in b"$ ":
                raw, plain = bytes((letter, 0x2E)) + raw, f"{text(bytes((letter,)))}.{plain}"
            entry = Entry(plain, raw, wide(number(e[0:2]), high >> 2 & 3), wide(number(e[2:4]), high >> 6), number(e[4:6]) | (high >> 4 & 3) << 16, LOCKED if n[7] & 0x80 else 0)
            out.append((entry, e[7] | (high & 3) << 8))
        return out

    def plausible(self) -> bool:
        """Titles without control characters and unused bits clear.  The last includes bit 2
        of the size, so discs that need it are not taken for this format."""
        s0, s1 = self.head
        return all(b > 0x1F or b == 0 for b in s0[:8] + s1[:4]) and s1[5] & 7 == 0 and s1[6] & 0xCC == 0

    def mostly_within(self, size: int) -> bool:
        """At most half of the files end beyond ``size`` bytes."""
        return 2 * sum(s * 256 + e.length > size for e, s in self.files) <= len(self.files)


class Dfs(Volume):
    label = "DFS"

    def __init__(self, image: Image) -> None:
        self.image = image
        first = Catalogue(image, False, 0)
        if not first.plausible() or not first.mostly_within(first.sectors * 256):
            raise NotRecognised
        other = Catalogue(image, True, 1)
        self.double = other.plausible() and not other.blank and 0 < other.declared <= image.size // 256 and other.mostly_within(image.size)
        self.sides = [Catalogue(image, True, 0), other] if self.double else [first]

    def root(self) -> Entry:
        return Entry("$", b"$", attrs=DIRECTORY, is_dir=True)

    def list(self, of: Entry, parent_sin: int | None = None) -> Listing:
        if self.double and of.side is None:
            return Listing([Entry(n, n.encode(), attrs=DIRECTORY | 1 << 31 | k << 8, is_dir=True, side=k) for k, n in enumerate(("Side0", "Side1"))], self.sides[0].title)
        side = of.side or 0
        out = Listing(title=self.sides[side].title)
        for e, sector in self.sides[side].files:
            if sector * 256 + e.length > self.image.size:
                out.anomalies.append(f"{e.name}: start sector {sector} + length {e.length:#x} exceeds disc size ({self.image.size} bytes)")
            else:
                e.runs = place(self.double, side, sector * 256, e.length)
                out.entries.append(e)
        out.broken = bool(out.anomalies)
        return out

    def info(self) -> dict:
        total = sum(c.sectors for c in self.sides)
        warn = [] if total * 256 == self.image.size else [f"catalogue total_sectors ({total} sectors / {total * 256} bytes) diverges from the image size ({self.image.size} bytes)"]
        # Listings of this format are checked against the image, so none is reported broken.
        return {"filesystem": "DFS", "map_type": "n/a", "dir_type": "double-sided" if self.double else "single-sided", "disc_name": self.sides[0].title, "disc_size": total * 256, "sector_size": 256, "boot_option": self.sides[0].boot, "broken_directories": [], "directory_warnings": warn}
