"""What decoders give: entries, listings and volumes over one image held as bytes."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.columns import C1

Run = tuple[int, int]  # address, length
READ, WRITE, LOCKED, DIRECTORY, PUBLIC_READ, PUBLIC_WRITE = 1, 2, 4, 8, 16, 32
_CHARS = [chr(b) if not 0x80 <= b < 0xA0 else C1[b - 0x80] for b in range(256)]


class NotRecognised(Exception):
    """No decoder knows the image."""


class Unsupported(Exception):
    """A known format in a form that cannot be read right."""


def text(raw: bytes) -> str:
    return "".join(_CHARS[b] for b in raw)


def until(raw: bytes, stops: bytes) -> bytes:
    """``raw`` up to the first byte of ``stops``."""
    for i, b in enumerate(raw):
        if b in stops:
            return raw[:i]
    return raw


def number(raw: bytes) -> int:
    return int.from_bytes(raw, "little")


class Image:
    """An image; what lies past its end reads as zeros."""

    def __init__(self, data: bytes) -> None:
        self.data, self.size = data, len(data)

    def read(self, at: int, n: int) -> bytes:
        got = self.data[at : at + n] if at < self.size else b""
        return got + bytes(n - len(got))

    def gather(self, runs: list[Run], most: int = 1 << 31) -> bytes:
        if sum(n for _, n in runs) > most:
            raise ValueError("an object larger than the reader allows")
        return b"".join(self.read(a, n) for a, n in runs)


@dataclass
class Entry:
    name: str
    raw: bytes = b""
    load: int = 0
    exec: int = 0
    length: int = 0
    attrs: int = 0
    is_dir: bool = False
    runs: list[Run] = field(default_factory=list)
    sin: int | None = None
    stamped: int | None = None  # seconds since 1970, where the format tells
    side: int | None = None

    @property
    def filetype(self) -> int | None:
        return self.load >> 8 & 0xFFF if self.load >> 20 == 0xFFF else None

    @property
    def modified(self) -> int | None:
        if self.stamped is not None or self.filetype is None:
            return self.stamped
        return ((self.load & 255) << 32 | self.exec) // 100 - 2208988800


@dataclass
class Listing:
    entries: list[Entry] = field(default_factory=list)
    title: str = ""
    broken: bool = False
    anomalies: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def clip(runs: list[Run], skip: int = 0, most: int | None = None) -> list[Run]:
    """The bytes of ``runs`` from ``skip`` on, ``most`` of them at most."""
    out, left = [], most
    for at, n in runs:
        cut = min(skip, n)
        skip -= cut
        keep = n - cut if left is None else min(n - cut, left)
        if keep > 0:
            out.append((at + cut, keep))
            left = None if left is None else left - keep
    return out


def joined(runs: list[Run]) -> list[Run]:
    """``runs`` with those joined that touch, in their order."""
    out: list[Run] = []
    for at, n in runs:
        if out and sum(out[-1]) == at:
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append((at, n))
    return out


def by_tracks(start: int, length: int, per_track: int, place) -> list[Run]:
    """A logical run cut at tracks of 256-byte sectors, each part put where ``place`` says."""
    out, at, end = [], start, start + length
    while at < end:
        stop = min(end, (at // (per_track * 256) + 1) * per_track * 256)
        out.append((place(at // 256) * 256 + at % 256, stop - at))
        at = stop
    return joined(out)


class Volume:
    """A file system on an image.  ``label`` names it, ``info`` has the report's own fields."""

    label = ""

    def root(self) -> Entry:
        raise NotImplementedError

    def list(self, of: Entry, parent_sin: int | None = None) -> Listing:
        raise NotImplementedError

    def info(self) -> dict:
        raise NotImplementedError

    def faults(self) -> list[tuple[str, str, dict]]:
        """(code, message, payload) of what the volume's own structures have wrong."""
        return []
