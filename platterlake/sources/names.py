"""Host names and sidecar lines, the worker's forms of the column functions."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from ..functions.columns import HOST, ILLEGAL, RISC_OS
from .model import Entry

_SWAP = str.maketrans(RISC_OS, HOST)
_BLANK = str.maketrans(ILLEGAL, " " * len(ILLEGAL))
_INSTEAD = {"": "_empty_name_", ".": "_dot_", "..": "_dotdot_"}


def host_leaf(e: Entry) -> tuple[str, bool]:
    """A name a host can hold, with the file's type behind it, and whether it stands for
    one that it cannot."""
    plain = e.name.translate(_SWAP).translate(_BLANK)
    safe = _INSTEAD.get(plain, plain)
    return (safe if e.is_dir or e.filetype is None else f"{safe},{e.filetype:03x}"), plain in _INSTEAD


def inf_name(raw: bytes) -> str:
    odd = lambda b: not 0x21 <= b <= 0x7E or b in b'%"'
    out = "".join(f"%{b:02X}" if odd(b) else chr(b) for b in raw)
    return f'"{out}"' if not raw or any(map(odd, raw)) else out


def inf_line(e: Entry, written: int, crc: int | None) -> str:
    parts = [inf_name(e.raw), f"{e.load:08x}", f"{e.exec:08x}", f"{written:08x}", f"{e.attrs & 255:02x}"]
    if crc is not None:
        parts.append(f"CRC32={crc:08X}")
    if e.modified is not None:
        parts.append(f"DATETIME={datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=e.modified):%Y%m%d%H%M%S}")
    return " ".join(parts)
