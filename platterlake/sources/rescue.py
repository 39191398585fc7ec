"""Rescue maps: which ranges of an image could be read."""

from __future__ import annotations

from dataclasses import dataclass


class RescueMapError(ValueError):
    """A map that does not parse."""


def literal(word: str) -> int:
    word = word.replace("_", "")
    try:
        if word[:2] in ("0x", "0X"):
            return int(word[2:], 16)
        return int(word, 8 if word[:1] == "0" and len(word) > 1 else 10)
    except ValueError:
        raise RescueMapError(f"not a number: {word!r}") from None


@dataclass(frozen=True)
class Ranges:
    rows: tuple[tuple[int, int, bool], ...]  # start, length, good; by start

    @classmethod
    def parse(cls, text: str) -> Ranges:
        lines = [x.split() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]
        if lines and len(lines[0]) < 2:
            raise RescueMapError("expected status line")
        rows = []
        for parts in lines[1:]:
            if len(parts) != 3 or parts[2] not in tuple("+?*/-"):
                raise RescueMapError(f"expected start, length and status, got {' '.join(parts)!r}")
            rows.append((literal(parts[0]), literal(parts[1]), parts[2] == "+"))
        return cls(tuple(sorted(rows, key=lambda r: r[0])))

    def segments(self, start: int, length: int) -> list[tuple[int, int, bool]]:
        """The run cut by status; what no range covers is good, the first range wins."""
        out, at, end = [], start, start + length
        for a, n, good in self.rows:
            lo, hi = max(a, at), min(a + n, end)
            if lo < hi:
                if lo > at:
                    out.append((at, lo - at, True))
                out.append((lo, hi - lo, good))
                at = hi
        return [*out, (at, end - at, True)] if at < end else out
