"""Column functions of the disc formats: checksums, text, times, names, attributes, geometry.

Checksums keep 32-bit state in BIGINT, as ANSI mode raises on INT overflow.  All of it
stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 4294967295

# Fixed values of the format: characters of bytes 0x80 to 0x9F.
C1 = "€Ŵŵ��Ŷŷ�←→↓↑…™‰•‘’‹›“”„–—−Œœ†‡ﬁﬂ"
# Fixed values of the format: characters that host names swap, and those they cannot hold.
RISC_OS, HOST = "/?<>+=;", ".#$^&@%"
ILLEGAL = '\\/:*?"<>|\x00'


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def long(x: int) -> Column:
    return F.lit(x).cast("long")


def byte_list(data: Column) -> Column:
    """The bytes of a binary as an array of BIGINT."""
    n = F.octet_length(data)
    at = F.filter(F.sequence(F.lit(0), n), lambda i: i > 0)
    return F.transform(at, lambda i: F.conv(F.hex(F.substr(data, i, F.lit(1))), 16, 10).cast("long"))


def word_list(data: Column) -> Column:
    """The whole little-endian 32-bit words of a binary as an array of BIGINT."""
    at = F.filter(F.sequence(F.lit(0), F.floor(F.octet_length(data) / 4).cast("int")), lambda i: i > 0)
    word = lambda i: F.reverse(F.sequence(i * 4 - 3, i * 4))
    hexed = lambda i: F.array_join(F.transform(word(i), lambda k: F.hex(F.substr(data, k, F.lit(1)))), "")
    return F.transform(at, lambda i: F.conv(hexed(i), 16, 10).cast("long"))


def boot_checksum(data: Column) -> Column:
    """Sum of the first 511 bytes; a carry out of 8 bits comes back in."""
    step = lambda s, b: F.when(s + b > 255, (s + b + 1).bitwiseAND(F.lit(255))).otherwise(s + b)
    return F.aggregate(F.slice(byte_list(data), 1, 511), long(0), step).bitwiseAND(F.lit(255))


def old_map_checksum(data: Column) -> Column:
    """From 255, bytes 254 down to 0; a carry comes in before the next byte."""
    step = lambda s, b: F.when(s > 255, (s + 1).bitwiseAND(F.lit(255))).otherwise(s) + b
    return F.aggregate(F.reverse(F.slice(byte_list(data), 1, 255)), long(255), step).bitwiseAND(F.lit(255))


def fold(x: Column) -> Column:
    """A 32-bit value folded to 8 bits, in two steps."""
    half = lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 8)).bitwiseAND(F.lit(255))
    return let(x.bitwiseXOR(F.shiftrightunsigned(x, 16)), half)


def zone_check(data: Column) -> Column:
    """Words from the last to the first with carries, less the first byte, folded.  The
    carry is bit 32 of the state and the one out of the last word is dropped."""
    step = lambda s, w: s.bitwiseAND(long(MASK)) + w + F.shiftright(s, 32)
    first = F.conv(F.hex(F.substr(data, F.lit(1), F.lit(1))), 16, 10).cast("long")
    total = F.aggregate(F.reverse(word_list(data)), long(0), step)
    return fold((total - first).bitwiseAND(long(MASK)))


def rotate13(x: Column) -> Column:
    return (F.shiftrightunsigned(x, 13) + F.shiftleft(x, 19)).bitwiseAND(long(MASK))


def dir_checksum(data: Column) -> Column:
    """Whole words, then the bytes left over, each xored with the state rotated by 13."""
    left = F.slice(byte_list(data), F.floor(F.octet_length(data) / 4).cast("int") * 4 + 1, 4)
    return fold(F.aggregate(F.concat(word_list(data), left), long(0), lambda c, w: w.bitwiseXOR(rotate13(c))))


def charset(data: Column) -> Column:
    """8-bit text as Unicode: ASCII and Latin-1 but for the table of 0x80 to 0x9F."""
    return F.translate(F.decode(data, "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), C1)


def to_host(name: Column) -> Column:
    return F.translate(name, RISC_OS, HOST)


def from_host(name: Column) -> Column:
    return F.translate(name, HOST, RISC_OS)


def reserved(name: Column) -> Column:
    """Whether the translated name is empty or a dot name, which a host path can't hold."""
    return to_host(name).isin("", ".", "..")


def host_name(name: Column) -> Column:
    plain = F.translate(to_host(name), ILLEGAL, " " * len(ILLEGAL))
    return F.when(plain == "", "_empty_name_").when(plain == ".", "_dot_").when(plain == "..", "_dotdot_").otherwise(plain)


def filetype(load: Column) -> Column:
    """The type in a load address whose top 12 bits are set, else null."""
    return F.when(F.shiftright(load, 20) == 0xFFF, F.shiftright(load, 8).bitwiseAND(long(0xFFF)))


def suffixed(name: Column, kind: Column, is_dir: Column) -> Column:
    return F.when(kind.isNotNull() & ~is_dir, F.concat(name, F.format_string(",%03x", kind))).otherwise(name)


def centiseconds(load: Column, exec_: Column) -> Column:
    """Hundredths of a second since 1900 in a typed load/exec pair."""
    return F.shiftleft(load.bitwiseAND(long(255)), 32) + exec_


def unix_seconds(load: Column, exec_: Column) -> Column:
    return F.when(filetype(load).isNotNull(), F.floor(centiseconds(load, exec_) / 100) - 2208988800)


def encode_load(kind: Column, centis: Column) -> Column:
    return long(0xFFF00000) + F.shiftleft(kind.cast("long"), 8) + F.shiftright(centis, 32)


def iso_8601(seconds: Column) -> Column:
    """Seconds since 1970 as text, in UTC whatever the session's zone."""
    utc = F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def packed_date(date: Column) -> Column:
    """A 16-bit file-server date; null where no such day exists."""
    low, high = date.bitwiseAND(F.lit(255)), F.shiftright(date, 8).bitwiseAND(F.lit(255))
    year = 1981 + F.shiftright(low, 5) * 16 + F.shiftright(high, 4)
    stamp = F.try_make_timestamp(year, high.bitwiseAND(F.lit(15)), low.bitwiseAND(F.lit(31)), F.lit(0), F.lit(0), F.lit(0))
    return stamp.cast("date")


def access(nfs: Column) -> Column:
    """File-server access bits as attributes: R W L D and public R W."""
    out = F.lit(0)
    for bit, to in ((1, 16), (2, 32), (4, 1), (8, 2), (16, 4), (32, 8)):  # fixed values of the format
        out = out + F.when(nfs.bitwiseAND(F.lit(bit)) != 0, to).otherwise(0)
    return out


def inf_name(data: Column) -> Column:
    """A sidecar's name field: quoted and percent-encoded where a byte asks for it."""
    odd = lambda b: (b < 0x21) | (b > 0x7E) | (b == 0x25) | (b == 0x22)
    code = lambda b: F.when(odd(b), F.concat(F.lit("%"), F.lpad(F.hex(b), 2, "0"))).otherwise(F.chr(b))
    quoted = lambda bs: F.when((F.size(bs) == 0) | F.exists(bs, odd), F.concat(F.lit('"'), F.array_join(F.transform(bs, code), ""), F.lit('"'))).otherwise(F.array_join(F.transform(bs, code), ""))
    return let(byte_list(data), quoted)


def inf_line(name: Column, load: Column, exec_: Column, length: Column, attrs: Column, crc: Column, seconds: Column) -> Column:
    stamp = F.date_format(F.timestamp_seconds(seconds), "yyyyMMddHHmmss")
    head = F.concat(inf_name(name), F.format_string(" %08x %08x %08x %02x", load, exec_, length, attrs.bitwiseAND(F.lit(255))))
    return F.concat_ws(" ", head, F.when(crc.isNotNull(), F.format_string("CRC32=%08X", crc)), F.when(seconds.isNotNull(), F.concat(F.lit("DATETIME="), stamp)))


def collation_key(name: Column) -> Column:
    """Names compare by bytes with A to Z as a to z."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary")


def interleaved(s: Column, kind: Column, spt: Column) -> Column:
    """A file-server logical sector's place under an order: seq, int or mux."""
    t, r = F.floor(s / spt).cast("long"), s % spt
    by_int = (t % 80) * 2 * spt + F.floor(t / 80).cast("long") * spt + r
    by_mux = (t % 2) * 80 * spt + F.floor(t / 2).cast("long") * spt + r
    return F.when((spt == 0) | (kind == "seq"), s).when(kind == "int", by_int).otherwise(by_mux)


def sml_sector(s: Column, tracks: Column, heads: Column) -> Column:
    """A floppy's logical sector (side by side) as image sector (sides interleaved)."""
    t = F.floor(s / 16).cast("long")
    return s % 16 + ((t % tracks) * heads + F.floor(t / tracks).cast("long")) * 16


def dsd_sector(s: Column, side: Column) -> Column:
    return s % 10 + (F.floor(s / 10).cast("long") * 2 + side) * 10
