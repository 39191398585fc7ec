"""Images as DataFrames: one walk of each volume gives every table.

``images`` is a DataFrame of (path, content), as Spark's ``binaryFile`` source reads it, in
batch or streaming.  An image is decoded in one task; images are spread over tasks.  A
corrupt or unknown image gives a row with its error and never fails the job.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..plans.catalog import FAULTS
from .dfs import Dfs
from .filecore import FileCore
from .fileserver import open_fileserver
from .model import Entry, Image, Listing, NotRecognised, Unsupported, Volume
from .names import host_leaf, inf_line
from .rescue import Ranges

REPORT = "filesystem string, map_type string, dir_type string, disc_name string, disc_id long, disc_size long, sector_size long, boot_option int, root_title string, boot_block_present boolean, boot_block_checksum_ok boolean, zone_checksum_ok_count int, zone_checksum_total int, cross_check_ok boolean, root_check_byte_ok boolean, broken_directories array<string>, directory_warnings array<string>"
SCHEMAS = {
    "volumes": "path string, volume_ord int, label string, backend string, status string, error string",
    "reports": f"path string, partition string, {REPORT}, status string, error string",
    "directories": "path string, partition string, dir_path string, depth int, visit_ord int, title string, is_broken boolean, anomalies array<string>, warnings array<string>, status string",
    "objects": "path string, partition string, dir_path string, entry_ord int, object_path string, name string, name_bytes binary, load long, exec long, length long, attrs long, is_directory boolean, sin long, filetype int, modified_unix_secs long, host_leaf string, host_leaf_substituted boolean",
    "extents": "path string, partition string, object_path string, entry_ord int, ord int, disc_addr long, len long",
    "zones": "path string, partition string, zone int, check_ok boolean, used_backup boolean, cross_check int",
    "old_maps": "path string, partition string, total_sectors long, disc_id long, boot_option int, sector0_checksum_ok boolean, sector1_checksum_ok boolean, free_extents int",
    "free_extents": "path string, partition string, ord int, start long, len long",
    "fragments": "path string, partition string, fragment_id long, ord int, disc_addr long, len long",
    "content": "path string, partition string, object_path string, host_path string, bytes binary, written long, crc32 long, modified_unix_secs long, inf string",
    "diagnostics": "path string, partition string, seq int, severity string, code string, message string, obj_path string, zone int, stored int, computed int, field string, boot string, zone0 string, details string, offset long, len long",
    "folders": "path string, partition string, host_path string",
    "verify": "path string, partition string, directories long, files long, unreadable long, status string, error string",
    "failures": "path string, partition string, task string, error string",
    "extract_log": "path string, partition string, seq int, kind string, obj_path string, line string",
    "extract_summary": "path string, partition string, files_extracted long, files_skipped long, dirs_created long, total_bytes long, status string, error string",
}


@dataclass(frozen=True)
class Options:
    """bad_sectors: skip, null or marker.  broken_dirs: fail, skip or recover."""

    bad_sectors: str = "null"
    broken_dirs: str = "fail"
    rescue_map: str | None = None
    partition: str | None = None
    dry_run: bool = False


def open_volumes(data: bytes) -> list[tuple[str, Volume]]:
    """Volumes with labels of their own.  The two systems that share discs are both tried,
    the third only where neither is there; an error counts only if nothing opens."""
    image, out, why = Image(data), [], None
    for kinds in ((FileCore, open_fileserver), (Dfs,)):
        for kind in kinds if not out else ():
            try:
                v = kind(image)
                same = sum(x[1].label == v.label for x in out)
                out.append((f"{v.label}-{same}" if same else v.label, v))
            except NotRecognised:
                pass
            except Exception as e:
                why = why or e
    if not out:
        raise why or NotRecognised()
    return out


@dataclass
class Visit:
    path: str
    depth: int
    entry: Entry
    listing: Listing | None  # None where the directory was seen before
    error: str = ""


def walk(v: Volume) -> Iterator[Visit]:
    """Every directory, last listed first; one with runs seen before is not listed again."""
    top = v.root()
    stack, seen = [("$", 0, top, top.sin)], set()
    while stack:
        path, depth, entry, parent = stack.pop()
        mark = tuple(entry.runs)
        if mark and mark in seen:
            yield Visit(path, depth, entry, None)
            continue
        seen.add(mark)
        try:
            visit = Visit(path, depth, entry, v.list(entry, parent))
        except Exception as e:
            visit = Visit(path, depth, entry, Listing(broken=True), f"{type(e).__name__}: {e}")
        # Whoever takes the visit may put a listing without entries in, and the walk leaves them.
        yield visit
        stack += [(f"{path}.{e.name}", depth + 1, e, entry.sin) for e in visit.listing.entries if e.is_dir]


#: How the messages of directory and file faults begin: fixed values.
SAID = {"unreadable_directory": "unreadable directory", "broken_directory": "broken directory", "directory_warning": "directory warning", "unreadable_file": "unreadable file"}


def _diagnose(v: Volume, visits: list[Visit]) -> tuple[list[dict], dict]:
    """Diagnostics with what they carry, and the counts of a verification."""
    found = [{"code": c, "message": m} | payload for c, m, payload in v.faults()]
    count = {"directories": 0, "files": 0, "unreadable": 0}

    def say(code: str, details: str, path: str) -> None:
        found.append({"code": code, "message": f"{SAID[code]}: {details}", "details": details, "obj_path": path})
        count["unreadable"] += FAULTS[code] == "damage"

    for x in visits:
        if x.listing is None:
            found.append({"code": "directory_cycle", "message": "directory cycle detected", "obj_path": x.path})
            count["unreadable"] += 1
            continue
        count["directories"] += 1
        if x.error:
            say("unreadable_directory", x.error, x.path)
            continue
        if x.listing.broken:
            say("broken_directory", "; ".join(x.listing.anomalies), x.path)
        for w in x.listing.warnings:
            say("directory_warning", w, x.path)
        for e in x.listing.entries:
            if not e.is_dir:
                count["files"] += 1
                if e.length and not e.runs:
                    say("unreadable_file", "no disc extents resolved (missing fragment?)", f"{x.path}.{e.name}")
    return found, count


def _report(v: Volume, visits: list[Visit], size: int) -> dict:
    top = visits[0].listing
    info = v.info()
    listed = [x for x in visits if x.listing is not None]
    out = {"root_title": top.title, "boot_block_present": False, "root_check_byte_ok": not top.broken, "broken_directories": [x.path for x in listed if x.listing.broken], "directory_warnings": [f"{x.path}: {w}" for x in listed for w in x.listing.warnings]} | info
    if info["filesystem"] == "FileCore" and size < info["disc_size"]:
        out["directory_warnings"].append(f"image is truncated/partial: disc records {info['disc_size']} bytes but the image is only {size} bytes")
    return out


class BrokenDirectory(Exception):
    """A broken directory under the policy to fail."""


def extract(v: Volume, options: Options) -> Iterator[tuple[str, dict]]:
    """("dir" | "file" | "log" | "summary", row) of a volume, in order of the walk."""
    ranges = Ranges.parse(options.rescue_map) if options.rescue_map is not None else None
    total = {"files_extracted": 0, "files_skipped": 0, "dirs_created": 0, "total_bytes": 0}
    log = lambda kind, path, line: ("log", {"kind": kind, "obj_path": path, "line": line})
    host = {"$": ""}
    for x in walk(v):
        if x.listing is None:
            yield log("warning", None, f"warning    directory cycle detected at {x.path}, skipping")
            continue
        total["dirs_created"] += 1
        if not options.dry_run:
            yield "dir", {"host_path": host[x.path]}
        for w in x.listing.warnings:
            yield log("warning", None, f"warning    {x.path}: {w}")
        if x.listing.broken:
            what = "; ".join(x.listing.anomalies) or x.error
            if options.broken_dirs == "fail":
                raise BrokenDirectory(f"{x.path}: {what}")
            yield log("broken_directory", x.path, f"broken-dir {x.path} action={options.broken_dirs}: {what}")
            if options.broken_dirs == "skip":
                x.listing = Listing(title=x.listing.title)
                continue
        else:
            for a in x.listing.anomalies:
                yield log("warning", None, f"warning    {x.path}: {a}")
        for e in x.listing.entries:
            path = f"{x.path}.{e.name}"
            leaf, swapped = host_leaf(e)
            if swapped:
                yield log("warning", None, f'warning    {path}: translated name would be empty or "."/".." (unsafe to use as a host path component); substituted "{leaf}" instead')
            at = f"{host[x.path]}/{leaf}".lstrip("/")
            if e.is_dir:
                host[path] = at
                continue
            whole = sum(n for _, n in e.runs)
            parts = [p for a, n in e.runs for p in (ranges.segments(a, n) if ranges else [(a, n, True)])]
            bad = [(a, n) for a, n, good in parts if not good]
            if whole and all(not good for *_, good in parts):
                total["files_skipped"] += 1
                yield log("skipped_wholly_bad", path, f"skipped    {path} (wholly bad sectors)")
                continue
            if bad:
                policy = {"skip": "Skip", "null": "NullFill", "marker": "MarkerFill"}[options.bad_sectors]
                yield log("bad_sectors", path, f"bad-sectors {path} [{', '.join(f'{a:#x}+{n:#x}' for a, n in bad)}] policy={policy}")
            total["files_extracted"] += 1
            if options.dry_run:
                total["total_bytes"] += whole
                continue
            body = b"".join(v.image.read(a, n) if good else _filler(n, options.bad_sectors) for a, n, good in parts)
            total["total_bytes"] += len(body)
            crc = zlib.crc32(body)
            yield "file", {"object_path": path, "host_path": at, "bytes": body, "written": len(body), "crc32": crc, "modified_unix_secs": e.modified, "inf": inf_line(e, len(body), crc)}
            yield log("extracted", path, f"extracted  {path} ({len(body)} bytes)")
    yield "summary", total


def _filler(n: int, policy: str) -> bytes:
    if policy == "skip":
        return b""
    return bytes(n) if policy == "null" else (b"BAD SECTOR! " * (n // 12 + 1))[:n]


def _rows(path: str, data: bytes, what: str, options: Options) -> Iterator[dict]:
    """The rows of one table.  A volume that fails once it is open leaves the others alone: it
    is a row of ``failures``, and of the tables that have an error column."""
    volumes = [(k, label, v) for k, (label, v) in enumerate(open_volumes(data)) if options.partition in (None, label)]
    for k, label, v in volumes:
        own = {"path": path, "partition": label}
        if what == "volumes":
            yield {"path": path, "volume_ord": k, "label": label, "backend": type(v).__name__, "status": "ok"}
        elif what == "failures":
            for task in ("reports", "verify", "extract_summary", "zones", "fragments"):
                last = None
                for last in _volume_rows(own, v, task, options, len(data), False):
                    pass
                if last and last.get("status") == "error":
                    yield own | {"task": task, "error": last["error"]}
        else:
            yield from _volume_rows(own, v, what, options, len(data), len(volumes) > 1)


def _volume_rows(own: dict, v: Volume, what: str, options: Options, size: int, several: bool) -> Iterator[dict]:
    try:
        old = isinstance(v, FileCore) and v.map_type == "old"
        if what == "zones":
            zones = zip(v.map.ok, v.map.backups, v.map.checks, strict=True) if isinstance(v, FileCore) and v.map else []
            yield from ({**own, "zone": z, "check_ok": ok, "used_backup": backup, "cross_check": check} for z, (ok, backup, check) in enumerate(zones))
        elif what == "old_maps":
            if old:
                yield own | {"total_sectors": v.total, "disc_id": v.id, "boot_option": v.option, "sector0_checksum_ok": v.map_ok[0], "sector1_checksum_ok": v.map_ok[1], "free_extents": len(v.free)}
        elif what == "free_extents":
            yield from ({**own, "ord": i, "start": at, "len": n} for i, (at, n) in enumerate(v.free if old else []))
        elif what == "fragments":
            runs = v.map.runs if isinstance(v, FileCore) and v.map else {}
            yield from ({**own, "fragment_id": f, "ord": i, "disc_addr": a, "len": n} for f, rs in runs.items() for i, (a, n) in enumerate(rs))
        elif what in ("content", "folders", "extract_log", "extract_summary"):
            yield from _extracted(own, v, what, options, several)
        else:
            yield from _walked(own, v, what, size)
    except Exception as e:
        if "error" in SCHEMAS[what]:
            why = str(e) if isinstance(e, BrokenDirectory) else f"{type(e).__name__}: {e}"
            yield own | {"status": "error", "error": why}


def _extracted(own: dict, v: Volume, what: str, options: Options, several: bool) -> Iterator[dict]:
    seq = 0
    inside = lambda at: f"{own['partition']}/{at}".rstrip("/") if several else at
    for kind, row in extract(v, options):
        if kind == "file" and what == "content" or kind == "dir" and what == "folders":
            yield own | row | {"host_path": inside(row["host_path"])}
        elif kind == "log" and what == "extract_log":
            yield {**own, "seq": seq, **row}
            seq += 1
        elif kind == "summary" and what == "extract_summary":
            yield own | row | {"status": "ok"}


def _walked(own: dict, v: Volume, what: str, size: int) -> Iterator[dict]:
    visits = list(walk(v))
    if what == "reports":
        yield own | _report(v, visits, size) | {"status": "ok"}
    elif what in ("diagnostics", "verify"):
        found, count = _diagnose(v, visits)
        if what == "verify":
            yield own | count | {"status": "ok"}
        else:
            yield from ({**own, "seq": i, "severity": FAULTS[x["code"]], **x} for i, x in enumerate(found))
    for ord_, x in enumerate(visits):
        if what == "directories":
            x_ = x.listing or Listing()
            status = "cycle" if x.listing is None else "unreadable" if x.error else "broken" if x_.broken else "ok"
            yield own | {"dir_path": x.path, "depth": x.depth, "visit_ord": ord_, "title": x_.title, "is_broken": x_.broken, "anomalies": x_.anomalies, "warnings": x_.warnings, "status": status}
        for i, e in enumerate(x.listing.entries if x.listing else ()):
            at = f"{x.path}.{e.name}"
            if what == "objects":
                leaf, swapped = host_leaf(e)
                yield own | {"dir_path": x.path, "entry_ord": i, "object_path": at, "name": e.name, "name_bytes": e.raw, "load": e.load, "exec": e.exec, "length": e.length, "attrs": e.attrs, "is_directory": e.is_dir, "sin": e.sin, "filetype": e.filetype, "modified_unix_secs": e.modified, "host_leaf": leaf, "host_leaf_substituted": swapped}
            elif what == "extents":
                yield from ({**own, "object_path": at, "entry_ord": i, "ord": k, "disc_addr": a, "len": n} for k, (a, n) in enumerate(e.runs))


def decode(images: DataFrame, what: str, options: Options | None = None, batch_bytes: int = 1 << 26) -> DataFrame:
    """The table ``what`` of :data:`SCHEMAS` of all images (path, content)."""
    options, schema = options or Options(), SCHEMAS[what]
    names = images.sparkSession.createDataFrame([], schema).columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        size = 0
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    for row in _rows(path, bytes(data or b""), what, options):
                        held.append(row)
                        size += 256 + len(row.get("bytes") or b"")
                        if size > batch_bytes:
                            yield _frame(held, names)
                            held, size = [], 0
                except Exception as e:  # one bad image is a row, not the end of the job
                    if what == "volumes":
                        status = "not_recognised" if isinstance(e, NotRecognised) else "unsupported" if isinstance(e, Unsupported) else "error"
                        held.append({"path": path, "status": status, "error": f"{type(e).__name__}: {e}"})
        if held:
            yield _frame(held, names)

    return images.select("path", "content").mapInPandas(run, schema)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})


def read_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content) of the files below ``path``."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return reader.load(path).select("path", "content")
