"""``python -m platterlake.cli info|verify|extract IMAGES``: reports, checks and extraction.

IMAGES is one image or a folder of them.  One image gives an array of its partitions, as
JSON, or a paragraph for each; of several, each partition is preceded by its image, files
are extracted below a folder named after the image, and totals run over all.

Exit codes: 0 done, 1 error, 2 no image recognised.  ``verify`` exits 0 with faults too.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .sources.disc import Options, decode, read_images
from .sources.rescue import Ranges


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="platterlake")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb, form in (("info", "json"), ("verify", "text"), ("extract", "json")):
        s = sub.add_parser(verb)
        s.add_argument("images")
        s.add_argument("--format", choices=("json", "text"), default=form)
        s.add_argument("--partition")
        if verb == "verify":
            s.add_argument("--diagnostics", help="write faults as JSON lines here")
        if verb == "extract":
            s.add_argument("--output", required=True)
            s.add_argument("--rescue-map")
            s.add_argument("--bad-sectors", choices=("skip", "null", "marker"), default="null")
            s.add_argument("--on-broken-directory", choices=("fail", "skip", "recover"), default="recover")
            s.add_argument("--inf", action="store_true")
            s.add_argument("--log", nargs="?", const="", help="write the log here; without a path, to extract.log in the output folder")
            s.add_argument("--dry-run", action="store_true")
    return p


def report_text(r: Row) -> str:
    yes = lambda b: str(b).lower()
    lines = [("Filesystem", r.filesystem), ("Map type", r.map_type), ("Directory type", r.dir_type), ("Disc name", r.disc_name), ("Disc id", None if r.disc_id is None else f"{r.disc_id:#06x}")]
    lines += [("Disc size", None if r.disc_size is None else f"{r.disc_size} bytes"), ("Sector size", None if r.sector_size is None else f"{r.sector_size} bytes"), ("Boot option", r.boot_option), ("Root title", r.root_title)]
    lines += [("Boot block", "present" if r.boot_block_present else "absent"), ("Boot block ok", None if r.boot_block_checksum_ok is None else yes(r.boot_block_checksum_ok))]
    lines += [("Zone checksums", None if r.zone_checksum_total is None else f"{r.zone_checksum_ok_count}/{r.zone_checksum_total} ok"), ("Cross-check ok", None if r.cross_check_ok is None else yes(r.cross_check_ok))]
    lines += [("Root dir ok", yes(r.root_check_byte_ok)), ("Broken dirs", ", ".join(r.broken_directories) or "none"), ("Dir warnings", "; ".join(r.directory_warnings) or "none")]
    return "\n".join(f"{k + ':':<17}{v}" for k, v in lines if v is not None)


def _place(base: str, host_path: str) -> str:
    """Where ``host_path`` goes below ``base``; a path that leaves it is refused."""
    to = os.path.realpath(os.path.join(base, host_path))
    if os.path.commonpath((base, to)) != base:
        raise ValueError(f"{host_path} leaves the output folder")
    return to


def write_folders(folders: DataFrame, output: str) -> None:
    """Every directory below ``output``, empty ones too."""
    base = os.path.realpath(output)
    folders.foreachPartition(lambda rows: [os.makedirs(_place(base, r.host_path), exist_ok=True) for r in rows] and None)


def write_files(content: DataFrame, output: str, inf: bool) -> None:
    """Files below ``output``, which all executors share."""
    base = os.path.realpath(output)

    def put(rows) -> None:
        for r in rows:
            to = _place(base, r.host_path)
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with open(to, "wb") as f:
                f.write(r.bytes)
            if r.modified_unix_secs is not None:
                os.utime(to, (r.modified_unix_secs, r.modified_unix_secs))
            if inf:
                with open(f"{to}.inf", "w", encoding="utf-8") as f:
                    f.write(f"{r.inf}\n")

    content.foreachPartition(put)


COUNTS = {"verify": ("directories", "files", "unreadable"), "extract": ("files_extracted", "files_skipped", "dirs_created", "total_bytes")}


def show(verb: str, form: str, rows: list[dict], several: bool) -> str:
    """What a verb prints of its partitions, each a dict with path and partition first."""
    if form == "json":
        out = [{k: v for k, v in r.items() if k not in ("status", "error") and (several or k != "path")} for r in rows]
        return json.dumps([{("image" if k == "path" else k): v for k, v in r.items()} for r in out], indent=2, ensure_ascii=False)
    sums = {k: sum(r[k] for r in rows) for k in COUNTS.get(verb, ())}
    image = lambda r: f"{r['path']}: " if several else ""
    if verb == "verify":
        lines = [f"{image(r)}partition {r['partition']}: " + " ".join(f"{k}={r[k]}" for k in sums) for r in rows]
        return "\n".join([*lines, "total: " + " ".join(f"{k}={v}" for k, v in sums.items())])
    parts = []
    for r in rows:
        text = f"{image(r)}Partition {r['partition']}:\n{report_text(Row(**r))}"
        if verb == "extract":
            text += "\n\n" + "\n".join(f"{k.capitalize().replace('_', ' ') + ':':<17}{r[k]}" for k in sums)
        parts.append(text)
    if verb == "extract" and len(rows) > 1:
        parts.append("Total: {files_extracted} files extracted, {files_skipped} files skipped, {dirs_created} dirs, {total_bytes} bytes".format(**sums))
    return "\n\n".join(parts)


def _failed(rows: list[Row]) -> bool:
    """Whether a volume failed; its error is printed."""
    bad = [r for r in rows if r.status != "ok"]
    for r in bad:
        print(f"error: {r.path}: {r.partition}: {r.error}", file=sys.stderr)
    return bool(bad)


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    images = read_images(spark, a.images)
    opened = decode(images, "volumes").where("status = 'ok'")
    several = opened.select("path").distinct().count() > 1
    if opened.isEmpty():
        print(json.dumps({"recognized": False}, indent=2) if a.format == "json" else "not a recognised disc image (FileCore, AFS or DFS)")
        return 2
    if a.partition and opened.where(F.col("label") == a.partition).isEmpty():
        print(f"partition '{a.partition}' not found on this image", file=sys.stderr)
        return 1
    rescue = None
    if getattr(a, "rescue_map", None):
        try:
            with open(a.rescue_map, encoding="utf-8") as f:
                rescue = f.read()
            Ranges.parse(rescue)
        except (OSError, ValueError) as e:
            print(f"error: {e}", file=sys.stderr)
            return 1
    options = Options(partition=a.partition) if a.verb != "extract" else Options(a.bad_sectors, a.on_broken_directory, rescue, a.partition, a.dry_run)
    table = lambda what: decode(images, what, options)
    # One row a partition; the rows of a folder of images come to the driver to be printed.
    rows = table("verify" if a.verb == "verify" else "reports").orderBy("path", "partition").collect()
    if a.verb != "extract":
        if _failed(rows):
            return 1
        print(show(a.verb, a.format, [r.asDict() for r in rows], several))
        return _diagnostics(table("diagnostics"), a.diagnostics) if a.verb == "verify" else 0

    sums = table("extract_summary").orderBy("path", "partition").collect()
    if _failed(rows) or _failed(sums):
        return 1
    if not a.dry_run:
        # Images in one folder can hold files of one name.
        place = (lambda df: df.withColumn("host_path", F.concat_ws("/", F.regexp_extract("path", "[^/]*$", 0), "host_path"))) if several else (lambda df: df)
        os.makedirs(a.output, exist_ok=True)
        write_folders(place(table("folders")), a.output)
        write_files(place(table("content")), a.output, a.inf)
    if a.log is not None:
        to = a.log or os.path.join(a.output, "extract.log")
        try:
            os.makedirs(os.path.dirname(to) or ".", exist_ok=True)
            with open(to, "w", encoding="utf-8") as f:
                for r in table("extract_log").orderBy("path", "partition", "seq").toLocalIterator():
                    f.write(f"{r.line}\n")
        except OSError as e:
            print(f"warning: failed to write log to {to}: {e}", file=sys.stderr)
    print(show(a.verb, a.format, [r.asDict() | s.asDict() for r, s in zip(rows, sums, strict=True)], several))
    return 0


def _diagnostics(found: DataFrame, to: str | None) -> int:
    """Faults as JSON lines in a file, or as lines on stderr."""
    found = found.orderBy("path", "partition", "seq")
    if not to:
        for r in found.toLocalIterator():
            print(f"{r.severity}: " + (f"{r.obj_path}: " if r.obj_path else "") + r.message, file=sys.stderr)
        return 0
    try:
        with open(to, "w", encoding="utf-8") as f:
            for r in found.select(F.to_json(F.struct("severity", "code", "message", F.col("obj_path").alias("path"), "offset", "len")).alias("line")).toLocalIterator():
                f.write(f"{r.line}\n")
    except OSError as e:
        print(f"warning: failed to write diagnostics to {to}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
