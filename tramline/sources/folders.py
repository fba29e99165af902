"""Feeds as folders: on disk, zipped, or written out in one text."""

from __future__ import annotations

import gzip
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tramline.functions.storage import exists, files_below, folder


def from_text(text: str, target: str) -> str:
    """Writes the files of one text, each below a line '# name', into a folder."""
    files: dict[str, list[str]] = {}
    own: list[str] | None = None
    for line in text.splitlines():
        if line.startswith("# ") and "." in line:
            own = files.setdefault(line[2:].strip(), [])
        elif own is not None and (line.strip() or own):
            own.append(line)
    for name, lines in files.items():
        path = Path(target, name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(lines).strip("\n") + "\n", encoding="utf-8")
    return target


def unpacked(spark: SparkSession, path: str) -> str:
    """path itself if it is a folder; a zip's files, and those of zips in it, in a folder of spark.checkpoint.dir that all executors reach."""
    if not path.endswith(".zip"):
        return path
    root = folder(spark)
    if "://" in root and not root.startswith("file://"):
        raise ValueError(f"zips are unpacked in local folders alone, not in {root}: unpack {path} first")
    target = Path(root.removeprefix("file://"), "feed-" + Path(path).stem)
    _extract(zipfile.ZipFile(path), target)
    return str(target)


def _extract(archive: zipfile.ZipFile, target: Path) -> None:
    for item in archive.infolist():
        if item.is_dir():
            continue
        inside = target / item.filename
        if not inside.resolve().is_relative_to(target.resolve()):
            raise ValueError(f"{item.filename} lies outside of its archive")
        inside.parent.mkdir(parents=True, exist_ok=True)
        if item.filename.endswith(".zip"):
            with archive.open(item) as inner:
                _extract(zipfile.ZipFile(inner), inside.with_suffix(""))
        else:
            inside.write_bytes(archive.read(item))


def gunzip(data: bytes) -> bytes:
    return gzip.decompress(data)


def has(path: str, *names: str) -> bool:
    return all(exists(f"{path}/{n}") for n in names)


def kind_of(path: str) -> str:
    """gtfs, hrd, netex or vdv by the files of a folder; an error names the folder where none fits."""
    from tramline.sources import fixed_width, gtfs

    if gtfs.applicable(path):
        return "gtfs"
    if fixed_width.applicable(path):
        return "hrd"
    if any(n.endswith((".xml", ".xml.gz")) for n in files_below(path)):
        return "netex"
    raise ValueError(f"no timetable format known in {path}")


def load(spark: SparkSession, path: str, hooks: dict | None = None, **options) -> dict[str, DataFrame]:
    """The tables of a feed of any known format."""
    from tramline.sources import fixed_width, gtfs, xml_timetable

    path = unpacked(spark, path)
    readers = {"gtfs": gtfs.read, "hrd": fixed_width.read, "netex": xml_timetable.read}
    tables = readers[kind_of(path)](spark, path, **options)
    for name, hook in (hooks or {}).items():
        if name in tables:
            tables[name] = hook(tables[name])
    return tables
