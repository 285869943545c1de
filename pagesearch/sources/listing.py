"""Files of many folders: listed by tasks, compared with what was listed before, and only new ones read."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

LISTED = "path string, length bigint, modified timestamp"
_ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", tz="UTC"))])


def _place(address: str):
    """The file system of an address, the path within it, and what stands before paths."""
    from pyarrow import fs

    if ":" not in address:
        return fs.LocalFileSystem(), address, ""
    scheme, _, rest = address.partition(":")
    place, name = fs.FileSystem.from_uri(f"file://{rest}" if scheme == "file" and not rest.startswith("//") else address)
    return place, name, address[: len(address) - len(name)] if address.endswith(name) else f"{scheme}:"


def _listing(folder: str, recursive: bool) -> Iterator[tuple[str, bool, int, datetime.datetime | None]]:
    from pyarrow import fs

    place, name, before = _place(folder)
    for f in place.get_file_info(fs.FileSelector(name, allow_not_found=True, recursive=recursive)):
        yield before + f.path, f.type == fs.FileType.Directory, f.size or 0, f.mtime


def listed_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, length, modified) of all files below ``folders``; a folder that is missing counts as empty.

    The driver lists one level, tasks all below: each folder of that level by itself, so that neither listing nor names
    of all files meet in one place.
    """
    top = [x for folder in folders for x in _listing(folder, False)]
    branches = [path for path, is_folder, *_ in top if is_folder]
    rows = [(path, size, when) for path, is_folder, size, when in top if not is_folder]
    here = spark.createDataFrame(rows, LISTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = [(path, size, when) for path, is_folder, size, when in _listing(folder, True) if not is_folder]
                for at in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, x)) for x in found[at : at + 10_000]], schema=_ARROW)

    if not branches:
        return here
    below = spark.createDataFrame([(x,) for x in branches], "folder string").repartition(min(len(branches), 10_000), "folder").mapInArrow(run, LISTED)
    return here.unionByName(below)


def changed_files(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Listed files that are not known as they are: new ones, and those with another size or time."""
    same = ["path", "length", "modified"]
    return listed.join(known.select(*same), same, "left_anti")


def read_files(paths: DataFrame) -> DataFrame:
    """The rows of ``paths`` with ``content``, the bytes of each file; a file that is gone has none. Tasks get their files by
    the hash of the path, so that many small files are spread."""
    at = paths.columns.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, path in enumerate(b.column(at).to_pylist()):
                place, name, _ = _place(path)
                try:
                    with place.open_input_file(name) as f:
                        content = f.read()
                except FileNotFoundError:
                    content = None
                row = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary())], [*row.schema.names, "content"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema)
    return paths.repartition("path").mapInArrow(run, f"{fields}, content binary")
