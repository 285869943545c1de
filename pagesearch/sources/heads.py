"""Sizes of images from a few bytes of their files, whatever the format and wherever in a file the size stands."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that are fetched at a time, and the most fetches for one file: a size that lies behind more is not looked for.
FETCH, MOST_FETCHES = 4096, 64
#: Entries of a TIFF directory and boxes or segments of other formats that are looked at.
ENTRIES, STEPS = 512, 512


class Ranges:
    """Random reads of a file in fetched blocks; ``read`` gives up to n bytes from an offset."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read, self.blocks, self.fetched = read, {}, 0

    def at(self, offset: int, n: int) -> bytes:
        """The bytes there; fewer at the end of the file, or when too many blocks were fetched."""
        out = []
        for k in range(offset // FETCH, (offset + n - 1) // FETCH + 1):
            if k not in self.blocks:
                if len(self.blocks) >= MOST_FETCHES:
                    break
                self.blocks[k] = self.read(k * FETCH, FETCH)
                self.fetched += len(self.blocks[k])
            out.append(self.blocks[k])
            if len(self.blocks[k]) < FETCH:
                break
        return b"".join(out)[offset % FETCH :][:n]

    def numbers(self, form: str, offset: int) -> tuple[int, ...]:
        data = self.at(offset, struct.calcsize(form))
        if len(data) < struct.calcsize(form):
            raise EOFError
        return struct.unpack(form, data)


def _png(r: Ranges) -> tuple[int, int]:
    return r.numbers(">II", 16)


def _gif(r: Ranges) -> tuple[int, int]:
    return r.numbers("<HH", 6)


def _bmp(r: Ranges) -> tuple[int, int]:
    if r.numbers("<I", 14)[0] == 12:
        return r.numbers("<HH", 18)
    width, height = r.numbers("<ii", 18)
    return width, abs(height)  # rows from the top count downwards


def _jpeg(r: Ranges) -> tuple[int, int]:
    at = 2
    for _ in range(STEPS):
        mark, kind = r.numbers("BB", at)
        if mark != 0xFF:
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = r.numbers(">HH", at + 5)
            return width, height
        elif kind == 0xFF:
            at += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD9:
            at += 2
        else:
            at += 2 + r.numbers(">H", at + 2)[0]
    return 0, 0


def _tiff(r: Ranges) -> tuple[int, int]:
    """The first directory, which lies anywhere; both the usual form and the one with 64-bit offsets."""
    order = "<" if r.at(0, 2) == b"II" else ">"
    big = r.numbers(f"{order}H", 2)[0] == 43
    at = r.numbers(f"{order}{'Q' if big else 'I'}", 8 if big else 4)[0]
    count, head, size, value = ("Q", 8, 20, 12) if big else ("H", 2, 12, 8)
    found = {}
    for k in range(min(r.numbers(f"{order}{count}", at)[0], ENTRIES)):
        entry = at + head + size * k
        tag, kind = r.numbers(f"{order}HH", entry)
        if tag in (256, 257) and kind in (3, 4, 16):
            found[tag] = r.numbers(order + {3: "H", 4: "I", 16: "Q"}[kind], entry + value)[0]
        if tag > 257:
            break  # entries ascend
    return found.get(256, 0), found.get(257, 0)


def _webp(r: Ranges) -> tuple[int, int]:
    kind = r.at(12, 4)
    if kind == b"VP8X":
        a, b, c, d, e, f = r.numbers("6B", 24)
        return (a | b << 8 | c << 16) + 1, (d | e << 8 | f << 16) + 1
    if kind == b"VP8L":
        bits = r.numbers("<I", 21)[0]
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    width, height = r.numbers("<HH", 26)
    return width & 0x3FFF, height & 0x3FFF


def _codestream(r: Ranges, at: int = 0) -> tuple[int, int]:
    right, bottom, left, top = r.numbers(">IIII", at + 8)
    return right - left, bottom - top


def _jp2(r: Ranges) -> tuple[int, int]:
    """The image header box within the header box, or else the codestream's own size."""
    at = 0
    for _ in range(STEPS):
        size, kind = r.numbers(">I4s", at)
        head = 8
        if size == 1:
            size, head = r.numbers(">Q", at + 8)[0], 16
        if kind == b"jp2h":
            at += head
            continue
        if kind == b"ihdr":
            height, width = r.numbers(">II", at + head)
            return width, height
        if kind == b"jp2c":
            return _codestream(r, at + head)
        if size < head:
            break  # up to the end of the file
        at += size
    return 0, 0


#: How files of each format begin, and what reads their size.
_FORMATS: tuple[tuple[int, bytes, Callable[[Ranges], tuple[int, int]]], ...] = (
    (0, b"\x89PNG\r\n\x1a\n", _png),
    (0, b"GIF87a", _gif),
    (0, b"GIF89a", _gif),
    (0, b"\xff\xd8\xff", _jpeg),
    (0, b"II*\0", _tiff),
    (0, b"MM\0*", _tiff),
    (0, b"II+\0", _tiff),
    (0, b"MM\0+", _tiff),
    (8, b"WEBP", _webp),
    (0, b"BM", _bmp),
    (0, b"\0\0\0\x0cjP  \r\n\x87\n", _jp2),
    (0, b"\xff\x4f\xff\x51", _codestream),
)


def size_of(r: Ranges) -> tuple[int, int]:
    """Width and height of an image; 0, 0 if the format is unknown, or its head is cut short or makes no sense."""
    head = r.at(0, 16)
    for at, signature, read in _FORMATS:
        if head[at : at + len(signature)] == signature:
            try:
                width, height = read(r)
            except (EOFError, struct.error):
                return 0, 0
            return (width, height) if width > 0 and height > 0 else (0, 0)
    return 0, 0


def image_header_size(data: bytes | None) -> tuple[int, int]:
    """Width and height of an image whose bytes, or the first of them, are at hand."""
    view = memoryview(data or b"")
    return size_of(Ranges(lambda at, n: bytes(view[at : at + n])))


@F.pandas_udf(T.StructType([T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType())]))
def image_size(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([image_header_size(c) for c in contents], columns=["width", "height"], dtype="float64")


def probed_files(paths: DataFrame) -> DataFrame:
    """Sizes of image files (media_id, path) that are read where they lie: (media_id, width, height, fetched).

    A task reads at most FETCH * MOST_FETCHES bytes of a file, and of most files one block, so what is read goes with the
    number of files, not with their sizes. Paths are local or addresses of a store that pyarrow reaches from executors;
    where it doesn't, image_size() works on contents that Spark has read. A file that can't be opened is 0 by 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            rows = []
            for path in b.column(1).to_pylist():
                try:
                    place, name = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
                    with place.open_input_file(name) as f:
                        size = f.size()
                        ranges = Ranges(lambda at, n, f=f, size=size: f.read_at(min(n, size - at), at) if at < size else b"")
                        rows.append((*size_of(ranges), ranges.fetched))
                except (OSError, pa.ArrowInvalid, AttributeError, TypeError):
                    rows.append((0, 0, 0))
            width, height, fetched = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(width, pa.float64()), pa.array(height, pa.float64()), pa.array(fetched, pa.int64())], ["media_id", "width", "height", "fetched"])

    # a file:/ path with one slash is how Spark lists local files
    slim = paths.select(F.col("media_id").cast("bigint").alias("media_id"), F.regexp_replace("path", "^file:/(?=[^/])", "file:///").alias("path"))
    return slim.mapInArrow(run, "media_id long, width double, height double, fetched long")
