"""Precise media types of files."""

from __future__ import annotations

import re
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.repair import fix_utf8_bytes, parse_recovering
from ..schemas import GENERIC_XML

#: Media types by namespace, by schema address, and by doctype or root element without a namespace.
IDENTIFIERS = {
    "application/xml": "application/xml",
    "text/xml": "text/xml",
    "http://www.w3.org/2000/svg": "image/svg+xml",
    "application/vnd.oasis.opendocument.presentation": "application/vnd.oasis.opendocument.presentation-flat-xml",
    "application/vnd.oasis.opendocument.spreadsheet": "application/vnd.oasis.opendocument.spreadsheet-flat-xml",
    "application/vnd.oasis.opendocument.text": "application/vnd.oasis.opendocument.text-flat-xml",
    "http://www.w3.org/1999/xhtml": "application/xhtml+xml",
    "http://www.w3.org/2005/Atom": "application/atom+xml",
    "http://purl.org/rss/1.0/": "application/rss+xml",
    "http://bibnum.bnf.fr/ns/alto_prod": "application/alto+xml",
    "http://bibnum.bnf.fr/ns/refNum": "application/vnd.bnf.refnum+xml",
    "http://www.iccu.sbn.it/metaAG1.pdf": "application/vnd.iccu.mag+xml",
    "http://www.loc.gov/MARC21/slim": "application/marcxml+xml",
    "http://www.loc.gov/METS/": "application/mets+xml",
    "http://www.loc.gov/mods/": "application/mods+xml",
    "http://www.loc.gov/standards/alto/ns-v2#": "application/alto+xml",
    "http://www.loc.gov/standards/alto/ns-v3#": "application/alto+xml",
    "http://www.loc.gov/standards/alto/ns-v4#": "application/alto+xml",
    "http://www.music-encoding.org/ns/mei": "application/vnd.mei+xml",
    "http://www.music-encoding.org/schema/3.0.0/mei-all.rng": "application/vnd.mei+xml",
    "http://www.musicxml.org/xsd/MusicXML": "application/vnd.recordare.musicxml+xml",
    "http://www.openarchives.org/OAI/2.0/": "application/vnd.openarchives.oai-pmh+xml",
    "http://www.openarchives.org/OAI/2.0/static-repository": "application/vnd.openarchives.oai-pmh+xml",
    "http://www.tei-c.org/ns/1.0": "application/tei+xml",
    "http://www.collada.org/2005/11/COLLADASchema": "model/vnd.collada+xml",
    "http://omeka.org/schemas/omeka-xml/v1": "text/vnd.omeka+xml",
    "http://omeka.org/schemas/omeka-xml/v2": "text/vnd.omeka+xml",
    "http://omeka.org/schemas/omeka-xml/v3": "text/vnd.omeka+xml",
    "http://omeka.org/schemas/omeka-xml/v4": "text/vnd.omeka+xml",
    "http://omeka.org/schemas/omeka-xml/v5": "text/vnd.omeka+xml",
    "alto": "application/alto+xml",
    "atom": "application/atom+xml",
    "ead": "application/vnd.ead+xml",
    "feed": "application/atom+xml",
    "html": "text/html",
    "mag": "application/vnd.iccu.mag+xml",
    "mei": "application/vnd.mei+xml",
    "mets": "application/mets+xml",
    "mods": "application/mods+xml",
    "pdf2xml": "application/vnd.pdf2xml+xml",
    "refNum": "application/vnd.bnf.refnum+xml",
    "rss": "application/rss+xml",
    "score-partwise": "application/vnd.recordare.musicxml+xml",
    "svg": "image/svg+xml",
    "TEI": "application/tei+xml",
    "xhtml": "application/xhtml+xml",
}

#: Processing instructions that tell nothing of the kind.
SKIPPED = ("xml-stylesheet", "oxygen")
_OFFICE = "urn:oasis:names:tc:opendocument:xmlns:office:1.0"
#: Where and how files of common formats begin.
_MAGIC = (
    (0, b"%PDF-", "application/pdf"),
    (0, b"PK\x03\x04", "application/zip"),
    (0, b"\x89PNG", "image/png"),
    (0, b"\xff\xd8\xff", "image/jpeg"),
    (0, b"GIF8", "image/gif"),
    (0, b"II*\0", "image/tiff"),
    (0, b"MM\0*", "image/tiff"),
    (0, b"II+\0", "image/tiff"),
    (0, b"MM\0+", "image/tiff"),
    (8, b"WEBP", "image/webp"),
    (8, b"WAVE", "audio/x-wav"),
    (8, b"AVI ", "video/x-msvideo"),
    (0, b"\0\0\0\x0cjP  ", "image/jp2"),
    (4, b"ftypheic", "image/heic"),
    (4, b"ftypavif", "image/avif"),
    (4, b"ftypM4A", "audio/mp4"),
    (4, b"ftypqt", "video/quicktime"),
    (4, b"ftyp", "video/mp4"),
    (0, b"ID3", "audio/mpeg"),
    (0, b"\xff\xfb", "audio/mpeg"),
    (0, b"OggS", "application/ogg"),
    (0, b"fLaC", "audio/flac"),
    (0, b"\x1aE\xdf\xa3", "video/webm"),
    (0, b"%!PS", "application/postscript"),
    (0, b"{\\rtf", "text/rtf"),
    (0, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "application/x-ole-storage"),
    (0, b"\x1f\x8b", "application/gzip"),
    (0, b"BZh", "application/x-bzip2"),
    (0, b"7z\xbc\xaf\x27\x1c", "application/x-7z-compressed"),
    (0, b"Rar!\x1a\x07", "application/x-rar"),
    (257, b"ustar", "application/x-tar"),
    (0, b"AT&TFORM", "image/vnd.djvu"),
)


def identifier_table(spark: SparkSession) -> DataFrame:
    """(identifier, media_type): 46 rows, small enough to broadcast."""
    return F.broadcast(spark.createDataFrame(list(IDENTIFIERS.items()), "identifier string, media_type string"))


def magic_type(data: bytes) -> str:
    """The media type that the leading bytes tell."""
    for at, head, kind in _MAGIC:
        if data.startswith(head, at):
            return kind
    if data[:2] == b"BM" and data[6:10] == bytes(4):
        return "image/bmp"
    head = data[:512].removeprefix(b"\xef\xbb\xbf").lstrip()
    if head.startswith(b"<?xml"):
        return "text/xml"
    if re.match(rb"<!doctype html|<html", head, re.I):
        return "text/html"
    if head.startswith(b"<"):
        return "text/xml"
    if b"\0" in data[:512]:
        return "application/octet-stream"
    return "text/plain" if data else "application/x-empty"


class _Found(Exception):
    pass


def xml_identifier(data: bytes) -> str | None:
    """What tells the kind of an XML file: doctype name, address in a processing instruction other than a style sheet
    or an editor's, or the root element's namespace, else its name; whichever comes first."""
    parser = expat.ParserCreate(namespace_separator="\n")
    found: list[str | None] = []

    def stop(value: str | None) -> None:
        found.append(value)
        raise _Found

    def instruction(target: str, value: str) -> None:
        address = re.search('href="(.+?)"', value, re.I)
        if target not in SKIPPED and address:
            stop(address[1])

    def element(name: str, attributes: dict[str, str]) -> None:
        space, _, local = name.rpartition("\n")
        stop(attributes.get(f"{_OFFICE}\nmimetype") if space == _OFFICE else space or local)

    parser.StartDoctypeDeclHandler = lambda name, *_: stop(name)
    parser.ProcessingInstructionHandler = instruction
    parser.StartElementHandler = element
    try:
        parser.Parse(data, True)
    except _Found:
        return found[0]
    except (expat.ExpatError, ValueError):
        pass
    root = parse_recovering(fix_utf8_bytes(data).decode("utf-8"))
    if root is None:
        return None
    space, _, local = root.tag.removeprefix("{").rpartition("}")
    if _OFFICE in (space, root.get("xmlns")):
        return root.get(f"{{{_OFFICE}}}mimetype") or root.get("office:mimetype")
    return space or root.get("xmlns") or local


def zip_type(data: bytes) -> str | None:
    """The type that a package gives in an uncompressed first entry named mimetype."""
    head = data[:256]
    end = head.find(b"PK", 38)
    return head[38:end].decode("latin-1") if head[30:38] == b"mimetype" and end > 38 else None


def precise_type(data: bytes | None, media_type: str | None = None) -> str | None:
    """The precise media type of a file; the given or general one where nothing tells more."""
    if data is None:
        return media_type
    data = bytes(data)
    general = media_type or magic_type(data)
    if general in GENERIC_XML:
        return IDENTIFIERS.get(xml_identifier(data) or "") or general
    if general == "application/zip":
        return zip_type(data) or general
    return general


@F.pandas_udf(T.StringType())
def specify_media_type(contents: pd.Series, given: pd.Series) -> pd.Series:
    return pd.Series([precise_type(c, g) for c, g in zip(contents, given)], dtype="object")


def upload_errors(media_type: Column, extension: Column, types: list[str] | None, extensions: list[str] | None, disabled: bool = False) -> Column:
    """Array of what speaks against an upload: a type or an extension outside its list.

    A list that is not given allows all; so does an unknown type or extension. Types that end in +xml pass where
    text/xml does.
    """
    wrong = []
    if types is not None and not disabled:
        allowed = media_type.isin(*types) if types else F.lit(False)
        allowed = allowed | media_type.endswith("+xml") if "text/xml" in types else allowed
        wrong.append(F.when((F.coalesce(media_type, F.lit("")) != "") & ~F.coalesce(allowed, F.lit(False)), F.lit("media_type")))
    if extensions is not None and not disabled:
        allowed = extension.isin(*extensions) if extensions else F.lit(False)
        wrong.append(F.when((F.coalesce(extension, F.lit("")) != "") & ~F.coalesce(allowed, F.lit(False)), F.lit("extension")))
    return F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<string>")


def typed_files(files: DataFrame) -> DataFrame:
    """Incoming files (content, and media_type if a type came with them) with the precise type of each."""
    given = F.col("media_type") if "media_type" in files.columns else F.lit(None).cast("string")
    return files.withColumn("media_type", specify_media_type("content", given))


def media_of_path(paths: DataFrame, media: DataFrame, base: str) -> DataFrame:
    """The medium of each stored file, null if none or if ``path`` is not below ``base``.

    A medium's storage name is its file name without extension, folders included; a path has it below the first folder
    under the base.
    """
    bare = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    root = base.rstrip("/") + "/"
    below = F.when(F.col("path").startswith(root), F.regexp_replace(F.expr(f"substring(path, {len(root) + 1})"), "^[^/]*/", ""))
    ids = media.select(bare(F.col("filename")).alias("s"), "media_id").groupBy("s").agg(F.min("media_id").alias("media_id"))
    return paths.withColumn("storage_id", bare(below)).join(ids, F.col("storage_id") == F.col("s"), "left").drop("s")
