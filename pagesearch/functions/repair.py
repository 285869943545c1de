"""Repair of text files: bytes to UTF-8, and XML that does not parse."""

from __future__ import annotations

import codecs
import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import PDF2XML_REPAIRS

_TAG = re.compile(r"""<(?P<end>/?)(?P<name>[A-Za-z_][\w:.-]*)(?P<attrs>(?:[^<>"']|"[^"]*"|'[^']*')*?)(?P<empty>/?)>|<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[?!][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z_][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def _latin1(e: UnicodeDecodeError) -> tuple[str, int]:
    return chr(e.object[e.start]), e.start + 1


codecs.register_error("pagesearch-latin1", _latin1)


def fix_utf8_bytes(data: bytes) -> bytes:
    """Keep valid sequences; a byte outside one becomes the character that it is in Latin-1."""
    return data.decode("utf-8", "pagesearch-latin1").encode("utf-8")


def fix_utf8_text(data: bytes | None) -> str | None:
    return None if data is None else fix_utf8_bytes(bytes(data)).decode("utf-8")


@F.pandas_udf(T.StringType())
def fix_utf8(contents: pd.Series) -> pd.Series:
    return contents.map(fix_utf8_text, na_action="ignore")


#: Bytes and characters that are decoded and parsed at a time.
PIECE = 1 << 20


def _pieces(data: memoryview, decoder: codecs.IncrementalDecoder) -> Iterator[str]:
    for at in range(0, len(data), PIECE):
        yield decoder.decode(data[at : at + PIECE], at + PIECE >= len(data))


def _decoder(data: memoryview, mode: str) -> codecs.IncrementalDecoder:
    """How a file's bytes become text: repaired if ``mode`` says so, else UTF-16 by its mark, UTF-8 if all bytes are
    valid, else Latin-1."""
    if mode in ("regex", "all"):
        return codecs.getincrementaldecoder("utf-8")("pagesearch-latin1")
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return codecs.getincrementaldecoder("utf-16")("replace")
    try:
        for _ in _pieces(data, codecs.getincrementaldecoder("utf-8-sig")()):
            pass
        return codecs.getincrementaldecoder("utf-8-sig")()
    except UnicodeDecodeError:
        return codecs.getincrementaldecoder("latin-1")()


def text_pieces(data: bytes, mode: str = "no") -> Iterator[str]:
    """The text of a file in pieces; only the repairs of one page layout need it whole."""
    view = memoryview(data)
    pieces = _pieces(view, _decoder(view, mode))
    first = next(pieces, "")
    if "pdf2xml" in first[:500]:
        whole = fix_pdf2xml_text("".join((first, *pieces)))
        yield from (whole[at : at + PIECE] for at in range(0, len(whole), PIECE))
    else:
        yield first
        yield from pieces


_SPACES = re.compile(r"\s\s")


def fix_pdf2xml_text(xml: str) -> str:
    """The same as functions.text.fix_pdf2xml, for text that Python parses. Runs of spaces are looked for before they are
    replaced, as the first takes a third of the time and few files have any."""
    spaces, *others = PDF2XML_REPAIRS
    for pattern, new in (spaces, *others) if _SPACES.search(xml) else others:
        xml = re.sub(pattern, new, xml)
    return xml


_DECLARATION = re.compile(r"^\s*<\?xml[^>]*\?>")


def undeclared(pieces: Iterator[str]) -> Iterator[str]:
    """Pieces of XML without the declaration, whose charset no longer holds."""
    yield _DECLARATION.sub("", next(pieces, ""), count=1)
    yield from pieces


class _Nothing:
    """A target that keeps nothing of what is parsed."""

    def close(self) -> None:
        pass


def well_formed(pieces: Iterator[str]) -> bool:
    """Whether a strict parser reads the text to its end; nothing of it is kept."""
    parser = ET.XMLParser(target=_Nothing())
    try:
        for piece in undeclared(pieces):
            parser.feed(piece)
        parser.close()
    except (ET.ParseError, ValueError):
        return False
    return True


def parse_strict(xml: str) -> ET.Element | None:
    try:
        return ET.fromstring(_DECLARATION.sub("", xml, count=1))
    except (ET.ParseError, ValueError):
        return None


def parse_recovering(xml: str) -> ET.Element | None:
    """The tree of what can be read: unknown entities stay as text, open elements end with their parent, and a closing
    tag that nothing opened is passed over. Well-formed text gives the tree of a strict parser."""
    strict = parse_strict(xml)
    if strict is not None:
        return strict
    root: ET.Element | None = None
    stack: list[ET.Element] = []
    at = 0

    def say(text: str) -> None:
        if stack and text:
            if len(stack[-1]):
                stack[-1][-1].tail = (stack[-1][-1].tail or "") + text
            else:
                stack[-1].text = (stack[-1].text or "") + text

    for m in _TAG.finditer(xml):
        say(html.unescape(xml[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            say(m["cdata"])
        if not m["name"]:
            continue
        if m["end"]:
            if any(e.tag == m["name"] for e in stack):
                while stack.pop().tag != m["name"]:
                    pass
            continue
        if root is not None and not stack:
            break
        attributes = {a: html.unescape(x or y or z) for a, x, y, z in _ATTRIBUTE.findall(m["attrs"])}
        element = ET.SubElement(stack[-1], m["name"], attributes) if stack else ET.Element(m["name"], attributes)
        root = element if root is None else root
        if not m["empty"]:
            stack.append(element)
    if stack:
        say(html.unescape(xml[at:]))
    return root


def as_text(data: bytes) -> str:
    """UTF-8 if the bytes are valid, else Latin-1; UTF-16 by its mark."""
    view = memoryview(data)
    return "".join(_pieces(view, _decoder(view, "no")))


def load_xml(data: bytes | None, mode: str = "no") -> ET.Element | None:
    """The tree of a file, or None: ``regex`` repairs bytes, ``dom`` recovers markup, ``all`` does both."""
    if not data:
        return None
    text = "".join(text_pieces(data, mode))
    return parse_recovering(text) if mode in ("dom", "all") else parse_strict(text)
