"""Pages pulled from a parser against whole trees, and sizes from ranges of image files."""

import random
import re
import struct
import subprocess
import sys

import pytest

from pagesearch import schemas as S
from pagesearch.functions import repair
from pagesearch.sources import heads, zones

ALTO = '<?xml version="1.0" encoding="UTF-8"?><alto xmlns="http://x/y#"><Description><a>t</a></Description><Layout>{}</Layout><Layout><Page WIDTH="1"><String CONTENT="second"/></Page></Layout></alto>'
PDF = '<?xml version="1.0"?><!DOCTYPE pdf2xml SYSTEM "pdf2xml.dtd"><pdf2xml>{}<outline><page number="9"/></outline></pdf2xml>'


def shown(pages):
    return [(page, [(z.attrib, "".join(z.itertext())) for z in held]) for page, held in pages]


def alto_file(rng, pages):
    string = lambda: f'<String CONTENT="w{rng.randrange(99)} é&amp;&lt;" HPOS="{rng.randrange(9)}"/>'
    line = lambda: f"<TextLine>{''.join(string() for _ in range(rng.randrange(4)))}<SP/></TextLine>"
    return ALTO.format("".join(f'<Page WIDTH="{k}"><PrintSpace>{"".join(line() for _ in range(rng.randrange(5)))}</PrintSpace></Page>\n<Other><Page/></Other>' for k in range(pages)))


def pdf_file(rng, pages):
    text = lambda: f'<text top="{rng.randrange(9)}">a <b>b{rng.randrange(99)}</b> c &amp; <i>d</i></text>'
    return PDF.format("".join(f'<page number="{k + 1}"><fontspec id="0"/>{"".join(text() for _ in range(rng.randrange(6)))}</page>' for k in range(pages)))


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
def test_pulled_pages_are_those_of_the_tree(monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    rng = random.Random(piece)
    for _ in range(15 if piece > 1 else 3):
        for kind, make, of_tree in ((S.ALTO, alto_file, zones.alto_pages), (S.PDF2XML, pdf_file, zones.pdf2xml_pages)):
            data = make(rng, rng.randrange(6)).encode()
            for mode in ("no", "dom", "regex", "all"):
                want = shown(of_tree(repair.load_xml(data, mode)))
                assert repair.well_formed(repair.text_pieces(data, mode))
                assert shown(zones._pages(data, kind, mode)) == want
            cut = data[: rng.randrange(60, len(data) - 20)]
            assert shown(zones._pages(cut, kind, "no")) == []
            tree = repair.load_xml(cut, "dom")
            assert shown(zones._pages(cut, kind, "dom")) == (shown(of_tree(tree)) if tree is not None else [])


@pytest.mark.parametrize("whole", [0, 1 << 21])
def test_small_files_are_parsed_once_and_large_ones_in_pieces(monkeypatch, whole):
    monkeypatch.setattr(zones, "WHOLE", whole)
    once = []
    monkeypatch.setattr(zones, "well_formed", lambda pieces: once.append(1) or repair.well_formed(pieces))
    rng = random.Random(5)
    for _ in range(15):
        for kind, make, of_tree in ((S.ALTO, alto_file, zones.alto_pages), (S.PDF2XML, pdf_file, zones.pdf2xml_pages)):
            data = make(rng, rng.randrange(6)).encode()
            cut = data[: rng.randrange(60, len(data) - 20)]
            for mode in ("no", "dom", "regex", "all"):
                assert shown(zones._pages(data, kind, mode)) == shown(of_tree(repair.load_xml(data, mode)))
                tree = repair.load_xml(cut, mode)
                assert shown(zones._pages(cut, kind, mode)) == ([] if tree is None else shown(of_tree(tree)))
    assert len(once) == (0 if whole else 240)
    assert zones._Rows(False, True).batch().num_rows == zones._Rows(False, True, False).batch().num_rows == 0


def test_runs_of_spaces_are_repaired():
    for raw in ("a  b", "a \n\tb\n\nc <b>  d</b>", " <i> </i> ", "  x", "a b", "", "  "):
        want = raw
        for pattern, new in repair.PDF2XML_REPAIRS:
            want = re.sub(pattern, new, want)
        assert repair.fix_pdf2xml_text(raw) == want


@pytest.mark.parametrize("text", ["<a>&nbsp;</a>", "<!DOCTYPE a SYSTEM 'x'><a>&nbsp;</a>", "<x:a/>", "", " ", "<a/><b/>", "<a>\x00</a>", "<a>￾</a>", "<?xml version='1.0' encoding='latin-1'?><a>é</a>", "  <?xml version='1.0'?><a/>", "﻿<a/>", "<a b='1' b='2'/>"])
@pytest.mark.parametrize("charset", ["utf-8", "latin-1", "utf-16"])
def test_well_formed_is_what_a_strict_tree_takes(text, charset):
    try:
        data = text.encode(charset)
    except UnicodeEncodeError:
        return
    for mode in ("no", "regex"):
        whole = "".join(repair.text_pieces(data, mode))
        assert repair.well_formed(repair.text_pieces(data, mode)) == (repair.parse_strict(whole) is not None)


def test_bytes_are_decoded_alike_in_pieces(monkeypatch):
    rng = random.Random(3)
    for _ in range(200):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xFF, 0x80]) for _ in range(rng.randrange(30)))
        monkeypatch.setattr(repair, "PIECE", 1 << 20)
        whole = [repair.as_text(data), "".join(repair.text_pieces(data, "regex"))]
        assert whole[1] == repair.fix_utf8_text(data)
        monkeypatch.setattr(repair, "PIECE", rng.randint(1, 4))
        assert [repair.as_text(data), "".join(repair.text_pieces(data, "regex"))] == whole


def test_a_large_file_takes_little_more_than_itself():
    """120 MB of pages: the tree of them would be ten times as large."""
    code = """
import resource, sys
sys.path.insert(0, %r)
from pagesearch import schemas as S
from pagesearch.sources import zones
page = '<Page WIDTH="9" HEIGHT="9">' + '<String CONTENT="word" HPOS="1" VPOS="1" WIDTH="2" HEIGHT="3"/>' * 400 + '</Page>'
data = ('<alto><Layout>' + page * 4800 + '</Layout></alto>').encode()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rows = zones._Rows(False, True)
n = sum(b.num_rows for b in rows.file(1, S.ALTO, 0, data, 'no')) + rows.batch().num_rows
print(len(data) >> 20, n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    root = zones.__file__.rpartition("/pagesearch/")[0]
    size, rows, more = map(int, subprocess.run([sys.executable, "-c", code % root], capture_output=True, text=True, check=True).stdout.split())
    assert size > 100 and rows == 4800 * 401 and more < 100


def images(width, height):
    w2, h2, w4, h4 = (struct.pack(f, v) for f, v in (("<H", width), ("<H", height), ("<I", width), ("<I", height)))
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    return {
        "png": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", width, height),
        "gif": b"GIF87a" + w2 + h2,
        "jpeg": b"\xff\xd8\xff\xe1" + struct.pack(">H", 9000) + b"x" * 8998 + b"\xff\xff\xc0\0\x11\x08" + struct.pack(">HH", height, width),
        "tiff": b"II*\0" + struct.pack("<I", 3_000_000) + bytes(2_999_992) + struct.pack("<H", 3) + struct.pack("<HHI", 254, 4, 1) + bytes(4) + struct.pack("<HHI", 256, 3, 1) + w2 + b"\0\0" + struct.pack("<HHI", 257, 4, 1) + h4 + bytes(4),
        "webp": b"RIFF....WEBPVP8 " + bytes(7) + b"\x9d\x01\x2a" + w2 + h2,
        "bmp": b"BM" + bytes(12) + struct.pack("<Iii", 40, width, -height),
        "os2": b"BM" + bytes(12) + struct.pack("<I", 12) + w2 + h2,
        "jp2": b"\0\0\0\x0cjP  \r\n\x87\n" + box(b"ftyp", b"jp2 ") + box(b"uuid", bytes(500_000)) + box(b"jp2h", box(b"ihdr", struct.pack(">II", height, width) + bytes(6))),
        "jpc": b"\xff\x4f\xff\x51" + bytes(4) + struct.pack(">IIII", width + 7, height + 9, 7, 9),
    }


def test_sizes_of_images_and_of_cut_ones():
    for width, height in ((1, 1), (1500, 2100), (16383, 9999)):
        for name, data in images(width, height).items():
            assert heads.image_header_size(data) == (width, height), name
    rng = random.Random(8)
    for data in images(640, 480).values():
        for _ in range(60):
            assert heads.image_header_size(data[: rng.randrange(40)]) in ((0, 0), (640, 480))
            broken = bytearray(data[:300])
            broken[rng.randrange(len(broken))] = rng.randrange(256)
            heads.image_header_size(bytes(broken))
    assert heads.image_header_size(None) == heads.image_header_size(b"words") == (0, 0)


def test_files_are_probed_by_ranges(spark, tmp_path):
    paths = []
    for k, (name, data) in enumerate(images(800, 600).items()):
        (tmp_path / name).write_bytes(data + bytes(2_000_000))
        paths.append((k, f"file:{tmp_path}/{name}" if k % 2 else str(tmp_path / name)))
    paths += [(100, str(tmp_path / "missing")), (101, "nowhere://x/y"), (102, None)]
    got = {r.media_id: r for r in heads.probed_files(spark.createDataFrame(paths, "media_id long, path string")).collect()}
    assert all((got[k].width, got[k].height) == (800, 600) and 0 < got[k].fetched <= 4 * heads.FETCH for k in range(len(paths) - 3))
    assert all((got[k].width, got[k].fetched) == (0, 0) for k in (100, 101, 102))


def test_pages_of_tiff_images_give_hits(spark, tmp_path):
    from pagesearch import search_matches
    from pagesearch.plans.search import corpus_from_sources

    (tmp_path / "scan.tif").write_bytes(images(1000, 2000)["tiff"])
    page = '<alto><Layout><Page WIDTH="1000" HEIGHT="2000"><String CONTENT="word" HPOS="1" VPOS="1" WIDTH="9" HEIGHT="9"/></Page></Layout></alto>'
    media = spark.createDataFrame([(7, 1, 1, S.ALTO, "a.xml", "a.xml", 9, None), (7, 2, 2, "image/tiff", "scan.tif", "scan.tif", 9, None)], S.MEDIA)
    contents = spark.createDataFrame([(1, page.encode())], "media_id bigint, content binary")
    none = spark.createDataFrame([], "item_id bigint, kind string, priority int, path string, content binary")
    probed = heads.probed_files(spark.createDataFrame([(2, str(tmp_path / "scan.tif"))], "media_id long, path string"))
    asked = spark.createDataFrame([(1, 7, "word")], S.QUERIES)
    for sizes, hits in ((probed, 1), (None, 0)):
        assert search_matches(corpus_from_sources(none, media, contents, probed=sizes), asked)[0].count() == hits
