"""Scalar functions and single-file sources."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from pagesearch import SearchConfig
from pagesearch import schemas as S
from pagesearch.functions import geometry, text
from pagesearch.functions.repair import as_text, fix_pdf2xml_text, fix_utf8_bytes, load_xml, parse_recovering
from pagesearch.operators import advertise, match, results
from pagesearch.plans import testbed
from pagesearch.sources import media, sniff, zones


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("q,clean,terms", [("  Bonjour,  le monde! ", "Bonjour le monde", ["Bonjour", "monde", "Bonjour le monde"]), ("l'été_2020", "l été 2020", ["été", "2020", "l été 2020"]), ("le", "le", []), ("a b", "a b", []), ("C++", "C++", ["C++"]), ("le la monde", "le la monde", ["monde"]), ("...", "", []), ("monde monde", "monde monde", ["monde", "monde", "monde monde"])])
def test_query_terms(spark, q, clean, terms):
    assert one(spark, text.clean_query(F.col("q")), q=q) == clean
    assert one(spark, text.query_terms(F.col("q")), q=q) == terms


def test_settings():
    assert SearchConfig(min_query_length=0).shortest == 3 and SearchConfig(min_query_length=2).shortest == 2
    for bad in ({"xml_image_match": "x"}, {"xml_fix_mode": "x"}):
        with pytest.raises(ValueError):
            SearchConfig(**bad)


def test_matching_is_literal_and_knows_case_of_all_letters(spark):
    assert one(spark, text.contains(F.col("t"), F.col("q")), t="L'ÉTÉ", q="été") is True
    assert one(spark, text.contains(F.col("t"), F.col("q")), t="abc", q="a+c") is False
    assert one(spark, text.first_match(F.col("t"), F.col("q")), t="xBONjour bonjour", q="bonjour") == "BONjour"
    assert one(spark, text.quoted(F.col("q")), q="a+$b") == r"a\+\$b"
    assert [text.slug_of(w) for w in ("Été", "ßœ", None, "ñÑ")] == ["ete", "ßœ", None, "nn"]


def test_names_and_markup(spark):
    assert one(spark, text.file_stem(F.col("p")), p="a/b.c/p1.alto.xml") == "p1.alto"
    assert one(spark, text.main_type(F.col("p")), p="image/png") == "image"
    assert one(spark, text.strip_tags(F.col("p")), p="a<b c='d'>e</b> f") == "ae f"
    raw = 'x  y <b>z</b>\n<fontspec id="\x03\n<!doctype pdf2xml system "pdf2xml.dtd">'
    assert one(spark, text.fix_pdf2xml(F.col("p")), p=raw) == fix_pdf2xml_text(raw) == 'x y z\n<!DOCTYPE pdf2xml SYSTEM "pdf2xml.dtd">'


@pytest.mark.parametrize("page,image,want", [((1000.0, 2000.0), (1500.0, 3000.0), (195, 300, 75, 30)), ((1000.0, 2000.0), (None, None), (130, 200, 50, 20)), ((None, None), (1500.0, 3000.0), (130, 200, 50, 20)), ((0.0, 0.0), (0.0, 0.0), (130, 200, 50, 20))])
def test_box(spark, page, image, want):
    d = lambda v: F.lit(v).cast("double")
    b = geometry.box(F.lit("Bonjour"), F.lit("jour"), d(100), d(200), d(70), d(20), tuple(map(d, page)), tuple(map(d, image)))
    assert tuple(spark.range(1).select(b.alias("b")).first()["b"]) == want
    whole = geometry.box(F.lit(""), F.lit(""), d(0), d(0), d(70), d(20), tuple(map(d, page)), tuple(map(d, page)))
    assert tuple(spark.range(1).select(whole.alias("b")).first()["b"]) == (0, 0, 70, 20)


def test_box_when_the_text_lacks_the_characters(spark):
    d = lambda v: F.lit(v).cast("double")
    b = geometry.box(F.lit("abcd"), F.lit("x"), d(10), d(0), d(40), d(5), (d(1), d(1)), (d(1), d(1)))
    assert tuple(spark.range(1).select(b.alias("b")).first()["b"]) == (10, 0, 20, 5)


@pytest.mark.parametrize("raw,fixed", [("61E962", "61C3A962"), ("618062", "61C28062"), ("C3A9", "C3A9"), ("E9A0", "C3A9C2A0"), ("", ""), ("F09F9880FF", "F09F9880C3BF")])
def test_utf8_repair(raw, fixed):
    assert fix_utf8_bytes(bytes.fromhex(raw)) == bytes.fromhex(fixed)


def test_broken_xml_is_recovered():
    root = parse_recovering('<a x="1"><b>one &amp; two<c/></a><d>')
    assert root.tag == "a" and root.get("x") == "1" and root[0].text == "one & two"
    assert parse_recovering("no markup") is None and load_xml(b"", "all") is None
    assert load_xml(b"<a><b></a>") is None and load_xml(b"<a><b></a>", "dom").tag == "a"
    assert load_xml(b"<a>\xe9</a>", "regex").text == "é" and as_text(b"\xe9") == "é"


def test_validity_of_sizes(spark):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(["", "0", None, "5"])], "k int, v string")
    five = F.lit("5")
    assert [r.x for r in rows.orderBy("k").select(zones.zone_code(F.col("v"), five, five, five).alias("x")).collect()] == ["zone_incomplete", None, "zone_incomplete", None]
    assert [r.x for r in rows.orderBy("k").select(zones.zone_code(five, five, F.col("v"), five).alias("x")).collect()] == ["zone_incomplete", "zone_incomplete", "zone_incomplete", None]


def page(texts, size='WIDTH="10" HEIGHT="10"'):
    return f"<Page {size}>" + "".join(f'<String CONTENT="{t}" HPOS="1" VPOS="1" WIDTH="1" HEIGHT="1"/>' for t in texts) + "</Page>"


def alto(*pages):
    return ("<alto><Layout>" + "".join(pages) + "</Layout></alto>").encode()


def test_merge(spark):
    files = [(1, 0, alto(page(["a"]), page(["b"]))), (1, 1, alto(page(["c"]), page(["d"]), page(["e"]))), (1, 2, b"broken"), (1, 3, alto("<Page/>")), (1, 4, alto(page(["f"]))), (2, 0, b"broken"), (2, 1, alto(page(["g"]))), (3, 0, b"<alto><Layout/></alto>")]
    df = spark.createDataFrame([(i, S.ALTO, n, c) for i, n, c in files], "item_id bigint, kind string, file_no int, content binary")
    parsed = zones.parse_files(df)
    got = {(r.item_id, r.page_no): r.text for r in zones.merge_pages(parsed).collect() if r.zone_no}
    assert got == {(1, 1): "a", (1, 2): "b", (1, 3): "c", (1, 6): "f"}
    assert {(r.page_no, r.code) for r in zones.page_diagnostics(zones.merge_pages(parsed)).collect()} == {(4, "page_incomplete"), (5, "page_incomplete")}
    every = {(r.item_id, r.page_no): r.text for r in zones.merge_pages(parsed, all_pages=True).collect() if r.zone_no}
    assert every == {(1, 1): "a", (1, 2): "b", (1, 3): "c", (1, 4): "d", (1, 5): "e", (1, 8): "f"}


def test_word_index_keeps_the_last_positions_and_the_first_line(spark):
    df = spark.createDataFrame([(1, S.TSV, b'b\t1:1,1,1,1\r\na\t1:2,2,2,2\nb\t2:3,3,3,3;3:4,4,4,4\n"q\tx')], "item_id bigint, kind string, content binary")
    words = zones.read_word_index(df)
    assert sorted(map(tuple, words.collect())) == [(1, 0, "b", "2:3,3,3,3;3:4,4,4,4"), (1, 1, "a", "1:2,2,2,2"), (1, 3, '"q', "x")]
    z = match.index_zones(words).orderBy("line_no", "position_no").collect()
    assert [(r.page_no, r.hpos, r.zone_code) for r in z] == [(2, 3.0, None), (3, 4.0, None), (1, 2.0, None), (None, None, "zone_incomplete")]


HEADS = [
    (b'<!DOCTYPE pdf2xml SYSTEM "pdf2xml.dtd"><x/>', "application/vnd.pdf2xml+xml"),
    (b'<alto xmlns="http://www.loc.gov/standards/alto/ns-v3#"><a></alto>', "application/alto+xml"),
    (b"<alto>", "application/alto+xml"),
    (b"<mets/>", "application/mets+xml"),
    (b"<unknown/>", "text/xml"),
    (b'<?xml-stylesheet href="a.xsl"?><TEI xmlns="http://www.tei-c.org/ns/1.0"/>', "application/tei+xml"),
    (b'<?xml-model href="http://www.music-encoding.org/schema/3.0.0/mei-all.rng"?><x/>', "application/vnd.mei+xml"),
    (b'<office:document xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" office:mimetype="application/vnd.oasis.opendocument.text"/>', "application/vnd.oasis.opendocument.text-flat-xml"),
    (b"<mods & broken", "text/xml"),
    (b"PK\x03\x04" + b"\0" * 26 + b"mimetypeapplication/epub+zipPK\x03\x04", "application/epub+zip"),
    (b"PK\x03\x04" + b"\0" * 40, "application/zip"),
    (b"%PDF-1.4", "application/pdf"),
    (b"plain", "text/plain"),
]


def test_media_types():
    assert [sniff.precise_type(d) for d, _ in HEADS] == [t for _, t in HEADS]
    assert sniff.precise_type(None, "x/y") == "x/y" and sniff.precise_type(b"<alto/>", "application/xml") == "application/alto+xml"
    assert len(sniff.IDENTIFIERS) == 46


def test_upload_rules(spark):
    check = lambda t, e, types, ends, off=False: one(spark, sniff.upload_errors(F.col("t"), F.col("e"), types, ends, off), t=t, e=e)
    assert check("application/alto+xml", "xml", ["text/xml"], ["xml"]) == []
    assert check("application/alto+xml", "exe", ["image/png"], ["xml"]) == ["media_type", "extension"]
    assert check("", "", ["image/png"], ["xml"]) == [] and check("a/b", "c", None, None) == [] and check("a/b", "c", [], [], True) == []


def test_image_headers():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + struct.pack(">I", zlib.crc32(b""))
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"\0\0" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 48, 64)
    assert [media.image_header_size(d) for d in (png, jpeg, b"GIF89a" + struct.pack("<HH", 3, 4), b"x", None, b"\xff\xd8\xff")] == [(640, 480), (64, 48), (3, 4), (0, 0), (0, 0), (0, 0)]


def test_files_and_media_of_items(spark, tmp_path):
    for name, content in (("index/1.tsv", "a\t1:1,1,1,1"), ("pdf2xml/1.xml", "<pdf2xml/>"), ("alto/2.alto.xml", "<alto/>"), ("index/3.xml", "<alto/>"), ("pdf2xml/2.xml", "<pdf2xml/>")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content)
    found = media.resolve_files(media.list_files(spark, str(tmp_path)))
    assert {r.item_id: r.kind for r in found.collect()} == {1: S.TSV, 2: S.PDF2XML, 3: "legacy"}
    assert media.list_files(spark, str(tmp_path / "none")).count() == 0
    rows = [(1, 10, 2, "image/png", "p1.png", "f", 1, '{"width":5,"height":6}'), (1, 11, 1, S.ALTO, "x/p2.xml", "f", 1, None), (1, 12, 3, "image/png", "p2.png", "f", 1, '{"dimensions":{"original":{"width":7,"height":8}}}'), (1, 13, 4, "text/plain", "t", "f", 1, None), (1, 14, 5, "image/gif", "p3.gif", "f", 1, None), (2, 20, 1, S.TSV, "a", "f", 1, None), (2, 21, 2, S.TSV, "b", "f", 1, None), (3, 30, 1, S.ALTO, "z", "f", 0, None)]
    m = spark.createDataFrame(rows, S.MEDIA)
    images = media.image_sizes(m)
    assert sorted((r.media_id, r.image_index, r.width, r.height) for r in images.collect()) == [(10, 0, 5.0, 6.0), (12, 1, 7.0, 8.0), (14, 2, 0.0, 0.0)]
    contents = spark.createDataFrame([(11, b"x"), (21, b"y")], "media_id bigint, content binary")
    order = {(r.item_id, r.kind, r.file_no, r.media_id) for r in media.media_files(m, images, contents).collect()}
    assert order == {(1, S.ALTO, 0, 11), (2, S.TSV, 0, 21)}
    named = {(r.item_id, r.file_no, r.media_id) for r in media.media_files(m, images, contents, "basename").collect() if r.item_id == 1}
    assert named == {(1, 0, None), (1, 1, 11), (1, 2, None)}
    assert [r.media_id for r in media.mergeable(m).collect()] == [11]


def test_advertisement(spark):
    items = spark.createDataFrame([(1, "item"), (2, "set"), (3, None), (4, "item")], "item_id bigint, type string")
    m = spark.createDataFrame([(1, S.ALTO), (2, S.ALTO), (4, "text/xml")], "item_id bigint, media_type string")
    files = spark.createDataFrame([(3,)], "item_id bigint")
    found = advertise.searchable_items(items, m, files)
    assert {r.item_id for r in found.collect()} == {1, 3}
    both = advertise.service_descriptions(found).filter("item_id = 1").first().services
    assert '"@type":"SearchService0"' in both and '"type":"SearchService1"' in both
    assert "SearchService" not in advertise.service_descriptions(found, versions=(0,)).first().services


def test_json_requirements(spark):
    df = spark.createDataFrame([("a", None)], "id string, target string").withColumn("chars", F.lit("x"))
    row = df.select(results.annotation_struct().alias("a")).select(results.missing_keys(F.col("a"), S.ANNOTATION_KEYS).alias("m"), F.to_json("a").alias("j")).first()
    assert row.m == ["on"] and '"on"' not in row.j
    filled = results.with_defaults(df, {"target": "t", "more": 1}).first()
    assert (filled.target, filled.more) == ("t", 1)


def test_stream_of_files(spark, tmp_path):
    from pagesearch.streaming.ingest import stream_zones, streamed_zones

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "7.xml").write_bytes(alto(page(["a", "b"])))
    stream_zones(spark, str(tmp_path / "in"), S.ALTO, str(tmp_path / "zones"), str(tmp_path / "state")).awaitTermination()
    assert sorted((r.item_id, r.text) for r in streamed_zones(spark, str(tmp_path / "zones")).collect()) == [(7, "a"), (7, "b")]


def test_stream_types_files_and_replaces_a_batch_that_is_tried_again(spark, tmp_path):
    import shutil

    from pagesearch.streaming.ingest import stream_zones, streamed_zones

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "7.xml").write_bytes(alto(page(["a", "b"])))
    (tmp_path / "in" / "8.xml").write_bytes(b"<mets/>")
    for _ in range(2):  # the second time its state is gone, so the batch comes again
        stream_zones(spark, str(tmp_path / "in"), None, str(tmp_path / "zones"), str(tmp_path / "state")).awaitTermination()
        shutil.rmtree(tmp_path / "state")
    assert sorted((r.item_id, r.text) for r in streamed_zones(spark, str(tmp_path / "zones")).collect()) == [(7, "a"), (7, "b")]
    with pytest.raises(ValueError):
        stream_zones(spark, "in", S.TSV, "zones", "state")


def test_media_of_nested_paths(spark):
    paths = spark.createDataFrame([("/f/original/ab/cd.xml",), ("/f/original/xy/cd.xml",), ("/f/cd.xml",), ("/g/original/ab/cd.xml",), ("/f/original/no.",)], "path string")
    media_rows = spark.createDataFrame([(1, "ab/cd.xml"), (2, "xy/cd.xml"), (3, "cd.jpg"), (4, "no.")], "media_id bigint, filename string")
    got = {r.path: r.media_id for r in sniff.media_of_path(paths, media_rows, "/f").collect()}
    assert got == {"/f/original/ab/cd.xml": 1, "/f/original/xy/cd.xml": 2, "/f/cd.xml": 3, "/g/original/ab/cd.xml": None, "/f/original/no.": 4}


@pytest.mark.parametrize("all_pages", [False, True])
def test_pages_of_files_that_come_together_are_numbered_in_one_pass(spark, all_pages):
    page = lambda t: f'<Page WIDTH="9" HEIGHT="9"><String CONTENT="{t}" HPOS="0" VPOS="0" WIDTH="1" HEIGHT="1"/></Page>'
    file = lambda *ts: f"<alto><Layout>{''.join(page(t) if t else '<Page/>' for t in ts)}</Layout></alto>".encode()
    of = {1: [file("a", "b"), file("c", "d"), None, b"<alto>", file("", "e"), file(), file("f")], 2: [None, file("g")], 3: [file("h")], 4: [file(), file("i")], 5: [file("j", "", "k"), b"", file("l", "m")]}
    rows = [(item, S.ALTO, k, content) for item, contents in of.items() for k, content in enumerate(contents)]
    files = spark.createDataFrame(rows, "item_id bigint, kind string, file_no int, content binary").coalesce(1)
    want = zones.merge_pages(zones.parse_files(files), all_pages)
    got = zones.parse_items(files, all_pages=all_pages, together=True)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and got.count() > 10


def test_files_of_pages_are_made_and_parsed_once(spark):
    plan = testbed.alto_merge(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("parquet") == 1 and plan.count("mapInArrow(run") + plan.count("MapInArrow run") <= 2
