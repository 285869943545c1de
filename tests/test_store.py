"""Versioned tables, trigrams, numbering in runs and texts so far, against plain versions."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from pagesearch.operators import match, results, trigrams
from pagesearch.sources.store import Conflict, Store

SCHEMA = "item_id bigint, text string"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def held(store, table="t", manifest=None):
    return sorted((r.item_id, r.text) for r in store.read(table, SCHEMA, manifest).collect())


def test_a_writer_that_stops_before_the_switch_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    assert held(store) == [] and store.manifest().number == 0
    store.replace_all({"t": frame(spark, (1, "a"), (2, "b"), (3, "c"))}, 4, {})

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "_switch", stop)
        with pytest.raises(RuntimeError):
            store.upsert(frame(spark, (2, "")), {"t": frame(spark, (2, "new"))}, {})
    assert held(Store(spark, str(tmp_path / "s"))) == [(1, "a"), (2, "b"), (3, "c")]
    open_before = store.read("t", SCHEMA)
    store.upsert(frame(spark, (2, ""), (3, "")), {"t": frame(spark, (2, "new"), (2, "more"))}, {})
    assert held(store) == [(1, "a"), (2, "more"), (2, "new")] and store.manifest().number == 2
    assert sorted(r.text for r in open_before.collect()) == ["a", "b", "c"]  # who has opened the old version keeps it
    assert held(store, manifest=store.manifest(1)) == [(1, "a"), (2, "b"), (3, "c")]
    assert len(store.vacuum(keep=1)) >= 1 and held(store) == [(1, "a"), (2, "more"), (2, "new")]
    assert all(not n.startswith(".") or n.endswith(".crc") for n in os.listdir(tmp_path / "s" / "manifest"))


def test_the_later_of_two_writers_is_told_to_try_again(spark, tmp_path, monkeypatch):
    store, other = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    store.replace_all({"t": frame(spark, (1, "a"))}, 2, {})
    old = other.manifest()
    store.upsert(frame(spark, (1, "")), {"t": frame(spark, (1, "b"))}, {})
    monkeypatch.setattr(other, "manifest", lambda number=None: old)
    with pytest.raises(Conflict):
        other.upsert(frame(spark, (1, "")), {"t": frame(spark, (1, "c"))}, {})
    assert held(store) == [(1, "b")]


def test_tables_switch_together_and_items_without_rows_go(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    tables = lambda *rows: {"t": frame(spark, *rows), "u": lambda done: done["t"].withColumn("text", F.upper("text"))}
    store.upsert(frame(spark, (1, ""), (2, "")), tables((1, "a"), (2, "b")), {}, 3)
    store.upsert(frame(spark, (2, ""), (9, "")), tables((9, "z")), {})
    assert held(store) == [(1, "a"), (9, "z")] and held(store, "u") == [(1, "A"), (9, "Z")] and store.manifest().buckets == 3


def test_large_buckets_have_several_files(spark, tmp_path):
    store, size = Store(spark, str(tmp_path / "s")), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "64k")
    try:
        rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("item_id"), F.md5(F.col("id").cast("string")).alias("text"))
        store.replace_all({"t": rows.repartition(8)}, 2, {})
    finally:
        spark.conf.set(size, before)
    files = [f for d, _, fs in os.walk(tmp_path / "s" / "data") for f in fs if f.endswith(".parquet")]
    assert len(files) > 6 and store.read("t", SCHEMA).count() == 60_000


def zone_rows(spark, n=400):
    random.seed(3)
    words = ["Straße", "STRASSE", "Éte", "été", "ſee", "See", "K9", "k9", "C++", "naïve", "日本語", "ab", "abc", "ABCabc", "x", "", "Größe groß", "İstanbul", "Ωmega", "ωMEGA"]
    return spark.createDataFrame([(k % 5, k // 50, k, " ".join(random.choices(words, k=random.randint(0, 3)))) for k in range(n)], "item_id bigint, page_no int, zone_no int, text string")


def test_trigrams_lose_no_match_and_spare_the_pattern(spark):
    zones = zone_rows(spark)
    asked = ["straße", "ÉTÉ", "été", "see", "k9 ", "c++", "ab", "x", "abc", "groß", "日本語", "istanbul", "Ωmega", "naïve c", "nowhere", "bca"]
    terms = spark.createDataFrame([(100 * k + i, i, k, t) for k, t in enumerate(asked) for i in range(5)], "query_id bigint, item_id bigint, term_no int, term string")
    table = trigrams.gram_table(zones)
    counts = trigrams.gram_counts(table)
    plain = match.contains_join(zones, terms)
    got = trigrams.contains_join_by_grams(zones, terms, table, counts).select(*plain.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and plain.count() > 500
    long = terms.filter(F.char_length("term") >= 3)
    seen = trigrams.candidates(zones, long, table, counts).count()
    held = plain.filter(F.char_length("term") >= 3).count()
    every = long.join(zones, "item_id").count()
    assert held <= seen < 1.6 * held and seen < every / 4


def stored_corpus(spark, zones, items):
    from pagesearch import schemas as S
    from pagesearch.plans.search import Corpus

    none = spark.createDataFrame([], "item_id bigint, line_no int, word string, positions string")
    return Corpus(zones, none, spark.createDataFrame([], S.IMAGES), spark.createDataFrame([], S.MEDIA_VALUES), items, items)


@pytest.mark.parametrize("few", [0, 32])
@pytest.mark.parametrize("dealt", [False, True])
def test_stored_texts_are_few_and_find_all_zones(spark, tmp_path, monkeypatch, dealt, few):
    from pagesearch.plans.search import save_zones, saved_corpus, update_zones, zones_with_terms

    monkeypatch.setattr(match, "FEW", few)
    zones, folder = zone_rows(spark, 2000).filter("zone_no % 7 <> 0"), str(tmp_path / "z")
    items = zones.select("item_id").distinct()
    store, rows = Store(spark, folder), lambda df: sorted(map(str, df.collect()))
    save_zones(stored_corpus(spark, zones.repartition(3, "item_id"), items), folder, 2, dealt)
    texts = saved_corpus(stored_corpus(spark, zones, items), folder).texts
    assert rows(texts.select("bucket", "text")) == rows(saved_corpus(stored_corpus(spark, zones, items), folder).zones.select("bucket", "text").distinct())
    assert sum(store.read(t, "item_id bigint").count() for t in store.manifest().tables if t != "zones") == texts.count() < zones.count()
    new = zones.filter("item_id = 1").withColumn("text", F.concat(F.lit("neu "), "text"))
    update_zones(stored_corpus(spark, new, items.filter("item_id < 3")), folder, dealt)
    now = zones.filter("item_id > 2").unionByName(new)
    saved = saved_corpus(stored_corpus(spark, zones, items), folder)
    assert rows(saved.zones.select(*now.columns)) == rows(now)
    asked = ["straße", "ÉTÉ", "see", "k9 ", "c++", "ab", "x", "neu", "neu ab", "日本語", "nowhere", "see"]
    terms = spark.createDataFrame([(100 * k + i, i, k, t) for k, t in enumerate(asked) for i in range(5) if (i + k) % 3], "query_id bigint, item_id bigint, term_no int, term string")
    plain = match.contains_join(now, terms)
    assert saved.texts is not None and rows(zones_with_terms(saved, terms).select(*plain.columns)) == rows(plain) and plain.count() > 500
    store.upsert(items.filter("item_id = 4"), {"zones": new.withColumn("item_id", F.lit(4).cast("bigint"))}, {})
    assert saved_corpus(stored_corpus(spark, zones, items), folder).texts is None  # texts of older zones are not relied on


def test_dealt_rows_are_written_from_their_partitions(spark, tmp_path):
    rows = spark.range(900).select((F.col("id") % 90).alias("item_id"), F.col("id").cast("string").alias("text")).repartition(3, "item_id")
    store, tracker = Store(spark, str(tmp_path / "s")), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("dealt", "dealt")
    try:
        store.replace_all({"t": rows}, 4, {}, dealt=True)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in tracker.getJobIdsForGroup("dealt") for s in tracker.getJobInfo(j).stageIds}
    files = [f for d, _, fs in os.walk(tmp_path / "s" / "data") for f in fs if f.endswith(".parquet")]
    assert 0 < len(stages) < 4 and len(files) <= 12 and store.read("t", SCHEMA).count() == 900
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def spilling_stages(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {found.apply(k).stageId() for k in range(found.size()) if found.apply(k).memoryBytesSpilled()}


def test_dealt_rows_are_not_sorted_once_every_bucket_is_open(spark, tmp_path):
    conf, key = spark._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    before, done = conf.get(key, "2147483647"), spilling_stages(spark)
    conf.set(key, "100")  # a sorter of more rows spills
    try:
        Store(spark, str(tmp_path / "s")).replace_all({"t": spark.range(4000).withColumnRenamed("id", "item_id")}, 4, {}, dealt=True)
    finally:
        conf.set(key, before)
    assert spilling_stages(spark) == done


def test_trigrams_of_a_long_text_take_one_pass(spark):
    random.seed(4)
    text = "".join(random.choices("abcÉéß 日\n", k=60_000))
    rows = spark.createDataFrame([(1, text), (2, "ab"), (3, ""), (4, None), (5, "a😀b")], SCHEMA)
    began = time.perf_counter()
    got = {r.item_id: r.g for r in rows.select("item_id", trigrams.grams(F.col("text")).alias("g"), trigrams.folded(F.col("text")).alias("f")).withColumn("g", F.sort_array("g")).collect()}
    assert time.perf_counter() - began < 30  # folding the text again for each place takes minutes
    whole = rows.filter("item_id = 1").select(trigrams.folded(F.col("text"))).first()[0]
    assert got[1] == sorted({whole[k : k + 3] for k in range(len(whole) - 2)}) and got[2] == got[3] == [] and got[5] == [f"a{trigrams.OTHER}b"]


def test_folded_characters_are_those_that_a_pattern_takes_as_one(spark):
    chars = {chr(c) for c in [*range(1, 0x590), *range(0x1C80, 0x1C90), *range(0x1E00, 0x2000), *range(0x2100, 0x2190), *range(0xA640, 0xA7C0)]}
    pairs = {(c, o) for c in chars for o in (c.upper(), c.lower(), c.title(), c.upper().lower(), c.casefold()) if len(o) == 1 and o != c}
    rows = spark.createDataFrame(sorted(pairs | {(b, a) for a, b in pairs}), "a string, b string")
    alike = F.call_function("rlike", F.col("a"), F.concat(F.lit(r"(?iu)^\Q"), F.col("b"), F.lit(r"\E$")))
    one = rows.select("a", "b", alike.alias("alike"), trigrams.folded(F.col("a")).alias("x"), trigrams.folded(F.col("b")).alias("y"))
    assert one.filter("alike").count() > 1500 and one.filter("alike and x <> y or char_length(x) <> 1").collect() == []


@pytest.mark.parametrize("within", [["page_no"], ["page_no", "zone_no div 3"]])
def test_numbers_by_runs_are_the_numbers_of_the_whole(spark, within):
    random.seed(5)
    rows = spark.createDataFrame([(random.randint(1, 3), random.randint(1, 2), random.randint(1, 9), k, 0) for k in range(500)], "query_id bigint, item_id bigint, page_no int, zone_no int, term_no int")
    order = ("page_no", "zone_no", "term_no")
    runs = match.number_hits(rows, *order, within=[F.expr(e) for e in within])
    assert sorted(map(str, runs.select(*rows.columns, "hit").collect())) == sorted(map(str, match.number_hits(rows, *order).select(*rows.columns, "hit").collect()))


def test_many_hits_of_one_item_and_their_texts_so_far(spark):
    rows = spark.range(300_000).select(F.lit(1).cast("bigint").alias("query_id"), F.lit(7).cast("bigint").alias("item_id"), F.expr("cast(id div 100 + 1 as int)").alias("page_no"), F.expr("cast(id + 1 as int)").alias("hit"), F.concat(F.lit("w"), F.expr("cast(sqrt(id div 1000) as int)").cast("string")).alias("matched"), F.lit("i").alias("id"))
    got = {r.page_no: r.match for r in results.hits_per_page(rows, cumulative=True).select("page_no", "match").collect()}
    assert len(got) == 3000 and got[1] == "w0" and got[3000] == " ".join(f"w{k}" for k in range(18))
    assert got[11] == "w0 w1"


def test_texts_so_far_are_in_order_of_first_hits(spark):
    hits = [(1, 7, 2, 3, "b", "x"), (1, 7, 1, 1, "a", "x"), (1, 7, 2, 2, "a", "x"), (1, 7, 3, 4, None, "x"), (1, 7, 5, 6, "c", "x"), (1, 7, 5, 5, "d", "x"), (2, 7, 1, 1, "z", "x")]
    rows = spark.createDataFrame(hits, "query_id bigint, item_id bigint, page_no int, hit int, matched string, id string")
    got = {(r.query_id, r.page_no): r.match for r in results.hits_per_page(rows, cumulative=True).collect()}
    assert got == {(1, 1): "a", (1, 2): "a b", (1, 3): "a b", (1, 5): "a b d c", (2, 1): "z"}


def test_the_latest_version_of_a_streamed_file_counts(spark, tmp_path):
    from pagesearch import schemas as S
    from pagesearch.streaming.ingest import stream_zones, streamed_zones

    xml = '<alto><Layout><Page WIDTH="9" HEIGHT="9"><String CONTENT="{}" HPOS="1" VPOS="1" WIDTH="1" HEIGHT="1"/></Page></Layout></alto>'
    (tmp_path / "in").mkdir()

    def put(name, text, seconds):
        (tmp_path / "in" / name).write_text(xml.format(text))
        os.utime(tmp_path / "in" / name, (seconds, seconds))

    def run(state="state"):
        stream_zones(spark, str(tmp_path / "in"), S.ALTO, str(tmp_path / "zones"), str(tmp_path / state)).awaitTermination()
        return sorted((r.item_id, r.text) for r in streamed_zones(spark, str(tmp_path / "zones")).collect())

    put("7.xml", "one", 1000), put("8.xml", "other", 1000)
    assert run() == [(7, "one"), (8, "other")]
    put("7.b.xml", "two", 2000)
    assert run() == [(7, "two"), (8, "other")]
    put("7.c.xml", "late", 1500)  # an older version that comes last
    assert run() == [(7, "two"), (8, "other")]
    number = Store(spark, str(tmp_path / "zones")).manifest().number
    assert run("again") == [(7, "two"), (8, "other")]  # all of it once more
    assert Store(spark, str(tmp_path / "zones")).manifest().number == number == 2


def test_metadata_holds_all_words_of_the_query(spark):
    from pagesearch.functions.text import clean_query

    random.seed(9)
    words = ["The", "the", "of", "Été", "c++", "a.b", "x", ""]
    values = spark.createDataFrame([(i, m, m % 4, random.choice([None, "", " ".join(random.choices(words, k=random.randint(1, 5)))])) for i in range(3) for m in range(40)] + [(1, 3, 1, "the of"), (1, 3, 1, "the of"), (1, 3, 1, "of")], "item_id bigint, media_id bigint, position int, text string")
    asked = spark.createDataFrame([(k, i, q) for k, (i, q) in enumerate((i, q) for i in (0, 1, 2, None) for q in ("the of", "of the the", " été ", "a b", "C++ x", "", "  ", None, "nowhere of"))], "query_id bigint, item_id bigint, q string")
    split = lambda c: F.split(clean_query(F.lower(F.coalesce(c, F.lit("")))), " ")
    plain = values.withColumn("has", split(F.col("text"))).join(asked.select("query_id", F.col("item_id").alias("i"), split(F.trim("q")).alias("words")).filter("words[0] <> ''"), F.col("item_id") == F.col("i"))
    plain = plain.filter(F.size(F.array_except("words", "has")) == 0).select("query_id", "item_id", "media_id", "position")
    postings = results.metadata_postings(values)
    for got in (results.metadata_matches(asked, values), results.metadata_matches(asked, postings=postings)):
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and plain.count() > 20


def test_files_of_responses_are_their_bodies(spark, tmp_path):
    import json

    by = "query_id bigint, item_id bigint, "
    queries = spark.createDataFrame([(1, 7, "a b", "ok"), (2, 7, " ", "blank"), (3, 8, "", "missing_query"), (4, None, "x", "missing_id"), (5, 9, "é&", "ok"), (6, 9, "wrong", "ok")], by + "q string, status string")
    rows = [(1, 7, 1 if k < 150 else 2, 0, k + 1, f"c\"{k}", f"id{k}", "t") for k in range(300)] + [(1, 7, 1, 1, 301, "", "meta", "t"), (5, 9, 4, 1, 1, "only\nmeta", "m", "t"), (6, 9, 1, 0, 1, "c", "i", None)]
    annotations = spark.createDataFrame(rows, by + "page_no int, source_rank int, hit int, chars string, id string, target string").withColumn("matched", F.col("chars"))
    hits = results.hits_per_page(annotations.filter("source_rank = 0"))
    want = {(r.query_id, r.http_status): json.loads(r.body) for r in results.responses(queries, annotations, hits).collect()}
    results.write_responses(results.response_parts(queries, annotations, hits), str(tmp_path / "out"))
    assert {(r.query_id, r.http_status): json.loads(r.body) for r in results.read_responses(spark, str(tmp_path / "out")).collect()} == want
    files = [os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "out") for f in fs if f.startswith("part-")]
    assert len(files) == 6 and all(json.loads(open(f).read()) in want.values() for f in files)


def test_files_are_parsed_once_where_they_are_merged_into_a_folder(spark, tmp_path):
    from pagesearch import schemas as S
    from pagesearch.plans.search import merged_layout

    page = '<Page WIDTH="9" HEIGHT="9"><String CONTENT="{}" HPOS="1" VPOS="1" WIDTH="1" HEIGHT="1"/></Page>'
    rows = [(i, S.ALTO, k, f"<alto><Layout>{''.join(page.format(f'{i}.{k}.{p}') for p in range(1 + (i + k) % 3))}</Layout></alto>".encode()) for i in range(5) for k in range(4)] + [(1, S.ALTO, 4, b"broken"), (9, S.ALTO, 0, b"<alto/>"), (9, S.ALTO, 1, rows_page(page))]
    files = spark.createDataFrame(rows, "item_id bigint, kind string, file_no int, content binary")
    got = merged_layout(files, str(tmp_path / "parsed"))
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, merged_layout(files).select(*got.columns).collect())) and got.count() > 20


def rows_page(page):
    return f"<alto><Layout>{page.format('later')}</Layout></alto>".encode()


def test_only_new_files_are_read(spark, tmp_path):
    from pagesearch import schemas as S
    from pagesearch.sources import listing
    from pagesearch.streaming.ingest import refresh_files, streamed_zones

    xml = '<alto><Layout><Page WIDTH="9" HEIGHT="9"><String CONTENT="{}" HPOS="1" VPOS="1" WIDTH="1" HEIGHT="1"/></Page></Layout></alto>'
    for k in range(20):
        folder = tmp_path / "in" / f"d{k % 3}" / "deep" if k else tmp_path / "in"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{k}.xml").write_text(xml.format(f"w{k}"))
        os.utime(folder / f"{k}.xml", (1000, 1000))
    store = Store(spark, str(tmp_path / "zones"))
    texts = lambda: sorted(r.text for r in streamed_zones(spark, str(tmp_path / "zones")).collect())
    listed = {r.path: r for r in listing.listed_files(spark, [f"file:{tmp_path}/in", str(tmp_path / "none")]).collect()}
    assert len(listed) == 20 and all(p.startswith("file:") and r.length > 100 and r.modified.timestamp() == 1000 for p, r in listed.items())
    assert refresh_files(store, [f"file:{tmp_path}/in"], S.ALTO) == (20, 0) and len(texts()) == 20
    assert refresh_files(store, [f"file:{tmp_path}/in"], S.ALTO) == (0, 0) and store.manifest().number == 1
    (tmp_path / "in" / "d1" / "deep" / "1.xml").write_text(xml.format("changed"))
    (tmp_path / "in" / "d1" / "deep" / "77.xml").write_text(xml.format("new"))
    (tmp_path / "in" / "d2" / "deep" / "2.xml").unlink()
    assert refresh_files(store, [f"file:{tmp_path}/in"], S.ALTO) == (2, 1)
    assert texts() == sorted([*(f"w{k}" for k in range(20) if k not in (1, 2)), "changed", "new"])
    known = listing.listed_files(spark, [str(tmp_path / "in")])
    assert listing.changed_files(known, known.filter("path not like '%/77.xml'")).count() == 1
    missing = spark.createDataFrame([(str(tmp_path / "gone"),)], "path string")
    assert [r.content for r in listing.read_files(missing).collect()] == [None]
