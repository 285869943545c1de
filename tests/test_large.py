"""What keeps work in proportion to the input: no match, zone or pair is lost by it."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesearch.operators import match, results
from pagesearch.plans import testbed

ZONE = "item_id bigint, page_no int, zone_no int, text string"
TERM = "query_id bigint, item_id bigint, term_no int, term string"


@pytest.mark.parametrize("few", [0, 5])
def test_only_zones_with_a_term_meet_their_items_queries(spark, monkeypatch, few):
    monkeypatch.setattr(match, "FEW", few)
    texts = ["that", "Straße", "STRASSE", "ſee", "c++", "other", "", None, "xyz"]
    zones = spark.createDataFrame([(k % 3, 1, k, texts[k % len(texts)]) for k in range(90)], ZONE)
    terms = spark.createDataFrame([(i, i, n, t) for i in range(3) for n, t in enumerate(["THAT", "straße", "see", "C++", "no"])], TERM)
    want = sorted((k, t) for k in range(90) for t, has in (("THAT", (0,)), ("straße", (1,)), ("see", (3,)), ("C++", (4,))) if k % len(texts) in has)
    assert sorted((r.zone_no, r.term) for r in match.contains_join(zones, terms).collect()) == want
    assert match.holding_any(zones, terms).count() == (40 if few else 90)
    assert match.contains_join(zones, terms.filter("false")).count() == 0


def test_places_of_words_in_a_long_line(spark, monkeypatch):
    words = [("w" * (k % 5)) for k in range(500)]
    docs = spark.createDataFrame([(1, " ".join(words) + "\n\nend"), (2, ""), (3, None)], "doc_id bigint, text string")
    monkeypatch.setattr(testbed, "table", lambda *_: docs)
    got = sorted((r.zone_no, r.text, r.hpos) for r in testbed.document_zones(spark, "").collect())
    at = np.cumsum([0, *(len(w) + 1 for w in words)])
    assert got == [*((k, w, 10.0 * at[k]) for k, w in enumerate(words) if w), (2000000, "end", 0.0)]


@pytest.mark.parametrize("name", ["alto_scan", "alto_merge", "pdf2xml_scan"])
def test_files_are_made_within_a_documents_row(spark, name):
    plan = testbed.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and not re.search(r"Generate posexplode\(split\(line", plan)


def test_the_nearest_text_is_found_in_a_large_group():
    from pagesearch.llm import simhash

    rng = np.random.default_rng(8)
    n = 3000
    bytes_ = np.zeros((n, simhash.MINIMA), "u1")
    for k in range(1, n):
        bytes_[k, rng.choice(simhash.MINIMA, 18, replace=False)] = rng.integers(1, 255, 18)
    bytes_[2501] = bytes_[1202]  # whole groups of more than 1,024 were once thinned, and with them such a pair
    edges = {(min(a, b), max(a, b)) for x, y in simhash.block_edges(np.arange(n), bytes_) for a, b in zip(x.tolist(), y.tolist())}
    assert (1202, 2501) in edges and len(edges) < 3 * n


def test_compressed_files_of_responses_take_less_and_read_alike(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id % 3 query_id", "id % 3 item_id", "200 http_status", "1 section", "0 rank", "cast(id as int) number", "concat(',{\"@type\":\"oa:Annotation\",\"on\":', id, '}') part")
    size = lambda d: sum(f.stat().st_size for f in d.rglob("part-*"))
    read = lambda d: sorted(map(str, results.read_responses(spark, str(d)).collect()))
    results.write_responses(rows, str(tmp_path / "plain"))
    results.write_responses(rows, str(tmp_path / "small"), "gzip")
    assert size(tmp_path / "small") * 4 < size(tmp_path / "plain") and read(tmp_path / "small") == read(tmp_path / "plain")


def test_places_of_index_words_are_dealt_as_numbers(spark):
    plan = testbed.conversation_index(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    gathered = re.search(r"collect_list\((.*?), 0, 0\)", plan).group(1)
    assert ",20," in plan and ",20," not in gathered and "word_no" in gathered


def test_matches_are_dealt_once_for_annotations_and_hits(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = testbed.response_json(spark, "/root/testdata/sf0.001")
        assert df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert final.count("Generate posexplode(some") == 1 and "ReusedExchange" in final


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_a_search_of_stored_zones_deals_its_matches_once(spark, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        df = testbed.search_bodies(spark, "/root/testdata/sf0.001")
        assert df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in final.split("\n") if re.search(r"[-+] ReusedExchange \[[^\]]*zone_no.*hashpartitioning\(query_id", line)]
    assert len(dealt) == 1  # hits take what was dealt for annotations


def test_many_responses_share_a_file(spark, tmp_path):
    by = "query_id bigint, item_id bigint, "
    queries = spark.createDataFrame([(1, 7, "a b", "ok"), (2, 7, " ", "blank"), (3, 8, "", "missing_query"), (4, None, "x", "missing_id"), (6, 9, "wrong", "ok"), *((k, k, "é&\x1e\n", "ok") for k in range(10, 400))], by + "q string, status string")
    rows = [(1, 7, k // 150, 0, k + 1, f'c"{k}\x1e', f"id{k}", "t") for k in range(300)] + [(1, 7, 1, 1, 301, "", "meta", "t"), (6, 9, 1, 0, 1, "c", "i", None), (5, 5, 1, 0, 1, "c", "not asked", "t"), *((k, k, 4, 1, 1, "only\nmeta", "m", "t") for k in range(10, 400, 3))]
    annotations = spark.createDataFrame(rows, by + "page_no int, source_rank int, hit int, chars string, id string, target string").withColumn("matched", F.col("chars"))
    hits = results.hits_per_page(annotations.filter("source_rank = 0"))
    want = {(r.query_id, r.item_id, r.http_status): json.loads(r.body) for r in results.responses(queries, annotations, hits).collect()}
    for compression in ("none", "gzip"):
        folder = tmp_path / compression
        results.write_responses(results.response_parts(queries, annotations, hits), str(folder), compression, together=True)
        got = results.read_responses(spark, str(folder), together=True).collect()
        assert len(got) == len(want) == 395 and {(r.query_id, r.item_id, r.http_status): json.loads(r.body) for r in got} == want
        assert len(list(folder.rglob("part-*"))) <= 4  # a file for each task, not for each request


def test_files_of_responses_make_annotations_once(spark):
    queries = spark.createDataFrame([(1, 1, "q", "ok")], "query_id bigint, item_id bigint, q string, status string")
    annotations = testbed.document_annotations(spark, "/root/testdata/sf0.001", dealt=True)
    df = results.response_parts(queries, annotations, results.hits_per_page(annotations))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert final.count("Generate posexplode(some") == 1 and "ReusedExchange" in final
