"""Matching zones with query terms, and numbering the hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions.text import contains, first_match, number, query_terms, quoted, slug, trimmed
from ..sources.zones import word_positions, zone_code


def request_status(queries: DataFrame) -> DataFrame:
    """``status`` of each query: missing_id, missing_query, blank, or ok. A blank query is answered with an empty list,
    a missing one with an error. With a column ``route``, requests for an annotation list itself are not_implemented."""
    blank = trimmed(F.coalesce("q", F.lit("")))
    direct = F.coalesce(F.col("route") == "annotation-list", F.lit(False)) if "route" in queries.columns else F.lit(False)
    status = F.when(direct, "not_implemented").when(F.col("item_id").isNull(), "missing_id").when(F.length(F.coalesce("q", F.lit(""))) == 0, "missing_query").when(F.length(blank) == 0, "blank").otherwise("ok")
    return queries.withColumn("status", status)


def explode_terms(queries: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """(query_id, item_id, term_no, term), one row for each term, in order."""
    terms = queries.filter("item_id is not null").select("query_id", "item_id", F.posexplode(query_terms(trimmed(F.col("q")), cfg.shortest)).alias("term_no", "term"))
    return terms


#: Different terms up to which zones without any of them are left out before the join.
FEW = 32


def holding_any(zones: DataFrame, terms: DataFrame) -> DataFrame:
    """Zones that contain any of the terms of all queries, if these have few different ones; else all zones. No match is
    lost, and of many queries for the same words only the zones that hold one have to meet their item's queries."""
    different = [r.term for r in terms.select("term").distinct().limit(FEW + 1).collect()]
    if len(different) > FEW:
        return zones
    return zones.filter(reduce(Column.__or__, (contains(F.col("text"), F.lit(t)) for t in different), F.lit(False)))


def contains_join(zones: DataFrame, terms: DataFrame) -> DataFrame:
    """Zones whose text contains a term in any case, one row for each term: an equi join on the item, with the pattern
    as what is left of the condition. ``matched`` is the first stretch that matches."""
    zones = holding_any(zones, terms)
    t = terms.select("query_id", F.col("item_id").alias("t_item"), "term_no", "term")
    joined = zones.join(t, (F.col("item_id") == F.col("t_item")) & contains(F.col("text"), F.col("term"))).drop("t_item", "bucket")
    return joined.withColumn("matched", first_match(F.col("text"), F.col("term")))


def key_join(words: DataFrame, terms: DataFrame) -> DataFrame:
    """Words of an index that equal the slug of a term; a term given twice counts once."""
    keys = terms.select("query_id", F.col("item_id").alias("t_item"), slug("term").alias("t_key")).distinct()
    return words.join(keys, (F.col("item_id") == F.col("t_item")) & (F.col("word") == F.col("t_key"))).drop("t_item", "t_key", "bucket")


def index_zones(words: DataFrame) -> DataFrame:
    """Positions of index words as zones: numbers, and ``zone_code`` for those that are not complete."""
    z = word_positions(words)
    page = F.col("page").try_cast("int")
    code = zone_code(F.col("top"), F.col("left"), F.col("width"), F.col("height"))
    sizes = {c: number(F.col(c)) for c in ("left", "top", "width", "height")}
    keep = [c for c in words.columns if c != "positions"]
    return z.select(*keep, "position_no", page.alias("page_no"), sizes["left"].alias("hpos"), sizes["top"].alias("vpos"), sizes["width"].alias("width"), sizes["height"].alias("height"), F.when(page.isNull(), F.lit("zone_incomplete")).otherwise(code).alias("zone_code"))


def with_images(rows: DataFrame, images: DataFrame, required: bool) -> DataFrame:
    """Rows with the image of their page, the image_index below page_no.

    ``required`` keeps only rows whose image has a size, as for XML layouts; else the image may be missing.
    """
    i = images.select(F.col("item_id").alias("i_item"), (F.col("image_index") + 1).alias("i_page"), "media_id", F.col("width").alias("image_width"), F.col("height").alias("image_height"))
    if required:
        i = i.filter("image_width > 0 and image_height > 0")
    # Other names meanwhile: where a union has an empty side, Spark renames what it keeps now so, now so, and would take rows that
    # are the same for annotations and hits as different.
    names = {"query_id": "r_query", "item_id": "r_item", "page_no": "r_page"}
    met = rows.withColumnsRenamed(names).join(i, (F.col("r_item") == F.col("i_item")) & (F.col("r_page") == F.col("i_page")), "inner" if required else "left")
    return met.drop("i_item", "i_page").withColumnsRenamed({new: old for old, new in names.items()})


def number_hits(matches: DataFrame, *order: str | Column, within: list[Column] | None = None) -> DataFrame:
    """``hit``: 1, 2, 3 and so on within a query and item, in the given order.

    ``within`` cuts the order into runs that a task numbers at a time, such as pages: expressions that ascend with it
    and are not null. What is numbered per query and item are then only the runs, by their counts, and each hit adds its place in its run,
    so that the matches of one item are dealt to many tasks.
    """
    by = ["query_id", "item_id"]
    if not within:
        return matches.withColumn("hit", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    runs = [f"run_{k}" for k in range(len(within))]
    run = Window.partitionBy(*by, *runs)
    rows = matches.withColumns(dict(zip(runs, within))).withColumn("in_run", F.row_number().over(run.orderBy(*order)))
    counts = rows.groupBy(*by, *runs).agg(F.max("in_run").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy(*runs)) - F.col("n")
    counts = counts.select(*(F.col(c).alias(f"of_{c}") for c in [*by, *runs]), before.alias("before"))
    same = [F.col(c) == F.col(f"of_{c}") for c in [*by, *runs]]
    joined = rows.join(counts, same)
    return joined.withColumn("hit", (F.col("before") + F.col("in_run")).cast("int")).drop("in_run", "before", *runs, *(f"of_{c}" for c in [*by, *runs]))


def xml_matches(zones: DataFrame, terms: DataFrame, images: DataFrame, cfg: SearchConfig = SearchConfig(), found: DataFrame | None = None) -> DataFrame:
    """All matches in zones of XML layouts, complete or not: pages need an image with a size. Images meet the few zones
    that match, not all zones. ``found`` are the rows of contains_join(), if they are known. Unless ``chars`` are quoted,
    the matched text is left to boxed(): then annotations and hits need the same columns up to their numbers, and Spark
    matches, joins and deals them once for both."""
    found = with_images(contains_join(zones, terms) if found is None else found, images, True)
    return found.withColumn("chars", quoted(F.col("term"))) if cfg.compat else found.withColumnRenamed("term", "chars").drop("matched")


def index_matches(words: DataFrame, terms: DataFrame, images: DataFrame) -> DataFrame:
    """All matches in word indexes, complete or not. The page is taken to be as large as its image."""
    found = with_images(index_zones(key_join(words, terms)), images, False)
    return found.withColumns({"text": F.col("word"), "chars": F.col("word"), "matched": F.col("word"), "page_width": F.col("image_width"), "page_height": F.col("image_height")})


def split_valid(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches with a complete box, and a diagnostic (query_id, item_id, page_no, code) for each of the others."""
    return matches.filter("zone_code is null").drop("zone_code"), matches.filter("zone_code is not null").select("query_id", "item_id", "page_no", F.col("zone_code").alias("code"))
