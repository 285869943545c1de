"""From numbered matches to annotations, hits, totals and the response."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..config import SearchConfig
from ..functions.geometry import annotation_id, box, canvas_target
from ..functions.text import clean_query, first_match, trimmed

MATCH_COLUMNS = ["query_id", "item_id", "hit", "page_no", "media_id", "chars", "matched", "x", "y", "w", "h", "id", "target", "source_rank"]


def boxed(numbered: DataFrame, cfg: SearchConfig = SearchConfig(), source_rank: int = 0) -> DataFrame:
    """Numbered matches with box, annotation id and canvas target; ``matched``, if they lack it, is where the text has chars."""
    c = F.col
    numbered = numbered if "matched" in numbered.columns else numbered.withColumn("matched", first_match(c("text"), c("chars")))
    rows = numbered.withColumn("box", box(c("text"), c("chars"), c("hpos"), c("vpos"), c("width"), c("height"), (c("page_width"), c("page_height")), (c("image_width"), c("image_height"))))
    base = F.concat(F.lit(f"{cfg.base_url}/"), c("item_id").cast("string"))
    rows = rows.withColumns({"id": annotation_id(F.concat(base, F.lit("/annotation/search-result/")), c("page_no"), c("hit"), c("box")), "target": canvas_target(F.concat(base, F.lit("/canvas/p")), c("page_no"), c("box")), "source_rank": F.lit(source_rank)})
    return rows.select("query_id", "item_id", "hit", "page_no", "media_id", "chars", "matched", "box.x", "box.y", "box.w", "box.h", "id", "target", "source_rank")


def hits_per_page(annotations: DataFrame, cumulative: bool = False) -> DataFrame:
    """(query_id, item_id, page_no, annotations, match): ids of a page in order, and its different matched texts.

    ``cumulative`` shows the matched texts of all pages up to the page, as word indexes once did.
    """
    by = ["query_id", "item_id", "page_no"]
    pages = annotations.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("hit", "id", "matched"))).alias("all"))
    texts = F.array_distinct(F.transform("all", lambda x: x["matched"]))
    if cumulative:
        pages, texts = pages.join(texts_so_far(annotations), by), F.col("seen")
    return pages.select(*by, F.transform("all", lambda x: x["id"]).alias("annotations"), F.array_join(texts, " ").alias("match"))


def texts_so_far(annotations: DataFrame) -> DataFrame:
    """(query_id, item_id, page_no, seen): the different matched texts of an item's pages up to each page, in the order of
    their first hits.

    Each text counts once, on its first page; a page then adds its new texts to those of the pages before. What a task
    holds are the different texts of one query and item, not its hits.
    """
    first = annotations.groupBy("query_id", "item_id", "matched").agg(F.min(F.struct("page_no", "hit")).alias("first"))
    new = first.filter("matched is not null").groupBy("query_id", "item_id", F.col("first.page_no").alias("page_no")).agg(F.array_sort(F.collect_list(F.struct("first.hit", "matched"))).alias("new"))
    pages = annotations.select("query_id", "item_id", "page_no").distinct().join(new, ["query_id", "item_id", "page_no"], "left")
    upto = Window.partitionBy("query_id", "item_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    return pages.select("query_id", "item_id", "page_no", F.flatten(F.collect_list(F.transform("new", lambda x: x["matched"])).over(upto)).alias("seen"))


def metadata_postings(values: DataFrame) -> DataFrame:
    """(item_id, word, media_id, position, text, copies): the different words of each metadata text, cleaned and in lower
    case; rows that repeat are one with their number. It depends on no query, so it can be made once and stored."""
    texts = values.groupBy("item_id", "media_id", "position", "text").agg(F.count("*").alias("copies"))
    words = F.array_distinct(F.split(clean_query(F.lower(F.coalesce("text", F.lit("")))), " "))
    return texts.select("item_id", F.explode(words).alias("word"), "media_id", "position", "text", "copies").filter("word <> ''")


def metadata_matches(queries: DataFrame, values: DataFrame | None = None, postings: DataFrame | None = None) -> DataFrame:
    """Media whose metadata text holds every word of the query, in any case, as (query_id, item_id, media_id,
    position). The words are those of the cleaned query.

    A division of relations: words of queries meet the postings of their item in an equi join, and a text matches where
    as many of the query's words met it as the query has. Texts are split once, however many queries there are.
    """
    postings = metadata_postings(values) if postings is None else postings
    words = F.array_distinct(F.split(clean_query(F.lower(trimmed(F.col("q")))), " "))
    q = queries.filter("item_id is not null").select("query_id", F.col("item_id").alias("q_item"), words.alias("words")).filter("words[0] <> ''")
    asked = q.select("query_id", "q_item", F.size("words").alias("needs"), F.explode("words").alias("q_word"))
    met = postings.join(asked, (F.col("item_id") == F.col("q_item")) & (F.col("word") == F.col("q_word")))
    whole = met.groupBy("query_id", "item_id", "media_id", "position", "text", "needs").agg(F.count("*").alias("has"), F.first("copies").alias("copies")).filter("has = needs")
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("query_id", "item_id", "media_id", "position")


def metadata_annotations(found: DataFrame, fulltext: DataFrame, images: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """Whole-page annotations of metadata matches: not of media that full text found, only of images, numbered on from
    the full-text total in order of position."""
    seen = fulltext.select("query_id", "item_id", "media_id").distinct()
    new = found.join(seen, ["query_id", "item_id", "media_id"], "left_anti")
    i = images.select(F.col("item_id").alias("i_item"), F.col("media_id").alias("i_media"), (F.col("image_index") + 1).alias("page_no"), F.col("width").alias("image_width"), F.col("height").alias("image_height"))
    rows = new.join(i, (F.col("item_id") == F.col("i_item")) & (F.col("media_id") == F.col("i_media"))).drop("i_item", "i_media")
    totals = fulltext.groupBy("query_id", "item_id").agg(F.count("*").alias("total"))
    rows = rows.join(totals, ["query_id", "item_id"], "left")
    order = Window.partitionBy("query_id", "item_id").orderBy("position", "media_id")
    rows = rows.withColumn("hit", (F.coalesce("total", F.lit(0)) + F.row_number().over(order)).cast("int"))
    size = {"hpos": F.lit(0.0), "vpos": F.lit(0.0), "width": F.col("image_width"), "height": F.col("image_height"), "page_width": F.col("image_width"), "page_height": F.col("image_height"), "text": F.lit(""), "chars": F.lit(""), "matched": F.lit(None).cast("string")}
    return boxed(rows.withColumns(size), cfg, 1)


def totals(annotations: DataFrame) -> DataFrame:
    """(query_id, item_id, total)."""
    return annotations.groupBy("query_id", "item_id").agg(F.count("*").alias("total"))


def annotation_struct() -> Column:
    """An annotation as the response has it, keys in order."""
    body = F.struct(F.lit(schemas.BODY_TYPE).alias("@type"), F.col("chars").alias("chars"))
    return F.struct(F.lit(schemas.CONTEXT).alias("@context"), F.col("id").alias("@id"), F.lit(schemas.ANNOTATION_TYPE).alias("@type"), F.lit(schemas.MOTIVATION).alias("motivation"), body.alias("resource"), F.col("target").alias("on"))


def hit_struct() -> Column:
    return F.struct(F.lit(schemas.HIT_TYPE).alias("@type"), F.col("annotations"), F.col("match"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))


def invalid(value: Column, keys: dict[str, str]) -> Column:
    """What is wrong with an object of the response, or null: the required keys that it lacks."""
    missing = missing_keys(value, keys)
    message = F.concat(F.lit('Missing required keys for object type "'), F.coalesce(value["@type"], F.lit("")), F.lit('": "'), F.array_join(missing, '", "'), F.lit('".'))
    return F.when(reduce(Column.__or__, (value[k].isNull() for k, need in keys.items() if need == "required")), message)


def missing_keys(value: Column, keys: dict[str, str]) -> Column:
    """Names of the required keys of a struct that are null."""
    return F.array_compact(F.array(*(F.when(value[k].isNull(), F.lit(k)) for k, need in keys.items() if need == "required")))


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Null and missing columns filled from ``defaults``."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def _list_head(cfg: SearchConfig) -> list[Column]:
    """What an annotation list begins with, before its resources and hits; of rows with q, item_id and total."""
    uri = F.concat(F.lit(f"{cfg.search_url}/"), F.col("item_id").cast("string"), F.lit("?q="), F.url_encode(F.coalesce("q", F.lit(""))))
    within = F.struct(F.lit(schemas.LAYER_TYPE).alias("@type"), F.col("total"))
    return [F.lit(schemas.CONTEXT).alias("@context"), uri.alias("@id"), F.lit(schemas.LIST_TYPE).alias("@type"), within.alias("within"), F.lit(0).alias("startIndex")]


def _outcome(wrong: Column) -> tuple[Column, Column, Column]:
    """(whether a list is the answer, its code, its message) of rows with a status and what is wrong with their list."""
    asked = F.col("status").isin("ok", "blank")
    ok = asked & wrong.isNull()
    message = (
        F.when(asked, wrong)
        .when(F.col("status") == "missing_query", F.lit("Missing or empty query."))
        .when(F.col("status") == "unsupported", F.concat(F.lit("Search is not supported for resource #"), F.col("item_id").cast("string"), F.lit(" (missing XML and/or image files).")))
        .when(F.col("status").isin("missing_id", "not_found"), F.lit("Not found."))
        .when(F.col("status") == "not_implemented", F.lit("Direct request to annotation-list is not implemented."))
    )
    code = F.when(ok, 200).when(asked, 500).when(F.col("status") == "not_implemented", 501).when(F.col("status").isin("missing_id", "not_found"), 404).otherwise(400)
    return ok, code, message


def _error(message: Column) -> Column:
    return F.to_json(F.struct(F.lit("error").alias("status"), message.alias("message")))


def responses(queries: DataFrame, annotations: DataFrame, hits: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """(query_id, item_id, status, http_status, message, total, body): one row for each query of ``queries``, which has
    ``status``; the body is the JSON of the annotation list, or of the error. Objects are checked before they are
    written: a response with one that lacks a required key is the error 500 and says which."""
    by = ["query_id", "item_id"]
    resources = annotations.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("source_rank", "hit", annotation_struct().alias("a")))), lambda x: x["a"]).alias("resources"), F.count("*").alias("total"), F.min(invalid(annotation_struct(), schemas.ANNOTATION_KEYS)).alias("wrong_annotation"))
    pages = hits.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", hit_struct().alias("h")))), lambda x: x["h"]).alias("hits"), F.min(invalid(hit_struct(), schemas.HIT_KEYS)).alias("wrong_hit"))
    rows = queries.join(resources, by, "left").join(pages, by, "left").withColumn("total", F.coalesce("total", F.lit(0)))
    none = lambda c, like: F.coalesce(c, F.array().cast(like))
    resources_type, hits_type = resources.schema["resources"].dataType, pages.schema["hits"].dataType
    listed = F.struct(*_list_head(cfg), none(F.col("resources"), resources_type).alias("resources"), none(F.col("hits"), hits_type).alias("hits"))
    wrong = F.coalesce("wrong_annotation", "wrong_hit", invalid(listed, schemas.LIST_KEYS))
    ok, code, message = _outcome(wrong)
    return rows.select(*by, "status", code.alias("http_status"), message.alias("message"), "total", F.when(ok, F.to_json(listed)).otherwise(_error(message)).alias("body"))


def response_parts(queries: DataFrame, annotations: DataFrame, hits: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """The bodies of responses() in parts: (query_id, item_id, http_status, section, rank, number, part), to be put
    together in the order of section, rank and number. An annotation or a hit is a part, so no body has to be one row.

    A request's parts lie together and in order once, and what they need of each other (how many there are, what is wrong
    with one, which come first) is read over them; annotations and hits are each made once."""
    by, order = ["query_id", "item_id"], ["section", "rank", "number"]
    row = lambda df, section, rank, number, text, wrong, *more: df.select(*by, section.alias("section"), rank.alias("rank"), number.alias("number"), text.alias("text"), wrong.alias("wrong"), *more)
    zero, none = F.lit(0), F.lit(None).cast("string")
    no_query = (none.alias("q"), none.alias("status"))
    frames = row(queries.withColumn("s", F.explode(F.array(*map(F.lit, (0, 2, 4))))), F.col("s"), zero, zero, none, none, "q", "status")
    a = row(annotations, F.lit(1), F.col("source_rank"), F.col("hit"), F.to_json(annotation_struct()), invalid(annotation_struct(), schemas.ANNOTATION_KEYS), *no_query)
    h = row(hits, F.lit(3), zero, F.col("page_no"), F.to_json(hit_struct()), invalid(hit_struct(), schemas.HIT_KEYS), *no_query)
    in_order = Window.partitionBy(*by).orderBy(*order)
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of = lambda section, value: F.when(F.col("section") == section, value)
    rows = reduce(DataFrame.unionByName, (a, h), frames).withColumns({
        "status": F.max("status").over(whole), "total": F.count(of(1, zero)).over(whole), "wrong_annotation": F.min(of(1, F.col("wrong"))).over(whole),
        "wrong_hit": F.min(of(3, F.col("wrong"))).over(whole), "before": F.lag("section").over(in_order),
    })
    head = F.struct(*_list_head(cfg))
    lacks = {k: v for k, v in schemas.LIST_KEYS.items() if k not in ("within", "resources", "hits")}
    ok, code, message = _outcome(F.coalesce("wrong_annotation", "wrong_hit", invalid(head, lacks)))
    rows = rows.filter("status is not null").withColumns({"ok": ok, "http_status": code}).filter("ok or section = 0")
    open_ = F.concat(F.expr("substring(head, 1, char_length(head) - 1)"), F.lit(',"resources":['))
    comma = F.when(F.col("before") == F.col("section"), F.lit(",")).otherwise(F.lit(""))
    part = F.when(F.col("section") == 0, F.when(F.col("ok"), open_).otherwise(_error(message))).when(F.col("section") == 2, F.lit('],"hits":[')).when(F.col("section") == 4, F.lit("]}")).otherwise(F.concat(comma, "text"))
    return rows.withColumn("head", of(0, F.to_json(head))).select(*by, "http_status", *order, part.alias("part"))


#: Stands before each response of a file of many. JSON escapes it, so that no body holds it.
RECORD = "\x1e"


def write_responses(parts: DataFrame, folder: str, compression: str = "none", together: bool = False) -> None:
    """A file of JSON for each request, ``http_status=.../query_id=.../item_id=.../part-...``, a part of it a line; line feeds
    mean nothing there. A file is written from rows that come sorted, so its size is bounded by no memory; those of a
    request are one task's. ``compression`` names a codec of text files, such as gzip: annotations repeat most of their
    keys and ids, so that bodies take a fraction of the disk, and read_responses() reads them alike.

    A folder and a file for each request are slow to make and to list where requests are many. ``together`` writes a file
    for each task instead: of each request a RECORD and a line of its ids and status, then its parts as above."""
    by = ["query_id", "item_id"]
    order = [*by, "section", "rank", "number"]
    if together:
        rows = parts.repartition(*by).sortWithinPartitions(*order)
        ids = F.concat(F.lit(RECORD), *(F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(end)) for c, end in ((by[0], "\t"), (by[1], "\t"), ("http_status", "\n"))))
        rows.select(F.concat(F.when(F.col("section") == 0, ids).otherwise(F.lit("")), "part")).write.text(folder, compression=compression)
        return
    by = ["http_status", *by]
    rows = parts.repartition(*by).sortWithinPartitions("http_status", *order)
    rows.select(*by, "part").write.partitionBy(*by).text(folder, compression=compression)


def read_responses(spark: SparkSession, folder: str, together: bool = False) -> DataFrame:
    """(query_id, item_id, http_status, body) of what write_responses() wrote, with the same ``together``."""
    if together:
        record = F.split("value", "\n", 2)
        ids = F.split(record[0], "\t")
        files = spark.read.text(folder, lineSep=RECORD).filter("value <> ''")
        files = files.select(record[1].alias("value"), *(ids[k].try_cast(kind).alias(c) for k, (c, kind) in enumerate((("query_id", "bigint"), ("item_id", "bigint"), ("http_status", "int")))))
    else:
        files = spark.read.schema("value string, http_status int, query_id bigint, item_id bigint").text(folder, wholetext=True)
    return files.select("query_id", "item_id", "http_status", F.replace("value", F.lit("\n"), F.lit("")).alias("body"))
