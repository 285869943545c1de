"""Contains-joins through a table of trigrams: zones that lack a term's rarest three letters never meet the pattern."""

from __future__ import annotations

import sys
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains, first_match
from .match import contains_join, holding_any

SIZE = 3
#: What stands for every character whose case has no counterpart that is surely one other character.
OTHER = "¿"
#: Ranges with case beyond ASCII: Latin, Greek, Cyrillic.
RANGES = ((0x80, 0x250), (0x370, 0x530))


@cache
def folds() -> tuple[str, str]:
    """Characters and what each folds to, so that any two characters that a pattern takes as one in any case fold alike.

    A pattern compares characters by their simple upper case, then by the lower case of that. A class of such characters
    that has members in ASCII or in the ranges folds to the first of these; characters of no such class fold to OTHER.
    """

    def simple(c: str, other: str) -> str:
        return other if len(other) == 1 else c

    classes: dict[str, list[str]] = {}
    for c in map(chr, range(sys.maxunicode + 1)):
        upper = simple(c, c.upper())
        lower = upper.lower()[:1] if upper == "\u0130" else simple(upper, upper.lower())
        classes.setdefault(lower, []).append(c)
    to = {}
    for members in classes.values():
        near = [c for c in members if ord(c) < 128 or any(a <= ord(c) < b for a, b in RANGES)]
        if len(members) > 1 and near:
            first = min(near).lower() if ord(min(near)) < 128 else min(near)
            to |= {c: first for c in members if c != first}
    return "".join(to), "".join(to.values())


def folded(text: Column) -> Column:
    """Text with one character for each of its characters, the same for all that a pattern takes as one."""
    outside = "[^\\x00-\\x7f" + "".join(f"\\x{{{a:x}}}-\\x{{{b - 1:x}}}" for a, b in RANGES) + "]"
    return F.regexp_replace(F.translate(text, *folds()), outside, OTHER)


def grams(text: Column) -> Column:
    """The different trigrams of a text; none below three characters. One pass gives those of all places, so that the work
    grows with the text, not with its square."""
    return F.array_distinct(F.regexp_extract_all(folded(text), F.lit(f"(?s)(?=(.{{{SIZE}}}))"), F.lit(1)))


def gram_table(zones: DataFrame) -> DataFrame:
    """(item_id, gram, page_no, zone_no): a row for each different trigram of a zone's text."""
    return zones.select("item_id", F.explode(grams(F.col("text"))).alias("gram"), "page_no", "zone_no")


def gram_counts(table: DataFrame) -> DataFrame:
    """(item_id, gram, n): how many zones of the item have the trigram."""
    return table.groupBy("item_id", "gram").agg(F.count("*").alias("n"))


def rarest_grams(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """Terms with the trigram of theirs that the fewest zones of their item have; terms with a trigram that no zone has
    are left out, as no zone can hold them. Counts of texts say the same of the different terms of a bucket, or of all."""
    within = [c for c in counts.columns if c not in ("gram", "n")]
    by = ["query_id", "item_id", "term_no", "term"] if "item_id" in within else [*within, "term"]
    terms = terms if "item_id" in within else terms.select(*by).distinct()
    each = terms.select(*by, F.explode(grams(F.col("term"))).alias("gram"), F.size(grams(F.col("term"))).alias("needs"))
    met = each.join(counts, [*within, "gram"])
    best = met.groupBy(*by).agg(F.min(F.struct("n", "gram")).alias("best"), F.count("*").alias("has"), F.first("needs").alias("needs"))
    return best.filter("has = needs").select(*by, F.col("best.gram").alias("gram"))


def candidates(zones: DataFrame, terms: DataFrame, table: DataFrame, counts: DataFrame) -> DataFrame:
    """Zones with each term whose rarest trigram they have: all that the pattern has to look at for terms of three
    characters and more. Every step is an equi join; the trigrams of other items and the rest of the table are not met."""
    places = table.join(rarest_grams(terms, counts), ["item_id", "gram"]).select(F.col("item_id").alias("t_item"), F.col("page_no").alias("t_page"), F.col("zone_no").alias("t_zone"), "query_id", "term_no", "term")
    return zones.join(places, (F.col("item_id") == F.col("t_item")) & (F.col("page_no") == F.col("t_page")) & (F.col("zone_no") == F.col("t_zone"))).drop("t_item", "t_page", "t_zone")


def contains_join_by_grams(zones: DataFrame, terms: DataFrame, table: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of contains_join(), with the pattern only on candidates; terms below three characters meet all zones of
    their item. A zone is told by its item, page and number."""
    long = F.char_length("term") >= SIZE
    few = candidates(zones, terms.filter(long), table.drop("bucket"), counts.drop("bucket")).filter(contains(F.col("text"), F.col("term")))
    found = few.drop("bucket").withColumn("matched", first_match(F.col("text"), F.col("term")))
    return found.unionByName(contains_join(zones, terms.filter(~long)))


def different_texts(zones: DataFrame) -> DataFrame:
    """(text), by bucket if zones have one: the different texts. Zones repeat theirs, words above all, so that trigrams of
    these are few beside those of all zones."""
    return zones.select(*(["bucket"] if "bucket" in zones.columns else []), "text").distinct()


def text_grams(texts: DataFrame) -> DataFrame:
    """(gram, text), by bucket if texts have one: a row for each different trigram of each text."""
    return texts.select(*(c for c in texts.columns if c != "text"), F.explode(grams(F.col("text"))).alias("gram"), "text")


def text_gram_counts(table: DataFrame) -> DataFrame:
    """(gram, n), by bucket if the table has one: how many texts have the trigram."""
    return table.groupBy(*(c for c in table.columns if c != "text")).agg(F.count("*").alias("n"))


def texts_with_terms(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """(text, term, matched), by bucket if texts have one: the texts that hold a term of three characters and more. The
    pattern looks only at texts with the term's rarest trigram, once however many zones have the text."""
    by, table = [c for c in texts.columns if c != "text"], text_grams(texts)
    few = table.join(rarest_grams(terms, text_gram_counts(table)), [*by, "gram"]).filter(contains(F.col("text"), F.col("term")))
    return few.select(*by, "text", "term", first_match(F.col("text"), F.col("term")).alias("matched"))


def contains_join_by_texts(zones: DataFrame, terms: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of contains_join(), with the pattern only on different texts that have a term's rarest trigram: zones meet
    these by their text, then the terms of their item. ``texts`` has at least the texts of the zones, each once; terms have
    a bucket if it has one. Terms below three characters meet all zones of their item."""
    long = F.char_length("term") >= SIZE
    by = [c for c in texts.columns if c != "text"]
    asked = terms.filter(long)
    found = texts_with_terms(asked, texts).select(*(F.col(c).alias(f"f_{c}") for c in [*by, "text"]), F.col("term").alias("f_term"), "matched")
    same = reduce(Column.__and__, (F.col(c) == F.col(f"f_{c}") for c in [*by, "text"]))
    held = holding_any(zones, asked).join(found, same)
    t = asked.select("query_id", F.col("item_id").alias("t_item"), "term_no", "term")
    rows = held.join(t, (F.col("item_id") == F.col("t_item")) & (F.col("f_term") == F.col("term")))
    rows = rows.drop("t_item", "f_term", "bucket", *(f"f_{c}" for c in [*by, "text"]))
    return rows.unionByName(contains_join(zones, terms.filter(~long)))
