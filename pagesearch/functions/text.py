"""Text expressions: queries, terms, slugs, names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that trimming takes off both ends: space, tab, line feed, carriage return, NUL, vertical tab.
_EDGE = r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$"


def trimmed(q: Column) -> Column:
    return F.regexp_replace(q, _EDGE, "")


#: Fixed value: what a query keeps are letters, numbers and symbols.
_DROPPED = r"[^\p{L}\p{N}\p{S}]"


def clean_query(q: Column) -> Column:
    """Letters, numbers and symbols; everything else is a space, and spaces are single."""
    return F.trim(F.regexp_replace(F.regexp_replace(q, _DROPPED, " "), r"\s+", " "))


def query_terms(q: Column, shortest: int = 3) -> Column:
    """The terms that a query looks for: its word, or its words that are long enough and, when there are several of
    those, the whole phrase too. A query shorter than ``shortest`` has none; repeated words stay repeated."""
    clean = clean_query(q)
    words = F.split(clean, " ")
    kept = F.filter(words, lambda w: F.char_length(w) >= shortest)
    several = F.when(F.size(kept) > 1, F.concat(kept, F.array(clean))).otherwise(kept)
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(F.char_length(clean), F.lit(0)) < shortest, none).when(F.size(words) == 1, F.array(clean)).otherwise(several)


def quoted(term: Column) -> Column:
    """A term with the symbols that have a meaning in patterns escaped; only these survive clean_query()."""
    return F.regexp_replace(term, r"([+^$=<>|])", r"\\$1")


def pattern(term: Column) -> Column:
    """The pattern of a term, matched as it stands in any case."""
    return F.concat(F.lit(r"(?iu)(\Q"), term, F.lit(r"\E)"))


def _ascii(text: Column, term: Column) -> Column:
    return (F.octet_length(text) == F.char_length(text)) & (F.octet_length(term) == F.char_length(term))


def contains(text: Column, term: Column) -> Column:
    """Whether the text holds the term in any case. Among ASCII strings that is a search in lower case, which needs no
    pattern; the others are matched by pattern, as letters may have more than two cases."""
    return F.when(_ascii(text, term), F.contains(F.lower(text), F.lower(term))).otherwise(F.call_function("rlike", text, pattern(term)))


def first_match(text: Column, term: Column) -> Column:
    """The first stretch of the text that matches, in its own case; empty without one."""
    at = F.call_function("locate", F.lower(term), F.lower(text))
    found = F.when(at > 0, F.call_function("substring", text, at, F.char_length(term))).otherwise(F.lit(""))
    return F.when(_ascii(text, term), found).otherwise(F.call_function("regexp_extract", text, pattern(term), F.lit(1)))


def slug_of(word: str | None) -> str | None:
    """Lower case without combining marks."""
    if word is None:
        return None
    bare = "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")
    return unicodedata.normalize("NFC", bare).lower()


@F.pandas_udf(T.StringType())
def slug(words: pd.Series) -> pd.Series:
    return words.map(slug_of, na_action="ignore")


def strip_tags(markup: Column) -> Column:
    return F.regexp_replace(markup, "<[^>]*>", "")


def file_stem(path: Column) -> Column:
    """The last part of a path without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), r"\.[^.]*$", "")


def main_type(media_type: Column) -> Column:
    return F.split_part(media_type, F.lit("/"), F.lit(1))


def truthy(raw: Column) -> Column:
    """A size given as text counts unless missing, empty or "0"."""
    return F.coalesce(raw, F.lit("")).isin("", "0") == F.lit(False)


def given(raw: Column) -> Column:
    """A position given as text counts unless missing or empty; "0" is a position."""
    return F.length(F.coalesce(raw, F.lit(""))) > 0


def number(raw: Column) -> Column:
    return raw.try_cast("double")


#: Repairs of the page layout, pattern and replacement, in this order.
PDF2XML_REPAIRS = ((r"\s{2,}", " "), ("</?[bi]>", ""), ('<fontspec id=".*\n', ""), (r'<!doctype pdf2xml system "pdf2xml\.dtd">', '<!DOCTYPE pdf2xml SYSTEM "pdf2xml.dtd">'))


def fix_pdf2xml(xml: Column) -> Column:
    """Single spaces, no bold or italic tags, no font lines, upper-case doctype; in this order."""
    for pattern, new in PDF2XML_REPAIRS:
        xml = F.regexp_replace(xml, pattern, new)
    return xml
