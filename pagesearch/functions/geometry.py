"""Boxes of matches on page images, and what is written of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _or(a: Column, b: Column) -> Column:
    """The first that is neither null nor 0, else the second."""
    return F.when(F.coalesce(a, F.lit(0.0)) != 0, a).otherwise(b)


def scale(image: Column, page: Column) -> Column:
    """Image units for each page unit; 1 when either size is unknown."""
    i, p = _or(image, page), _or(page, image)
    return F.when((F.coalesce(i, F.lit(0.0)) != 0) & (F.coalesce(p, F.lit(0.0)) != 0), i / p).otherwise(F.lit(1.0))


def place(text: Column, chars: Column) -> Column:
    """Where the characters start in the text, in any case, from 0; 0 if they don't occur."""
    return F.greatest(F.call_function("locate", F.lower(chars), F.lower(text)) - 1, F.lit(0))


def box(text: Column, chars: Column, left: Column, top: Column, width: Column, height: Column, page_size: tuple[Column, Column], image_size: tuple[Column, Column]) -> Column:
    """Struct x, y, w, h on the image, of the characters within a zone, or of the whole zone when they are empty.

    Characters are taken as equally wide; the width has room for one more and is rounded before and after scaling.
    """
    sx, sy = scale(image_size[0], page_size[0]), scale(image_size[1], page_size[1])
    n = F.nullif(F.char_length(text), F.lit(0)).cast("double")
    part = F.char_length(F.coalesce(chars, F.lit(""))) > 0
    x = F.when(part, left + F.coalesce(place(text, chars) / n, F.lit(0.0)) * width).otherwise(left)
    w = F.when(part, F.round(width * ((F.char_length(chars) + 1) / n))).otherwise(width)
    whole = lambda v: F.round(v).cast("bigint")
    return F.struct(whole(x * sx).alias("x"), whole(top * sy).alias("y"), whole(w * sx).alias("w"), whole(height * sy).alias("h"))


def xywh(b: Column) -> Column:
    return F.concat_ws(",", b["x"].cast("string"), b["y"].cast("string"), b["w"].cast("string"), b["h"].cast("string"))


def annotation_id(base: Column, page_no: Column, hit: Column, b: Column) -> Column:
    return F.concat(base, F.lit("a"), page_no.cast("string"), F.lit("h"), hit.cast("string"), F.lit("r"), xywh(b))


def canvas_target(base: Column, page_no: Column, b: Column) -> Column:
    return F.concat(base, page_no.cast("string"), F.lit("#xywh="), xywh(b))
