"""Which items can be searched, and the service descriptions that say so."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..config import SearchConfig


def searchable_items(items: DataFrame, media: DataFrame, files: DataFrame) -> DataFrame:
    """Items of type "item" (or without a type) that have a file of their own or a medium of a searchable type."""
    wanted = items.filter(F.coalesce("type", F.lit("item")) == "item") if "type" in items.columns else items
    able = files.select("item_id").union(media.filter(F.col("media_type").isin(*schemas.SEARCHABLE)).select("item_id")).distinct()
    return wanted.join(able, "item_id", "left_semi")


def service_descriptions(items: DataFrame, cfg: SearchConfig = SearchConfig(), versions: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(item_id, services): JSON of the services to add to an item's manifest. ``versions`` of (0,) is for manifests of
    the older presentation format, whose service has no type."""
    at = F.concat(F.lit(f"{cfg.search_url}/"), F.col("item_id").cast("string"))
    label = F.lit("Search within this manifest").alias("label")
    typed = [F.lit("SearchService0").alias("@type")] if 1 in versions else []
    first = F.struct(F.lit(schemas.CONTEXT).alias("@context"), at.alias("@id"), *typed, F.lit(schemas.PROFILE).alias("profile"), label)
    second = F.struct(F.lit(schemas.CONTEXT_1).alias("@context"), F.concat(at, F.lit("/search")).alias("id"), F.lit("SearchService1").alias("type"), F.lit(schemas.PROFILE_1).alias("profile"), label)
    parts = [F.to_json(s) for v, s in ((0, first), (1, second)) if v in versions]
    return items.select("item_id", F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")).alias("services"))
