"""What an item offers for search: its files, media and images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import file_stem, main_type
from .heads import image_header_size, image_size  # noqa: F401

#: File kinds by falling priority. A "legacy" file is XML whose layout is sniffed first.
FILE_PRIORITY = {schemas.TSV: 0, schemas.PDF2XML: 1, schemas.ALTO: 2, "legacy": 3}


def list_files(spark, base: str, index_dir: str = "index", pdf_dir: str = "pdf2xml", alto_dir: str = "alto") -> DataFrame:
    """(item_id, kind, priority, path, content) of files named by item below ``base``: {index}/{id}.tsv, {pdf2xml}/{id}.xml,
    {alto}/{id}.alto.xml and {index}/{id}.xml. Folders that are missing count as empty."""
    places = ((f"{index_dir}/*.tsv", schemas.TSV, r"/([0-9]+)\.tsv$"), (f"{pdf_dir}/*.xml", schemas.PDF2XML, r"/([0-9]+)\.xml$"), (f"{alto_dir}/*.alto.xml", schemas.ALTO, r"/([0-9]+)\.alto\.xml$"), (f"{index_dir}/*.xml", "legacy", r"/([0-9]+)\.xml$"))
    found = []
    hadoop = spark._jvm.org.apache.hadoop.fs
    for glob, kind, name in places:
        path = hadoop.Path(f"{base}/{glob}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path):
            continue
        files = spark.read.format("binaryFile").load(f"{base}/{glob}")
        found.append(files.select(F.regexp_extract("path", name, 1).try_cast("bigint").alias("item_id"), F.lit(kind).alias("kind"), F.lit(FILE_PRIORITY[kind]).alias("priority"), "path", "content").filter("item_id is not null"))
    if not found:
        return spark.createDataFrame([], "item_id bigint, kind string, priority int, path string, content binary")
    return reduce(DataFrame.unionByName, found)


def resolve_files(files: DataFrame) -> DataFrame:
    """The file of highest priority of each item, the first by path of equals.

    Files are compared by their paths alone. Contents are read once, and only those of items with several files meet the
    list of the files that lose.
    """
    place = F.struct("priority", "path")
    best = files.groupBy("item_id").agg(F.min(place).alias("best"), F.count("*").alias("n")).filter("n > 1").select("item_id", "best")
    lost = files.select("item_id", "priority", "path").join(best, "item_id").filter(place != F.col("best")).select(F.col("path").alias("lost"))
    return files.join(lost, F.col("path") == F.col("lost"), "left_anti").select("item_id", "kind", "content")


def resolve_sources(files: DataFrame, media: DataFrame, images: DataFrame, contents: DataFrame, how: str = "order") -> DataFrame:
    """Files (item_id, kind, file_no, content) that each item is searched by: its own file if it has one, else its media."""
    own = resolve_files(files)
    rest = media.join(own.select("item_id"), "item_id", "left_anti")
    of_media = media_files(rest, images, contents, how).select("item_id", "kind", "file_no", "content")
    return own.select("item_id", "kind", F.lit(0).alias("file_no"), "content").unionByName(of_media)


def classify_media(media: DataFrame) -> DataFrame:
    """``role`` of each medium: tsv, xml, generic_xml, or other."""
    t = F.col("media_type")
    role = F.when(t == schemas.TSV, "tsv").when(t.isin(schemas.ALTO, schemas.PDF2XML), "xml").when(t.isin(*schemas.GENERIC_XML), "generic_xml").otherwise("other")
    return media.withColumn("role", role)


def image_sizes(media: DataFrame, probed: DataFrame | None = None) -> DataFrame:
    """Images of each item, numbered from 0 by position.

    Sizes come from the medium's data, directly or under dimensions.original; the width decides which. Else an image
    medium takes the size that a probe of its file gave (media_id, width, height), 0 by 0 when that failed. Media with
    neither are no images and take no number.
    """
    json = lambda path: F.get_json_object("data", path)
    direct, nested = json("$.width"), json("$.dimensions.original.width")
    rows = classify_media(media).filter("role = 'other'")
    if probed is None:
        rows = rows.withColumns({"probed_width": F.lit(0.0), "probed_height": F.lit(0.0)})
    else:
        sizes = probed.select(F.col("media_id").alias("m"), F.col("width").alias("probed_width"), F.col("height").alias("probed_height"))
        rows = rows.join(sizes, F.col("media_id") == F.col("m"), "left").drop("m")
    pick = lambda a, b, c: F.when(direct.isNotNull(), a.try_cast("double")).when(nested.isNotNull(), b.try_cast("double")).otherwise(F.coalesce(c, F.lit(0.0)))
    rows = rows.filter(direct.isNotNull() | nested.isNotNull() | (main_type(F.col("media_type")) == "image"))
    number = (F.row_number().over(Window.partitionBy("item_id").orderBy("position", "media_id")) - 1).cast("int")
    return rows.select("item_id", number.alias("image_index"), "media_id", pick(direct, nested, F.col("probed_width")).alias("width"), pick(json("$.height"), json("$.dimensions.original.height"), F.col("probed_height")).alias("height"), "source")


def match_by_name(images: DataFrame, xml_media: DataFrame) -> DataFrame:
    """Each image with the first XML medium of the same file stem; null without one."""
    named = xml_media.withColumn("stem", file_stem(F.col("source"))).groupBy("item_id", "stem").agg(F.min_by("media_id", "position").alias("xml_media_id"))
    named = named.select(F.col("item_id").alias("i"), F.col("stem").alias("s"), "xml_media_id")
    return images.join(named, (F.col("item_id") == F.col("i")) & (file_stem(F.col("source")) == F.col("s")), "left").drop("i", "s")


def match_by_order(images: DataFrame, xml_media: DataFrame) -> DataFrame:
    """Each image with the XML medium of the same ordinal; null without one."""
    order = Window.partitionBy("item_id").orderBy("position", "media_id")
    numbered = xml_media.select(F.col("item_id").alias("i"), (F.row_number().over(order) - 1).alias("n"), F.col("media_id").alias("xml_media_id"))
    return images.join(numbered, (F.col("item_id") == F.col("i")) & (F.col("image_index") == F.col("n")), "left").drop("i", "n")


def mergeable(media: DataFrame) -> DataFrame:
    """Media whose pages can be merged: exactly the one layout, and not empty."""
    return media.filter((F.col("size") > 0) & (F.col("media_type") == schemas.ALTO))


def media_files(media: DataFrame, images: DataFrame, contents: DataFrame, how: str = "order") -> DataFrame:
    """Files (item_id, kind, file_no, media_id, content) of the XML media of items, in page order.

    ``contents`` is (media_id, content). By name, an image without XML keeps its number with an empty file. Items need
    an XML medium and an image. A word index medium replaces the XML media; of several, the last by position.
    """
    roles = classify_media(media)
    tsv = roles.filter("role = 'tsv'").groupBy("item_id").agg(F.max_by("media_id", F.struct("position", "media_id")).alias("media_id"))
    tsv = tsv.select("item_id", F.lit(schemas.TSV).alias("kind"), F.lit(0).alias("file_no"), "media_id")
    xml = roles.filter("role in ('xml', 'generic_xml')").join(tsv.select("item_id"), "item_id", "left_anti").join(images.select("item_id").distinct(), "item_id", "left_semi")
    kinds = xml.select("item_id", F.col("media_id"), F.col("media_type").alias("kind"), "position")
    if how == "basename":
        placed = match_by_name(images, xml).join(xml.select("item_id").distinct(), "item_id", "left_semi")
        placed = placed.select("item_id", F.col("xml_media_id").alias("media_id"), F.col("image_index").alias("file_no"))
        first = kinds.groupBy("item_id").agg(F.min_by("kind", "position").alias("kind"))
        placed = placed.join(first, "item_id")
    else:
        order = Window.partitionBy("item_id").orderBy("position", "media_id")
        placed = kinds.select("item_id", "media_id", (F.row_number().over(order) - 1).alias("file_no"), F.first("kind").over(order).alias("kind"))
    chosen = tsv.unionByName(placed.select("item_id", "kind", "file_no", "media_id"))
    return chosen.join(contents.select("media_id", "content"), "media_id", "left").select("item_id", "kind", F.col("file_no").cast("int").alias("file_no"), "media_id", "content")
