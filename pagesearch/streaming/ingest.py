"""Live ingest of text files; an addition, as search itself is a batch job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.trigrams import gram_counts, gram_table
from ..sources.listing import listed_files, read_files
from ..sources.sniff import typed_files
from ..sources.store import Store
from ..sources.zones import file_pages, numeric_zones, parse_files


#: What the store has of each item: when and where its file was; its zones.
FILES = "item_id bigint, modified timestamp, path string"
ZONES = "item_id bigint, page_no int, zone_no int, text string, hpos double, vpos double, width double, height double, page_width double, page_height double, zone_code string"
ORDER = {"zones": ["item_id", "page_no", "zone_no"], "grams": ["item_id", "gram"], "gram_counts": ["item_id", "gram"]}


def _later(store: Store, files: DataFrame) -> DataFrame:
    """(item_id, modified, path): the last file of each item, if it is later than the one that the store has."""
    latest = files.groupBy("item_id").agg(F.max(F.struct("modified", "path")).alias("last"))
    known = store.read("files", FILES).select(F.col("item_id").alias("known_id"), F.col("modified").alias("known"))
    new = latest.join(known, F.col("item_id") == F.col("known_id"), "left").filter("known is null or last.modified > known")
    return new.select("item_id", F.col("last.modified").alias("modified"), F.col("last.path").alias("path"))


def _replace(store: Store, items: DataFrame, chosen: DataFrame, files: DataFrame, fix_mode: str) -> None:
    """Put the zones of the chosen files in place of all that the store has of the items."""
    layouts = files.filter(F.col("kind").isin(schemas.ALTO, schemas.PDF2XML)).withColumn("file_no", F.lit(0))
    zones = numeric_zones(file_pages(parse_files(layouts, fix_mode)))
    store.upsert(items, {"zones": zones, "grams": lambda done: gram_table(done["zones"]), "gram_counts": lambda done: gram_counts(done["grams"]), "files": chosen}, ORDER)


def upsert_files(store: Store, batch: DataFrame, fix_mode: str = "no") -> bool:
    """Put the files of a batch (item_id, kind, path, modified, content) into the store, if any is new: whether any was.

    Of several files of an item the last modified counts, the last by path of equals. A file that is not later than the
    one that the store has of its item is passed over: an old version that comes late, or a batch that is tried again.
    A new version replaces all zones of its item.
    """
    chosen = _later(store, batch).persist()
    try:
        if chosen.isEmpty():
            return False
        _replace(store, chosen, chosen, batch.join(chosen.select(F.col("path").alias("chosen_path")), F.col("path") == F.col("chosen_path"), "left_semi"), fix_mode)
        return True
    finally:
        chosen.unpersist()


def refresh_files(store: Store, folders: list[str], kind: str | None = None, pattern: str = r"/([0-9]+)\.", fix_mode: str = "no") -> tuple[int, int]:
    """Bring the store up to the files that are below ``folders``: (files read, items removed).

    Files are listed by tasks and compared with what the store has by their paths and times; only the contents of new or
    changed files are read. Items whose file is gone are removed.
    """
    spark = store.spark
    listed = listed_files(spark, folders).withColumn("item_id", F.regexp_extract("path", pattern, 1).try_cast("bigint")).filter("item_id is not null").persist()
    known = store.read("files", FILES).drop("bucket")
    chosen = _later(store, listed).persist()
    gone = known.join(listed.select("item_id"), "item_id", "left_anti").select("item_id").persist()
    try:
        n, m = chosen.count(), gone.count()
        if n or m:
            files = read_files(chosen)
            files = files.withColumn("kind", F.lit(kind)) if kind else typed_files(files).withColumnRenamed("media_type", "kind")
            _replace(store, chosen.select("item_id").unionByName(gone), chosen, files, fix_mode)
        return n, m
    finally:
        for df in (listed, chosen, gone):
            df.unpersist()


def stream_zones(spark: SparkSession, folder: str, kind: str | None, table: str, checkpoint: str, pattern: str = r"/([0-9]+)\.", fix_mode: str = "no") -> StreamingQuery:
    """Parse XML files as they arrive in ``folder`` and keep the zones of each item's latest file in the store at ``table``.

    The item is the first group of ``pattern`` in the file's path. Without a ``kind``, files are typed as they come; one of
    another type leaves its item without zones. Each item is one file. Batches may be tried again; see upsert_files().
    """
    if kind not in (None, schemas.ALTO, schemas.PDF2XML):
        raise ValueError(f"not an XML layout: {kind}")
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    files = files.select(F.regexp_extract("path", pattern, 1).try_cast("bigint").alias("item_id"), "path", F.col("modificationTime").alias("modified"), "content").filter("item_id is not null")
    files = files.withColumn("kind", F.lit(kind)) if kind else typed_files(files).withColumnRenamed("media_type", "kind")

    def write(batch: DataFrame, number: int) -> None:
        upsert_files(Store(batch.sparkSession, table), batch, fix_mode)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_zones(spark: SparkSession, table: str) -> DataFrame:
    """The zones of every item's latest file."""
    return Store(spark, table).read("zones", ZONES).drop("bucket")
