"""Versioned tables by item: immutable folders and a manifest that says which version has each bucket.

    folder/data/<version>/<table>/bucket=<k>/part-...    written once, never changed
    folder/manifest/<number>                             {"buckets": n, "tables": {table: {bucket: version}}}

A writer first writes data under a new version, then a manifest under a temporary name, and renames it to the next number
as its last step. Readers take the manifest with the highest number, so they see all of a version or nothing of it, and a
version that they have opened stays whole while others write. Of two writers the later one finds its number taken and is
told to try again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables to write, in order: rows of items, or a function from the tables written before to rows of buckets. It is given
#: all rows of the buckets that are written, with their bucket, and what it makes of a bucket takes the place of all that
#: the table had of it.
Tables = dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]]


#: Items up to which an update sends their ids to the stored rows, some 16 bytes each, and not the rows to the ids.
MANY = 4_000_000


class Conflict(RuntimeError):
    """Another writer has switched in between; nothing of this writer's is seen."""


def with_bucket(df: DataFrame, buckets: int) -> DataFrame:
    """The item's bucket: its hash modulo the number of buckets."""
    return df.withColumn("bucket", F.pmod(F.hash(F.col("item_id").cast("bigint")), F.lit(buckets)))


@dataclass(frozen=True)
class Manifest:
    """``number`` 0 is an empty store. ``tables`` has for each table the version that holds each bucket with rows."""

    number: int
    buckets: int
    tables: dict[str, dict[int, str]]


class Store:
    """Tables with a column item_id in one folder of a file system that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    # --- files ---------------------------------------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        path = self._path("")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _switch(self, manifest: Manifest) -> None:
        """Make ``manifest`` the current one, or raise Conflict if its number is taken."""
        jvm, fs = self.spark._jvm, self._fs()
        new, at = self._path(f"manifest/.{uuid.uuid4().hex}"), self._path(f"manifest/{manifest.number:012d}")
        out = fs.create(new)
        out.write(bytearray(json.dumps({"buckets": manifest.buckets, "tables": manifest.tables}).encode()))
        out.close()
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
            files.rename(fs.makeQualified(new), fs.makeQualified(at), how)
        except Py4JJavaError as e:
            fs.delete(new, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"manifest {manifest.number} was written by another writer") from None
            raise

    def manifest(self, number: int | None = None) -> Manifest:
        """The current manifest, or an earlier one."""
        names = [n for n in self._names("manifest") if not n.startswith(".")]
        if not names:
            return Manifest(0, 0, {})
        name = names[-1] if number is None else f"{number:012d}"
        stream = self._fs().open(self._path(f"manifest/{name}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        held = json.loads(text)
        return Manifest(int(name), held["buckets"], {t: {int(k): v for k, v in of.items()} for t, of in held["tables"].items()})

    # --- tables --------------------------------------------------------------------------------------------------

    def read(self, table: str, schema, manifest: Manifest | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a table with its column bucket, by the manifest; ``only`` some buckets. Buckets without rows have
        no folder."""
        manifest = self.manifest() if manifest is None else manifest
        by_version: dict[str, list[str]] = {}
        for bucket, version in manifest.tables.get(table, {}).items():
            if only is None or bucket in only:
                by_version.setdefault(version, []).append(f"{self.folder}/data/{version}/{table}/bucket={bucket}")
        empty = self.spark.createDataFrame([], schema)
        whole = empty if "bucket" in empty.columns else empty.withColumn("bucket", F.lit(0))
        parts = [self.spark.read.schema(whole.schema).option("basePath", f"{self.folder}/data/{v}/{table}").parquet(*paths) for v, paths in sorted(by_version.items())]
        return reduce(DataFrame.unionByName, parts) if parts else whole.filter(F.lit(False))

    def _write(self, version: str, table: str, rows: DataFrame, order: list[str] | None, dealt: int) -> dict[int, str]:
        """Write rows by their bucket, sorted within files. Spark cuts the rows to partitions of its advised size, so a
        bucket has as many files as it is large, and small buckets share a task. Up to ``dealt`` buckets are written from
        the partitions that rows have, as they come: a task keeps a file open for each bucket, so nothing is shuffled or
        sorted. Spark sorts what is left once as many files are open as it may open, so it may open one more."""
        writers, before = "spark.sql.maxConcurrentOutputFileWriters", self.spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0")
        if not dealt:
            rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *(order or []))
        try:
            if dealt:
                self.spark.conf.set(writers, str(dealt + 1))
            rows.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.folder}/data/{version}/{table}")
        finally:
            self.spark.conf.set(writers, before)
        return {int(n.partition("=")[2]): version for n in self._names(f"data/{version}/{table}") if n.startswith("bucket=")}

    def _put(self, tables: Tables, of: dict[str, dict[int, str]], keys: DataFrame | None, before: Manifest, buckets: int, order: dict[str, list[str]], dealt: bool) -> Manifest:
        """Write each table under a new version and switch to it. A table given as a function is made of the rows that
        this call has written, by table, so that what rows are made of is computed once."""
        version, written, changed = uuid.uuid4().hex, {}, None
        if keys is not None:
            by_bucket = {r.bucket: r["count"] for r in keys.groupBy("bucket").count().collect()}  # as many rows as buckets at most
            changed, gone = sorted(by_bucket), keys.select("item_id")
            if sum(by_bucket.values()) <= MANY:
                gone = gone.hint("broadcast")
        for t, made in tables.items():
            if callable(made):
                new = made(written)
                new = new if "bucket" in new.columns else with_bucket(new, buckets)
            else:
                new = with_bucket(made.drop("bucket"), buckets)
                if changed is not None:
                    new = self.read(t, made.drop("bucket").schema, before, changed).join(gone, "item_id", "left_anti").select(*new.columns).unionByName(new)
            files = self._write(version, t, new, order.get(t, ["item_id"]), buckets if dealt else 0)
            of[t] = {k: v for k, v in of.get(t, {}).items() if changed is not None and k not in changed} | files
            written[t] = self.read(t, new.drop("bucket").schema, Manifest(0, buckets, {t: files}))
        after = Manifest(before.number + 1, buckets, of)
        self._switch(after)
        return after

    def replace_all(self, tables: Tables, buckets: int, order: dict[str, list[str]], dealt: bool = False) -> Manifest:
        """A new version with these tables and no others. ``dealt`` says that the rows' partitions are few enough for a
        file of each in each bucket; they are then written where they are."""
        return self._put(tables, {}, None, self.manifest(), buckets, order, dealt)

    def upsert(self, items: DataFrame, tables: Tables, order: dict[str, list[str]], buckets: int = 64, dealt: bool = False) -> Manifest:
        """Replace all rows of ``items`` (item_id) in ``tables`` by those given, in one step for all tables; an item
        without rows is removed. Only the buckets of these items are written anew. An empty store gets ``buckets``."""
        before = self.manifest()
        buckets = before.buckets or buckets
        keys = with_bucket(items.select(F.col("item_id").cast("bigint").alias("item_id")).distinct(), buckets)
        return self._put(tables, {t: dict(b) for t, b in before.tables.items()}, keys, before, buckets, order, dealt)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete data that none of the last ``keep`` manifests names, and the manifests before these: what stopped
        writers have left, and versions that no reader should still have open. Not to be run beside a writer."""
        names = [n for n in self._names("manifest") if not n.startswith(".")]
        needed = {v for n in names[-keep:] for of in self.manifest(int(n)).tables.values() for v in of.values()}
        gone = [v for v in self._names("data") if v not in needed]
        fs = self._fs()
        for n in names[:-keep]:
            fs.delete(self._path(f"manifest/{n}"), False)
        for v in gone:
            fs.delete(self._path(f"data/{v}"), True)
        return gone
