"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id and the whole text, null as empty; every other column but ``also`` is left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *also)


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it in any case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def set_checkpoint_dir(spark: SparkSession) -> str:
    """Point checkpoints at the shared folder that the session names; only a local session may make its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (sc.master or "").startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder: later uses reread it, also after an executor is lost.

    Spark deletes the files once nothing refers to the frame, if spark.cleaner.referenceTracking.cleanCheckpoints is
    set. Results are kept this way; what an operator needs only in between belongs into a Work.
    """
    set_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Work:
    """Tables in the shared folder that one call needs until its result is materialised; the end deletes them all."""

    #: Setting by which shuffle files go as soon as the table that they led to is written.
    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, drop_shuffles: bool = False):
        self.drop_shuffles = drop_shuffles
        self.spark, self.folder, self.made, self.named = spark, f"{set_checkpoint_dir(spark)}/work-{uuid.uuid4().hex}", 0, []
        self.written: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Work:
        if self.drop_shuffles:
            self.before = self.spark.conf.get(self.CLEANUP, "false")
            self.spark.conf.set(self.CLEANUP, "true")
        return self

    def __exit__(self, *_) -> None:
        if self.drop_shuffles:
            self.spark.conf.set(self.CLEANUP, self.before)
        for name in self.named:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, self.folder)

    def path(self) -> str:
        self.made += 1
        return f"{self.folder}/{self.made}"

    def table(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """The rows of ``df``, written as Parquet and read again, in folders by the values of a column if one is named."""
        path = self.path()
        (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.written.append((out, path))
        return out

    def drop(self, table: DataFrame) -> None:
        """Delete one table before the end."""
        for frame, path in self.written:
            if frame is table:
                delete(self.spark, path)

    def bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """The same, in buckets by key, so that joins on it leave the rows in place."""
        name = f"work_{uuid.uuid4().hex}"
        self.named.append(name)
        buckets = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        df.write.bucketBy(buckets, key).option("path", self.path()).option("compression", "zstd").saveAsTable(name)
        return self.spark.table(name)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint behind a count of a materialised frame; beyond the bound Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= max_rows else df


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column without nulls, all after one another, and the n + 1 offsets; nothing is copied."""
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, "<i8", len(wide) + 1, 8 * wide.offset) if len(wide) else np.zeros(1, "i8")
    whole = np.frombuffer(data, "u1") if data is not None else np.empty(0, "u1")
    return whole[at[0] : at[-1]], at - at[0]


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The binary column whose n values lie between the n + 1 offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(np.ascontiguousarray(data))])


def parcels(batches: Iterable[pa.RecordBatch], size: int, text: str = "text") -> Iterator[pa.Table]:
    """Rows of ``batches`` in their order, put together or cut so that a parcel has at most ``size`` bytes of text, or
    one row."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(b.schema.get_field_index(text))).to_numpy(zero_copy_only=False), dtype="i8")
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            fit = int(np.searchsorted(ends, before + size - n, side="right"))
            if fit <= at and held:
                yield pa.Table.from_batches(held)
                held, n = [], 0
                continue
            fit = max(fit, at + 1)
            held.append(b.slice(at, fit - at))
            n += int(ends[fit - 1]) - before
            at = fit
    if held:
        yield pa.Table.from_batches(held)


def byte_set(characters: str) -> np.ndarray:
    """Whether each byte is one of these ASCII characters."""
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


class WordScan:
    """Words of several texts at once: ``data`` has the texts with a line feed after each, ``starts`` and ``ends`` the
    places of the words, ``doc`` the number of the text that each is in. ``apart`` are the bytes between words."""

    def __init__(self, texts: list[bytes], apart: np.ndarray):
        self.data = np.frombuffer(b"\n".join([*texts, b""]), "u1")
        self.apart = apart[self.data]
        edge = np.diff(self.apart.view("i1"), prepend=np.int8(1))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge[: len(self.data)] == 1)
        sizes = np.fromiter(map(len, texts), "i8", len(texts)) + 1
        self.begins = np.cumsum(sizes) - sizes
        self.doc = np.searchsorted(self.begins, self.starts, side="right") - 1

    def values(self) -> pa.Array:
        """The words as a binary column."""
        offsets = np.concatenate(([0], np.cumsum(self.ends - self.starts)))
        return pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(self.data[~self.apart])])
