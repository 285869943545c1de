"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

#: Hashed dimensions, and the most labelled documents that a fit reads. The model's size is bounded by the first and
#: the fit's memory and time by the second, whatever the corpus holds.
BITS, MAX_LABELLED = 20, 16384
#: Learning rate, its offset, L1 and L2 strength, and passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 2.0, 1.0, 2
THRESHOLD = 0.3
#: Words whose hashes a scorer keeps, and the longest that it keeps.
KEPT, KEPT_CHARS = 100_000, 40
WORD = re.compile(r"\w+")


class WordHashes(dict):
    """32-bit hashes of words, for those met so far."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh32_intdigest(word.encode())
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[word] = h
        return h


def _mixed(h: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """Slots of 64-bit feature hashes; kind keeps words, pairs and skips apart."""
    h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype("i8")


def slots(words: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(position of the first word, slot) of each word, of each pair of neighbours, and of each pair one word apart."""
    w = words.astype("u8")
    out = [(np.arange(len(w)), _mixed(w, 1, bits))]
    for gap in (1, 2):
        if len(w) > gap:
            out.append((np.arange(len(w) - gap), _mixed(w[:-gap] * np.uint64(0x100000001B3) + w[gap:], 1 + gap, bits)))
    return out


def word_hashes(text: str, table: WordHashes) -> np.ndarray:
    return np.fromiter(map(table.__getitem__, WORD.findall(text.lower())), "u4")


def fit(examples: Iterable[tuple[np.ndarray, int]], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots and weights that are not zero, and the bias. Each example: the distinct slots of a text, and its label;
    they come once for each pass and are not kept.

    Each coordinate has its own rate, which falls with the squared gradients that it has met; the L1 term keeps every
    coordinate at zero until its gradients agree. The bias is a coordinate without L1.
    """
    n_slots = 1 << bits
    z, n = np.zeros(n_slots + 1), np.zeros(n_slots + 1)
    for x, y in examples:
        at = np.append(x, n_slots)
        zi, ni = z[at], n[at]
        l1 = np.full(len(at), L1)
        l1[-1] = 0
        w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n[at] = ni + g * g
        z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
    l1 = np.full(n_slots + 1, L1)
    l1[-1] = 0
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    at = np.flatnonzero(w[:-1])
    return at.astype("i4"), w[at].astype("f4"), float(w[-1])


def examples(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(place, x, y): the distinct slots of each labelled text that is learned from, and its label.

    The sample is the first ``max_labelled`` labelled ids by MD5 whose crc32 mod 4 is not 2; an id with several labels
    counts as toxic if one says so, and rows without an id or a label are left out. Of rows that share an id one is
    learned from, the one whose slots hash lowest, so that rows are bounded as ids are.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("k"), F.col("toxic").cast("int").alias("toxic")).dropna()
    marks = marks.filter(F.pmod(F.crc32(F.col("k").cast("string")), F.lit(4)) != 2).groupBy("k").agg(F.max("toxic").alias("toxic"))
    sample = marks.orderBy(F.md5(F.col("k").cast("string"))).limit(max_labelled)
    rows = id_and_text(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("k")).select("doc_id", "text", "toxic")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for b in batches:
            xs = [np.unique(np.concatenate([s for _, s in slots(word_hashes(t.as_py(), table))])).astype("<i4").tobytes() for t in b.column(1)]
            place = [xxhash.xxh64_intdigest(str(i)) >> 1 for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(place, pa.int64()), pa.array(xs, pa.binary()), b.column(2)], ["doc_id", "place", "x", "y"])

    slim = rows.mapInArrow(features, "doc_id long, place long, x binary, y int")
    return slim.groupBy("doc_id").agg(F.min(F.struct("place", F.xxhash64("x").alias("h"), "x", "y")).alias("e")).select("e.place", "e.x", "e.y")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray, float] | None:
    """The model, from the sample of examples(); None when it is empty.

    One task fits. Spark brings it the examples once for each pass, in an order that ids alone decide, so that the task
    holds a batch of them; only the weights that are not zero go to the driver.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = (b for b in batches if b.num_rows)
        head = next(filled, None)
        if head is not None:
            at, w, bias = fit((np.frombuffer(x.as_buffer(), "<i4").astype("i8"), y) for b in chain([head], filled) for x, y in zip(b.column(0), b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()]), pa.array([w.tobytes()]), pa.array([bias])], ["at", "w", "bias"])

    passes = examples(docs, labels, max_labelled).withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))))
    ordered = passes.repartition(1).sortWithinPartitions("pass", "place", "x").select("x", "y")
    got = ordered.mapInArrow(learn, "at binary, w binary, bias double").collect()
    return (np.frombuffer(got[0].at, "<i4"), np.frombuffer(got[0].w, "<f4"), got[0].bias) if got else None


class Scorer:
    """Scores of texts: each slot that occurs counts once, however often it occurs."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray, float] | None, bits: int = BITS):
        self.bits, self.table, self.weights, self.bias = bits, WordHashes(), None, 0.0
        if model is not None:
            self.weights = np.zeros(1 << bits, "f4")
            self.weights[model[0]] = model[1]
            self.bias = model[2]

    def __call__(self, text: str) -> float:
        if self.weights is None:
            return 0.0
        total = self.bias
        hit: set[int] = set()
        for _, s in slots(word_hashes(text, self.table), self.bits):
            hit.update(s[self.weights[s] != 0].tolist())
        for s in sorted(hit):
            total += float(self.weights[s])
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every whole text.

    Without any usable label every score is 0. Null texts count as empty and get the bias alone. Null doc_ids are not
    held out. A row in gives a row out; only doc_id and text of ``docs`` are read, and only the text is scored.
    """
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            score = np.fromiter((scorer(t.as_py()) for t in b.column(1)), "f8", b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= threshold).astype("i4"))], ["doc_id", "score", "predicted"])

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", held.alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not predicted toxic.

    Every row is judged by its own text, so rows that repeat an id or lack one are kept or go each by itself. Null and
    empty texts are scored by the bias alone, and all rows stay when no label can be used. An empty table stays empty.
    """
    model = train(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            yield b.filter(pa.array([scorer(str(t.as_py() or "")) < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
