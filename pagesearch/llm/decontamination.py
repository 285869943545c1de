"""Benchmark decontamination: rare n-grams of items join passages of documents, Smith-Waterman alignment scores them."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, id_and_text, materialize, unused

WORD, BETWEEN = re.compile(r"\w+"), re.compile(r"\W")
#: A match adds 1, a substitution or a gap takes this. A copy with a fifth of its words replaced has a score of
#: 0.8 - 0.2 * PENALTY = 0.75 for each word of the item.
PENALTY, SCORE = 0.25, 0.75
#: Characters of documents that are looked up together, or one document.
TOGETHER = 1 << 18
#: Items with fewer words count only as they are, word by word, since edits would leave nothing of them.
SHORT = 5
#: A seed is two words of which the second follows within this many places.
REACH = 4
#: A passage holds one seed for each so many words of its item, or more, wherever the item has enough of them.
WORDS_A_SEED = 8
#: A filter has at most 2 to this power bits (32 MB); with more keys it only lets more through to the join.
BITS = 28
#: Hashes of words that a worker keeps; characters of a long text that are split at a time.
KEPT, SLICE = 1 << 18, 1 << 20
#: Odd, so that its powers have inverses modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
#: Seeds that a task counts together before Spark adds up.
COUNTED = 1 << 20


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Hashes(dict):
    """The 64-bit hash of each word; the words seen are kept, and forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: str) -> np.ndarray:
        """Hashes of the words of a text, of which one slice at a time becomes strings."""
        parts = [np.fromiter(map(self.__getitem__, found), "u8", len(found)) for found in map(WORD.findall, slices(text.lower()))]
        return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, "u8"), *parts])


def slices(low: str) -> Iterator[str]:
    """A text in parts of about SLICE characters, none of which cuts a word."""
    at = 0
    while at < len(low):
        stop = BETWEEN.search(low, at + SLICE) if len(low) - at > SLICE else None
        to = stop.start() if stop else len(low)
        yield low[at:to]
        at = to


@cache
def letters() -> np.ndarray:
    """A 64-bit value for each character of words, 0 for any other."""
    x = np.arange(1, sys.maxunicode + 2, dtype="u8") * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    x = (x ^ (x >> np.uint64(32))) | np.uint64(1 << 63)
    inside = np.zeros(len(x), bool)
    for m in WORD.finditer("".join(map(chr, range(len(x))))):
        inside[m.start() : m.end()] = True
    return np.where(inside, x, np.uint64(0))


@cache
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2 ** bits powers of BASE and of its inverse."""
    both = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(1 << bits, base, "u8")
        p[0] = 1
        both.append(np.cumprod(p, dtype="u8"))
    return both[0], both[1]


def word_keys(low: str) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first character, key) of each word. All words are taken at once: a key is the sum of the values of the
    word's characters, up to SLICE of them, times powers of BASE. Equal words have equal keys, so seeds lose nothing by
    them; scores come from words."""
    if len(low) > SLICE:
        low = "\n".join(w[:SLICE] for w in WORD.findall(low))
    value = letters()[np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "u4")]
    inside = value != 0
    inside[1:] &= value[:-1] == 0
    start = np.flatnonzero(inside)
    if not len(start):
        return start, np.empty(0, "u8")
    up, down = powers(max(18, (len(value) - 1).bit_length()))
    return start, np.add.reduceat(value * up[: len(value)], start) * down[start]


def blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of several texts after one another: their keys, the text that each is in and its place there."""
    held: list[str] = []
    size = 0
    for k, text in enumerate(texts):
        held.append(text.lower())
        size += len(held[-1]) + 1
        if k + 1 < len(texts) and size + len(texts[k + 1]) < TOGETHER:
            continue
        if size <= SLICE:
            start, key = word_keys("\n".join(held))
            begin = np.cumsum([0, *(len(h) + 1 for h in held)])
            lengths = np.diff(np.searchsorted(start, begin))
        else:
            keys = [[word_keys(part)[1] for part in slices(h)] for h in held]
            lengths = np.array([sum(map(len, parts)) for parts in keys])
            key = np.concatenate([np.empty(0, "u8"), *(x for parts in keys for x in parts)])
        row = np.repeat(np.arange(len(held)), lengths)
        yield key, row + (k + 1 - len(held)), np.arange(len(row)) - (np.cumsum(lengths) - lengths)[row]
        held, size = [], 0


def gram(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """The key of a seed of two words; a seed of one word has 0 for the other."""
    b = np.asarray(b, "u8")
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0x165667B19E3779F9)
    return (x ^ (x >> np.uint64(29))).view("i8")


class Filter:
    """Bits by the first bits of 64-bit keys: a key whose bit is not set is none of those that it was made from."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.shift = words, np.uint64(64 - bits)

    @classmethod
    def of(cls, keys: DataFrame, most: int) -> Filter:
        """From the only column of ``keys``; Spark sets the bits, so the driver gets 2 ** (most - 6) words or fewer."""
        bits = min(most, max(10, (16 * keys.count()).bit_length()))
        slot = F.shiftrightunsigned("key", 64 - bits)
        words = keys.toDF("key").select(slot.alias("slot")).selectExpr("shiftright(slot, 6) AS word", "shiftleft(1L, CAST(slot & 63 AS INT)) AS bit")
        got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        out = np.zeros(1 << (bits - 6), "i8")
        out[got.column(0).to_numpy()] = got.column(1).to_numpy()
        return cls(out.view("u8"), bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = keys.view("u8") >> self.shift
        return (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def seeds_in(keys: Filter, single: bool, words: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, key) of the seeds of texts that the filter lets through; ``single``: also those of one word."""
    at, found = [], []
    for apart in range(0 if single else 1, REACH + 1):
        key = gram(words[: max(0, len(words) - apart)], words[apart:] if apart else 0)
        ok = np.flatnonzero((row[apart:] == row[: max(0, len(row) - apart)]) & keys.has(key))
        at.append(ok)
        found.append(key[ok])
    at = np.concatenate(at)
    return row[at], place[at], np.concatenate(found)


def seeds_needed(n: int, bound: float) -> tuple[int, int]:
    """How many seeds an item of ``n`` words takes, and how many of these every passage at its bound holds.

    Seeds are pairs of neighbouring item words, no word in two of them. A passage may lose n * (1 - bound) of the score:
    at least 1 for an item word without a match, which spoils one pair at most, and PENALTY for a word put between. A
    pair whose words match is a seed of the passage unless REACH words or more were put between them.
    """
    if n == 1:
        return 1, 1
    lose = n * (1 - bound) + 1e-6
    gone = np.arange(int(lose) + 1)
    spoilt = int((gone + ((lose - gone) / PENALTY // REACH).astype("i8")).max())
    taken = min(n // 2, spoilt + max(1, n // WORDS_A_SEED))
    if taken <= spoilt:
        raise ValueError(f"a bound of {bound} is too low for seeds to reach every passage")
    return taken, taken - spoilt


def slack(n: int, bound: float) -> int:
    """The most words that gaps of a passage can have."""
    return int((n * (1 - bound) + 1e-6) / PENALTY)


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair of word sequences, and the first passage word after one that has it.

    All pairs advance together by one item word a step; gaps along the passage are a running maximum, as a gap costs
    the same for each word.
    """
    best, end = np.zeros(len(items), "f4"), np.zeros(len(items), "i8")
    order = sorted(range(len(items)), key=lambda k: len(passages[k]))
    at = 0
    while at < len(order):
        n = max(1, min(256, 200_000 // max(1, len(passages[order[min(at + 255, len(order) - 1)]]))))
        some, at = order[at : at + n], at + n
        rows, width = max(len(items[k]) for k in some), max(len(passages[k]) for k in some)
        a, b = np.full((len(some), rows), -1, "i4"), np.full((len(some), width), -2, "i4")
        for r, k in enumerate(some):
            a[r, : len(items[k])] = items[k]
            b[r, : len(passages[k])] = passages[k]
        slope = (PENALTY * np.arange(width)).astype("f4")
        before, top, where = np.zeros((len(some), width + 1), "f4"), np.zeros(len(some), "f4"), np.zeros(len(some), "i8")
        for i in range(rows):
            step = before[:, :-1] + np.where(b == a[:, i : i + 1], np.float32(1), np.float32(-PENALTY))
            step = np.maximum(np.maximum(step, before[:, 1:] - np.float32(PENALTY)), 0)
            before[:, 1:] = np.maximum.accumulate(step + slope, axis=1) - slope
            j = before.argmax(axis=1)
            value = before[np.arange(len(some)), j]
            where = np.where(value > top, j, np.where(value == top, np.minimum(where, j), where))
            top = np.maximum(top, value)
        best[some], end[some] = top, where
    return best, end


def bound_of(n: int, threshold: float) -> float:
    return 1.0 if n < SHORT else threshold


def distinct_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, item): the words of each item with single spaces and their hash; items with the same words are
    one, under their smallest id. Items without an id, a text or a word are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(words_of(t)) for t in b.column(1).to_pylist()], pa.string())], ["item_id", "words"])

    slim = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    return slim.mapInArrow(run, "item_id long, words string").filter("words <> ''").groupBy("words").agg(F.min("item_id").alias("item_id")).select("item_id", "words", F.xxhash64("words").alias("item"))


def item_pairs(items: DataFrame) -> DataFrame:
    """(item_id, item, n, place, seed): all pairs of neighbouring words of each item of ``n`` words, or its only word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                item_id, words, item = (c[k].as_py() for c in whole.columns)
                ids = np.concatenate([word_keys(part)[1] for part in slices(words)])
                seed = gram(ids, 0) if len(ids) == 1 else gram(ids[:-1], ids[1:])
                same = [pa.array(np.full(len(seed), v, "i8")) for v in (item_id, item, len(ids))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(len(seed))), pa.array(seed)], ["item_id", "item", "n", "place", "seed"])

    return items.mapInArrow(run, "item_id long, item long, n long, place long, seed long")


def counted(texts: DataFrame, keys: Filter, single: bool) -> DataFrame:
    """(seed, times) over all texts, for the seeds that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def totals() -> pa.RecordBatch:
            seed, times = np.unique(np.concatenate([np.empty(0, "i8"), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(seed), pa.array(times)], ["seed", "times"])

        for b in batches:
            for at in range(0, b.num_rows, 512):
                for block in blocks(b.column(0).slice(at, 512).to_pylist()):
                    held.append(seeds_in(keys, single, *block)[2])
                    size += len(held[-1])
                    if size >= COUNTED:
                        yield totals()
                        held, size = [], 0
        yield totals()

    return texts.select("text").mapInArrow(run, "seed long, times long").groupBy("seed").agg(F.sum("times").alias("times"))


def rarest(n: int, bound: float, pairs: list[dict]) -> tuple[list[dict], int]:
    """The rarest pairs of an item of which no two share a word, and how many of these every passage holds."""
    taken, least = seeds_needed(n, bound)
    order = sorted(pairs, key=lambda p: (p["times"], p["place"]))
    used, out = bytearray(n + 1), []
    for p in order:
        at = p["place"]
        if len(out) < taken and not used[at] and not used[at + 1]:
            used[at] = used[at + 1] = 1
            out.append(p)
    return (out if len(out) == taken else [p for p in order if p["place"] % 2 == 0][:taken]), least


def rare_seeds(pairs: DataFrame, times: DataFrame, threshold: float) -> DataFrame:
    """(seed, item_id, item, n, least, first, last, weight): the seeds of each item. A pair that an item has at several
    places is one row with the first and last of them and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                item_id, item, n, own = (c[k].as_py() for c in whole.columns)
                chosen, least = rarest(n, bound_of(n, threshold), own)
                same = [pa.array(np.full(len(chosen), v, "i8")) for v in (item_id, item, n, least)]
                seed, place = (pa.array([p[c] for p in chosen], pa.int64()) for c in ("seed", "place"))
                yield pa.RecordBatch.from_arrays([seed, *same, place], ["seed", "item_id", "item", "n", "least", "place"])

    counts = pairs.join(times, "seed", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    items = counts.groupBy("item_id", "item", "n").agg(F.collect_list(F.struct("place", "seed", "times")).alias("pairs"))  # the words of one text
    some = items.mapInArrow(run, "seed long, item_id long, item long, n long, least long, place long")
    return some.groupBy("seed", "item_id", "item", "n", "least").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("weight"))


def places(texts: DataFrame, keys: Filter, single: bool) -> DataFrame:
    """(digest, seed, at): where each text has seeds; texts that are equal are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                b = whole.slice(begin, 512)
                for block in blocks(b.column(1).to_pylist()):
                    row, place, seed = seeds_in(keys, single, *block)
                    if not len(row):
                        continue
                    order = np.lexsort((place, seed, row))
                    row, place, seed = row[order], place[order], seed[order]
                    first = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(seed) != 0))))
                    at = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(place, pa.int32()))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[first])), pa.array(seed[first]), at], ["digest", "seed", "at"])

    found = texts.select("digest", "text").mapInArrow(run, "digest binary, seed long, at array<int>")
    return found.groupBy("digest", "seed").agg(F.first("at").alias("at"))


def candidates(texts: DataFrame, benchmark: DataFrame, threshold: float, bits: int) -> DataFrame | None:
    """(digest, found): for each different text the items of which it has enough seeds, with these seeds and the
    item's words; kept as a checkpoint. None if there is nothing to search for."""
    with Work(texts.sparkSession) as work:
        items = work.table(distinct_items(benchmark))
        pairs = work.table(item_pairs(items))
        single = bool(pairs.filter("n = 1").take(1))
        if not items.take(1):
            return None
        times = counted(texts, Filter.of(pairs.select("seed").distinct(), bits), single)
        seeds = work.table(rare_seeds(pairs, times, threshold))
        hits = places(texts, Filter.of(seeds.select("seed").distinct(), bits), single).join(seeds, "seed")
        enough = hits.groupBy("digest", "item_id", "item", "n", "least").agg(F.sum("weight").alias("held"), F.collect_list(F.struct("first", "last", "weight", "at")).alias("seeds")).filter("held >= least")
        found = enough.join(items, ["item_id", "item"]).groupBy("digest").agg(F.collect_list(F.struct("item_id", "words", "least", "seeds")).alias("found"))
        return materialize(found)


def passages(n: int, bound: float, least: int, seeds: list[dict]) -> list[tuple[int, int]]:
    """(first word, end) of the stretches of a text that hold every passage of an item of ``n`` words at its bound."""
    extra = slack(n, bound)
    size = [len(s["at"]) for s in seeds]
    at = np.concatenate([np.asarray(s["at"], "i8") for s in seeds])
    first, last, weight = (np.repeat(np.array([s[c] for s in seeds]), size) for c in ("first", "last", "weight"))
    order = np.argsort(at, kind="stable")
    at, first, last, weight = at[order], first[order], last[order], weight[order]
    before = np.concatenate(([0], np.cumsum(weight)))
    near = before[np.searchsorted(at, at + n + extra, "right")] - before[np.searchsorted(at, at - n - extra, "left")]
    keep = near >= least
    at, first, last = at[keep], first[keep], last[keep]
    if not len(at):
        return []
    new = np.flatnonzero(np.concatenate(([True], np.diff(at) > n + extra)))
    return list(zip(np.maximum(np.minimum.reduceat(at - last - extra, new), 0).tolist(), np.maximum.reduceat(at - first + n + extra, new).tolist()))


def search(rows: list[tuple[str, list[dict]]], threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(row, best item id, score, number of items, word after the passage) of the texts that hold an item; ``rows``: texts
    with what candidates() found for them."""
    hashes = Hashes()
    owner, words, parts = [], [], []
    for row, (text, found) in enumerate(rows):
        ids = None
        for k, item in enumerate(found):
            own = hashes.of(item["words"])
            for a, b in passages(len(own), bound_of(len(own), threshold), item["least"], item["seeds"]):
                ids = hashes.of(text) if ids is None else ids
                owner.append((row, k, a))
                words.append(own)
                parts.append(ids[a:b])
    best: dict[int, dict[int, tuple[float, int]]] = {}
    _, dense = np.unique(np.concatenate([np.empty(0, "u8"), *words, *parts]), return_inverse=True)  # numbers that align() holds
    dense = np.split(dense, np.cumsum([len(x) for x in [*words, *parts]])[:-1]) if words else []
    score, end = align(dense[: len(words)], dense[len(words) :])
    for (row, k, a), own, s, e in zip(owner, words, score.tolist(), end.tolist()):
        if s / len(own) >= bound_of(len(own), threshold):
            held = best.setdefault(row, {})
            held[k] = min(held.get(k, (0.0, 0)), (-s / len(own), a + e))
    out = []
    for row, held in sorted(best.items()):
        s, i, e = min((s, rows[row][1][k]["item_id"], e) for k, (s, e) in held.items())
        out.append((row, i, -s, len(held), e))
    return out


def keyed(docs: DataFrame, h: str, digest: str) -> DataFrame:
    """``docs`` with two more columns: a digest of the text and a hash of the digest."""
    return docs.withColumn(digest, F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))).withColumn(h, F.xxhash64(digest))


def let_through(docs: DataFrame, h: str, keys: Filter, through: bool = True) -> DataFrame:
    """The rows that the filter lets through, or the others."""
    at = docs.columns.index(h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = keys.has(b.column(at).to_numpy()) == through
            if ok.any():
                yield b.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)


def decontamination(docs: DataFrame, benchmark: DataFrame, threshold: float = SCORE, bits: int = BITS) -> DataFrame:
    """The documents that hold a benchmark item, exact or edited: doc_id, item_id, score, n_items, end_word.

    item_id is the item that scores best, the smallest of equals; n_items counts the items at or above their bound;
    end_word is the number of words up to the first end of a passage with that score. Words are letters and digits in
    lower case. An item of fewer than five words is found where its words stand one after the other, with nothing
    between. Items without an id, a text or a word are not searched; items with the same words are one. Null texts
    count as empty. Rows that share a doc_id, null too, come out as one, with the best of them. An empty table on either
    side gives an empty result; other columns are ignored.
    """
    texts = keyed(id_and_text(docs), "h", "digest")
    found = candidates(texts, benchmark, threshold, bits)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, n_items long, end_word long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                hits = search(list(zip(b.column(1).to_pylist(), b.column(2).to_pylist())), threshold)
                row, item, score, n, end = zip(*hits) if hits else ((),) * 5
                columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(end, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "n_items", "end_word"])

    near = let_through(texts, "h", Filter.of(found.select(F.xxhash64("digest")), bits)).join(found, "digest")
    judged = near.select("doc_id", "text", "found").mapInArrow(run, "doc_id long, item_id long, score double, n_items long, end_word long")
    merged = judged.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "item_id", "end_word")).alias("best"), F.max("n_items").alias("n_items"))
    return merged.select("doc_id", "best.item_id", (-F.col("best.s")).alias("score"), "n_items", "best.end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = SCORE, bits: int = BITS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item.

    Every row is judged by its own text, so rows that repeat an id or lack one stay or go each by itself; rows with null
    and empty texts stay. All rows stay when the benchmark has no item; an empty table stays empty.
    """
    h, digest, found_name = (unused(docs, c) for c in ("text_hash", "text_digest", "items_found"))
    found = candidates(keyed(id_and_text(docs), "h", "digest"), benchmark, threshold, bits)
    if found is None:
        return docs
    found = found.toDF(digest, found_name)
    rows, keys, width, at = keyed(docs, h, digest), Filter.of(found.select(F.xxhash64(digest)), bits), len(docs.columns), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                b = whole.slice(k, 64)
                hit = {r[0] for r in search([(str(t or ""), f or []) for t, f in zip(b.column(at).to_pylist(), b.column(width).to_pylist())], threshold)}
                yield b.select(list(range(width))).filter(pa.array([r not in hit for r in range(b.num_rows)], pa.bool_()))

    near = let_through(rows, h, keys).join(found, digest, "left").drop(h, digest)
    return let_through(rows, h, keys, False).drop(h, digest).unionAll(near.mapInArrow(run, docs.schema))
