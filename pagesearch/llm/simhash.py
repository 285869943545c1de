"""SimHash near-duplicates: pigeonring chains choose the pairs, star contraction joins them to components.

Four bits of a SimHash find few of the pairs whose five-word similarity is 0.8 or little more: these differ in about 9 of
64 bits. So that one_of_each keeps one document of such pairs too, it adds links between texts whose shingles of five words
have that similarity; minima of these shingles choose the pairs, and the shingles themselves decide.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work, flat, id_and_text, materialize, unused

WORDS, MAX_BITS, SEED = 4, 4, 42
#: Segments of a fingerprint as (first bit, width): one more than the bits that may differ.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Buckets above this size are divided further before their members are compared: by a task up to the second size, and
#: beyond it before they are dealt to tasks.
DIVIDE, SPLIT = 4096, 1 << 16
#: Minima of five-word shingles for each text, of which a byte each is compared, and how many of these may differ for a pair
#: to be looked at: a pair with similarity 0.8 differs in 25.5 on average, with a deviation of 4.5. Beyond CLOSE a text is
#: also looked at with the two nearest to it.
MINIMA, MAX_DIFFERENT, CLOSE = 128, 38, 16
#: Least similarity of texts that are linked, as a fraction.
SIMILAR = (4, 5)
#: Texts that share a chain with more than BLOCK others meet by GROUPS groups of GROUP of the other minima's bytes: a pair with
#: similarity 0.8 shares none of them once in 2,800 times.
GROUPS, GROUP = 20, 5
#: Length of the ring of minima that is searched, and of its chains that have to be equal.
RING, CHAIN = 24, 3
#: Members of a chain's bucket that a task compares at a time.
BLOCK = 1 << 14
#: Bytes of text whose words are held at a time.
RUN = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_runs(text: bytes, width: int = WORDS, size: int = RUN) -> Iterator[list[bytes]]:
    """The words of a text in runs of about ``size`` bytes. A run begins with the last width - 1 words of the one
    before, so that each shingle is in exactly one run, however long the text is."""
    held: list[bytes] = []
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            space = SPACE.search(text, end)
            end = space.start() if space else len(text)
        words = held + text[at:end].lower().split()
        at = end
        if len(words) >= width or at >= len(text):
            yield words
            held = words[len(words) - width + 1 :] if len(words) >= width else []
        else:
            held = words


def shingle_hashes(text: str) -> Iterator[np.ndarray]:
    """XXH64 of each word shingle in order, in runs; A-Z lower-cased, words end at ASCII white space."""
    seen = False
    digest = xxhash.xxh64_intdigest
    for words in word_runs(text.encode()):
        if not words or (seen and len(words) < WORDS):
            continue  # what the run before has had already
        joined, shingles = b" ".join(words), max(1, len(words) - WORDS + 1)
        ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[:shingles].tolist()
        seen = True
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[-shingles:].tolist())], "<u8")


class Majority:
    """Majority bits of hashes that come in runs."""

    def __init__(self) -> None:
        self.votes, self.n = np.zeros(64, "i8"), 0

    def add(self, hashes: np.ndarray) -> None:
        for at in range(0, len(hashes), 1 << 16):
            self.votes += np.unpackbits(hashes[at : at + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
        self.n += len(hashes)

    def value(self) -> int:
        return int(np.packbits(self.votes * 2 > self.n, bitorder="little").view("<u8")[0])


def fingerprint(text: str) -> int:
    """Majority bits of the XXH64 of each word shingle."""
    found = Majority()
    for hashes in shingle_hashes(text):
        found.add(hashes)
    return found.value()


_FACTORS, _MASKS = (np.random.default_rng(SEED + k).integers(0, 1 << 63, MINIMA, dtype="u8") * np.uint64(2) + np.uint64(1) for k in range(2))
#: Factor of the first of the two hashes that make the hash of a five-word shingle.
FIRST_OF_TWO = _FACTORS[1]


def minima_of(shingles: np.ndarray) -> np.ndarray:
    """The least value of the shingles' hashes under each of MINIMA orders."""
    least = np.full(MINIMA, (1 << 64) - 1, "u8")
    for at in range(0, len(shingles), 512):
        np.minimum(least, ((shingles[at : at + 512, None] ^ _MASKS) * _FACTORS).min(axis=0), out=least)
    return least


def packed(least: np.ndarray) -> bytes:
    """RING keys of eight bytes, each of a start and the CHAIN minima from it around the ring, then a byte of each minimum."""
    ring = least[:RING]
    keys = np.arange(RING, dtype="u8")
    for k in range(CHAIN):
        keys = (keys ^ np.roll(ring, -k)) * _FACTORS[0]
        keys ^= keys >> np.uint64(29)
    return keys.astype("<u8").tobytes() + (least >> np.uint64(24)).astype("u1").tobytes()


def shingle_set(text: str) -> np.ndarray:
    """Different hashes of the five-word shingles in order, each made of the two shingles of four words in it; a text of
    fewer words is one shingle."""
    found, last, n = [], np.empty(0, "u8"), 0
    for hashes in shingle_hashes(text):
        four = np.concatenate((last, hashes))
        found.append(np.unique(four[:-1] * FIRST_OF_TWO + four[1:]))
        last, n = hashes[-1:], n + len(hashes)
    return last if n == 1 else np.unique(np.concatenate(found)) if found else last


def fingerprint_and_minima(text: str) -> tuple[int, bytes]:
    """The fingerprint and the packed minima of five-word shingles, each made of the two shingles of four words in it.
    A text of fewer words is one shingle; all minima of a text without words are the largest."""
    found, least, last = Majority(), minima_of(np.empty(0, "u8")), np.empty(0, "u8")
    for hashes in shingle_hashes(text):
        found.add(hashes)
        four = np.concatenate((last, hashes))
        np.minimum(least, minima_of(four[:-1] * FIRST_OF_TWO + four[1:]), out=least)
        last = hashes[-1:]
    if found.n == 1:
        least = minima_of(last)
    return found.value(), packed(least)


def fingerprints(docs: DataFrame, *also: str, minima: bool = False) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; ``also`` names columns of longs that are kept, ``minima`` adds
    the packed minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if minima:
                both = [fingerprint_and_minima(t.as_py()) for t in b.column(1)]
                fps, more = np.fromiter((f for f, _ in both), "u8", b.num_rows), [pa.array([m for _, m in both], pa.binary())]
            else:
                fps, more = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), "u8", b.num_rows), []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view("i8")), *b.columns[2:], *more], names)

    names = ["doc_id", "fp", *also, *(["minima"] if minima else [])]
    return id_and_text(docs, *also).mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'minima' else 'long'}" for c in names))


def chain_keys(fp) -> list:
    """Bucket keys of a fingerprint.

    If two fingerprints differ in at most 4 bits, some segment of the ring of 5 starts a chain in which the first j
    segments differ in at most floor(4j / 5) bits: the first is equal and the second has at most one other bit, so one
    half of it is equal too. A key is the first segment and either half of the second; two keys for each start.
    """
    bits = lambda first, width: F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    keys = []
    for i, (first, width) in enumerate(SEGMENTS):
        second, wide = SEGMENTS[(i + 1) % len(SEGMENTS)]
        for half, (a, w) in enumerate(((second, wide // 2), (second + wide // 2, wide - wide // 2))):
            keys.append(F.shiftleft(bits(first, width), 7).bitwiseOR(bits(a, w)).bitwiseOR(F.lit((2 * i + half) << 40).cast("long")))
    return keys


def _mask(segments) -> np.uint64:
    return np.uint64(sum(((1 << w) - 1) << a for a, w in segments))


_CHAINS = [[_mask(SEGMENTS[(i + j) % 5] for j in range(n)) for n in range(1, 6)] for i in range(5)]
#: Ways to deal the 64 bits to five parts; a pair that differs in at most 4 bits is equal in one part of each way. A task
#: divides by the first two, the others divide buckets before they are dealt to tasks.
_WAYS = [[_mask((b, 1) for b in range(64) if deal(b) % (MAX_BITS + 1) == part) for part in range(MAX_BITS + 1)] for deal in (lambda b: b, lambda b: b // 5, lambda b: b // 2, lambda b: b // 3)]


def linked(x: np.ndarray, start) -> np.ndarray:
    """Which differences x keep every chain budget from a start and then the whole Hamming bound."""
    ok = np.ones(len(x), bool)
    for n in range(1, 6):
        mask = np.array([c[n - 1] for c in _CHAINS])[start]
        at = np.flatnonzero(ok)
        ok[at] = np.bitwise_count(x[at] & (mask if np.ndim(mask) == 0 else mask[at])) <= n * MAX_BITS // 5
    return ok


def bucket_edges(fps: np.ndarray, start: int, way: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that join exactly what the links within one bucket join: a search tree over them, never all pairs. A large
    bucket is divided by the parts of one way, then of another; what stays large is searched as it is."""
    out = []
    if way < 2 and len(fps) > DIVIDE:
        for mask in _WAYS[way]:
            order = np.argsort(fps & mask, kind="stable")
            for group in np.split(fps[order], np.flatnonzero(np.diff((fps & mask)[order])) + 1):
                if len(group) > 1:
                    out += bucket_edges(group, start, way + 1)
        return out
    rest = fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            near = linked(rest ^ node, start)
            if near.any():
                new = rest[near]
                out.append((np.full(len(new), node), new))
                queue.extend(new)
                rest = rest[~near]
    return out


def _edges_of_batches(batches: Iterator[tuple[np.ndarray, ...]], n_keys: int, edges: Callable) -> Iterator[pa.RecordBatch]:
    """Edges of buckets whose rows come sorted by the first n_keys columns; one bucket and one batch are held."""

    def out(held):
        found = list(edges(*(np.concatenate(c) for c in zip(*held))))
        a, b = (np.concatenate([f[k] for f in found]).astype("i8") for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    for columns in batches:
        other = np.flatnonzero(reduce(np.logical_or, (c != c[-1] for c in columns[:n_keys])))
        whole = int(other[-1]) + 1 if len(other) else 0
        held.append(tuple(c[:whole] for c in columns))  # the last bucket may go on in the next batch
        if whole:
            yield out(held)
            held = []
        held.append(tuple(c[whole:] for c in columns))
    if held:
        yield out(held)


def _edges_of(start: np.ndarray, keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of whole buckets; rows come sorted by start and key."""
    firsts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (start[1:] != start[:-1]))))
    sizes = np.diff(np.concatenate((firsts, [len(keys)])))
    pairs = firsts[sizes == 2]
    fps = fps.view("u8")
    ok = linked(fps[pairs] ^ fps[pairs + 1], start[pairs].astype("i8"))
    yield fps[pairs][ok], fps[pairs + 1][ok]
    for at, n in zip(firsts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        yield from bucket_edges(fps[at : at + n], int(start[at]))


def buckets(distinct: DataFrame, work: Work, split: int = SPLIT) -> DataFrame:
    """(start, key, fp) of every bucket that a fingerprint of ``distinct`` (fp) is in.

    There are some ten million keys, whatever the corpus, so counting them is cheap. A bucket of more than ``split``
    members, as a large group of near copies makes, is divided by the five parts of a way into buckets of their own,
    and once more by those of another way, before any task gets it whole. Keys of divided buckets are hashes; buckets that
    meet by chance are searched together, which adds no wrong link.
    """
    keys = F.array(*(F.struct(F.lit(k // 2).alias("start"), key.alias("key")) for k, key in enumerate(chain_keys(F.col("fp")))))
    now = distinct.select("fp", F.explode(keys).alias("k")).select("k.start", "k.key", "fp")
    out = []
    for way in _WAYS[2:]:
        large = work.table(now.groupBy("start", "key").agg(F.count("*").alias("n")).filter(F.col("n") > split).select("start", "key"))
        if large.isEmpty():
            break
        out.append(now.join(large, ["start", "key"], "left_anti"))
        parts = F.array(*(F.xxhash64("key", F.lit(k), F.col("fp").bitwiseAND(F.lit(int(mask.astype("i8"))))) for k, mask in enumerate(way)))
        now = work.table(now.join(large, ["start", "key"], "left_semi").select("start", F.explode(parts).alias("key"), "fp"))
    return reduce(DataFrame.unionByName, out, now)


def links(distinct: DataFrame, work: Work, split: int = SPLIT) -> DataFrame:
    """Edges (a, b) between different fingerprints of ``distinct`` (fp) that connect what links connect.

    Buckets stream through sorted; a task holds one bucket and one batch. Fingerprints are distinct, so copies never
    enlarge a bucket; a bucket yields fewer edges than its members, one that a task divides fewer than 25 times as many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _edges_of_batches((tuple(c.to_numpy() for c in b.columns) for b in batches if b.num_rows), 2, _edges_of)

    dealt = buckets(distinct, work, split).repartition("start", "key").sortWithinPartitions("start", "key")
    return dealt.mapInArrow(run, "a long, b long")


def block_edges(ids: np.ndarray, bytes_: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs to look at that join what pairs with at most MAX_DIFFERENT unequal bytes join: a search tree, never all pairs,
    and for texts that are not CLOSE to the text above them the two nearest of their whole tree, which is no larger than
    what a task compares at a time."""
    out = []
    rest = np.arange(len(ids))
    while len(rest) > 1:
        queue, group, far, rest = [rest[0]], [rest[:1]], [], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            different = np.count_nonzero(bytes_[rest] != bytes_[node], axis=1)
            near = different <= MAX_DIFFERENT
            if near.any():
                new = rest[near]
                out.append((np.full(len(new), ids[node]), ids[new]))
                queue.extend(new)
                group.append(new)
                far.extend(new[different[near] > CLOSE])
                rest = rest[~near]
        members = np.concatenate(group)
        held = bytes_[members]
        for k in far if len(members) > 2 else ():
            different = np.where(members == k, MINIMA + 1, np.count_nonzero(held != bytes_[k], axis=1))
            nearest = np.argpartition(different, 1)[:2]
            nearest = nearest[different[nearest] <= MAX_DIFFERENT]
            out.append((np.full(len(nearest), ids[k]), ids[members[nearest]]))
    return out


def _edges_of_keys(keys: np.ndarray, ids: np.ndarray, bytes_: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of whole buckets; rows come sorted by key."""
    firsts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((firsts, [len(keys)])))
    pairs = firsts[sizes == 2]
    pairs = pairs[np.count_nonzero(bytes_[pairs] != bytes_[pairs + 1], axis=1) <= MAX_DIFFERENT]
    yield ids[pairs], ids[pairs + 1]
    for at, n in zip(firsts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        yield from block_edges(ids[at : at + n], bytes_[at : at + n])


def meetings(texts: DataFrame, work: Work, block: int) -> DataFrame:
    """(key, id): the buckets that each of ``texts`` (id, minima) is in, of at most some ``block`` members that a task
    compares at a time. Their rows are in proportion to the texts.

    Two texts meet where they share a chain of the ring of minima. Texts of chains that more than ``block`` share meet by
    GROUPS further groups of minima instead, once for all their chains. Where more than ``block`` share such a group, as
    under one template, it is cut into parts that hold one common part each: texts that are all alike are joined by
    that. A pair that is only like each other would then have to be in one part or another group's.
    """
    chains = texts.select("id", F.explode(F.array(*(F.xxhash64(F.substring("minima", 8 * k + 1, 8)) for k in range(RING)))).alias("key"))
    sizes = work.table(chains.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    few = chains.join(sizes.filter(F.col("n") <= block), "key").select("key", "id")
    many = sizes.filter(F.col("n") > block)
    if many.isEmpty():
        return few
    hot = texts.join(chains.join(many, "key").select("id").distinct(), "id")
    groups = F.array(*(F.xxhash64(F.lit(g), F.substring("minima", 8 * RING + RING + GROUP * g + 1, GROUP)) for g in range(GROUPS)))
    again = work.table(hot.select("id", F.explode(groups).alias("key")))
    sizes = work.table(again.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    met = again.join(sizes, "key").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    places = F.when(part == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part.cast("int")))
    cut = met.select("id", F.when(F.col("parts") == 1, F.array("key")).otherwise(F.transform(places, lambda p: F.xxhash64("key", p))).alias("keys"))
    return few.unionByName(cut.select(F.explode("keys").alias("key"), "id"))


def similar_links(rows: DataFrame, texts: DataFrame, work: Work, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between fingerprints of written ``rows`` (row, fp, minima) whose texts (row, text) have a five-word
    similarity of SIMILAR or more.

    Rows with equal fingerprints and minima are one text. meetings() brings texts together, bytes of their minima choose
    pairs, and each pair is then decided by the whole sets of shingles, so that no other texts are linked. What the choice
    misses is a matter of chance, as with all minima.
    """
    alike = work.table(rows.groupBy("fp", "minima").agg(F.min("row").alias("id")))
    members = work.table(meetings(alike.select("id", "minima"), work, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ((b.column(0).to_numpy(), b.column(1).to_numpy(), flat(b.column(2))[0].reshape(-1, MINIMA)) for b in batches if b.num_rows)
        return _edges_of_batches(columns, 1, _edges_of_keys)

    bytes_ = F.expr(f"substring(minima, {8 * RING + 1}, {MINIMA})").alias("bytes")
    dealt = members.join(alike.select("id", bytes_), "id").select("key", "id", "bytes").repartition("key").sortWithinPartitions("key", "id")
    found = dealt.mapInArrow(run, "a long, b long")
    pairs = work.table(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    work.drop(members)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                sets = pa.array([shingle_set(t.as_py()).astype("<u8").tobytes() for t in some.column(2)], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), sets], ["id", "fp", "shingles"])

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("x", "y"))
            keep = []
            for p, q in zip(x, y):
                p, q = (np.frombuffer(v.as_buffer(), "<u8") for v in (p, q))
                both = len(np.intersect1d(p, q, assume_unique=True)) if min(len(p), len(q)) * SIMILAR[1] >= max(len(p), len(q)) * SIMILAR[0] else 0
                keep.append(both * SIMILAR[1] >= (len(p) + len(q) - both) * SIMILAR[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(alike.select("id", "fp"), "id")
    sets = work.table(asked.join(texts.select(F.col("row").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "id").mapInArrow(hashed, "id long, fp long, shingles binary"))
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("fp").alias("fa"), F.col("shingles").alias("x")), "a")
    whole = left.join(sets.select(F.col("id").alias("b"), F.col("fp").alias("fb"), F.col("shingles").alias("y")), "b")
    return whole.select("fa", "fb", "x", "y").mapInArrow(decided, "a long, b long")


def components(edges: DataFrame, work: Work) -> DataFrame:
    """(node, root): the smallest node of each component, by alternating large-star and small-star contraction.

    Every round is two aggregations with partial sums and two joins. What is joined is written before, so that Spark
    can split the edges of a node with very many neighbours. Rounds end when the edges stay as they are.
    """
    now = work.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    last = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.table(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
        large = both.join(least, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = work.table(large)
        least = work.table(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"))
        joined = large.join(least, F.col("u") == F.col("k"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        now = work.table(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        last = state


def least_of_components(rows: DataFrame, order: Column, work: Work, more: DataFrame | None = None) -> DataFrame:
    """(k, least): for each fingerprint of written ``rows`` (fp), the least ``order`` that links reach, those of ``more``
    (a, b) included.

    A node is the least order of a fingerprint's rows, then the fingerprint, so that a component's root already is its
    answer and nothing is gathered by root.
    """
    nodes = work.table(rows.groupBy("fp").agg(F.min(order).alias("least")))
    node = F.struct("least", "fp")
    found = links(nodes.select("fp"), work)
    found = work.table(found if more is None else found.unionByName(more).distinct())
    for end in ("a", "b"):
        named = nodes.select(F.col("fp").alias("f"), node.alias("node"))
        found = found.join(named, F.col(end) == F.col("f")).drop(end, "f").withColumnRenamed("node", end)
    roots = components(found, work).select(F.col("node.fp").alias("f"), F.col("root.least").alias("reached"))
    # written, so that Spark can split the rows of one fingerprint in the join that follows
    return work.table(nodes.join(roots, F.col("fp") == F.col("f"), "left").select(F.col("fp").alias("k"), F.coalesce("reached", "least").alias("least")))


def simhash_components(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """doc_id, fingerprint in hex and component_id, the smallest doc_id that links reach.

    Equal fingerprints are one node, whatever their number. Documents without words have fingerprint zero. Null texts
    count as empty; null doc_ids are never a component's id unless it has no other. Rows may repeat. An empty table
    gives an empty result; other columns are ignored.
    """
    with Work(docs.sparkSession) as work:
        rows = work.table(fingerprints(docs))
        classes = least_of_components(rows, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id"), work)
        found = rows.join(classes, F.col("fp") == F.col("k"))
        return materialize(found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row of ``docs``, with all its columns, for each component of fingerprints' and of similar texts' links.

    The row with the component's smallest doc_id stays, one without a doc_id only if there is no other; of rows that
    share that doc_id any one. Rows get a number when they are written once; they are chosen and removed by it. Null and
    empty texts have fingerprint zero, so one of them stays. An empty table stays empty.
    """
    row, gone = unused(docs, "__row"), unused(docs, "__gone")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    with Work(docs.sparkSession) as work:
        rows = work.table(fingerprints(numbered, row, minima=True).withColumnRenamed(row, "row"))
        similar = similar_links(rows, numbered.select(F.col(row).alias("row"), "text"), work, block)
        classes = least_of_components(rows, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"), work, similar)
        others = rows.join(classes, F.col("fp") == F.col("k")).filter(F.col("row") != F.col("least.row")).select(F.col("row").alias(gone))
        others = materialize(others)
    return numbered.join(others, F.col(row) == F.col(gone), "left_anti").drop(row)
