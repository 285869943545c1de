"""Repeated 200-byte strings by sorting suffixes: multikey quicksort to a shallow depth, blind tries below it.

Not every suffix is sorted. Each text gives anchors: the positions whose hash of the next 80 bytes is the least among
the windows of 121 positions, so every 200-byte string holds an anchor at a place that its bytes alone decide. Equal
strings hold equal anchors; only anchors that occur twice are followed. Of an anchor's occurrences, the suffixes that
start there and the reversed prefixes that end there are sorted; a string that starts d bytes before an anchor is
repeated if another occurrence shares d bytes to the left and 200 - d to the right, which both orders' common prefixes
tell for all occurrences at once. Occurrences whose whole surroundings are equal are thinned to two where they are
found, and an anchor that many different surroundings share is divided by longer common strings until a task can sort
each group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, id_and_text, materialize

LENGTH, GRAM = 200, 80
#: Bytes that multikey quicksort looks at before a blind trie orders what is still equal.
SHALLOW = 12
#: Contexts of one anchor that one task sorts; a group of more is divided first.
HOT = 32768
#: Bytes of text that are hashed together, and occurrences that are sorted together.
SLICE, CHUNK = 1 << 20, 8192
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of ``width`` values."""
    span = 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return pick(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchors of texts that lie one after the other in ``data``; a text ends where the next
    starts. Texts shorter than ``length`` have none."""
    n, width = len(data), length - gram + 1
    if n < length:
        return np.empty(0, "i8"), np.empty(0, "u8")
    with np.errstate(over="ignore"):
        powers = np.full(n, _BASE)
        powers[0] = 1
        powers = np.cumprod(powers)
        sums = np.concatenate((np.zeros(1, "u8"), np.cumsum((data.astype("u8") + np.uint64(1)) * powers)))
        back = np.full(n, _INVERSE)
        back[0] = 1
        h = (sums[gram:] - sums[:-gram]) * np.cumprod(back)[: n - gram + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    at = np.arange(len(h))
    inside = at + gram <= end[: len(h)]
    h[~inside] = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = _slide(h, width, np.minimum)
    least[np.arange(len(least)) + length > end[: len(least)]] = 0
    pad = np.zeros(width - 1, "u8")
    chosen = np.flatnonzero(inside & (_slide(np.concatenate((pad, least, pad)), width, np.maximum) == h))
    return chosen, h[chosen]


# --- sorting -------------------------------------------------------------------------------------------------------


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, which is at least ``start``."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return start + (8 * (n - start) - x.bit_length()) // 8


def _at(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


def blind_trie(strings: list[bytes], some: list[int], depth: int) -> list[tuple[int, int]]:
    """(string, common prefix with the one before) in order, of different strings that share ``depth`` bytes.

    A node is [depth, children by byte]; a leaf is a string's number. Going down looks only at the bytes where strings
    branch; the leaf that is met is compared once, which tells where the new branch belongs.
    """
    root: list | int = some[0]
    for k in some[1:]:
        s, node = strings[k], root
        while isinstance(node, list):
            node = node[1].get(_at(s, node[0])) if _at(s, node[0]) in node[1] else next(iter(node[1].values()))
        same = common(s, strings[node], depth)
        leaf, above, node = node, None, root
        while isinstance(node, list) and node[0] < same:
            above, node = node, node[1][_at(s, node[0])]
        if isinstance(node, list) and node[0] == same:
            node[1][_at(s, same)] = k
            continue
        branch = [same, {_at(strings[leaf], same): node, _at(s, same): k}]
        if above is None:
            root = branch
        else:
            above[1][_at(s, above[0])] = branch
    out: list[tuple[int, int]] = []
    stack: list[tuple[list | int, int]] = [(root, depth)]
    while stack:
        node, prefix = stack.pop()
        if isinstance(node, list):
            children = sorted(node[1].items())
            stack.extend((child, node[0]) for _, child in reversed(children[1:]))
            stack.append((children[0][1], prefix))
        else:
            out.append((node, prefix))
    return out


def deep_shallow(strings: list[bytes], some: list[int], depth: int, shallow: int = SHALLOW) -> list[tuple[int, int]]:
    """(string, common prefix with the one before) in order, of different strings that share ``depth`` bytes."""
    limit, out = depth + shallow, []
    stack = [(some, depth, depth)]  # strings, bytes they share, common prefix with what comes before
    while stack:
        part, d, prefix = stack.pop()
        if len(part) == 1:
            out.append((part[0], prefix))
        elif d >= limit:
            ordered = blind_trie(strings, part, d)
            out.append((ordered[0][0], prefix))
            out.extend(ordered[1:])
        else:
            pivot = sorted(_at(strings[part[k]], d) for k in (0, len(part) // 2, -1))[1]
            below = [k for k in part if _at(strings[k], d) < pivot]
            equal = [k for k in part if _at(strings[k], d) == pivot]
            above = [k for k in part if _at(strings[k], d) > pivot]
            todo, p = [], prefix
            for group, shared in ((below, d), (equal, d + 1), (above, d)):
                if group:
                    todo.append((group, shared, p))
                    p = d
            stack.extend(reversed(todo))
    return out


def repeated(groups: np.ndarray, weights: np.ndarray, lefts: list[bytes], rights: list[bytes], low: int, high: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each context of an anchor, the least and the greatest d from ``low`` to ``high`` whose string, from d bytes
    before the anchor, occurs at another occurrence too; least > greatest if there is none. ``weights`` are the
    occurrences of each context. Contexts of an anchor stand together; ``lefts`` are reversed."""
    first: dict[tuple[int, bytes, bytes], int] = {}
    context = np.fromiter((first.setdefault(k, len(first)) for k in zip(groups.tolist(), lefts, rights)), "i8", len(groups))
    weight = np.bincount(context, weights=weights, minlength=len(first))
    keys = list(first)
    left_of, right_of = [k[1] for k in keys], [k[2] for k in keys]
    member = np.array([k[0] for k in keys])
    edges = np.flatnonzero(np.concatenate(([True], member[1:] != member[:-1], [True])))
    rank, prefix = np.zeros((2, len(keys)), "i8"), np.zeros((2, len(keys)), "i8")
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        some = list(range(a, b))
        for side, strings in ((0, left_of), (1, right_of)):
            distinct: dict[bytes, list[int]] = {}
            for k in some:
                distinct.setdefault(strings[k], []).append(k)
            heads = [v[0] for v in distinct.values()]
            place = a
            for k, p in deep_shallow(strings, heads, 0) if len(heads) > 1 else [(heads[0], 0)]:
                for j in distinct[strings[k]]:
                    rank[side, j], prefix[side, place] = place, p
                    p, place = length + 1, place + 1  # equal contexts share everything, whatever their length
            prefix[side, a] = -1
    size = [np.array([len(s) for s in strings], "i8") for strings in (left_of, right_of)]
    least, greatest = np.full(len(keys), high + 1, "i8"), np.full(len(keys), -1, "i8")
    for d in range(low, high + 1):
        classes = [np.cumsum(prefix[side] < depth)[rank[side]] for side, depth in ((0, d), (1, length - d))]
        _, pair = np.unique(classes[0] * (len(keys) + 1) + classes[1], return_inverse=True)
        hit = (np.bincount(pair, weights=weight)[pair] > 1) & (size[0] >= d) & (size[1] >= length - d)
        least[hit] = np.minimum(least[hit], d)
        greatest[hit] = d
    return least[context], greatest[context]


def joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    """The spans as maximal runs, in order."""
    out: list[list[int]] = []
    for a, e in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return out


# --- over a corpus -------------------------------------------------------------------------------------------------


def _key(text) -> object:
    return F.substring(F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)), 1, 16)


def _slices(texts: list[memoryview], length: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in slices of about SLICE bytes, several texts or a part of one: (numbers of the texts, where each begins in
    the bytes, where it begins in its text, the bytes). Each string of ``length`` bytes lies in a slice."""
    at = 0
    while at < len(texts):
        n, size = 0, 0
        while at + n < len(texts) and (not n or size + len(texts[at + n]) <= SLICE):
            size += len(texts[at + n])
            n += 1
        if n == 1:
            for a in range(0, max(1, size - length + 1), SLICE):
                yield [at], np.zeros(1, "i8"), np.array([a]), np.frombuffer(texts[at][a : a + SLICE + length - 1], "u1")
        else:
            part = texts[at : at + n]
            starts = np.concatenate(([0], np.cumsum([len(p) for p in part])))[:-1].astype("i8")
            yield list(range(at, at + n)), starts, np.zeros(n, "i8"), np.frombuffer(b"".join(part), "u1")
        at += n


def _thinned(texts: list[memoryview], text: np.ndarray, pos: np.ndarray, h: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Which occurrences of a slice go on, and the spans (text, start, end) of the others.

    Of occurrences that are equal in all that can matter, ``length - gram`` bytes before the anchor and ``length`` from
    it, two go on: they stand for the rest, whose strings occur often enough already. So a run of one byte, a text that
    repeats itself and a passage that many texts share cost as much as two of them.
    """
    _, group, count = np.unique(h, return_inverse=True, return_counts=True)
    go_on, reach = np.ones(len(h), bool), length - gram
    met: dict[tuple[int, bytes], int] = {}
    spans = []
    for k in np.flatnonzero(count[group] > 2).tolist():
        t, p = int(text[k]), int(pos[k])
        a = max(0, p - reach)
        context = (p - a, bytes(texts[t][a : p + length]))
        n = met[context] = met.get(context, 0) + 1
        if n > 2:
            go_on[k] = False
            if len(context[1]) >= length:
                spans.append((t, a, a + len(context[1])))
    return go_on, spans


def _anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, key, pos, stop): anchors that may occur again, without a stop, and spans from pos to stop that are known to
    be repeated, without h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).cast(pa.large_binary())
            whole = [memoryview(x.as_buffer()) for x in raw]
            tail = np.empty(0, "i8")  # anchors of the slice before that this one meets too
            for numbers, starts, skipped, data in _slices(whole, length):
                where, h = anchors(data, starts, length, gram)
                part = np.searchsorted(starts, where, side="right") - 1
                pos, text = where - starts[part] + skipped[part], np.array(numbers)[part]
                if skipped[0]:
                    new = ~np.isin(pos, tail)
                    pos, text, h = pos[new], text[new], h[new]
                tail = pos[pos >= skipped[0] + SLICE] if len(numbers) == 1 else tail
                go_on, spans = _thinned(whole, text, pos, h, length, gram)
                by_text: dict[int, list[tuple[int, int]]] = {}
                for t, a, e in spans:
                    by_text.setdefault(t, []).append((a, e))
                known = [(t, a, e) for t, some in by_text.items() for a, e in joined(some)]
                text, pos, h = text[go_on], pos[go_on], h[go_on]
                n = len(known)
                columns = [
                    pa.array(np.concatenate((h.view("i8"), np.zeros(n, "i8"))), mask=np.arange(len(h) + n) >= len(h)),
                    b.column(0).take(pa.array(np.concatenate((text, np.array([x[0] for x in known], "i8"))))),
                    pa.array(np.concatenate((pos, np.array([x[1] for x in known], "i8")))),
                    pa.array(np.concatenate((np.zeros(len(h), "i8"), np.array([x[2] for x in known], "i8"))), mask=np.arange(len(h) + n) < len(h)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["h", "key", "pos", "stop"])

    return texts.filter(F.octet_length("text") >= length).select("key", "text").mapInArrow(run, "h long, key binary, pos long, stop long")


def _contexts(placed: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, key, pos, at, context) of the wanted occurrences of each text: the bytes around an anchor, ``at`` of them
    before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = length - gram
        for b in batches:
            raw = b.column(1).cast(pa.large_binary())
            for r in range(b.num_rows):
                text, found, key = memoryview(raw[r].as_buffer()), b.column(2)[r].values, b.column(0)[r].as_py()
                for some in (found.slice(k, CHUNK) for k in range(0, len(found), CHUNK)):
                    pos = some.field("pos").to_pylist()
                    at = [min(p, reach) for p in pos]
                    context = [bytes(text[p - a : p + length]) for p, a in zip(pos, at)]
                    yield pa.RecordBatch.from_arrays([some.field("h"), pa.array([key] * len(pos), pa.binary()), some.field("pos"), pa.array(at, pa.int32()), pa.array(context, pa.binary())], ["h", "key", "pos", "at", "context"])

    return placed.select("key", "text", "found").mapInArrow(run, "h long, key binary, pos long, at int, context binary")


def _by_group(batches: Iterator[pa.RecordBatch], same: tuple[int, ...], enough: int) -> Iterator[pa.Table]:
    """Rows in tables of ``enough`` or more, with all rows of a group, by the columns ``same``, in one table; they come
    sorted by group."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < enough:
            continue
        t = pa.Table.from_batches(held)
        last = [t.column(c)[t.num_rows - 1].as_py() for c in same]
        whole = t.num_rows - 1
        while whole and [t.column(c)[whole - 1].as_py() for c in same] == last:
            whole -= 1
        if whole:
            yield t.slice(0, whole)
            held = t.slice(whole).to_batches()
            rows = t.num_rows - whole
    if rows:
        yield pa.Table.from_batches(held)


def _sorted_spans(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, a, b) of the bytes that repeated strings around each occurrence cover; anchors have a bounded number of
    occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches, (0,), CHUNK):
            at, context = t.column("at").to_pylist(), t.column("context").to_pylist()
            least, greatest = repeated(t.column("h").to_numpy(), np.ones(len(at)), [c[:k][::-1] for c, k in zip(context, at)], [c[k:] for c, k in zip(context, at)], 0, length - gram, length)
            hit = np.flatnonzero(least <= greatest)
            pos = t.column("pos").to_numpy()[hit]
            key = t.column("key").take(pa.array(hit)).combine_chunks()
            key = key.combine_chunks() if isinstance(key, pa.ChunkedArray) else key
            yield pa.RecordBatch.from_arrays([key, pa.array(pos - greatest[hit]), pa.array(pos - least[hit] + length)], ["key", "a", "b"])

    # h comes sorted, so that an anchor's occurrences stand together
    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(run, "key binary, a long, b long")


def _shared_spans(contexts: DataFrame, work: Work, length: int, gram: int, hot: int) -> DataFrame:
    """The same for anchors with any number of occurrences.

    A group is the occurrences of an anchor for a range of d, at first for all. Strings with d from low to high share
    the ``core``: low bytes before the anchor and length - high from it. No byte beyond high before the anchor and
    length - low from it matters, so occurrences that are equal there are one context with a weight, summed in part
    before the shuffle. A group of at most ``hot`` contexts is sorted by a task; a larger one is divided: each half of
    its range has a longer core, and groups are what shares the core. A range of one d leaves one context, so that
    dividing ends whatever the corpus holds.
    """
    reach = length - gram
    now = work.table(contexts.select("key", "pos", "at", "context", F.lit(0).alias("low"), F.lit(reach).alias("high")))
    out = None
    while True:
        before = F.least("at", "high")  # of the bytes that matter, those before the anchor
        cut = lambda first, n: F.substring(F.col("context"), first, n)
        inside = now.filter((F.col("at") >= F.col("low")) & (F.octet_length("context") - F.col("at") >= length - F.col("high")))
        trimmed = cut(F.col("at") - before + 1, before + length - F.col("low"))
        core = F.unhex(F.sha2(cut(F.col("at") - F.col("low") + 1, F.col("low") + length - F.col("high")), 256))
        inside = inside.select("key", "pos", "at", "context", "low", "high", before.alias("before"), trimmed.alias("trimmed"), core.alias("core"))
        classes = work.table(inside.groupBy("low", "high", "core", "before", "trimmed").agg(F.count("*").alias("n")))
        groups = work.table(classes.groupBy("low", "high", "core").agg(F.count("*").alias("contexts"), F.sum("n").alias("all")).filter("all > 1"))
        group = ["low", "high", "core"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _by_group(batches, (0, 1, 2), CHUNK):
                ranges = t.select(["low", "high"]).to_pandas()
                cores = t.column("core").to_pylist()
                for (low, high), rows in ranges.groupby(["low", "high"], sort=False).groups.items():
                    some = t.take(pa.array(rows.to_numpy()))
                    number: dict[bytes, int] = {}
                    member = np.array([number.setdefault(cores[r], len(number)) for r in rows])
                    context, at = some.column("trimmed").to_pylist(), some.column("before").to_pylist()
                    least, greatest = repeated(member, some.column("n").to_numpy(), [c[:k][::-1] for c, k in zip(context, at)], [c[k:] for c, k in zip(context, at)], low, high, length)
                    some = some.append_column("least", pa.array(least)).append_column("greatest", pa.array(greatest)).filter(pa.array(least <= greatest))
                    yield from some.select(["low", "high", "core", "before", "trimmed", "least", "greatest"]).to_batches()

        small = classes.join(groups.filter(F.col("contexts") <= hot).select(*group), group).select(*group, "before", "trimmed", "n")
        solved = work.table(small.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "low int, high int, core binary, before int, trimmed binary, least long, greatest long"))
        spans = inside.join(solved, [*group, "before", "trimmed"]).select("key", (F.col("pos") - F.col("greatest")).alias("a"), (F.col("pos") - F.col("least") + length).alias("b"))
        spans = work.table(spans)
        out = spans if out is None else out.unionByName(spans)
        large = groups.filter(F.col("contexts") > hot).select(*group)
        if large.isEmpty():
            return out
        middle = F.expr("cast((low + high) div 2 as int)")
        halves = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high")))
        done, now = now, work.table(inside.join(large, group, "left_semi").select("key", "pos", "at", "context", F.explode(halves).alias("d")).select("key", "pos", "at", "context", "d.low", "d.high"))
        work.drop(done)


def _cut(texts: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans) of every different text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
        for b in batches:
            out: list[tuple] = []
            raw = b.column(1).cast(pa.large_binary())
            for r, (key, copies, found) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 2, 3)))):
                text = memoryview(raw[r].as_buffer())
                if copies > 1 and len(text) >= length:
                    merged = [[0, len(text)]]
                else:
                    merged = joined([(f["a"], f["b"]) for f in found or ()])
                kept, at = hashlib.sha256(), 0
                for a, e in merged:
                    kept.update(text[at:a])
                    at = e
                kept.update(text[at:])
                out.append((key, len(text), sum(e - a for a, e in merged), len(merged), kept.hexdigest(), merged))
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    per_text = spans.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("found"))
    joined_texts = texts.join(per_text, "key", "left").select("key", "text", "copies", "found")
    return joined_texts.mapInArrow(run, "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans ([start, end) in bytes) of every document.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or another.
    Equal texts are one text with a number of copies, so a large group of copies costs as much as one of them. Null
    texts count as empty; ids may be null or repeat, a row in gives a row out. An empty table gives an empty result;
    other columns are ignored. ``hot`` is the most contexts of one anchor that a task sorts.
    """
    with Work(docs.sparkSession) as work:
        rows = id_and_text(docs).withColumn("key", _key(F.col("text")))
        texts = work.bucketed(rows.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "key")
        found = work.table(_anchor_rows(texts, length, gram).withColumn("known", F.col("h").isNull()), by="known")
        known = found.filter("known").select("key", F.col("pos").alias("a"), F.col("stop").alias("b"))
        found = found.filter("not known").select("h", "key", "pos")
        often = work.table(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")).withColumnRenamed("h", "again")

        # both sides grow with the corpus, so neither is broadcast
        placed = found.join(often.hint("merge"), F.col("h") == F.col("again"))
        places = work.table(placed.groupBy("key").agg(F.collect_list(F.struct("h", "pos", (F.col("n") > hot).alias("many"))).alias("found")))

        def contexts(many: bool) -> DataFrame:
            some = places.withColumn("found", F.filter("found", lambda x: x["many"] == many)).filter(F.size("found") > 0)
            return _contexts(texts.join(some, "key"), length, gram)

        spans = known.unionByName(_sorted_spans(contexts(False), length, gram))
        if not often.filter(F.col("n") > hot).isEmpty():
            spans = spans.unionByName(_shared_spans(contexts(True), work, length, gram, hot))
        cut = _cut(texts, spans, length).withColumnRenamed("key", "k")
        result = rows.select("doc_id", "key").join(cut, F.col("key") == F.col("k"))
        return materialize(result.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"))
