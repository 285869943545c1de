"""Phrase collocations by hierarchical pair naming: a k-gram is the pair of the (k-1)-grams that it begins and ends with.

Texts are kept in chunks of word numbers that only their chunk knows. At each level a chunk counts the different pairs of
neighbours that are frequent (k-1)-grams, one shuffle of these counts gives every frequent pair one id for all chunks, and
the ids go back to the chunks. Parts of a frequent phrase are frequent, so nothing is lost. The two ids of a pair point to
the phrases that it begins and ends with: cuts and longer phrases are found through them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, WordScan, byte_set, materialize, parcels

LONGEST, LEAST, SHARE, SCALE, TOP = 4, 30, 80, 2_000_000, 2000
PIECE_ENDS, BLANKS = ".,;:!?\n\x0b\x0c\r", " \t"
_LOWER = bytes(range(256)).lower()
_ENDS, _APART = byte_set(PIECE_ENDS), byte_set(PIECE_ENDS + BLANKS)
#: Bytes of text that are read together and words of a chunk (both change no result); a pair's number within its chunk has BITS bits.
TOGETHER, CHUNK, BITS = 12 << 20, 1 << 21, 22
#: Rounds in which the phrases of each length are counted, each a part of them by hash, so that only a part of what is
#: shuffled is on disk at a time: pairs of words are by far the most.
PARTS = (2, 4, 2, 1)
#: Mark of a word that ends its piece.
_LAST = 1 << 30
_WRITTEN = "tag long, lang string, word string, n long, chunk long, own int, codes binary"


def chunks_of(texts: list[bytes], langs: list[str], size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, pa.Array, pa.Array, np.ndarray]]:
    """(own, codes, lang, word, n): codes number the words of a chunk by language and word. The first ``own`` words are
    the chunk's own, which n counts; up to LONGEST - 1 words after them only complete phrases that begin there."""
    found = WordScan([t.translate(_LOWER) for t in texts], _APART)
    words = found.values()
    piece = np.searchsorted(np.flatnonzero(_ENDS[found.data]), found.starts)
    last = np.append(piece[1:] != piece[:-1], True)
    names = pa.array(langs, pa.string()).dictionary_encode()
    lang = names.indices.to_numpy()[found.doc].astype("i8")
    for s in range(0, len(words), size):
        e = min(s + size, len(words))
        held = slice(s, min(e + LONGEST - 1, len(words)))
        coded = words[held].dictionary_encode()
        many = max(1, len(coded.dictionary))
        keys, codes = np.unique(lang[held] * many + coded.indices.to_numpy(), return_inverse=True)
        n = np.bincount(codes[: e - s], minlength=len(keys))
        yield e - s, np.where(last[held], codes | _LAST, codes).astype("<i4"), names.dictionary.take(pa.array(keys // many)), coded.dictionary.take(pa.array(keys % many)).cast(pa.large_string()).cast(pa.string()), n


def _writer(together: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each chunk a row for each of its words and a row with its codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tag", "lang", "word", "n", "chunk", "own", "codes"]
        chunk = TaskContext.get().partitionId() << 17
        for table in parcels(batches, together):
            texts, langs = (table.column(c).to_pylist() for c in ("text", "lang"))
            for own, codes, lang, word, n in chunks_of([t.encode() for t in texts], langs, size):
                for at in range(0, len(n), 1 << 16):
                    part = slice(at, min(at + (1 << 16), len(n)))
                    tags = pa.array((chunk << BITS) + np.arange(part.start, part.stop))
                    none = [pa.nulls(len(tags), t) for t in (pa.int64(), pa.int32(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([tags, lang[part], word[part], pa.array(n[part]), *none], names)
                none = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*none, pa.array([chunk]), pa.array([own], pa.int32()), pa.array([codes.tobytes()], pa.binary())], names)
                chunk += 1

    return run


def pairs_of(codes: np.ndarray, own: int, names: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, n) of a chunk's different pairs, in the order of their numbers, one level above ``names``.

    ``names`` has for each level below (numbers, ids) of the chunk's frequent phrases, by number. n counts the pairs that begin at
    the chunk's own words. The levels between are made anew from the codes, so that codes are written only once.
    """
    last, numbers = codes[:-1] >= _LAST, codes & (_LAST - 1)
    found, at = numbers, np.arange(len(codes))
    for level, (of, ids) in enumerate(names):
        known = np.full(int(found.max(initial=-1)) + 1, -1, "i8")
        known[of] = np.arange(len(of))
        named = np.full(len(codes), -1, "i8")
        named[at] = known[found]
        both = (named[:-1] >= 0) & (named[1:] >= 0)
        if not level:
            both &= ~last
        at = np.flatnonzero(both)
        keys, found = np.unique(named[at] * max(1, len(of)) + named[at + 1], return_inverse=True)
    n = np.bincount(found[at < own], minlength=len(keys))
    return ids[keys // max(1, len(of))], ids[keys % max(1, len(of))], n


def _paired(level: int, part: int, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Pairs of a chunk from its codes and the names of all levels below ``level``: those of one part of all pairs."""

    def run(chunk: pa.Table, names: pa.Table) -> pa.Table:
        level_of, number, gid = (names.column(c).to_numpy() for c in ("level", "number", "gid"))
        order = np.argsort(number, kind="stable")  # rows come in any order, and pairs are numbered by that of the names
        known = [(number[at], gid[at]) for at in (order[level_of[order] == k] for k in range(1, level))]
        left = right = n = tags = np.zeros(0, "i8")
        for row in chunk.to_pylist():
            left, right, n = pairs_of(np.frombuffer(row["codes"], "<i4"), row["own"], known)
            tags = (row["chunk"] << BITS) + np.arange(len(n))
        if parts > 1:
            mine = ((left * 31 + right).astype("u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts) == part
            left, right, n, tags = left[mine], right[mine], n[mine], tags[mine]
        return pa.table({"tag": tags, "left": left, "right": right, "n": n})

    return run


def _named(rows: DataFrame, *key: str, least: int) -> DataFrame:
    """Rows of ``key`` whose counts add up to ``least``, with that sum f and gid, an id of the key: its least tag.

    A chunk has one row for a key at most, so that no key has more rows than there are chunks.
    """
    whole = Window.partitionBy(*key)
    return rows.withColumns({"f": F.sum("n").over(whole), "gid": F.min("tag").over(whole)}).filter(F.col("f") >= least).drop("n")


def frequent_phrases(docs: DataFrame, work: Work, least: int = LEAST, together: int = TOGETHER, size: int = CHUNK) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and for each length from 1 to LONGEST a table of the phrases that occur ``least`` times:
    gid, f, then lang and word, or left and right, the ids of the phrases that it begins and ends with."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = work.table(docs.select(text, F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).mapInArrow(_writer(together, size), _WRITTEN))
    words = rows.filter("tag is not null").select("tag", "lang", "word", "n")
    totals = work.table(words.groupBy("lang").agg(F.sum("n").alias("n")))
    of_part = F.pmod(F.xxhash64("lang", "word"), F.lit(PARTS[0]))
    out = [reduce(DataFrame.unionByName, [work.table(_named(words.filter(of_part == part), "lang", "word", least=least)) for part in range(PARTS[0])])]
    codes = work.bucketed(rows.filter("chunk is not null").select("chunk", "own", "codes"), "chunk")
    work.drop(rows)
    number = F.col("tag").bitwiseAND(F.lit((1 << BITS) - 1)).alias("number")
    for level in range(2, LONGEST + 1):
        # of all but the longest phrases it is enough to know which ones of the chunk are frequent
        ids = [F.col("gid") if k == level - 1 else F.lit(0).cast("long").alias("gid") for k in range(1, level)]
        names = reduce(DataFrame.unionByName, (t.select(F.shiftright("tag", BITS).alias("chunk"), F.lit(k).alias("level"), number, ids[k - 1]) for k, t in enumerate(out, 1)))
        parts = PARTS[level - 1]
        named = []
        for part in range(parts):
            pairs = codes.groupBy("chunk").cogroup(names.groupBy("chunk")).applyInArrow(_paired(level, part, parts), "tag long, left long, right long, n long")
            named.append(work.table(_named(pairs, "left", "right", least=least)))
        out.append(reduce(DataFrame.unionByName, named))
    return totals, [t.filter("tag = gid").drop("tag") for t in out]


def _spelled(found: list[DataFrame], work: Work) -> list[DataFrame]:
    """Phrases of each length with lang, phrase, its last word, and the counts ``heads`` and ``tails`` of what it begins
    and ends with, by length. Each level takes them from the two phrases that its ids point to."""
    none = F.array().cast("array<bigint>")
    out = [work.table(found[0].select("gid", "f", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), none.alias("heads"), none.alias("tails")))]
    for pairs in found[1:]:
        a = out[-1].select(F.col("gid").alias("left"), "lang", F.col("phrase").alias("begin"), F.concat("heads", F.array("f")).alias("heads"))
        b = out[-1].select(F.col("gid").alias("right"), "last", F.concat("tails", F.array("f")).alias("tails"))
        whole = F.concat_ws(" ", "begin", "last").alias("phrase")
        half = work.table(pairs.join(a, "left"))  # written, so that Spark can split a phrase that begins very many
        out.append(work.table(half.join(b, "right").select("gid", "f", "lang", whole, "last", "heads", "tails", "left", "right")))
    return out


def _score(a: Column, both: Column, scale: int) -> Column:
    """floor(scale * a / both) in exact decimals."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(F.lit(scale)) * wide(a), wide(both))


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, scale: int = SCALE, top: int = TOP, together: int = TOGETHER, size: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of two to four words in each language.

    A phrase counts all its occurrences within pieces of text; a null language is ``und``, null texts are empty, rows that
    repeat count again, and other columns are ignored. The cut with the lowest score counts, the earliest of equal ones.
    A phrase inside a longer one that has ``share`` per cent of its count is dropped; it is enough to look one word
    further, as every phrase between the two is as frequent as the longer one at least. Ties in score go by count, then
    by phrase. An empty table, or one without frequent phrases, gives an empty result.

    Ids are found by a window over pairs, one row for each pair and chunk; nothing is gathered on the driver.
    """
    with Work(docs.sparkSession, drop_shuffles=True) as work:
        totals, found = frequent_phrases(docs, work, least, together, size)
        levels = _spelled(found, work)
        kept = []
        for k in range(2, LONGEST + 1):
            rows = levels[k - 1]
            if k < LONGEST:
                longer = levels[k]
                over = longer.select(F.explode(F.array("left", "right")).alias("gid"), F.col("f").alias("most")).groupBy("gid").agg(F.max("most").alias("most"))
                wide = lambda c: F.col(c).cast("decimal(19,0)")
                rows = rows.join(over, "gid", "left").filter(F.col("most").isNull() | (wide("most") * 100 < wide("f") * share))
            cuts = [F.struct(_score(F.col("f"), F.col("heads")[j] + F.col("tails")[k - 2 - j], scale).alias("score"), F.lit(j).alias("cut"), F.col("heads")[j].alias("l"), F.col("tails")[k - 2 - j].alias("r")) for j in range(k - 1)]
            lowest = F.array_min(F.array(*cuts))
            kept.append(rows.select("gid", "lang", "phrase", F.col("f").alias("a"), lowest.alias("cut")))
        phrases = reduce(DataFrame.unionByName, kept).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"), "gid")
        order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
        parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        part = F.pmod(F.xxhash64("gid"), F.lit(parts))
        first = phrases.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("place") <= top).drop("place", "gid")
        ranked = work.table(first).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
        return materialize(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def sql(least: int = LEAST, share: int = SHARE, scale: int = SCALE, top: int = TOP) -> str:
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k - 1}], ' '))) AS phrase FROM w WHERE len(ws) >= {k}" for k in range(1, LONGEST + 1))
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM ({grams}) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= {least}),
cut AS (SELECT *, unnest(range(1, k)) AS j FROM c),
s AS (SELECT cut.lang, cut.k, cut.phrase, a, j, x.f AS l, y.f AS r, {scale}::HUGEINT * a // (x.f + y.f) AS score FROM cut
  JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(ws[1:j], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(ws[j + 1:cut.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, a, k, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))))) AS phrase FROM c WHERE k > 2),
longer AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < {share} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= {top}
"""
