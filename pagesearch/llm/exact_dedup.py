"""Exact deduplication by a tree of merges over sorted digest runs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, binary_column, flat, id_and_text, materialize

#: Partners of a round, and entries of one piece of a run.
FAN_IN, PIECE = 8, 4096
#: An entry of a run: what a text is known by (SHA-256, XXH64 and bytes of the normalised text), the row that stays so
#: far, and the number of rows.
ENTRY = np.dtype([("digest", "S32"), ("check", ">u8"), ("n_bare", ">u8"), ("shorter", "<i8"), ("no_id", "u1"), ("id", "<i8"), ("row", "<i8"), ("n", "<i8")])
_TEXT, _BEST = ("digest", "check", "n_bare"), ("shorter", "no_id", "id", "row")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_chars of the original text, and length, SHA-256 and XXH64 of the text without ASCII white space.

    ``row`` numbers the rows; it is fixed once the frame is written.
    """
    bare = id_and_text(docs).select("doc_id", F.char_length("text").alias("n_chars"), F.regexp_replace("text", r"[\x20\x09-\x0D]+", "").alias("bare"))
    digest = F.unhex(F.sha2(F.col("bare").cast("binary"), 256))
    return bare.select("doc_id", F.monotonically_increasing_id().alias("row"), "n_chars", F.octet_length("bare").alias("n_bare"), digest.alias("digest"), F.xxhash64("bare").alias("check"))


def merged(entries: np.ndarray) -> np.ndarray:
    """One entry for each text of ``entries``, in order: the best row and the sum of the counts.

    Texts are the same only if digest, second hash and length all are; entries that share the digest alone stay apart.
    """
    if len(entries) < 2:
        return entries
    order = np.lexsort([entries[c] for c in reversed(_TEXT + _BEST)])
    entries = entries[order]
    first = np.ones(len(entries), bool)
    first[1:] = False
    for c in _TEXT:
        first[1:] |= entries[c][1:] != entries[c][:-1]
    at = np.flatnonzero(first)
    out = entries[at].copy()
    out["n"] = np.add.reduceat(entries["n"], at)
    return out


def merge_pieces(pieces: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Merge any number of sorted runs into one, given their pieces by ascending first digest.

    When a piece comes up, all that is left of smaller digests is whole: its run's earlier pieces end before it and the
    later pieces of the others begin after it. What is held is at most one open piece of each run.
    """
    held: list[np.ndarray] = []
    for piece in pieces:
        low = piece["digest"][0]
        if held and sum(map(len, held)) >= PIECE:
            all_held = merged(np.concatenate(held))
            cut = int(np.searchsorted(all_held["digest"], low))
            if cut:
                yield all_held[:cut]
            held = [all_held[cut:]] if cut < len(all_held) else []
        held.append(piece)
    if held:
        yield merged(np.concatenate(held))


def _lead(entries: np.ndarray) -> np.ndarray:
    """The first 8 bytes of the digests as numbers."""
    return np.frombuffer(entries["digest"].tobytes(), ">u8").reshape(-1, 4)[:, 0].astype("u8") if len(entries) else np.empty(0, "u8")


def _sent(entries: Iterator[np.ndarray], holder: int, place: int, rounds: int, fan_in: int) -> Iterator[pa.RecordBatch]:
    """Cut a holder's run for the partners of a round: a partner's number differs from the holder's in the digit at
    ``place``, where it has the digit of the digests that it gets. Each part is a sorted run again."""
    holders, unit = np.uint64(fan_in**rounds), fan_in**place

    def pack(to: int, part: np.ndarray) -> tuple[int, bytes, bytes]:
        return to, part["digest"][0].ljust(32, b"\0"), part.tobytes()

    waiting: dict[int, list[np.ndarray]] = {}
    for some in entries:
        # where a digest ends up: its range of all holders, whose digit at ``place`` is due now
        final = ((_lead(some) >> np.uint64(48)) * holders >> np.uint64(16)).astype("i8")
        digit = final // unit % fan_in
        out = []
        for d in np.unique(digit).tolist():
            to = holder + (d - holder // unit % fan_in) * unit
            waiting.setdefault(to, []).append(some[digit == d])
            if sum(map(len, waiting[to])) >= PIECE:
                out.append(pack(to, np.concatenate(waiting.pop(to))))
        if out:
            yield _batch(out)
    if waiting:
        yield _batch([pack(to, np.concatenate(parts)) for to, parts in waiting.items()])


def _peeked(batches: Iterator[pa.RecordBatch]) -> tuple[pa.RecordBatch | None, Iterator[pa.RecordBatch]]:
    """The first batch that has rows, if any, and all that have."""
    filled = (b for b in batches if b.num_rows)
    head = next(filled, None)
    return head, chain([head], filled)


def _batch(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    to, first, run = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(first, pa.binary()), pa.array(run, pa.binary())], ["holder", "first", "run"])


#: Holders at most: a digest's first bytes tell its holder in each round.
MOST_HOLDERS = 1 << 16
_PIECES = "holder int, first binary, run binary"


def rounds_for(partitions: int, fan_in: int = FAN_IN) -> int:
    """Two rounds at least, and so many that there are about as many holders as partitions, but no more than can be. With
    more partitions than that a holder has more runs to merge, still piece by piece."""
    most = 1
    while fan_in ** (most + 1) <= MOST_HOLDERS:
        most += 1
    return min(most, max(2, round(math.log(max(2, partitions), fan_in))))


def merge_runs(rows: DataFrame, rounds: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each text: digest, check, n_bare, the row that stays (keep_id, keep_row) and group_size.

    There are fan_in ** rounds holders. Each input partition is sorted into a run and dealt to a holder. In a round,
    holders whose numbers differ in one digit exchange runs: each gets from its partners the digests whose own digit is
    the holder's, and merges the sorted runs into one. After the last round a holder has one range of digests and has
    met, through its partners, all input. Every merge leaves one entry of a text, so a text that fills a third of the
    corpus is down to one entry a run at once. What identifies a text is compared again at every level.
    """
    if rounds is None:
        partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rounds = rounds_for(partitions, fan_in)
    holders = fan_in**rounds
    if holders > MOST_HOLDERS:
        raise ValueError(f"{holders} holders are more than {MOST_HOLDERS}")

    def entries(b: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(b.num_rows, ENTRY)
        _, digest, check, n_bare, n_chars, doc_id, row = b.columns
        out["digest"] = np.frombuffer(flat(digest)[0], "S32")
        out["check"] = check.to_numpy().view("u8")
        out["n_bare"], out["shorter"], out["row"], out["n"] = n_bare.to_numpy(), -n_chars.to_numpy().astype("i8"), row.to_numpy(), 1
        out["no_id"] = doc_id.is_null().to_numpy(zero_copy_only=False)
        out["id"] = doc_id.fill_null(0).to_numpy()
        return out

    def first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, batches = _peeked(batches)
        if head is not None:
            yield from _sent(merge_pieces(map(entries, batches)), head.column(0)[0].as_py(), 0, rounds, fan_in)

    def exchanged(place: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            head, batches = _peeked(batches)
            if head is None:
                return
            run = merge_pieces(np.frombuffer(piece.as_buffer(), ENTRY) for b in batches for piece in b.column(2))
            if place < rounds:
                yield from _sent(run, head.column(0)[0].as_py(), place, rounds, fan_in)
                return
            for some in run:
                digest = binary_column(np.frombuffer(some["digest"].tobytes(), "u1"), 32 * np.arange(len(some) + 1))
                ids = pa.array(some["id"].copy(), mask=some["no_id"].astype(bool))
                columns = [digest, pa.array(some["check"].astype("u8").view("i8")), pa.array(some["n_bare"].astype("i8")), ids, pa.array(some["row"].copy()), pa.array(some["n"].copy())]
                yield pa.RecordBatch.from_arrays(columns, ["digest", "check", "n_bare", "keep_id", "keep_row", "group_size"])

        return run

    # sorted by Spark, which spills, so that a task holds a piece and not its partition
    dealt = rows.select(F.pmod(F.spark_partition_id(), F.lit(holders)).alias("holder"), "digest", "check", "n_bare", "n_chars", "doc_id", "row")
    level = dealt.sortWithinPartitions("digest").mapInArrow(first_runs, _PIECES)
    for place in range(1, rounds + 1):
        last = place == rounds
        met = level.repartitionById(holders, "holder").sortWithinPartitions("first")
        level = met.mapInArrow(exchanged(place), "digest binary, check long, n_bare long, keep_id long, keep_row long, group_size long" if last else _PIECES)
    return level


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Every document with the document that stays of its group of equal texts.

    Texts are equal when identical without ASCII white space; the longest original stays, then the smallest doc_id.
    Null texts count as empty and form one group. A null doc_id sorts last. Of rows that repeat a doc_id and its text
    one is kept, any of them. An empty table gives an empty result; other columns are ignored.
    """
    with Work(docs.sparkSession) as work:
        rows = work.table(digests(docs))
        keepers = merge_runs(rows).select(F.col("digest").alias("k"), F.col("check").alias("kc"), F.col("n_bare").alias("kb"), "keep_id", "keep_row", "group_size")
        found = rows.join(keepers, (F.col("digest") == F.col("k")) & (F.col("check") == F.col("kc")) & (F.col("n_bare") == F.col("kb")))
        kept = (F.col("row") == F.col("keep_row")).alias("kept")
        return materialize(found.select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256")))


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k
"""
