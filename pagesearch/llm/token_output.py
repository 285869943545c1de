"""Token ids in files: frequency ranks in byte-aligned variable-length coding with separate control bytes."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Work, binary_column, flat, id_and_text, set_checkpoint_dir

END_ID = 2
#: Bytes of texts that are encoded together, and pieces of words whose ids a task keeps.
TOGETHER, KEPT = 1 << 23, 500_000

#: For each control byte, how many bytes beyond the first the four values that it stands for have.
CODES = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype("u1")


def _filled(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the lengths in the control bytes, four to a byte, stand for values of texts that have ``counts`` values,
    and the offsets of the texts' control bytes."""
    quads = np.concatenate(([0], np.cumsum(-(-counts // 4))))
    filled = np.ones(4 * int(quads[-1]), bool)
    for k in (1, 2, 3):
        filled[4 * quads[1:][-counts % 4 >= k] - k] = False
    return filled, quads


def _present(code: np.ndarray) -> np.ndarray:
    """Which of the low bytes of each value are stored, up to the most that any needs."""
    out = np.ones((len(code), 1 + int(code.max(initial=0))), bool)
    for k in range(1, out.shape[1]):
        out[:, k] = code >= k
    return out


def pack(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, two bits for each value, and the values' low bytes, of texts that lie one after the other with
    ``counts`` values each: (control, its offsets, payload, its offsets). Values are below 2**32."""
    v = values.astype("<u4", copy=False)
    code = (v > 0xFF).astype("u1") + (v > 0xFFFF) + (v > 0xFFFFFF)
    filled, quads = _filled(counts)
    codes = np.zeros(len(filled), "u1")
    codes[filled] = code
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    present = _present(code)
    payload = np.ascontiguousarray(v.view("u1").reshape(-1, 4)[:, : present.shape[1]]).ravel()[present.ravel()]
    ends = np.cumsum(counts)
    more = np.concatenate(([0], np.cumsum(code, dtype="i8")))
    return control, quads, payload, np.concatenate(([0], ends + more[ends]))


def unpack(control: np.ndarray, payload: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values that pack() was given, with lengths looked up by control byte."""
    present = _present(CODES[control].ravel()[_filled(counts)[0]])
    low = np.zeros(present.size, "u1")
    low[present.ravel()] = payload
    out = np.zeros((len(present), 4), "u1")
    out[:, : present.shape[1]] = low.reshape(present.shape)
    return out.view("<u4").ravel()


class Ids:
    """The ids of numbered strings, one after the other."""

    def __init__(self):
        self.ids, self.start, self.count = np.empty(0, "<u2"), np.empty(0, "i4"), np.empty(0, "i4")

    def add(self, ids: np.ndarray, count: np.ndarray) -> None:
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(count) - count)).astype("i4")
        self.count = np.concatenate((self.count, count)).astype("i4")
        self.ids = np.concatenate((self.ids, ids))

    def add_each(self, some: list[np.ndarray]) -> None:
        self.add(np.concatenate([np.empty(0, "<u2"), *some]), np.array([len(x) for x in some], "i4"))

    def of(self, numbers: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The first ``count`` ids of each."""
        source = np.repeat(self.start[numbers] - (np.cumsum(count, dtype="i4") - count), count)
        source += np.arange(len(source), dtype="i4")
        return self.ids[source]


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, with each word of a batch looked at once.

    The library's pre-tokenizer starts a token at each space that follows a non-space and precedes one, so a text is
    the concatenation of its words with the space in front of each. Within a word, Latin letters, runs of marks and
    single line feeds are tokens of their own; these pieces go straight to the library's merges and are kept, up to
    ``limit`` of them. Words with anything else go through the library's whole pipeline. Texts in which a space stands
    between other white space, or which hold a special token's string, go to the library whole.
    """

    WHOLE = re.compile(r"\s \s|\s \Z")
    CUT = re.compile(r"(?<=\S) (?=\S)")
    LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"  # all of them are letters to the pre-tokenizer
    MARKS = r"!-&(-/:-@\[-`{-~"  # ASCII without letters, digits and the apostrophe, which may begin a suffix
    PIECES = re.compile(f" ?[{LETTERS}]+|[{MARKS}]+|\x00|\n(?!\n)|(?:[^\x00\n{LETTERS}{MARKS}]|\n(?=\n))+\n?")
    GOOD = re.compile(f" ?[{LETTERS}]+|[{MARKS}]+")
    #: Numbers of what is no piece: the border of two words, and anything that needs the whole pipeline.
    BORDER, OTHER = -1, -2

    def __init__(self, path: str, limit: int = KEPT):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library would start a thread for each
        self.limit = limit
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        if max(vocabulary.values()) > 0xFFFF:
            raise ValueError("ids beyond 16 bits")
        self.length = np.zeros(max(vocabulary.values()) + 1, "i8")
        for token, i in vocabulary.items():
            self.length[i] = len(token)  # the byte-level alphabet has one character for each byte
        same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves in it
        self.alphabet = np.arange(256, dtype="<u2")
        self.alphabet[[b for b in range(256) if b not in same]] = 0x100 + np.arange(256 - len(same))
        self.merges = Tokenizer(self.library.model)  # the same merges, between line feeds
        self.merges.pre_tokenizer = pre_tokenizers.Split(chr(self.alphabet[0x0A]), "removed")
        self.forget()

    def forget(self) -> None:
        self.pieces: dict[str, int] = {"\x00": self.BORDER, "\n": 0}
        self.parts = Ids()
        self.parts.add_each(self.encoded(["\n"]))

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u2") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn_pieces(self, pieces: list[str]) -> None:
        """Take in what the pre-tokenizer leaves whole: merged together, cut by the lengths of its bytes."""
        raw = [np.frombuffer("\n".join(pieces[k : k + 256]).encode(), "u1") for k in range(0, len(pieces), 256)]
        encoded = self.merges.encode_batch_fast([self.alphabet[x].tobytes().decode("utf-16-le") for x in raw], add_special_tokens=False)
        ids = np.concatenate([np.empty(0, "<u2"), *(np.array(e.ids, "<u2") for e in encoded)])
        n_bytes = np.concatenate([np.empty(0, "i8"), *(np.diff(np.concatenate(([-1], np.flatnonzero(x == 0x0A), [len(x)]))) - 1 for x in raw)])
        stops = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(n_bytes)) + 1
        self.pieces.update(zip(pieces, range(len(self.parts.count), len(self.parts.count) + len(pieces))))
        self.parts.add(ids, np.diff(np.concatenate(([0], stops))))

    def spaced(self, words: pa.Array) -> Ids:
        """Ids of different words with the space in front of each."""
        if len(self.pieces) > self.limit:
            self.forget()
        found = self.PIECES.findall(" " + "\x00 ".join(pc.replace_substring(words, "\x00", "\x01").to_numpy(zero_copy_only=False)))
        number = np.fromiter(map(self.pieces.get, found, repeat(-3)), "i8", len(found))
        unknown = np.flatnonzero(number == -3).tolist()
        new = dict.fromkeys(found[k] for k in unknown)
        self.learn_pieces([p for p in new if self.GOOD.fullmatch(p)])
        number[unknown] = [self.pieces.get(found[k], self.OTHER) for k in unknown]
        word = np.cumsum(number == self.BORDER)
        odd = np.zeros(len(words), bool)
        odd[word[number == self.OTHER]] = True
        keep = (number >= 0) & ~odd[word]
        number, word = number[keep], word[keep]
        count = self.parts.count[number]
        rest = np.flatnonzero(odd)
        others = self.encoded([" " + w for w in words.take(pa.array(rest)).to_pylist()])
        out = Ids()
        out.count = np.bincount(word, count, len(words)).astype("i4")
        out.start = (np.cumsum(out.count) - out.count).astype("i4")
        out.ids = self.parts.of(number, count)
        n = np.array([len(x) for x in others], "i4")
        out.start[rest], out.count[rest] = len(out.ids) + np.cumsum(n) - n, n
        out.ids = np.concatenate([out.ids, *others])
        return out

    def __call__(self, texts: pa.Array, opens: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the n + 1 offsets. Texts that don't open a document have a space
        in front; they begin and end without white space."""
        split = pc.split_pattern(texts, " ")
        at = split.offsets.to_numpy()
        at, words = at - at[0], split.flatten()
        first = at[:-1]
        coded = words.dictionary_encode()
        distinct, codes = coded.dictionary, coded.indices.to_numpy()
        empty = pc.binary_length(distinct).to_numpy() == 0
        odd = empty | pc.utf8_is_space(pc.utf8_slice_codeunits(distinct, 0, 1)).to_numpy(zero_copy_only=False)
        whole = np.zeros(len(texts), bool)
        if odd.any():
            perhaps = np.logical_or.reduceat(odd[codes], first)
            whole[[k for k in np.flatnonzero(perhaps).tolist() if self.WHOLE.search(texts[k].as_py())]] = True
        for s in (*self.special, "\x00"):
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        ids = self.spaced(distinct)
        heads = np.unique(codes[first[~whole]]) if opens else np.empty(0, "i4")
        alone = np.flatnonzero(whole).tolist()
        numbers = codes.astype("i8")
        if opens:
            numbers[first[~whole]] = len(distinct) + np.searchsorted(heads, codes[first[~whole]])
        numbers[first[alone]] = len(distinct) + len(heads) + np.arange(len(alone))
        ids.add_each(self.encoded(distinct.take(pa.array(heads)).to_pylist() + [("" if opens else " ") + texts[k].as_py() for k in alone]))
        count = ids.count[numbers]
        for k in alone:  # the first word stands for the text
            count[at[k] + 1 : at[k + 1]] = 0
        return ids.of(numbers, count), np.concatenate(([0], np.cumsum(count, dtype="i8")[at[1:] - 1]))


def _ended(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of the ids of each text with the end id behind them."""
    out = np.full(len(ids) + len(offsets) - 1, END_ID, "<u2")
    out[np.arange(len(ids)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))] = ids
    return binary_column(out.view("u1"), 2 * (offsets + np.arange(len(offsets))))


def encode(docs: DataFrame, path: str, together: int = TOGETHER, kept: int = KEPT) -> DataFrame:
    """doc_id and ids, 16 bits each, the end id last. ``together`` is the bytes of text that are encoded at a time; a
    longer text is cut at single spaces, where no token begins before and ends after. A task has its own encoder, which
    ends with it, so that reused workers hold nothing."""

    def parts(text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > together and (cut := Encoder.CUT.search(text, at + together)):
            yield text[at : cut.start()]
            at = cut.end()
        yield text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, kept)
        for b in batches:
            size = np.cumsum(pc.binary_length(b.column(1)).to_numpy().astype("i8"))
            at = 0
            while at < b.num_rows:
                n = max(1, int(np.searchsorted(size, (size[at - 1] if at else 0) + together, side="right")) - at)
                some = b.column(1).slice(at, n)
                if n > 1:
                    ids = _ended(*encoder(some))
                else:
                    each = [encoder(pa.array([part], pa.string()), k == 0)[0] for k, part in enumerate(parts(some[0].as_py()))]
                    ids = _ended(np.concatenate(each), np.array([0, sum(map(len, each))]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), ids], ["doc_id", "ids"])
                at += n

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids binary")


def id_counts(encoded: DataFrame) -> DataFrame:
    """(id, n) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, "i8")
        for b in batches:
            total += np.bincount(flat(b.column(0))[0].view("<u2"), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(total[at])], ["id", "n"])

    return encoded.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def frequency_ranks(counts: Iterable[tuple[int, int]]) -> np.ndarray:
    """Ids by falling frequency, then by id; a rank is an index into this."""
    return np.array([i for i, _ in sorted(counts, key=lambda x: (-x[1], x[0]))], "<u2")


def write_token_files(docs: DataFrame, path: str, folder: str, together: int = TOGETHER, kept: int = KEPT) -> None:
    """Write the ids of all documents, in ascending doc_id order, to ``folder``, with all that reading them needs.

    ``folder``/texts: a row for each document: doc_id, part, place, n_tokens, control bytes, payload bytes; parts rise
    with doc_id, and places within a part. ``folder``/ranks: the id of each rank. Documents are ordered by doc_id, nulls
    first, then by length and hash of their ids; the number of a row tells the rest apart, so that any number of rows
    with one doc_id is spread over parts. Ids are encoded once, to a table that is deleted afterwards.
    """
    spark = docs.sparkSession
    with Work(spark) as work:
        encoded = work.table(encode(docs, path, together, kept))
        by_rank = frequency_ranks((r.id, r.n) for r in id_counts(encoded).collect())  # as many rows as the vocabulary at most
        rank_of = np.zeros(1 << 16, "<u4")
        rank_of[by_rank] = np.arange(len(by_rank))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, at = flat(b.column(1))
                counts = np.diff(at) // 2
                control, controls, payload, payloads = pack(rank_of[ids.view("<u2")], counts)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), binary_column(control, controls), binary_column(payload, payloads)], ["doc_id", "n_tokens", "control", "payload"])

        # ordered before packing: finding the ranges reads all that comes before
        order = ["doc_id", F.length("ids").alias("l"), F.xxhash64("ids").alias("x"), F.monotonically_increasing_id().alias("row")]
        ordered = encoded.select(*order, "ids").repartitionByRange("doc_id", "l", "x", "row").sortWithinPartitions("doc_id", "l", "x", "row")
        packed = ordered.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, control binary, payload binary")
        packed.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}).write.parquet(f"{folder}/texts", compression="zstd")
        ranks = spark.createDataFrame([(k, int(i)) for k, i in enumerate(by_rank)], "rank int, id int")
        ranks.coalesce(1).write.parquet(f"{folder}/ranks", compression="zstd")


def read_ranks(spark: SparkSession, folder: str) -> np.ndarray:
    """The id of each rank."""
    rows = spark.read.schema("rank int, id int").parquet(f"{folder}/ranks").collect()  # as many rows as the vocabulary at most
    by_rank = np.zeros(len(rows), "<u4")
    for r in rows:
        by_rank[r.rank] = r.id
    return by_rank


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 from the files: start counts the ids of all documents before."""
    by_rank = read_ranks(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = b.column(2).to_numpy()
            ids = memoryview(by_rank[unpack(flat(b.column(3))[0], flat(b.column(4))[0], counts)].view("u1"))
            ends = (4 * np.cumsum(counts)).tolist()
            crc = [zlib.crc32(ids[a:e]) for a, e in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(5), pa.array(crc, pa.int64())], ["doc_id", "part", "n_tokens", "place", "ids_crc32"])

    files = spark.read.schema("doc_id long, n_tokens long, control binary, payload binary, part int, place long").parquet(f"{folder}/texts")
    files = files.select("doc_id", "part", "n_tokens", "control", "payload", "place")
    rows = files.mapInArrow(run, "doc_id long, part int, n_tokens long, place long, ids_crc32 long")
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # a row for each write task
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("total").over(before(Window.orderBy("part"))), F.lit(0)).alias("offset"))
    inside = before(Window.partitionBy("part").orderBy("place"))
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(F.broadcast(offsets), F.col("part") == F.col("p"))
    return placed.select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, path: str, folder: str | None = None, together: int = TOGETHER, kept: int = KEPT) -> DataFrame:
    """Write the token files of all documents, then describe each document from what the files hold.

    Null texts count as empty: the end id alone. Documents with one doc_id stand side by side by length and content;
    null ids come first. An empty table writes empty files and gives an empty result. Other columns are ignored. The
    folder is the corpus and stays; it defaults to a new one in the shared checkpoint folder. ``together`` bounds the
    text that a Python worker encodes at a time, ``kept`` the pieces of words that it keeps.
    """
    spark = docs.sparkSession
    if folder is None:
        folder = f"{set_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, folder, together, kept)
    return read_token_files(spark, folder)
