"""Alignment of two tokenizers: overlapping tokens are linked, union-find makes links to groups, links are counted.

Both tokenizers cut a text before a space or line feed that follows a visible character, so the stretches in between are
aligned on their own, each different stretch of a parcel of texts once. What its groups hold and which pairs of ids its
links have is kept with the stretch; texts are sequences of stretches. The counts of pairs are added up by Spark and go back
to the parcels, which know how often each text has each pair.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, flat, materialize, parcels

#: Bytes of text that are aligned together; changes no result.
TOGETHER = 8 << 20
SPACE = "▁"
#: A stretch: white space, then all up to the next space or line feed that follows a visible character.
_STRETCH = re.compile(r"\s+\S*(?:[^\S \n]\s*\S*)*")
_ROWS = "chunk long, number int, a int, b int, n long, row int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, data binary"
_NAMES = [f.split()[0] for f in _ROWS.split(", ")]
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_ARROW = pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in _ROWS.split(", "))])
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_level() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if visible, else one after U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Sides:
    """Both tokenizers and the bytes that each of their ids stands for."""

    def __init__(self, a_file: str, b_file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        of = byte_level()
        self.bytes_a = {i: bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("a piece of this model spans words or lines")
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(SPACE, " ").encode() for p in pieces]
        self.mark = self.b.piece_to_id(SPACE)
        self.size_a = np.zeros(max(self.bytes_a) + 1, "i8")
        for i, x in self.bytes_a.items():
            self.size_a[i] = len(x)
        self.size_b = np.fromiter(map(len, self.bytes_b), "i8", len(self.bytes_b))

    def tokens(self, stretches: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids of both sides, and which stretches both sides give back; the others have no ids."""
        a = [e.ids for s in range(0, len(stretches), 1 << 14) for e in self.a.encode_batch_fast(stretches[s : s + (1 << 14)], add_special_tokens=False)]
        # B puts a space before what it gets: that is the stretch's own, or one that is taken off again
        b = self.b.encode([s[1:] if s[0] == " " else s for s in stretches], num_threads=1)
        for k, s in enumerate(stretches):
            if s == " ":
                b[k] = [self.mark]
            elif s[0] != " ":
                b[k] = b[k][1:] if b[k][:1] == [self.mark] else []
        good = np.ones(len(stretches), bool)
        of_a, of_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        for k, s in enumerate(stretches):
            raw = s.encode()
            if b"".join(map(of_b, b[k])) != raw or b"".join(map(of_a, a[k])) != raw:
                good[k], a[k], b[k] = False, [], []
        return a, b, good


def joined(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Union-find over n nodes: the least node that links (left, right) reach from each, by hooking roots to lesser
    roots and halving paths until nothing changes."""
    parent = np.arange(n)
    while True:
        x, y = parent[left], parent[right]
        apart = x != y
        if not apart.any():
            return parent
        left, right, x, y = left[apart], right[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


class Aligned:
    """Stretches of a parcel, aligned: for each n_a, n_b, n_groups and its groups as text, and its links as pairs of ids,
    in order; ``offsets`` tells where the links of each stretch begin."""

    def __init__(self, sides: Sides, stretches: list[str]):
        a, b, self.good = sides.tokens(stretches)
        self.n_a, self.n_b = (np.fromiter(map(len, x), "i8", len(x)) for x in (a, b))
        ids = [np.fromiter((i for x in side for i in x), "i8", int(n.sum())) for side, n in ((a, self.n_a), (b, self.n_b))]
        ends = [np.cumsum(size[i]) for size, i in zip((sides.size_a, sides.size_b), ids)]
        segments = np.union1d(*ends)  # each lies in one token of either side: these two are a link
        at_a, at_b = (np.searchsorted(e, segments) for e in ends)
        self.pairs = ids[0][at_a], ids[1][at_b]
        m = len(ids[0])
        root = joined(m + len(ids[1]), at_a, at_b + m)
        of_stretch = np.repeat(np.arange(len(a)), self.n_a)
        is_root = root[:m] == np.arange(m)
        self.n_groups = np.bincount(of_stretch[is_root], minlength=len(a))
        self.offsets = np.concatenate(([0], np.cumsum(np.bincount(of_stretch[at_a], minlength=len(a)))))
        self.texts = self._texts(ids, root, m)

    def _texts(self, ids: list[np.ndarray], root: np.ndarray, m: int) -> list[bytes]:
        """Groups of each stretch: ids with commas, sides apart by a bar, groups by a semicolon."""
        order = np.argsort(2 * root + (np.arange(len(root)) >= m), kind="stable")
        side, group = order >= m, root[order]
        new_group = np.append(True, group[1:] != group[:-1])[: len(order)]
        new_side = np.append(False, side[1:] != side[:-1])[: len(order)] & ~new_group
        mark = np.where(new_group, 0, np.where(new_side, 1, 2))
        of = np.concatenate(ids)[order]
        whole = pc.binary_join_element_wise(pa.array([";", "|", ","]).take(pa.array(mark)), pa.array(of).cast(pa.string()), "")
        data, at = flat(whole.cast(pa.binary()))
        first = np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))
        raw, cuts = data.tobytes(), at[first].tolist()
        return [raw[s + 1 : e] for s, e in zip(cuts[:-1], cuts[1:])]


class _Numbered(dict):
    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _rows(many: int, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], f.type) if c in columns else pa.nulls(many, f.type) for c, f in zip(_NAMES, _ARROW)], schema=_ARROW)


def _aligner(a_file: str, b_file: str, together: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each parcel a row for each pair of ids that it links, a row for each text, with its stretches as numbers, and a
    row that tells the pairs of each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Sides(a_file, b_file)
        chunk = (TaskContext.get().partitionId() << 17) - 1
        for table in parcels(batches, together):
            chunk += 1
            number = _Numbered()
            texts = table.column("text").to_pylist()
            held = [np.fromiter(map(number.__getitem__, _STRETCH.findall(" " + t)) if t else (), "i4") for t in texts]
            m = len(texts)
            docs = {"many": m, "chunk": [chunk] * m, "row": np.arange(m), "doc_id": table.column("doc_id").combine_chunks()}
            del table
            if not number:
                yield _rows(**docs, n_a=[0] * m, n_b=[0] * m, n_groups=[0] * m, n_links=[0] * m, groups_sha256=[""] * m, data=[b""] * m)
                continue
            found = Aligned(sides, list(number))
            links = np.diff(found.offsets)
            held = [x if found.good[x].all() else x[:0] for x in held]
            sums = {c: [int(of[x].sum()) for x in held] for c, of in (("n_a", found.n_a), ("n_b", found.n_b), ("n_groups", found.n_groups), ("n_links", links))}
            sha = [hashlib.sha256(b";".join([found.texts[i] for i in x.tolist()])).hexdigest() if len(x) else "" for x in held]
            yield _rows(**docs, **sums, groups_sha256=sha, data=[x.tobytes() for x in held])
            times = sum((np.bincount(x, minlength=len(number)) for x in held), np.zeros(len(number), "i8"))
            wide = len(sides.size_b)
            keys, pair = np.unique(found.pairs[0] * wide + found.pairs[1], return_inverse=True)
            n = np.bincount(pair, weights=np.repeat(times, links), minlength=len(keys)).astype("i8")
            yield _rows(1, chunk=[chunk], n=[len(number)], data=[np.concatenate((found.offsets, pair)).astype("<i4").tobytes()])
            met = np.flatnonzero(n)
            for s in range(0, len(met), 1 << 16):
                k = met[s : s + (1 << 16)]
                yield _rows(len(k), chunk=np.full(len(k), chunk), number=k, a=keys[k] // wide, b=keys[k] % wide, n=n[k])

    return run


def _scored(table: pa.Table) -> pa.Table:
    """n_best and count_sum of a parcel's texts, from the counts of its pairs."""
    is_pair, is_doc = pc.is_valid(table.column("number")), pc.is_valid(table.column("row"))
    docs, pairs = table.filter(is_doc), table.filter(is_pair)
    of = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    sums = np.zeros((2, docs.num_rows), "i8")
    for row in table.filter(pc.and_(pc.invert(is_pair), pc.invert(is_doc))).select(["n", "data"]).to_pylist():
        whole = np.frombuffer(row["data"], "<i4")
        offsets, links = whole[: row["n"] + 1], whole[row["n"] + 1 :]
        for k, column in enumerate(("best", "count")):
            value = np.zeros(int(links.max(initial=-1)) + 1, "i8")
            value[pairs.column("number").to_numpy()] = pairs.column(column).to_numpy()
            before = np.concatenate(([0], np.cumsum(value[links])))
            of_stretch = before[offsets[1:]] - before[offsets[:-1]]
            sums[k] = [int(of_stretch[np.frombuffer(x, "<i4")].sum()) for x in docs.column("data").to_pylist()]
    return pa.table(of | {"n_best": sums[0], "count_sum": sums[1]})


def token_alignment(docs: DataFrame, a_file: str, b_file: str, together: int = TOGETHER) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document.

    A encodes a space and the text, B the text, to which it adds a space. Groups are the components of tokens that
    overlap; a link is a pair of overlapping tokens. A pair of ids counts its links in all documents, repeated rows again.
    n_best counts the links whose pair has the highest count of all pairs with its B id, count_sum adds up the counts of
    all links. Null and empty texts, and texts that the tokens of a side don't give back byte for byte, have no tokens:
    zeros and the empty string. Null doc_ids stay. An empty table gives an empty result; other columns are ignored.

    Each parcel has one row for a pair of ids, so that no pair has more rows than there are parcels.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with Work(docs.sparkSession) as work:
        found = work.table(rows.mapInArrow(_aligner(a_file, b_file, together), _ROWS))
        pairs = found.filter("number is not null").select("chunk", "number", "a", "b", "n")
        counts = work.table(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")))
        top = counts.groupBy("b").agg(F.max("count").alias("top"))
        scores = counts.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))
        named = pairs.join(scores, ["a", "b"]).select("chunk", "number", "count", "best")
        texts = found.filter("number is null").drop("a", "b", "number")
        both = texts.unionByName(named, allowMissingColumns=True)
        out = both.groupBy("chunk").applyInArrow(_scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
        return materialize(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
