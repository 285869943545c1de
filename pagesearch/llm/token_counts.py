"""Token counts by byte-pair merging over a heap and a linked list, without making ids."""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

LIMIT = 4096
#: Words whose counts a worker keeps, and the longest that it keeps; beyond either a word is merged anew.
KEPT, KEPT_CHARS = 1_000_000, 40
SPACE = "▁"


class MergeCounter(dict):
    """Counts of the words met so far; a missing word is merged.

    Keys are words without the space mark in front of them. Pieces hold a space mark only in their first characters,
    so merges never cross from a word into the next word's mark, and the counts of words add up to a text's count.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        pieces = {model.id_to_piece(i): -model.get_score(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        rank = {score: k for k, score in enumerate(sorted(set(pieces.values())))}
        self.ranks = {p: rank[score] for p, score in pieces.items()}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces) or any("\n" in p for p in pieces):
            raise ValueError("a piece of this model spans words or lines")

    def merged(self, symbols: str) -> int:
        """Initial symbols minus merges; a character outside the vocabulary stands for its UTF-8 bytes.

        A heap entry is one integer: rank, left position and length of the piece that the merge would make.
        """
        ranks, n = self.ranks, len(symbols)
        parts = list(symbols)
        weight = [1 if c in ranks else len(c.encode()) for c in parts]
        count = sum(weight)
        heap = [ranks[p] << 64 | i << 32 | 2 for i in range(n - 1) if (p := symbols[i : i + 2]) in ranks]
        if not heap:
            return count
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top >> 32 & 0xFFFFFFFF
            a, j = parts[i], right[i]
            if not a or j >= n or len(a) + len(parts[j]) != top & 0xFFFFFFFF:
                continue  # one of the two has merged otherwise meanwhile
            count -= weight[i] + weight[j] - 1
            weight[i] = 1
            a += parts[j]
            parts[i], parts[j] = a, ""
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (p := a + parts[k]) in ranks:
                    heappush(heap, ranks[p] << 64 | i << 32 | len(p))
            if (k := left[i]) >= 0 and (p := parts[k] + a) in ranks:
                heappush(heap, ranks[p] << 64 | k << 32 | len(p))
        return count

    def __missing__(self, word: str) -> int:
        if word[:1] == SPACE:  # the start of a line: no piece holds a line feed, so nothing merges across it
            symbols = "\n" + word[1:]
        elif "\n" in word:
            head, *lines = word.split("\n")
            return self[head] + sum(self[SPACE + x] for x in lines)
        else:
            symbols = SPACE + word.replace(" ", SPACE)
        n = self.merged(symbols)
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(SPACE, " ")
        words = text.split(" ") if "  " not in text and text[0] != " " else [m[1:] for m in re.findall(" +[^ ]*", " " + text)]
        return sum(map(self.__getitem__, words))


def token_counts(docs: DataFrame, model_file: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text.

    Null texts count as empty, with no tokens. Null and repeated doc_ids stay as they are: a row in gives a row out.
    Very long words are merged whole, in n log n steps. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = MergeCounter(model_file)
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            n = np.fromiter(map(counter.count, texts), "i8", len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.fromiter((len(t.encode()) for t in texts), "i8", len(texts))), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
