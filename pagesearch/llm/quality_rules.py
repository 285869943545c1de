"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them by their estimated accuracies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work, WordScan, byte_set, materialize, parcels

#: A text fails without votes below so many words, or with so many per cent of its words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on as with be by this a "
    "der die das und zu den von mit ist des dem nicht ein eine auf für "
    "le la les et des en un une du que est pour dans sur au "
    "el los las y del se por con una su para no como de"
).split()
#: Rounds of expectation-maximisation, how little the probabilities may change at the end, and what counts as seen of
#: each outcome before any is.
ROUNDS, CHANGE, PRIOR = 200, 1e-9, 1.0
#: Bytes of text that are looked at together.
TOGETHER = 8 << 20
_BLANK, _SYMBOL, _TERMINAL, _UPPER, _LETTER = (byte_set(s) for s in (" \t\n\x0b\x0c\r", SYMBOLS, ".!?", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_ANY_LETTER = _LETTER | (np.arange(256) >= 128)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_lettered", "n_terminal", "n_stop")


def repeated_words(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each word is in a window of three words that its text holds twice or more."""
    out = np.zeros(len(code), bool)
    if len(code) < 3:
        return out
    many = int(code.max()) + 1
    seen = np.unique(doc * many + code, return_inverse=True)[1]
    for k in (1, 2):
        seen = np.unique(seen[: len(code) - k] * many + code[k:], return_inverse=True)[1]
    whole = doc[2:] == doc[:-2]
    again = whole & (np.bincount(seen[whole], minlength=int(seen.max()) + 1)[seen] > 1)
    for k in range(3):
        out[k : len(code) - 2 + k] |= again
    return out


def counts_of(texts: list[bytes]) -> list[np.ndarray]:
    """COUNTS of each text."""
    m = len(texts)
    found = WordScan(texts, _BLANK)
    data, doc = found.data, found.doc
    of_bytes = lambda mask: np.add.reduceat(mask.view("u1"), found.begins, dtype="i8") if m else np.zeros(0, "i8")
    of_words = lambda mask: np.bincount(doc[mask], minlength=m)
    feeds = np.flatnonzero(data == 10) + 1
    lines = pa.Array.from_buffers(pa.large_binary(), len(feeds), [None, pa.py_buffer(np.concatenate(([0], feeds)).astype("<i8")), pa.py_buffer(data)]).dictionary_encode().indices.to_numpy()
    full = np.unique(np.searchsorted(feeds, found.starts, side="right"))
    line_doc = np.searchsorted(found.begins, np.concatenate(([0], feeds[:-1]))[full], side="right") - 1
    many = int(lines.max(initial=0)) + 1
    n_lines = np.bincount(line_doc, minlength=m)
    different = np.bincount(np.unique(line_doc * many + lines[full]) // many, minlength=m)
    words = found.values().dictionary_encode()
    code = words.indices.to_numpy().astype("i8")
    stop = pc.is_in(words.dictionary, pa.array([w.encode() for w in STOP_WORDS], pa.large_binary())).to_numpy(zero_copy_only=False)
    lettered = np.add.reduceat(_ANY_LETTER[data].view("u1"), found.starts, dtype="i8") > 0 if len(code) else np.zeros(0, bool)
    continued = (data & 0xC0) == 0x80
    return [
        np.bincount(doc, minlength=m), of_bytes(~found.apart & ~continued), of_bytes(_SYMBOL[data]), n_lines - different, of_words(repeated_words(code, doc)),
        n_lines, of_bytes(_LETTER[data]), of_bytes(_UPPER[data]), of_words(lettered), of_words(_TERMINAL[data[found.ends - 1]]), of_words(stop[code]),
    ]


def text_counts(docs: DataFrame, together: int = TOGETHER) -> DataFrame:
    """doc_id and COUNTS of each document's whole text; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in parcels(batches, together):
            found = counts_of([t.encode() for t in table.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), *(pa.array(c, pa.int64()) for c in found)], ["doc_id", *COUNTS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *COUNTS)))


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.nullif(F.col(whole), F.lit(0))


def rules() -> dict[str, tuple[Column, Column]]:
    """For each rule when it votes against a text and when for it; it abstains between the two, and on null shares."""
    length, symbols, upper = _share("word_chars", "n_words"), _share("n_symbols", "n_words"), _share("n_upper", "n_letters")
    repeats, copies, lettered, ends, stop = _share("n_repeat_words", "n_words"), _share("n_dup_lines", "n_lines"), _share("n_lettered", "n_words"), _share("n_terminal", "n_words"), _share("n_stop", "n_words")
    return {
        "words": (F.col("n_words") < LEAST_WORDS, F.col("n_words") >= 2 * LEAST_WORDS),
        "word_length": ((length < 3) | (length > 10), (length >= 4) & (length <= 7)),
        "symbols": (symbols > 0.1, symbols < 0.02),
        "upper_case": (upper > 0.3, upper < 0.15),
        "repeated_words": (repeats > 0.4, repeats < 0.1),
        "copied_lines": (copies > 0.3, (copies < 0.1) & (F.col("n_lines") >= 4)),
        "lettered_words": (lettered < 0.8, lettered > 0.95),
        "sentence_ends": ((ends > 0.4) | (ends < 0.005), (ends > 0.02) & (ends < 0.25)),
        "stop_words": (stop < 0.04, stop > 0.1),
    }


def votes() -> Column:
    """A character for each rule in order: 1 for the text, 0 against it, - if it abstains."""
    one = lambda against, for_: F.when(against, "0").when(for_, "1").otherwise("-")
    return F.concat(*(one(*r) for r in rules().values()))


class Fitted:
    """Accuracies by expectation-maximisation over patterns of votes and how many texts have each.

    A rule has two accuracies, of its votes on good and on bad texts; an abstention tells nothing. The first
    probabilities are shares of votes for the text, so that good is what most rules vote for.
    """

    def __init__(self, patterns: list[str], n: list[int]):
        vote = np.array([[{"0": 0.0, "1": 1.0}.get(c, np.nan) for c in p] for p in patterns]).reshape(len(patterns), len(patterns[0]) if patterns else 0)
        said, for_, weight = ~np.isnan(vote), np.nan_to_num(vote), np.asarray(n, "f8")
        against = said & (for_ == 0)
        posterior = (for_.sum(1) + 0.5) / (said.sum(1) + 1)
        for self.rounds in range(1, ROUNDS + 1):
            good, bad = weight * posterior, weight * (1 - posterior)
            self.prior = (good.sum() + PRIOR) / (weight.sum() + 2 * PRIOR)
            self.good = (good @ for_ + 2 * PRIOR) / (good @ said + 3 * PRIOR)
            self.bad = (bad @ against + 2 * PRIOR) / (bad @ said + 3 * PRIOR)
            log_good = np.log(self.prior) + for_ @ np.log(self.good) + against @ np.log1p(-self.good)
            log_bad = np.log1p(-self.prior) + for_ @ np.log1p(-self.bad) + against @ np.log(self.bad)
            new = 1 / (1 + np.exp(np.clip(log_bad - log_good, -700, 700)))
            change, posterior = np.abs(new - posterior).max(initial=0.0), new
            if change < CHANGE:
                break
        self.posterior = posterior


def quality_rules(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, votes and quality.

    Each document is looked at once; only patterns of votes and their counts come to the driver, at most three to the
    power of the number of rules. quality is the probability that a text with its votes is good, rounded to nine digits;
    a text is kept with ``least`` or more unless it fails the base rules. All documents count in the estimate, repeated
    rows again; null and empty texts have no words and fail. Null doc_ids stay. An empty table gives an empty result;
    other columns are ignored.
    """
    with Work(docs.sparkSession) as work:
        rows = work.table(text_counts(docs).withColumn("votes", votes()))
        seen = sorted((r.votes, r.n) for r in rows.groupBy("votes").agg(F.count("*").alias("n")).collect())
        fitted = Fitted([v for v, _ in seen], [n for _, n in seen])
        known = docs.sparkSession.createDataFrame([(v, round(float(p), 9)) for (v, _), p in zip(seen, fitted.posterior)], "votes string, quality double")
        out = rows.join(F.broadcast(known), "votes")
        failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
        return materialize(out.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & (F.col("quality") >= least)).alias("kept"), "votes", "quality"))
