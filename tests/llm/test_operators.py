"""Each corpus operator against the library, the SQL or a brute-force version that it must agree with."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark import SparkFiles
from pyspark.sql import functions as F

from pagesearch.llm import collocations, decontamination, exact_dedup, license_scan, quality_rules, simhash, source_mixing, suffix_dedup, token_alignment, token_counts, token_output, toxicity, url_filter

SPIECE = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sql_rows(sql, df=None, **tables):
    con = duckdb.connect()
    for name, columns, rows in tables.values():
        con.register(name, pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype="Int64" if c.endswith("_id") else "object") for i, c in enumerate(columns)}))
    return con.sql(sql)


def documents(edge):
    return {"d": ("documents", ["doc_id", "text", "lang", "source"], [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1") for r in edge])}


def same(df, sql, **tables):
    rel = sql_rows(sql, **tables)
    want = sorted((tuple(r) for r in rel.fetchall()), key=repr)
    assert rows_of(df.select(*rel.columns)) == want


# --- 1 -------------------------------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark, make_docs, edge_rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=SPIECE)
    random.seed(5)
    more = ["\n", " a", "a ", "a  b", "a\n\nb \n c", "▁x", "<s> </s> <unk> <0x41>", "日本語テキスト", "\tx\t\ty", "a" * 3000, "   \n   ", "\n\n\n"]
    more += ["".join(random.choice(" ab\n\t é▁x.,") for _ in range(40)) for _ in range(300)]
    rows = edge_rows + [(100 + k, t) for k, t in enumerate(more)]
    got = token_counts.token_counts(make_docs(rows), SPIECE).collect()
    want = [(r[0], len((r[1] or "").encode()), n, n > 4096) for r, n in ((r, len(library.encode(r[1] or ""))) for r in rows)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert any(w[3] for w in want)


def test_merge_cache_is_emptied_not_wrong(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 3)
    counter = token_counts.MergeCounter(SPIECE)
    text = "one two three four five six seven eight one two three four"
    assert counter.count(text) == token_counts.MergeCounter(SPIECE).count(text) and len(counter) <= 3


# --- 2 -------------------------------------------------------------------------------------------------------------


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        covered = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(r, covered) if not m)
        out.append((len(r), sum(covered), sum(1 for i, m in enumerate(covered) if m and (not i or not covered[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_deep_shallow_sort_and_common_prefixes():
    random.seed(3)
    for shallow in (0, 1, 3, 12):
        for _ in range(60):
            strings = list({bytes(random.choice(b"ab") for _ in range(random.randint(0, 30))) for _ in range(random.randint(2, 60))})
            got = suffix_dedup.deep_shallow(strings, list(range(len(strings))), 0, shallow)
            assert [strings[k] for k, _ in got] == sorted(strings)
            assert all(p == suffix_dedup.common(strings[a], strings[b]) for (a, _), (b, p) in zip(got, got[1:]))


@pytest.mark.parametrize("length,gram,hot,size", [(20, 8, 1000, 1 << 20), (24, 9, 2, 1 << 20), (20, 8, 3, 100)])
def test_repeated_strings_equal_brute_force(make_docs, monkeypatch, length, gram, hot, size):
    monkeypatch.setattr(suffix_dedup, "SLICE", size)
    random.seed(length)
    words = ["".join(random.choice("abcdé") for _ in range(random.randint(2, 6))) for _ in range(60)]
    passages = [" ".join(random.choices(words, k=random.randint(3, 9))) for _ in range(8)]
    texts = []
    for _ in range(90):
        t = " ".join(random.choices(words, k=random.randint(0, 20)))
        for _ in range(random.randint(0, 2)):
            t += random.choice(["", " "]) + random.choice(passages) + " ".join(random.choices(words, k=random.randint(0, 6)))
        texts.append(t)
    texts += texts[:10] + ["", None, "a" * 44, "ab" * 20, "x" * (length - 1), "a" * 300, "b" + "a" * (length + 1) + "c", "abc" * 200, "q" * 20 + "abc" * 9] + [texts[5]] * 5
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(make_docs(list(enumerate(texts))), length, gram, hot).collect()}
    assert [(got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) for k in range(len(texts))] == brute_repeats(texts, length)
    assert all(sum(e - a for a, e in r.spans) == r.n_removed for r in got.values())


def test_repeated_strings_of_edge_rows(make_docs, edge_rows):
    rows = [*edge_rows, (12, "abc " * 300), (13, "x" + "lorem ipsum dolor " * 3)]
    got = suffix_dedup.suffix_dedup(make_docs(rows)).drop("spans")
    want = [(r[0], *b) for r, b in zip(rows, brute_repeats([r[1] for r in rows], 200))]
    assert rows_of(got) == sorted(want, key=repr)


def test_very_long_texts_leave_nothing_behind(spark, make_docs):
    from pagesearch.llm.common import set_checkpoint_dir

    random.seed(31)
    own = " ".join(f"w{random.randrange(10**6)}" for _ in range(600_000))
    folder = set_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    texts = ["a" * 1_000_000, "x" * 50 + "a" * 210 + "y" * 50, own + own[1000:3000]]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(make_docs(list(enumerate(texts)))).collect()}
    assert got == {0: (1_000_000, 1), 1: (210, 1), 2: (4000, 2)}
    assert not spark.sql("SHOW TABLES").collect() and all(x.startswith("rdd-") for x in set(os.listdir(folder)) - before)


# --- 3 -------------------------------------------------------------------------------------------------------------


def mixing_rows():
    random.seed(9)
    return [(k, "x" * random.randint(0, 400), random.choice(["en", "de", "fr", "es", None]), random.choice(["src0"] * 6 + [f"src{i}" for i in range(12)] + [None, "odd"])) for k in range(300)] + [(5, "again", "en", "src0")] * 3


@pytest.mark.parametrize("digits,steps", [(2, 4), (1, 1), (1, 0)])
def test_mixing_equals_sql(make_docs, monkeypatch, digits, steps):
    monkeypatch.setattr(source_mixing, "DIGITS", digits)
    monkeypatch.setattr(source_mixing, "STEPS", steps)
    rows = mixing_rows()
    same(source_mixing.source_mixing(make_docs(rows)), source_mixing.sql(), **documents(rows))


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaf = "domain string, lang string, source string, supply long"
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "1", 1000), ("b", "x", "1", 1000)], leaf)
    got = {(r.domain, r.lang, r.source): r.budget for r in source_mixing.leaf_budgets(leaves, 800, {}, 1).collect()}
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 190, ("a", "y", "1"): 200, ("b", "x", "1"): 400}
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 20), ("a", "y", "1", 1000), ("b", "x", "1", 100)], leaf)
    got = {(r.domain, r.lang, r.source): r.budget for r in source_mixing.leaf_budgets(leaves, 800, {}, 1).collect()}
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 20, ("a", "y", "1"): 670, ("b", "x", "1"): 100}


def test_mixing_of_edge_rows(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    assert source_mixing.source_mixing(docs, percent=100, max_epochs=1).filter("times = 1").count() == len(edge_rows)  # whole epochs take empty texts too
    kept = source_mixing.mixed(docs, percent=200, max_epochs=2)
    assert kept.columns == docs.columns and kept.count() == 2 * len(edge_rows)


# --- 4 -------------------------------------------------------------------------------------------------------------


def smith_waterman(a, b):
    """Best local score, and the least number of words of b up to an end that has it."""
    p, best, end = decontamination.PENALTY, 0.0, 0
    row = [0.0] * (len(b) + 1)
    for x in a:
        new = [0.0]
        for j, y in enumerate(b):
            v = max(0.0, row[j] + (1 if x == y else -p), row[j + 1] - p, new[j] - p)
            new.append(v)
            if v > best or v == best and j + 1 < end:
                best, end = v, j + 1
        row = new
    return best, end


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(4)
    pairs = [(rng.integers(0, 5, rng.integers(1, 20)).astype("i4"), rng.integers(0, 5, rng.integers(1, 40)).astype("i4")) for _ in range(300)]
    got, end = decontamination.align([a for a, _ in pairs], [b for _, b in pairs])
    assert list(zip(got.tolist(), end.tolist())) == [smith_waterman(a.tolist(), b.tolist()) for a, b in pairs]


def decontamination_case():
    random.seed(6)
    words = [f"w{k}" for k in range(400)]
    say = lambda n: " ".join(random.choices(words, k=n))
    items = [(k, say(random.randint(12, 50))) for k in range(30)] + [(99, "Too few words"), (98, None), (97, " ... "), (96, "too  few, words"), (95, "w7"), (None, say(20))]
    docs = []
    for k in range(240):
        t = say(random.randint(0, 80))
        if k % 3 == 0:
            w = items[k % 30][1].upper().split()
            for i in range(len(w)):
                if random.random() < (k % 7) / 20:
                    w[i] = random.choice([random.choice(words), "", w[i] + ", " + random.choice(words)])
            t += "\n" + " ".join(w) + " " + say(10)
        docs.append((k, t))
    docs += [(300, items[3][1] + " and " + items[4][1]), (301, items[3][1]), (301, items[3][1]), (302, "too few of words"), (303, "not too few words"), (304, None), (None, items[5][1]), (None, "x " + items[6][1])]
    return docs, items


def brute_found(docs, items):
    """doc_id: (item_id, score, n_items, end_word), the best of the rows of one doc_id."""
    kept = {}
    for i, t in items:
        w = tuple(decontamination.words_of(t or ""))
        if i is not None and w:
            kept[w] = min(i, kept.get(w, i))
    out = {}
    for d, t in docs:
        words = decontamination.words_of(t or "")
        have = set(words)
        hits = []
        for w, i in kept.items():
            bound = 1.0 if len(w) < 5 else decontamination.SCORE
            if sum(x in have for x in w) >= bound * len(w):  # else no alignment can reach the bound
                score, end = smith_waterman(w, words)
                if score / len(w) >= bound:
                    hits.append((-score / len(w), i, end))
        if hits:
            best, n = out.get(d, ((0.0, 0, 0), 0))
            out[d] = min(best, min(hits)), max(n, len(hits))
    return {d: (i, -s, n, e) for d, ((s, i, e), n) in out.items()}


def brute_contaminated(docs, items):
    return set(brute_found(docs, items))


@pytest.mark.parametrize("bits", [decontamination.BITS, 10])  # with 10 the filter lets nearly every pair of words through
def test_contaminated_documents_equal_brute_force(spark, make_docs, bits):
    docs, items = decontamination_case()
    benchmark = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id bigint, text string, h string")
    found = decontamination.decontamination(make_docs(docs), benchmark, bits=bits)
    got = {r.doc_id: (r.item_id, r.score, r.n_items, r.end_word) for r in found.collect()}
    want = brute_found(docs, items)
    assert {d: (i, round(x, 6), n, e) for d, (i, x, n, e) in got.items()} == {d: (i, round(x, 6), n, e) for d, (i, x, n, e) in want.items()} and len(want) > 50
    assert got[300][2] == 2 and got[300][0] == 3 and got[301][1] == 1.0 and got[303] == (96, 1.0, 1, 4) and 302 not in got
    clean = decontamination.drop_contaminated(make_docs(docs), benchmark, bits=bits)
    assert sorted((r.doc_id, r.text) for r in clean.collect() if r.doc_id is not None) == sorted((d, t) for d, t in docs if d is not None and not brute_found([(d, t)], items)) if bits == 10 else clean.count() == sum(not brute_found([x], items) for x in docs)


def test_an_item_around_an_inserted_run_is_found(spark, make_docs):
    random.seed(16)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(36))) for k in range(8)]
    docs = []
    for k, t in items:
        w, run = t.split(), [f"o{random.randrange(50)}" for _ in range((k + 2) * 4)]
        docs.append((k, " ".join([*run, *w[:18], *run, *w[18:], *run])))
    got = {r.doc_id for r in decontamination.decontamination(make_docs(docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == brute_contaminated(docs, items) == set(range(8))


def test_no_edited_copy_is_lost(spark, make_docs):
    random.seed(17)
    common = [f"c{k}" for k in range(40)]
    say = lambda n: random.choices(common, k=n)
    items = [(k, [random.choice([f"r{random.randrange(300)}", random.choice(common)]) for _ in range(random.randint(5, 40))]) for k in range(25)]
    docs = []
    for d in range(400):
        w = list(items[d % 25][1])
        if d % 4 == 0:  # a word put in after each one, two or three
            every = 1 + d // 4 % 3
            w = [x for j, y in enumerate(w) for x in ([y, random.choice(common)] if j % every == every - 1 else [y])]
        elif d % 4 == 1:  # any edits
            w = [x for y in w for x in random.choice([[y]] * 7 + [[y, *say(2)], [], say(1)])]
        elif d % 4 == 2:  # cut off
            w = w[: -(-len(w) * 3 // 4)] if d % 8 == 2 else w[len(w) // 4 :]
        docs.append((d, " ".join([*say(d % 50), *w, *say(d % 30)])))
    items = [(k, " ".join(w)) for k, w in items]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_contaminated(docs, items)
    assert len(want) > 250
    assert {r.doc_id for r in decontamination.decontamination(make_docs(docs), benchmark).collect()} == want
    assert {r.doc_id for r in decontamination.drop_contaminated(make_docs(docs), benchmark).collect()} == {d for d, _ in docs} - want


@pytest.mark.parametrize("size", [decontamination.SLICE, 40, 7])
def test_keys_of_words_are_those_of_the_pattern(monkeypatch, size):
    monkeypatch.setattr(decontamination, "SLICE", size)
    monkeypatch.setattr(decontamination, "TOGETHER", 60)
    texts = ["", "ΑΣ", ", .", "Σ İstanbul ſ ß_9 ½ e\u0301a 東京\U00010400", "A b. c-d", "x y " * 40 + "end", "a" * 50 + " ab ba", "ba ab x"]
    words = [decontamination.words_of(t) for t in texts]
    got = [(k, row, place) for block in decontamination.blocks(texts) for k, row, place in zip(*(c.tolist() for c in block))]
    assert [r[1:] for r in got] == [(i, j) for i, w in enumerate(words) for j in range(len(w))]
    of: dict = {}
    for (key, _, _), word in zip(got, (w for x in words for w in x)):
        assert of.setdefault(word, key) == key
    assert len(set(of.values())) == len({w[:size] for w in of})


def test_decontamination_of_edge_rows(spark, make_docs, edge_rows):
    benchmark = spark.createDataFrame([(1, "no id here at all"), (2, "zebra quartz lemon cobalt und7"), (3, "id no"), (4, "...")], "item_id bigint, text string")
    docs = make_docs(edge_rows)
    assert decontamination.decontamination(docs, benchmark).count() == 0
    assert decontamination.drop_contaminated(docs, benchmark).count() == len(edge_rows)
    assert decontamination.decontamination(docs, benchmark.limit(0)).count() == 0


# --- 5 -------------------------------------------------------------------------------------------------------------


def toxic_case():
    random.seed(8)
    words = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(700):
        w = random.choices(words, k=random.randint(5, 60))
        bad = k % 6 == 0
        if bad:
            for _ in range(3):
                w[random.randrange(len(w))] = random.choice(["Vile", "NASTY", "foul"])
        docs.append((k, " ".join(w)))
        if k % 5:
            labels.append((k, 1, int(bad)))
    return docs, labels + [(None, 1, 1), (3, None, None), (9999, 1, 1)]


def test_toxicity_on_held_out_rows(spark, make_docs):
    docs, labels = toxic_case()
    got = toxicity.toxicity(make_docs(docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)


def plain_ftrl(examples):
    """FTRL-proximal with a dictionary of coordinates, one at a time."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        l1 = 0 if i == "bias" else toxicity.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for x, y in examples:
        x = [*x, "bias"]
        w = {i: weight(i) for i in x}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in x:
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA
            z[i] += g - sigma * w[i]
            n[i] += g * g
    return {i: weight(i) for i in z if weight(i) or i == "bias"}


def test_training_equals_plain_ftrl(spark, make_docs):
    docs, labels = toxic_case()
    docs, labels = docs[:200] + [(7, "one more row of an id that repeats")] * 3, [r for r in labels if r[0] is None or r[0] < 200]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = toxicity.examples(make_docs(docs), marks).collect()
    usable = {i for i, _, t in labels if i is not None and t is not None and i < 200 and zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(rows) == len(usable) and len(toxicity.examples(make_docs(docs), marks, 20).collect()) == 20
    rows.sort(key=lambda r: (r.place, bytes(r.x)))
    want = plain_ftrl([(np.frombuffer(r.x, "<i4").tolist(), r.y) for _ in range(toxicity.EPOCHS) for r in rows])
    at, w, bias = toxicity.train(make_docs(docs), marks)
    assert bias == pytest.approx(want.pop("bias")) and dict(zip(at.tolist(), w.tolist())) == pytest.approx(want, rel=1e-5) and len(want) > 3


def test_slots_are_those_of_words_pairs_and_skips():
    table = toxicity.WordHashes()
    at = toxicity.slots(toxicity.word_hashes("Alpha beta, GAMMA delta", table))
    assert [x.tolist() for x, _ in at] == [[0, 1, 2, 3], [0, 1, 2], [0, 1]]
    one = lambda text: {int(v) for _, s in toxicity.slots(toxicity.word_hashes(text, table)) for v in s}
    assert one("alpha beta gamma delta") == {int(v) for _, s in at for v in s} and one("alpha x gamma") & one("alpha y gamma") > one("alpha") | one("gamma")


def test_toxicity_ignores_held_out_labels(spark, make_docs):
    docs, labels = toxic_case()
    flipped = [(i, q, t if i is None or t is None or zlib.crc32(str(i).encode()) % 4 != 2 else 1 - t) for i, q, t in labels]
    score = lambda rows: rows_of(toxicity.toxicity(make_docs(docs), spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")))
    assert score(labels) == score(flipped)


def test_toxicity_of_edge_rows(spark, make_docs, edge_rows):
    docs, labels = make_docs(edge_rows), spark.createDataFrame([(5, 1, 1), (6, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert toxicity.toxicity(docs, labels).count() == len(edge_rows)
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    kept = toxicity.drop_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(edge_rows)


# --- 6 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("texts", [[], [[]], [[0], [], [1, 2, 3, 4, 5]], [[255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1] * 3, list(range(1000))]])
def test_variable_length_coding_round_trip(texts):
    v, counts = np.array([x for t in texts for x in t], "u4"), np.array([len(t) for t in texts], "i8")
    control, controls, payload, payloads = token_output.pack(v, counts)
    assert (token_output.unpack(control, payload, counts) == v).all()
    for k, t in enumerate(texts):
        own = control[controls[k] : controls[k + 1]], payload[payloads[k] : payloads[k + 1]]
        assert len(own[0]) == -(-len(t) // 4) and token_output.unpack(*own, counts[k : k + 1]).tolist() == t
        assert len(own[1]) == sum(max(1, -(-x.bit_length() // 8)) for x in t)


def encoder_texts():
    random.seed(2)
    texts = ["", " ", "  ", "\n", " a", "a ", "a  b", "a   b", "a\n\nb \n c", "a <|endoftext|> b", "x\n <|endoftext|>", "日本語 テキスト", "😀😀 é́", "it's we'll 's", "a\x1c b \x1c c", "a\x85 b", "y" * 500]
    texts += ["".join(random.choice(" ab\n\té'.1 ") for _ in range(14)) for _ in range(4000)]
    texts += ["".join(random.choice(" a\n\x1c\x85\u00a0\u3000<|endoftext|>é字") for _ in range(9)) for _ in range(3000)]
    return texts + [" ".join(random.choice(["ab", "Éaß", "ªb", "x²", "ǅ", "ɐb"]) + random.choice(["", ".", "!?", "\n", ".\nBé,", "\n\nc", "'s", "~`", "…", "4"]) for _ in range(6)) for _ in range(2000)]


@pytest.mark.parametrize("limit", [0, 50, 10**6])
def test_encoder_equals_the_library(limit):
    encoder, texts = token_output.Encoder(BYTES, limit), encoder_texts()
    want = [x.tolist() for x in encoder.encoded(texts)]
    for n in (1, 500, len(texts)):
        for k in range(0, len(texts), n) if n > 1 else range(40):
            ids, at = encoder(pa.array(texts[k : k + n]).slice(0))
            assert [ids[a:e].tolist() for a, e in zip(at, at[1:])] == want[k : k + n]
    ids, at = encoder(pa.array(texts).slice(100, 50))
    assert [ids[a:e].tolist() for a, e in zip(at, at[1:])] == want[100:150]


@pytest.mark.parametrize("together", [1, 30])
def test_long_texts_are_cut_without_a_trace(spark, make_docs, together):
    texts = [t for t in encoder_texts()[::40]] + [" ".join(encoder_texts()[20:90])]
    got = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in token_output.encode(make_docs(list(enumerate(texts))), BYTES, together).collect()}
    assert [got[k] for k in range(len(texts))] == [[*x.tolist(), 2] for x in token_output.Encoder(BYTES).encoded(texts)]


def brute_tokens(rows):
    from tokenizers import Tokenizer

    library, out, start = Tokenizer.from_file(BYTES), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_equal_the_library(make_docs, edge_rows):
    rows = [(r[0], r[1]) for r in edge_rows if r[0] is not None] + [(k, f"text number {k}") for k in range(1000, 1060)]
    random.shuffle(rows)
    got = token_output.token_output(make_docs(rows), BYTES).collect()
    assert sorted(map(tuple, got)) == sorted(brute_tokens(rows))


def test_token_files_of_null_and_equal_ids(make_docs):
    rows = [(None, "no id"), (3, "later"), (None, None), (1, "two words"), (1, "x"), (1, "x"), (1, "y"), (None, "no id")]
    got = [tuple(r) for r in token_output.token_output(make_docs(rows).repartition(3), BYTES).orderBy("start").collect()]
    assert [r[0] for r in got] == [None] * 3 + [1] * 4 + [3]
    sizes = {(i, c): n for i, _, n, c in brute_tokens(rows)}
    assert [(r[0], r[3]) for r in got if r[2] != sizes[r[0], r[3]]] == [] and [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert [r[2] for r in got if r[0] == 1] == [2, 2, 2, 3] and got[4][3] in (got[3][3], got[5][3])  # by length, equal texts together


def test_another_session_reads_the_token_files(spark, make_docs, edge_rows, tmp_path):
    rows = [(r[0], r[1]) for r in edge_rows if r[0] is not None]
    token_output.write_token_files(make_docs(rows), BYTES, str(tmp_path / "tokens"))
    assert sorted(os.listdir(tmp_path)) == ["tokens"] and sorted(os.listdir(tmp_path / "tokens")) == ["ranks", "texts"]
    got = token_output.read_token_files(spark.newSession(), str(tmp_path / "tokens")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_tokens(rows))


# --- 7, 8, 10 ------------------------------------------------------------------------------------------------------


def test_exact_dedup_equals_sql(make_docs, edge_rows):
    rows = [r for r in edge_rows if r[0] is not None and r[0] != 4] + [(20 + k, f"w {k % 7}") for k in range(50)]
    same(exact_dedup.exact_dedup(make_docs(rows).repartition(9)), exact_dedup.SQL, **documents(rows))


def test_exact_dedup_of_edge_rows(make_docs, edge_rows):
    got = exact_dedup.exact_dedup(make_docs(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    assert sorted((r.keep_id, r.group_size, r.kept) for r in got if r.doc_id == 4) == [(4, 2, False), (4, 2, True)]
    assert {r.keep_id for r in got if r.doc_id in (1, 2, 3)} == {3} and {r.keep_id for r in got if r.doc_id in (5, 6, 7)} == {6, 7}


def test_one_row_of_each_group_is_kept(make_docs):
    random.seed(41)
    texts = [" " * random.randrange(3) + f"t{random.randrange(12)}" + " " * random.randrange(3) for _ in range(200)] + ["hot"] * 150
    rows = [(random.choice([None, *range(60)]), t) for t in texts]
    got = exact_dedup.exact_dedup(make_docs(rows).repartition(7)).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups["".join(t.split())].append((-len(t), i is None, i or 0))
    want = {hashlib.sha256(t.encode()).hexdigest(): (min(g)[2] if not min(g)[1] else None, len(g)) for t, g in groups.items()}
    assert {(r.text_sha256, (r.keep_id, r.group_size)) for r in got} == set(want.items()) and len(got) == len(rows)
    assert sorted((r.text_sha256, r.doc_id) for r in got if r.kept) == sorted((h, i) for h, (i, _) in want.items())


def test_any_number_of_partitions_has_its_rounds():
    for fan_in in (2, 3, 8):
        for partitions in (1, 2, 200, 5000, 92_682, 10**6, 10**9):
            rounds = exact_dedup.rounds_for(partitions, fan_in)
            assert 2 <= rounds and fan_in**rounds <= exact_dedup.MOST_HOLDERS and (partitions < fan_in**2 or fan_in**rounds * fan_in >= min(partitions, exact_dedup.MOST_HOLDERS))


def test_a_list_that_was_saved_but_not_added_is_added(spark):
    array = url_filter.DigestArray([("block", "once.example", "/")])
    name = f"rules-{hashlib.sha256(array.packed).hexdigest()[:32]}"
    with open(os.path.join(SparkFiles.getRootDirectory(), name), "wb") as f:
        f.write(b"cut short")
    pages = spark.createDataFrame([(1, "http://a.once.example/x")], "page_id long, url string")
    for _ in range(2):
        assert url_filter.url_filter(pages, [("block", "once.example", "/")]).first().verdict == "block"


@pytest.mark.parametrize("rounds,fan_in", [(1, 2), (3, 2), (2, 3), (2, 8)])
def test_rounds_merge_sorted_runs(make_docs, monkeypatch, rounds, fan_in):
    monkeypatch.setattr(exact_dedup, "PIECE", 5)
    rows = [(k, f"t{k % 83}") for k in range(400)]
    from pagesearch.llm.common import Work

    docs = make_docs(rows).repartition(5)
    with Work(docs.sparkSession) as work:
        tree = exact_dedup.merge_runs(work.table(exact_dedup.digests(docs)), rounds, fan_in)
        assert tree._jdf.queryExecution().executedPlan().toString().count("shufflepartitionidpassthrough") == rounds
        parts = [[bytes(r.digest) for r in part] for part in tree.rdd.glom().collect()]
        got = {bytes(r.digest): (r.keep_id, r.group_size) for r in tree.collect()}
    assert got == {hashlib.sha256(f"t{k}".encode()).digest(): (k, 400 // 83 + (k < 400 % 83)) for k in range(83)}
    assert [h for part in parts for h in part] == sorted(got)  # a holder has one range, in order


@pytest.mark.parametrize("piece", [3, 50])
def test_merging_pieces_equals_a_dictionary(monkeypatch, piece):
    monkeypatch.setattr(exact_dedup, "PIECE", piece)
    rng = random.Random(piece)
    for _ in range(60):
        want, pieces = {}, []
        for _ in range(rng.randint(1, 5)):
            run = np.zeros(rng.randint(1, 40), exact_dedup.ENTRY)
            for k in range(len(run)):
                run[k] = (bytes([rng.randrange(9)] * 31 + [rng.choice([0, 5])]), rng.randrange(2), 7, -rng.randrange(3), rng.randrange(2), rng.randrange(5), rng.randrange(10**6), 1)
                key, best = (bytes(run[k]["digest"]), int(run[k]["check"])), tuple(int(run[k][c]) for c in exact_dedup._BEST)
                want[key] = min(best, want.get(key, (best, 0))[0]), want.get(key, (best, 0))[1] + 1
            run = exact_dedup.merged(run)
            pieces += [run[k : k + 4] for k in range(0, len(run), 4)]
        pieces.sort(key=lambda p: p["digest"][0])
        out = np.concatenate(list(exact_dedup.merge_pieces(iter(pieces))))
        assert {(bytes(x["digest"]), int(x["check"])): (tuple(int(x[c]) for c in exact_dedup._BEST), int(x["n"])) for x in out} == want and len(out) == len(want)


def test_license_scan_equals_sql(make_docs, edge_rows):
    texts, notices = license_scan.LICENSES, license_scan.NOTICES
    mit = texts["MIT"]
    rows = edge_rows + [(50, "Copyright (c) 2020 Someone\n\n" + mit), (51, "/*\n * " + mit.upper().replace("\n", "\n * ") + " */"), (52, mit + " x"), (53, "Licensed under the Apache Licence, Version 2.0"), (54, "copyright notice and this\n" + mit), (55, "(c) 2021 A\nall rights reserved.\n© 2020 B")]
    rows += [(56, "The MIT License (MIT)\n\nCopyright 2019 X\n" + mit), (57, texts["BSD-3-Clause"].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")), (58, "Boost Software License - Version 1.0 - August 17th, 2003\n" + texts["BSL-1.0"]), (59, texts["Unlicense"].replace("https", "http"))]
    rows += [(60, "prose.\n " + notices["GPL-3.0 line"].upper() + "\nmore\n# " + notices["MIT line"]), (61, "prose " + notices["MIT line"]), (62, notices["CC-BY-NC-4.0 line"])]
    got = license_scan.license_scan(make_docs(rows))
    same(got.filter("doc_id is not null and doc_id <> 4"), license_scan.SQL, **documents([r for r in rows if r[0] is not None and r[0] != 4]))
    assert {r.doc_id: r.license for r in got.collect() if r.license} == {50: "MIT", 51: "MIT", 53: "Apache-2.0 line", 56: "MIT", 57: "BSD-3-Clause", 58: "BSL-1.0", 59: "Unlicense", 62: "CC-BY-NC-4.0 line"}
    assert {r.doc_id: r.notices for r in got.collect() if r.notices} == {53: "Apache-2.0 line", 60: "GPL-3.0 line,MIT line", 62: "CC-BY-NC-4.0 line"}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no public licence texts here")
def test_digests_of_long_licenses(make_docs):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = {n: open(f"/usr/share/common-licenses/{f}", encoding="utf-8").read() for n, f in files.items() if os.path.exists(f"/usr/share/common-licenses/{f}")}
    got = {r.doc_id: r.license for r in license_scan.license_scan(make_docs([(k, t.replace("\n", "\r\n")) for k, t in enumerate(texts.values())])).collect()}
    assert [got[k] for k in range(len(texts))] == list(texts)


def test_url_filter_equals_sql(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://net", "http://net/", "http://example.net/en/", "http://example.com/de/1", "http://xexample.com/de/1", "http://a.b.org/fr/", "x://org?q/fr/", "http://a.org/fr", "http://u@b.net:80/", "ftp://x.net/a://b.org/fr/", "http://É.NET/ü"]
    pages = spark.createDataFrame([(k, u, "h", "x") for k, u in enumerate(urls)] + [(None, urls[5], "h", "x")], "page_id bigint, url string, html string, rule string")
    got = url_filter.url_filter(pages)
    same(got.filter("page_id is not null"), url_filter.SQL, p=("pages", ["page_id", "url"], list(enumerate(urls))))
    assert got.count() == len(urls) + 1


def test_very_long_urls(spark):
    host, path = "x." * 500_000 + "Example.COM", "/de/" + "y" * 1_000_000
    rows = [(1, f"http://{host}{path}"), (2, f"http://{host}/{path}"), (3, "http://" + "z" * 1_000_000 + ".net/"), (4, "http://" + "z" * 1_000_000 + "net/"), (5, "http://" + "." * 200_000 + "org/fr/")]
    got = {r.page_id: (len(r.host), len(r.path), r.rule, r.verdict) for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert got == {1: (1_000_011, 1_000_004, "example.com/de/", "block"), 2: (1_000_011, 1_000_005, None, "allow"), 3: (1_000_004, 1, "net/", "block"), 4: (1_000_003, 1, None, "allow"), 5: (200_003, 4, "org/fr/", "allow")}


def test_host_ends():
    for host in ("", "a", ".", "a..b", "a.b.c.d", ".net", "net.", "abc.net"):
        every, rest = [], host
        while rest:
            every.append(rest)
            rest = rest.partition(".")[2]
        for longest in range(8):
            assert url_filter.host_ends(host, longest) == [x for x in every if len(x) <= longest]


def test_url_rules_survive_collisions(monkeypatch, tmp_path):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda s, *_: len(s) % 3)
    array = url_filter.DigestArray([*url_filter.RULES, ("block", "x.com", "/"), ("allow", "y.com", "/")])
    array.save(str(tmp_path / "rules"))
    opened = url_filter.OpenDigestArray(str(tmp_path / "rules"), array.n)
    assert [opened.rule(k) if k >= 0 else None for k in opened.find([b"x.com/", b"y.com/", b"z.com/", b"net/"])] == ["x.com/", "y.com/", None, "net/"]
    with pytest.raises(ValueError):
        url_filter.DigestArray(url_filter.RULES, max_bytes=10)


# --- 9 -------------------------------------------------------------------------------------------------------------


word_runs = simhash.word_runs


def brute_fingerprint(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_components(ids, fps):
    label = list(range(len(ids)))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    f = np.array(fps, "u8")
    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f[k + 1 :] ^ f[k]) <= 4):
            label[find(k + 1 + int(j))] = find(k)
    least = {}
    for k, i in enumerate(ids):
        r = find(k)
        least[r] = i if least.get(r) is None else min(least[r], i if i is not None else least[r])
    return [least[find(k)] for k in range(len(ids))]


def brute_minima(text):
    """The minima of a text's five-word shingles, one integer after another."""
    words, top = text.encode().lower().split(), (1 << 64) - 1
    grams = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))] if words else []
    factors, masks = simhash._FACTORS.tolist(), simhash._MASKS.tolist()
    five = [(a * int(simhash.FIRST_OF_TWO) + b) & top for a, b in zip(grams, grams[1:])] if len(grams) > 1 else grams
    return [min([((x ^ m) * f) & top for x in five], default=top) for m, f in zip(masks, factors)]


def shingles_of(text):
    words = text.encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_similar(a, b):
    return bool(a | b) and len(a & b) * 5 >= len(a | b) * 4


def brute_kept(rows):
    """The rows of (doc_id, text, ...) with different ids that stay, one for each component of both kinds of links."""
    fps, sets = [brute_fingerprint(r[1] or "") for r in rows], [shingles_of(r[1] or "") for r in rows]
    label = list(range(len(rows)))
    for k in range(len(rows)):
        for j in range(k):
            if label[k] != label[j] and ((fps[k] ^ fps[j]).bit_count() <= 4 or brute_similar(sets[k], sets[j])):
                label = [label[j] if x == label[k] else x for x in label]
    least = {}
    for r, x in zip(rows, label):
        least[x] = min(least.get(x, r[0]), r[0])
    return [r for r, x in zip(rows, label) if r[0] == least[x]]


def near_copies():
    random.seed(12)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for g in range(25):
        base = random.choices(words, k=random.randint(30, 300))
        for _ in range(random.randint(1, 9)):
            w = list(base)
            for _ in range(random.randint(0, 3)):
                w[random.randrange(len(w))] = random.choice(words)
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    return rows


def test_components_equal_brute_force(make_docs, edge_rows):
    rows = near_copies() + [(2000 + (r[0] or 50), *r[1:]) for r in edge_rows]
    got = simhash.simhash_components(make_docs(rows)).collect()
    fps = [brute_fingerprint(r[1] or "") for r in rows]
    want = zip((r[0] for r in rows), (f"{f:016x}" for f in fps), brute_components([r[0] for r in rows], fps))
    assert sorted(map(tuple, got)) == sorted(want)


def test_divided_buckets_give_the_same_components(make_docs, monkeypatch):
    rows = near_copies()
    whole = rows_of(simhash.simhash_components(make_docs(rows)))
    monkeypatch.setattr(simhash, "DIVIDE", 3)
    assert rows_of(simhash.simhash_components(make_docs(rows), split=2)) == whole


def test_fingerprint_of_texts_in_runs(monkeypatch):
    random.seed(14)
    texts = ["", " ", "a", "a b c", " a b c d ", "x" * 50 + " b c d e"] + [" ".join("w" * random.randint(1, 9) + str(random.randrange(50)) for _ in range(n)) + " " * (n % 3) for n in range(3, 90)]
    for size in (1, 7, 40):
        monkeypatch.setattr(simhash, "word_runs", lambda t, size=size, f=word_runs: f(t, size=size))
        assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_one_row_of_each_component_stays(make_docs):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (5, c), (5, c), (None, c), (None, "no id"), (None, "no id"), (7, None), (7, "")]
    docs = make_docs(rows).repartition(3)
    got = simhash.one_of_each(docs)
    assert simhash.one_of_each(docs.limit(0)).count() == 0
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=str) == sorted([(1, a), (2, b), (5, c), (None, "no id"), (7, "")], key=str)


def edited(words, share, rng):
    """A copy with that share of words replaced, at random places."""
    return [f"new{rng.randrange(1000)}" if rng.random() < share else w for w in words]


def jaccard(a, b):
    a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def test_similar_texts_leave_one(make_docs):
    rng = random.Random(31)
    rows = []
    for g in range(30):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randint(60, 400))]
        rows += [(len(rows) * 7 % 1009 + 10_000 * k, " ".join(w)) for k, w in enumerate([base] + [edited(base, rng.choice([0.01, 0.02, 0.1]), rng) for _ in range(rng.randint(0, 6))])]
    rows += [(50_000 + k, t) for k, t in enumerate(["", "a", "a b c d", "A  b c d", "a b c d e", "a b c d e f"])]
    want = brute_kept(rows)
    assert len(want) < len(rows) - 40
    assert rows_of(simhash.one_of_each(make_docs(rows).repartition(3)).select("doc_id", "text")) == sorted(want, key=repr)


@pytest.mark.parametrize("block", [3, 8, 1 << 14])
def test_chosen_pairs_join_similar_texts_and_no_others(spark, block):
    """All pairs of similar texts are joined, by chains of pairs that are similar by their shingles."""
    rng = random.Random(32)
    texts = []
    for g in range(120):
        base = [f"g{g % 90}w{rng.randrange(3000)}" for _ in range(rng.randint(30, 200))]
        texts += [" ".join(base), *(" ".join(edited(base, rng.choice([0.01, 0.02, 0.025, 0.03, 0.06]), rng)) for _ in range(rng.randint(1, 7)))]
    template = [f"t{k}" for k in range(150)]
    texts += [" ".join([*template[:-3], *(f"own{k}x{j}" for j in range(3))]) for k in range(150)]
    numbered = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    docs = numbered.withColumnRenamed("row", "doc_id").withColumn("row", F.col("doc_id"))
    from pagesearch.llm.common import Work

    with Work(spark) as work:
        rows = work.table(simhash.fingerprints(docs, "row", minima=True))
        fp = {r.row: r.fp for r in rows.collect()}
        edges = [(r.a, r.b) for r in simhash.similar_links(rows, numbered, work, block).collect()]
        met = simhash.meetings(rows.select(F.col("row").alias("id"), "minima"), work, block).count()
    assert met <= (simhash.RING + 2 * simhash.GROUPS) * len(texts)
    of = {f: k for k, f in fp.items()}
    sets = [shingles_of(t) for t in texts]
    assert all(brute_similar(sets[of[a]], sets[of[b]]) for a, b in edges)
    label = {f: f for f in of}
    for a, b in edges:
        if label[a] != label[b]:
            old, new = label[a], label[b]
            label = {f: new if x == old else x for f, x in label.items()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i].split()[0] == texts[j].split()[0] or (i >= len(texts) - 150 and j >= len(texts) - 150) or abs(i - j) < 9]
    alike = [(i, j) for i, j in pairs if brute_similar(sets[i], sets[j])]
    joined = sum(label[fp[i]] == label[fp[j]] for i, j in alike)
    assert len(alike) > 11_000 and joined >= (0.99 if block > 8 else 0.97) * len(alike)
    few = [(i, j) for i, j in alike if i < len(texts) - 150]
    assert sum(label[fp[i]] == label[fp[j]] for i, j in few) >= (0.97 if block > 8 else 0.9) * len(few)


def test_minima_of_texts_in_runs(monkeypatch):
    random.seed(15)
    texts = ["", " ", "a", "a b c", " a b c d ", "a b c d e"] + [" ".join("w" * random.randint(1, 9) + str(random.randrange(50)) for _ in range(n)) for n in (6, 40, 700)]
    for size in (1, 7, 40, 1 << 20):
        monkeypatch.setattr(simhash, "word_runs", lambda t, size=size, f=word_runs: f(t, size=size))
        for t in texts:
            assert simhash.fingerprint_and_minima(t) == (brute_fingerprint(t), simhash.packed(np.array(brute_minima(t), "u8")))


def test_chain_keys_are_equal_where_chains_are():
    rng = np.random.default_rng(9)
    for _ in range(300):
        a, b = rng.integers(0, 3, (2, simhash.MINIMA), dtype="u8")
        x, y = (np.frombuffer(simhash.packed(v)[: 8 * simhash.RING], "u8") for v in (a, b))
        chains = [all(a[(k + j) % simhash.RING] == b[(k + j) % simhash.RING] for j in range(simhash.CHAIN)) for k in range(simhash.RING)]
        assert (x == y).tolist() == chains


def test_bucket_edges_join_what_links_join(monkeypatch):
    rng = np.random.default_rng(1)
    for divide in (4096, 5):
        monkeypatch.setattr(simhash, "DIVIDE", divide)
        base = rng.integers(0, 1 << 63, 12, dtype="u8")
        fps = np.unique(np.concatenate([base ^ sum((np.uint64(1) << np.uint64(b) for b in rng.integers(13, 64, n)), np.uint64(0)) for n in rng.integers(0, 6, 30)]) & ~np.uint64(0x1FFF))
        edges = [(int(a), int(b)) for x, y in simhash.bucket_edges(fps, 0) for a, b in zip(x, y)]
        assert all((a ^ b).bit_count() <= 4 for a, b in edges) and len(edges) < (25 if divide == 5 else 1) * len(fps)
        parent = {int(f): int(f) for f in fps}

        def find(x):
            return x if parent[x] == x else find(parent[x])

        for a, b in edges:
            parent[find(a)] = find(b)
        for i, a in enumerate(fps):
            for b in fps[i + 1 :]:
                if simhash.linked(np.array([a ^ b]), 0)[0]:
                    assert find(int(a)) == find(int(b))


def test_chains_miss_no_pair(spark):
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 63, 4000, dtype="u8")
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, len(b)).astype("u8")
    assert np.logical_or.reduce([simhash.linked(a ^ b, s) for s in range(5)]).all()
    both = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a[:500].view("i8"), b[:500].view("i8"))], "x long, y long")
    from pyspark.sql import functions as F

    shared = both.select(F.arrays_overlap(F.array(*simhash.chain_keys(F.col("x"))), F.array(*simhash.chain_keys(F.col("y")))).alias("s"))
    assert shared.filter("not s").count() == 0


def test_star_contraction_of_a_long_path(spark):
    n = 60
    edges = spark.createDataFrame([(k * 7 % n, (k + 1) * 7 % n) for k in range(n - 1)] + [(100, 101)], "a long, b long")
    from pagesearch.llm.common import Work

    with Work(spark) as work:
        got = {r.node: r.root for r in simhash.components(edges, work).collect()}
    assert all(got[k] == 0 for k in range(1, n)) and got[101] == 100


# --- all -----------------------------------------------------------------------------------------------------------


def test_empty_tables(spark, make_docs):
    none = make_docs([(1, "x")]).limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "some words that are an item")], "item_id bigint, text string")
    pages = spark.createDataFrame([], "page_id bigint, url string")
    results = [token_counts.token_counts(none, SPIECE), suffix_dedup.suffix_dedup(none), source_mixing.source_mixing(none), decontamination.decontamination(none, benchmark), toxicity.toxicity(none, labels), token_output.token_output(none, BYTES), exact_dedup.exact_dedup(none), license_scan.license_scan(none), simhash.simhash_components(none), url_filter.url_filter(pages)]
    assert [df.count() for df in results] == [0] * 10


# --- 11 ------------------------------------------------------------------------------------------------------------


def phrase_rows():
    random.seed(21)
    words = ["The", "cat", "of", "é", "MAT", "a|b", "x\x1cy", "日本"]
    texts = ["".join(random.choice(words) + random.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ! "]) for _ in range(random.randint(0, 60))) for _ in range(120)]
    return [(k, t, random.choice(["en", "en", "en", "de", None, "und"])) for k, t in enumerate(texts)]


@pytest.mark.parametrize("least,share,top,size", [(3, 80, 2000, 1 << 21), (2, 60, 15, 7), (4, 95, 40, 1)])
def test_collocations_equal_sql(make_docs, edge_rows, least, share, top, size):
    rows = phrase_rows() + [r for r in edge_rows if len(r[1] or "") < 1000] + [(5, "of the cat of the cat", "en")] * 3
    same(collocations.collocations(make_docs(rows), least, share, top=top, together=500, size=size), collocations.sql(least, share, top=top), **documents([(*r[:2], r[2] if len(r) > 2 else "en", "s") for r in rows]))


def test_collocations_of_long_texts_and_none(make_docs, edge_rows):
    rows = [*edge_rows, (77, "one two three four. " * 200_000), (78, "w" * 3_000_000), (79, "ja nein " * 100, "")]
    same(collocations.collocations(make_docs(rows)), collocations.sql(), **documents([(*r[:2], r[2] if len(r) > 2 else "en", "s") for r in rows]))
    assert collocations.collocations(make_docs([])).collect() == [] and collocations.collocations(make_docs([(1, None), (2, "few words")])).collect() == []


def test_scores_beyond_64_bits(spark):
    n = 1 << 58
    row = spark.sql(f"select {n}L as a, {n + 3}L as b").select(collocations._score(F.col("a"), F.col("b"), 2_000_000).alias("s")).first()
    assert row.s == 2_000_000 * n // (n + 3)


# --- 12 ------------------------------------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def quality_rows():
    random.seed(12)
    words = ["the", "of", "and", "in", "with", "Haus", "été", "house", "garden", "walks", "river", "sleeps"]
    sentence = lambda: " ".join(random.choice(words) + str(random.randint(0, 40)) * (random.random() < 0.3) for _ in range(12)).capitalize() + "."
    good = ["\n".join(" ".join(sentence() for _ in range(3)) for _ in range(random.randint(2, 6))) for _ in range(120)]
    bad = [" ".join(random.choice(words).upper() + "!!" for _ in range(80)) for _ in range(15)]
    bad += [" ".join(sentence().replace(" ", "### ") for _ in range(8)) for _ in range(15)]
    bad += ["\n".join(["| a | b | 1 | 2 |"] * 20) for _ in range(5)]
    return good, bad


@pytest.mark.parametrize("together", [1, 2000, 8 << 20])
def test_quality_counts_equal_brute_force(make_docs, edge_rows, together):
    random.seed(4)
    odd = ["".join(random.choice("ab \n\t\r\x0b#|é") for _ in range(random.randint(0, 60))) for _ in range(200)]
    good, bad = quality_rows()
    rows = [*edge_rows, *((100 + k, t) for k, t in enumerate(odd + good + bad + ["a b c a b c", "a a a a", "b c", "a b c", "x\n x\n\nx\n \n"]))]
    got = quality_rules.text_counts(make_docs(rows), together).select("doc_id", *quality_rules.COUNTS[:5])
    assert rows_of(got) == sorted(((r[0], *brute_counts(r[1])) for r in rows), key=repr)


def test_quality_keeps_good_texts_and_drops_bad_ones(make_docs, edge_rows):
    good, bad = quality_rows()
    rows = [*((k, t) for k, t in enumerate(good)), *((1000 + k, t) for k, t in enumerate(bad)), *((2000 + r[0] if r[0] else None, r[1]) for r in edge_rows)]
    got = {}
    for r in quality_rules.quality_rules(make_docs(rows)).collect():
        got.setdefault(r.doc_id, r)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed and r.quality >= 0.5)
    assert all(got[k].kept for k in range(len(good))) and not any(got[1000 + k].kept for k in range(len(bad)))
    assert not got[2001].kept and not got[2002].kept and got[2001].n_words == 0
    assert quality_rules.quality_rules(make_docs([])).collect() == []


def test_accuracies_equal_expectation_maximisation_row_by_row():
    random.seed(8)
    truth = [random.random() < 0.8 for _ in range(4000)]
    rates = [(0.95, 0.9, 0.1), (0.8, 0.7, 0.4), (0.9, 0.6, 0.0), (0.7, 0.9, 0.2), (0.6, 0.6, 0.5)]
    rows = ["".join("-" if random.random() < skip else str(int((random.random() < (good if t else 1 - bad)))) for good, bad, skip in rates) for t in truth]
    patterns = collections.Counter(rows)
    found = quality_rules.Fitted(list(patterns), list(patterns.values()))
    assert 1 < found.rounds < quality_rules.ROUNDS and abs(found.prior - 0.8) < 0.05
    assert all(abs(g - rate[0]) < 0.06 for g, rate in zip(found.good, rates))
    posterior = [(sum(c == "1" for c in r) + 0.5) / (sum(c != "-" for c in r) + 1) for r in rows]
    for _ in range(found.rounds):
        prior = (sum(posterior) + 1) / (len(rows) + 2)
        acc = []
        for j in range(5):
            voted = [(p, r[j]) for p, r in zip(posterior, rows) if r[j] != "-"]
            acc.append(((sum(p for p, v in voted if v == "1") + 2) / (sum(p for p, _ in voted) + 3), (sum(1 - p for p, v in voted if v == "0") + 2) / (sum(1 - p for p, _ in voted) + 3)))
        new = []
        for r in rows:
            a, b = prior, 1 - prior
            for (g, w), v in zip(acc, r):
                a *= 1 if v == "-" else g if v == "1" else 1 - g
                b *= 1 if v == "-" else 1 - w if v == "1" else w
            new.append(a / (a + b))
        posterior = new
    known = dict(zip(patterns, found.posterior))
    assert max(abs(known[r] - p) for r, p in zip(rows, posterior)) < 1e-6
    assert sum((known[r] >= 0.5) == t for r, t in zip(rows, truth)) / len(rows) > 0.93


# --- 13 ------------------------------------------------------------------------------------------------------------


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=SPIECE)
    a_side.encode_special_tokens = True
    of_char = token_alignment.byte_level()

    def piece(i):
        m = re.fullmatch("<0x([0-9A-F]{2})>", b_side.id_to_piece(i))
        return bytes([int(m[1], 16)]) if m else b_side.id_to_piece(i).replace("▁", " ").encode()

    found, count = [], collections.Counter()
    for doc, text in rows:
        groups, links, a, b = [], [], [], []
        if text:
            a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
            sides = [bytes(of_char[c] for c in a_side.id_to_token(i)) for i in a], [piece(i) for i in b]
            if any(b"".join(s) != (" " + text).encode() for s in sides):
                a, b = [], []
            ends = [np.cumsum([len(x) for x in s]) for s in sides]
            i = j = 0
            while i < len(a):
                if not groups or ends[0][i - 1] == ends[1][j - 1] and i and j:
                    groups.append(([], []))
                groups[-1][0].extend([i] if i not in groups[-1][0][-1:] else [])
                groups[-1][1].extend([j] if j not in groups[-1][1][-1:] else [])
                links.append((a[i], b[j]))
                x, y = ends[0][i], ends[1][j]
                i, j = i + (x <= y), j + (y <= x)
        count.update(links)
        found.append((doc, a, b, groups, links))
    top = collections.defaultdict(int)
    for (x, y), n in count.items():
        top[y] = max(top[y], n)
    out = []
    for doc, a, b, groups, links in found:
        text = ";".join(",".join(str(a[i]) for i in g) + "|" + ",".join(str(b[j]) for j in h) for g, h in groups)
        out.append((doc, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("together", [1, 700, 8 << 20])
def test_alignment_equals_brute_force(make_docs, edge_rows, together):
    random.seed(6)
    texts = ["\n", " a", "a ", "a  b", "a\n\nb \n c", "▁x", "x▁ y", "<s> </s> <unk> <0x41> <|endoftext|>", "日本語テキスト", "\tx\t\ty", "a" * 3000, "   \n   ", "\n\n\n", " ", "  ", "\n ", "x\x1c y", "a\x85 b", "a\xa0 b \xa0c", "x\n \ny", "don't we'll", "　 a", "a \nb", "é" * 50, "\x00 a", "👩‍👩‍👧 ﷽"]
    texts += ["".join(random.choice(" ab\n\t é　x.,1'") for _ in range(40)) for _ in range(150)]
    rows = [*((r[0], (r[1] or "")[:4000] if r[1] is not None else None) for r in edge_rows), *((100 + k, t) for k, t in enumerate(texts))]
    assert rows_of(token_alignment.token_alignment(make_docs(rows), BYTES, SPIECE, together)) == brute_alignment(rows)


def test_alignment_of_long_texts_and_none(make_docs, edge_rows):
    rows = [*edge_rows, (50, "ab" * 300_000), (51, "wort für wort. " * 100_000)]
    assert rows_of(token_alignment.token_alignment(make_docs(rows), BYTES, SPIECE)) == brute_alignment([r[:2] for r in rows])
    assert token_alignment.token_alignment(make_docs([]), BYTES, SPIECE).collect() == []
    assert [tuple(r) for r in token_alignment.token_alignment(make_docs([(None, None), (None, "")]), BYTES, SPIECE).collect()] == [(None, 0, 0, 0, 0, 0, 0, "")] * 2


def test_union_find_joins_what_links_reach():
    random.seed(2)
    for _ in range(50):
        n = random.randint(1, 60)
        links = [(random.randrange(n), random.randrange(n)) for _ in range(random.randint(0, 70))]
        least = list(range(n))
        for _ in range(n):
            for x, y in links:
                least[x] = least[y] = min(least[x], least[y])
        got = token_alignment.joined(n, *(np.array([p[k] for p in links], "i8") for k in range(2)))
        assert got.tolist() == least
