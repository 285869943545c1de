import pytest

#: Names that the operators use inside, here as columns of the input.
CLASHING = ["key", "h", "k", "n", "u", "fp", "run", "pos", "copies", "found", "digest", "best", "rest", "full", "cut", "bucket", "license", "score", "root", "node", "domain", "n_tokens", "tag", "gid", "chunk", "number", "word", "phrase", "votes", "quality", "n_words", "row", "a", "b", "count", "data", "__row", "__gone", "__other", "__leaf", "__copy", "__full", "__cut", "__domain", "__lang", "__source", "id", "fa", "fb", "minima", "least", "times", "best_score"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """docs(rows of (doc_id, text, lang, source)) with many more columns; fewer fields are filled."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1", len(r[1] or ""), *(["x"] * len(CLASHING))) for r in rows]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHING)
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, a very long one, repeated rows and ties."""
    long = " ".join(f"word{k % 977} und{k % 31}" for k in range(15000))
    return [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (5, "The cat sat on the mat."), (6, "The cat  sat on the mat."), (7, "thecatsatonthemat."), (None, "no id here"), (None, None), (8, long), (9, long + " end"), (10, "é😀 \x0b\x1c\x85 ﷽ ß", None, None), (11, "...")]
