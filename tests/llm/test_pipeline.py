"""The pipeline against a version without Spark, and its registration."""

import random

import duckdb
import pandas as pd

import corpus_pipeline
from pagesearch.llm import source_mixing, toxicity
from pagesearch.llm.queries import ORACLE_SQL, QUERIES

from .test_operators import brute_contaminated, brute_kept, brute_tokens, decontamination_case, near_copies, toxic_case


def test_pipeline_equals_brute_force(spark, tmp_path):
    random.seed(21)
    toxic_docs, labels = toxic_case()
    leaked, items = decontamination_case()
    rows = toxic_docs[:300] + [(1000 + i, t) for i, t in leaked[:120]] + [(3000 + i, t) for i, t in near_copies()] + [(9000, None), (9001, "")]
    rows = [(i, t, random.choice(["en", "de", None]), random.choice(["src0", "src1", "src2", None]), len(t or "")) for i, t in rows]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([x for x in items if x[0] is not None], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    left = [r for r in rows if scorer(r[1] or "") < toxicity.THRESHOLD]
    assert 0 < len(rows) - len(left) < 100
    once = brute_kept(left)
    assert len(once) < len(left)
    bad = brute_contaminated([r[:2] for r in once], items)
    clean = [r for r in once if r[0] not in bad]
    assert bad
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": [r[0] for r in clean], "text": pd.Series([r[1] for r in clean], dtype="object"), "lang": pd.Series([r[2] for r in clean], dtype="object"), "source": pd.Series([r[3] for r in clean], dtype="object")}))
    taken = {r[0] for r in con.sql(f"SELECT doc_id FROM ({source_mixing.sql(max_epochs=1)})").fetchall()}
    assert 0 < len(taken) < len(clean)

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_tokens([r[:2] for r in clean if r[0] in taken]))


def test_stages_keep_columns(spark, make_docs, edge_rows, tmp_path):
    spark.createDataFrame([(5, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "an item of five words")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make_docs(edge_rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_every_operator_is_registered():
    import __spark_entry__

    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(__spark_entry__.queries()) and "pipeline" in __spark_entry__.queries()


def test_pipeline_of_empty_tables(spark, make_docs, tmp_path):
    make_docs([(1, "x")]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_is_missed_alone(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        entry = importlib.reload(__spark_entry__)
        assert "pipeline" not in entry.queries() and set(QUERIES) <= set(entry.queries())
    finally:
        monkeypatch.undo()
        assert "pipeline" in importlib.reload(__spark_entry__).queries()
