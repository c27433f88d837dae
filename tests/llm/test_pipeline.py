import random

import corpus_pipeline
import pytest

from tidemark.llm.common import stage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text_of(seed, n=60):
    g = random.Random(seed)
    return " ".join(g.choice("the of and wind river stone house green light walks over under small old new".split()) + g.choice(["", "s", "ing", "ed"]) for _ in range(n))


def test_stages_keep_their_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    n = docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, small), name)
        assert docs.columns == corpus_pipeline.COLUMNS and 0 < docs.count() <= n
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert packed.select("doc_id").distinct().count() == n


def test_whole_run_and_empty_table(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
    none = spark.read.parquet(f"{small}/documents.parquet").filter("false")
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, none, small).count() == 0


def test_near_duplicates_go_by_row(spark, small):
    """Ids that repeat or are null neither lose a text nor keep a copy."""
    a, b = text_of(1), text_of(2)
    rows = [(1, a), (2, a + " more"), (2, b), (3, b + " more"), (None, a), (7, text_of(3)), (7, text_of(3)), (8, None), (8, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, df, small).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, a), (2, b), (7, text_of(3)), (8, None), (8, "")], key=str)


def test_nulls_repeats_and_other_columns_in_every_stage(spark, small):
    rows = [(i, text_of(100 + i), "en" if i % 3 else None, "s", 1) for i in range(40)]
    rows += [(None, text_of(300), None, None, None), (5, text_of(105), "en", "s", 1), (50, None, "en", "s", 0), (51, "", "en", "s", 0), (52, "12 34 !!", "en", "s", 0), (53, "Москва является столицей", None, "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS component_id", "7 AS _row", "1 AS h", "'y' AS lang_pred")
    kept = stage(corpus_pipeline.identify_language(spark, docs, small), "t")
    assert {r.doc_id for r in kept.collect()} == {*range(40), None}
    lines = stage(corpus_pipeline.drop_repeated_lines(spark, kept.selectExpr("*", "1 AS _row", "'z' AS k"), small), "t")
    near = stage(corpus_pipeline.drop_near_duplicates(spark, lines.selectExpr("*", "1 AS _row", "'z' AS component_id"), small), "t")
    assert near.count() == 41 and near.columns == corpus_pipeline.COLUMNS
    packed = corpus_pipeline.pack_sequences(spark, near.selectExpr("*", "1 AS piece", "2 AS length"), small).collect()
    assert len({r.doc_id for r in packed}) == 41


@pytest.mark.parametrize("name", ["op1_token_store", "op3_ngram_join", "op10_chat_windows"])
def test_queries_are_registered(spark, small, name):
    import __spark_entry__

    assert __spark_entry__.queries()[name](spark, small).count() >= 20
