"""The pipeline on a small table, each stage against a plain statement of what it keeps."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, tmp_path):
    prose = "the quiet house by the river was sold to a young family in the year of the long rain number {}"
    rows = [(k, " ".join(prose.format(k * 7 + j) for j in range(4)), "en", f"s{k % 3}", None) for k in range(30)]
    rows += [(100, rows[0][1], "en", "s0", None), (101, "1234 ### 99", "en", "s0", None), (102, None, None, None, None), (103, rows[5][1] + ' token = "abcdef123456"', None, "s1", None)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    docs = spark.read.parquet(path)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)), name)
        kept[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name != "packing":
            assert out.columns == docs.columns
        if name == "secrets":
            assert out.where("text LIKE '%abcdef123456%'").count() == 0
        docs = out
    assert kept["language"] == {r[0] for r in rows} - {101, 102}
    assert 100 not in kept["near_dedup"] and kept["secrets"] == kept["near_dedup"]
    assert kept["packing"] == kept["mixing"] <= kept["secrets"]


def test_lettered_documents_stay_without_any_language(spark, tmp_path):
    rows = [(1, "a quiet house", None), (2, "ein leises Haus", ""), (3, "1234 ###", None), (4, None, None)]
    out = corpus_pipeline.by_language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), str(tmp_path)).collect()
    assert {(r["doc_id"], r["lang"]) for r in out} == {(1, None), (2, "")}


def test_rows_that_share_an_id_are_told_apart(spark, tmp_path):
    text = lambda word: " ".join(f"{word}{k}" for k in range(40))
    rows = [(1, text("a")), (1, text("b")), (2, text("b")), (3, text("c")), (3, text("a")), (3, text("c")), (None, text("a"))]
    out = corpus_pipeline.without_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in out) == [(0, "a"), (1, "a"), (1, "b"), (3, "c")]


STRANGE = ["score", "lang_pred", "topic", "tokens", "weight", "p", "sampled", "residual", "own", "row", "blob", "spans", "new", "draw", "component_id", "a.b"]


def test_stages_keep_columns_of_any_name_and_odd_rows(spark, tmp_path):
    """Null ids, repeated rows, a text of a megabyte and columns named as the stages' own go through; null and wordless texts don't."""
    prose = "the quiet house by the river was sold to a young family in the year of the long rain number {}"
    text = lambda k: " ".join(prose.format(k * 7 + j) for j in range(4))
    rows = [(k, text(k), "en", f"s{k % 3}", len(text(k)), k) for k in range(20)]
    rows += [(None, text(500), "en", "s0", 1, 7), (None, None, None, None, None, 7), (30, " ".join(f"word{k} river" for k in range(90_000)), "en", None, 5, 7), (31, "", "en", "s0", 0, 7)]
    rows += [(40, text(900), None, "s1", 2, 7)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, mark long")
    docs = docs.select("*", *[(docs.mark * 100 + k).alias(c) for k, c in enumerate(STRANGE)])
    expected = {r["doc_id"] for r in docs.collect()} - {31}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(r[c] == r["mark"] * 100 + k for r in found for k, c in enumerate(STRANGE))
        if name != "mixing":
            assert {r["doc_id"] for r in found} == expected
        docs = out
    assert corpus_pipeline.packed(spark, docs, str(tmp_path)).count() >= docs.count()


def test_an_empty_table_goes_through(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    docs = spark.read.parquet(path)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns and stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
