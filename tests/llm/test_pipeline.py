"""The pipeline against a plain version of its stages."""

import corpus_pipeline

from foliospark.llm import quality_model, quality_rules
from tests.llm.test_corpus_operators import junk, near_copies, similar

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, tmp_path, rows, labels):
    spark.createDataFrame([(k, t, "en", "s", None) for k, t in rows], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, q, 0) for k, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return f"{tmp_path}"


def test_stages_are_the_plain_ones(spark, tmp_path):
    rows, labels = junk(150)
    rows += [(10_000 + i, t) for i, (_, t) in enumerate(rows[:40])] + [(None, rows[1][1]), (20_000, None), (20_001, ""), rows[2]]
    d = corpus(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    scores = {(r.doc_id): r.score for r in quality_model.score_documents(docs, spark.read.parquet(f"{d}/labels.parquet")).collect()}
    first = corpus_pipeline.classify(spark, docs, d)
    assert sorted(map(repr, first.select("doc_id").collect())) == sorted(repr(r) for r in docs.select("doc_id").collect() if scores[r.doc_id] >= 0.5)
    second = corpus_pipeline.apply_rules(spark, first, d)
    verdict = {r.doc_id: r.kept for r in quality_rules.measures(first).collect()}
    assert sorted(map(repr, second.select("doc_id").collect())) == sorted(repr(r) for r in first.select("doc_id").collect() if verdict[r.doc_id])
    third = corpus_pipeline.drop_similar(spark, second, d)
    kept = sorted(r.doc_id for r in third.collect())
    assert kept == sorted({c for _, _, _, c in similar([(r.doc_id, r.text) for r in second.collect()]) if c is not None})
    clean = {(r.doc_id, r.clean_text) for r in quality_rules.score_documents(first).collect()}
    assert {(r.doc_id, r.text) for r in second.collect()} <= clean and len({r.text for r in third.collect()}) == len(kept)
    for stage in (first, second, third):
        assert stage.columns == docs.columns
    pieces = corpus_pipeline.run(spark, d)
    assert sorted({r.doc_id for r in pieces.collect()}) == kept


def test_different_texts_under_one_key_stay(spark, tmp_path):
    rows = [(1, "some words that are the first text here"), (1, "quite another text under that very key"), (1, "some words that are the first text here"), (None, "a third one without any key"), (None, "a third one without any key")]
    docs = spark.createDataFrame([(k, t, "en", "s", None) for k, t in rows], COLUMNS)
    got = corpus_pipeline.drop_similar(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted({(k or 0, t) for k, t in rows})


def test_one_document_of_each_group_stays(spark, tmp_path):
    rows = near_copies(5)
    docs = spark.createDataFrame([(k, t, "en", "s", None) for k, t in rows], COLUMNS)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_similar(spark, docs, str(tmp_path)).collect())
    assert got == sorted({c for *_, c in similar(rows)})


def test_near_copies_under_one_key_are_one_group(spark, tmp_path):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = lambda t: t + " more"
    # 7 holds two near copies; 9 a near copy of what 3 holds, besides a text that is alone; 5 holds all of another group
    rows = [(7, a), (7, near(a)), (3, b), (9, near(b)), (9, c), (5, "some words of their own, in a line"), (5, "some words of their own, in a line"), (9, near(a))]
    docs = spark.createDataFrame([(k, t, "en", "s", None) for k, t in rows], COLUMNS)
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_similar(spark, docs, str(tmp_path)).collect())
    assert [k for k, _ in got] == [3, 5, 7, 9]
    assert got[0] == (3, b) and got[2][1] in (a, near(a)) and got[3] == (9, c)


def test_clashing_columns_and_rows_of_one_key(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(3, b, 1, "x", 2), (5, a, 1, "x", 2), (5, b, 1, "x", 2), (5, None, 1, "x", 2), (5, None, 1, "x", 2), (None, "", 1, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, number long, key string, component_id long")
    got = corpus_pipeline.drop_similar(spark, docs, "")
    assert got.columns == docs.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted({r[:2] for r in rows if r[:2] != (5, b)}, key=repr)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, corpus(spark, tmp_path, [], [])).count() == 0


def test_stages_in_order():
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "best-fit packing"]
    assert corpus_pipeline.ORACLE_SQL is None
