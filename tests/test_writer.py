import json

from foliospark.operators.documents import merge_messages, written_documents
from foliospark.streaming.writer import DocumentsWriter

ROWS = [
    (1, "a", "header", "old"), (2, "a", "append", "x"), (3, "a", "balloon", "b1"), (4, "b", "pages", "3"), (5, "a", "header", "new"),
    (6, "a", "balloon", "b1"), (7, "b", "what", None), (8, "b", None, None), (9, "b", "finish", None), (10, None, "append", "y"),
]
SCHEMA = "seq long, doc string, kind string, payload string"


def test_batches_of_a_stream_give_the_state_of_the_whole(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame(ROWS[i * 4 : i * 4 + 4], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    running = DocumentsWriter(stream, f"file://{tmp_path}/out")
    running.query.awaitTermination()
    assert sorted(map(repr, running.current().collect())) == sorted(map(repr, merge_messages(spark.createDataFrame(ROWS, SCHEMA)).collect()))
    assert running.query.recentProgress[-1]["batchId"] == 2


def test_repeated_balloons_count_once_in_a_table(spark):
    got = {r.doc: r for r in merge_messages(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert (got["a"].title, got["a"].n_balloons, got["a"].n_appended) == ("new", 1, 1)
    assert (got["b"].pages, got["b"].n_unknown, got["b"].n_finish, got[None].n_appended) == ("3", 2, 1, 1)


def test_nothing_yet(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    running = DocumentsWriter(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"file://{tmp_path}/out")
    running.query.awaitTermination()
    assert running.current().count() == 0


def test_documents_keep_elements_and_order_pages(spark):
    rows = [
        (1, "a", "header", "T", None, None, '"old"'), (2, "a", "append", "L", 2, None, '{"Página":2}'), (3, "a", "sub", "L", 1, "g", '"x"'), (4, "a", "sub", "L", 2, "g", '"y"'),
        (5, "a", "sub", "L", 2, "g", '"z"'), (6, "a", "sort", "L", None, None, None), (7, "a", "append", "L", 0, None, "{}"), (8, "a", "header", "T", None, None, '"new"'),
        (9, "a", "what", None, None, None, None), (10, "a", "append", "L", 2, None, '{"Página":2,"again":true}'), (11, "a", "sub", "L", 0, "g", "1"), (12, None, "append", "M", None, None, "{}"),
    ]
    schema = "seq long, doc string, kind string, name string, page int, sub string, value string"
    got = {r.doc: json.loads(r.document) for r in written_documents(spark.createDataFrame(rows, schema)).collect()}
    pages = [{"Página": 1, "g": ["x"]}, {"Página": 2, "g": ["y", "z"]}, {"g": [1]}, {"Página": 2, "again": True}]
    assert got == {"a": {"T": "new", "L": pages}, None: {"M": [{}]}} and list(got["a"]) == ["T", "L"]
    assert written_documents(spark.createDataFrame([], schema)).count() == 0
