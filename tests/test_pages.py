import numpy as np
from pyspark.sql import functions as F

from foliospark.functions import pixels
from foliospark.plans import pages
from foliospark.sources import files, sinks


def test_page_driver(spark, tmp_path):
    for name, side in (("p1", 8), ("p2", 40), ("p3", 16), ("p4", 12)):
        (tmp_path / f"{name}.png").write_bytes(files.png([[side] * side] * side))
    (tmp_path / "p5.png").write_bytes(b"no image")
    found = spark.read.format("image").load(str(tmp_path)).withColumn("page", F.regexp_extract("image.origin", r"p(\d)\.png", 1).cast("int"))

    def detect(image):
        if image.shape[0] > 30:
            raise RuntimeError("CUDA out of memory")
        if image.shape[0] == 16:
            raise ValueError("odd")
        return [(1, 1, 2, 2)]

    done = pages.process_pages(found.withColumn("title", F.lit("t")), detect, pixels.fill_boxes, lambda a: a.tobytes())
    got = {r.page: r for r in done.collect()}
    assert (got[1].attempts, got[2].attempts, got[3].attempts, got[5].attempts) == (1, 2, 1, 0)
    assert got[3].error == "ValueError: odd" and got[5].error and got[1].error is None
    assert len(got[1].content) == 8 * 8 and len(got[2].content) == 40 * 40 and got[2].boxes[0].x == 1 and got[1].boxes[0].w == 2
    last = pages.process_pages(found.filter("page = 2").withColumn("title", F.lit("t")), detect, pixels.fill_boxes, lambda a: b"", attempts=1).first()
    assert "memory" in last.error
    assert pages.on_canvas(np.ones((2, 3), np.uint8), 3, 2).tolist() == [[1, 1], [1, 1], [0, 0]]
    assert pages.smaller(np.zeros((1, 3), np.uint8)).shape == (1, 2)


def test_only_complete_titles_are_compiled(spark):
    f = spark.createDataFrame([("a", "p10.jpg"), ("a", "p2.jpg"), ("b", "p1.jpg")], "title string, file string")
    n = spark.createDataFrame([("a", 2), ("b", 2)], "title string, n int")
    assert [(r.name, r.files) for r in pages.compile_titles(f, n).collect()] == [("a_Traducido.pdf", ["p2.jpg", "p10.jpg"])]


def test_documents_are_replaced_by_title(spark, tmp_path):
    out = str(tmp_path / "out")
    write = lambda rows: sinks.write_documents(spark.createDataFrame(rows, "title string, document string"), out)
    write([("a", '{"é":1}'), ("b", "{}")])
    write([("a", '{"é":2}')])
    assert sorted((r.title, r.value) for r in spark.read.text(out).collect()) == [("a", '{"é":2}'), ("b", "{}")]
