import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark import providers
from foliospark.functions import pixels
from foliospark.operators import documents, geometry, graph, translate
from foliospark.plans import batches
from foliospark.sources import files


def test_components_of_chains_stars_and_loops(spark):
    random.seed(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(200, 260)] + [(7, 7)] + [(random.randrange(300, 400), random.randrange(300, 400)) for _ in range(60)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert found == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [500, 4, 0])
def test_regions_equal_raster_labels(spark, most):
    random.seed(1)
    rows = []
    for page in range(20):
        for pos in range(random.randrange(1, 9)):
            x, y = random.randrange(40), random.randrange(40)
            rows.append((page, pos, x, y, x + random.randrange(8), y + random.randrange(8)))
    rows.append((99, 0, 5, 5, 2, 9))  # no area
    got = sorted(tuple(r) for r in geometry.merge_touching(spark.createDataFrame(rows, "page long, pos int, x1 int, y1 int, x2 int, y2 int"), most).drop("members").collect())
    want = []
    for page in range(20):
        own = [r[2:] for r in rows if r[0] == page]
        groups = [{i} for i in range(len(own))]
        for i, j in itertools.combinations(range(len(own)), 2):
            a, b = own[i], own[j]
            if a[0] <= b[2] + 1 and b[0] <= a[2] + 1 and a[1] <= b[3] + 1 and b[1] <= a[3] + 1:
                x, y = next(g for g in groups if i in g), next(g for g in groups if j in g)
                if x is not y:
                    x |= y
                    groups.remove(y)
        for g in groups:
            x1, y1, x2, y2 = (f(own[i][k] for i in g) for k, f in enumerate((min, min, max, max)))
            want.append((page, x1, y1, x2 - x1 + 1, y2 - y1 + 1))
    assert got == sorted(want)


def test_kernel_rounds_half_to_even(spark):
    row = spark.range(1).select(geometry.kernel(F.lit(50), F.lit(500), F.lit(False)).alias("k")).first().k
    assert (row.h, row.w) == (round(2.5), round(1.5))


def test_plan_equals_the_search(spark):
    cases = [(n, r, w, gb) for n in (0, 1, 7, 40, 1000) for r in (0, 1, 8, 2000) for w in (1, 3, 16) for gb in (7.0, 8.0, 40.0)]
    got = batches.plan(spark.createDataFrame(cases, "n long, requested int, workers int, gb double")).collect()
    for row in got:
        b = max(1, row.requested)
        while (-(-row.n // b) > row.workers or -(-row.n // b) * 7.8 > row.gb) and b < row.n:
            b += 1
        assert (row.batch_size, row.processes) == (b, max(1, -(-row.n // b))), row


def test_running_index(spark):
    df = spark.createDataFrame([(i * 7919 % 501,) for i in range(501)], "k long")
    assert sorted((r.k, r.page_idx) for r in batches.running_index(df, ["k"]).collect()) == [(i, i) for i in range(501)]
    assert batches.running_index(spark.createDataFrame([], "k long"), ["k"]).count() == 0


def test_validation(spark):
    e = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1)], "page int, id int")
    a = spark.createDataFrame([(1, 1), (1, 1), (1, 9), (2, 1), (4, None)], "page int, id int")
    got = {r.page: (r.missing, r.unknown, r.repeated, r.valid) for r in translate.validate(e, a).collect()}
    assert got == {1: ([2], [9], [1], False), 2: ([], [], [], True), 3: ([1], [], [], False), 4: ([], [-1], [], False)}


def test_responses(spark):
    bodies = ['{"traducciones":[{"id":1,"traduccion":"a"},{"id":true,"traduccion":"b"}]}', "no json", "{}", '{"traducciones":[{"id":"1","traduccion":"a"}]}', '{"traducciones":[{"id":1,"traduccion":2}]}', None]
    got = translate.parse_responses(spark.createDataFrame(list(enumerate(bodies)), "page int, body string")).collect()
    assert [(r.page, r.id, r.traduccion) for r in got if r.well_formed] == [(0, 1, "a"), (0, 1, "b")]
    assert sorted(r.page for r in got if not r.well_formed) == [1, 2, 3, 4, 5]


def test_translation_falls_back_and_remembers(spark):
    def batch(texts, ctx):
        if "bad" in texts:
            raise RuntimeError("no")
        return [f"{len(ctx)}:{t}" for t in texts]

    def single(t):
        if t == "bad":
            raise ValueError
        return "" if t == "void" else t.upper()

    rows = [("t", p, i, x) for p, ts in enumerate([["a", " "], ["b"], ["c"], ["bad", "void", "ok"], [None]]) for i, x in enumerate(ts)]
    got = translate.translate(spark.createDataFrame(rows, "title string, page int, pos int, texto string"), batch, single, pause=None).orderBy("page", "pos").collect()
    assert [r.traduccion for r in got] == ["0:a", "", "1:b", "2:c", "bad", "void", "OK", ""]
    assert [r.method for r in got] == ["batch", "batch", "batch", "batch", "single", "single", "single", "copy"]


def test_translation_without_a_model_and_with_pauses(spark):
    one = spark.createDataFrame([("t", 0, 0, "hello"), ("t", 0, 1, "x"), ("t", 0, 2, None), ("t", 0, 3, "a。")], "title string, page int, pos int, texto string")
    answers = {"hello": "hola！！！！！", "x": "y"}
    got = translate.translate(one, None, lambda t: answers.get(t)).orderBy("pos").collect()
    assert [r.traduccion for r in got] == ["hola!!!", "", "", ""]
    waited = []

    def refuse(texts, ctx):
        raise RuntimeError("no")

    run = translate.translate  # the pauses are made in the workers: here they end up in the text
    rows = run(one.filter("pos = 0"), refuse, lambda t: "w" + str(len(waited)), pause=waited.append).collect()
    assert rows[0].traduccion == "w2" and rows[0].method == "single"


def test_answers_are_validated():
    import json

    answer = lambda *rows: json.dumps({"traducciones": [{"id": i, "traduccion": t} for i, t in rows]})
    assert translate.read_answer(answer((1, "b"), (0, "a")), 2) == ["a", "b"] and translate.read_answer(answer((True, "b"), (0, "a")), 2) == ["a", "b"]
    for bad in (answer((0, "a")), answer((0, "a"), (0, "b")), answer((0, "a"), (2, "b")), answer((0, "a"), ("1", "b")), answer((0, "a"), (1, 3)), "[]", "no", '{"x": 1}'):
        with pytest.raises(ValueError):
            translate.read_answer(bad, 2)
    asked = []
    batch = translate.json_batch(lambda *a: asked.append(a) or answer((0, "a")), "Japonés", "Español", "lore")
    assert batch(["é"], [["x -> y"]]) == ["a"] and asked[0][1:] == ('{"contexto_previo": [["x -> y"]], "textos_a_traducir": [{"id": 0, "texto": "é"}]}', 256)
    assert "lore" in asked[0][0] and "Japonés" in asked[0][0]


def test_context_takes_two_pages_that_have_any(spark):
    rows = [("t", 1, ["a"]), ("t", 2, []), ("t", 3, ["b"]), ("t", 4, ["c"]), ("t", 5, ["d"])]
    got = translate.context(spark.createDataFrame(rows, "title string, page int, ctx array<string>")).orderBy("page").collect()
    assert [r.previo for r in got] == [[], [["a"]], [["a"], ["b"]], [["b"], ["c"]]]


def test_documents(spark):
    import json

    b = spark.createDataFrame([("t", 1, 1, "y"), ("t", 1, 0, "x"), ("t", 3, 0, "z")], "title string, page int, pos int, t string")
    b = b.select("title", "page", "pos", documents.balloon(F.lit(1), F.lit(2), F.lit(3), F.lit(4), F.col("t")).alias("balloon"))
    pages = spark.createDataFrame([("t", 1, "Color"), ("t", 2, "Color")], "title string, page int, format string")
    doc = json.loads(documents.assemble(b, pages, "Transcripción").first().document)
    assert doc["Páginas"] == 3
    assert [[g["Texto"] for g in p["Globos de texto"]] for p in doc["Transcripción"]] == [["x", "y"], [], ["z"]]
    assert doc["Transcripción"][0]["Globos de texto"][0]["Coordenadas"] == [[1, 2], [4, 6]]


def test_pixels():
    rng = np.random.default_rng(0)
    img = np.where(rng.random((20, 30)) < 0.3, 220, 30).astype(np.uint8) + rng.integers(0, 9, (20, 30)).astype(np.uint8)
    t = pixels.otsu(img)
    best = max(range(256), key=lambda k: ((img <= k).sum() * (img > k).sum() * ((img[img <= k].mean() if (img <= k).any() else 0) - (img[img > k].mean() if (img > k).any() else 0)) ** 2, -k))
    assert t == best
    clean = pixels.binarize(img)
    assert clean.shape == (20, 30, 3) and (clean == 255).sum() * 2 >= clean.size
    page = np.full((10, 10, 3), 200, np.uint8)
    page[4:6, 4:6] = 0
    assert (pixels.fill_boxes(page, [(4, 4, 2, 2)])[3:7, 3:7] == 0).all() and (pixels.fill_boxes(page, [(2, 2, 6, 6)])[1:9, 1:9] == 255).all()
    hole = np.zeros((9, 9), np.uint8)
    hole[2:7, 2:7] = 1
    distance, reached = pixels.rings(hole, size=256)
    assert distance[4, 4] == 3 * 128 // 128 and distance[0, 0] == 0 and distance[2, 2] == 1
    assert pixels.rings(np.ones((3, 3), np.uint8))[0].sum() == 0 and reached[4, 4].sum() > 0
    assert pixels.otsu(np.zeros(0, np.uint8)) == 0
    scaled, mask, added = pixels.model_input(page, np.pad(np.full((2, 2), 255, np.uint8), 4))
    assert scaled.shape == (3, 128, 128) and mask.shape == (128, 128) and added == (118, 118)
    assert (scaled[:, 4:6, 4:6] == 0).all() and scaled[0, 0, 0] == np.float32(200 / 127.5 - 1) and scaled[0, 10, 10] == scaled[0, 9, 9]


def test_files(spark, tmp_path):
    import zipfile

    for n in ("b2.png", "a10.PNG", "x.txt"):
        (tmp_path / n).write_bytes(files.png([[0, 255], [9, 9]]))
    assert {r.file for r in files.list_pages(spark, str(tmp_path)).collect()} == {"b2.png", "a10.PNG"}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/", "")
        z.writestr("d/a.txt", "hi")
    rows = spark.read.format("binaryFile").load([str(tmp_path / "z.zip"), str(tmp_path / "x.txt")])
    assert [(r.member, bytes(r.content)) for r in files.archive_members(rows).collect()] == [("d/a.txt", b"hi")]
    spark.dataSource.register(files.HttpSource)
    got = spark.read.format("folio_http").option("urls", f"file://{tmp_path}/b2.png file://{tmp_path}/none").load().collect()
    assert sorted(r.error is None for r in got) == [False, True]


def test_tasks_list_folders_and_not_files(spark, tmp_path):
    for title in ("one", "two é"):
        (tmp_path / title / "inner.png").mkdir(parents=True)
        for i in range(60):
            (tmp_path / title / f"{i}.{'PNG' if i % 2 else 'txt'}").write_bytes(b"x" * i)
    pages = files.list_pages(spark, f"file://{tmp_path}/one")
    assert sorted(tuple(r) for r in pages.collect()) == sorted(("one", f"{i}.PNG", f"file:{tmp_path}/one/{i}.PNG", i) for i in range(1, 60, 2))
    both = spark.createDataFrame([(f"{tmp_path}/one",), (f"{tmp_path}/two é",)], "folder string")
    assert sorted((r.title, r.length) for r in files.list_pages(spark, both).collect()) == [(t, i) for t in ("one", "two é") for i in range(1, 60, 2)]
    assert {r.length: bytes(r.content) for r in files.list_files(spark, both, content=True).collect()} == {i: b"x" * i for i in range(60)}
    assert pages.rdd.getNumPartitions() == 1


def test_images_are_those_of_sparks_source_without_its_listing(spark, tmp_path):
    java, folder = spark._jvm, tmp_path / "a é %[1] #"
    folder.mkdir()
    for name, kind in (("gray.png", 10), ("color.png", 5), ("alpha.png", 6), ("color.jpg", 5), ("gray.jpeg", 10), ("color.bmp", 5), ("indexed.gif", 13)):
        image = java.java.awt.image.BufferedImage(5, 3, kind)
        for i in range(15):
            image.setRGB(i % 5, i // 5, (i * 17 << 24 | i * 0x0B1103) - (1 << 31))
        assert java.javax.imageio.ImageIO.write(image, name.rpartition(".")[2].replace("jpeg", "jpg"), java.java.io.File(str(folder / name)))
    for name, content in (("broken.png", files.png([[0]], broken=True)), ("cut.jpg", (folder / "color.jpg").read_bytes()[:300]), ("text.png", b"text"), ("empty.png", b"")):
        (folder / name).write_bytes(content)
    rows = lambda df: sorted(df.select("image.*").collect())
    want = rows(spark.read.format("image").option("dropInvalid", True).load(str(tmp_path / "a é*")))
    found = files.read_images(spark, str(folder))
    assert rows(found) == want and len(want) >= 7
    assert found.rdd.getNumPartitions() == 1 and "FileScan" not in found._jdf.queryExecution().toString()


def test_providers():
    assert providers.provider("translate", "echo")("a") == "«a»"
    assert providers.first_of("translate", ["none", "echo"])("a") == "«a»"
    with pytest.raises(ValueError):
        providers.provider("ocr", "none")
    with pytest.raises(ValueError):
        providers.register("sing", "x", lambda: None)
