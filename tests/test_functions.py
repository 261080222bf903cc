import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark import catalog
from foliospark.functions import layout, links, naming, text

HARD = ["", "   ", "　あ　", "\t\nx\r\n", "aaaa", "aaab", "aaaaa\n\n\n\n\n", "！！！！？。０", "***", "é¿?", "\r\r\r\r\r", "a ", "🙂🙂🙂🙂🙂", "٣", None, "\x1cx\x85"]


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def python_clean(t):
    t = t.translate(str.maketrans({"。": ".", "·": ".", "．": ".", "・": ".", "？": "?", "！": "!", "０": None})).strip()
    t = re.sub(r"([^\n])\1{3,}", r"\1\1\1", t)
    return t if any(c.isalnum() for c in t) else ""


def test_clean_is_the_plain_version(spark):
    assert column(spark, HARD, text.clean) == [None if t is None else python_clean(t) for t in HARD]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aab \n\r\t。！０　.?x", max_size=30), min_size=20, max_size=60))
def test_clean_of_any_text(spark, values):
    assert column(spark, values, text.clean) == [python_clean(t) for t in values]


def test_blank(spark):
    assert column(spark, [None, "", " 　\x85", "a"], text.is_blank) == [True, True, True, False]


def test_sentences(spark):
    assert column(spark, ["hELLO wORLD. bye\nnow. ", "", None], text.capitalize_sentences) == ["Hello world Bye now", "", None]


def test_sentences_change_case_letter_by_letter(spark):
    duck = duckdb.connect()
    duck.sql("CREATE TABLE documents (doc_id INT, text VARCHAR)")
    values = ["ßALT. groß ẞ. ß", "ΑΣ ΣΑΣ. ςΣ", "İI. iİ", "ﬁA. ŉA. ǆA. ǅA", "ᾳA. ᾲA", "\U00010d50A\U00010d50. \U00010d70", "K. ſS", *[chr(c) + chr(c) for c in range(0xB5, 0x2200)]]
    duck.executemany("INSERT INTO documents VALUES (?, ?)", [[0, "plain"], *([i, v] for i, v in enumerate(values[:7], 1))])
    duck.sql("INSERT INTO documents SELECT 8 + c - 181, chr(c) || chr(c) FROM (SELECT unnest(range(181, 8704))::INT AS c)")
    want = [r[0] for r in duck.sql(f"SELECT sentences FROM ({catalog.oracle_sql()['capitalize_sentences']}) WHERE doc_id > 0 ORDER BY doc_id").fetchall()]
    assert column(spark, values, text.capitalize_sentences) == want
    assert want[0] == "ẞalt Groß ß ẞ"


def test_natural_order(spark):
    names = ["p10.png", "p2.png", "P1.png", "p１２.png", "01a.png", "²x.png", "none.png", "p00002.png"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(naming.natural_key(F.col("n")), "n").collect()]
    wide = str.maketrans("０１２３４５６７８９", "0123456789")
    key = lambda n: [(t, int(d) if d else -1) for t, d in zip(re.split("[0-9]+", n.translate(wide).lower()), re.findall("[0-9]+", n.translate(wide)) + [""])]
    assert got == sorted(names, key=lambda n: (key(n), n))


@pytest.mark.parametrize(
    ("name", "want"),
    [("p7.webp", "0007.jpg"), ("x.WEBP", "x.jpg"), ("ch12345.png", "12345.png"), ("ch00012345x9.jpeg", "12345.jpeg"), ("p１２.bmp", "0012.bmp"), ("a", "a"), (".hidden1", "0001"), ("000.png", "0000.png")],
)
def test_result_name(spark, name, want):
    assert column(spark, [name], naming.result_name) == [want]


def test_links(spark):
    drive, box = "https://drive.google.com/file/d/Ab_-1/view?usp=sharing", "http://www.dropbox.com/scl/x?rlkey=1&y?dl=0"
    assert column(spark, [drive, box, "see " + drive, None], links.direct_link) == [
        "https://drive.google.com/uc?export=download&id=Ab_-1", "http://www.dropbox.com/scl/x?rlkey=1&y?dl=1", "see " + drive, None,
    ]
    assert column(spark, ["https://drive.google.com/drive/folders/abc?x=1", "https://h/?id=q", "https://h"], links.folder_id) == ["abc", "q", None]
    assert column(spark, ['a; filename="b%20c+d.zip"', "none", None], links.quoted_filename) == ["b c+d.zip", None, None]
    assert column(spark, ["filename=a.ZIP", None, 'filename="b"'], lambda c: links.plain_filename(c, "x")) == ["a.ZIP", "x.zip", "b.zip"]


def python_wrap(t, size, width):
    wide = lambda s: len(s) * size * 3 // 5
    out, now = [], None
    for w in t.split():
        if now is None:
            now = w
        elif wide(f"{now} {w}") > max(1, width):
            out.append(now)
            now = w
        else:
            now = f"{now} {w}"
    return [*out, now or ""]


@pytest.mark.parametrize("t", ["", "one", "a bb ccc dddd eeeee", "averyveryverylongword x", "  many   spaces　here "])
def test_wrap_and_fit(spark, t):
    assert column(spark, [t], lambda c: layout.wrap(c, F.lit(12), F.lit(60))) == [python_wrap(t, 12, 60)]
    size = 12
    for s in range(12, 101):
        lines = python_wrap(t, s, 120)
        if len(lines) * s + (len(lines) - 1) * min(14, s * 0.42) > 90 or max(len(x) * s * 3 // 5 for x in lines) > 120:
            break
        size = s
    assert column(spark, [t], lambda c: layout.font_size(c, F.lit(120), F.lit(90))) == [size]
