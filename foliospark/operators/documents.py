"""A title's nested document, from rows or from the messages of its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import coordinates


def balloon(x: Column, y: Column, w: Column, h: Column, text: Column) -> Column:
    return F.struct(coordinates(x, y, w, h).alias("Coordenadas"), text.alias("Texto"))


def assemble(balloons: DataFrame, pages: DataFrame, list_name: str) -> DataFrame:
    """Rows (title, document): balloons (title, page, pos, balloon) under their pages (title, page, format), as JSON.

    Pages and balloons are in order. A page without balloons has an empty list; balloons of an unlisted page make a page
    without a format. Balloons are gathered by page first, pages by title then.
    """
    by_page = balloons.groupBy("title", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "balloon"))), lambda b: b["balloon"]).alias("b"))
    full = pages.groupBy("title", "page").agg(F.max("format").alias("format")).join(by_page, ["title", "page"], "full")
    page = F.struct(
        F.col("page").cast("int").alias("Página"),
        F.col("format").alias("Formato"),
        F.coalesce("b", F.array().cast("array<struct<Coordenadas:array<array<int>>,Texto:string>>")).alias("Globos de texto"),
    )
    title = full.groupBy("title").agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(page)).alias("pages"))
    return title.select("title", F.to_json(F.struct(F.col("title").alias("Título"), F.col("n").alias("Páginas"), F.col("pages").alias(list_name))).alias("document"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Records of ``new`` in the place of those of ``old`` with equal keys; the rest of both stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def pending(pages: DataFrame, first: DataFrame, second: DataFrame, on: str) -> DataFrame:
    """Pages that lack one of their two results."""
    done = first.select(on).join(second.select(on), on, "left_semi").distinct()
    return pages.join(done, on, "left_anti")


def positional_zip(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows at the same place of two lists; what the longer list has more is dropped."""
    return left.join(right, on, "inner")


def written_documents(messages: DataFrame) -> DataFrame:
    """Rows (doc, document): the JSON that a writer's messages (seq, doc, kind, name, page, sub, value) leave. value and the result are JSON texts.

    header: the document's entry ``name`` is value, the last one wins. append: value, an object with its page, is added to the list ``name``. sub: value is
    added to the list ``sub`` of the list's first record for the page, which is made if there is none. sort: the records that list ``name`` has by then
    are ordered by page. Entries are in the order in which they first came, and so are elements; other kinds change nothing. Sublists are
    gathered by page first, records by list then. A null page is a page of its own.
    """
    rows = messages.select("seq", "doc", "kind", "name", "page", "sub", "value")
    kind = lambda k: rows.filter(F.col("kind") == k)
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    joined = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, c))), lambda x: x[c]), ",")
    headers = kind("header").groupBy("doc", "name").agg(F.max_by("value", "seq").alias("body"), F.min("seq").alias("first"))
    lists = kind("sub").groupBy("doc", "name", "page", "sub").agg(joined("value", ["seq"]).alias("all"), F.min("seq").alias("first"))
    lists = lists.withColumn("field", F.concat(quoted(F.col("sub")), F.lit(":["), "all", F.lit("]")))
    pages = lists.groupBy("doc", "name", "page").agg(joined("field", ["first"]).alias("extra"), F.min("first").alias("seq"))
    made = pages.select("doc", "name", "page", "seq", F.concat(F.lit('{"Página":'), F.coalesce(F.col("page").cast("string"), F.lit("null")), F.lit("}")).alias("value"), F.lit(False).alias("own"))
    records = kind("append").select("doc", "name", "page", "seq", "value", F.lit(True).alias("own")).unionByName(made)
    nth = F.row_number().over(Window.partitionBy("doc", "name", "page").orderBy("seq", F.desc("own")))
    records = records.withColumn("nth", nth).filter("own or nth = 1").alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("doc", "name", "page")]
    full = records.join(pages.select("doc", "name", "page", "extra").alias("p"), same[0] & same[1] & same[2] & (F.col("r.nth") == 1), "left")
    bare = F.regexp_replace("value", r"\s*\}\s*$", "")
    whole = F.when(F.col("extra").isNull(), F.col("value")).otherwise(F.concat(bare, F.when(bare.rlike(r"\{\s*$"), F.lit("")).otherwise(F.lit(",")), "extra", F.lit("}")))
    full = full.select("r.doc", "r.name", "r.page", "r.seq", whole.alias("record"))
    sorts = kind("sort").groupBy(F.col("doc").alias("d"), F.col("name").alias("n")).agg(F.max("seq").alias("until"))
    full = full.join(sorts, full["doc"].eqNullSafe(sorts["d"]) & full["name"].eqNullSafe(sorts["n"]), "left")
    late = F.coalesce(F.col("seq") > F.col("until"), F.lit(True))
    placed = full.select("doc", "name", "seq", "record", late.alias("late"), F.when(~late, F.col("page")).alias("by"))
    arrays = placed.groupBy("doc", "name").agg(F.concat(F.lit("["), joined("record", ["late", "by", "seq"]), F.lit("]")).alias("body"), F.min("seq").alias("first"))
    entries = headers.unionByName(arrays).withColumn("entry", F.concat(quoted(F.col("name")), F.lit(":"), "body"))
    return entries.groupBy("doc").agg(F.concat(F.lit("{"), joined("entry", ["first"]), F.lit("}")).alias("document"))


def merge_messages(messages: DataFrame) -> DataFrame:
    """What a writer's messages (seq, doc, kind, payload) leave, a row a document: title, pages, appended, n_balloons, finished, unknown.

    header and pages keep the last value set; append adds elements in order; balloon counts each place once, however often it is repeated;
    finish marks the end; other kinds are counted apart and change nothing.
    """
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("payload")), F.when(F.col("kind") == kind, F.col("seq")))
    count = lambda cond: F.count_if(cond).alias
    kind = F.col("kind")
    return messages.groupBy("doc").agg(
        last("header").alias("title"),
        last("pages").alias("pages"),
        count(kind == "append")("n_appended"),
        F.count_distinct(F.when(kind == "balloon", F.col("payload"))).alias("n_balloons"),
        count(kind == "finish")("n_finish"),
        count(~kind.isin("header", "pages", "append", "balloon", "finish") | kind.isNull())("n_unknown"),
        F.max("seq").alias("last_seq"),
    )
