"""The engine's own queries by name, with the DuckDB SQL that checks them."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import providers
from .functions import layout, links, naming, pixels, text
from .operators import documents as docs
from .operators import geometry, translate
from .plans import batches, pages
from .sources import files, sinks
from .storage import shared_dir
from .streaming import writer

FLAGSHIP = "conversation_document"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- text ---------------------------------------------------------------------------------------------------------------

_WS = "".join(f"\\x{{{ord(c):x}}}" for c in text.SPACE)


def sql_strip(t: str) -> str:
    return f"regexp_replace({t}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def sql_squeeze(t: str) -> str:
    letters = f"regexp_extract_all({t}, '(?s).')"
    return (
        f"(SELECT array_to_string(list_filter(l, lambda x, i: i < 4 OR x = chr(10) OR NOT (x = l[i - 1] AND x = l[i - 2] AND x = l[i - 3])), '') "
        f"FROM (SELECT {letters} AS l))"
    )


def sql_clean(t: str) -> str:
    squeezed = sql_squeeze(sql_strip(f"translate({t}, '{text.SPECIAL}', '{text.PLAIN}')"))
    return f"(SELECT CASE WHEN regexp_matches(s, '[\\p{{L}}\\p{{N}}]') THEN s ELSE '' END FROM (SELECT {squeezed} AS s))"


@query(f"SELECT doc_id, {sql_clean('text')} AS cleaned FROM documents")
def clean_text(spark, d):
    return read(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, {sql_squeeze('text')} AS squeezed FROM documents")
def squeeze_runs(spark, d):
    return read(spark, d, "documents").select("doc_id", text.squeeze(F.col("text")).alias("squeezed"))


@query(
    "SELECT event_id, CASE WHEN regexp_matches(props, '[\\p{L}\\p{N}]') THEN props ELSE '' END AS kept, "
    "CASE WHEN regexp_matches(regexp_replace(props, '[\\p{L}\\p{N}]', '', 'g'), '[\\p{L}\\p{N}]') THEN 'x' ELSE '' END AS symbols FROM events"
)
def drop_symbol_only(spark, d):
    bare = F.regexp_replace("props", r"[\p{L}\p{N}]", "")
    return read(spark, d, "events").select("event_id", text.drop_symbol_only(F.col("props")).alias("kept"), text.drop_symbol_only(bare).alias("symbols"))


@query(
    "SELECT doc_id, array_to_string(list_transform(list_filter(string_split(replace(text, chr(10), ' '), '. '), lambda s: s <> ''), "
    "lambda s: upper(s[1]) || lower(s[2:])), ' ') AS sentences FROM documents"
)
def capitalize_sentences(spark, d):
    return read(spark, d, "documents").select("doc_id", text.capitalize_sentences(F.col("text")).alias("sentences"))


@query(
    "SELECT doc_id, CASE WHEN lang IN ('es', 'en') THEN replace(text, chr(10), ' ') ELSE replace(replace(text, chr(10), ''), '~', '') END AS joined FROM documents"
)
def ocr_lines_joined(spark, d):
    lines = F.split("text", "\n", -1)
    return read(spark, d, "documents").select("doc_id", text.join_lines(lines, F.col("lang").isin("es", "en")).alias("joined"))


@query(f"SELECT conv_id, turn, text IS NULL OR {sql_strip('text')} = '' AS blank, CASE WHEN text IS NULL OR length(text) <= 1 THEN '' ELSE text END AS kept FROM conversations")
def short_or_blank(spark, d):
    t = F.col("text")
    return read(spark, d, "conversations").select("conv_id", "turn", text.is_blank(t).alias("blank"), text.short_to_empty(t).alias("kept"))


# --- names and files ------------------------------------------------------------------------------------------------------

_HOST = "regexp_extract(url, '^[a-z]+://([^/]*)', 1)"
_SQL_KEY = (
    "list_transform(string_split_regex({t}, '[0-9]+'), lambda x, i: {{'t': x, 'd': coalesce(try_cast(regexp_extract_all({t}, '[0-9]+')[i] AS DECIMAL(38, 0)), -1)}})"
)


@query(
    f"SELECT page_id, {_HOST} AS title, (row_number() OVER (PARTITION BY {_HOST} ORDER BY "
    + _SQL_KEY.format(t="lower(url)")
    + ", page_id) - 1)::BIGINT AS place FROM pages"
)
def natural_order_rank(spark, d):
    title = F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)
    within = Window.partitionBy(title).orderBy(naming.natural_key(F.col("url")), "page_id")
    return read(spark, d, "pages").select("page_id", title.alias("title"), (F.row_number().over(within) - 1).cast("long").alias("place"))


def sql_result_name(name: str) -> str:
    ext = f"regexp_extract({name}, '(?s)^(.*[^.].*)(\\.[^.]*)$', 2)"
    return (
        f"(SELECT CASE WHEN g = '' THEN base WHEN length(ltrim(g, '0')) >= 4 THEN ltrim(g, '0') ELSE lpad(ltrim(g, '0'), 4, '0') END || "
        f"CASE WHEN lower(ext) = '.webp' THEN '.jpg' ELSE ext END FROM (SELECT ext, base, regexp_extract(base, '([0-9]+)', 1) AS g FROM "
        f"(SELECT {ext} AS ext, {name}[1:length({name}) - length({ext})] AS base)))"
    )


@query(
    f"SELECT c_custkey AS id, 'customer' AS kind, {sql_result_name('c_name')} AS result, concat_ws('/', 'Outputs', 'Limpieza', {sql_result_name('c_name')}) AS path FROM customer "
    f"UNION ALL SELECT page_id, 'page', {sql_result_name('name')}, concat_ws('/', 'Outputs', 'Limpieza', {sql_result_name('name')}) "
    "FROM (SELECT page_id, string_split(url, '/')[-1] || '.WEBP' AS name FROM pages)"
)
def page_names(spark, d):
    names = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_name").alias("name"))
    pages = read(spark, d, "pages").select("page_id", F.lit("page"), F.concat(naming.basename(F.col("url")), F.lit(".WEBP")))
    result = naming.result_name(F.col("name"))
    return names.union(pages).select("id", "kind", result.alias("result"), F.concat_ws("/", F.lit("Outputs"), F.lit("Limpieza"), result).alias("path"))


@query(
    f"SELECT p_partkey, result, count(*) OVER (PARTITION BY result) > 1 AS collision FROM (SELECT p_partkey, {sql_result_name('name')} AS result "
    "FROM (SELECT p_partkey, p_brand || '_' || p_size || '.png' AS name FROM part))"
)
def name_collisions(spark, d):
    name = F.concat("p_brand", F.lit("_"), "p_size", F.lit(".png"))
    named = read(spark, d, "part").select("p_partkey", naming.result_name(name).alias("result"))
    # counted before it is joined: a name that very many files share is one row by then
    counts = named.groupBy("result").agg((F.count("*") > 1).alias("collision"))
    return named.join(counts, "result").select("p_partkey", "result", "collision")


@query(
    "SELECT page_id, regexp_matches(lower(url || ext), '\\.(jpg|png|jpeg|bmp|webp)$') AS allowed, lower(ext) AS ext FROM pages, "
    "(VALUES ('.JPG'), ('.webp'), ('.gif'), ('.jpeg2'), ('')) AS v(ext)"
)
def allowed_extensions(spark, d):
    ext = F.explode(F.array(*map(F.lit, (".JPG", ".webp", ".gif", ".jpeg2", ""))))
    return read(spark, d, "pages").select("page_id", "url", ext.alias("ext")).select(
        "page_id", naming.is_image(F.concat("url", "ext")).alias("allowed"), F.lower("ext").alias("ext")
    )


@query(
    "SELECT page_id, CASE WHEN regexp_matches(u, '^https?://drive\\.google\\.com/file/d/[^\\n]+/view') THEN 'https://drive.google.com/uc?export=download&id=' || regexp_extract(u, 'd/([a-zA-Z0-9_-]+)', 1) "
    "WHEN regexp_matches(u, '^https?://(www\\.)?dropbox\\.com/scl/[^\\n]') THEN replace(u, '?dl=0', '?dl=1') ELSE u END AS link, kind "
    "FROM (SELECT page_id, unnest(['plain', 'drive', 'dropbox']) AS kind, unnest([url, 'https://drive.google.com/file/d/' || md5(url) || '/view?usp=sharing', "
    "'https://www.dropbox.com/scl/' || md5(url) || '?dl=0']) AS u FROM pages)"
)
def direct_links(spark, d):
    h = F.md5(F.col("url").cast("binary"))
    kinds = F.array(
        F.struct(F.lit("plain").alias("kind"), F.col("url").alias("u")),
        F.struct(F.lit("drive").alias("kind"), F.concat(F.lit("https://drive.google.com/file/d/"), h, F.lit("/view?usp=sharing")).alias("u")),
        F.struct(F.lit("dropbox").alias("kind"), F.concat(F.lit("https://www.dropbox.com/scl/"), h, F.lit("?dl=0")).alias("u")),
    )
    pages = read(spark, d, "pages").select("page_id", F.explode(kinds).alias("k"))
    return pages.select("page_id", links.direct_link(F.col("k.u")).alias("link"), F.col("k.kind").alias("kind"))


@query(
    "SELECT page_id, nullif(regexp_extract(u, '/d/([^/]+)', 1), '') AS file_id, coalesce(nullif(regexp_extract(url, '[?&]id=([^&#]*)', 1), ''), "
    "nullif(regexp_extract(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '([^/]+)/*$', 1), '')) AS folder_id, "
    "array_to_string(list_filter(string_split(url, '/'), lambda p: p <> ''), '>') AS parts FROM (SELECT page_id, url, replace(url, '/en/', '/d/') AS u FROM pages)"
)
def drive_ids(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select(
        "page_id",
        links.file_id(F.replace(u, F.lit("/en/"), F.lit("/d/"))).alias("file_id"),
        links.folder_id(u).alias("folder_id"),
        F.array_join(links.path_parts(u), ">").alias("parts"),
    )


@query(
    "SELECT p_partkey, url_decode(replace(p_name, ' ', '%20')) AS quoted, CASE WHEN p_size % 3 = 0 THEN 'pages.zip' WHEN ends_with(lower(p_name), '.zip') THEN p_name ELSE p_name || '.zip' END AS plain FROM part"
)
def header_filename(spark, d):
    name = F.col("p_name")
    quoted = F.concat(F.lit('attachment; filename="'), F.replace(name, F.lit(" "), F.lit("%20")), F.lit('"'))
    plain = F.when(F.col("p_size") % 3 == 0, F.lit("attachment")).otherwise(F.concat(F.lit("attachment; filename="), name))
    return read(spark, d, "part").select("p_partkey", links.quoted_filename(quoted).alias("quoted"), links.plain_filename(plain, "pages.zip").alias("plain"))


@query("SELECT doc_id, lang || '/' || doc_id || '.txt' AS member, octet_length(encode(text))::BIGINT AS length FROM documents")
def archive_members(spark, d):
    """Every document in an archive of its own, opened again."""
    import io
    import zipfile

    def pack(frames):
        for frame in frames:
            out = []
            for i, lang, body in zip(frame["doc_id"], frame["lang"], frame["text"]):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(f"{lang}/{i}.txt", body or "")
                out.append((str(i), buffer.getvalue()))
            yield frame[["doc_id"]].assign(path=[o[0] for o in out], content=[o[1] for o in out])

    packed = read(spark, d, "documents").select("doc_id", "lang", "text").mapInPandas(pack, "doc_id long, path string, content binary")
    return files.archive_members(packed).select(F.col("archive").cast("long").alias("doc_id"), "member", "length")


@query("SELECT vec_id, 8 AS height, 8 AS width, 1 AS channels FROM embeddings")
def images_decoded(spark, d):
    """Every embedding written as an 8 x 8 image, beside files that aren't images, and all decoded."""
    folder = shared_dir(spark)
    grays = read(spark, d, "embeddings").select("vec_id", files.shelf(F.col("vec_id")).alias("shelf"), _grays())

    def draw(frames):
        for frame in frames:
            content = [files.png([list(g[i : i + 8]) for i in range(0, 64, 8)]) for g in frame["g"]]
            broken = [files.png([[0]], broken=True) for _ in content]
            ids = [f"{shelf}/{v}" for shelf, v in zip(frame["shelf"], frame["vec_id"])]
            yield frame[["vec_id"]].assign(name=[f"{i}.png" for i in ids], content=content)
            yield frame[["vec_id"]].assign(name=[f"{i}-broken.png" for i in ids], content=broken)

    written = files.write_files(grays.mapInPandas(draw, "vec_id long, name string, content binary"), folder)
    image = files.read_images(spark, files.written_folders(written, folder))
    name = F.regexp_extract("image.origin", r"([0-9]+)\.png$", 1).cast("long")
    return image.select(name.alias("vec_id"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"))


# --- plans ------------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, page_idx, page_idx // 8 AS batch_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS page_idx FROM documents)")
def page_batches(spark, d):
    numbered = batches.running_index(read(spark, d, "documents").select("doc_id"), ["doc_id"])
    return numbered.select("doc_id", "page_idx", batches.batch_of(F.col("page_idx"), 8).alias("batch_id"))


@query("""
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL),
p AS (SELECT source, lang, n, r AS requested, w AS workers, least(w, floor(gb / 7.8)::BIGINT) AS p
      FROM c, (VALUES (1), (8), (30)) AS a(r), (VALUES (1, 8.0::DOUBLE), (7, 40.0::DOUBLE), (16, 7.0::DOUBLE)) AS b(w, gb)),
s AS (SELECT *, CASE WHEN (n + requested - 1) // requested <= p THEN requested WHEN p <= 0 THEN greatest(requested, n) ELSE greatest(requested, (n + p - 1) // p) END AS batch_size FROM p)
SELECT source, lang, requested, workers, n, batch_size::BIGINT AS batch_size, ((n + batch_size - 1) // batch_size)::BIGINT AS processes,
       (n + batch_size - 1) // batch_size > 1 AS in_parallel FROM s
""")
def execution_plan(spark, d):
    counts = read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    machines = F.array(*[F.struct(F.lit(w).alias("workers"), F.lit(gb).alias("gb")) for w, gb in ((1, 8.0), (7, 40.0), (16, 7.0))])
    cases = counts.withColumn("requested", F.explode(F.array(F.lit(1), F.lit(8), F.lit(30)))).withColumn("m", F.explode(machines))
    planned = batches.plan(cases.select("source", "lang", "n", "requested", "m.workers", "m.gb"))
    return planned.select("source", "lang", "requested", "workers", "n", "batch_size", "processes", "in_parallel")


@query(
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0))"
)
def pending_documents(spark, d):
    labels = read(spark, d, "labels")
    return docs.pending(read(spark, d, "documents").select("doc_id"), labels.filter("quality = 1"), labels.filter("toxic = 0"), "doc_id")


# --- languages and translation ------------------------------------------------------------------------------------------------


@query("""
WITH n(lang, name) AS (VALUES ('de', 'Alemán'), ('en', 'Inglés'), ('es', 'Español'), ('fr', 'Francés'))
SELECT doc_id, CASE name WHEN 'Inglés' THEN 'en' WHEN 'Español' THEN 'es' WHEN 'Francés' THEN 'fr' ELSE 'none' END AS code,
       CASE WHEN lang = 'es' THEN 'es' ELSE 'en' END AS reader, CASE WHEN doc_id % 2 = 0 THEN 'zh-CN' ELSE lang END AS provider,
       lang = 'en' AS same FROM documents JOIN n USING (lang)
""")
def language_codes(spark, d):
    names = {"de": "Alemán", "en": "Inglés", "es": "Español", "fr": "Francés"}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    lang = F.col("lang")
    given = F.when(F.col("doc_id") % 2 == 0, F.lit("zh")).otherwise(lang)
    return read(spark, d, "documents").select(
        "doc_id",
        translate.language_code(F.try_element_at(table, lang), "none").alias("code"),
        translate.reader_code(lang).alias("reader"),
        translate.provider_code(given, "google").alias("provider"),
        translate.same_language(F.concat(lang, F.lit("-XX")), F.lit("EN")).alias("same"),
    )


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as texts of a page; every fifth is blank."""
    c = read(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("page"), F.col("turn").alias("pos"), F.when(F.col("turn") % 5 == 4, F.lit("   ")).otherwise(F.col("text")).alias("texto"))


@query("""
SELECT conv_id AS page, turn AS pos, CASE WHEN turn % 5 = 4 THEN '   ' WHEN turn % 3 = 0 AND length(text) > 0 THEN '«' || text || '»' ELSE text END AS salida FROM conversations
""")
def scatter_back(spark, d):
    items = _items(spark, d)
    done = items.filter(~text.is_blank(F.col("texto"))).select("page", "pos", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("«"), "texto", F.lit("»"))).otherwise(F.lit("")).alias("traduccion"))
    return translate.scatter_back(items, done).select("page", "pos", "salida")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations)
SELECT a.conv_id, a.k::BIGINT AS k, a.text AS asked, b.text AS answered FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.k = b.k AND a.role = 'user' AND b.role = 'assistant'
""")
def positional_zip(spark, d):
    k = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")).cast("long")
    numbered = read(spark, d, "conversations").withColumn("k", k)
    side = lambda role, name: numbered.filter(F.col("role") == role).select("conv_id", "k", F.col("text").alias(name))
    return docs.positional_zip(side("user", "asked"), side("assistant", "answered"), ["conv_id", "k"])


@query("""
WITH e AS (SELECT o_orderkey AS page, unnest(range(1, (o_custkey % 6 + 2)::BIGINT)) AS id FROM orders),
a AS (SELECT l_orderkey AS page, CASE WHEN l_quantity = 7 THEN 1 ELSE l_linenumber END AS id FROM lineitem),
ac AS (SELECT page, id, count(*) AS n FROM a GROUP BY ALL),
j AS (SELECT coalesce(e.page, ac.page) AS page, coalesce(e.id, ac.id) AS id, e.id IS NOT NULL AS e, coalesce(n, 0) AS n FROM e FULL JOIN ac ON e.page = ac.page AND e.id = ac.id)
SELECT page, count(*) FILTER (e)::BIGINT AS n_expected, sum(n)::BIGINT AS n_answered,
       coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (e AND n = 0), '') AS missing, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (NOT e), '') AS unknown,
       coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (n > 1), '') AS repeated,
       count(*) FILTER (NOT e OR n <> 1) = 0 AS valid FROM j GROUP BY page
""")
def response_validation(spark, d):
    expected = read(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("o_custkey") % 6 + 1)).alias("id"))
    answered = read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.when(F.col("l_quantity") == 7, F.lit(1)).otherwise(F.col("l_linenumber")).cast("long").alias("id")
    )
    found = translate.validate(expected, answered)
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return found.select("page", "n_expected", "n_answered", listed("missing"), listed("unknown"), listed("repeated"), "valid")


@query("""
SELECT conv_id AS page, true AS well_formed, turn::INT AS id, text AS traduccion FROM conversations WHERE role <> 'system'
UNION ALL SELECT conv_id, false, NULL, NULL FROM conversations WHERE role = 'system'
""")
def response_parsing(spark, d):
    t = F.when(F.col("role") == "system", F.concat(F.lit('{"traducciones": [{"id": '), F.to_json(F.struct("turn")), F.lit("}]}"))).otherwise(
        F.to_json(F.struct(F.array(F.struct(F.col("turn").alias("id"), F.col("text").alias("traduccion"))).alias("traducciones")))
    )
    return translate.parse_responses(read(spark, d, "conversations").select(F.col("conv_id").alias("page"), t.alias("body")))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    return translate.page_context(
        c.select(
            F.col("role").alias("title"), F.col("conv_id").alias("page"), F.col("turn").alias("pos"), F.col("text").alias("texto"), F.reverse("text").alias("traduccion")
        )
    )


@query(f"""
WITH p AS (SELECT role AS title, conv_id AS page, turn AS pos, text || ' -> ' || reverse(text) AS p FROM conversations WHERE {sql_strip('text')} <> '' AND {sql_strip('reverse(text)')} <> ''),
c AS (SELECT title, page, string_agg(p, '|' ORDER BY pos) AS ctx FROM p GROUP BY ALL)
SELECT title, page, ctx, coalesce(string_agg(ctx, '#') OVER (PARTITION BY title ORDER BY page ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS previo FROM c
""")
def bilingual_context(spark, d):
    got = translate.context(_pairs(spark, d))
    return got.select("title", "page", F.array_join("ctx", "|").alias("ctx"), F.array_join(F.transform("previo", lambda c: F.array_join(c, "|")), "#").alias("previo"))


@query(f"""
SELECT conv_id AS page, '{{"contexto_previo":[],"textos_a_traducir":[' || string_agg('{{"id":' || turn || ',"texto":' || to_json(text) || '}}', ',' ORDER BY turn) || ']}}' AS body,
       greatest(256, 96 * count(*))::INT AS budget FROM conversations WHERE {sql_strip('text')} <> '' GROUP BY conv_id
""")
def request_payload(spark, d):
    kept = read(spark, d, "conversations").filter(~text.is_blank(F.col("text")))
    items = F.array_sort(F.collect_list(F.struct(F.col("turn").cast("int").alias("id"), F.col("text").alias("texto"))))
    page = kept.groupBy(F.col("conv_id").alias("page")).agg(items.alias("items"))
    none = F.array().cast("array<array<string>>")
    return page.select("page", translate.request_json(none, F.col("items")).alias("body"), translate.token_budget(F.col("items")).alias("budget"))


@query("""
WITH c AS (SELECT *, contains(text, '?') AS q FROM (SELECT conv_id, turn, role, CASE WHEN turn % 4 = 3 THEN text || '?' ELSE text END AS text FROM conversations)),
p AS (SELECT conv_id, role, bool_or(q) AS bad FROM c GROUP BY ALL)
SELECT role AS title, conv_id AS page, turn AS pos, """ + sql_clean("'«' || text || '»'") + """ AS traduccion,
       CASE WHEN bad THEN 'single' ELSE 'batch' END AS method FROM c JOIN p USING (conv_id, role)
""")
def translate_fallback(spark, d):
    c = read(spark, d, "conversations")
    texto = F.when(F.col("turn") % 4 == 3, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    rows = c.select(F.col("role").alias("title"), F.col("conv_id").alias("page"), F.col("turn").alias("pos"), texto.alias("texto"))
    got = translate.translate(rows, providers.provider("translate_batch", "echo"), providers.provider("translate", "echo"), pause=None)
    return got.select("title", "page", "pos", "traduccion", "method")


# --- rectangles -----------------------------------------------------------------------------------------------------------------

_SQL_BOX = "SELECT l_orderkey AS page, l_linenumber AS pos, (l_partkey % 460)::INT AS x, (l_suppkey * 37 % 700)::INT AS y, (l_quantity + 4)::INT AS w, (l_linenumber * 5 + 10)::INT AS h FROM lineitem"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page"),
        F.col("l_linenumber").alias("pos"),
        (F.col("l_partkey") % 460).cast("int").alias("x"),
        (F.col("l_suppkey") * 37 % 700).cast("int").alias("y"),
        (F.col("l_quantity") + 4).cast("int").alias("w"),
        (F.col("l_linenumber") * 5 + 10).cast("int").alias("h"),
    )


def _page() -> tuple[Column, Column]:
    """Width and height of all pages."""
    return F.lit(500), F.lit(720)


@query(f"""
SELECT page, pos, greatest(0, x - 1) AS mx1, greatest(0, y - 1) AS my1, least(499, x + w) AS mx2, least(719, y + h) AS my2,
       greatest(0, x - 15) AS cx1, greatest(0, y - 15) AS cy1, least(500, x + w + 15) AS cx2, least(720, y + h + 15) AS cy2,
       '[[' || x || ',' || y || '],[' || (x + w) || ',' || (y + h) || ']]' AS corners, greatest(1, floor(w * 0.75))::INT AS smaller FROM ({_SQL_BOX})
""")
def boxes_clamped(spark, d):
    c, page = [F.col(n) for n in "xywh"], _page()
    made = _boxes(spark, d).select("*", geometry.mask_box(*c, *page).alias("m"), geometry.crop_box(*c, *page).alias("c"))
    named = [F.col(f"{s}.{n}").alias(f"{s}{n}") for s in "mc" for n in ("x1", "y1", "x2", "y2")]
    return made.select("page", "pos", *named, F.to_json(geometry.coordinates(*c)).alias("corners"), geometry.shrink(F.col("w")).alias("smaller"))


@query(f"""
WITH RECURSIVE b AS MATERIALIZED (SELECT page, row_number() OVER (PARTITION BY page) AS pos, greatest(0, greatest(0, x - 1) - 7) AS x1, greatest(0, greatest(0, y - 1) - 1) AS y1, least(499, least(499, x + w) + 7) AS x2, least(719, least(719, y + h) + 2) AS y2 FROM ({_SQL_BOX})),
e AS MATERIALIZED (SELECT a.page, a.pos AS a, b.pos AS b FROM b a JOIN b ON a.page = b.page AND a.x1 <= b.x2 + 1 AND b.x1 <= a.x2 + 1 AND a.y1 <= b.y2 + 1 AND b.y1 <= a.y2 + 1),
r(page, a, b) AS (SELECT page, a, b FROM e UNION SELECT r.page, r.a, e.b FROM r JOIN e ON r.page = e.page AND r.b = e.a),
m AS (SELECT page, a AS pos, min(b) AS root FROM r GROUP BY ALL),
g AS (SELECT b.page, root, min(x1) AS x, min(y1) AS y, max(x2) AS x2, max(y2) AS y2, count(*) AS members FROM b JOIN m ON b.page = m.page AND b.pos = m.pos GROUP BY b.page, root)
SELECT page, x, y, x2 - x + 1 AS w, y2 - y + 1 AS h, members FROM g
""")
def regions_merged(spark, d):
    c, page = [F.col(n) for n in "xywh"], _page()
    k = geometry.kernel(*page, F.lit(False))
    grown = _boxes(spark, d).select("page", "pos", geometry.dilate(geometry.mask_box(*c, *page), k, *page).alias("b")).select("page", "pos", "b.*")
    return geometry.merge_touching(grown)


@query(f"""
SELECT page, x, y, w, h, pos AS det, (row_number() OVER (PARTITION BY page ORDER BY floor(y / 50), CASE WHEN page % 2 = 0 THEN -x ELSE x END, y, h, w, pos) - 1)::INT AS pos FROM ({_SQL_BOX})
""")
def reading_order(spark, d):
    # boxes are told apart by their height, which holds their number
    return geometry.reading_order(_boxes(spark, d).withColumnRenamed("pos", "det"), F.col("page") % 2 == 0).select("page", "x", "y", "w", "h", "det", "pos")


@query("""
SELECT p_partkey, greatest(1, round_even(h * c1, 0))::INT AS kh, greatest(1, round_even(w * c2, 0))::INT AS kw FROM (
  SELECT p_partkey, p_size * 100 AS h, p_partkey % 2500 + 1 AS w, CASE WHEN p_size % 2 = 0 THEN 0.003215::DOUBLE ELSE 0.005::DOUBLE END AS c1, CASE WHEN p_size % 2 = 0 THEN 0.003215::DOUBLE ELSE 0.03::DOUBLE END AS c2 FROM part)
""")
def kernel_sizes(spark, d):
    k = geometry.kernel(F.col("p_partkey") % 2500 + 1, F.col("p_size") * 100, F.col("p_size") % 2 == 0)
    return read(spark, d, "part").select("p_partkey", k.alias("k")).select("p_partkey", F.col("k.h").alias("kh"), F.col("k.w").alias("kw"))


@query("""
WITH s AS (SELECT p_partkey, p_partkey % 1900 + 60 AS w, p_size * 31 + 40 AS h FROM part),
r AS (SELECT *, least(1024 / h, 1024 / w) AS r, w / h AS aspect FROM s)
SELECT p_partkey, (ceil(round_even(w * r, 0) / 64) * 64)::INT AS fw, (ceil(round_even(h * r, 0) / 64) * 64)::INT AS fh,
       CASE WHEN aspect > 1 THEN 595 ELSE floor(842 * aspect)::INT END AS pw, CASE WHEN aspect > 1 THEN floor(595 / aspect)::INT ELSE 842 END AS ph FROM r
""")
def fitted_sizes(spark, d):
    w, h = F.col("w"), F.col("h")
    sides = read(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 1900 + 60).alias("w"), (F.col("p_size") * 31 + 40).alias("h"))
    made = sides.select("p_partkey", geometry.fit_size(w, h, 1024, 64).alias("f"), geometry.print_size(w, h, 595, 842).alias("p"))
    return made.select("p_partkey", *[F.col(f"{s}.{n}").alias(f"{s}{n}") for s in "fp" for n in "wh"])


# --- pixels ---------------------------------------------------------------------------------------------------------------------


def _grays() -> Column:
    return F.transform("embedding", lambda v: (F.floor(F.abs(v.cast("double")) * 1000) % 256).cast("int")).alias("g")


_SQL_GRAYS = "SELECT vec_id, label, list_transform(embedding, lambda v: (floor(abs(v::DOUBLE) * 1000)::BIGINT % 256)::INT) AS g FROM embeddings"


@query(f"SELECT vec_id, CASE WHEN m < 50 OR m > 200 THEN 'Blanco y negro (B/N)' ELSE 'Color' END AS format, round(m, 6) AS gray FROM (SELECT vec_id, list_sum(g) / len(g) * (1 + vec_id % 2) AS m FROM ({_SQL_GRAYS}))")
def page_format(spark, d):
    m = pixels.mean(F.col("g")) * (1 + F.col("vec_id") % 2)
    return read(spark, d, "embeddings").select("vec_id", _grays()).select("vec_id", pixels.page_format(m).alias("format"), F.round(m, 6).alias("gray"))


@query(
    f"SELECT vec_id, CASE WHEN m > 128 THEN 'white' ELSE 'black' END AS fill, CASE WHEN m < 128 THEN 'black' ELSE 'white' END AS outline, CASE WHEN m < 128 THEN 'white' ELSE 'black' END AS letters "
    f"FROM (SELECT vec_id, list_sum(g) / len(g) AS m FROM ({_SQL_GRAYS}))"
)
def fill_colors(spark, d):
    m = pixels.mean(F.col("g"))
    colors = read(spark, d, "embeddings").select("vec_id", _grays()).select("vec_id", pixels.fill_color(m).alias("fill"), pixels.text_colors(m).alias("c"))
    return colors.select("vec_id", "fill", F.col("c.outline").alias("outline"), F.col("c.fill").alias("letters"))


@query("""
WITH h AS (SELECT event_type AS page, (floor(abs(value))::BIGINT % 256)::INT AS gray, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT page, gray, n, sum(n) OVER w AS w0, sum(n * gray) OVER w AS s0, sum(n) OVER (PARTITION BY page) AS wt, sum(n * gray) OVER (PARTITION BY page) AS st FROM h WINDOW w AS (PARTITION BY page ORDER BY gray)),
b AS (SELECT *, CASE WHEN w0 = wt THEN 0 ELSE power((wt * s0 - w0 * st)::DOUBLE, 2) / (w0 * (wt - w0))::DOUBLE END AS v FROM s),
t AS (SELECT page, arg_max(gray, (v, -gray)) AS threshold FROM b GROUP BY page)
SELECT t.page, threshold, sum(n) FILTER (gray > threshold)::BIGINT AS white, sum(n) FILTER (gray <= threshold)::BIGINT AS black,
       sum(n) FILTER (gray <= threshold) > sum(n) FILTER (gray > threshold) AS inverted FROM h JOIN t USING (page) GROUP BY ALL
""")
def otsu_threshold(spark, d):
    """Histograms are counted before they are gathered: 256 numbers a page at most."""
    gray = (F.floor(F.abs("value")) % 256).cast("int")
    h = read(spark, d, "events").select(F.col("event_type").alias("page"), gray.alias("gray")).groupBy("page", "gray").agg(F.count("*").alias("n"))

    def threshold(frames):
        for frame in frames:
            found = []
            for grays, n in zip(frame["grays"], frame["ns"]):
                counts = np.zeros(256, dtype=np.int64)
                counts[np.asarray(grays)] = np.asarray(n)
                found.append(pixels.otsu_of(counts))
            yield frame[["page"]].assign(threshold=found)

    best = h.groupBy("page").agg(F.collect_list("gray").alias("grays"), F.collect_list("n").alias("ns")).mapInPandas(threshold, "page string, threshold int")
    counted = h.join(best, "page").groupBy("page", "threshold").agg(
        F.sum(F.when(F.col("gray") > F.col("threshold"), F.col("n"))).alias("white"), F.sum(F.when(F.col("gray") <= F.col("threshold"), F.col("n"))).alias("black")
    )
    return counted.withColumn("inverted", F.col("black") > F.col("white"))


@query(f"""
WITH g AS ({_SQL_GRAYS})
SELECT a.vec_id, array_to_string(list_transform(a.g, lambda x, i: CASE WHEN (x + b.g[i]) % 2 = 1 THEN b.g[i] ELSE x END), ',') AS mixed FROM g a JOIN g b ON b.vec_id = a.vec_id + 1
""")
def composite(spark, d):
    g = read(spark, d, "embeddings").select("vec_id", _grays())
    other = g.select((F.col("vec_id") - 1).alias("vec_id"), F.col("g").alias("o"))
    mask = F.zip_with("g", "o", lambda x, y: (x + y) % 2)
    return g.join(other, "vec_id").select("vec_id", F.array_join(pixels.composite(F.col("o"), F.col("g"), mask).cast("array<string>"), ",").alias("mixed"))


@query(f"""
WITH p AS MATERIALIZED (SELECT vec_id, i // 8 AS y, i % 8 AS x, g[i + 1] > 60 AS hole FROM (SELECT vec_id, g, unnest(range(64)) AS i FROM ({_SQL_GRAYS}))),
d AS MATERIALIZED (SELECT a.vec_id, a.y, a.x, coalesce(min(CASE WHEN a.hole THEN greatest(abs(a.y - b.y), abs(a.x - b.x)) ELSE 0 END), 0) AS d
      FROM p a LEFT JOIN p b ON a.vec_id = b.vec_id AND NOT b.hole GROUP BY ALL),
s AS (SELECT * FROM (VALUES (0, 0, 0), (0, -1, 0), (0, 0, -1), (0, -1, -1), (1, 0, 0), (1, 1, 0), (1, 0, -1), (1, 1, -1), (2, 0, 0), (2, -1, 0), (2, 0, 1), (2, -1, 1), (3, 0, 0), (3, 1, 0), (3, 0, 1), (3, 1, 1)) AS t(k, dy, dx)),
r AS (SELECT d.vec_id, d.y, d.x, k, bool_or(n.d = d.d - 1) AS hit FROM d CROSS JOIN s JOIN d n ON n.vec_id = d.vec_id AND n.y = 7 - abs(7 - abs(d.y + dy)) AND n.x = 7 - abs(7 - abs(d.x + dx)) WHERE d.d > 0 GROUP BY ALL),
c AS (SELECT vec_id, k, count(*) FILTER (hit) AS n FROM r GROUP BY ALL),
v AS (SELECT vec_id, k, coalesce(n, 0) AS n FROM (SELECT vec_id FROM embeddings) CROSS JOIN (SELECT unnest(range(4)) AS k) LEFT JOIN c USING (vec_id, k))
SELECT vec_id, string_agg(least(127, floor(d * 32))::INT::VARCHAR, ',' ORDER BY y, x) AS distance, any_value(e.reached) AS reached
FROM d JOIN (SELECT vec_id, string_agg(n::VARCHAR, ',' ORDER BY k) AS reached FROM v GROUP BY vec_id) e USING (vec_id) GROUP BY vec_id
""")
def position_rings(spark, d):
    """Each embedding as a mask of 8 x 8: distances and directions into its hole."""

    def run(frames):
        for frame in frames:
            rows = []
            for g in frame["g"]:
                distance, directions = pixels.rings((np.asarray(g).reshape(8, 8) > 60).astype(np.uint8), size=8)
                rows.append([",".join(map(str, x.ravel().tolist())) for x in (distance, directions.sum(axis=(0, 1)))])
            yield frame[["vec_id"]].assign(distance=[r[0] for r in rows], reached=[r[1] for r in rows])

    return read(spark, d, "embeddings").select("vec_id", _grays()).mapInPandas(run, "vec_id long, distance string, reached string")


def _images(spark: SparkSession, d: str, make: Callable, schema: str) -> DataFrame:
    """What ``make(vec_id, 8 x 8 image)`` gives for each embedding, batch by batch."""

    def run(frames):
        for frame in frames:
            rows = [make(i, np.asarray(g, dtype=np.uint8).reshape(8, 8)) for i, g in zip(frame["vec_id"], frame["g"])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return read(spark, d, "embeddings").select("vec_id", _grays()).mapInPandas(run, schema)


@query(f"""
WITH h AS (SELECT vec_id, gray, count(*) AS n FROM (SELECT vec_id, unnest(g) AS gray FROM ({_SQL_GRAYS})) GROUP BY ALL),
s AS (SELECT vec_id, gray, sum(n) OVER w AS w0, sum(n * gray) OVER w AS s0, sum(n) OVER (PARTITION BY vec_id) AS wt, sum(n * gray) OVER (PARTITION BY vec_id) AS st FROM h WINDOW w AS (PARTITION BY vec_id ORDER BY gray)),
b AS (SELECT *, CASE WHEN w0 = wt THEN 0 ELSE power((wt * s0 - w0 * st)::DOUBLE, 2) / (w0 * (wt - w0))::DOUBLE END AS v FROM s),
t AS (SELECT vec_id, CASE WHEN max(v) > 0 THEN arg_max(gray, (v, -gray)) ELSE 0 END AS threshold FROM b GROUP BY vec_id),
c AS (SELECT vec_id, count(*) FILTER (gray > threshold) AS white FROM (SELECT vec_id, unnest(g) AS gray FROM ({_SQL_GRAYS})) JOIN t USING (vec_id) GROUP BY vec_id)
SELECT vec_id, (CASE WHEN 2 * white < 64 THEN 64 - white ELSE white END)::BIGINT AS white, 3 AS channels FROM c
""")
def reading_parts(spark, d):
    """Embeddings as parts of pages made ready to be read: black text on white in three channels."""

    def one(i, image):
        out = pixels.binarize(image)
        return i, int((out[..., 0] == 255).sum()), out.shape[2]

    return _images(spark, d, one, "vec_id long, white long, channels int")


@query(f"""
WITH p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, g[i + 1] AS v FROM (SELECT vec_id, g, unnest(range(64)) AS i FROM ({_SQL_GRAYS}))),
m AS (SELECT vec_id, avg(v) FILTER (x BETWEEN 1 AND 4 AND y BETWEEN 2 AND 4) AS a FROM p GROUP BY vec_id)
SELECT vec_id, sum(CASE WHEN x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 5 THEN CASE WHEN a > 128 THEN 255 ELSE 0 END ELSE v END)::BIGINT AS total FROM p JOIN m USING (vec_id) GROUP BY vec_id
""")
def filled_boxes(spark, d):
    """A detection on each embedding painted over by the mean around it."""
    return _images(spark, d, lambda i, image: (i, int(pixels.fill_boxes(image, [(2, 3, 3, 2)]).sum(dtype=np.int64))), "vec_id long, total long")


@query(f"""
SELECT vec_id, round(sum(CASE WHEN v >= 128 THEN 0 ELSE v / 127.5::DOUBLE - 1 END), 2) AS total, count(*) FILTER (v >= 128) AS hole, 4 AS added_rows, 2 AS added_columns
FROM (SELECT vec_id, g[least(y, 15 - y) * 8 + least(x, 15 - x) + 1] AS v FROM (SELECT vec_id, g, unnest(range(12)) AS y FROM ({_SQL_GRAYS})), (SELECT unnest(range(10)) AS x)) GROUP BY vec_id
""")
def model_inputs(spark, d):
    """What an inpainting model gets for each embedding, filled up to 12 x 10, with its bright pixels as the hole."""

    def one(i, image):
        scaled, hole, (rows, columns) = pixels.model_input(image[..., None], np.where(image >= 128, 255, 0).astype(np.uint8), least=12)
        scaled, hole = scaled[0, :, :10], hole[:, :10]
        return i, round(float(scaled.sum(dtype=np.float64)), 2), int(hole.sum()), rows, columns - 2

    return _images(spark, d, one, "vec_id long, total double, hole long, added_rows int, added_columns int")


@query(f"""
SELECT vec_id::INT AS page, CASE WHEN vec_id % 5 = 0 THEN 3 WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS attempts,
       CASE WHEN vec_id % 5 = 0 THEN 'RuntimeError: CUDA out of memory' WHEN vec_id % 7 = 0 AND vec_id % 3 <> 0 THEN 'ValueError: odd' END AS error,
       CASE WHEN vec_id % 5 = 0 OR (vec_id % 7 = 0 AND vec_id % 3 <> 0) THEN NULL WHEN vec_id % 3 = 0 THEN '1,1,2,2' ELSE '1,1,2,2' END AS box,
       CASE WHEN vec_id % 5 = 0 OR (vec_id % 7 = 0 AND vec_id % 3 <> 0) THEN NULL ELSE 64 END::INT AS size
FROM embeddings
""".replace("CASE WHEN vec_id % 5 = 0 THEN 3 WHEN", "CASE WHEN vec_id % 5 = 0 THEN 3 WHEN vec_id % 7 = 0 AND vec_id % 3 <> 0 THEN 1 WHEN"))
def page_driver(spark, d):
    """Every embedding as a page through a detector that is short of memory on some, and fails on others."""
    number = F.col("vec_id").cast("int")
    image = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.col("data"))
    g = read(spark, d, "embeddings").select("vec_id", _grays())

    def to_bytes(frames):
        for frame in frames:
            # the first two pixels say how the detector takes the page
            kinds = [(1 if i % 5 == 0 else 2 if i % 7 == 0 and i % 3 != 0 else 3 if i % 3 == 0 else 0) for i in frame["vec_id"]]
            data = [bytes([k * 60]) * 64 for k in kinds]
            yield frame[["vec_id"]].assign(data=data)

    def detect(page):
        kind = int(page[0, 0, 0]) // 60
        if kind == 1 or kind == 3 and page.shape[0] == 8:
            raise RuntimeError("CUDA out of memory")
        if kind == 2:
            raise ValueError("odd")
        return [(1, 1, 2, 2)]

    rows = g.mapInPandas(to_bytes, "vec_id long, data binary").select(F.lit("t").alias("title"), number.alias("page"), image.alias("image"))
    done = pages.process_pages(rows, detect, pixels.fill_boxes, lambda page: page.tobytes())
    box = F.col("boxes")[0]
    return done.select("page", "attempts", "error", F.concat_ws(",", *[box[c] for c in "xywh"]).alias("b"), F.length("content").alias("size")).select(
        "page", "attempts", "error", F.when(F.col("size").isNotNull(), F.col("b")).alias("box"), "size"
    )


# --- layout ---------------------------------------------------------------------------------------------------------------------


def sql_wrap(t: str, size: str, width: str) -> str:
    return (
        f"list_reduce(list_filter(string_split_regex({t}, '[{_WS}]+'), lambda x: x <> ''), "
        f"lambda a, x: CASE WHEN floor((length(string_split(a, chr(10))[-1]) + 1 + length(x)) * {size} * 3 / 5) > greatest(1, {width}) THEN a || chr(10) || x ELSE a || ' ' || x END)"
    )


@query(f"SELECT item_id, {sql_wrap('text', '16', '300')} AS lines FROM benchmark")
def word_wrap(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.array_join(layout.wrap(F.col("text"), F.lit(16), F.lit(300)), "\n").alias("lines"))


_SQL_FIT = f"""
WITH c AS (SELECT item_id, text, 200 + item_id % 7 * 60 AS w, 150 + item_id % 5 * 90 AS h FROM benchmark),
s AS (SELECT *, unnest(range(12, 101))::INT AS size FROM c),
l AS (SELECT *, string_split({sql_wrap('text', 'size', 'w')}, chr(10)) AS lines FROM s),
f AS (SELECT item_id, w, h, size, lines, len(lines) * size + (len(lines) - 1) * least(14.0::DOUBLE, size * 0.42::DOUBLE) <= h AND list_max(list_transform(lines, lambda x: floor(length(x) * size * 3 / 5)::INT)) <= w AS ok FROM l),
b AS (SELECT item_id, greatest(12, coalesce(min(size) FILTER (NOT ok), 101) - 1)::INT AS size FROM f GROUP BY item_id)
"""


@query(_SQL_FIT + "SELECT item_id, b.size AS font, len(lines)::INT AS n_lines FROM b JOIN f USING (item_id) WHERE f.size = b.size")
def font_fit(spark, d):
    c = read(spark, d, "benchmark").withColumns({"w": (200 + F.col("item_id") % 7 * 60).cast("int"), "h": (150 + F.col("item_id") % 5 * 90).cast("int")})
    sized = c.withColumn("font", layout.font_size(F.col("text"), F.col("w"), F.col("h")))
    return sized.select("item_id", "font", F.size(layout.wrap(F.col("text"), F.col("font"), F.col("w"))).alias("n_lines"))


@query(f"""
WITH c AS (SELECT item_id, string_split({sql_wrap('text', '16', '300')}, chr(10)) AS lines FROM benchmark),
l AS (SELECT item_id, len(lines) AS n, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM c)
SELECT item_id, k::INT AS k, line, (40 + greatest(0, floor((300 - floor(length(line) * 16 * 3 / 5)) / 2)))::INT AS x,
       round(60 + greatest(0, (900 - (n * 16 + (n - 1) * 6.72::DOUBLE)) / 2) + k * (16 + 6.72::DOUBLE), 4) AS y FROM l
""")
def text_layout(spark, d):
    lines = layout.wrap(F.col("text"), F.lit(16), F.lit(300))
    placed = layout.place_lines(lines, F.lit(16), F.lit(40), F.lit(60), F.lit(300), F.lit(900))
    rows = read(spark, d, "benchmark").select("item_id", F.posexplode(placed).alias("k", "p"))
    return rows.select("item_id", "k", F.col("p.line").alias("line"), F.col("p.x").alias("x"), F.round("p.y", 4).alias("y"))


@query("SELECT doc_id, doc_id || '.' || CASE WHEN doc_id % 3 = 0 THEN 'PNG' ELSE 'jpg' END AS file, octet_length(encode(source))::BIGINT AS length FROM documents WHERE doc_id % 4 <> 1")
def listed_pages(spark, d):
    """A file for each document, some of which aren't images, written and listed again."""
    folder = shared_dir(spark)
    ending = F.when(F.col("doc_id") % 4 == 1, F.lit("txt")).when(F.col("doc_id") % 3 == 0, F.lit("PNG")).otherwise(F.lit("jpg"))
    name = F.concat(files.shelf(F.col("doc_id")), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ending)
    made = read(spark, d, "documents").select(name.alias("name"), F.col("source").cast("binary").alias("content"))
    made_in = files.written_folders(files.write_files(made, folder), folder)
    return files.list_pages(spark, made_in).select(F.split("file", r"\.")[0].cast("long").alias("doc_id"), "file", "length")


@query("SELECT doc_id, 'page-' || doc_id AS name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_resources(spark, d):
    """Documents as wanted files, those with a label as the ones that are there."""
    name = F.concat(F.lit("page-"), F.col("doc_id").cast("string")).alias("name")
    return files.missing(read(spark, d, "documents").select("doc_id", name), read(spark, d, "labels").select(name).distinct()).select("doc_id", "name")


@query("SELECT l_orderkey AS page, l_linenumber AS pos, least(a, b, c) AS x, least(d, e) AS y, greatest(a, b, c) - least(a, b, c) + 1 AS w, greatest(d, e) - least(d, e) + 1 AS h FROM (SELECT *, (l_partkey % 460)::INT AS a, (l_suppkey % 97)::INT AS b, l_quantity::INT AS c, (l_linenumber * 50)::INT AS d, (l_quantity * 3)::INT AS e FROM lineitem)")
def bounding_boxes(spark, d):
    """Polygons of three points as rectangles."""
    a, b, c = (F.col("l_partkey") % 460).cast("int"), (F.col("l_suppkey") % 97).cast("int"), F.col("l_quantity").cast("int")
    low, high = (F.col("l_linenumber") * 50).cast("int"), (F.col("l_quantity") * 3).cast("int")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    quad = F.array(point(a, low), point(b, high), point(c, low))
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("pos"), geometry.bounding_box(quad).alias("b")).select("page", "pos", "b.*")


@query("""
SELECT event_id, contains(m, 'cuda') OR contains(m, 'out of memory') AS retry_smaller, contains(m, '429') AND contains(m, 'rate_limit_exceeded') AND contains(m, 'tokens') AS used_up
FROM (SELECT event_id, lower(CASE event_id % 4 WHEN 0 THEN 'Error 429 rate_limit_exceeded: TOKENS ' WHEN 1 THEN 'CUDA error ' WHEN 2 THEN 'Error 429 tokens ' ELSE 'Out of Memory ' END || coalesce(props, '')) AS m FROM events)
""")
def error_kinds(spark, d):
    """Messages of failed requests and pages: after which a smaller page is tried, and after which nothing is."""
    heads = ["Error 429 rate_limit_exceeded: TOKENS ", "CUDA error ", "Error 429 tokens ", "Out of Memory "]
    message = F.concat(F.element_at(F.array(*map(F.lit, heads)), (F.col("event_id") % 4 + 1).cast("int")), F.coalesce("props", F.lit("")))
    return read(spark, d, "events").select("event_id", translate.out_of_memory(message).alias("retry_smaller"), translate.used_up(message).alias("used_up"))


@query("SELECT title, n AS n_files, title || '_Traducido.pdf' AS name, files FROM (SELECT lang AS title, count(*) AS n, string_agg(doc_id || '.jpg', ',' ORDER BY doc_id) AS files FROM documents GROUP BY lang) WHERE n % 2 = 0 OR title < 'e'")
def compiled_titles(spark, d):
    """Titles of which all pages are there, their files in natural order; of others one is missing."""
    made = read(spark, d, "documents").select(F.col("lang").alias("title"), F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("file"))
    counted = made.groupBy("title").agg(F.count("*").alias("n"))
    expected = counted.select("title", F.when((F.col("n") % 2 == 0) | (F.col("title") < "e"), F.col("n")).otherwise(F.col("n") + 1).alias("n"))
    return pages.compile_titles(made, expected).select("title", F.size("files").cast("long").alias("n_files"), "name", F.array_join("files", ",").alias("files"))


@query(f"""
WITH c AS (SELECT conv_id AS title, turn // 4 AS page, turn % 4 AS pos, CASE WHEN turn % 16 = 3 THEN text || '?' ELSE text END AS text FROM conversations),
p AS (SELECT title, page, bool_or(contains(text, '?')) AS bad FROM c GROUP BY ALL)
SELECT title, page, pos, {sql_clean("'«' || text || '»'")} AS traduccion, CASE WHEN bad THEN 'single' ELSE 'batch' END AS method FROM c JOIN p USING (title, page)
""")
def translate_page(spark, d):
    """Pages of four turns through a model whose JSON answers are validated; an answer that lacks an id is no answer."""
    texto = F.when(F.col("turn") % 16 == 3, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    turn = F.col("turn")
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("title"), F.floor(turn / 4).alias("page"), (turn % 4).alias("pos"), texto.alias("texto"))
    batch = translate.json_batch(providers.echo_model, "Japonés", "Español", "A test.")
    return translate.translate(rows, batch, providers.provider("translate", "echo"), pause=None).select("title", "page", "pos", "traduccion", "method")


# --- documents ------------------------------------------------------------------------------------------------------------------


@query(f"""
SELECT conv_id AS title, to_json({{'Título': conv_id::VARCHAR, 'Páginas': count(*)::INT, 'Transcripción': list({{'Página': turn::INT, 'Texto': t}} ORDER BY turn)}})::VARCHAR AS document
FROM (SELECT conv_id, turn, {sql_clean('text')} AS t FROM conversations) WHERE t <> '' GROUP BY conv_id
""")
def conversation_document(spark, d):
    """Turns cleaned, blank ones dropped, and gathered in order to a document for each conversation."""
    cleaned = read(spark, d, "conversations").select("conv_id", "turn", text.clean(F.col("text")).alias("t")).filter("t <> ''")
    page = F.struct(F.col("turn").cast("int").alias("Página"), F.col("t").alias("Texto"))
    titles = cleaned.groupBy("conv_id").agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(page)).alias("pages"))
    whole = F.struct(F.col("conv_id").cast("string").alias("Título"), F.col("n").alias("Páginas"), F.col("pages").alias("Transcripción"))
    return titles.select(F.col("conv_id").alias("title"), F.to_json(whole).alias("document"))


@query("""
WITH b AS (SELECT conv_id, turn // 2 AS page, turn % 2 AS pos, {'Coordenadas': [[turn::INT, 0], [turn::INT + 10, 20]], 'Texto': text} AS b FROM conversations),
p AS (SELECT conv_id, page, list(b ORDER BY pos) AS g FROM b GROUP BY ALL)
SELECT conv_id::VARCHAR AS title, to_json({'Título': conv_id::VARCHAR, 'Páginas': count(*)::INT, 'Traducción': list({'Página': page::INT, 'Formato': 'Color', 'Globos de texto': g} ORDER BY page)})::VARCHAR AS document
FROM p GROUP BY conv_id
""")
def title_documents(spark, d):
    turn = F.col("turn").cast("int")
    balloon = docs.balloon(turn, F.lit(0), F.lit(10), F.lit(20), F.col("text"))
    b = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("title"), F.floor(turn / 2).alias("page"), (turn % 2).alias("pos"), balloon.alias("balloon"))
    return docs.assemble(b, b.select("title", "page", F.lit("Color").alias("format")), "Traducción")


@query(_SQL["title_documents"])
def document_files(spark, d):
    """Every title's document as a file of indented JSON, read back."""
    folder = shared_dir(spark)
    made = title_documents(spark, d).select(F.concat(files.shelf(F.col("title").cast("long")), F.lit("/"), "title").alias("title"), "document")
    made_in = files.written_folders(sinks.write_document_files(made, folder), folder)

    def compact(frames):
        for frame in frames:
            bodies = [json.dumps(json.loads(bytes(c)), ensure_ascii=False, separators=(",", ":")) for c in frame["content"]]
            yield frame[["title"]].assign(document=bodies)

    found = files.list_files(spark, made_in, content=True).select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("title"), "content")
    return found.mapInPandas(compact, "title string, document string")


@query("""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber <> 1 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT o_orderkey, 1, -1 FROM orders WHERE o_orderstatus = 'F'
""")
def page_upsert(spark, d):
    old = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(-1.0).alias("l_quantity"))
    return docs.upsert(old, new, ["l_orderkey", "l_linenumber"])


def _messages(events: DataFrame) -> DataFrame:
    """Events as a writer's messages, a document for each user."""
    kinds = {"signup": "header", "view": "pages", "click": "append", "purchase": "balloon", "error": "oops"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("doc"), F.try_element_at(kind, F.col("event_type")).alias("kind"), F.col("props").alias("payload"))


_SQL_WRITER = """
SELECT user_id::VARCHAR AS doc, arg_max(props, event_id) FILTER (event_type = 'signup') AS title, arg_max(props, event_id) FILTER (event_type = 'view') AS pages,
       count(*) FILTER (event_type = 'click') AS n_appended, {n} AS n_balloons, 0::BIGINT AS n_finish, count(*) FILTER (event_type = 'error') AS n_unknown, max(event_id) AS last_seq
FROM events GROUP BY user_id
"""


@query(_SQL_WRITER.format(n="count(DISTINCT props) FILTER (event_type = 'purchase')"))
def writer_state(spark, d):
    return writer.documents_batch(_messages(read(spark, d, "events")))


_SQL_WRITTEN = """
WITH m AS (SELECT event_id AS seq, user_id::VARCHAR AS doc, event_type AS t, event_id % 5 AS page FROM events),
h AS (SELECT doc, max(seq) AS v, min(seq) AS f FROM m WHERE t = 'signup' GROUP BY doc),
s1 AS (SELECT doc, page, t, '"' || CASE t WHEN 'click' THEN 'Globos de texto' ELSE 'Notas' END || '":[' || string_agg(seq::VARCHAR, ',' ORDER BY seq) || ']' AS x, min(seq) AS f FROM m WHERE t IN ('click', 'purchase') GROUP BY doc, page, t),
s AS (SELECT doc, page, string_agg(x, ',' ORDER BY f) AS extra, min(f) AS seq FROM s1 GROUP BY ALL),
r AS (SELECT doc, page, seq, '{"Página":' || page || ',"n":' || seq || '}' AS v, true AS own FROM m WHERE t = 'view' UNION ALL SELECT doc, page, seq, '{"Página":' || page || '}', false FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY seq) AS n FROM r),
b AS (SELECT k.doc, k.page, k.seq, CASE WHEN n = 1 AND extra IS NOT NULL THEN left(v, -1) || ',' || extra || '}' ELSE v END AS v FROM k LEFT JOIN s ON k.doc = s.doc AND k.page = s.page WHERE own OR n = 1),
o AS (SELECT doc, max(seq) AS z FROM m WHERE t = 'error' GROUP BY doc),
l AS (SELECT b.doc, '"Traducción":[' || string_agg(v, ',' ORDER BY b.seq > coalesce(z, -1), CASE WHEN b.seq <= coalesce(z, -1) THEN page END, b.seq) || ']' AS x, min(b.seq) AS f FROM b LEFT JOIN o ON b.doc = o.doc GROUP BY b.doc)
SELECT doc, '{' || string_agg(x, ',' ORDER BY f) || '}' AS document FROM (SELECT doc, '"Título":' || v AS x, f FROM h UNION ALL SELECT doc, x, f FROM l) GROUP BY doc
"""


def _element_messages(events: DataFrame) -> DataFrame:
    """Events as messages that set titles, add pages and balloons, and order pages."""
    kinds = {"signup": "header", "view": "append", "click": "sub", "purchase": "sub", "error": "sort"}
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type"))
    seq, page = F.col("event_id"), (F.col("event_id") % 5).cast("int")
    value = F.when(kind == "append", F.to_json(F.struct(page.alias("Página"), seq.alias("n")))).otherwise(seq.cast("string"))
    name = F.when(kind == "header", F.lit("Título")).otherwise(F.lit("Traducción"))
    sub = F.when(F.col("event_type") == "click", F.lit("Globos de texto")).otherwise(F.lit("Notas"))
    return events.select(seq.alias("seq"), F.col("user_id").cast("string").alias("doc"), kind.alias("kind"), name.alias("name"), page.alias("page"), sub.alias("sub"), value.alias("value"))


@query(_SQL_WRITTEN)
def writer_documents(spark, d):
    """The documents themselves, with their lists, page records and order."""
    return docs.written_documents(_element_messages(read(spark, d, "events")))


@query(_SQL_WRITTEN)
def writer_documents_stream(spark, d):
    """The same from a stream."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    messages = _element_messages(spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet"))
    running = writer.DocumentsWriter(messages, shared_dir(spark), merge=docs.written_documents)
    running.query.awaitTermination()
    return running.current()


@query(_SQL_WRITER.format(n="count(DISTINCT props) FILTER (event_type = 'purchase')"))
def writer_stream(spark, d):
    """The same from a stream of the table's files, run to its end."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a stream reads folders or patterns; this pattern is the file, or the files of the folder, of that name
    running = writer.DocumentsWriter(_messages(spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")), shared_dir(spark))
    running.query.awaitTermination()
    return running.current()
