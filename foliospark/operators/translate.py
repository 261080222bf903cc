"""Batches of texts through a translation provider: ids, validation, fallback, context."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_string, is_blank, pair

#: Languages of the reader's interface and their codes; the second provider's code where it differs.
LANGUAGES = {"Auto": "auto", "Español": "es", "Inglés": "en", "Portugués": "pt", "Francés": "fr", "Italiano": "it", "Japonés": "ja", "Coreano": "ko", "Chino": "zh"}
#: Codes of the recogniser; others are read as English.
READER = {"en": "en", "ko": "korean", "zh": "ch", "es": "es"}
PROVIDER_CODES = {("google", "zh"): "zh-CN"}
#: What an error message holds, all of it, if the provider's tokens are used up.
USED_UP = ("429", "rate_limit_exceeded", "tokens")


def language_code(name: Column, default: str | None = None) -> Column:
    """The code of a language; for another the default, or null."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, name), F.lit(default))


def provider_code(code: Column, provider: str) -> Column:
    out = code
    for (p, c), special in PROVIDER_CODES.items():
        if p == provider:
            out = F.when(code == c, F.lit(special)).otherwise(out)
    return out


def same_language(a: Column, b: Column) -> Column:
    """Equal primary subtags, whatever the case; ``auto`` is like no language."""
    x, y = (F.lower(F.split_part(c, F.lit("-"), F.lit(1))) for c in (a, b))
    return F.coalesce((x == y) & (x != "auto"), F.lit(False))


def reader_code(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in READER.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), F.lit("en"))


def used_up(message: Column) -> Column:
    """An error that no further attempt can help."""
    lower = F.lower(message)
    out = F.lit(True)
    for part in USED_UP:
        out = out & F.contains(lower, F.lit(part))
    return F.coalesce(out, F.lit(False))


def out_of_memory(message: Column) -> Column:
    """An error after which a smaller image is tried."""
    lower = F.lower(message)
    return F.coalesce(F.contains(lower, F.lit("cuda")) | F.contains(lower, F.lit("out of memory")), F.lit(False))


def validate(expected: DataFrame, answered: DataFrame) -> DataFrame:
    """By page: whether the ids answered (page, id) are exactly those expected (page, id), each once.

    Rows (page, n_expected, n_answered, missing, unknown, repeated, valid) with sorted lists. Ids are counted by (page, id) before
    anything is gathered by page. A null id is unknown.
    """
    e = expected.filter("id is not null").groupBy("page", "id").agg(F.lit(1).alias("e"))
    a = answered.groupBy("page", "id").agg(F.count("*").alias("a"))
    both = e.alias("e").join(a.alias("a"), (F.col("e.page") == F.col("a.page")) & F.col("e.id").eqNullSafe(F.col("a.id")), "full").select(
        F.coalesce("e.page", "a.page").alias("page"), F.coalesce("e.id", "a.id").alias("id"), F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("a", F.lit(0)).alias("n")
    )
    ids = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.coalesce(F.col("id"), F.lit(-1)))))
    out = both.groupBy("page").agg(
        F.sum("e").alias("n_expected"),
        F.sum("n").alias("n_answered"),
        ids((F.col("e") == 1) & (F.col("n") == 0)).alias("missing"),
        ids(F.col("e") == 0).alias("unknown"),
        ids(F.col("n") > 1).alias("repeated"),
    )
    return out.withColumn("valid", (F.size("missing") == 0) & (F.size("unknown") == 0) & (F.size("repeated") == 0))


def parse_responses(responses: DataFrame) -> DataFrame:
    """Rows (page, body) of model answers, taken apart: page, id, traduccion, and ``well_formed`` for the page.

    JSON true counts as id 1, as it does to Python; a body that isn't JSON, lacks the list, or holds an entry of other types isn't well formed and has no entries.
    """
    parsed = responses.select("page", F.try_parse_json("body").alias("v"))
    items = F.try_variant_get("v", "$.traducciones", "array<variant>")
    kind = lambda v, path, t: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == t, F.lit(False))
    number = lambda v: F.when(kind(v, "$.id", "BOOLEAN"), F.try_variant_get(v, "$.id", "boolean").cast("int")).otherwise(F.try_variant_get(v, "$.id", "int"))
    sound = F.forall("items", lambda v: (kind(v, "$.id", "BIGINT") | kind(v, "$.id", "BOOLEAN")) & kind(v, "$.traduccion", "STRING"))
    judged = parsed.select("page", items.alias("items")).withColumn("well_formed", F.coalesce(sound, F.lit(False)))
    entries = F.when(F.col("well_formed"), F.transform("items", lambda v: F.struct(number(v).alias("id"), F.try_variant_get(v, "$.traduccion", "string").alias("traduccion"))))
    return judged.select("page", "well_formed", F.explode_outer(entries).alias("e")).select("page", "well_formed", "e.id", "e.traduccion")


def scatter_back(items: DataFrame, translated: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Items (page, pos, texto) with ``salida``: their translation (page, pos, traduccion); blanks and what has none pass through.

    An empty translation leaves the original, unless ``keep_empty``.
    """
    t = F.col("traduccion") if keep_empty else F.nullif(F.col("traduccion"), F.lit(""))
    return items.join(translated.select("page", "pos", "traduccion"), ["page", "pos"], "left").select(
        "page", "pos", "texto", F.coalesce(F.when(~is_blank(F.col("texto")), t), F.col("texto"), F.lit("")).alias("salida")
    )


def context(pairs: DataFrame, last: int = 2) -> DataFrame:
    """Rows (title, page, ctx) with ``previo``: the contexts of the title's last pages before it that have any."""
    before = Window.partitionBy("title").orderBy("page").rowsBetween(-last, -1)
    return pairs.filter(F.size("ctx") > 0).withColumn("previo", F.collect_list("ctx").over(before))


def page_context(texts: DataFrame) -> DataFrame:
    """Texts (title, page, pos, texto, traduccion) as rows (title, page, ctx): the page's pairs in order, without blank sides."""
    remembered = texts.select("title", "page", "pos", pair(F.col("texto"), F.col("traduccion")).alias("p")).filter("p is not null")
    return remembered.groupBy("title", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: x["p"]).alias("ctx"))


def request_json(previous: Column, items: Column) -> Column:
    """The JSON of a request: context, then texts with their ids; not blank ones only are sent."""
    return F.to_json(F.struct(previous.alias("contexto_previo"), items.alias("textos_a_traducir")))


def token_budget(items: Column) -> Column:
    return F.greatest(F.lit(256), F.size(items) * 96)


def system_prompt(source: str, target: str, lore: str | None = None) -> str:
    """What a model is told before a request: the languages, the story if there is one, and the shape of the answer."""
    story = f" The story so far: {lore}" if lore else ""
    return (
        f"Translate comic dialogue from {source} to {target}.{story} Texts were read by a machine: mend letters that were misread where the scene tells, and give "
        "'...' for what can't be understood. Keep names, forms of address and tone as in contexto_previo. Answer with JSON only, an object with a list "
        "'traducciones' of objects with the 'id' of a text and its 'traduccion', one for each text."
    )


def read_answer(answer: str, count: int) -> list[str]:
    """The translations of a model's JSON answer in the order of their ids, 0 to count - 1, each of which must be there once; else ValueError.

    JSON true counts as 1, as in ``parse_responses``.
    """
    try:
        rows = json.loads(answer)["traducciones"]
        found = [(r["id"], r["traduccion"]) for r in rows]
    except (TypeError, KeyError, json.JSONDecodeError) as e:
        raise ValueError(f"the answer has another shape: {e}") from None
    out: list[str | None] = [None] * count
    for i, text in found:
        if not isinstance(i, int) or not isinstance(text, str):
            raise ValueError(f"an id or translation of another type: {i!r}")
        if not 0 <= i < count or out[i] is not None:
            raise ValueError(f"{'unknown' if not 0 <= i < count else 'repeated'} id: {i}")
        out[i] = text
    missing = [i for i, t in enumerate(out) if t is None]
    if missing:
        raise ValueError(f"ids without a translation: {missing}")
    return out


def json_batch(ask: Callable[[str, str, int], str], source: str, target: str, lore: str | None = None) -> Callable[[list[str], list[list[str]]], list[str]]:
    """A ``batch`` for ``translate`` from a model: ask(prompt, request, token budget) gives its answer, which is validated."""
    prompt = system_prompt(source, target, lore)

    def batch(texts: list[str], ctx: list[list[str]]) -> list[str]:
        request = {"contexto_previo": ctx, "textos_a_traducir": [{"id": i, "texto": t} for i, t in enumerate(texts)]}
        return read_answer(ask(prompt, json.dumps(request, ensure_ascii=False), max(256, 96 * len(texts))), len(texts))

    return batch


def translate(
    df: DataFrame,
    batch: Callable[[list[str], list[list[str]]], list[str]] | None,
    single: Callable[[str], str],
    attempts: int = 3,
    source: str = "ja",
    target: str = "es",
    clean: bool = True,
    pause: Callable[[float], None] | None = time.sleep,
) -> DataFrame:
    """Texts (title, page, pos, texto) with ``traduccion``, ``method``: model pages in order, with the context of the last two.

    A page's non-blank texts go to ``batch`` with the context; an answer of another length or an error is tried again, up to ``attempts``
    times with 1, 2, 4, ... seconds between them (``pause``; None: at once), and not again once its tokens are used up; then each text goes to ``single``,
    whose failure or empty answer leaves the text as it is. Without a ``batch`` every text goes to ``single``, an answer of one letter counts as none
    and gives an empty text, and nothing is remembered. Translations are cleaned, as recognised texts are, and so remembered, unless ``clean`` is false.
    A title is one ordered unit, as each page's context holds the answers for the pages before it; titles run in parallel. Pages of a
    title stream through in order, so a long title needs no more memory than a batch.
    """
    same = source.split("-")[0].lower() == target.split("-")[0].lower() and source.lower() != "auto"

    def one(text: str) -> str:
        try:
            got = single(text)
        except Exception:  # noqa: BLE001 a provider may fail in any way; the text stays
            return text
        if batch is None:
            return got if isinstance(got, str) and len(got) > 1 else ""
        return got if isinstance(got, str) and got else text

    def page(texts: list[str], ctx: list[list[str]]) -> tuple[list[str], str]:
        some = [i for i, t in enumerate(texts) if t.strip()]
        if same or not some:
            return texts, "copy"
        for attempt in range(attempts if batch is not None else 0):
            try:
                if attempt and pause is not None:
                    pause(2.0 ** (attempt - 1))
                got = batch([texts[i] for i in some], ctx[-2:])
                if len(got) == len(some) and all(isinstance(g, str) for g in got):
                    out = list(texts)
                    for i, g in zip(some, got):
                        out[i] = g
                    return out, "batch"
            except Exception as e:  # noqa: BLE001
                if all(p in str(e).lower() for p in USED_UP):
                    break
        out = list(texts)
        for i in some:
            out[i] = one(texts[i])
        return out, "single"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        title, ctx, held = None, [], None

        def finish(group: pd.DataFrame) -> pd.DataFrame:
            nonlocal title, ctx
            if group["title"].iloc[0] != title:
                title, ctx = group["title"].iloc[0], []
            texts = [t if isinstance(t, str) else "" for t in group["texto"]]
            out, how = page(texts, ctx)
            out = [clean_string(t) for t in out] if clean else out
            pairs = [f"{a} -> {b}" for a, b in zip(texts, out) if a.strip() and b.strip()]
            if pairs and batch is not None:
                ctx = [*ctx, pairs][-3:]
            return group.assign(traduccion=out, method=how)

        for frame in frames:
            frame = pd.concat([held, frame]) if held is not None else frame
            if not len(frame):
                continue
            number = ((frame["title"] != frame["title"].shift()) | (frame["page"] != frame["page"].shift())).cumsum()
            groups = [g for _, g in frame.groupby(number, sort=False)]
            held = groups.pop()
            if groups:
                yield pd.concat([finish(g) for g in groups])
        if held is not None:
            yield finish(held)

    source_rows = df.select("title", "page", "pos", "texto").repartition("title").sortWithinPartitions("title", "page", "pos")
    types = dict(source_rows.dtypes)
    schema = f"title {types['title']}, page {types['page']}, pos {types['pos']}, texto string, traduccion string, method string"
    return source_rows.mapInPandas(run, schema)
