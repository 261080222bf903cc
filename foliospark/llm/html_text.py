"""Main text of web pages: structure proposes blocks, and what repeats across a host's pages is taken out of them.

Where a page marks its article, its blocks are proposed without what is in them of menus, notices and the like; of other pages, all blocks that
aren't marked as such. The token streams of what all pages of a host have outside of marked articles are concatenated, and a suffix array finds
the long substrings that distinct pages share: the host's boilerplate. Words of proposed blocks that those cover are removed and unique runs stay, but
for marked articles, whose text is whole: articles hold sentences that adverts of other pages have too.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Filter, array, drop_dir, materialize, mix, narrow, shared_dir, slices, starts

#: Tokens of the shortest substring that counts as long; distinct pages that must share it; pages in one suffix array.
LONG, PAGES, GROUP = 8, 3, 2000
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*+")
_STOP = re.compile(r"[>\"']")
_HIDDEN = frozenset("script style template noscript textarea svg iframe title".split())
_ENDS = {t: re.compile(rf"</{t}\s*+>", re.I) for t in _HIDDEN}
_HEAD_END = re.compile(r"</head\s*+>|(?=<body\b)", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label map mark meter output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr td th".split())
_SPACED = frozenset(("td", "th"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OPEN = frozenset("nav header footer aside form button select dialog menu article main div section ul ol dl table fieldset figure address blockquote details body html object video audio canvas".split())
_CHROME_TAGS = frozenset("nav footer aside form button select dialog menu object video audio canvas".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
_CHROME = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices newsletter "
    "subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments disqus share sharing social "
    "related recommended popup modal overlay pagination pager widget login signup toolbar respond replies skip".split()
)
_MAIN = frozenset(("article", "post", "entry", "story", "content", "main"))
_PLACES = frozenset("site page main post entry article content global primary secondary top bottom left right header js".split())
_ARTICLE = re.compile(r"<(?:article|main)\b", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+", re.I)


def _named_chrome(parts: list[str]) -> bool:
    """Whether a name begins with a word of chrome, or goes on with one after words for a part of a page: has-sidebar doesn't."""
    first = next((p for p in parts if p in _CHROME or p not in _PLACES), "")
    return first in _CHROME


def role(tag: str, attributes: str) -> str:
    """chrome, main or nothing, from a tag and its class, id, role and visibility."""
    return _short_role(tag, attributes) if len(attributes) < 500 else _role(tag, attributes)


def _role(tag: str, attributes: str) -> str:
    found = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), a or b or c)
    if tag in _CHROME_TAGS or found.get("role", "").lower() in _CHROME_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return "chrome"
    names = [w.lower() for w in (found.get("class", "") + " " + found.get("id", "")).split()]
    if tag in ("article", "main") or found.get("role", "").lower() in ("main", "article"):
        # names of an article often are its subjects, such as category-cookies: only whole names tell
        return "chrome" if (tag == "article" or found.get("role", "").lower() == "article") and tag != "main" and _CHROME.intersection(names) else "main"
    if tag not in ("body", "html") and any(_named_chrome(_PART.findall(w)) for w in names):
        return "chrome"
    if tag == "header":
        return "header"
    return "content" if tag in ("div", "section") and any(set(_PART.findall(w)) & _MAIN and not set(_PART.findall(w)) - _MAIN - {"body", "text", "page", "area", "wrap", "inner"} for w in names) else ""


_short_role = lru_cache(maxsize=10_000)(_role)


def pieces(page: str) -> Iterator[tuple[str | None, str, bool]]:
    """The page in order: (None, text, False), or (tag, attributes, whether it closes). Comments, scripts and the like are left out.

    Time grows with the length, whatever is broken: every character is passed once, and what turns out to have no end is not looked for again. A quote
    without its partner counts as a letter; a tag without its end as text.
    """
    at, size = 0, len(page)
    quotes = {'"': True, "'": True}
    closes = head = True
    ends = dict.fromkeys(_HIDDEN, True)
    while at < size:
        lt = page.find("<", at)
        if lt < 0 or not closes:
            yield None, page[at:], False
            return
        if lt > at:
            yield None, page[at:lt], False
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", lt) and (end := page.find("]]>", lt)) >= 0:
            yield None, entities.escape(page[lt + 9 : end]), False
            at = end + 3
            continue
        slash = page.startswith("/", lt + 1)
        name = _NAME.match(page, lt + 1 + slash)
        if name is None:
            if page.startswith(("<!", "<?", "</"), lt):
                end = page.find(">", lt)
                if end < 0:
                    closes = False
                    at = lt
                    continue
                at = end + 1
            else:
                yield None, "<", False
                at = lt + 1
            continue
        end, here = -1, name.end()
        while m := _STOP.search(page, here):
            q = m.group()
            if q == ">":
                end = m.start()
                break
            here = m.end()
            if quotes[q]:
                other = page.find(q, here)
                if other < 0:
                    quotes[q] = False
                else:
                    here = other + 1
        if end < 0:  # no end outside of quotes: from here on quotes don't count
            quotes = dict.fromkeys(quotes, False)
            end = page.find(">", name.end())
            if end < 0:
                closes = False
                at = lt
                continue
        tag, attributes, at = name.group().lower(), page[name.end() : end].strip(), end + 1
        if tag == "head" and not slash and head:
            m = _HEAD_END.search(page, at)
            head = m is not None
            at = m.end() if m else at
            continue
        if tag in _HIDDEN:
            if not slash and not attributes.endswith("/"):
                m = _ENDS[tag].search(page, at) if ends[tag] else None
                ends[tag] = m is not None
                at = m.end() if m else size
            continue
        yield tag, attributes, slash


def blocks(page: str, unclosed: bool = False) -> list[tuple[str, str, float]]:
    """The visible blocks of a page in order: kind (main, content, other, chrome), text, and share of it in links.

    With ``unclosed`` an article ends menus and notices that were left open before it.

    White space in a block becomes one space; a block ends at any tag that isn't inline. Elements left open end with the element around them.
    """
    out: list[tuple[str, str, float]] = []
    text: list[str] = []
    linked = 0
    stack: list[str] = []
    kinds = ["other"]
    opened: Counter[str] = Counter()
    link = False

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            if words:
                out.append((kinds[-1], words, min(1.0, linked / len(words))))
            text.clear()
        linked = 0

    for tag, attributes, closing in pieces(page):
        if tag is None:
            text.append(attributes)
            if link:
                linked += len(attributes)
            continue
        if tag in _INLINE:
            if tag == "a":
                link = not closing
            elif tag in _SPACED:
                text.append(" ")
            continue
        flush()
        link = False
        if tag not in _OPEN or tag in _VOID:
            continue
        if not closing:
            if attributes.endswith("/") and tag not in ("div", "section"):
                continue
            here, now = kinds[-1], role(tag, attributes)
            if unclosed and tag in ("article", "main") and now == "main":
                kind = "main"
            elif here == "chrome" or now == "chrome" or (now == "header" and here not in ("main", "content")):
                kind = "chrome"
            elif "main" in (here, now):
                kind = "main"
            else:
                kind = "content" if "content" in (here, now) else "other"
            stack.append(tag)
            opened[tag] += 1
            kinds.append(kind)
        elif opened[tag]:
            while True:
                last = stack.pop()
                opened[last] -= 1
                kinds.pop()
                if last == tag:
                    break
    flush()
    return out


def marked(found: list[tuple[str, str, float]]) -> list[str] | None:
    """The blocks in the article, or in what is named as content; None if the page marks neither."""
    for kind in ("main", "content"):
        own = [t for k, t, _ in found if k == kind]
        if own:
            return own
    return None


def hashes(text: str) -> list[int]:
    """A number for the block's begin and for each of its words; never negative."""
    return [1, *(xxhash.xxh3_64_intdigest(w.lower()) >> 1 for w in text.split())]


def suffix_array(tokens: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``long`` tokens or more, by doubling; and each suffix's rank (equal prefixes, equal ranks)."""
    _, rank = np.unique(tokens, return_inverse=True)
    n, k = len(tokens), 1
    order = np.argsort(rank, kind="stable")
    while k < long:
        step = min(k, long - k)
        second = np.full(n, -1, dtype=np.int64)
        second[: n - step] = rank[step:]
        key = rank.astype(np.int64) * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, dtype=np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank, k = new, k + step
    return order, rank


def shared_grams(streams: list[np.ndarray], long: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every distinct run of ``long`` tokens and how many of the pages have it: runs of equal suffixes in the array.

    times: how many pages each stream stands for, one by default.

    A substring of at least ``long`` tokens is shared by pages if, and only if, all its runs of that length are.
    """
    at = starts(np.array([len(s) + long for s in streams]))
    tokens = np.empty(at[-1], dtype=np.uint64)
    page = np.repeat(np.arange(len(streams)), np.diff(at))
    for i, s in enumerate(streams):
        tokens[at[i] : at[i] + len(s)] = s
        tokens[at[i] + len(s) : at[i + 1]] = np.uint64(1 << 63) + np.uint64(i)  # ends no other page's suffix equals
    order, rank = suffix_array(tokens, long)
    inside = (np.arange(len(tokens)) + long <= at[1:][page] - long)[order]
    order = order[inside]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    r, p = rank[order], page[order]
    by = np.lexsort((p, r))
    r, p, order = r[by], p[by], order[by]
    first = np.concatenate([[True], r[1:] != r[:-1]])
    other = first | np.concatenate([[True], p[1:] != p[:-1]])
    heads = np.flatnonzero(first)
    weight = np.ones(len(streams), dtype=np.int64) if times is None else times.astype(np.int64)
    counts = np.add.reduceat(other * weight[p], heads)
    return gram_hashes(tokens, order[heads], long), counts


def gram_hashes(tokens: np.ndarray, at: np.ndarray, long: int) -> np.ndarray:
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(long):
        out = mix(out ^ tokens[at + k])
    return out.view(np.int64)


def _of_host(seed, grams: np.ndarray) -> np.ndarray:
    """A number for each run of a host."""
    return mix(grams ^ seed).view(np.int64)


def parse_pages(df: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Every row's key and url; host; id, a hash of host and page; the proposed blocks; sign, a hash of the tokens of
    what else it has, if anything; and stream, those tokens, once for each host and sign of a batch."""
    source = narrow(df, key=key, url=url, html=html)
    fields = (("host", T.StringType(), pa.string()), ("id", T.BinaryType(), pa.binary()), ("blocks", T.ArrayType(T.StringType()), pa.list_(pa.string())), ("stream", T.BinaryType(), pa.binary()), ("sign", T.LongType(), pa.int64()), ("marked", T.BooleanType(), pa.bool_()))
    schema = T.StructType([T.StructField("key", source.schema["key"].dataType), T.StructField("url", source.schema["url"].dataType), *[T.StructField(n, t) for n, t, _ in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, sent = [], set()
            for u, page in zip(array(batch.column(1)).to_pylist(), array(batch.column(2)).to_pylist()):
                page = page or ""
                found = blocks(page)
                own = marked(found)
                if own is None and _ARTICLE.search(page):
                    found = blocks(page, unclosed=True)
                    own = marked(found)
                kept = own if own is not None else [t for k, t, links in found if k == "other" and links < 0.5]
                stream = np.array([h for k, t, links in found if links < 0.5 and (k == "chrome" or own is None or k == "other") for h in hashes(t)], dtype=np.uint64).tobytes()
                host = re.sub(r"^[a-z]+://(?:[^/@]*@)?([^/:?#]*).*", r"\1", (u or "").lower(), flags=re.S)
                sign = xxhash.xxh3_64_intdigest(stream) - (1 << 63)
                rows.append((host, xxhash.xxh3_128_digest(f"{host}\0{page}".encode("utf-8", "surrogatepass")), kept, None if not stream or (host, sign) in sent else stream, sign if stream else None, own is not None))
                sent.add((host, sign))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, (_, _, t) in zip(zip(*rows), fields)]], names=schema.names)

    return source.mapInArrow(run, schema)


def boilerplate(parsed: DataFrame, long: int, pages: int) -> DataFrame:
    """(host, gram): runs of ``long`` tokens, outside of marked articles and of lists of links (which may name articles), that at least ``pages`` pages of a host share; pages with one and the same
    stream count as one page each.

    A host's streams are spread over groups of about GROUP, each with a suffix array of its own; the groups' counts of each
    run are then added up, so that a large host is no single task and gives the same runs as one array would.
    """
    own = parsed.filter("sign is not null").groupBy("host", "sign", "id").agg(F.max("stream").alias("stream"))
    streams = own.groupBy("host", "sign").agg(F.max("stream").alias("stream"), F.count("*").alias("times"))
    sizes = streams.groupBy("host").agg(F.count("*").alias("n"), F.sum("times").alias("pages")).filter(F.col("pages") >= pages)
    group = F.pmod(F.xxhash64("sign"), F.ceil(F.col("n") / GROUP)).alias("salt")
    salted = streams.join(sizes, "host").select("host", group, "stream", "times")

    def run(table: pa.Table) -> pa.Table:
        streams = [np.frombuffer(s, dtype=np.uint64) for s in table.column("stream").to_pylist()]
        grams, counts = shared_grams(streams, long, table.column("times").to_numpy())
        hosts = pa.array([table.column("host")[0].as_py()] * len(grams), pa.string())
        return pa.table({"host": hosts, "gram": pa.array(grams), "pages": pa.array(counts)})

    counted = salted.groupBy("host", "salt").applyInArrow(run, "host string, gram long, pages long")
    return counted.groupBy("host", "gram").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= pages).select("host", "gram")


def without(found: list[str], covered: np.ndarray) -> str:
    """The blocks without the covered words; covered has a place for each block's begin and each word."""
    out, at = [], 0
    for t in found:
        # words as hashes() cuts them, of the block itself
        words = t.split()
        own = covered[at + 1 : at + 1 + len(words)]
        at += 1 + len(words)
        if not own.any():
            out.append(t)
        elif not own.all():
            out.append(" ".join(w for w, gone in zip(words, own) if not gone))
    return "\n".join(out)


def main_text(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", long: int = LONG, pages: int = PAGES) -> DataFrame:
    """A row for each row of ``df``: key, url, text and n_chars.

    Null or empty html gives an empty text. Pages with a null url, or one without a host, count as one host. Keys may repeat or be null, and equal rows
    get equal texts. Pages are parsed once. Proposed blocks whose runs a Bloom filter of the hosts' boilerplate, of bounded size, doesn't know are
    ready; those of the others are joined with it, and only those pages are shuffled.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    parsed = materialize(parse_pages(df, key, url, html), f"{folder}/parsed")
    known = materialize(boilerplate(parsed, long, pages), f"{folder}/grams")
    seed = F.xxhash64("host").alias("seed")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_of_host(*[c.to_numpy(zero_copy_only=False) for c in batch.columns]))], names=["id"])

    seeds = known.select(seed).distinct()
    hosts, maybe = Filter(seeds, seeds.count(), each=36), Filter(known.select(seed, "gram").mapInArrow(number, "id long"), known.count(), each=36)
    keyed = parsed.select("key", "url", "host", "id", "blocks", seed, "marked")
    names = ["key", "url", "host", "id", "blocks", "text", "at", "gram"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.list_(pa.string()), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        for batch in slices(batches):
            rows, own = [], batch.column(5).to_numpy(zero_copy_only=False)
            for found, go, host, whole in zip(batch.column(4).to_pylist(), hosts.has(own).tolist(), own, batch.column(6).to_pylist()):
                tokens = np.array([h for t in found for h in hashes(t)] if go and not whole else [], dtype=np.uint64)
                at = np.arange(max(0, len(tokens) - long + 1))
                grams = gram_hashes(tokens, at, long)
                at = np.flatnonzero(maybe.has(_of_host(host, grams))) if len(at) else at
                rows.append((found, None, at.tolist(), grams[at].tolist()) if len(at) else (None, "\n".join(found), [], []))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=names)

    plain = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema.fields[:5])
    sifted = keyed.mapInArrow(look, f"{plain}, text string, at array<long>, gram array<long>")
    open_ = materialize(sifted.filter("text is null"), f"{folder}/open")
    hits = open_.select("host", "id", F.explode(F.arrays_zip("at", "gram")).alias("x")).select("host", "id", "x.at", "x.gram").distinct()
    hits = hits.join(known, ["host", "gram"], "left_semi").groupBy("id").agg(F.collect_list("at").alias("hits"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for found, at in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                covered = np.zeros(sum(1 + len(t.split()) for t in found), dtype=bool)
                for i in at or []:
                    covered[i : i + long] = True
                texts.append(without(found, covered))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["key", "url", "text"])

    short = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema.fields[:2])
    judged = open_.join(hits, "id", "left").select("key", "url", "blocks", "hits").mapInArrow(decide, f"{short}, text string")
    judged = materialize(judged, f"{folder}/judged")
    for done in ("grams", "open"):
        drop_dir(f"{folder}/{done}")
    text = sifted.filter("text is not null").select("key", "url", "text").unionByName(judged)
    return text.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))


def query(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
