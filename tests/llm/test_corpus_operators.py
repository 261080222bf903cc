"""Operators that look at all texts: against brute force on small tables, with nulls, ties, repeated rows and clashing columns."""

import math
import random
import time
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from foliospark.llm import common
from foliospark.llm import components as graph
from foliospark.llm import html_text, jaccard, language_model, packing, quality_model, tokenfile
from tests.llm.test_row_operators import ROWS, table, words

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def near_copies(seed=2):
    random.seed(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = [random.choice(vocab) for _ in range(60)]
    rows, k = [], 100
    for _ in range(12):
        source = [random.choice(vocab) for _ in range(random.randrange(20, 150))]
        for _ in range(random.randrange(1, 9)):
            copy = list(source)
            for _ in range(random.randrange(0, 5)):
                copy[random.randrange(len(copy))] = random.choice(vocab)
            text = " ".join(copy)
            rows.append((k, random.choice([text, text.upper(), text.replace(" ", "\n "), text])))
            k += 1
    for _ in range(10):
        own = [random.choice(vocab) for _ in range(80)]
        rows.append((k, " ".join(own[:40] + passage + own[40:])))
        k += 1
    rows += [(k, "a b c"), (k + 1, "A B  c"), (k + 2, "a b"), (k + 3, "x"), (50, rows[0][1]), (rows[3][0], rows[3][1]), (None, rows[0][1])]
    random.shuffle(rows)
    return rows


def similar(rows, size=5, percent=80):
    sets = []
    for _, t in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    low = {r: min((k for k in ks if k is not None), default=None) for r, ks in least.items()}
    return sorted(((k, len(sets[i]), n[i], low[find(i)]) for i, (k, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("rows", "block"), [(ROWS, 768), (near_copies(), 768), (near_copies(), 4), (near_copies(9), 2)])
def test_similar_documents_are_those_of_all_pairs(spark, monkeypatch, rows, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    got = jaccard.similar_documents(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in got), key=repr) == similar(rows)


def test_similar_documents_with_other_threshold_and_size(spark):
    rows = near_copies(4)
    got = jaccard.similar_documents(table(spark, rows), size=3, percent=60).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in got), key=repr) == similar(rows, 3, 60)
    assert jaccard.similar_documents(table(spark, [])).count() == 0


def test_first_pass_keeps_every_linked_pair():
    """Two sets that reach the threshold share enough of their sampled tokens, whatever their sizes."""
    t = jaccard.Threshold(80)
    rng = np.random.default_rng(1)
    for _ in range(400):
        both = int(rng.integers(1, 80))
        extra = int(rng.integers(0, both // 4 + 1))
        a_only = int(rng.integers(0, extra + 1))
        tokens = rng.permutation(1000)[: both + extra]
        a, b = set(tokens[: both + a_only].tolist()), set(tokens[:both].tolist()) | set(tokens[both + a_only :].tolist())
        if not t.links(np.int64(len(a & b)), np.int64(len(a)), np.int64(len(b))):
            continue
        first = lambda s: set(sorted(s)[: int(t.sample(np.int64(len(s))))])
        shared = len(first(a) & first(b))
        assert shared >= int(t.least(np.int64(len(a)))) and shared >= int(t.least(np.int64(len(b))))


def test_filter_has_no_false_negatives(spark):
    ids = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 500)
    f = common.Filter(spark.createDataFrame([(int(i),) for i in ids], "i long"), 500)
    assert f.has(ids).all() and f.has(ids + 1).mean() < 0.1
    assert common.Filter(spark.createDataFrame([(int(i),) for i in ids], "i long"), 500, most=64).has(ids).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(200, 220)] + [(9, 9)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([100, *range(200, 220)], 100)}


@lru_cache
def library():
    tok = Tokenizer.from_file(VOCAB)
    tok.encode_special_tokens = True
    return tok


@lru_cache
def ids_of(t):
    return [*library().encode(t or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_files(spark, tmp_path):
    manifest = tokenfile.write(table(spark), VOCAB, f"file://{tmp_path}", shards=3)
    got = tokenfile.read(manifest).orderBy("start").collect()
    want, at = [], 0
    order = sorted(((k, ids_of(t)) for k, t in ROWS), key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32(np.array(x[1], dtype="<u2").tobytes())))
    for k, ids in order:
        want.append((k, at, len(ids), crc(ids)))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    found = tokenfile.lookup(manifest, spark.createDataFrame([(1,), (5,), (77,), (None,), (5,)], "doc_id long")).collect()
    texts = dict(ROWS)
    assert sorted((r.key, tuple(r.ids)) for r in found) == sorted([(1, tuple(ids_of(texts[1])))] * 2 + [(5, tuple(ids_of(texts[5])))])
    assert tokenfile.read(tokenfile.write(table(spark, []), VOCAB, f"file://{tmp_path}/none")).count() == 0


def test_shard_is_read_in_small_parts(tmp_path):
    """A key costs a few reads of a few bytes where the file can't be mapped; unknown keys give nothing, even with a known one's fingerprint."""
    keys = np.unique(np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 20_000))
    w = tokenfile.ShardWriter(f"{tmp_path}/x.tok", 4)
    w.append(pa.array(keys), pa.array([np.full(i % 5, i, dtype="<u4").tobytes() for i in range(len(keys))], pa.binary()))
    w.close()
    mapped, read = tokenfile.Shard(f"{tmp_path}/x.tok"), []

    class Remote:
        def __init__(self, path):
            self.f = open(path, "rb")

        def size(self):
            return self.f.seek(0, 2)

        def read_at(self, n, at):
            read.append(n)
            self.f.seek(at)
            return self.f.read(n)

    class System:
        type_name = "s3"
        open_input_file = staticmethod(Remote)

    before, tokenfile.file_system = tokenfile.file_system, lambda uri: (System, uri)
    try:
        shard = tokenfile.Shard(f"{tmp_path}/x.tok")
    finally:
        tokenfile.file_system = before
    for i in (0, 7, 19_998):
        read.clear()
        assert [x.tolist() for x in shard[int(keys[i])]] == [[i] * (i % 5)] == [x.tolist() for x in mapped[int(keys[i])]]
        assert sum(read) < 2000
    assert shard[int(keys[0]) + 1] == [] == mapped[int(keys[0]) + 1]
    mapped.prints = np.broadcast_to(tokenfile.fingerprints(np.array([5])), (len(keys),))
    assert mapped[5] == []


def test_hot_key_is_spread_over_shards(spark, tmp_path):
    rows = [(7, f"text {i}") for i in range(300)] + [(i, "x") for i in range(20)]
    manifest = tokenfile.write(table(spark, rows), VOCAB, f"file://{tmp_path}", shards=4)
    assert sum(r.min_key <= 7 <= r.max_key for r in manifest.collect()) > 1
    assert tokenfile.read(manifest).count() == 320
    assert tokenfile.lookup(manifest, spark.createDataFrame([(7,)], "doc_id long")).count() == 301


@pytest.mark.parametrize("n", [0, 1, 2, 17, 5000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.uint64)
    h = tokenfile.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(n))
    few = tokenfile.PerfectHash.build(keys, levels=1)
    assert sorted(few.slots(keys).tolist()) == list(range(n))
    unknown = h.slots(keys + np.uint64(1 << 41))
    assert ((unknown >= -1) & (unknown < max(1, n))).all()


def slow_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        open_ = [i for i, room in enumerate(bins) if room >= s]
        if open_:
            bins[min(open_, key=lambda i: bins[i])] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_is_the_plain_one(seed):
    random.seed(seed)
    capacity = random.choice([10, 37, 100])
    sizes = [random.randrange(1, capacity + 1) for _ in range(random.randrange(0, 200))]
    plan, used = packing.best_fit(Counter(sizes), capacity)
    rooms = [capacity] * used
    placed = Counter()
    for size, first, each, n, bin_, offset in plan:
        for k in range(n):
            assert rooms[bin_ + k] == capacity - offset
            rooms[bin_ + k] -= each * size
        placed.update({(size, r): 1 for r in range(first, first + each * n)})
    assert sorted(rooms) == slow_best_fit(sizes, capacity)
    assert placed == Counter({(s, r): 1 for s, c in Counter(sizes).items() for r in range(c)})


@pytest.mark.parametrize("steps", [packing.BROADCAST_STEPS, 0])
def test_packing(spark, monkeypatch, steps):
    monkeypatch.setattr(packing, "BROADCAST_STEPS", steps)
    packed = packing.pack(table(spark), VOCAB, capacity=64, with_ids=True)
    got = packed.collect()
    want = [(k, i // 64, i, len(ids_of(t)[i : i + 64]), crc(ids_of(t)[i : i + 64])) for k, t in ROWS for i in range(0, len(ids_of(t)), 64)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [p[0] for p in parts] == np.concatenate([[0], np.cumsum([p[1] for p in parts])[:-1]]).tolist() and sum(p[1] for p in parts) <= 64
    assert len(by) == len(slow_best_fit([w[3] for w in want], 64))
    assert sum(len(r.ids) for r in packing.sequences(packed).collect()) == 4 * sum(w[3] for w in want)
    assert packing.pack(table(spark, []), VOCAB).count() == 0


def lm_tokens(t):
    return ["<s>", *words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]


def plain_model(rows, order):
    """The score of a text in an unquantised model of the rows, counted token by token."""
    counts, after = Counter(), {}
    for _, t in rows:
        ts = lm_tokens(t)
        for n in range(2, order + 1):
            for i in range(n - 1, len(ts)):
                counts[tuple(ts[i - n + 1 : i + 1])] += 1
    for gram, n in counts.items():
        after.setdefault(gram[:-1], []).append(n)
    off = {k: language_model.discounts(*(sum(len(g) == k and n == i for g, n in counts.items()) for i in (1, 2, 3, 4))) for k in range(2, order + 1)}
    c = Counter(w for _, t in rows for w in lm_tokens(t)[1:])
    total, kinds = sum(c.values()), len(c)

    def p(context, w):
        out = (c[w] + 1) / (total + kinds + 1)
        for n in range(1, min(len(context), order - 1) + 1):
            if ns := after.get(h := tuple(context[-n:])):
                d = [off[n + 1][min(x, 3) - 1] for x in ns]
                x = counts[(*h, w)]
                out = (x - off[n + 1][min(x, 3) - 1] if x else 0) / sum(ns) + sum(d) / sum(ns) * out
        return math.log10(out)

    def score(t):
        ts = lm_tokens(t)
        base = sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in ts[1:])
        return len(ts) - 1, sum(c[w] > 0 for w in ts[1:]), base, sum(p(ts[:i], ts[i]) for i in range(1, len(ts)))

    return total, kinds, score


def lm_rows(seed=8):
    random.seed(seed)
    vocab = [f"v{i}" for i in range(60)]
    return [(i, " ".join(random.choice(vocab[: 5 + i]) for _ in range(random.randrange(0, 80)))) for i in range(40)] + ROWS


@pytest.mark.parametrize(("order", "file_tokens"), [(2, 6_000_000), (3, 6_000_000), (3, 40), (4, 300)])
def test_language_model_is_the_plain_one(spark, order, file_tokens):
    rows = lm_rows()
    model = language_model.train(table(spark, rows), order=order, file_tokens=file_tokens)
    tests = [*rows, (900, "v1 v2 unknown v3 unknown v1 v2"), (901, "never seen Words"), (902, None)]
    got = sorted(language_model.score(table(spark, tests), model).collect(), key=repr)
    total, kinds, score = plain_model(rows, order)
    assert (model.total, model.distinct) == (total, kinds) and (len(model.layout.hot) > 0) == (file_tokens < 1000)
    want = sorted(((k, *score(t)) for k, t in tests), key=lambda w: repr((w[0], w[1])))
    got = sorted(got, key=lambda r: repr((r.doc_id, r.n_tokens)))
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known) for r in got) == sorted((repr(w[0]), *w[1:3]) for w in want)
    for column, at, slack in (("base_score", 3, 1e-9), ("score", 4, 2 * order * language_model.STEP)):
        for r, w in zip(sorted(got, key=lambda r: (repr(r.doc_id), r.n_tokens, r.base_score)), sorted(want, key=lambda w: (repr(w[0]), w[1], w[3]))):
            assert w[at] - slack * w[1] - 1e-9 <= r[column] <= w[at] + 1e-7, (column, w[0])


def test_language_model_is_the_same_however_it_is_cut(spark):
    rows, before, found = lm_rows(3), spark.conf.get("spark.sql.shuffle.partitions"), []
    for partitions, file_tokens in (("8", 6_000_000), ("64", 6_000_000), ("8", 100), ("3", 30)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        model = language_model.train(table(spark, rows), file_tokens=file_tokens)
        found.append(sorted((repr(r.doc_id), r.n_tokens, r.score) for r in language_model.score(table(spark, rows), model).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(f == found[0] for f in found)


def test_probabilities_sum_to_one_at_most():
    rng = np.random.default_rng(3)
    key = np.unique(rng.integers(0, 20, 300) * 50 + rng.integers(0, 50, 300))
    contexts, words_, counts, unigram = key // 50, key % 50, rng.integers(1, 9, len(key)), rng.dirichlet(np.ones(51))
    total, n = np.bincount(contexts, counts, 21), np.bincount(contexts, minlength=21)
    rest = np.where(total > 0, 0.6 * n / np.maximum(total, 1), 1)
    level = language_model.Level(language_model.Level.build(contexts, words_, 21, 6, (counts - 0.6) / total[contexts] + rest[contexts] * unigram[words_], rest))
    for c in range(21):
        found = level.find(np.full(51, c), np.append(np.arange(50), -1))
        assert np.flatnonzero(found >= 0).tolist() == words_[contexts == c].tolist()
        assert 0.995 < (10 ** level.scores(found, np.full(51, c), np.log10(unigram), False)).sum() <= 1 + 1e-9


@pytest.mark.parametrize(("n", "limit"), [(0, 1), (1, 1), (5, 100), (3000, 1 << 40), (2000, 2001)])
def test_elias_fano(n, limit):
    values = np.sort(np.random.default_rng(n).integers(0, limit, n))
    e = language_model.EliasFano.build(values, limit)
    assert e.get(np.arange(n)).tolist() == values.tolist()
    for width in (0, 1, 13, 41, 63):
        low = values & ((1 << width) - 1)
        assert language_model.bits_at(language_model.bits_of(low, width), width, np.arange(n)).tolist() == low.tolist()


def test_elias_fano_of_several_files():
    rng, limit = np.random.default_rng(4), 1 << 18
    near = [np.sort(rng.integers(0, 4000, n)) for n in (3000, 2, 700)]
    values = [np.concatenate([v, v + 200_000]) for v in near]  # the gap is wider than what is looked at word by word
    e = language_model.EliasFano(*[language_model.EliasFano.build(v, limit).parts() for v in values])
    part = rng.integers(0, 3, 5000)
    i = np.concatenate([rng.integers(0, 1 << 30, 4000) % np.array([len(values[p]) - 1 for p in part[:4000]]), [len(near[p]) - 1 for p in part[4000:]]])
    one, next_ = e.between(i, part)
    assert one.tolist() == e.get(i, part).tolist() == [values[p][x] for p, x in zip(part, i)] and next_.tolist() == [values[p][x + 1] for p, x in zip(part, i)]


def test_lookups_of_a_batch_do_not_follow_the_number_of_files(spark, monkeypatch):
    rows, calls, found, find = lm_rows(5), [], [], language_model.Level.find
    monkeypatch.setattr(language_model.Level, "find", lambda *a: calls.append(1) or find(*a))
    texts = pa.array([*(t for _, t in rows), "v1 v2 unknown v3 unknown v1 v2"])
    for file_tokens in (6_000_000, 30):
        model = language_model.train(table(spark, rows), file_tokens=file_tokens)
        calls.clear()
        got = model.measure(texts)
        found.append((model.layout.files, len(calls), got))
    assert found[0][0] < 3 and found[1][0] > 20 and found[0][1] == found[1][1] == language_model.ORDER - 1
    # files one by one, as where they can't be mapped, and few places at once
    monkeypatch.setattr(language_model, "JOINED", 1)
    monkeypatch.setattr(language_model, "AT_ONCE", 7)
    found.append((0, 0, model.measure(texts)))
    assert all((f[name] == found[0][2][name]).all() for _, _, f in found for name in f)


def test_language_model_of_nothing(spark):
    model = language_model.train(table(spark, []))
    row = language_model.score(table(spark, [(1, "a b")]), model).first()
    assert (row.n_tokens, row.n_known, row.base_score) == (3, 0, 0.0) and row.score == pytest.approx(0, abs=0.01)


def test_longer_contexts_tell_more(spark):
    # a word that only the two before it tell: a bigram model can't
    texts = [(i, "a x b" if i % 2 else "c x d") for i in range(200)]
    two, three = ({r.doc_id: r.score for r in language_model.score(table(spark, texts), language_model.train(table(spark, texts), order=o)).collect()} for o in (2, 3))
    assert three[1] > two[1] + 0.2 and language_model.ORDER >= 3


def test_tries_that_cannot_be_mapped_are_bounded(monkeypatch, tmp_path):
    monkeypatch.setattr(language_model, "mapped", lambda path: ([np.zeros(1)], 100))
    monkeypatch.setattr(language_model, "KEPT_BYTES", 250)
    language_model._OPENED.clear()
    for i in range(10):
        language_model.opened(f"x{i}")
    assert list(language_model._OPENED) == ["x8", "x9"]
    language_model._OPENED.clear()


PAGE = """<!doctype html><html><head><title>T &amp; t</title><style>p{}</style><script>x="</p><p>no"</script></head><body><header>Site</header>
<nav><ul><li><a href=x>Home</a></li></ul></nav><!-- hidden --><div class="cookie-notice">We use cookies</div><main><div class="post"><header><h1>Head
line</h1></header><p>One &lt;b&gt; <b>two</b>&nbsp;three<p>four<br>five</p><ul><li>six<li>seven</ul><table><tr><td>a</td><td>b</td></tr></table>
<aside>side</aside><form>send <input></form><div id="comments"><p>first!</p></div></div></main><div class="sidebar">links</div><footer>&copy; me</footer></body>"""


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, url string, html string, text string, host string, n_chars int")


def test_main_text(spark):
    long = "<article><p>" + "word " * 30000 + "</p></article>"
    rows = [(1, "http://a/1", PAGE), (2, None, None), (3, "http://a/3", ""), (4, "http://a/4", long), (1, "http://a/1", PAGE), (None, "http://a/5", "<p>plain &#65;&eacute;</p>tail")]
    got = {r.page_id: r for r in html_text.main_text(pages(spark, rows)).collect()}
    assert got[1].text == "Head line\nOne <b> two three\nfour\nfive\nsix\nseven\na b"
    assert got[2].text == got[3].text == "" and got[4].n_chars == 30000 * 5 - 1
    assert got[None].text == "plain Aé\ntail"
    assert html_text.main_text(pages(spark, rows)).count() == len(rows) and html_text.main_text(pages(spark, [])).count() == 0


def test_article_after_a_menu_that_is_left_open():
    page = "<nav><ul><li>Home</li></ul><div class=ad>Buy<article><p>The text.</p><aside>no</aside></article><footer>f</footer>"
    assert html_text.marked(html_text.blocks(page)) is None
    assert html_text.marked(html_text.blocks(page, unclosed=True)) == ["The text."]


@pytest.mark.parametrize("names", ["post category-related", "post tag-cookies", "hentry category-advertising", "post-7 tag-sidebar has-banner"])
def test_article_whose_names_tell_its_subject(names):
    page = f"<nav>Home</nav><article class='{names}'><p>The text.</p><div class='site-footer'>f</div><div class=cookie-notice>c</div></article><div>out</div>"
    assert html_text.marked(html_text.blocks(page)) == ["The text."]


def test_whole_and_leading_names_are_chrome():
    assert html_text.marked(html_text.blocks("<div class='content has-sidebar'><p>The text.</p></div><div class='sidebar-left'>no</div>")) == ["The text."]
    page = "<article><p>The text.</p></article><article class='comment'>no</article><article class=ad>no</article><div class='comments-area'>no</div>"
    assert html_text.marked(html_text.blocks(page)) == ["The text."]


def unmarked(n, seed=1):
    random.seed(seed)
    own = lambda: " ".join(f"u{random.randrange(10**6)}" for _ in range(40))
    foot = "This footer is on every page of the site and says the same thing again"
    rows, want = [], {}
    for i in range(n):
        body = [own(), own()]
        rows.append((i, f"https://host.example/{i}", f"<div><p>Home of all things we do</p><p>{body[0]}</p><p>{body[1]}</p></div><div>{foot}</div>"))
        want[i] = "\n".join(body)
    return rows, want


def plain_main_text(rows, long=8, pages=3):
    """Every host's runs counted page by page, and covered words of proposed blocks removed."""
    seen, places = {}, []
    for k, u, h in rows:
        found = html_text.blocks(h or "")
        own = html_text.marked(found)
        proposed = own if own is not None else [t for kind, t, links in found if kind == "other" and links < 0.5]
        host = (u or "").split("/")[2] if "//" in (u or "") else (u or "")
        rest = [w for kind, t, links in found if links < 0.5 and (kind == "chrome" or own is None or kind == "other") for w in ["", *t.lower().split()]]
        for i in range(len(rest) - long + 1):
            seen.setdefault((host, tuple(rest[i : i + long])), set()).add(h)
        places.append((k, host if own is None else None, proposed))  # a marked article is whole
    out = []
    for k, host, proposed in places:
        words_ = [(b, w) for b, t in enumerate(proposed) for w in ["", *t.split()]]
        gone = set()
        for i in range(len(words_) - long + 1):
            if len(seen.get((host, tuple(w.lower() for _, w in words_[i : i + long])), ())) >= pages:
                gone.update(range(i, i + long))
        kept = {}
        for i, (b, w) in enumerate(words_):
            if w and i not in gone:
                kept.setdefault(b, []).append(w)
        out.append((k, "\n".join(" ".join(x) for _, x in sorted(kept.items()))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group", [2000, 3])
def test_boilerplate_of_a_host(spark, monkeypatch, group):
    monkeypatch.setattr(html_text, "GROUP", group)
    rows, want = unmarked(9)
    alone = (50, "https://other.example/x", rows[0][2])
    notice = "Please support our work with a small gift of any size today"
    marked = [(60 + i, f"https://host.example/m{i}", f"<nav>{notice}</nav><article><p>own{i} words {'and ' * i}</p><p>Before {notice} after {i}</p><p>{notice}</p></article>") for i in range(4)]
    # a passage that only articles share stays, and so does a title that other pages link to
    title = "A title of eight words that others link"
    shared = [(70 + i, f"https://host.example/s{i}", f"<aside><a href=x>{title}</a></aside><article><h1>{title}</h1><p>{'the same passage in every article of the host ' * 2}</p>{i}</article>") for i in range(5)]
    all_rows = [*rows, alone, *marked, *shared, rows[0], (None, None, rows[1][2])]
    got = html_text.main_text(pages(spark, all_rows)).collect()
    assert sorted(((r.page_id, r.text) for r in got), key=repr) == plain_main_text(all_rows)
    texts = {r.page_id: r.text for r in got}
    assert {i: texts[i].split("\n")[-2:] for i in want} == {i: w.split("\n") for i, w in want.items()}
    assert "footer" in texts[50] and not any("footer" in texts[i] for i in want)
    assert texts[61] == f"own1 words and\nBefore {notice} after 1\n{notice}" and texts[71].startswith(title + "\nthe same passage")


@pytest.mark.parametrize("broken", ["<a", "<div ", "<a \">", "<a '\">\"", "<div>", "</section>", "<!--", "<![CDATA[", "<head>", "<script", "<script>", "<p class=\"", "&am", "<a href='x' b=\"y", "<main-", "< ", "<!"])
def test_broken_pages_take_time_in_proportion(broken):
    page = "<article>begin " + broken * (1_000_000 // len(broken)) + " end"
    began = time.time()
    html_text.blocks(page)
    html_text.blocks("<div>" * 50_000 + "</section>" * 50_000 + f"<div class='{'main-' * 100_000}'><p {'a' * 500_000}>")
    assert time.time() - began < 20


def test_pieces_of_odd_tags():
    text = lambda page: [b[1] for b in html_text.blocks(page)]
    assert text("<p title='a > b'>x</p>1 < 2 <3 <p>y<br/>z</p><p a='>open") == ["x", "1 < 2 <3", "y", "z", "open"]
    assert text("a<![CDATA[1 < 2 &amp;]]>b<!-- c --><?php d ?>e<script>var f='</p>'</script>g<textarea>h") == ["a1 < 2 &amp;bed ?>eg".replace("ed ?>e", "e")]


def test_suffix_array_counts_pages():
    rng = np.random.default_rng(2)
    streams = [rng.integers(2, 5, rng.integers(0, 30)).astype(np.uint64) for _ in range(8)]
    grams, counts = html_text.shared_grams(streams, 4)
    want = Counter()
    for s in streams:
        want.update({tuple(s[i : i + 4].tolist()) for i in range(len(s) - 3)})
    name = {g: int(html_text.gram_hashes(np.array(g, dtype=np.uint64), np.array([0]), 4)[0]) for g in want}
    assert dict(zip(grams.tolist(), counts.tolist())) == {name[g]: n for g, n in want.items()}


def junk(n=240):
    random.seed(4)
    rows, labels = [], []
    for i in range(n):
        w = ["".join(random.choice("abcdeiou") for _ in range(random.randrange(2, 9))) for _ in range(random.randrange(30, 120))]
        good = i % 3 > 0
        text = ". ".join(" ".join(w[k : k + 9]).capitalize() for k in range(0, len(w), 9)) + "." if good else random.choice([" | ".join(w), " ".join(x.upper() + "!!" for x in w), " ".join(x + "###" for x in w)])
        rows.append((i, text))
        if i % 5:
            labels.append((i, int(good)))
    return rows, labels


def test_quality_model(spark):
    rows, labels = junk()
    lab = spark.createDataFrame([*labels, (10**6, 1), (None, 1), (3, None)], "doc_id long, quality int")
    all_rows = [*rows, (1000, None), (1001, ""), rows[0]]
    got = quality_model.score_documents(table(spark, all_rows), lab, held=1).collect()
    assert len(got) == len(all_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 30 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    kept = quality_model.keep_documents(table(spark, all_rows), lab)
    assert kept.columns[:2] == ["doc_id", "text"] and sum(truth.get(r.doc_id, 1) for r in kept.collect()) > 0.95 * sum(truth.values())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r.score, 2) for r in quality_model.score_documents(table(spark, rows[:5]), none).collect()} == {0.5}
    assert quality_model.score_documents(table(spark, []), lab).count() == 0


def test_quality_model_is_the_plain_solution(spark):
    """The summed normal equations against one solve over all rows, and the calibration against isotonic regression over them."""
    rng = np.random.default_rng(5)
    width, n = len(quality_model.STATISTICS), 600
    x = rng.normal(2, 3, (n, width))
    y, calibrate = (x[:, 0] + rng.normal(0, 1, n) > 2).astype(float), rng.random(n) < 0.2
    rows = [(a.tolist(), float(b), bool(c)) for a, b, c in zip(x, y, calibrate)] + [(None, 1.0, False), (x[0].tolist(), None, True)]
    model = quality_model.fit(spark.createDataFrame(rows, "x array<double>, y double, calibrate boolean").repartition(7), features=40)
    z = (x - x.mean(0)) / x.std(0)
    draw = np.random.default_rng(7)
    directions, phases = draw.normal(0, np.sqrt(2 * 0.08), (width, 40)), draw.uniform(0, 2 * np.pi, 40)
    lifted = np.column_stack([np.ones(n), np.sqrt(2 / 40) * np.cos(z @ directions + phases)])
    f, t = lifted[~calibrate], y[~calibrate]
    plain = np.linalg.solve(f.T @ f + 1e-3 * len(f) * np.diag([1e-9] + [1.0] * 40), f.T @ t)
    assert np.allclose(lifted @ plain, model.raw(x), atol=1e-6)
    score = model.score(x)
    assert (np.diff(score[np.argsort(lifted @ plain, kind="stable")]) >= -1e-9).all() and ((score >= 0.5) == (y == 1)).mean() > 0.65


def test_held_out_labels_are_never_read(spark):
    rows, labels = junk(90)
    flipped = [(k, 1 - q if zlib.crc32(str(k).encode()) % 3 == 1 else q) for k, q in labels]
    score = lambda lab: sorted((r.doc_id, r.score) for r in quality_model.score_documents(table(spark, rows), spark.createDataFrame(lab, "doc_id long, quality int"), held=1).collect())
    assert score(labels) == score(flipped)


def test_isotonic():
    x, y, w = np.arange(6.0), np.array([0, 0.5, 0.25, 0.25, 1, 0.9]), np.ones(6)
    knots, values = quality_model.isotonic(x, y, w)
    assert values.tolist() == pytest.approx([0, 1 / 3, 0.95]) and (np.diff(knots) > 0).all()
