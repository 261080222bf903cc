"""Line-first cleaning: rules remove lines, and a document that loses too much text is rejected."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Words, array, bound_batches, flat, narrow, slices, sums

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
SEPARATOR = r"^(\||>|»|•|·|/|::)$"
#: Stock phrases of English, German, French and Spanish pages, and marks of rights.
BOILERPLATE = (
    r"(?i)(lorem ipsum|javascript (is|must|has|ist|muss|est|doit|debe|está)|(enable|aktivier\w*|activez|active) javascript|"
    r"(cookie (policy|notice|settings)|we use cookies|uses cookies)|cookie-?(richtlinie|hinweis|einstellung)|verwende[nt]+ cookies|"
    r"utilis(ons|e|ent) des cookies|(politique|gestion|paramètres) des cookies|(utilizamos|usamos|utiliza|usa) cookies|(política|configuración|aviso) de cookies|"
    r"all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|derechos reservados|(©|\(c\)|copyright) ?[0-9]{4}|"
    r"terms (of use|of service|and conditions)|nutzungsbedingungen|allgemeine geschäftsbedingungen|conditions (générales|d.utilisation)|mentions légales|"
    r"(términos|condiciones) (de uso|del servicio|y condiciones)|aviso legal|privacy policy|datenschutz(erklärung|hinweis|richtlinie)|politique de confidentialité|"
    r"política de privacidad|sign up for|subscribe to our|newsletter abonnieren|abonnieren sie|abonnez-vous|inscrivez-vous|suscríbe(te|ase)|regístre(te|se)|"
    r"click here|hier klicken|klicken sie hier|cliquez ici|haga clic|haz clic|(share|teilen|partager|compartir) (this|on|auf|sur|en|this page on) (facebook|twitter|page|x|linkedin)|"
    r"(share|compartir|partager) (this|esto|cette) page|powered by|bereitgestellt von|propulsé par|desarrollado por|"
    r"skip to (main )?content|zum (haupt)?inhalt springen|aller au contenu|(saltar|ir) al contenido)"
)
UPPER, LOWER, END = r"\p{Lu}", r"\p{Ll}", r"[.!?:;,)\]\"'»”’…。！？]$"


@dataclass(frozen=True)
class Rules:
    """Thresholds; a line fails if any rule does.

    navigation: that share of a line's words, two at least, are menu separators.
    punctuation: symbols are more than a share of its word characters; or it has at least
    ``shout_words`` words, mostly of capitals, that end in an exclamation mark or not at all; or it has under
    ``stub_words`` words and ends without any punctuation mark.
    boilerplate: it holds a stock phrase and is no longer than ``stock_words`` words.
    """

    separators: int = 25
    symbols: int = 10
    shout_words: int = 5
    capitals: int = 70
    stub_words: int = 3
    stock_words: int = 40
    min_words: int = 50
    max_repeated: int = 50
    max_lost: int = 50


OUTPUT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]
    + [T.StructField(n, T.LongType()) for n in ("n_lines", "n_removed_lines", "lost_words")]
)


def failing_lines(lines: pa.Array, rules: Rules = Rules()) -> tuple[np.ndarray, np.ndarray]:
    """Which lines the rules remove, and each line's words."""
    count = lambda pattern: pc.count_substring_regex(lines, pattern).to_numpy(zero_copy_only=False).astype(np.int64)
    words = Words(lines)
    n = words.counts
    chars = sums(pc.utf8_length(words.vocab).to_numpy(zero_copy_only=False).astype(np.int64)[words.codes], words.at)
    is_sep = pc.match_substring_regex(words.vocab, SEPARATOR).to_numpy(zero_copy_only=False)
    separators = sums(is_sep[words.codes].astype(np.int64), words.at)
    symbols, upper, lower = count(SYMBOL), count(UPPER), count(LOWER)
    trimmed = pc.ascii_trim_whitespace(lines)
    ends = pc.match_substring_regex(trimmed, END).to_numpy(zero_copy_only=False)
    stock = pc.match_substring_regex(lines, BOILERPLATE).to_numpy(zero_copy_only=False)
    fails = (
        ((separators >= 2) & (100 * separators >= rules.separators * n))
        | (100 * symbols > rules.symbols * chars)
        | ((n >= rules.shout_words) & (100 * upper > rules.capitals * (upper + lower)))
        | ((n < rules.stub_words) & ~ends)
        | (stock & (n <= rules.stock_words))
    )
    return fails & (n > 0), n


def measure(texts: pa.Array, rules: Rules = Rules(), cleaned: bool = False) -> tuple[dict[str, np.ndarray], list | None]:
    """The columns of OUTPUT for each text; with ``cleaned`` the texts without the removed lines too."""
    texts = array(texts)
    rows = len(texts)
    words = Words(texts)
    n, doc, codes = words.counts, words.docs(), words.codes
    chars = pc.utf8_length(words.vocab).to_numpy(zero_copy_only=False).astype(np.int64)
    marks = pc.count_substring_regex(words.vocab, SYMBOL).to_numpy(zero_copy_only=False).astype(np.int64)
    out = {"n_words": n, "word_chars": sums(chars[codes], words.at), "n_symbols": sums(marks[codes], words.at)}

    values, at = flat(pc.split_pattern(texts, "\n"))
    coded = values.dictionary_encode()
    lines, line = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    fails, line_words = failing_lines(lines, rules)
    line_doc = np.repeat(np.arange(rows), np.diff(at))
    key = line_doc * max(1, len(lines)) + line
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), dtype=bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["n_dup_lines"] = sums((again & (line_words[line] > 0)).astype(np.int64), at)

    covered = np.zeros(len(codes), dtype=bool)
    if len(codes) > 2:
        i = np.flatnonzero(doc[2:] == doc[:-2])
        v = np.uint64(len(words.vocab))
        c = codes.astype(np.uint64)
        key = (c[i] * v + c[i + 1]) * np.uint64(0x9E3779B97F4A7C15) + (c[i + 2] + doc[i].astype(np.uint64) * v) * np.uint64(0xC2B2AE3D27D4EB4F)
        order = np.argsort(key, kind="stable")
        a, b = i[order[:-1]], i[order[1:]]
        same = (key[order[1:]] == key[order[:-1]]) & (doc[a] == doc[b]) & (codes[a] == codes[b]) & (codes[a + 1] == codes[b + 1]) & (codes[a + 2] == codes[b + 2])
        for start in (a[same], b[same]):
            for k in range(3):
                covered[start + k] = True
    out["n_repeat_words"] = sums(covered.astype(np.int64), words.at)
    removed = fails[line]
    out["n_lines"], out["n_removed_lines"] = np.diff(at), sums(removed.astype(np.int64), at)
    out["lost_words"] = sums(np.where(removed, line_words[line], 0), at)
    out["base_failed"] = (n < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeated * n)
    out["kept"] = ~out["base_failed"] & (100 * out["lost_words"] <= rules.max_lost * n)
    if not cleaned:
        return out, None
    text = texts.to_pylist()
    parts = None
    for d in np.flatnonzero(out["n_removed_lines"]):
        parts = text[d].split("\n")
        text[d] = "\n".join(p for p, gone in zip(parts, removed[at[d] : at[d + 1]]) if not gone)
    return out, text


def score_documents(df: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row for each row of ``df``: its key, the measures, ``base_failed``, ``kept`` and ``clean_text``.

    A null text has no words and no lines: it fails the base rule and its clean text is null. An empty
    text fails too. Repeated rows and keys give a row each; a null key stays null; other columns are ignored. No
    shuffle: every text is judged on its own.
    """
    return _apply(df, key, text, rules, True)


def _apply(df: DataFrame, key: str, text: str, rules: Rules, cleaned: bool) -> DataFrame:
    source = narrow(df, key=key, text=text)
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), *OUTPUT.fields, *([T.StructField("clean_text", T.StringType())] * cleaned)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got, clean = measure(batch.column(1), rules, cleaned)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(got[f.name]) for f in OUTPUT.fields], *([pa.array(clean, pa.string())] if cleaned else [])], names=schema.names
            )

    return source.mapInArrow(run, schema)


def measures(df: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """As ``score_documents``, without the cleaned texts."""
    return _apply(df, key, text, rules, False)


def keep_documents(df: DataFrame, text: str = "text", chars: str = "n_chars", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``df`` whose text the rules keep, without the lines that fail; null and empty texts go.

    ``chars``, if there is such a column, is counted again where lines went; all other columns are unchanged.
    """
    bound_batches(df.sparkSession)
    at, names = df.columns.index(text), df.columns
    count = names.index(chars) if chars in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got, clean = measure(batch.column(at), rules, True)
            columns = list(batch.columns)
            columns[at] = pa.array(clean, columns[at].type)
            if count is not None:
                shorter = pa.array(got["n_removed_lines"] > 0)
                columns[count] = pc.if_else(shorter, pc.utf8_length(columns[at]).cast(columns[count].type), columns[count])
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(got["kept"]))

    return df.mapInArrow(run, df.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return measures(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "lost_words"
    )


def keep_sql(source: str, rules: Rules = Rules()) -> str:
    """DuckDB SQL: every measure of the rows (doc_id, text) of ``source``."""
    q = lambda s: s.replace("'", "''")
    return f"""
    WITH src AS (SELECT row_number() OVER () AS rid, doc_id, text FROM {source}),
    toks AS (SELECT rid, doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
                    CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM src),
    wins AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM toks WHERE len(w) >= 3),
    keyed AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM wins),
    covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM keyed WHERE c >= 2) GROUP BY rid),
    ln AS (SELECT rid, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM toks),
    lw AS (SELECT *, regexp_extract_all(line, '{WORD}') AS w FROM ln),
    lm AS (SELECT rid, pos, line, len(w) AS n, len(array_to_string(w, '')) AS chars,
             len(list_filter(w, lambda x: regexp_matches(x, '{SEPARATOR}'))) AS sep,
             len(regexp_extract_all(line, '{SYMBOL}')) AS sym, len(regexp_extract_all(line, '{UPPER}')) AS up,
             len(regexp_extract_all(line, '{LOWER}')) AS lo,
             len(w) > 0 AND regexp_matches(w[-1], '{q(END)}') AS ends,
             regexp_matches(line, '{q(BOILERPLATE)}') AS stock,
             row_number() OVER (PARTITION BY rid, line ORDER BY pos) AS nth FROM lw),
    la AS (SELECT rid, count(*) FILTER (n > 0 AND nth > 1) AS dups, count(*) FILTER (bad) AS removed, coalesce(sum(n) FILTER (bad), 0) AS lost
           FROM (SELECT *, n > 0 AND ((sep >= 2 AND 100 * sep >= {rules.separators} * n) OR 100 * sym > {rules.symbols} * chars
                   OR (n >= {rules.shout_words} AND 100 * up > {rules.capitals} * (up + lo)) OR (n < {rules.stub_words} AND NOT ends)
                   OR (stock AND n <= {rules.stock_words})) AS bad FROM lm) GROUP BY rid)
    SELECT t.doc_id, len(t.w)::BIGINT AS n_words, len(array_to_string(t.w, ''))::BIGINT AS word_chars,
           len(regexp_extract_all(t.body, '{SYMBOL}'))::BIGINT AS n_symbols, coalesce(la.dups, 0)::BIGINT AS n_dup_lines,
           coalesce(c.n, 0)::BIGINT AS n_repeat_words,
           (len(t.w) < {rules.min_words} OR 100 * coalesce(c.n, 0) > {rules.max_repeated} * len(t.w)) AS base_failed,
           (NOT (len(t.w) < {rules.min_words} OR 100 * coalesce(c.n, 0) > {rules.max_repeated} * len(t.w))
             AND 100 * coalesce(la.lost, 0) <= {rules.max_lost} * len(t.w)) AS kept,
           coalesce(la.removed, 0)::BIGINT AS n_removed_lines, coalesce(la.lost, 0)::BIGINT AS lost_words
    FROM toks t LEFT JOIN covered c USING (rid) LEFT JOIN la USING (rid)
    """


ORACLE_SQL = keep_sql("documents")
