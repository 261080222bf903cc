"""A quality score from document statistics: random Fourier features, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, array, bound_batches, flat, materialize, narrow, shared_dir, slices, sums

STATISTICS = (
    "log_words", "word_length", "symbols", "capitals", "digits", "marks", "separators", "shouts", "distinct", "repeats",
    "line_words", "stub_lines", "log_chars", "stops", "long_words", "copied_lines",
)

#: Sums of a batch of partitions that one task, or the driver, adds up.
FAN_IN = 16


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; a null or empty text has zeros."""
    texts = array(texts).fill_null("")
    words = Words(texts)
    n = words.counts.astype(np.float64)
    per = np.maximum(1, n)
    vocab = words.vocab
    number = lambda a: a.to_numpy(zero_copy_only=False).astype(np.int64)
    total = lambda values: sums(values[words.codes], words.at).astype(np.float64)
    length = number(pc.utf8_length(vocab))
    upper = number(pc.count_substring_regex(vocab, r"\p{Lu}"))
    chars = np.maximum(1, total(length))
    doc = words.docs()
    order = np.argsort(doc * max(1, len(vocab)) + words.codes, kind="stable")
    d, c = doc[order], words.codes[order]
    new = np.ones(len(c), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (c[1:] != c[:-1])
    twice = np.zeros(len(words.codes), dtype=bool)
    twice[1:] = (words.codes[1:] == words.codes[:-1]) & (doc[1:] == doc[:-1])
    lines, at = flat(pc.split_pattern(texts, "\n"))
    blank = number(pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]"))
    n_lines = np.maximum(1, sums(blank, at))
    ends = number(pc.match_substring_regex(lines, r"[.!?…。”\")][\x20\x09-\x0D]*$")) * blank
    coded = lines.dictionary_encode() if len(lines) else None
    copied = np.zeros(len(n))
    if coded is not None:
        line_doc = np.repeat(np.arange(len(n)), np.diff(at))
        key = line_doc * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        o = np.argsort(key, kind="stable")
        again = np.zeros(len(key), dtype=np.int64)
        again[o[1:]] = key[o[1:]] == key[o[:-1]]
        copied = sums(again * blank, at)
    out = np.column_stack(
        [
            np.log1p(n),
            total(length) / per,
            total(number(pc.count_substring_regex(vocab, r"[#*$%&|<>~^=_{}\[\]\\]"))) / chars,
            total(upper) / chars,
            total(number(pc.count_substring_regex(vocab, r"\p{Nd}"))) / chars,
            total(number(pc.match_substring_regex(vocab, r"[.!?…。]$"))) / per,
            total(number(pc.match_substring_regex(vocab, r"^[|>»•·/]+$"))) / per,
            total((upper * 10 > length * 6) & (length > 2)) / per,
            sums(new.astype(np.int64), np.searchsorted(d, np.arange(len(n) + 1))) / per,
            sums(twice.astype(np.int64), words.at) / per,
            np.log1p(n / n_lines),
            (n_lines - np.minimum(n_lines, sums(ends, at))) / n_lines,
            np.log1p(total(length)),
            total(length <= 3) / per,
            total(length >= 16) / per,
            copied / n_lines,
        ]
    )
    out[n == 0] = 0
    return out


@dataclass(frozen=True)
class Model:
    """Standardisation, the random projection, ridge weights, and the knots of the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        return _lift((x - self.mean) / self.scale, self.directions, self.phases)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1: calibrated, and still rising a little with the raw score where the calibration is flat."""
        raw = self.raw(x)
        return np.clip(0.998 * np.interp(raw, self.knots, self.values) + 0.002 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def _lift(z: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    f = np.sqrt(2 / len(phases)) * np.cos(np.clip(z, -8, 8) @ directions + phases)
    return np.column_stack([np.ones(len(z)), f])


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the knots and values of the closest non-decreasing function; x ascending."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x.tolist(), y.tolist(), w.tolist()):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _partials(df: DataFrame, make, columns: str) -> np.ndarray:
    """The sum over all rows of what ``make`` gives for a batch: first by partition, then by tasks that each add up FAN_IN of those sums, as often
    as it takes, then here."""

    def by_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                part = np.frombuffer(raw, dtype="<f8")
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    left, sums = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.selectExpr(*columns.split(",")).mapInArrow(by_partition, "part binary")
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        sums = sums.repartition(left).mapInArrow(merge, "part binary")
    parts = sums.collect()
    return np.sum([np.frombuffer(r[0], dtype="<f8") for r in parts], axis=0) if parts else np.zeros(0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def fit(rows: DataFrame, features: int = 256, gamma: float = 0.08, ridge: float = 1e-3, seed: int = 7) -> Model:
    """From rows (x array<double>, y 0/1, calibrate boolean). Each step sums fixed-size matrices over partitions.

    Rows without a label or statistics are left out. Without any row the model gives 0.5 to everything; with one class its share.
    """
    width = len(STATISTICS)
    rows = rows.filter("x is not null and y is not null")
    moments = _partials(rows, lambda b: np.concatenate([[b.num_rows, pc.sum(b.column(1)).as_py()], _matrix(b.column(0), width).sum(0), (_matrix(b.column(0), width) ** 2).sum(0)]), "x,y")
    rng = np.random.default_rng(seed)
    directions, phases = rng.normal(0, np.sqrt(2 * gamma), (width, features)), rng.uniform(0, 2 * np.pi, features)
    if not len(moments):
        return Model(np.zeros(width), np.ones(width), directions, phases, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    n = moments[0]
    mean = moments[2 : 2 + width] / n
    scale = np.sqrt(np.maximum(moments[2 + width :] / n - mean**2, 1e-9))

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        fitted = ~batch.column(2).to_numpy(zero_copy_only=False)
        z = _lift((_matrix(batch.column(0), width)[fitted] - mean) / scale, directions, phases)
        y = batch.column(1).to_numpy(zero_copy_only=False)[fitted]
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    total, size = _partials(rows, normal, "x,y,calibrate"), features + 1
    gram, right = total[: size * size].reshape(size, size), total[size * size :]
    weights = np.linalg.solve(gram + ridge * max(1.0, gram[0, 0]) * np.diag([1e-9] + [1.0] * features), right)
    model = Model(mean, scale, directions, phases, weights, np.array([0.0]), np.array([moments[1] / n]))
    bins = 2048

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        held = batch.column(2).to_numpy(zero_copy_only=False)
        raw = np.clip((model.raw(_matrix(batch.column(0), width)[held]) + 1) / 3 * bins, 0, bins - 1).astype(np.int64)
        y = batch.column(1).to_numpy(zero_copy_only=False)[held]
        return np.concatenate([np.bincount(raw, minlength=bins), np.bincount(raw, weights=y, minlength=bins)])

    counts = _partials(rows, histogram, "x,y,calibrate")
    seen = np.flatnonzero(counts[:bins])
    if not len(seen):
        return model
    centres = (seen + 0.5) * 3 / bins - 1
    knots, values = isotonic(centres, counts[bins:][seen] / counts[seen], counts[seen])
    return Model(mean, scale, directions, phases, weights, knots, values)


def document_statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, x): the statistics of every row's whole text. No shuffle."""
    source = narrow(df, key=key, text=text)
    schema = T.StructType([T.StructField("key", source.schema["key"].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = statistics(batch.column(1))
            at = np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel()))], names=["key", "x"])

    return source.mapInArrow(run, schema)


def labelled(x: DataFrame, labels: DataFrame, key: str, label: str, held: int | None) -> DataFrame:
    """The statistics of labelled rows, without those whose crc32(key as text) mod 3 is ``held``; a tenth or so calibrates."""
    crc = F.crc32(F.col("key").cast("string").cast("binary"))
    y = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("y")).filter("key is not null and y is not null").groupBy("key").agg(F.max("y").alias("y"))
    rows = x.join(y, "key")
    if held is not None:
        rows = rows.filter(crc % 3 != held)
    return rows.select("x", "y", (F.pmod(F.floor(crc / 3), F.lit(8)) == 0).alias("calibrate"))


def score_documents(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", held: int | None = None) -> DataFrame:
    """A row for each row of ``df``: key, score, predicted (1 from 0.5 on).

    Texts are read once, for sixteen numbers each, which are written; the labels are joined with those. Null and empty texts are scored
    like any other, from zeros. Repeated rows get equal scores. Labels of unknown keys and null labels are ignored; of
    several labels for a key the largest counts.
    """
    x = materialize(document_statistics(df, key, text), shared_dir(df.sparkSession))
    model = fit(labelled(x, labels, key, label, held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch.column(1), len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    schema = T.StructType([T.StructField(key, x.schema["key"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return x.mapInArrow(run, schema)


def keep_documents(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df``, all columns unchanged, that score at least ``threshold`` in a model of all labels.

    The texts are read twice, for the model and for the filter, and never shuffled.
    """
    x = materialize(document_statistics(df, key, text), shared_dir(df.sparkSession))
    model = fit(labelled(x, labels, key, label, None))
    at = df.columns.index(text)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(model.score(statistics(batch.column(at))) >= threshold))

    return df.mapInArrow(run, df.schema)


def query(spark, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out")
    return score_documents(documents, labels, held=1).select("doc_id", held, "score", "predicted")
