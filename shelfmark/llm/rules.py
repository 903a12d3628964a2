"""Quality rules: word rules with a hashed n-gram logistic regression beside them."""

from __future__ import annotations

import pickle
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64

#: The regression is fitted on at most so many labelled rows, those of the smallest hashes of doc_id.
FIT_ROWS = 4000
#: Longer texts are scored, but not learned from.
FIT_CHARS = 50_000
#: Rows below this calibrated probability are rejected.
KEEP_AT = 0.5
BITS = 17
SIZE = 1 << BITS
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"

_SPACES = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"


def _packed(ids: np.ndarray) -> np.ndarray:
    return (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    if ids.max() >= 1 << 21:  # pairs of words first, numbered anew, so that three fit in 64 bits
        two = np.unique((ids[:-1] << 32) | ids[1:], return_inverse=True)[1].astype(np.int64)
        key = (two[:-1] << 32) | ids[2:]
    else:
        key = _packed(ids)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def base_counts(text: str, raw_words: list[bytes], ids: np.ndarray) -> tuple[int, int, int, int, int]:
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return (len(raw_words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids))


def _grams(values: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Buckets of the n-grams of an array, hashed."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    h = np.full(m, seed, dtype=U64)
    for k in range(n):
        h = (h ^ values[k : k + m]) * U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(29)
    return (h >> U64(64 - BITS)).astype(np.int64)


class Hasher:
    """Word ids and hashes of a worker; emptied when large."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = defaultdict(count().__next__)
        self.hashes: dict[bytes, int] = {}

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ids) > 200_000:  # also keeps ids within 21 bits
            self.__init__()
        if len(words) > 1_500_000:
            order = {w: i for i, w in enumerate(dict.fromkeys(words))}
            ids = np.asarray([order[w] for w in words], np.int64)
        else:
            ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        h = self.hashes
        if len(h) > 200_000:
            h.clear()
        for w in set(words).difference(h):
            h[w] = zlib.crc32(w)
        return ids, np.fromiter(map(h.__getitem__, words), U64, len(words))


def features(text: str, hashes: np.ndarray) -> list[np.ndarray]:
    """Buckets of one- and two-word grams and of three- and four-character grams, each kind in a range of its own."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(U64)
    return [_grams(hashes, 1, 1), _grams(hashes, 2, 2) + SIZE, _grams(chars, 3, 3) + 2 * SIZE, _grams(chars, 4, 4) + 3 * SIZE]


def fitted(sample: DataFrame, fit: Callable[[list[tuple[int, str, int]]], dict]) -> dict:
    """The model that fit makes of a bounded sample (doc_id, text, quality), in one task: the driver gets the model alone."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        yield pa.record_batch([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    model = sample.select("doc_id", "text", "quality").repartition(1).mapInArrow(train, "model binary").first()
    return pickle.loads(model[0]) if model else fit([])


def fit(rows: list[tuple[int, str, int]], rounds: int = 12, rate: float = 4.0) -> dict:
    """Logistic regression on mean n-gram weights, then a Platt calibration on the fifth of rows held back.

    A sample without rows of both labels gives a model that scores every text by the share of label 1.
    """
    rows = sorted(rows, key=lambda r: zlib.crc32(str(r[0]).encode()))
    hasher, xs, ys = Hasher(), [], []
    for _, text, y in rows:
        _, h = hasher.words(text.encode().split())
        xs.append([(u.astype(np.int32), (c / c.sum()).astype(np.float32)) for u, c in (np.unique(f, return_counts=True) for f in features(text, h)) if len(u)])
        ys.append(y)
    w, y = np.zeros(4 * SIZE, np.float32), np.asarray(ys, float)
    share = (y.sum() + 1) / (len(y) + 2)
    if not 0 < y.sum() < len(y):
        return {"w": w, "a": 0.0, "b": float(np.log(share / (1 - share)))}
    held = np.arange(len(y)) % 5 == 0
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    b = 0.0
    squares = np.full(4 * SIZE, 1e-6, np.float32)
    for r in range(rounds):
        for i in np.flatnonzero(~held):
            z = b + sum(float(w[u] @ c) for u, c in xs[i])
            g = weight[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i])
            for u, c in xs[i]:
                d = g * c + 1e-6 * w[u]
                squares[u] += d * d
                w[u] -= rate * 0.05 * d / np.sqrt(squares[u])
            b -= 0.02 * g / (r + 1)
    z = np.asarray([b + sum(float(w[u] @ c) for u, c in xs[i]) for i in np.flatnonzero(held)])
    alpha, beta = platt(z, y[held])
    return {"w": w, "a": alpha, "b": alpha * b + beta}


def platt(z: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """The line over scores whose logistic fits the labels, with smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.asarray([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.asarray([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
        da, db = np.linalg.solve(h, g)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def probability(model: dict, text: str, hashes: np.ndarray) -> float:
    z = sum(float(model["w"][f].mean()) for f in features(text, hashes) if len(f))
    return float(1 / (1 + np.exp(-np.clip(model["a"] * z + model["b"], -30, 30))))


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int, fit_chars: int) -> DataFrame:
    """doc_id, text, quality of at most fit_rows rows, half of either label, those of the least hashes of doc_id.

    Texts of over fit_chars characters are not learned from, which bounds the sample in bytes. Of several labels
    of a document the lowest counts, of several texts the first in order.
    """
    ids = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    half = [ids.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows // 2) for y in (0, 1)]
    chosen = half[0].unionByName(half[1])  # few ids: bounded by fit_rows
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= fit_chars)
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


def trained(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> dict:
    """The regression, fitted on the labelled rows of docs."""
    return fitted(labelled(docs, labels, fit_rows, fit_chars), fit)


def judged(texts: list[str | None], hasher: Hasher, model: dict, keep_at: float) -> list[tuple]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality of every text."""
    rows = []
    for t in texts:
        t = t or ""
        raw = t.encode()
        words = raw.split()
        ids, h = hasher.words(words)
        counts = base_counts(t, words, ids)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        p = probability(model, t, h)
        rows.append((*counts, failed, not failed and p >= keep_at, p))
    return rows


def quality_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, keep_at: float = KEEP_AT) -> DataFrame:
    """Counts, the fixed rules and the regression's verdict for every whole text.

    A null or empty text has no words and fails the fixed rule of 50 words. Repeated rows are judged each.
    Words, symbols and lines are counted over the whole text.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, fit_rows))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
        names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
        for b in batches:
            rows = judged(b.column(1).to_pylist(), hasher, model.value, keep_at)
            yield pa.record_batch([b.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 8, kinds))], names=names)

    return docs.mapInArrow(judge, SCHEMA)


def kept_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs, with all columns, that quality_rules keeps; no shuffle of texts."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, fit_rows))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            yield b.filter(pa.array([r[6] for r in judged(b.column(at).to_pylist(), hasher, model.value, keep_at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
