"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .rules import FIT_CHARS, fitted, labelled, platt

#: The field is fitted on at most so many labelled rows, those of the smallest hashes of doc_id.
FIT_ROWS = 4000
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(97, 123)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[32, 9, 11, 12, 13]] = 4
_CLASS[[ord(c) for c in "#*$%&|<>{}[]\\^~`@=+_/"]] = 5
_CLASS[[ord(c) for c in "!?"]] = 6
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 7
_CLASS[128:] = 8
_OWN = 14


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines that hold more than white space, their lengths in bytes, and each text's first line."""
    lines: list[bytes] = []
    first = [0]
    for t in texts:
        lines.extend(x for x in t.encode().split(b"\n") if x.strip())
        first.append(len(lines))
    n = len(lines)
    if not n:
        return np.zeros((0, 3 * _OWN + 3)), np.zeros(0), np.asarray(first)
    size = np.asarray([len(x) for x in lines], float)
    at = np.concatenate([[0], np.cumsum(size[:-1])]).astype(np.int64)
    kind = _CLASS[np.frombuffer(b"".join(lines), np.uint8)]
    x = np.zeros((n, _OWN))
    for c in range(1, 9):
        x[:, c - 1] = np.add.reduceat((kind == c).view(np.uint8), at, dtype=np.int64) / size
    for i, line in enumerate(lines):
        words = line.split()
        k = len(words)
        x[i, 8] = len(set(words)) / k
        x[i, 9] = sum(map(bytes.__eq__, words, words[1:])) / k
        x[i, 10] = min(size[i] / k, 30) / 10
        x[i, 11] = min(k, 200) / 100
    x[:, 12] = np.sqrt(x[:, 4])
    x[:, 13] = np.sqrt(x[:, 0])
    full = np.zeros((n, 3 * _OWN + 3))
    full[:, :_OWN] = x
    starts = np.zeros(n, bool)
    starts[[a for a, b in zip(first, first[1:]) if b > a]] = True
    ends = np.append(starts[1:], True)
    full[1:, _OWN : 2 * _OWN] = np.where(starts[1:, None], 0, x[:-1])
    full[:-1, 2 * _OWN : 3 * _OWN] = np.where(ends[:-1, None], 0, x[1:])
    full[:, -3] = starts
    full[:, -2] = ends
    full[:, -1] = 1
    return full, size, np.asarray(first)


def marginals(u: np.ndarray, trans: np.ndarray, first: np.ndarray, want_pairs: bool = False):
    """Forward-backward over all chains side by side: P(good) of each line, and expected transitions.

    u holds the score of good over bad per line; chains step together, longest first.
    """
    n, length = len(u), np.diff(first)
    p = np.zeros(n)
    pairs = np.zeros((2, 2))
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    if not len(order):
        return (p, pairs) if want_pairs else p
    begin, size = first[order], length[order]
    alive = [int(np.searchsorted(-size, -k, side="right")) for k in range(1, int(size[0]) + 1)]  # chains with at least k lines
    unary = np.stack([np.zeros(n), u], 1)
    fwd = np.zeros((n, 2))
    fwd[begin] = unary[begin]
    for k in range(1, len(alive)):
        i = begin[: alive[k]] + k
        s = fwd[i - 1][:, :, None] + trans[None]
        m = s.max(1)
        f = m + np.log(np.exp(s - m[:, None]).sum(1)) + unary[i]
        fwd[i] = f - f.max(1, keepdims=True)
    bwd = np.zeros((n, 2))
    for k in range(len(alive) - 1, 0, -1):
        i = begin[: alive[k]] + k
        s = trans[None] + (unary[i] + bwd[i])[:, None, :]
        m = s.max(2)
        b = m + np.log(np.exp(s - m[:, :, None]).sum(2))
        bwd[i - 1] = b - b.max(1, keepdims=True)
        if want_pairs:
            q = fwd[i - 1][:, :, None] + s
            q = np.exp(q - q.max((1, 2), keepdims=True))
            pairs += (q / q.sum((1, 2), keepdims=True)).sum(0)
    z = fwd + bwd
    p = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -50, 50)))
    return (p, pairs) if want_pairs else p


def _share(p: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The mean marginal of each text, weighted by line length; 0 without lines."""
    total = np.concatenate([[0], np.cumsum(size)])
    good = np.concatenate([[0], np.cumsum(p * size)])
    return (good[first[1:]] - good[first[:-1]]) / np.maximum(total[first[1:]] - total[first[:-1]], 1e-9)


def _logit(q: np.ndarray) -> np.ndarray:
    return np.log((q + 1e-3) / (1 - q + 1e-3))


def fit(rows: list[tuple[int, str, int]], steps: int = 150) -> dict:
    """Gradient ascent on the chain's likelihood; lines begin with their document's label.

    After each of two fits, lines of bad documents that look good beyond doubt are marked good, all but the
    worst line. The document score is calibrated on the same rows. Without both labels, only the share counts.
    """
    rows = sorted(rows, key=lambda r: zlib.crc32(str(r[0]).encode()))
    y = np.asarray([r[2] for r in rows], float)
    x, size, first = line_features([r[1] for r in rows])
    share = (y.sum() + 1) / (len(y) + 2)
    if not 0 < y.sum() < len(y) or not len(x):
        return {"w": np.zeros(x.shape[1]), "mean": np.zeros(x.shape[1]), "sd": np.ones(x.shape[1]), "trans": np.zeros((2, 2)), "a": 0.0, "b": float(np.log(share / (1 - share)))}
    mean, sd = x.mean(0), x.std(0) + 1e-3
    mean[-1], sd[-1] = 0, 1
    x = (x - mean) / sd
    doc = np.repeat(np.arange(len(y)), np.diff(first))
    line = y[doc].copy()
    inner = np.append(doc[1:] == doc[:-1], False)
    balance = np.where(y[doc] == 1, 0.5 / max(1, (y[doc] == 1).sum()), 0.5 / max(1, (y[doc] == 0).sum()))
    for turn in range(3):
        w, trans, mw, vw, mt, vt = np.zeros(x.shape[1]), np.zeros((2, 2)), 0, 0, 0, 0
        a, b = line[:-1][inner[:-1]].astype(int), line[1:][inner[:-1]].astype(int)
        seen = np.zeros((2, 2))
        np.add.at(seen, (a, b), 1)
        for k in range(1, steps + 1):
            p, pairs = marginals(x @ w, trans, first, True)
            g = x.T @ ((line - p) * balance) - 1e-4 * w
            t = (seen - pairs) / max(1, seen.sum()) - 1e-3 * trans
            mw, vw, mt, vt = 0.9 * mw + 0.1 * g, 0.99 * vw + 0.01 * g * g, 0.9 * mt + 0.1 * t, 0.99 * vt + 0.01 * t * t
            c, d = 1 - 0.9**k, 1 - 0.99**k
            w = w + 0.1 * (mw / c) / (np.sqrt(vw / d) + 1e-8)
            trans = trans + 0.05 * (mt / c) / (np.sqrt(vt / d) + 1e-8)
        p = marginals(x @ w, trans, first)
        if turn < 2:
            line = y[doc].copy()
            line[(y[doc] == 0) & (p > 0.8)] = 1
            for i, j in zip(first[:-1][y == 0], first[1:][y == 0]):
                if j > i:
                    line[i + int(p[i:j].argmin())] = 0
    alpha, beta = platt(_logit(_share(p, size, first)), y)
    return {"w": w, "mean": mean, "sd": sd, "trans": trans, "a": alpha, "b": beta}


def score(model: dict, texts: list[str]) -> np.ndarray:
    x, size, first = line_features(texts)
    p = marginals(((x - model["mean"]) / model["sd"]) @ model["w"], model["trans"], first)
    return 1 / (1 + np.exp(-np.clip(model["a"] * _logit(_share(p, size, first)) + model["b"], -30, 30)))


def line_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> DataFrame:
    """Score of every whole text; rows with crc32(doc_id) mod 3 = 1 are held out of the fit.

    A null or empty text has no lines and the score of a text whose lines are all bad. Repeated rows score alike.
    """
    sc = docs.sparkSession.sparkContext
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    model = sc.broadcast(fitted(labelled(docs, labels.where(~held), fit_rows, fit_chars), fit))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = [t or "" for t in b.column(1).to_pylist()], b.column(0).to_pylist()
            s = np.concatenate([score(model.value, texts[i:j]) for i, j in chunks(texts, 8_000_000)] or [np.zeros(0)])
            yield pa.record_batch([b.column(0), pa.array([zlib.crc32(str(i).encode()) % 3 == 1 if i is not None else False for i in ids], pa.bool_()), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(judge, SCHEMA)
