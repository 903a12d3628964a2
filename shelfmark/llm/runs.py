"""Periodic runs of words: block convolution at dyadic scales."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and at least two periods.
SHORTEST = 12
#: A prime of which 2^30 divides one less, and a generator: transforms of up to 2^30 places, products below 2^64.
PRIME = 3 * 2**30 + 1
ROOT = 5
#: Blocks of fewer words are compared with what follows by direct sums: a transform so short costs more.
DIRECT = 8
#: Words of neighbouring documents worked on together, and places of one batch of transforms.
SLICE = 200_000
PLACES = 1 << 20

_P = np.uint64(PRIME)
_twiddles: dict[tuple[int, bool], np.ndarray] = {}


def _powers(size: int, back: bool) -> np.ndarray:
    if (size, back) not in _twiddles:
        w = pow(ROOT, (PRIME - 1) // size, PRIME)
        w = pow(w, PRIME - 2, PRIME) if back else w
        out = np.ones(1, np.uint64)
        while len(out) < size // 2:
            out = np.concatenate([out, out * np.uint64(pow(w, len(out), PRIME)) % _P])
        _twiddles[size, back] = out
    return _twiddles[size, back]


def transform(a: np.ndarray, back: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row, a power of two long (Stockham order, no bit reversal)."""
    rows, size = a.shape
    a, n, stride = a.reshape(rows, size, 1), size, 1
    while n > 1:
        half = n // 2
        u, v = a[:, :half], a[:, half:]
        w = _powers(n, back)[None, :, None]
        out = np.empty((rows, half, 2, stride), np.uint64)
        out[:, :, 0] = (u + v) % _P
        out[:, :, 1] = (u + _P - v) % _P * w % _P
        n, stride = half, stride * 2
        a = out.reshape(rows, half, stride)
    a = a.reshape(rows, size)
    return a * np.uint64(pow(size, PRIME - 2, PRIME)) % _P if back else a


def mismatches(x: np.ndarray, begin: np.ndarray, block: int) -> np.ndarray:
    """Sums of squared differences, modulo PRIME, of each block with what follows it.

    Row k, column t: x[begin[k] : + block] against the words 2 * block - 1 + t further on, for t below 2 * block.
    x must reach 5 * block places behind each begin. The sum is 0 wherever the words are equal.
    """
    size = 4 * block
    own = x[begin[:, None] + np.arange(block)]
    far = x[begin[:, None] + np.arange(2 * block - 1, 5 * block - 2)]
    a, b = np.zeros((len(begin), size), np.uint64), np.zeros((len(begin), size), np.uint64)
    a[:, :block] = own[:, ::-1]
    b[:, : far.shape[1]] = far
    both = transform(transform(a) * transform(b) % _P, True)[:, block - 1 : 3 * block - 1]
    square = np.zeros((len(begin), far.shape[1] + 1), np.uint64)
    np.cumsum(far * far % _P, axis=1, out=square[:, 1:])
    there = square[:, block:] - square[:, : 2 * block]
    return ((own * own % _P).sum(1)[:, None] + there + (_P - both) * np.uint64(2)) % _P


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _reach(x: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from i and j on (step 1) or backwards (step -1) are equal; i < j."""
    most, done, size = (len(x) - j if step > 0 else i + 1), 0, 64
    while done < most:
        n = min(size, most - done)
        if step > 0:
            differ = np.flatnonzero(x[i + done : i + done + n] != x[j + done : j + done + n])
        else:
            differ = np.flatnonzero(x[i - done - n + 1 : i - done + 1][::-1] != x[j - done - n + 1 : j - done + 1][::-1])
        if len(differ):
            return done + int(differ[0])
        done, size = done + n, min(size * 2, 1 << 16)
    return most


def _may_recur(x: np.ndarray, order: np.ndarray, key: np.ndarray, block: int) -> np.ndarray:
    """For each place whether its word occurs 2 * block - 1 to 4 * block - 2 places further on."""
    n = len(x)
    at = np.searchsorted(key, key + (2 * block - 1))
    near = key[np.minimum(at, n - 1)] - key
    out = np.zeros(n, bool)
    # keys of one word differ by the distance of its places, those of two words by more than any distance asked for
    out[order] = (at < n) & (near <= 4 * block - 2)
    return out


def find_runs(x: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, end, period): every maximal run of the sequence, with its smallest period.

    A run of period q holds, in its first half, a whole block of 2^k words, 2^(k+1) - 1 <= q <= 2^(k+2) - 2, that
    occurs again q words later. At each scale the blocks' zero-mismatch occurrences at these distances are
    found by one transform for many blocks; every such distance is a seed, extended both ways word by word, so that
    a sum that is 0 only modulo PRIME ends at once. Blocks with a word that does not occur again there cannot
    match. A stretch inside a run already found, whose period is no longer than a block, gives only multiples
    of that period, and is passed over. longest: no document is longer, so that no period is over half of it.
    """
    n = len(x)
    found: dict[tuple[int, int], int] = {}
    reach, period = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)

    def keep(lo: int, hi: int, q: int) -> None:
        if found.get((lo, hi), q + 1) > q:
            found[lo, hi] = q
            over = reach[lo:hi] < hi
            reach[lo:hi][over] = hi
            period[lo:hi][over] = q

    for q in range(1, min(2 * DIRECT - 2, longest // 2) + 1):
        # the scales below DIRECT: a squared difference is 0 where the words are equal
        lo, hi = _stretches((x[:-q] - x[q:]) ** 2 == 0)
        long = hi - lo + q >= max(SHORTEST, 2 * q)
        for i, j in zip(lo[long].tolist(), hi[long].tolist()):
            keep(i, j + q, q)
    if longest >= 2 * (2 * DIRECT - 1):
        order = np.argsort(x, kind="stable")
        key = x[order] * (8 * n + 64) + order
        padded = np.concatenate([x, np.zeros(2 * longest + 5 * DIRECT, x.dtype)]).astype(np.uint64)
    block = DIRECT
    while 2 * (2 * block - 1) <= longest:
        begin = np.arange(0, n - block + 1, block)
        begin = begin[np.logical_and.reduceat(_may_recur(x, order, key, block), begin)] if len(begin) else begin
        if len(begin):  # the last reduced stretch may be longer than a block, which only asks more of the last block
            inside = (reach[begin] >= begin + 5 * block - 2) & (period[begin] <= block)
            begin = begin[~inside]
        for i in range(0, len(begin), max(1, PLACES // (4 * block))):
            some = begin[i : i + max(1, PLACES // (4 * block))]
            row, t = np.nonzero(mismatches(padded, some, block) == 0)
            seed, d = some[row], 2 * block - 1 + t
            fits = seed + d + block <= n
            seed, d = seed[fits], d[fits]
            for b, q in zip(seed.tolist(), d.tolist()):
                if reach[b] >= b + q + block and q % period[b] == 0 and period[b] <= block:
                    continue
                right = _reach(x, b, b + q, 1)
                if right < block:
                    continue
                lo = b - _reach(x, b - 1, b + q - 1, -1) if b else 0
                if b + right - lo >= max(SHORTEST - q, q):
                    keep(lo, b + right + q, q)
        block *= 2
    return np.asarray(sorted((lo, hi, q) for (lo, hi), q in found.items()), np.int64).reshape(-1, 3)


def _slices(texts: list) -> Iterator[tuple[int, list[list[bytes]]]]:
    first, held, n = 0, [], 0
    for i, t in enumerate(texts):
        words = t.split() if t else []
        if n and n + len(words) > SLICE:
            yield first, held
            first, held, n = i, [], 0
        held.append(words)
        n += len(words)
    if held:
        yield first, held


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each of these word lists. They are worked on as one sequence, with a word of its own between two."""
    names: dict[bytes, int] = {}
    for words in texts:
        names.update(dict.fromkeys(words))
    for k, w in enumerate(names):
        names[w] = k
    size = np.asarray([len(w) + 1 for w in texts], np.int64)
    end = np.cumsum(size)
    x = np.empty(int(end[-1]), np.int64)
    for k, words in enumerate(texts):
        x[end[k] - size[k] : end[k] - 1] = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
        x[end[k] - 1] = len(names) + k
    found = find_runs(x, int(size.max()) - 1)
    which = np.searchsorted(end, found[:, 0], side="right")
    found[:, :2] -= (end - size)[which][:, None]
    cuts = np.searchsorted(which, np.arange(len(texts) + 1))
    return [found[i:j] for i, j in zip(cuts, cuts[1:])]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed): the maximal periodic runs of words of each text, and the text without repeats.

    Words are the stretches between ASCII white space, numbered from 0. A run is (start, length, period): words one
    period apart are equal, the period is the smallest, length is at least SHORTEST and two periods, and
    neither neighbour goes on with it. collapsed holds, joined by one space, the words that no run has after its
    first period. Each row has its result from its own text alone: repeated rows and ids, and rows without id, have one
    each; other columns are not looked at. A null, empty or blank text has no run and an empty text. A very long
    text is worked on alone. Runs are in order of start, then period; each stands once.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            texts = b.column(1).to_pylist()
            for first, held in _slices(texts):
                every, kept = [], []
                for words, found in zip(held, runs_of(held)):
                    found = found[np.lexsort((found[:, 2], found[:, 0]))]
                    every.append([{"start": s, "length": e - s, "period": q} for s, e, q in found.tolist()])
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, found[:, 0] + found[:, 2], 1)
                    np.add.at(gone, found[:, 1], -1)
                    kept.append(b" ".join([w for w, g in zip(words, np.cumsum(gone).tolist()) if not g] if len(found) else words))
                yield pa.record_batch([b.column(0).slice(first, len(held)), pa.array(every, kind), pa.array(kept, pa.binary())], names=["doc_id", "runs", "collapsed"])

    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    out = d.mapInArrow(scan, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))
