"""Repeated 200-byte strings: q-gram buckets refined by the bucket identifiers of later offsets."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, stored

#: Length of a repeated string and of the q-grams that name the first buckets.
LENGTH = 200
Q = 64
_STARTS = LENGTH - Q + 1
#: Length of the first buckets in a task; doubled by each refinement until it is LENGTH.
FIRST = 50
#: A bucket of more different contexts (about 1.3 MB of bytes) is dealt anew by its next refinement.
LARGE = 4_000
#: Bytes of text worked on at once.
PART = 2_000_000
RUNS = "h long, c long, doc_id long, t long, lo int, n int, at int"
CONTEXTS = "h long, size long, doc_id long, t long, lo int, n int, at int, least int, most int, bytes binary"
SPANS = "doc_id long, t long, lo int, hi int"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

_B = 0x9E3779B97F4A7C15
_INVERSE = pow(_B, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        for i, b in enumerate((_B, _INVERSE)):
            p = np.full(n + 1, b, U64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


class Prefix:
    """Hashes of any stretch of a byte array, from its prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _pow(len(data) + 1)
        self.sum = np.concatenate([np.zeros(1, U64), np.cumsum(_BYTE[data] * up[: len(data)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.down[start])


def anchors(h: np.ndarray) -> np.ndarray:
    """For every start of a string the place of the least q-gram hash within it, the leftmost of equal ones.

    It depends on the string alone, so equal strings have it at the same offset.
    """
    m = len(h)
    k = -(-m // _STARTS) * _STARTS
    x = np.full(k, 2**64 - 1, U64)
    x[:m] = h
    x = x.reshape(-1, _STARTS)
    before = np.minimum.accumulate(x, axis=1).ravel()
    after = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    ns = m - _STARTS + 1
    low = np.minimum(after[:ns], before[_STARTS - 1 : _STARTS - 1 + ns])
    left, came = np.zeros(ns, bool), np.zeros(ns, bool)
    left[1:] = h[: ns - 1] == low[:-1]
    left[0] = True
    came[1:] = low[1:] < low[:-1]
    a = np.zeros(ns, np.int64)
    at = np.flatnonzero(came)
    a[at] = at + _STARTS - 1
    at = np.flatnonzero(left & ~came)
    view = np.lib.stride_tricks.sliding_window_view(h, _STARTS)
    for j in range(0, len(at), 10_000):
        some = at[j : j + 10_000]
        a[some] = some + view[some].argmin(1)
    return np.maximum.accumulate(a)


def runs(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring starts with the same anchor, over texts side by side.

    Returns text, bucket (the anchor's q-gram), context (the run's bytes and where the anchor lies in them),
    first start within the text, number of starts, and offset of the anchor from the first start.
    """
    size = np.asarray([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    if len(data) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    p = Prefix(data)
    i = np.arange(len(data) - Q + 1)
    h = p.of(i, i + Q)
    a = anchors(h)
    end = np.cumsum(size)
    s = np.flatnonzero(np.arange(len(a)) + LENGTH <= np.repeat(end, size)[: len(a)])
    if not len(s):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    own = a[s]
    first = np.append(True, (own[1:] != own[:-1]) | (s[1:] != s[:-1] + 1))
    lo = s[first]
    hi = np.append(s[np.flatnonzero(first)[1:] - 1], s[-1])
    at = own[first]
    c = mix(p.of(lo, hi + LENGTH) ^ ((at - lo).astype(U64) << U64(32)) ^ (hi - lo).astype(U64))
    text = np.searchsorted(end, lo, side="right")
    return text, h[at].view(np.int64), c.view(np.int64), lo - (end - size)[text], hi - lo + 1, at - lo


def _parts(raw: list[bytes]) -> Iterator[tuple[int, int]]:
    first, n = 0, 0
    for i, r in enumerate(raw):
        if n and n + len(r) > PART:
            yield first, i
            first, n = i, 0
        n += len(r)
    if first < len(raw):
        yield first, len(raw)


def all_runs(docs: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes, raw = b.column(0).to_numpy(), b.column(1).to_numpy(), [(t or "").encode() for t in b.column(2).to_pylist()]
            for i, j in _parts(raw):
                text, h, c, lo, n, at = runs(raw[i:j])
                yield pa.record_batch([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(ids[i:j][text], pa.int64()), pa.array(hashes[i:j][text], pa.int64()), *(pa.array(x.astype(np.int32)) for x in (lo, n, at))], names=["h", "c", "doc_id", "t", "lo", "n", "at"])

    return docs.mapInArrow(scan, RUNS)


def repeated_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of these starts have a string of LENGTH bytes that another of them has too.

    Bucket-pointer refinement: the bucket of each place, first a q-gram's, is refined by the bucket of the place as
    many bytes further on; the buckets so made are refined in the same way, until they tell LENGTH bytes apart.
    Starts alone in a bucket leave on the way. What is left in one bucket is compared byte by byte.
    """
    again = np.zeros(len(starts), bool)
    left = np.arange(len(starts))
    p = Prefix(data)
    place = np.unique(np.concatenate([starts + k for k in range(0, LENGTH, FIRST)]))
    bucket = p.of(place, place + FIRST)
    length = FIRST
    while True:
        number = np.unique(bucket, return_inverse=True)[1].astype(np.int64)
        own = number[np.searchsorted(place, starts[left])]
        many = np.bincount(own)[own] > 1
        left, own = left[many], own[many]
        if length == LENGTH or not len(left):
            break
        further = np.unique(np.concatenate([starts[left] + k for k in range(0, LENGTH, 2 * length)]))
        bucket = (number[np.searchsorted(place, further)] << 32) | number[np.searchsorted(place, further + length)]
        place, length = further, 2 * length
    order = np.argsort(own, kind="stable")
    left, own = left[order], own[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    leader = np.repeat(starts[left[first]], np.diff(np.append(first, len(own))))
    view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    same = np.zeros(len(left), bool)
    for i in range(0, len(left), 50_000):
        same[i : i + 50_000] = (view[starts[left[i : i + 50_000]]] == view[leader[i : i + 50_000]]).all(1)
    if same.all():
        again[left] = True
    else:  # different strings of one hash
        text = [data[x : x + LENGTH].tobytes() for x in starts[left]]
        n = Counter(text)
        again[left] = [n[t] > 1 for t in text]
    return again


def _refined(contexts: DataFrame) -> DataFrame:
    """Contexts dealt anew by their bucket's next refinement.

    The anchor of a start lies least to most bytes behind it, so that all its bucket's strings share the bytes from
    least before the anchor to LENGTH - most behind it. The starts with the anchor in the nearer half of that
    range are told apart by the next bytes behind those, the others by the bytes before them. At last a bucket
    has strings of one place of the anchor alone, which share all LENGTH bytes.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for h, _, doc, t, lo, n, at, least, most, raw in zip(*(c.to_pylist() for c in b.columns)):
                middle = (least + most) // 2
                seed = h.to_bytes(8, "little", signed=True)
                for near in (True, False):
                    # start i has its anchor at - i bytes behind it
                    i, j = (max(0, at - middle), n) if near else (0, min(n, at - middle))
                    if i < j:
                        part = raw[at + LENGTH - most : at + LENGTH - middle] if near else raw[at - middle - 1 : at - least]
                        key = xxhash.xxh64_intdigest(seed + (b"r" if near else b"l") + part)
                        ends = (least, middle) if near else (middle + 1, most)
                        rows.append((key - (key >> 63 << 64), 0, doc, t, lo + i, j - i, at - i, *ends, raw[i : j - 1 + LENGTH]))
                if len(rows) > 10_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return contexts.mapInArrow(split, CONTEXTS)


_CONTEXT = pa.schema([(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]]) for x in CONTEXTS.split(", ")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_CONTEXT), _CONTEXT)], schema=_CONTEXT)


def _bucket_spans(contexts: DataFrame) -> DataFrame:
    """Spans of starts that repeat, for contexts dealt by bucket; buckets are worked on side by side."""

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            # equal strings have one anchor and so one bucket: several buckets can be refined together
            data = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
            begin = np.concatenate([[0], np.cumsum([len(r[6]) for r in rows])])[:-1]
            n = np.asarray([r[4] for r in rows])
            starts = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            again = repeated_starts(data, starts)
            which = np.repeat(np.arange(len(rows)), n)
            place = starts - begin[which] + np.asarray([r[3] for r in rows])[which]
            which, place = which[again], place[again]
            first = np.append(True, (which[1:] != which[:-1]) | (place[1:] != place[:-1] + 1))[: len(which)]
            lo, docs, hashes = place[first], *(np.asarray([r[k] for r in rows], np.int64)[which[first]] for k in (1, 2))
            hi = np.append(place[np.flatnonzero(first)[1:] - 1], place[-1:])
            return pa.record_batch([pa.array(docs, pa.int64()), pa.array(hashes, pa.int64()), pa.array(lo.astype(np.int32)), pa.array((hi + LENGTH).astype(np.int32))], names=["doc_id", "t", "lo", "hi"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size > PART and held[-1][0] != row[0]:  # only between buckets
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield flush(held)

    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(refine, SPANS)


def _context_spans(contexts: DataFrame) -> DataFrame:
    """Spans of starts that repeat in the same bucket; size is the number of contexts in it."""
    out = None
    while True:
        spans = _bucket_spans(contexts.where(F.col("size") <= LARGE).select("h", "doc_id", "t", "lo", "n", "at", "bytes"))
        out = spans if out is None else out.unionByName(spans)
        large = contexts.where(F.col("size") > LARGE)
        if large.isEmpty():
            return out
        out = out.unionByName(large.where("least = most").select("doc_id", "t", "lo", (F.col("lo") + LENGTH).alias("hi")))
        dealt = stored(_refined(large.where("least < most")), "refined").drop("size")
        size = stored(dealt.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
        contexts = stored(dealt.join(size, "h").select(*_CONTEXT.names), "contexts")


def named(docs: DataFrame) -> DataFrame:
    """doc_id, t, text: a row is known by its doc_id and a hash of its text; without doc_id by the hash alone."""
    none = F.col("doc_id").isNull()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.xxhash64(none, "text").alias("t"), "text", none.alias("none"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, t, lo, hi): stretches of bytes covered by strings of LENGTH bytes that start more than once, of rows by named().

    Buckets are the q-grams that the least hash picks from each string. Buckets of one are done. Where whole
    contexts in a bucket are equal, all their strings repeat; one context of each kind and those that are alone
    in their bucket with others go on and are refined to LENGTH bytes: a bucket of at most LARGE in one task, a larger
    one over the cluster first.
    """
    docs = docs.select("doc_id", "t", "text")
    found = all_runs(docs)
    # written, so that the join after it deals both sides anew and Spark can split a frequent bucket
    often = stored(found.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h"), "often")
    some = stored(found.join(often, "h", "left_semi"), "runs")
    kinds = some.groupBy("h", "c").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("doc_id", "t", "lo")).alias("one"))
    kinds = stored(kinds, "kinds")
    mixed = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    equal = some.join(kinds.where("k > 1").select("h", "c"), ["h", "c"], "left_semi").select("doc_id", "t", "lo", (F.col("lo") + F.col("n") - 1 + LENGTH).alias("hi"))
    # one context of each kind: the rest of a kind has been decided with it
    one = kinds.join(mixed, "h").select("h", "c", F.col("one.doc_id").alias("doc_id"), F.col("one.t").alias("t"), F.col("one.lo").alias("lo"), F.col("kinds").alias("size"))
    todo = some.join(one, ["h", "c", "doc_id", "t", "lo"]).distinct()  # equal rows are one here
    lists = todo.groupBy("doc_id", "t").agg(F.collect_list(F.struct("h", "size", "lo", "n", "at")).alias("todo"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for i, k, text, todo in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                raw = (text.as_py() or "").encode()
                for x in todo:
                    part = raw[x["lo"] : x["lo"] + x["n"] - 1 + LENGTH]
                    rows.append((x["h"], x["size"], i, k, x["lo"], x["n"], x["at"], 0, _STARTS - 1, part))
                    size += len(part)
                if size > 8_000_000:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)

    contexts = stored(docs.join(lists, ["doc_id", "t"]).mapInArrow(cut, CONTEXTS), "contexts")
    return equal.unionByName(_context_spans(contexts))


def without_repeats(docs: DataFrame) -> DataFrame:
    """What remains of every whole text without its repeated strings.

    A null or empty text has 0 bytes, nothing removed, and the hash of the empty string. Repeated rows remove each
    other, under their own doc_id or one and the same. Every row has a result of its own: rows of one doc_id with
    different texts are documents of their own, and so are rows without doc_id. Other columns are not looked at.
    """
    docs = named(docs)
    spans = repeated_spans(docs).groupBy("doc_id", "t").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                raw = (t.as_py() or "").encode()
                kept, at, n = hashlib.sha256(), 0, 0
                gone = 0
                end = -1
                for x in spans.as_py() or []:
                    if x["lo"] > end:
                        kept.update(raw[max(at, 0) : x["lo"]])
                        n += 1
                        gone += x["hi"] - x["lo"]
                        end = at = x["hi"]
                    elif x["hi"] > end:
                        gone += x["hi"] - end
                        end = at = x["hi"]
                kept.update(raw[at:])
                rows.append((i, len(raw), gone, n, kept.hexdigest()))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(),) * 4 + (pa.string(),))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.join(spans, ["doc_id", "t"], "left").select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "text", "spans").mapInArrow(remove, RESULT)
