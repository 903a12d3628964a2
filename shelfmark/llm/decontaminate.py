"""Benchmark decontamination by the q-gram lemma and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, mix, stored

#: Q-gram length, window length, characters up to which an item is also asked for whole, edits allowed
#: for each character.
Q = 8
WINDOW = 120
WHOLE = 180
EDITS = 0.07
#: Characters of benchmark text in one broadcast index; more items are done in further blocks.
BLOCK_CHARS = 2_000_000
#: Characters of a normalised item from which it is cut into overlapping parts.
PART_CHARS = 500_000
SCHEMA = "doc_id long, item_id long"
_TABLE_BITS = 22
#: Places where a text and items share a q-gram that are looked at together.
HITS = 2_000_000


def normal(text: str) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(text.lower().split())


def windows(text: str) -> list[str]:
    """Every stretch of WINDOW characters, and an item of at most WHOLE characters itself, which has a larger budget."""
    t = normal(text)
    whole = [t] if 0 < len(t) <= WHOLE else []
    return whole + ([t[i : i + WINDOW] for i in range(len(t) - WINDOW + 1)] if len(t) > WINDOW else [])


def edit_budget(length: int) -> int:
    """The most edits for which the lemma still asks for at least one shared q-gram."""
    return max(0, min(int(EDITS * length), (length - Q) // Q))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(U64)


def _qgrams(codes: np.ndarray) -> np.ndarray:
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.zeros(n, U64)
    for k in range(Q):
        h = h * U64(0x100000001B3) + codes[k : k + n]
    return mix(h)


class Index:
    """Q-grams of benchmark items, each taken once; a stretch of an item is a range of its offsets.

    An entry is an item with the length of the stretches of it that are asked for: WINDOW, or the whole item.
    """

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items, self.text, self.short, spans = [], [], [], []
        for i, t in items:
            w = normal(t or "")
            if len(w) >= 2 * Q:
                self.items.append(i)
                self.text.append(w)
                spans.append([n for n in (len(w), WINDOW) if n <= len(w) and (n == WINDOW or len(w) <= WHOLE)])
            elif w:  # too short for the lemma, and for a place within a text to tell anything
                self.short.append((i, w))
        # for each item, (stretch length, budget, least shared q-grams)
        self.asked = [[(n, edit_budget(n), n - Q + 1 - Q * edit_budget(n)) for n in dict.fromkeys(x)] for x in spans]
        self.least = np.asarray([min(x[2] for x in a) for a in self.asked], np.int64)
        grams = [_qgrams(_codes(w)) for w in self.text]
        h = np.concatenate(grams) if grams else np.zeros(0, U64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.window = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order] if grams else np.zeros(0, np.int64)
        self.offset = np.concatenate([np.arange(len(g)) for g in grams])[order] if grams else np.zeros(0, np.int64)
        self.aligned: dict[tuple, bool] = {}
        self._grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.hash >> U64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def grams(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """The q-grams of one item in order, with their offsets; kept, as a block of items is bounded."""
        if w not in self._grams:
            h = _qgrams(_codes(self.text[w]))
            order = np.argsort(h, kind="stable")
            self._grams[w] = (h[order], order)
        return self._grams[w]

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, first entry, entries) of every q-gram of a text that some item has; nothing is expanded."""
        at = np.flatnonzero(self.table[(h >> U64(64 - _TABLE_BITS)).view(np.int64)])
        low = np.searchsorted(self.hash, h[at], "left")
        real = self.hash[np.minimum(low, len(self.hash) - 1)] == h[at]
        at, low = at[real], low[real]
        return at, low, np.searchsorted(self.hash, h[at], "right") - low


def _expanded(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def _slices(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of entries that expand to about HITS rows each."""
    upto = np.cumsum(n)
    first = 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + HITS, "right")))
        yield first, last
        first = last


def within(pattern: str, region: str, budget: int, first: int, last: int) -> bool:
    """Whether the pattern aligns to some part of the region, on diagonals first..last, with at most budget edits."""
    if pattern in region:
        return True
    p, r = _codes(pattern), _codes(region)
    width = last - first + 1
    diag = np.arange(first, last + 1)
    big = budget + 1
    cost = np.where((diag >= 0) & (diag <= len(r)), 0, big)
    for i in range(1, len(p) + 1):
        j = diag + i  # cells of the region reached on each diagonal
        ok = (j >= 1) & (j <= len(r))
        step = cost + np.where(ok, r[np.clip(j - 1, 0, len(r) - 1)] != p[i - 1], big)
        down = np.append(cost[1:] + 1, big)
        new = np.minimum(step, down)
        new = np.where((j < 0) | (j > len(r)), big, new)
        new = np.minimum.accumulate(new - np.arange(width)) + np.arange(width)  # characters of the region left over
        cost = np.minimum(np.where((j < 0) | (j > len(r)), big, new), big)
        if cost.min() > budget:
            return False
    return bool(cost.min() <= budget)


def any_within(item: str, starts: np.ndarray, size: int, text: str, budget: int, first: int, last: int) -> bool:
    """Whether within() holds for any stretch of the item from one of the starts, on the item's diagonals first..last."""
    p, r = _codes(item), _codes(text)
    ramp = np.arange(last - first + 1)
    diag = starts[:, None] + first + ramp
    big = budget + 1
    cost = np.where((diag >= 0) & (diag <= len(r)), 0, big)
    for i in range(1, size + 1):
        j = diag + i
        out = (j < 0) | (j > len(r))
        ok = (j >= 1) & ~out
        step = cost + np.where(ok, r[np.clip(j - 1, 0, len(r) - 1)] != p[starts + i - 1][:, None], big)
        down = np.append(cost[:, 1:] + 1, np.full((len(starts), 1), big), axis=1)
        new = np.where(out, big, np.minimum(step, down))
        new = np.minimum.accumulate(new - ramp, axis=1) + ramp
        cost = np.minimum(np.where(out, big, new), big)
        keep = cost.min(axis=1) <= budget
        if not keep.all():
            starts, diag, cost = starts[keep], diag[keep], cost[keep]
            if not len(starts):
                return False
    return True


def leaks(texts: list[str], index: Index) -> list[set[int]]:
    """For every normalised text the benchmark items of which one of windows() occurs in it within its edit budget."""
    found: list[set[int]] = [{i for i, w in index.short if w == t} for t in texts]
    if not len(index.hash):
        return found
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    h = _qgrams(_codes("\0".join(texts)))
    pos, low, n = index.found(h)
    doc = np.searchsorted(begin, pos, "right") - 1
    # the lemma without place first: a text must share enough q-grams with an item at all
    if n.sum() <= HITS:
        which = _expanded(low, n)
        at, off = np.repeat(pos, n), index.offset[which]
        key = np.repeat(doc, n) * len(index.text) + index.window[which]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, np.int64)
        for i, size in zip(first.tolist(), np.diff(np.append(first, len(key))).tolist()):
            d, w = divmod(int(key[order[i]]), len(index.text))
            if size >= index.least[w] and index.items[w] not in found[d]:
                rows = order[i : i + size]
                if _aligned(texts[d], w, at[rows] - begin[d] - off[rows], off[rows], index):
                    found[d].add(index.items[w])
        return found
    # many hits: counts only, slice by slice, and then the places of one text and item after another
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i, j in _slices(n):
        key, k = np.unique(np.repeat(doc[i:j], n[i:j]) * len(index.text) + index.window[_expanded(low[i:j], n[i:j])], return_counts=True)
        keys, at = np.unique(np.concatenate([keys, key]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([counts, k]), minlength=len(keys)).astype(np.int64)
    enough = counts >= index.least[keys % len(index.text)] if len(keys) else np.zeros(0, bool)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    for key in keys[enough].tolist():
        d, w = divmod(key, len(index.text))
        if index.items[w] not in found[d]:
            own = pos[bounds[d] : bounds[d + 1]]
            if _shared(texts[d], own - begin[d], h[own], w, index):
                found[d].add(index.items[w])
    return found


def _shared(text: str, pos: np.ndarray, h: np.ndarray, w: int, index: Index) -> bool:
    """Whether a stretch of item w occurs in the text. pos: where the text has q-grams h of any item, in order.

    The text is gone through in overlapping parts of bounded hits.
    """
    mine, offset = index.grams(w)
    low = np.searchsorted(mine, h, "left")
    n = np.searchsorted(mine, h, "right") - low
    hit = np.flatnonzero(n)
    pos, low, n = pos[hit], low[hit], n[hit]
    overlap = 2 * (WHOLE + edit_budget(WHOLE))  # more than any alignment spans
    upto = np.cumsum(n)
    first = 0
    while first < len(pos):
        last = int(np.searchsorted(upto, upto[first] - n[first] + HITS, "right"))
        last = max(last, int(np.searchsorted(pos, pos[first] + 2 * overlap)), first + 1)
        off = offset[_expanded(low[first:last], n[first:last])]
        if _aligned(text, w, np.repeat(pos[first:last], n[first:last]) - off, off, index):
            return True
        if last >= len(pos):
            break
        first = max(first + 1, int(np.searchsorted(pos, pos[last] - overlap)))
    return False


def _aligned(text: str, w: int, diag: np.ndarray, off: np.ndarray, index: Index) -> bool:
    """Bands of diagonals as wide as the budget on either side, each overlapping the next by half.

    In a band, every stretch whose offsets have enough q-grams is aligned: the first of them alone, as most
    quotes are found by it, then all others at once.
    """
    item = index.text[w]
    for size, budget, least in index.asked[w]:
        step = np.floor_divide(diag, budget + 1)
        bands, n = np.unique(np.concatenate([step, step - 1]), return_counts=True)
        for band in bands[n >= max(1, least)].tolist():
            low, high = band * (budget + 1) - budget, (band + 2) * (budget + 1) + budget
            upto = np.append(0, np.cumsum(np.bincount(off[(step == band) | (step == band + 1)], minlength=len(item) - Q + 1)))
            shared = upto[size - Q + 1 :] - upto[: len(upto) - (size - Q + 1)]
            starts = np.flatnonzero(shared >= max(1, least))
            if not len(starts):
                continue
            least_start = int(starts[0])
            begin = max(0, low + least_start)
            part, region = item[least_start : int(starts[-1]) + size], text[begin : max(0, high + int(starts[-1]) + size + 1)]
            key = (part, region, (starts - least_start).tobytes(), size, low + least_start - begin)
            if key not in index.aligned:  # passages that repeat, within a text or among items, are aligned once
                if len(index.aligned) > 20_000:
                    index.aligned.clear()
                index.aligned[key] = _stretches_within(part, region, starts - least_start, shared[starts], size, budget, low + least_start - begin, high + least_start - begin)
            if index.aligned[key]:
                return True
    return False


def _stretches_within(part: str, region: str, starts: np.ndarray, shared: np.ndarray, size: int, budget: int, low: int, high: int) -> bool:
    best = int(starts[np.argmax(shared)])
    begin = max(0, low + best)
    if within(part[best : best + size], region[begin : max(0, high + best + size + 1)], budget, low + best - begin, high + best - begin):
        return True
    rest = starts[starts != best]
    return any(any_within(part, rest[k : k + 4096], size, region, budget, low, high) for k in range(0, len(rest), 4096))


def _by_id(i: int | None) -> tuple[bool, int]:
    return i is None, i or 0


def _parts(items: DataFrame) -> DataFrame:
    """Distinct (item_id, text), texts normalised; one of over PART_CHARS in parts that every stretch of WINDOW lies within."""
    overlap = WINDOW + 2  # a space at the end of a part is cut off

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                w = normal(t.as_py() or "")
                n = max(1, -(-(len(w) - overlap) // (PART_CHARS - overlap)))
                step = -(-(len(w) - overlap) // n) if n > 1 else len(w)
                own = [w[k * step : (k + 1) * step + overlap] for k in range(n)] if n > 1 else [w]
                yield pa.record_batch([pa.array([i.as_py()] * n, pa.int64()), pa.array(own, pa.string())], names=["item_id", "text"])

    return items.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL").mapInArrow(cut, "item_id long, text string").where("text <> ''").distinct()


def blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded text, so that any size of it can be broadcast piece by piece.

    Equal items count once, and very long ones are cut, so that no row and no repetition makes a block large.
    """
    items = stored(_parts(items), "items")
    total = items.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_CHARS))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        if rows:
            yield sorted(((r.item_id, r.text) for r in rows), key=lambda r: (_by_id(r[0]), r[1]))


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) for every document that holds a benchmark item, or any stretch of WINDOW characters of one.

    Items of under 2 * Q characters say too little: only a text that is such an item as a whole holds it. Null and
    empty texts hold none, null and empty items are held by none; items without an id are one item, counted and
    without a place in the list of ids; repeated rows give one row. Texts may be of any length, and any number of
    items may share a passage. Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for rows in blocks(items):
        index = spark.sparkContext.broadcast(rows)

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = Index(index.value)
            for b in batches:
                ids, texts, got = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()], []
                for first, last in chunks(texts, 1_000_000):
                    some = [normal(t) for t in texts[first:last]]
                    got += [(i, x) for i, items in zip(ids[first:last], leaks(some, own)) for x in sorted(items, key=_by_id)]
                yield pa.record_batch([pa.array(x, pa.int64()) for x in (zip(*got) if got else ([], []))], names=["doc_id", "item_id"])

        part = docs.mapInArrow(scan, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out.distinct()


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each row of docs: whether it holds benchmark text, how many items, and which, in order.

    Each row is answered from its own text, without a join or shuffle: rows without id, and rows of one id with
    different texts, have their own answers, repeated rows equal ones. Otherwise as matches says. Further blocks of
    items add to the lists of those before; texts go along until the last.
    """
    d = docs.select(F.col("doc_id").cast("long"), "text")
    every = list(blocks(items))
    schema = "doc_id long, text string, item_ids array<long>, other boolean"
    d = d.withColumns({"item_ids": F.array().cast("array<long>"), "other": F.lit(False)})
    for rows in every:
        index = docs.sparkSession.sparkContext.broadcast(rows)

        def scan(batches: Iterator[pa.RecordBatch], index=index, last=rows is every[-1]) -> Iterator[pa.RecordBatch]:
            own = Index(index.value)
            for b in batches:
                texts, lists, other = [t or "" for t in b.column(1).to_pylist()], [], []
                had, flag = b.column(2).to_pylist(), b.column(3).to_pylist()
                for first, end in chunks(texts, 1_000_000):
                    for k, found in enumerate(leaks([normal(t) for t in texts[first:end]], own), first):
                        lists.append(sorted(set(had[k]) | (found - {None})))
                        other.append(flag[k] or None in found)
                kept = pa.nulls(len(b), pa.string()) if last else b.column(1)
                yield pa.record_batch([b.column(0), kept, pa.array(lists, pa.list_(pa.int64())), pa.array(other, pa.bool_())], names=["doc_id", "text", "item_ids", "other"])

        d = d.mapInArrow(scan, schema)
    n = (F.size("item_ids") + F.col("other").cast("int")).cast("long")
    return d.select("doc_id", (n > 0).alias("contaminated"), n.alias("n_items"), "item_ids")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that hold no benchmark text; no shuffle of texts."""
    at = docs.columns.index("text")
    schema = docs.schema
    for rows in blocks(items):
        index = docs.sparkSession.sparkContext.broadcast(rows)

        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = Index(index.value)
            for b in batches:
                texts, clean = [t or "" for t in b.column(at).to_pylist()], []
                for first, last in chunks(texts, 1_000_000):
                    clean += [not x for x in leaks([normal(t) for t in texts[first:last]], own)]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, schema)
    return docs
