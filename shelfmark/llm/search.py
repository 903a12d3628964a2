"""Ranked lexical search the other way round: documents stream through an index of the queries."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Best documents kept for each item.
KEPT = 10
#: Bytes of item texts indexed and broadcast at once; a single longer item is a block of its own.
BLOCK_BYTES = 2_000_000
#: Bytes of a text split into terms at once, scores held at once, and candidates held before heaps are trimmed.
PIECE = 4_000_000
CELLS = 2_000_000
HELD = 500_000

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(raw: bytes | None) -> Counter:
    """Terms of a text (UTF-8) with their counts: stretches of ASCII letters, digits and other characters; A-Z in lower case."""
    out: Counter = Counter()
    if raw:
        at = 0
        while at < len(raw):
            end = at + PIECE
            while end < len(raw) and _TERM[raw[end]] != 32:  # never within a term
                end += 1
            out.update(raw[at:end].translate(_TERM).split())
            at = end
    return out


class Index:
    """Terms of a block of items, and the items of each term with how often they have it."""

    def __init__(self, items: list[bytes]) -> None:
        counts = [term_counts(t) for t in items]
        self.items = len(items)
        self.number = {w: k for k, w in enumerate(sorted(set().union(*counts)))} if counts else {}
        entry = sorted((self.number[w], i, n) for i, c in enumerate(counts) for w, n in c.items())
        term, self.item, self.times = np.asarray(entry, np.int64).reshape(-1, 3).T
        self.first = np.searchsorted(term, np.arange(len(self.number) + 1))


def postings(docs: DataFrame, sent) -> DataFrame:
    """(doc_id, n, terms, tf) of each document with a term: all its terms counted, the index's terms listed."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.number
        for b in batches:
            ids, rows = b.column(0), []
            for i in range(len(b)):
                c = term_counts(b.column(1)[i].as_py())
                if c:
                    own = number.keys() & c.keys() if len(number) < len(c) else [w for w in c if w in number]
                    rows.append((ids[i].as_py(), c.total(), [number[w] for w in own], [c[w] for w in own]))
                if len(rows) == 2_000:
                    yield _postings(rows)
                    rows = []
            yield _postings(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(scan, "doc_id long, n long, terms array<int>, tf array<long>")


def _postings(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["doc_id", "n", "terms", "tf"])


class Heaps:
    """The KEPT best (score, document) of each item; equal scores by ascending doc_id, documents without id last."""

    def __init__(self, items: int) -> None:
        self.least = np.ones(items, np.int64)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def offer(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        self.held.append((item, score, doc, known))
        self.size += len(item)
        if self.size > HELD:
            self.trim()

    def trim(self) -> tuple[np.ndarray, ...]:
        """Keep the best; from then on an item takes no score below its last one kept."""
        item, score, doc, known = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((doc, ~known.astype(bool), -score, item))
        item, score, doc, known = item[order], score[order], doc[order], known[order]
        first = np.searchsorted(item, np.arange(len(self.least) + 1))
        place = np.arange(len(item)) - first[item]
        last = place == KEPT - 1
        self.least[item[last]] = score[last]
        top = place < KEPT
        self.held, self.size = [(item[top], score[top], doc[top], known[top])], int(top.sum())
        return self.held[0]


def _ranked(stream: DataFrame, sent, documents: int, terms: int) -> DataFrame:
    """Each task's heaps. sent: the index and the weight of each of its terms."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight = sent.value
        heaps = Heaps(index.items)
        for b in batches:
            n, ids = b.column(1).to_pylist(), b.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            m = np.asarray([25 + 75 * x * documents // terms for x in n], np.int64)
            column = b.column(2)
            off = column.offsets.to_numpy().astype(np.int64)
            term, tf = column.values.to_numpy().astype(np.int64), b.column(3).values.to_numpy()
            cells = max(1, CELLS // max(1, index.items))
            for i in range(0, len(n), cells):
                at = off[i : min(i + cells, len(n)) + 1]
                k = len(at) - 1
                row = np.repeat(np.arange(k), np.diff(at))
                t, f = term[at[0] : at[-1]], tf[at[0] : at[-1]]
                part = weight[t] * ((1_000_000_000 * f) // (1000 * f + 8 * m[i : i + k][row]))
                total = np.zeros(k * index.items, np.int64)
                for j in range(0, len(t), 20_000):  # a bounded number of (document, term, item) at once
                    size = index.first[t[j : j + 20_000] + 1] - index.first[t[j : j + 20_000]]
                    which = np.repeat(np.arange(len(size)), size)
                    entry = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + index.first[t[j : j + 20_000]][which]
                    np.add.at(total, row[j : j + 20_000][which] * index.items + index.item[entry], part[j : j + 20_000][which] * index.times[entry])
                total = total.reshape(k, index.items)
                doc, item = np.nonzero(total >= heaps.least)
                heaps.offer(item, total[doc, item], ids[i : i + k][doc], known[i : i + k][doc])
        item, score, doc, known = heaps.trim()
        yield pa.record_batch([pa.array(item, pa.int64()), pa.array(doc, pa.int64(), mask=~known.astype(bool)), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return stream.mapInArrow(score, "item long, doc_id long, score long")


def item_blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """Distinct items with a term, numbered blocks of bounded size."""
    d = items.select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL").distinct()
    room = d.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    blocks = -(-room // BLOCK_BYTES)
    return d.withColumn("block", F.pmod(F.xxhash64("text", F.coalesce("item_id", F.lit(-1))), F.lit(max(1, blocks)))), blocks


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the KEPT highest-scoring documents of each item, scores above 0, in whole numbers.

    The index holds a block of items of bounded size, so that documents of any number stream through it where they lie: one
    pass makes their term counts, which are written; from them come the statistics and, in a second pass, the scores,
    of which each task keeps KEPT for each item; these heaps are merged by item. Larger sets of items take more passes.

    Null and empty texts have no terms: such documents count nowhere, such items have no rows. Every row of docs is a
    document: repeated rows are ranked each, documents without id after those of equal score that have one. Equal items
    count once; different texts of one item_id, or of none, are items each with its own ranking. An item's repeated
    term counts as often as it stands there. Very long texts are split in pieces. Other columns are not looked at.
    """
    spark = docs.sparkSession
    numbered, blocks = item_blocks(items)
    numbered = stored(numbered, "items")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        own = numbered.where(F.col("block") == b).select("item_id", "text").toArrow().to_pydict()
        index = Index(own["text"])
        if not index.number:
            continue
        stream = stored(postings(docs, spark.sparkContext.broadcast(index)), "postings")
        documents, terms = stream.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not documents:
            continue
        having = np.zeros(len(index.number), np.int64)
        for r in stream.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # at most the index's terms
            having[r["term"]] = r["count"]
        weight = np.asarray([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in having], np.int64)
        found = _ranked(stream, spark.sparkContext.broadcast((index, weight)), documents, terms)
        w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= KEPT)
        names = F.broadcast(spark.createDataFrame(list(enumerate(own["item_id"])), "item long, item_id long"))  # a block's items
        out = out.unionByName(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out
