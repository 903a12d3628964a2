"""Nearest vectors by inner product: collision-counting hashing over query-centred windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Single random projections, and half the width of a window in units of the radius.
PROJECTIONS = 128
WIDTH = 2.0
#: A vector at just the radius reaches the collision threshold with this probability at least.
FOUND = 0.99
#: Factor from one radius to the next while a query has no bound yet.
GROW = 1.15
#: Rows of a block from which the first radius of a query without a bound is guessed.
GUESS = 512
#: Rows indexed together in a task.
BLOCK = 16_384
#: One row in so many goes to each smaller level; the smallest has so many rows at least.
FEWER = 16
LEAST = 16_384
#: Bytes of query vectors broadcast at once.
QUERY_BYTES = 16_000_000
SEED = 12


def threshold() -> int:
    """The fewest collisions, of PROJECTIONS, that a vector at the radius has with probability FOUND."""
    out = math.erfc(WIDTH / math.sqrt(2))
    total = 0.0
    for k in range(PROJECTIONS + 1):
        total += math.comb(PROJECTIONS, k) * out**k * (1 - out) ** (PROJECTIONS - k)
        if total >= FOUND:
            return PROJECTIONS - k
    return 0


def directions(size: int) -> np.ndarray:
    """PROJECTIONS random directions, at right angles within each size of them, scaled as normal vectors are."""
    r = np.random.default_rng((SEED, size))
    bases = [np.linalg.qr(r.standard_normal((size, size)))[0] for _ in range(-(-PROJECTIONS // size))]
    return np.concatenate(bases, axis=1)[:, :PROJECTIONS] * math.sqrt(size)


class Block:
    """Rows indexed by sorted projections.

    Inner products become distances: a row gets one more component that brings it to the largest norm of the block, a
    query is brought to that norm, so that squared distances are 2 M^2 - 2 M <row, query> / |query|.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        self.unit = float(np.abs(rows).max())
        scaled = rows / self.unit
        square = (scaled * scaled).sum(1)
        self.norm = math.sqrt(square.max())
        full = np.concatenate([scaled, np.sqrt(np.maximum(0.0, square.max() - square))[:, None]], axis=1)
        self.directions = directions(full.shape[1])
        p = (full @ self.directions).T
        self.order = np.argsort(p, axis=1, kind="stable")
        self.sorted = np.take_along_axis(p, self.order, axis=1)

    def windows(self, queries: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and projection the first and the last place of the window about the query."""
        at = (queries @ self.directions[:-1]).T
        half = WIDTH * radius
        lo = np.stack([np.searchsorted(s, a - half, "left") for s, a in zip(self.sorted, at)], axis=1)
        hi = np.stack([np.searchsorted(s, a + half, "right") for s, a in zip(self.sorted, at)], axis=1)
        return lo, hi

    def colliding(self, lo: np.ndarray, hi: np.ndarray, least: int) -> np.ndarray:
        """Rows that lie in at least so many of a query's windows; wide windows are counted by what they leave out."""
        n = len(self.ids)
        if 2 * int((hi - lo).sum()) <= n * len(lo):
            inside = np.concatenate([o[i:j] for o, i, j in zip(self.order, lo.tolist(), hi.tolist())])
            return np.flatnonzero(np.bincount(inside, minlength=n) >= least)
        outside = [x for o, i, j in zip(self.order, lo.tolist(), hi.tolist()) for x in (o[:i], o[j:])]
        return np.flatnonzero(np.bincount(np.concatenate(outside), minlength=n) <= len(lo) - least)


class Nearest:
    """The k nearest rows of each query among all blocks seen so far, and the bound that they set."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bound: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.bound, self.k = ids, vectors, bound, k
        unit = np.abs(vectors).max(1, keepdims=True)
        self.norm = unit[:, 0] * np.sqrt(((vectors / unit) ** 2).sum(1))
        self.unit = vectors / self.norm[:, None]
        self.score, self.found = np.full((len(ids), k), np.nan), np.zeros((len(ids), k), np.int64)
        self.least = threshold()

    def look(self, block: Block, i: int, cand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best of these rows: approximate first, then, for what may count, the same sum for each row."""
        q = self.vectors[i]
        cand = cand[block.ids[cand] != self.ids[i]]
        about = block.rows[cand] @ q
        slack = 1e-10 * self.norm[i] * block.unit * block.norm
        low = self.bound[i]
        if len(about) > self.k:
            low = max(low, np.partition(about, -self.k)[-self.k])
        cand = cand[~(about < low - slack)]
        return block.ids[cand], (block.rows[cand] * q).sum(1)

    def search(self, block: Block, some: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Rows of the block that may be among the k nearest of each of these queries.

        A query with a bound, its k-th best score so far, has its last radius at once. One without starts from a
        radius guessed from a few rows and grows it (virtual rehashing: the windows in the same arrays become wider),
        until k verified rows lie within the radius or all rows collide.
        """
        m = block.norm
        with np.errstate(over="ignore", invalid="ignore"):
            cosine = self.bound[some] / (self.norm[some] * block.unit * m)
        some, cosine = some[~(cosine > 1 + 1e-9)], cosine[~(cosine > 1 + 1e-9)]
        own = self.unit[some] * m
        known = np.isfinite(cosine)
        if not known.all():
            few = block.rows[:: max(1, len(block.ids) // GUESS)] / (block.unit * m)
            at = min(len(few), 1 + -(-self.k * len(few) // len(block.ids)))  # one more: a row meets itself
            guess = np.partition(self.unit[some[~known]] @ few.T, -at, axis=1)[:, -at]
            cosine[~known] = np.minimum(guess, 1 - 1e-4)
        radius = m * np.sqrt(np.maximum(0.0, 2 - 2 * cosine)) + 1e-9 * m
        left = np.arange(len(some))
        while len(left):
            lo, hi = block.windows(own[left], radius[left])
            again = []
            for k, w in enumerate(left.tolist()):
                cand = block.colliding(lo[k], hi[k], self.least)
                if known[w]:
                    yield (int(some[w]), *self.look(block, int(some[w]), cand))
                    continue
                done = radius[w] > 2 * m
                if done or len(cand) > self.k:
                    ids, score = self.look(block, int(some[w]), cand)
                    near = score / (self.norm[some[w]] * block.unit) * m >= m * m - radius[w] ** 2 / 2
                    if done or len(np.unique(ids[near])) >= self.k:
                        yield int(some[w]), ids, score
                        continue
                again.append(w)
            left = np.asarray(again, np.int64)
            radius[left] *= GROW

    def add(self, block: Block) -> None:
        for first in range(0, len(self.ids), 1024):
            some = np.arange(first, min(first + 1024, len(self.ids)))
            for i, ids, score in self.search(block, some):
                if not len(ids):
                    continue
                had = ~np.isnan(self.score[i])
                s, v = np.concatenate([self.score[i][had], score]), np.concatenate([self.found[i][had], ids])
                best = np.lexsort((v, -s))
                # an id that stands more than once counts with its best row
                best = best[np.sort(np.unique(v[best], return_index=True)[1])[: self.k]]
                self.score[i, : len(best)], self.found[i, : len(best)] = s[best], v[best]
                if len(best) == self.k:
                    self.bound[i] = max(self.bound[i], s[best[-1]])

    def rows(self) -> pa.RecordBatch:
        some = ~np.isnan(self.score)
        return pa.record_batch([pa.array(np.repeat(self.ids, some.sum(1)), pa.int64()), pa.array(self.found[some], pa.int64()), pa.array(self.score[some], pa.float64())], names=["query_id", "vec_id", "score"])


def _usable(vectors: DataFrame) -> DataFrame:
    d = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e150)
    good = F.col("vec_id").isNotNull() & ~F.exists("embedding", odd) & F.exists("embedding", lambda x: x != 0)
    return d.where(good)


def _looked_at(table: DataFrame, sent, k: int) -> DataFrame:
    """Each task's k nearest rows of its part for every query of the broadcast block, none below the query's bound."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {size: Nearest(ids, rows, bound.copy(), k) for size, (ids, rows, bound) in sent.value.items()}
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def index(size: int) -> None:
            ids, rows = (np.concatenate(x) for x in zip(*held.pop(size)))
            for i in range(0, len(ids), BLOCK):
                own[size].add(Block(ids[i : i + BLOCK], rows[i : i + BLOCK]))

        for b in batches:
            column = b.column(1)
            size = np.diff(column.offsets.to_numpy())
            flat, at = column.values.to_numpy(), column.offsets.to_numpy()[:-1]
            for n in np.unique(size).tolist():
                if n in own:
                    some = np.flatnonzero(size == n)
                    held.setdefault(n, []).append((b.column(0).to_numpy()[some], flat[at[some][:, None] + np.arange(n)]))
                    if sum(len(x[0]) for x in held[n]) >= BLOCK:
                        index(n)
        for n in list(held):
            index(n)
        for x in own.values():
            yield x.rows()

    return table.mapInArrow(search, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    one = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by every, the k rows of largest inner product.

    Queries go out in blocks of bounded size. The rows lie in levels, each some FEWER times larger than the one before:
    the k-th best score of a query over one level bounds its radius in the next, so that each level adds about
    k * FEWER rows a query whatever the size of the table. A level's rows are searched where they lie, in blocks of
    rows of like norm, each with its own sorted projections. A row within the radius is missed with a probability of at
    most 1 - FOUND; what is found is compared exactly, in doubles.

    vectors has vec_id and embedding. Null and zero vectors, those with a null, non-finite or huge (over 1e150)
    component, and rows without id take no part. Vectors of different lengths do not meet. Equal rows count once;
    if an id has several vectors, two ids have the largest product of any of theirs, and an id never meets itself.
    Ties go to the smaller vec_id. Other columns are not looked at. A query without candidates has no rows.
    """
    spark = vectors.sparkSession
    good = _usable(vectors)
    asked = (F.col("vec_id") % every == 0)
    n, room = good.agg(F.count(F.lit(1)), F.sum(F.when(asked, F.size("embedding") * 8 + 24))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not room:
        return empty
    levels = 0
    while n >= LEAST * FEWER ** (levels + 1):
        levels += 1
    own = F.lit(levels)
    for i in reversed(range(levels)):
        own = F.when(F.pmod(F.xxhash64("vec_id"), F.lit(FEWER ** (levels - i))) == 0, i).otherwise(own)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    tables = [stored(good.where(own == i).sortWithinPartitions(norm.desc()), "vectors") for i in range(levels + 1)]
    blocks = -(-room // QUERY_BYTES)
    queries = stored(good.where(asked).distinct().withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))), "queries")
    out = empty
    for b in range(blocks):
        rows = queries.where(F.col("block") == b).select("vec_id", "embedding").toArrow().to_pydict()
        by: dict[int, list[int]] = {}
        for i, v in enumerate(rows["embedding"]):
            by.setdefault(len(v), []).append(i)
        ids = {size: np.asarray([rows["vec_id"][i] for i in some], np.int64) for size, some in by.items()}
        matrix = {size: np.asarray([rows["embedding"][i] for i in some], np.float64) for size, some in by.items()}
        bound: dict[int, float] = {}
        best = None
        for level, table in enumerate(tables):
            sent = spark.sparkContext.broadcast({s: (ids[s], matrix[s], np.asarray([bound.get(i, -np.inf) for i in ids[s].tolist()])) for s in by})
            found = _looked_at(table, sent, k)
            best = stored(_best(found if best is None else found.unionByName(best.select(found.columns)), k), "nearest")
            if level < levels:
                bound = {r.query_id: r.score for r in best.where(F.col("rank") == k).select("query_id", "score").toLocalIterator()}
        out = out.unionByName(best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    return out
