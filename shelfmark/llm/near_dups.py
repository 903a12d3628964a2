"""Near duplicates: dart signatures, banded joining, exact checks, connected classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, mix, stored

#: Words in a shingle, least similarity, bands and signature coordinates in each.
WORDS = 5
SIMILAR = 0.8
BANDS = 32
ROWS = 5
NEED = SIMILAR / (1 + SIMILAR)
TINY = 1e-6
#: Members of a group of which all pairs are checked, and how many members of a larger one show its base.
SMALL = 100
SAMPLE = 32
SIGNATURE = "doc_id long, row long, node long, n long, bands array<long>"


def _cells() -> Iterator[tuple[float, np.ndarray]]:
    """Ranks cut into cells, low ones first: (height, distribution of the number of darts in a unit of weight)."""
    low = 0.0
    while True:
        height = 0.0625 if low < 0.125 else 0.125 if low < 0.5 else 0.25 if low < 1 else 0.5 if low < 4 else 1.0 if low < 16 else 4.0 if low < 128 else 8.0
        p, total, cdf = np.exp(-height), 0.0, []
        for k in range(64):
            total += p
            cdf.append(total)
            p *= height / (k + 1)
        yield height, np.minimum(np.asarray(cdf), 1.0)
        low += height


class Shingler:
    """Word hashes of a worker; emptied when large."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def units(self, text: str) -> np.ndarray:
        """The weighted shingles of a text as unit regions: a shingle that occurs w times is w of them.

        Sorted. A text of fewer words than a shingle is one shingle of its words; one without words has none.
        """
        words = text.lower().encode().split()
        if not words:
            return np.zeros(0, U64)
        if len(self.known) > 200_000:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(self.known.__getitem__, words), U64, len(words))
        n = max(1, len(h) - WORDS + 1)
        s = np.zeros(n, U64)
        for k in range(min(WORDS, len(h))):
            s = mix(s * U64(0x9E3779B97F4A7C15) + h[k : k + n])
        s.sort()
        first = np.append(True, s[1:] != s[:-1])
        at = np.flatnonzero(first)
        nth = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
        u = np.where(nth == 0, s, mix(s + nth.astype(U64) * U64(0xD6E8FEB86659FD93)))
        u.sort()
        return u


def signatures(units: list[np.ndarray]) -> np.ndarray:
    """Dart signatures, one row a text: each coordinate holds the dart of least rank that falls on it.

    Darts fall into (unit of weight, cell of rank) by hash, as a Poisson process; cells are opened from low rank
    until every coordinate of every text has its dart. Two texts agree on a coordinate with the probability of
    their weighted Jaccard similarity.
    """
    k = BANDS * ROWS
    out = np.zeros((len(units), k), U64)
    filled = np.zeros(len(units) * k, bool)
    elements = np.concatenate(units) if units else np.zeros(0, U64)
    of = np.repeat(np.arange(len(units)), [len(u) for u in units])
    left = np.where([len(u) > 0 for u in units], k, 0)
    flat = out.ravel()
    for cell, (_, cdf) in enumerate(_cells()):
        if not len(elements):
            return out
        seed = mix(elements + U64((cell + 1) * 0xA0761D6478BD642F % 2**64))
        n = np.searchsorted(cdf, (seed >> U64(11)).astype(np.float64) / 2.0**53, side="right")
        hit = np.flatnonzero(n)
        n = n[hit]
        which = np.repeat(hit, n)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        dart = mix(mix(seed[which]) + nth.astype(U64) * U64(0xE7037ED1A0B428DB))
        key = of[which] * k + (dart % U64(k)).astype(np.int64)
        new = ~filled[key]
        key, dart = key[new], dart[new]
        rank = mix(dart ^ U64(0x8EBC6AF09C88C6E3))
        order = np.lexsort((rank, key))
        key, dart = key[order], dart[order]
        first = np.append(True, key[1:] != key[:-1])[: len(key)]
        key = key[first]
        flat[key] = dart[first]
        filled[key] = True
        left -= np.bincount(key // k, minlength=len(units))
        more = left[of] > 0
        if not more.all():
            elements, of = elements[more], of[more]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    h = np.tile(np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), (len(signature), 1))
    for r in range(ROWS):
        h = mix(h ^ signature[:, r::ROWS])
    return h.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of id and text), node (64 bits that name the text's weighted shingles), their number, and band keys (none without words)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler()
        for batch in batches:
            ids, row, texts = batch.column(0), batch.column(1), [t or "" for t in batch.column(2).to_pylist()]
            for i, j in chunks(texts, 500_000):
                units = [own.units(t) for t in texts[i:j]]
                n = np.asarray([len(u) for u in units], np.int64)
                node = np.asarray([int(mix(u).sum()) for u in units], U64).view(np.int64)
                keys = band_keys(signatures(units))
                size = np.where(n > 0, BANDS, 0)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(keys[n > 0].ravel(), pa.int64()))
                yield pa.record_batch([ids.slice(i, j - i), row.slice(i, j - i), pa.array(node), pa.array(n), bands], names=["doc_id", "row", "node", "n", "bands"])

    return docs.select(F.col("doc_id").cast("long"), _row().alias("row"), "text").mapInArrow(sign, SIGNATURE)


def _row() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 0.0


def _arrays(column: pa.Array) -> list[np.ndarray]:
    at, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[i:j] for i, j in zip(at[:-1], at[1:])]


def _units(docs: DataFrame, todo: DataFrame) -> DataFrame:
    """(node, units) of the texts of todo (node, row), each text once."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in chunks(texts, 1_000_000):
                units = [own.units(t) for t in texts[i:j]]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(u) for u in units])]), pa.int32()), pa.array(np.concatenate(units).view(np.int64)))
                yield pa.record_batch([b.column(0).slice(i, j - i), lists], names=["node", "units"])

    texts = docs.groupBy(_row().alias("row")).agg(F.any_value("text").alias("text"))  # repeated rows meet before the join
    return texts.join(todo, "row").select("node", "text").mapInArrow(unfold, "node long, units array<long>")


def _met_units(units: DataFrame) -> DataFrame:
    """(node, n, units): of the units of each text those that some other text of these has too; n counts all.

    No pair shares others. Texts that keep too few of them for any link are left out.
    """
    alone = units.select("node", F.explode("units").alias("unit")).groupBy("unit").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).where("k = 1")
    alone = alone.groupBy("node").agg(F.collect_list("unit").alias("alone"))
    met = units.join(alone, "node", "left").select("node", F.size("units").cast("long").alias("n"), F.when(F.col("alone").isNull(), F.col("units")).otherwise(F.array_except("units", "alone")).alias("units"))
    return met.where(F.size("units") >= SIMILAR * F.col("n") - TINY)


def _linked(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Of these pairs (u, v, need) those that share at least need units."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = np.asarray([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(_arrays(b.column(3)), _arrays(b.column(4)))], np.int64)
            keep = pa.array(both >= b.column(2).to_numpy())
            yield pa.record_batch([b.column(0).filter(keep), b.column(1).filter(keep)], names=["u", "v"])

    one, two = (units.select(F.col("node").alias(k), F.col("units").alias(f"units_{k}")) for k in "uv")
    return pairs.join(one, "u").join(two, "v").select("u", "v", "need", "units_u", "units_v").mapInArrow(check, "u long, v long")


def _bases(groups: DataFrame, units: DataFrame) -> DataFrame:
    """(group, base): the units that most members of a group have, as far as about SAMPLE of its members show.

    Results do not hang on it, as any set of units serves as a base; a good one leaves little to compare.
    """

    def most(group: pa.Table) -> pa.Table:
        lists = [x for c in group.column("units").chunks for x in _arrays(c)]
        unit, n = np.unique(np.concatenate(lists), return_counts=True)
        return pa.table({"group": group.column("group")[:1], "base": pa.array([unit[2 * n > len(lists)]], pa.list_(pa.int64()))})

    some = groups.where(F.pmod(F.xxhash64("node"), F.col("size")) < SAMPLE).select("group", "node")
    return some.join(units, "node").select("group", "units").groupBy("group").applyInArrow(most, "group long, base array<long>")


def _against_bases(members: DataFrame, units: DataFrame, bases: DataFrame) -> DataFrame:
    """members: group, node, n, most, weight, label. Adds base_n, both (units shared with the base), more (others of the node) and less (others of the base)."""
    kinds = [pa.int64()] * 2 + [pa.list_(pa.int64())] * 2

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x, c in zip(_arrays(b.column(6)), _arrays(b.column(7))):
                more = np.setdiff1d(x, c, assume_unique=True)
                rows.append((len(c), len(x) - len(more), np.sort(more), np.setdiff1d(c, x, assume_unique=True)))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], *(pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 4, kinds))], names=["group", "node", "n", "most", "weight", "label", "base_n", "both", "more", "less"])

    both = members.join(units.select("node", "units"), "node").join(bases, "group").select("group", "node", "n", "most", "weight", "label", "units", "base")
    return both.mapInArrow(compare, "group long, node long, n long, most long, weight long, label long, base_n long, both long, more array<long>, less array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(doc, label): the least id of each connected component, for every id on an edge.

    Alternates large-star and small-star steps, each joins and minima only, until the edges stay.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(low.withColumnRenamed("m", "v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
        new = mark(now)
        if new == seen:
            break
        seen = new
    return now.select(F.col("u").alias("doc"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("doc"), F.col("v").alias("label"))).distinct()


def _scored(compared: DataFrame) -> DataFrame:
    """Adds to each member compared with its group's base a score, and the node of most score in its group (top).

    Also whether it is not linked to that node (far), and else that node as its label; how many units outside the base it
    must share with a partner that needs some (lack); the size up to which the base's units are enough (reach).

    With NEED = SIMILAR / (1 + SIMILAR), x and y are linked if and only if they share NEED * (n_x + n_y) units, that is
    if they share at least -(score_x + score_y) of the units in which each differs from the base. So all whose
    score makes up for the best one's are linked to that one without a look at it.
    """
    score = F.col("both") - NEED * F.col("n") - F.col("base_n") / 2
    compared = compared.withColumn("score", score)
    best = stored(compared.groupBy("group").agg(F.max(F.struct("score", "node")).alias("best"), F.min("n").alias("least")), "best")
    found = compared.join(best.select("group", F.col("best.node").alias("top"), F.col("best.score").alias("top_score"), "least"), "group")
    found = found.withColumn("far", F.col("score") + F.col("top_score") < -TINY)
    least = F.greatest(F.ceil(SIMILAR * F.col("n") - TINY), F.col("least"))
    lack = F.greatest(F.lit(1), F.ceil(NEED * (F.col("n") + least) - F.col("both") - TINY))
    reach = F.floor(F.col("both") / NEED + TINY) - F.col("n")
    label = F.when(F.col("far"), F.col("label")).otherwise(F.col("top"))
    return found.withColumns({"label": label, "lack": lack.cast("int"), "reach": reach})


def _next_groups(rest: DataFrame, turn: int) -> DataFrame:
    """Groups in which every pair lies that may still be linked, of members scored against their group's base.

    Of two members of different labels one is far. They share NEED * (n_x + n_y) units if linked. If either has fewer
    units of the base, they share a unit outside it, and as many as lack. Else they share a unit in which both
    differ from the base. Of n units of which so many must be shared, all but the last ones, in one order, are
    enough to meet on one.
    """
    head = lambda units, lack: F.explode(F.slice(units, 1, F.greatest(F.lit(0), F.size(units) - lack + 1)))
    common = ("group", "node", "n", "most", "weight", "label", "far", "reach")
    outside = rest.select(*common, head(F.col("more"), F.col("lack")).alias("unit")).withColumn("kind", F.lit(2 * turn))
    # the others, as far as sizes allow a pair with a far member
    ends = rest.groupBy("group").agg(F.max(F.when(F.col("far"), F.col("reach"))).alias("far_reach"), F.max(F.when(F.col("far"), F.col("score"))).alias("far_score")).where("far_reach IS NOT NULL")
    near = rest.join(ends, "group").where(F.when(F.col("far"), F.col("reach") >= F.col("least")).otherwise(False) | (F.col("n") <= F.col("far_reach")) & (F.col("reach") >= F.col("least")))
    lack = F.greatest(F.lit(1), F.ceil(-F.col("score") - F.when(F.col("far"), F.col("top_score")).otherwise(F.col("far_score")) - TINY)).cast("int")
    inside = near.select(*common, head(F.sort_array(F.concat("more", "less")), lack).alias("unit")).withColumn("kind", F.lit(2 * turn + 1))
    rows = stored(outside.unionByName(inside).withColumn("key", F.xxhash64("group", "unit", "kind")), "unit-groups")
    keys = rows.groupBy("key").agg(F.max(F.col("kind") % 2).alias("inside"), F.max("far").alias("far"), F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least"), F.max(F.when(F.col("far"), F.col("reach"))).alias("far_reach"), F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("name"))
    keys = keys.where(F.col("far") & (F.col("low") < F.col("high")))
    # of groups of one kind with the same members one is enough
    keys = keys.groupBy("inside", "size", "name").agg(F.min_by(F.struct("key", "least", "far_reach"), F.col("key")).alias("one")).select("one.*")
    rows = rows.drop("far_reach").join(stored(keys.withColumnRenamed("least", "key_least"), "keys"), "key")
    possible = (F.col("kind") % 2 == 0) | F.col("far") & (F.col("reach") >= F.col("key_least")) | (F.col("n") <= F.col("far_reach"))
    return stored(rows.where(possible).select("key", "node", "n", "most", "weight", "label"), "members")


def _links(members: DataFrame, units: DataFrame) -> DataFrame | None:
    """Links (u, v) among the members of each key: enough of them to connect all that are linked.

    In small groups all pairs of different labels are checked. The members of a larger one are compared with its
    base; then those pairs are grouped anew that can still be linked. members: key, node, n, most (how many of its n units others have too), weight, label.
    """
    found, turn = None, 0
    while not members.isEmpty():
        size = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("weight", "node")).alias("top"))
        sized = members.join(stored(size.select("key", "size", F.col("top.node").alias("top")), "sizes"), "key")
        sized = stored(sized, "sized")
        small, large = sized.where(F.col("size") <= SMALL), sized.where(F.col("size") > SMALL)
        one, two = (small.select("key", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "most", "label"))) for k in "uv")
        need = F.ceil(NEED * (F.col("n_u") + F.col("n_v")) - TINY)
        possible = (F.col("node_u") < F.col("node_v")) & (F.col("label_u") != F.col("label_v")) & (F.least("most_u", "most_v") >= need)
        pairs = one.join(two, "key").where(possible).select(F.col("node_u").alias("u"), F.col("node_v").alias("v"), need.alias("need")).distinct()
        links = stored(_linked(pairs, units), "links")
        found = links if found is None else found.unionByName(links)
        # the buckets of one group of texts have one member of most weight: they are one group
        if large.isEmpty():
            return found
        group = F.col("key") if turn else F.col("top")
        groups = large.groupBy(group.alias("group"), "node").agg(F.max("size").alias("size"), F.min("n").alias("n"), F.min("most").alias("most"), F.min("weight").alias("weight"), F.min("label").alias("label"))
        groups = stored(groups, "groups")
        bases = stored(_bases(groups, units), "bases")
        rest = stored(_scored(stored(_against_bases(groups, units, bases), "compared")), "rest")
        found = found.unionByName(rest.where("NOT far AND node <> top").select(F.col("node").alias("u"), F.col("top").alias("v")))
        members = _next_groups(rest, turn)
        turn += 1
    return found


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, row, n, and for texts with words class_id and best (the row hash of the class's least row), for every row."""
    sig = stored(signed(docs), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))  # an id before none
    texts = sig.where("n > 0").groupBy("node").agg(first.alias("rep"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    texts = stored(texts, "texts")
    rows = texts.select("node", "n", F.explode("bands").alias("key"))
    often = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "often")
    shared = stored(rows.join(often, "key"), "shared")
    todo = shared.select("node").distinct().join(texts, "node").select("node", F.col("rep.row").alias("row"))
    units = stored(_met_units(stored(_units(docs, todo), "all-units")), "units")
    # a text most of whose units others have is near the middle of its group
    weight = (F.size("units") / F.col("n") * 1_000_000).cast("long").alias("weight")
    kept = units.select("node", "n", F.size("units").cast("long").alias("most"), weight, F.col("node").alias("label"))
    members = stored(shared.select("key", "node").join(kept, "node"), "members")
    links = _links(members, units)
    reps = texts.select("node", "rep")
    if links is None:
        named = reps
    else:
        label = stored(components(links).select(F.col("doc").alias("node"), "label"), "labels")
        least = reps.join(label, "node").groupBy("label").agg(F.min("rep").alias("least"))
        named = reps.join(label.join(least, "label"), "node", "left").select("node", F.coalesce("least", "rep").alias("rep"))
    named = named.select("node", F.col("rep.doc_id").alias("class_id"), F.col("rep.row").alias("best"))
    return sig.drop("bands").join(stored(named, "named"), "node", "left")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and n_shingles, for every row.

    Texts of equal weighted shingles (five lower-cased words) are one class at once; of the others, pairs that
    share a band are linked if their exact similarity is 0.8 or more, and linked texts are one class. No bucket is
    expanded to all pairs: see _links. A null, empty or white-space text is a class of its own. Rows are judged by their text:
    repeated rows get the same class, and rows of one id with different texts those of their texts. Rows without an
    id take part; their class is the least id in it, or null. Texts may be of any length; columns other than doc_id
    and text are ignored. Texts are told apart by 64-bit sums of hashed shingles.
    """
    found = _classes(docs.select("doc_id", "text"))
    return found.select("doc_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.col("n").alias("n_shingles"))


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, of the first text of each class: the one with the least id.

    Every text without words stays. Rows that repeat both id and text are one row.
    """
    rows = _classes(docs.select("doc_id", "text"))
    keep = rows.where("n = 0 OR row = best").select(F.col("row").alias("near_dups_row")).distinct()
    named = docs.withColumn("near_dups_row", _row())
    return named.join(stored(keep, "keep"), "near_dups_row", "left_semi").dropDuplicates(["near_dups_row"]).select(*docs.columns)
