"""An inverted index of characters for searches by a part of a text, so that a term does not scan all texts.

A text is folded once and its different grams of one, two and three characters are postings: lists of the keys that hold
a gram, made in the task that reads the texts, of a few million characters at a time, and dealt over a fixed number of
partitions by hash. So the shuffle carries a key for each different gram of a text, but no gram with each. A term of three
characters and more looks up its rarest trigrams alone, what holds them all is a candidate, and candidates are verified
against their texts; a shorter term is a gram itself. Both tables are read only in the partitions that the grams, and then
the candidates, lie in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold_latin, fold_latin_long
from .aggregates import spread, top_k, written
from .joins import id_lists

#: Partitions of postings and of texts. A search names at most so many of each to the driver.
PARTS = 64
#: How many of its rarest trigrams a term looks up.
RAREST = 3
#: Tasks that the hits of a term are dealt over where they meet the rows that ask for it.
SALTS = 16
#: Characters of texts whose postings are listed at once; a longer text is listed alone.
LISTED = 4_000_000


def _part(col: Column) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(PARTS)).cast("int")


def grams(folded: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """The different grams of a text; neighbours are zipped, so the work grows with the length alone."""
    chars = F.split(folded, "")
    after = lambda n: F.slice(chars, n + 1, F.size(chars))
    two = F.zip_with(chars, after(1), lambda a, b: F.concat(a, b))  # null beyond the end
    of = {1: chars, 2: two, 3: F.zip_with(two, after(2), lambda a, b: F.concat(a, b))}
    return F.when(F.length(folded) > 0, F.array_distinct(F.array_compact(F.concat(*[of[n] for n in sizes])))).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Index:
    """postings (part, gram, key), counts (part, gram, n) and texts (part, key, text), each below a path; lists holds the postings as (part, gram, keys)."""

    spark: SparkSession
    path: str
    key_type: str

    def table(self, name: str) -> DataFrame:
        if name == "postings":
            return self.table("lists").select("gram", "part", F.explode("keys").alias("key"))
        columns = {"texts": f"key {self.key_type}, text string", "lists": f"gram string, keys array<{self.key_type}>", "counts": "gram string, n bigint"}[name]
        return self.spark.read.schema(f"{columns}, part int").parquet(f"{self.path}/{name}")


def _grams_of(texts: list[str], owner: np.ndarray) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """For each size of grams: the different grams of these texts, and of each different (gram, owner) both places, in that order.

    Characters are numbered as they occur, so that a gram with its owner is one whole number and one sort tells them apart.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    used = np.zeros(0x110000, bool)
    used[codes] = True
    chars, codes = np.flatnonzero(used), (np.cumsum(used) - 1)[codes]
    of, left = np.repeat(owner, sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters to the text's end
    n, owners = len(chars), int(owner[-1]) + 1 if len(owner) else 1
    gram = np.zeros(len(codes), np.int64)
    for size in (1, 2, 3):
        gram = gram[: max(0, len(codes) - size + 1)] * n + codes[size - 1 :]
        whole = left[: len(gram)] >= size
        both = np.sort(gram[whole] * owners + of[: len(gram)][whole])
        both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
        which, place = np.divmod(both, owners)
        first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else which
        found, parts = which[first], []
        for _ in range(size):
            parts.append(chars[found % n])
            found = found // n
        text = np.stack(parts[::-1], axis=1).astype("<u4").tobytes().decode("utf-32-le")
        yield [text[i : i + size] for i in range(0, len(text), size)], np.cumsum(np.r_[False, which[1:] != which[:-1]]) if len(which) else which, place


def _posting_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, keys) of (key, text) in order of key: no key twice in the lists of a gram, even if its texts fill several lists."""
    last, had = None, set()  # of the key that the last lists end with

    def lists(keys: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        nonlocal last, had
        new = np.fromiter((i > 0 and k != keys[i - 1] for i, k in enumerate(keys)), bool, len(keys))
        owner, own = np.cumsum(new), pa.array([k for i, k in enumerate(keys) if i == 0 or new[i]], key_type)
        again, goes_on = keys[0] == last, set()
        for grams, which, place in _grams_of(texts, owner):
            goes_on.update(grams[i] for i in which[place == len(own) - 1])
            if again:
                known = np.fromiter((g in had for g in grams), bool, len(grams))
                kept = ~(known[which] & (place == 0))
                which, place = which[kept], place[kept]
            ends = np.r_[0, np.cumsum(np.bincount(which, minlength=len(grams)))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.ListArray.from_arrays(pa.array(ends), own.take(pa.array(place)))], ["gram", "keys"])
        had = goes_on | had if again and len(own) == 1 else goes_on
        last = keys[-1]

    def fitting(keys: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        used = np.zeros(0x110000, bool)
        used[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)] = True
        step = 2**62 // int(used.sum()) ** 3  # a gram and its owner are a number of 62 bits; two at least, as there are so few characters
        for i in range(0, len(texts), step):
            yield from lists(keys[i : i + step], texts[i : i + step])

    keys, texts, chars, key_type = [], [], 0, None
    for b in batches:
        key_type = b.column(0).type
        for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if texts and chars + len(t) > LISTED:
                yield from fitting(keys, texts)
                keys, texts, chars = [], [], 0
            keys.append(k)
            texts.append(t)
            chars += len(t)
    if texts:
        yield from fitting(keys, texts)


def build_index(texts: DataFrame, key: str, text: str, path: str) -> Index:
    """Index the texts of every key; a key may have several, null keys and null or empty texts have no grams.

    Frequent texts need no care: a text gives no more postings than it has different grams. The texts of a key come to one
    task in a row, which holds LISTED characters at a time.
    """
    spark = texts.sparkSession
    d = texts.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), fold_latin_long(F.col(text)).alias("text")).where("text <> ''")
    d = written(d, "folded").withColumn("part", _part(F.col("key")))
    d.repartition("part").write.partitionBy("part").parquet(f"{path}/texts")
    key_type = d.schema["key"].dataType.simpleString()
    lists = d.select("key", "text").repartition("key").sortWithinPartitions("key").mapInArrow(_posting_lists, f"gram string, keys array<{key_type}>")
    # a frequent gram has a list for every few million characters, so it is dealt over eight tasks of its partition's folder
    lists = lists.where(F.size("keys") > 0).withColumn("part", _part(F.col("gram"))).withColumn("_salt", F.pmod(F.xxhash64(F.col("keys")[0]), F.lit(8)))
    lists.repartition("part", "_salt").drop("_salt").write.partitionBy("part").parquet(f"{path}/lists")
    index = Index(spark, path, key_type)
    index.table("lists").groupBy("part", "gram").agg(F.sum(F.size("keys")).alias("n")).repartition("part").write.partitionBy("part").parquet(f"{path}/counts")
    return index


def _only(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """The partitions of a table that wanted names: at most PARTS numbers come to the driver."""
    return table.where(F.col("part").isin([r[0] for r in wanted.select("part").distinct().collect()]))


def candidates(index: Index, terms: DataFrame) -> DataFrame:
    """(term_id, term, key, sure): keys that hold the rarest grams of a folded term; sure where that is all of it: a term of up to three is a gram."""
    short = F.length("term") <= 3
    own = terms.select("term_id", "term", F.explode(F.when(short, F.array("term")).otherwise(grams(F.col("term"), (3,)))).alias("gram")).withColumn("part", _part(F.col("gram")))
    own = written(own, "grams")
    counted = own.join(_only(index.table("counts"), own), ["part", "gram"], "left")
    rare = top_k(counted, ["term_id"], [F.coalesce("n", F.lit(0)), F.col("gram")], RAREST)  # a gram that no text has comes first
    rare = written(rare.withColumn("_need", F.count(F.lit(1)).over(Window.partitionBy("term_id"))).withColumn("_none", F.max(F.col("n").isNull()).over(Window.partitionBy("term_id"))).where("NOT _none"), "rare")
    held = _only(index.table("postings"), rare).join(rare.drop("n"), ["part", "gram"]).groupBy("term_id", "term", "key", "_need").agg(F.count(F.lit(1)).alias("_n"))
    return held.where("_n = _need").select("term_id", "term", "key", short.alias("sure"))


def search(index: Index, terms: DataFrame, term_id: str, term: str) -> DataFrame:
    """(term_id, key): the keys with a text that contains a term, both folded, as contains over all texts would say.

    terms is a table of any length, ids unique; a null or empty term finds nothing.
    """
    members, found = search_classes(index, terms, term_id, term)
    one = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    # a frequent term has many rows and many hits, so the hits are dealt over SALTS tasks, each with all its rows as lists of ids
    lists = id_lists(one, members, "term_id", "_ids").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = spread(found).withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return hits.join(lists, ["class_id", "_salt"]).select(F.explode("_ids").alias("term_id"), "key")


def search_classes(index: Index, terms: DataFrame, term_id: str, term: str) -> tuple[DataFrame, DataFrame]:
    """(term_id, class_id) and (class_id, key): each different term is looked up once, under the least id of those that have it.

    Terms that recur so give no more hits than one; search gives each its own.
    """
    all_terms = written(terms.select(F.col(term_id).alias("term_id"), fold_latin(F.col(term)).alias("term")).where("term <> ''"), "terms")
    least = written(all_terms.groupBy("term").agg(F.min("term_id").alias("class_id")), "classes")
    return all_terms.join(least, "term").select("term_id", "class_id"), _lookup(index, least.select(F.col("class_id").alias("term_id"), "term")).withColumnRenamed("term_id", "class_id")


def _lookup(index: Index, folded: DataFrame) -> DataFrame:
    found = written(candidates(index, folded), "candidates")
    unsure = found.where("NOT sure").withColumn("part", _part(F.col("key")))
    texts = _only(index.table("texts"), unsure)
    proven = unsure.join(texts, ["part", "key"]).where(F.contains(F.col("text"), F.col("term"))).select("term_id", "key").distinct()
    return found.where("sure").select("term_id", "key").unionByName(proven)


def entity_search(index: Index, titles: DataFrame, terms: DataFrame, term_id: str, term: str, limit: int = 20) -> DataFrame:
    """(term_id, key, title, rank): of the entities of which some name, alias or code contains a term the first by title and key."""
    d = search(index, terms, term_id, term).join(titles.select("key", "title").distinct(), "key")
    place = F.row_number().over(Window.partitionBy("term_id").orderBy("title", "key"))
    return d.withColumn("rank", place).where(F.col("rank") <= limit)
