"""Aggregates and windows: ordered collections, representatives, rollups, ranking, paging."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sum0(col: str) -> Column:
    return F.coalesce(F.sum(col), F.lit(0))


def bit_or0(col: str) -> Column:
    return F.coalesce(F.bit_or(col), F.lit(0).cast("long"))


def ordered_array(order: list[str], value: str) -> Column:
    """Values in order; null values stay, which collect_list alone would drop."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.col(value).alias("v")))), lambda x: x["v"])


def sorted_set(col: str) -> Column:
    return F.array_sort(F.collect_set(col))


def first_non_blank(col: str, order: str) -> Column:
    return F.min_by(F.col(col), F.when(F.trim(F.col(col)) != "", F.col(order)))


def earliest_date(col: Column) -> Column:
    return F.min(F.try_to_timestamp(col, F.lit("yyyy-MM-dd"))).cast("date")


def representative(df: DataFrame, key: str, value: str) -> DataFrame:
    """The commonest value if some value repeats, the least of ties; else the lower median.

    The median is the value at the middle place of a sorted window, so that no key's values are gathered in one row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key).agg(F.max("n").alias("most"), F.min_by(F.col(value), F.struct(-F.col("n"), F.col(value))).alias("mode"), F.count(F.lit(1)).alias("kinds"))
    flat = counts.join(best.where("most = 1").select(key, "kinds"), key).withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(value)))
    middle = flat.where("_place = floor((kinds - 1) / 2) + 1").select(key, F.col(value).alias("middle"))
    return best.join(middle, key, "left").select(key, F.when(F.col("most") > 1, F.col("mode")).otherwise(F.col("middle")).alias("representative"))


def majority(df: DataFrame, key: str, value: str) -> DataFrame:
    """The values of each key with the most rows."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("_r", F.rank().over(Window.partitionBy(key).orderBy(F.desc("n")))).where("_r = 1").drop("_r")


def find_equal_set(groups: DataFrame, wanted: DataFrame, key: str, member: str, wanted_key: str) -> DataFrame:
    """(wanted_key, key) of groups with exactly the same members."""
    one = groups.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("_set"))
    two = wanted.groupBy(wanted_key).agg(F.array_sort(F.collect_set(member)).alias("_set"))
    return two.join(one, "_set").select(wanted_key, key)


def rollup_decade_year(df: DataFrame, when: str) -> DataFrame:
    """Rows counted under their decade and under their year; undated ones under unknown."""
    d = df.select(F.year(when).alias("year")).withColumn("decade", (F.floor(F.col("year") / 10) * 10).cast("int"))
    sets = d.groupingSets([["decade"], ["decade", "year"]], "decade", "year").agg(F.count(F.lit(1)).alias("n"), F.grouping("year").alias("is_decade"))
    return sets.where("is_decade = 1 OR decade IS NOT NULL")


def bitmask_rollup(df: DataFrame, col: str, nodes: DataFrame) -> DataFrame:
    """Rows counted once under every node (key, mask) of which they have a bit. nodes is a small fixed tree."""
    masks = df.groupBy(F.col(col).alias("_mask")).agg(F.count(F.lit(1)).alias("_n"))  # few different ones meet the tree
    return masks.join(nodes, F.col("_mask").bitwiseAND(F.col("mask")) != 0).groupBy("key").agg(F.sum("_n").alias("n"))


def top_k(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def top_page(df: DataFrame, key: list[str], order: list[Column], page: int, size: int = 24) -> DataFrame:
    """One page of every key's rows, with their place."""
    r = df.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return r.where(F.col("place").between((page - 1) * size + 1, page * size))


def locate(df: DataFrame, id_col: str, value: int, page_size: int) -> DataFrame:
    """The page on which a row stands in id order; an aggregate, not a global window."""
    n = F.count(F.when(F.col(id_col) <= value, 1))
    return df.agg(n.alias("place"), F.ceil(n / page_size).cast("long").alias("page"))


def append_order(existing: DataFrame, new: DataFrame, group: str, member: str, order: str) -> DataFrame:
    """New members of each group take the places after its last one; those already there are left out."""
    fresh = new.join(existing.select(group, member), [group, member], "left_anti")
    last = existing.groupBy(group).agg(F.max(order).alias("_last"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(member))
    return fresh.join(last, group, "left").select(group, member, (F.coalesce("_last", F.lit(0)) + place).cast("long").alias(order))


def apply_sort(df: DataFrame, rules: list[tuple[str, bool]], id_col: str) -> DataFrame:
    """Ascending or descending per rule, nulls last both ways, the id last."""
    cols = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in rules]
    return df.orderBy(*cols, F.col(id_col).asc())


def sort_places(df: DataFrame, rules: list[tuple], id_col: str, name: str = "place") -> DataFrame:
    """The place of every row under apply_sort's order, from 0; no row is left out."""
    cols = [(c if isinstance(c, Column) else F.col(c)) for c, _ in rules]
    order = [c.asc_nulls_last() if up else c.desc_nulls_last() for c, (_, up) in zip(cols, rules)]
    return sequence_ids(df, [*order, F.col(id_col).asc()], name)


def array_key(col: str) -> Column:
    """What an array column is sorted by: its elements in order, joined."""
    return F.array_join(F.array_sort(col), "")


def sort_groups(groups: DataFrame, members: DataFrame, key: str, rules: list[tuple[str, bool]], id_col: str, name: str = "place") -> DataFrame:
    """The place of every group under the order of its best member by the same rules; groups without members come last."""
    order = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in rules]
    best = top_k(members, [key], [*order, F.col(id_col)], 1).select(key, *(F.col(c).alias(f"_m_{c}") for c, _ in rules), F.col(id_col).alias("best"))
    d = groups.join(best, key, "left").withColumn("_none", F.col("best").isNull())
    return sort_places(d, [("_none", True), *((f"_m_{c}", up) for c, up in rules)], key, name).drop("_none", *(f"_m_{c}" for c, _ in rules))


#: The fields that tracks are sorted by; a field without a value gives way to the title.
TRACK_FIELDS = ("title", "artist", "duration", "release_date")


def sort_tracks(df: DataFrame, field: str, id_col: str, ascending: bool = True, name: str = "place") -> DataFrame:
    """The place of every track by one of TRACK_FIELDS, texts without case, then by title and id."""
    if field not in TRACK_FIELDS:
        raise ValueError(f"tracks are not sorted by {field}")
    low = lambda c: F.lower(c) if dict(df.dtypes)[c] == "string" else F.col(c)
    key = F.coalesce(F.nullif(low(field), F.lit("")), low("title")) if dict(df.dtypes)[field] == "string" else low(field)
    return sort_places(df, [(key, ascending), (low("title"), True)], id_col, name)


def sub_genres(df: DataFrame, genre: str, words: str, table: dict[str, str]) -> DataFrame:
    """bucket, n: rows under each sub-genre that one of their words names; a row of which no word does, under its genre."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    named = F.array_distinct(F.array_compact(F.transform(F.split(F.upper(words), r"\s+"), lambda w: pairs[w])))
    bucket = F.explode(F.when(F.size(named) > 0, named).otherwise(F.array(F.concat(F.lit("Other "), genre))))
    return df.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def paginate(df: DataFrame, page: int, size: int, rules: list[tuple[str, bool]], id_col: str) -> DataFrame:
    """A page with total and page count; a page beyond the last is the first. Sizes are 1 to 500."""
    size = min(max(size, 1), 500)
    total = df.count()
    pages = max(1, -(-total // size))
    page = page if 1 <= page <= pages else 1
    return apply_sort(df, rules, id_col).offset((page - 1) * size).limit(size).withColumns({"total": F.lit(total), "page": F.lit(page), "page_count": F.lit(pages)})


def checkpoint_dir(spark) -> None:
    """spark.checkpoint.dir as the session has it; a temporary folder only where it is unset and all runs on one machine."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or f"{tempfile.gettempdir()}/spark-shelfmark-{uuid.uuid4().hex}")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the checkpoint folder that nothing has."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """df written once as a table in the checkpoint folder and read again: cuts lineage, survives lost executors, and what uses it often does not compute it again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df whose joins are shuffled on both sides unless the other is broadcast by hint.

    Columns that repeat compress so well that a table of few bytes on disk, which Spark would broadcast, is hundreds of
    megabytes in the driver; several such joins at once do not fit it. The hint holds through select, explode and groupBy,
    up to the next join.
    """
    return df.hint("merge")


def sequence_ids(df: DataFrame, order: list, name: str) -> DataFrame:
    """0-based ids in order: a range sort, counts of its partitions, and places within them.

    The ranges are cut by a sample, so that they are written once: to cut them again could give others.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    placed = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    low = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = low.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn("_own", own).join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_part", "_own", "_before")


def chained(rows: DataFrame, keys: list[str], value: str, id_col: str, tolerance: int) -> DataFrame:
    """(a, b): each row with the one before it in order of value, of equal keys, if no more than tolerance apart.

    Rows are dealt by ranges of (keys, value, id), so that a key with any number of rows is spread over many tasks; in
    each the row before is looked up by a window over its own rows alone. The first row of each range is then joined to
    the last of the nearest range before it that has rows: a row for each range, not for each row.
    """
    spark = rows.sparkSession
    n = max(2, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [*keys, value, id_col]
    dealt = written(rows.select(*order).where(" AND ".join(f"{c} IS NOT NULL" for c in order)).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_range").orderBy(*order)
    row = F.struct(*order)
    inside = dealt.withColumn("_before", F.lag(row).over(w))
    ends = dealt.groupBy("_range").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    # one row for each range: a window over them is small, however many rows there are
    seams = ends.withColumn("_before", F.lag("last").over(Window.orderBy("_range"))).select(F.col("first.*"), "_before")
    found = inside.where("_before IS NOT NULL").select(*order, "_before").unionByName(seams.where("_before IS NOT NULL").select(*order, "_before"))
    same = [F.col(k) == F.col(f"_before.{k}") for k in keys]
    near = F.col(value) - F.col(f"_before.{value}") <= tolerance
    for s in same:
        near = near & s
    return found.where(near).select(F.col(id_col).alias("a"), F.col(f"_before.{id_col}").alias("b"))


def set_compare(a: Column, b: Column) -> Column:
    """equal, subset, superset, intersects or disjoint, of two arrays as sets."""
    less, more, both = F.size(F.array_except(a, b)), F.size(F.array_except(b, a)), F.size(F.array_intersect(a, b))
    return F.when((less == 0) & (more == 0), "equal").when(less == 0, "subset").when(more == 0, "superset").when(both > 0, "intersects").otherwise("disjoint")


def dedupe_best(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, key, order, 1)
