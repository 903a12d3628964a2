"""Disagreements of contents of one code, counted without making their pairs.

Contents (kinds): id, code, title, ms, who (sorted array of artists), first (the least entry), n (the number of entries).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.aggregates import spread

#: Sets of at most this many artists are counted by their subsets; larger ones are joined by artist.
SUBSETS = 6


def _total(df: DataFrame) -> DataFrame:
    return df.groupBy("code").agg(F.sum("n").alias("total"))


def title_partners(kinds: DataFrame) -> DataFrame:
    """code, title_key, title_partners (entries of other titles), title_other (the least of them). Rows without a title have none."""
    t = kinds.where("title_key IS NOT NULL").groupBy("code", "title_key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    least = t.groupBy("code").agg(F.sum("n").alias("total"), F.min(F.struct("first", "title_key")).alias("least"))
    d = t.join(least, "code")
    own = F.col("title_key") == F.col("least.title_key")
    second = d.where(~own).groupBy("code").agg(F.min("first").alias("second"))
    return d.join(spread(second), "code", "left").select("code", "title_key", (F.col("total") - F.col("n")).alias("title_partners"), F.when(own, F.col("second")).otherwise(F.col("least.first")).alias("title_other"))


def length_partners(kinds: DataFrame, tolerance: int) -> DataFrame:
    """code, ms, duration_partners (entries further off than the tolerance), duration_other (of the shortest, else of the longest, if that far).

    What is near is summed over a sweep of the different lengths, each dealt to its bucket and both neighbours, so that
    a task's window holds three buckets of lengths at most, whatever the size of the code.
    """
    bucket = F.floor(F.col("ms") / (tolerance + 1))
    m = kinds.where("ms IS NOT NULL").groupBy("code", "ms").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    dealt = m.withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    w = Window.partitionBy("code", "bucket").orderBy("ms").rangeBetween(-tolerance, tolerance)
    near = dealt.withColumn("near", F.sum("n").over(w)).where(F.col("bucket") == bucket)
    ends = m.groupBy("code").agg(F.sum("n").alias("total"), F.min(F.struct("ms", "first")).alias("short"), F.min(F.struct((-F.col("ms")).alias("ms"), "first")).alias("long"))
    other = F.when(F.col("ms") - F.col("short.ms") > tolerance, F.col("short.first")).when(-F.col("long.ms") - F.col("ms") > tolerance, F.col("long.first"))
    return near.join(ends, "code").select("code", "ms", (F.col("total") - F.col("near")).alias("duration_partners"), other.alias("duration_other"))


def _subsets(items: Column) -> Column:
    """Every non-empty subset of a short sorted array, each sorted."""
    last = F.call_function("shiftleft", F.lit(1), F.size(items)) - 1
    return F.transform(F.sequence(F.lit(1), last), lambda mask: F.filter(items, lambda _, i: F.getbit(mask, i) == 1))


def artist_partners(kinds: DataFrame) -> DataFrame:
    """code, set_key, artist_partners: entries with artists of which none is among this set's.

    Entries that share some artist with a set are counted by inclusion and exclusion: over its subsets, those that hold
    all of it, odd ones added and even ones taken off. Sets of more than SUBSETS artists meet the others by a join on
    artist instead, counted once for each two sets. Without artists, or with an unknown one, nothing is apart.
    """
    known = (F.size("who") > 0) & ~F.exists("who", lambda x: x.isNull())
    sets = kinds.where(known).groupBy("code", "set_key").agg(F.sum("n").alias("n"), F.first("who").alias("who"))
    parts = sets.where(F.size("who") <= SUBSETS).select("code", "set_key", "n", F.explode(_subsets(F.col("who"))).alias("part"))
    holding = parts.groupBy("code", "part").agg(F.sum("n").alias("held"))
    sign = F.when(F.size("part") % 2 == 1, 1).otherwise(-1)
    shared = parts.join(holding, ["code", "part"]).select("code", "set_key", (sign * F.col("held")).alias("shared"))
    each = sets.select("code", "set_key", "n", (F.size("who") > SUBSETS).alias("large"), F.explode("who").alias("artist"))
    one = each.where("large").select("code", "artist", F.col("set_key").alias("one_key"), F.col("n").alias("one_n"))
    met = one.join(each, ["code", "artist"]).select("code", "one_key", "one_n", "set_key", "n", "large").distinct()
    # a large set counts all that it meets; a small one has counted small ones above
    there = met.select("code", F.col("one_key").alias("set_key"), F.col("n").alias("shared"))
    back = met.where("NOT large").select("code", "set_key", F.col("one_n").alias("shared"))
    found = shared.unionByName(there).unionByName(back).groupBy("code", "set_key").agg(F.sum("shared").alias("shared"))
    return found.join(_total(sets), "code").select("code", "set_key", (F.col("total") - F.col("shared")).alias("artist_partners"))


def count_conflicts(kinds: DataFrame, tolerance: int) -> DataFrame:
    """Each content with the numbers of entries that disagree with it, and one of them by title and by length."""
    d = kinds.select("id", "code", "ms", "who", "first", "n", F.md5(F.encode("title", "utf-8")).alias("title_key"), F.md5(F.to_json("who")).alias("set_key"))
    d = spread(d)
    none = F.lit(0).cast("long")
    out = d.join(title_partners(d), ["code", "title_key"], "left").join(spread(length_partners(d, tolerance)), ["code", "ms"], "left").join(spread(artist_partners(d)), ["code", "set_key"], "left")
    numbers = [F.coalesce(c, none).alias(c) for c in ("title_partners", "duration_partners", "artist_partners")]
    return out.select(F.col("first").alias("entry_id"), "code", F.col("n").alias("members"), *numbers, "title_other", "duration_other")
