"""Merging entities: one plan for many merges at once, its preview, and its application.

Tables by name, each with the columns named here and any others:
artists(artist_id), codes(artist_id, authority, code), titles(artist_id, locale, fallback, title, normalized),
aliases(artist_id, alias, normalized), relations(artist_id, ref_artist_id, relation),
album_artists(album_id, display_order, artist_id), song_artists(song_id, display_order, artist_id, display_title).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.aggregates import top_k, written


def close_targets(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((source, target) with each target the end of its chain, (source, error)).

    Pointer doubling: in each round a target that is itself a source gives way to that source's target, so that a chain
    of n merges takes log2(n) rounds of one join. What still points at a source when no chain can be left is part of
    a cycle or leads into one. A source with several targets, or merged into itself, is an error; so is all that
    leads to it.
    """
    t = targets.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct()
    n = t.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target"))
    one = written(n.select("source", "target", F.when(F.col("n") > 1, "several targets").when(F.col("source") == F.col("target"), "merged into itself").alias("error")), "targets")
    rounds = max(1, one.count()).bit_length() + 1
    for _ in range(rounds):
        step = one.select(F.col("source").alias("target"), F.col("target").alias("next"), F.col("error").alias("why"))
        d = one.join(step, "target", "left").select("source", F.when(F.col("error").isNull(), F.coalesce("next", "target")).otherwise(F.col("target")).alias("target"), F.coalesce("error", "why").alias("error"), (F.col("next").isNotNull() & F.col("error").isNull()).alias("moved"))
        one = written(d, "targets")
        if not one.where("moved").take(1):
            break
    ends = one.select(F.col("source").alias("target"), F.lit(True).alias("onward"))
    d = one.drop("moved").join(ends, "target", "left").select("source", "target", F.coalesce("error", F.when(F.col("onward"), "cycle")).alias("error"))
    return d.where("error IS NULL").select("source", "target"), d.where("error IS NOT NULL").select("source", "error")


def _valid_targets(artists: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    closed, errors = close_targets(targets)
    have = artists.select("artist_id").distinct()
    d = closed.join(have.select(F.col("artist_id").alias("source"), F.lit(True).alias("_s")), "source", "left").join(have.select(F.col("artist_id").alias("target"), F.lit(True).alias("_t")), "target", "left")
    d = d.select("source", "target", F.when(F.col("_s").isNull(), "source not found").when(F.col("_t").isNull(), "target not found").alias("error"))
    return d.where("error IS NULL").select("source", "target"), errors.unionByName(d.where("error IS NOT NULL").select("source", "error"))


def fallback_titles(titles: DataFrame) -> DataFrame:
    """artist_id, name: the fallback title, else the one of the least locale."""
    return top_k(titles, ["artist_id"], [F.desc("fallback"), F.col("locale"), F.col("title")], 1).select("artist_id", F.col("title").alias("name"))


def _moves(df: DataFrame, closed: DataFrame) -> DataFrame:
    return df.join(closed.withColumnRenamed("source", "artist_id"), "artist_id").withColumnRenamed("artist_id", "source")


def code_moves(codes: DataFrame, closed: DataFrame) -> DataFrame:
    """source, target, authority, code, action.

    A code moves to the target unless the target or a smaller source of it has the code (skip-duplicate), or an artist
    that is no part of this merge has it (skip-owned).
    """
    key = ["authority", "code"]
    to = codes.join(closed.withColumnRenamed("source", "artist_id"), "artist_id", "left")
    own = F.coalesce("target", "artist_id")
    stay = F.col("target").isNull()
    # one row for each code and artist that has it in the end; a frequent code is summed up before it is joined
    ends = to.groupBy(*key, own.alias("target")).agg(F.min(F.when(~stay, F.col("artist_id"))).alias("first"), F.max(stay).alias("had"))
    kept = ends.where("had").groupBy(*key).agg(F.min("target").alias("low"), F.max("target").alias("high"))
    d = to.where("target IS NOT NULL").join(ends, [*key, "target"]).join(kept, key, "left")
    other = F.coalesce((F.col("low") != F.col("target")) | (F.col("high") != F.col("target")), F.lit(False))
    action = F.when(F.col("had") | (F.col("artist_id") != F.col("first")), "skip-duplicate").when(other, "skip-owned").otherwise("move")
    return d.select(F.col("artist_id").alias("source"), "target", *key, action.alias("action")).distinct()


def name_moves(titles: DataFrame, aliases: DataFrame, closed: DataFrame) -> DataFrame:
    """source, target, kind, alias, normalized, action: names of sources become aliases if their normalised form is new.

    Titles come before aliases; of equal forms the first of the smallest source is added.
    """
    t = titles.select("artist_id", F.lit("title").alias("kind"), F.struct((~F.col("fallback")).cast("int").alias("a"), F.col("locale").cast("string").alias("b")).alias("at"), F.trim("title").alias("alias"), "normalized")
    a = aliases.select("artist_id", F.lit("alias").alias("kind"), F.struct(F.lit(2).alias("a"), F.col("alias").alias("b")).alias("at"), F.trim("alias").alias("alias"), "normalized")
    both = t.unionByName(a)
    have = both.join(closed.select(F.col("target").alias("artist_id")).distinct(), "artist_id", "left_semi").select(F.col("artist_id").alias("target"), "normalized", F.lit(True).alias("had")).distinct()
    d = _moves(both, closed).join(have, ["target", "normalized"], "left")
    place = F.row_number().over(Window.partitionBy("target", "normalized").orderBy("source", "at", "alias"))
    blank = F.coalesce(F.col("alias") == "", F.lit(True))
    return d.withColumn("place", place).select("source", "target", "kind", "alias", "normalized", F.when(blank | F.col("had") | (F.col("place") > 1), "skip-duplicate").otherwise("add").alias("action"))


def relation_moves(relations: DataFrame, closed: DataFrame) -> DataFrame:
    """Relations that touch a source: artist_id, ref_artist_id, relation, new_artist_id, new_ref_artist_id, action.

    Both ends go to their targets. A relation to itself, or equal to one that is there or moves before it, is deleted.
    """
    one = closed.select(F.col("source").alias("artist_id"), F.col("target").alias("_a"))
    two = closed.select(F.col("source").alias("ref_artist_id"), F.col("target").alias("_b"))
    d = relations.select("artist_id", "ref_artist_id", "relation").distinct().join(one, "artist_id", "left").join(two, "ref_artist_id", "left")
    d = d.withColumns({"new_artist_id": F.coalesce("_a", "artist_id"), "new_ref_artist_id": F.coalesce("_b", "ref_artist_id"), "touched": F.col("_a").isNotNull() | F.col("_b").isNotNull()})
    place = F.row_number().over(Window.partitionBy("new_artist_id", "new_ref_artist_id", "relation").orderBy("touched", "artist_id", "ref_artist_id"))
    action = F.when((F.col("new_artist_id") == F.col("new_ref_artist_id")) | (F.col("place") > 1), "delete").otherwise("update")
    return d.withColumns({"place": place, "action": action}).where("touched").select("artist_id", "ref_artist_id", "relation", "new_artist_id", "new_ref_artist_id", "action")


def merge_plan(tables: dict[str, DataFrame], targets: DataFrame) -> dict[str, DataFrame]:
    """What merging each source into the end of its chain of targets does to every table.

    errors(source, error), closed(source, target), codes, names, relations as their moves say; album_artists and
    song_artists: the links that move, a song's with the display name of its own source, as it was credited.
    """
    closed, errors = _valid_targets(tables["artists"], targets)
    closed = written(closed, "closed")
    names = fallback_titles(tables["titles"]).select(F.col("artist_id").alias("source"), F.col("name").alias("new_display_title"))
    return {
        "errors": errors,
        "closed": closed,
        "codes": written(code_moves(tables["codes"], closed), "codes"),
        "names": written(name_moves(tables["titles"], tables["aliases"], closed), "names"),
        "relations": written(relation_moves(tables["relations"], closed), "relations"),
        "album_artists": _moves(tables["album_artists"], closed).select("source", "target", "album_id", "display_order"),
        "song_artists": _moves(tables["song_artists"], closed).join(names, "source", "left").select("source", "target", "song_id", "display_order", "display_title", "new_display_title"),
    }


def merge_counts(plan: dict[str, DataFrame]) -> DataFrame:
    """source, part, action, n: what the plan does, counted; no table is changed."""
    one = lambda part, source, action: plan[part].groupBy(source.alias("source"), action.alias("action")).agg(F.count(F.lit(1)).alias("n")).select("source", F.lit(part).alias("part"), "action", "n")
    ids = plan["closed"].select("source", F.lit(1).alias("_in"))
    r = plan["relations"].join(ids.withColumnRenamed("source", "artist_id"), "artist_id", "left")
    counted = {"relations": F.when(F.col("_in").isNotNull(), F.col("artist_id")).otherwise(F.col("ref_artist_id"))}
    plan = {**plan, "relations": r}
    parts = [one(p, counted.get(p, F.col("source")), F.col("action") if p in ("codes", "names", "relations") else F.lit("move")) for p in ("codes", "names", "relations", "album_artists", "song_artists")]
    return reduce(DataFrame.unionByName, parts)


def apply_merge(tables: dict[str, DataFrame], plan: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after the plan; sources are gone. Other columns of kept rows stay, those of added rows are null."""
    gone = plan["closed"].select(F.col("source").alias("artist_id"))
    out = {k: tables[k].join(gone, "artist_id", "left_anti").select(*tables[k].columns) for k in ("artists", "codes", "titles", "aliases")}
    out["codes"] = out["codes"].unionByName(plan["codes"].where("action = 'move'").select(F.col("target").alias("artist_id"), "authority", "code"), allowMissingColumns=True)
    out["aliases"] = out["aliases"].unionByName(plan["names"].where("action = 'add'").select(F.col("target").alias("artist_id"), "alias", "normalized"), allowMissingColumns=True)
    key = ["artist_id", "ref_artist_id", "relation"]
    moved = plan["relations"].where("action = 'update'")
    rest = tables["relations"].join(plan["relations"].select(*key), key, "left_anti").select(*tables["relations"].columns)
    out["relations"] = rest.unionByName(moved.select(F.col("new_artist_id").alias("artist_id"), F.col("new_ref_artist_id").alias("ref_artist_id"), "relation"), allowMissingColumns=True)
    for part, owner in (("album_artists", "album_id"), ("song_artists", "song_id")):
        keys = [owner, "display_order"]
        new = plan[part].select(*keys, F.col("source").alias("artist_id"), F.col("target").alias("_target"), *(["new_display_title"] if part == "song_artists" else [])).distinct()
        d = tables[part].join(new, [*keys, "artist_id"], "left")
        changed: dict[str, Column] = {"artist_id": F.coalesce("_target", "artist_id")}
        if part == "song_artists":
            changed["display_title"] = F.when(F.col("_target").isNotNull(), F.col("new_display_title")).otherwise(F.col("display_title"))
        out[part] = d.select(*[changed.get(c, F.col(c)).alias(c) for c in tables[part].columns])
    return out
