"""Denormalised views: each child table is aggregated once, then joined to its parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import ordered_array, top_k
from ..operators.joins import nest


def with_title(owners: DataFrame, titles: DataFrame, key: str, order: list[Column], name: str = "title") -> DataFrame:
    """Owners with the title that this order puts first; nulls where none."""
    best = top_k(titles, [key], order, 1).select(key, F.col("title").alias(name))
    return owners.join(best, key, "left")


def with_array(owners: DataFrame, child: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """Owners with an ordered array of a child's values; null where none."""
    return owners.join(child.groupBy(key).agg(ordered_array(order, value).alias(name)), key, "left")


def with_counts(owners: DataFrame, child: DataFrame, key: str, name: str = "n") -> DataFrame:
    n = child.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return owners.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def album_overview(albums: DataFrame, titles: DataFrame, artists: DataFrame, tracks: DataFrame, key: str, title_order: list[Column]) -> DataFrame:
    """Title pick, artists in order, tracks."""
    d = with_title(albums, titles, key, title_order)
    return with_counts(with_array(d, artists, key, ["display_order", "artist"], "artist", "artists"), tracks, key, "tracks")


def artist_overview(artists: DataFrame, titles: DataFrame, aliases: DataFrame, codes: DataFrame, key: str, title_order: list[Column]) -> DataFrame:
    """Title pick, aliases in order, codes joined."""
    d = with_array(with_title(artists, titles, key, title_order), aliases, key, ["alias"], "alias", "aliases")
    return d.join(codes.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes")), key, "left")


def song_overview(songs: DataFrame, artists: DataFrame, releases: DataFrame, codes: DataFrame, release_order: list[Column]) -> DataFrame:
    """Artists in order, the best release, codes joined."""
    d = with_array(songs, artists, "song_id", ["display_order", "artist_id"], "artist_id", "artists")
    best = top_k(releases, ["song_id"], release_order, 1).select("song_id", "release_id")
    return d.join(best, "song_id", "left").join(codes.groupBy("song_id").agg(F.array_join(F.array_sort(F.collect_set("authority_code")), ",").alias("codes")), "song_id", "left")


def entry_overview(entries: DataFrame, mappings: DataFrame, members: DataFrame, order: list[Column]) -> DataFrame:
    """Entries with their best mapping and least group."""
    best = top_k(mappings, ["entry_id"], order, 1)
    return entries.join(best, "entry_id", "left").join(members.groupBy("entry_id").agg(F.min("group_id").alias("group_id")), "entry_id", "left")


RESOURCES = ("albums", "artists", "songs", "entries", "sources", "mappings", "entry-groups", "issues", "history")


def resource(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """The base relation of a resource by name."""
    if name not in RESOURCES:
        raise ValueError(f"unknown resource {name}")
    return tables[name]


def hydrate_song(df: DataFrame, id_col: str, songs: DataFrame) -> DataFrame:
    """Any table with a song id gets the song's pre-aggregated fields."""
    s = songs.select(F.col("song_id").alias(id_col), *[F.col(c).alias(f"song_{c}") for c in songs.columns if c != "song_id"])
    return df.join(s, id_col, "left")


def hydrate_group(groups: DataFrame, members: DataFrame, issues: DataFrame) -> DataFrame:
    return nest(nest(groups, members, "group_id", ["entry_id"], ["entry_id"], "entries"), issues, "group_id", ["issue_id"], ["issue_id"], "issues")


def detail_docs(owners: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """Nested documents of all owners at once: name -> (child table, order, fields)."""
    for name, (child, order, fields) in children.items():
        owners = nest(owners, child, key, order, fields, name)
    return owners


def gallery(df: DataFrame, categories: Column, id_col: str, title: str, page: int = 1, size: int = 24) -> DataFrame:
    """Rows under each of their categories: the category's total and one page of it."""
    from ..operators.aggregates import top_page

    d = df.withColumn("category", F.explode(categories))
    n = d.groupBy("category").agg(F.count(F.lit(1)).alias("total"))
    return top_page(d, ["category"], [F.lower(title).asc_nulls_last(), F.col(id_col)], page, size).join(n, "category")


def issue_view(issues: DataFrame, mappings: DataFrame, songs: DataFrame) -> DataFrame:
    """Issues with the song they name, or else the one their entry is mapped to."""
    d = issues.join(mappings.select("entry_id", F.col("song_id").alias("_mapped")), "entry_id", "left")
    return hydrate_song(d.withColumn("song_id", F.coalesce("song_id", "_mapped")).drop("_mapped"), "song_id", songs)


def export_docs(docs: DataFrame) -> DataFrame:
    """Documents as JSON text, nulls kept."""
    return docs.select(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}).alias("document"))


def source_detail(sources: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    return with_counts(sources, entries, key, "imported")
