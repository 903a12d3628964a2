"""Readers and writers of catalogue files. Violations are rows, not exceptions."""

from __future__ import annotations

import plistlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOC = "struct<en:string,fr:string,ja:string,ko:string,zs:string,zt:string>"
CATALOGUE = f"""source string, time string, artists array<struct<id:string,title:{LOC},artwork:string>>,
albums array<struct<id:string,title:{LOC},artistID:array<string>,artwork:string,compilation:boolean,discCount:int,releaseDate:string,trackCount:map<string,int>>>,
songs array<struct<id:string,title:{LOC},audio:string,albumID:string,artistID:array<string>,discNumber:int,duration:int,isrc:string,locale:string,releaseDate:string,trackNumber:int>>, _corrupt string"""


def read_catalogue(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """artists, albums, songs with their place in the document, special artist names, and violations of required fields."""
    doc = spark.read.schema(CATALOGUE).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    part = lambda n: doc.select(F.posexplode(n).alias("pos", "r")).select("pos", "r.*")
    artists, albums, songs = part("artists"), part("albums"), part("songs")
    need = {"artists": (artists, ["id", "title"]), "albums": (albums, ["id", "title", "artistID"]), "songs": (songs, ["id", "title", "artistID", "duration"])}
    bad = [df.select(F.lit(n).alias("table"), "pos", F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]))).alias("field")) for n, (df, cols) in need.items()]
    corrupt = doc.where("_corrupt IS NOT NULL").select(F.lit("document").alias("table"), F.coalesce(F.size("songs"), F.lit(-1)).alias("pos"), F.lit("json").alias("field"))
    special = artists.where(F.col("title.en").rlike("[&,]")).select(F.col("title.en").alias("name"))
    return {"artists": artists, "albums": albums, "songs": songs, "special_names": special, "violations": bad[0].union(bad[1]).union(bad[2]).union(corrupt)}


def extract_entries(songs: DataFrame, albums: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (song with its album's title, and album artists before song artists, each once) and dangling album references."""
    a = albums.select(F.col("id").alias("albumID"), F.col("title").alias("album_title"), F.col("artistID").alias("album_artists"))
    d = songs.join(a, "albumID", "left")
    entries = d.select(F.col("id").alias("source_item_id"), "title", "album_title", F.array_distinct(F.concat(F.coalesce("album_artists", F.array().cast("array<string>")), "artistID")).alias("artists"), "duration", F.to_json(F.struct("id", "title", "albumID", "artistID", "duration")).alias("raw_json"))
    return entries, d.where("albumID IS NOT NULL AND album_title IS NULL").select(F.col("id").alias("source_item_id"), F.concat(F.lit("$.songs["), "pos", F.lit("].albumID")).alias("path"))


def register_source(sources: DataFrame, files: DataFrame) -> DataFrame:
    """New files with the next source ids in order of name; registered ones are skipped."""
    new = files.select("source_file").distinct().join(sources.select("source_file"), "source_file", "left_anti")
    from ..operators.aggregates import sequence_ids

    top = sources.agg(F.coalesce(F.max("source_id"), F.lit(0))).first()[0]
    return sequence_ids(new, ["source_file"], "_k").select((F.lit(top + 1) + F.col("_k")).cast("long").alias("source_id"), "source_file")


def read_edited(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Edited songs: genre names to a mask, titles; violations where not exactly one title is the fallback."""
    from ..functions.codecs import GENRES, encode_flags

    d = spark.read.schema("id long, genre string, titles array<struct<locale:string,title:string,fallback:boolean>>").option("multiLine", True).json(path)
    n = F.size(F.filter("titles", lambda t: F.coalesce(t["fallback"], F.lit(False))))
    rules = F.array_compact(F.array(F.when(F.coalesce(F.col("id"), F.lit(0)) <= 0, F.lit("id")), F.when(F.coalesce(F.size("titles"), F.lit(0)) < 1, F.lit("titles")), F.when(n != 1, F.lit("fallback"))))
    return {"songs": d.select("id", encode_flags(F.col("genre"), {g: 1 << i for i, g in enumerate(GENRES)}).alias("genre_tag")), "titles": d.select("id", F.explode("titles").alias("t")).select("id", "t.*"), "violations": d.select("id", F.explode(rules).alias("rule"))}


def read_plist(spark: SparkSession, path: str, playlists: tuple[str, ...] = ("Library",)) -> DataFrame:
    """Tracks of the named playlists of property-list files, one file a row of work."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                doc = plistlib.loads(content)
                keep = {i["Track ID"] for p in doc.get("Playlists", []) if p.get("Name") in playlists or p.get("Master") for i in p.get("Playlist Items", [])}
                rows = [(t["Track ID"], t.get("Name"), t.get("Artist"), t.get("Total Time"), t.get("Play Count", 0), f"{t.get('Year', 1):04d}-01-01") for t in doc.get("Tracks", {}).values() if t["Track ID"] in keep]
                yield pd.DataFrame(rows, columns=["track_id", "name", "artist", "duration", "play_count", "release_date"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "track_id long, name string, artist string, duration long, play_count long, release_date string")


def in_playlist(songs: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """A flag whether the row's id is in the playlist."""
    ids = items.select(key).distinct().withColumn("_in", F.lit(True))
    return songs.join(ids, key, "left").withColumn("in_playlist", F.col("_in").isNotNull()).drop("_in")


def read_legacy_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed CSV: empty is null, a bad value fails; the row is kept as JSON."""
    d = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("nullValue", "").csv(path)
    return d.withColumn("row_json", F.to_json(F.struct(*d.columns)))


def read_artist_map(spark: SparkSession, path: str) -> DataFrame:
    """One artist for each key of a JSON object: native title first, else the English one."""
    kind = "map<string,struct<us:string,tw:string,or:string,locale:string,alias:array<string>,thumb:string,ai:boolean,synth:boolean>>"
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("apple_id", "a"))
    return d.select("apple_id", F.coalesce("a.or", "a.us", "a.tw").alias("title"), "a.locale", F.coalesce("a.alias", F.array().cast("array<string>")).alias("alias"), (F.when(F.col("a.ai"), 1).otherwise(0) + F.when(F.col("a.synth"), 2).otherwise(0)).alias("tag"))


def extract_payload(payloads: DataFrame) -> DataFrame:
    """Songs that a payload's data names, with attributes from its resources; malformed payloads yield nothing."""
    kind = "struct<data:array<struct<id:string,type:string>>,resources:struct<songs:map<string,struct<attributes:struct<name:string,durationInMillis:long,isrc:string>>>>>"
    j = payloads.select(F.from_json("payload", kind).alias("j"))
    named = j.select(F.explode("j.data").alias("d"), F.col("j.resources.songs").alias("songs")).where("d.type = 'songs'")
    return named.select(F.col("d.id").alias("id"), F.try_element_at("songs", F.col("d.id")).alias("s")).where("s IS NOT NULL").select("id", F.col("s.attributes.name").alias("name"), F.col("s.attributes.durationInMillis").alias("duration"), F.col("s.attributes.isrc").alias("isrc")).distinct()


def extract_embedded_json(pages: DataFrame, script_id: str = "serialized-server-data") -> DataFrame:
    """Track items of JSON blocks in pages: page_id, item id, title; only complete ones."""
    block = F.explode(F.regexp_extract_all("html", F.lit(rf'(?s)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>'), F.lit(1)))
    kind = "array<struct<data:struct<sections:array<struct<id:string,items:array<struct<id:string,title:string>>>>>>>"
    d = pages.select("page_id", block.alias("b")).select("page_id", F.explode(F.from_json("b", kind)).alias("x")).select("page_id", F.explode("x.data.sections").alias("s"))
    return d.where("s.id LIKE 'track-list - %'").select("page_id", F.explode("s.items").alias("i")).where("i.id LIKE 'track-lockup - %' AND i.title IS NOT NULL").select("page_id", "i.id", "i.title")


def links(pages: DataFrame) -> DataFrame:
    """Anchors of pages: page_id and target."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("href"))


def enrich(base: DataFrame, lookups: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """Columns of the last lookup overwrite the base's; unknown keys are ignored."""
    last = lookups.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(order, *cols)).alias("_l"))
    out = base.join(last, key, "left")
    return out.select(*[F.when(F.col("_l").isNotNull(), F.col(f"_l.{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in base.columns])


def merge_localized(df: DataFrame, key: str, order: str, slots: list[str]) -> DataFrame:
    """Each slot's first defined value in order; later ones never overwrite it."""
    return df.groupBy(key).agg(*[F.min_by(s, F.when(F.col(s).isNotNull(), F.col(order))).alias(s) for s in slots])


def disc_counts(tracks: DataFrame, album: str, disc: str) -> DataFrame:
    """Track counts of each disc but 0 as a map, and the number of discs."""
    n = tracks.where(F.col(disc) != 0).groupBy(album, disc).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(album).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(disc, "n")))).alias("track_count"), F.count(F.lit(1)).alias("disc_count"))


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Sorted, with a sequential legacy_id."""
    from ..operators.aggregates import sequence_ids

    sequence_ids(df, order, "legacy_id").orderBy("legacy_id").write.mode("errorifexists").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def read_first_existing(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first path that exists, through Spark's own file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return read_legacy_csv(spark, p, schema)
    raise FileNotFoundError(f"none of {paths}")


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def fan_out(docs: DataFrame) -> dict[str, DataFrame]:
    """Nested owner documents (owner_id, children array of structs) to an owner table and a child table with positions."""
    return {"owners": docs.select("owner_id", F.size("children").alias("n_children")), "children": docs.select("owner_id", F.posexplode("children").alias("position", "c")).select("owner_id", "position", "c.*")}
