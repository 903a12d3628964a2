"""The gallery: all modes and groupings in one pass over their items, details looked up for the shown page alone."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.aggregates import written

# The genres as a tree, each with the bit of its own where it has one.
GENRES = """
Classical 1
Country 2
Dance 4
  Bass
    Color Bass 256
    Future Bass 512
    Kawaii Bass 1024
    Melodic Bass 2048
  Downtempo 4096
  Drum and Bass 8192
  Dubstep
    Brostep 16384
    Chillstep 32768
    Melodic Dubstep 65536
    Riddim 131072
  Glitch Hop 524288
  Hard
    Artcore 1048576
    Future Core 2097152
    Happy Hardcore 4194304
    Hardcore 8388608
    Hardstyle 16777216
    J-Core 33554432
  House
    Ambient House 67108864
    Complextro 134217728
    Electro House 268435456
    Future House 536870912
    Progressive House 1073741824
    Slap House 2147483648
    Tropical House 4294967296
  Lo-fi 17179869184
  Synthwave 274877906944
  Trance 549755813888
  Trap 1099511627776
Hip-hop 8
Instrumental 16
Jazz 8589934592
Pop 32
R&B 64
  Funk 262144
Rock 128
  Alternative 34359738368
  Metal 68719476736
  Soft Rock 137438953472
"""
# Groups of locales with their codes; artist tags with their bits; album types and vocals, numbered from 0.
LOCALES = """
Acoustic 0
Austronesian 256
Chinese 8192 16384 32768
English 2
French 8
Hakka 16
Hindi 32
Japanese 64
Korean 128
Southern Min 512
Spanish 4
Thai 1024
Vietnamese 2048
Yue 4096
Undefined 1
"""
TAGS = {"No Tag": 0, "AI": 1, "Synthesizer": 2, "VTuber": 4}
TYPES = ["Single", "EP", "Album", "Compilation"]
VOCALS = ["Acoustic", "Female", "Male", "Duet", "Unknown"]
MODES = {"albums": ["locale", "type", "year"], "artists": ["locale", "tag"], "songs": ["genre", "locale", "vocal", "year"]}
SIZE = 24
COMPILATION = 2


def _key(label: str) -> str:
    return re.sub(r"[^a-z]+", "-", label.lower().replace("&", " and "))


def tree(outline: str) -> list[dict]:
    """Nodes of an indented outline in its order: key, label, depth, parent, own (numbers of its own)."""
    nodes, above = [], []
    for line in outline.strip("\n").splitlines():
        label, numbers = re.fullmatch(r"\s*(.*?)((?: \d+)*)", line).groups()
        depth = (len(line) - len(line.lstrip())) // 2
        del above[depth:]
        nodes.append({"key": _key(label), "label": label, "depth": depth, "parent": above[-1] if above else None, "own": [int(n) for n in numbers.split()]})
        above.append(nodes[-1]["key"])
    return nodes


def masks(nodes: list[dict]) -> dict[str, int]:
    """Each node's bits with those of all below it: every bit goes to its node and that node's ancestors."""
    parent = {n["key"]: n["parent"] for n in nodes}
    mask = dict.fromkeys(parent, 0)
    for n in nodes:
        at = n["key"]
        while at:
            mask[at] |= sum(n["own"])
            at = parent[at]
    return mask


def catalogue(spark: SparkSession) -> DataFrame:
    """group_by, key, label, depth, place: the fixed groups in their order; years are not among them."""
    numbered = lambda labels: [(str(i), x, 0) for i, x in enumerate(labels)]
    kinds = {g: [(n["key"], n["label"], n["depth"]) for n in tree(o)] for g, o in (("genre", GENRES), ("locale", LOCALES))}
    kinds |= {"tag": [(str(b), x, 0) for x, b in TAGS.items()], "type": numbered(TYPES), "vocal": numbered(VOCALS)}
    rows = [(g, *row, i) for g, found in kinds.items() for i, row in enumerate(found)]
    return spark.createDataFrame(rows, "group_by string, key string, label string, depth int, place int")


def genre_keys(bits: Column) -> Column:
    """The genres of which a row has a bit, and all above them."""
    nodes = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(m).cast("long").alias("mask")) for k, m in masks(tree(GENRES)).items()])
    return F.transform(F.filter(nodes, lambda n: n["mask"].bitwiseAND(bits.cast("long")) != 0), lambda n: n["key"])


def tag_keys(bits: Column) -> Column:
    return F.array_compact(F.array(*[F.when(bits == 0 if b == 0 else bits.bitwiseAND(F.lit(b).cast("long")) != 0, F.lit(str(b))) for b in TAGS.values()]))


def locale_keys(codes: Column) -> Column:
    """The groups of these locale codes, each once; of no codes, or of a code without a group, undefined."""
    group = F.create_map(*[F.lit(x) for n in tree(LOCALES) for c in n["own"] for x in (c, n["key"])])
    codes = F.coalesce(codes.cast("array<int>"), F.array().cast("array<int>"))
    found = F.array_distinct(F.transform(codes, lambda c: F.coalesce(F.when(c.isNotNull(), F.element_at(group, c)), F.lit("undefined"))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("undefined")))


def year_keys(date: Column) -> Column:
    """A dated row is under its decade and its year."""
    decade = (F.floor(F.year(date) / 10) * 10).cast("string")
    return F.when(date.isNull(), F.array(F.lit("unknown"))).otherwise(F.array(F.concat(F.lit("decade:"), decade), F.concat(F.lit("year:"), F.year(date).cast("string"))))


def _keys(group_by: str) -> Column:
    """The keys of a row by one grouping, from the columns that the modes' tables have."""
    if group_by == "genre":
        return genre_keys(F.col("genre_tag"))
    if group_by == "tag":
        return tag_keys(F.col("artist_tag"))
    if group_by == "locale":
        return locale_keys(F.col("locales"))
    if group_by == "year":
        return year_keys(F.col("release_date"))
    return F.array_compact(F.array(F.col("album_type" if group_by == "type" else "vocal").cast("string")))


def _tagged(group_by: str) -> Column:
    return F.transform(_keys(group_by), lambda k: F.struct(F.lit(group_by).alias("group_by"), k.alias("key")))


def memberships(items: dict[str, DataFrame], groupings: dict[str, list[str]] | None = None, where: Column | None = None) -> DataFrame:
    """mode, group_by, key, id, title: every item under every key of every grouping of its mode, each table read once.

    items: of each mode a table of id, title and what its groupings read: locales (array of codes), genre_tag, artist_tag,
    album_type, vocal, release_date. where restricts the items, as a search does.
    """
    groupings = groupings or {m: MODES[m] for m in items}
    parts = []
    for mode, names in groupings.items():
        if mode not in MODES or not set(names) <= set(MODES[mode]):
            raise ValueError(f"invalid gallery mode or grouping: {mode} by {names}")
        each = F.flatten(F.array(*[_tagged(g) for g in names]))
        d = items[mode] if where is None else items[mode].where(where)
        parts.append(d.select(F.lit(mode).alias("mode"), F.col("id").cast("long").alias("id"), "title", F.explode(each).alias("g")).select("mode", "g.*", "id", "title"))
    return reduce(DataFrame.unionByName, parts)


def groups(members: DataFrame) -> DataFrame:
    """mode, group_by, key, label, depth, ordinal, total: groups that have items, in the order shown.

    Fixed groups in the catalogue's order, what is not in it left out; years from the newest decade down, each decade
    before its years, unknown last. Counts are summed before the shuffle; what is left is a row for each group.
    """
    counts = members.groupBy("mode", "group_by", "key").agg(F.count(F.lit(1)).alias("total"))
    # the catalogue has fewer than a hundred rows
    d = counts.join(F.broadcast(catalogue(members.sparkSession)), ["group_by", "key"], "left").where("label IS NOT NULL OR group_by = 'year'")
    kind, number = F.substring_index("key", ":", 1), F.try_element_at(F.split("key", ":"), F.lit(2)).cast("int")
    label = F.coalesce("label", F.when(kind == "decade", F.concat(number, F.lit("s"))).when(kind == "year", number.cast("string")).otherwise("Unknown"))
    depth = F.coalesce("depth", (kind == "year").cast("int"))
    order = [F.coalesce("place", F.lit(0)), (F.floor(number / 10) * 10).desc_nulls_last(), (kind == "decade").desc(), number.desc_nulls_last()]
    return d.select("mode", "group_by", "key", label.alias("label"), depth.alias("depth"), F.row_number().over(Window.partitionBy("mode", "group_by").orderBy(*order)).alias("ordinal"), "total")


def pages(members: DataFrame, page: int = 1, size: int = SIZE) -> DataFrame:
    """groups with the rows of one page of each: page, position, id, title. A group without that page shows its first.

    The rows up to the page's end are kept in each task before the shuffle, so a group may hold any share of all rows.
    """
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    order = [F.lower("title").asc_nulls_last(), F.col("id")]
    top = members.withColumn("position", F.row_number().over(Window.partitionBy("mode", "group_by", "key").orderBy(*order))).where(F.col("position") <= page * size)
    d = top.join(groups(members), ["mode", "group_by", "key"])
    at = F.when(F.ceil(F.col("total") / size) >= page, page).otherwise(1)
    return d.withColumn("page", at).where(F.col("position").between((F.col("page") - 1) * size + 1, F.col("page") * size))


def _names(shown: DataFrame, mode: str, links: DataFrame, artists: DataFrame) -> DataFrame:
    """mode, id, artists: the names of a shown item's artists, in order, joined."""
    ids = shown.where(F.col("mode") == mode).select("id").distinct()
    d = links.join(F.broadcast(ids), "id", "left_semi").join(artists.select(F.col("id").alias("artist_id"), F.col("title").alias("name")), "artist_id")
    ordered = F.array_sort(F.collect_list(F.struct("display_order", "artist_id", "name")))
    return d.where("name IS NOT NULL").groupBy("id").agg(F.array_join(ordered["name"], ", ").alias("artists")).select(F.lit(mode).alias("mode"), "id", "artists")


def gallery(items: dict[str, DataFrame], album_artists: DataFrame, song_artists: DataFrame, tracks: DataFrame, page: int = 1, size: int = SIZE, where: Column | None = None) -> DataFrame:
    """pages of all modes and groupings with artwork, artists, year, album_count and track_count.

    A song's artwork is that of its albums' first that has some, compilations (COMPILATION) before others, then by id.
    Years are of albums and songs, counts of artists. Links: id, artist_id, display_order; tracks: album_id, song_id.
    What is shown (a page of each of the fixed groups and of the years) is written once; only its ids meet the links and
    tracks, broadcast, as they are at most size times the groups; by a semi join, which Spark moves below the aggregates
    that links and tracks are made by, so that only rows of what is shown are summed up.
    """
    shown = written(pages(memberships(items, where=where), page, size), "shown")
    ids = {m: shown.where(F.col("mode") == m).select("id").distinct() for m in MODES}
    albums, artists, songs = (items[m] for m in MODES)
    own = [items[m].join(F.broadcast(ids[m]), "id").select(F.lit(m).alias("mode"), "id", F.col("artwork") if m != "songs" else F.lit(None).cast("string").alias("artwork"), F.year("release_date").alias("year") if m != "artists" else F.lit(None).cast("int").alias("year")) for m in MODES]
    art = albums.where("artwork <> ''").select(F.col("id").alias("album_id"), "artwork", (F.col("album_type") == COMPILATION).alias("whole"))
    covers = tracks.select("album_id", F.col("song_id").alias("id")).join(F.broadcast(ids["songs"]), "id", "left_semi").join(art, "album_id").groupBy("id").agg(F.min_by("artwork", F.struct(~F.coalesce("whole", F.lit(False)), F.col("album_id"))).alias("cover"))
    count = lambda links, name: links.join(F.broadcast(ids["artists"].withColumnRenamed("id", "artist_id")), "artist_id", "left_semi").groupBy("artist_id").agg(F.count_distinct("id").alias(name)).select(F.col("artist_id").alias("id"), name)
    named = _names(shown, "albums", album_artists, artists).unionByName(_names(shown, "songs", song_artists, artists))
    on = lambda df, mode: df.withColumn("mode", F.lit(mode))
    d = shown.join(reduce(DataFrame.unionByName, own), ["mode", "id"], "left").join(named, ["mode", "id"], "left")
    d = d.join(on(covers, "songs"), ["mode", "id"], "left")
    for links, name in ((album_artists, "album_count"), (song_artists, "track_count")):
        d = d.join(on(count(links, name), "artists"), ["mode", "id"], "left").withColumn(name, F.when(F.col("mode") == "artists", F.coalesce(name, F.lit(0))))
    return d.select("mode", "group_by", "key", "label", "depth", "ordinal", "total", "page", "position", "id", "title", F.coalesce("cover", "artwork").alias("artwork"), "artists", "year", "album_count", "track_count")
