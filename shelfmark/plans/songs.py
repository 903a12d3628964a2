"""Songs from groups of entries: who claims what, the plan of each song, and its creation or merge.

entries: group_id, entry_id, duration, release_date (text), audio; of each entry titles(entry_id, locale, title),
codes(entry_id, authority, code), artists(entry_id, position, code) and albums(entry_id, code, disc, track,
track_count). The catalogue: groups(group_id, song_id, null where none), songs(song_id, duration, release_date, audio),
song_titles(song_id, locale, title, fallback), song_locales(song_id, locale, is_primary), song_codes(song_id, authority,
code), song_artists(song_id, artist_id, display_order), album_tracks(album_id, disc, track, song_id),
track_counts(album_id, disc, track_count), mappings(entry_id, song_id, method, confidence, status),
artist_codes(code, artist_id), album_codes(code, album_id). An entry is in one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs as C
from ..operators.aggregates import earliest_date, representative, sequence_ids, spread, top_k, written
from .changes import insert_if_absent
from .matching import components

#: The locales of undetermined and English titles.
UND = 1
EN = 2


def settle_claims(groups: DataFrame, codes: DataFrame, owned: DataFrame) -> DataFrame:
    """group_id, unit_id, song_id, several: groups that claim one code or one song, directly or by others, are one unit.

    groups: group_id, song_id. codes: group_id, authority, code. owned: authority, code, song_id. A unit is named by
    its least group; its song is the one that a member has or that owns a code of a member, null where none
    does; several is true where there is more than one. Groups, codes and songs are the nodes of one graph,
    with an edge for each claim, so that a code which many groups claim is a star and not all pairs of them.
    """
    g = F.concat(F.lit("g"), "group_id")
    c = F.concat_ws("|", F.lit("c"), "authority", "code")
    s = F.concat(F.lit("s"), "song_id")
    codes = codes.where("code IS NOT NULL").select("group_id", "authority", "code").distinct()
    claimed = owned.join(codes.select("authority", "code").distinct(), ["authority", "code"], "left_semi")
    claims = groups.where("song_id IS NOT NULL")
    edges = codes.select(g.alias("a"), c.alias("b")).unionByName(claimed.select(c.alias("a"), s.alias("b"))).unionByName(claims.select(g.alias("a"), s.alias("b")))
    # a group without a claim is a unit of its own: only those that claim something are nodes
    every = groups.where("group_id IS NOT NULL").select("group_id").distinct()
    claiming = codes.select("group_id").unionByName(claims.select("group_id")).distinct().join(every, "group_id", "left_semi")
    nodes = claiming.select(g.alias("id")).unionByName(edges.select(F.col("b").alias("id"))).unionByName(claimed.select(s.alias("id")))
    label = written(components(edges, nodes), "labels")
    kind, value = F.substring("id", 1, 1), F.expr("substring(id, 2)").cast("long")
    units = label.where(kind != "c").groupBy("label").agg(F.min(F.when(kind == "g", value)).alias("unit_id"), F.min(F.when(kind == "s", value)).alias("low"), F.max(F.when(kind == "s", value)).alias("high"))
    joined = spread(label.where(kind == "g").join(units, "label").select(value.alias("group_id"), "unit_id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("song_id"), F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("several")))
    return every.join(joined, "group_id", "left").select("group_id", F.coalesce("unit_id", F.col("group_id").cast("long")).alias("unit_id"), "song_id", F.coalesce("several", F.lit(False)).alias("several"))


def _listed(df: DataFrame, label: str, name: str) -> DataFrame:
    """unit_id, name: the codes that do not resolve, as one text."""
    return df.groupBy("unit_id").agg(F.concat(F.lit(label), F.array_join(F.array_sort(F.collect_set("code")), ", ")).alias(name))


def plan_songs(entries: DataFrame, children: dict[str, DataFrame], catalogue: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What each unit's song is to be. songs: unit_id, song_id (null: a new one), duration, release_date, audio, locale, errors.

    Of several titles of a locale that of the first entry counts, the others are in conflicts. The fallback is the
    title of the audio's locale, else the English one where all titles are equal, else an error. Duration is the
    representative one, the date the earliest valid one, audio that of the first entry that has some. Errors: no
    title, no fallback, artists or albums that the catalogue lacks, no artist, no duration, codes of several songs.
    """
    of_group = entries.select("group_id", "entry_id")
    codes = written(of_group.join(children["codes"], "entry_id"), "claims")  # few, and read for every kind of edge
    units = written(settle_claims(catalogue["groups"], codes, catalogue["song_codes"]), "units")
    e = written(entries.join(units.select("group_id", "unit_id"), "group_id").select("unit_id", "entry_id", "duration", "release_date", "audio"), "members")
    own = e.select("unit_id", "entry_id")
    # dealt by unit once: all that is summed up for a unit, its representative duration too, is found where its entries lie
    e = e.repartition("unit_id")
    first = lambda value, some: F.min_by(value, F.when(some, F.col("entry_id")))
    tag = C.locale_bit(F.col("audio"))
    main = e.groupBy("unit_id").agg(first(F.col("audio"), F.trim("audio") != "").alias("audio"), first(tag, (F.trim("audio") != "") & (tag != UND)).alias("locale"), earliest_date(F.col("release_date")).alias("release_date"), F.count(F.lit(1)).alias("members"))
    main = main.join(representative(e, "unit_id", "duration").withColumnRenamed("representative", "duration"), "unit_id", "left").withColumn("locale", F.coalesce("locale", F.lit(UND)))
    main = written(main, "values")

    rows = own.join(children["titles"].where("trim(title) <> ''"), "entry_id")
    best = written(rows.groupBy("unit_id", "locale").agg(F.min(F.struct("entry_id", "title"))["title"].alias("title")), "titles")
    conflicts = rows.join(best.withColumnRenamed("title", "existing"), ["unit_id", "locale"]).where("title <> existing").select("unit_id", "locale", "existing", F.col("title").alias("incoming"), "entry_id").distinct()
    kinds = best.groupBy("unit_id").agg(F.count_distinct("title").alias("kinds"), F.max(F.col("locale") == EN).alias("english"), F.count(F.lit(1)).alias("n"))
    spoken = best.select("unit_id", "locale", F.lit(True).alias("spoken"))
    choice = main.select("unit_id", "locale").join(spoken, ["unit_id", "locale"], "left").join(kinds, "unit_id", "left")
    choice = choice.select("unit_id", "n", F.when(F.col("spoken"), F.col("locale")).when((F.col("kinds") == 1) & F.col("english"), EN).alias("fallback_locale"))
    titles = best.join(choice, "unit_id").select("unit_id", "locale", "title", F.coalesce(F.col("locale") == F.col("fallback_locale"), F.lit(False)).alias("fallback"))

    choice = written(choice, "fallbacks")
    artists = own.join(children["artists"], "entry_id").groupBy("unit_id", "code").agg(F.min(F.struct("entry_id", "position")).alias("at")).join(catalogue["artist_codes"], "code", "left")
    albums = own.join(children["albums"], "entry_id").groupBy("unit_id", "code", F.coalesce(F.when(F.col("disc") > 0, F.col("disc")), F.lit(1)).alias("disc"), F.when(F.col("track") > 0, F.col("track")).alias("track")).agg(F.min_by("track_count", "entry_id").alias("track_count")).join(catalogue["album_codes"], "code", "left")
    artists, albums = written(artists, "artists"), written(albums, "albums")
    no_artist = _listed(artists.where("artist_id IS NULL"), "artist not found: ", "_artist")
    no_album = _listed(albums.where("album_id IS NULL"), "album not found: ", "_album")
    some = artists.select("unit_id").distinct().withColumn("_some", F.lit(True))
    d = main.join(choice, "unit_id").join(no_artist, "unit_id", "left").join(no_album, "unit_id", "left").join(some, "unit_id", "left").join(units.select("unit_id", "song_id", "several").distinct(), "unit_id")
    errors = F.array_compact(F.array(F.when(F.col("n").isNull(), F.lit("title missing")), F.when(F.col("n").isNotNull() & F.col("fallback_locale").isNull(), F.lit("fallback unknown")), F.col("_artist"), F.col("_album"), F.when(F.col("_some").isNull(), F.lit("artist missing")), F.when(F.coalesce("duration", F.lit(0)) <= 0, F.lit("duration missing")), F.when(F.col("several"), F.lit("codes of several songs"))))
    return {
        "units": units,
        "songs": written(d.select("unit_id", "song_id", "duration", "release_date", "audio", "locale", "members", errors.alias("errors")), "plans"),
        "titles": titles,
        "conflicts": conflicts,
        "codes": own.join(children["codes"], "entry_id").where("code IS NOT NULL").select("unit_id", "authority", "code").distinct(),
        "artists": artists.select("unit_id", "code", "artist_id", "at"),
        "albums": albums,
        "members": own,
    }


def create_or_merge(plan: dict[str, DataFrame], tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The catalogue after every plan without errors: songs with new ids in order of unit, or changed ones.

    Main values are set. Titles are set for each locale of the plan, others stay, but lose fallback if the plan has one.
    Locales become the plan's. Codes are added where nobody has them; artists that are not there yet come
    after the others; track counts and tracks are added where their place is free, of several the least song
    has it. Members are confirmed by hand, their other mappings rejected.
    """
    good = plan["songs"].where(F.size("errors") == 0)
    fresh = sequence_ids(good.where("song_id IS NULL").select("unit_id"), ["unit_id"], "_k")
    top = tables["songs"].agg(F.coalesce(F.max("song_id"), F.lit(0)).alias("_top"))  # one row
    dealt = fresh.crossJoin(F.broadcast(top)).select("unit_id", (F.col("_top") + 1 + F.col("_k")).alias("_new"))
    good = good.join(dealt, "unit_id", "left").withColumn("song_id", F.coalesce("song_id", "_new").cast("long")).drop("_new")
    good = written(good, "good")
    ids = good.select("unit_id", "song_id")
    of = lambda part: plan[part].join(ids, "unit_id")
    out: dict[str, DataFrame] = {"ids": ids}

    main = ["song_id", "duration", "release_date", "audio"]
    rest = tables["songs"].join(ids, "song_id", "left_anti").select(*main)
    out["songs"] = rest.unionByName(good.select(*main))

    titles = of("titles").select("song_id", "locale", "title", "fallback")
    has = titles.where("fallback").select("song_id", F.lit(True).alias("_has"))
    kept = tables["song_titles"].join(titles, ["song_id", "locale"], "left_anti").join(has, "song_id", "left")
    out["song_titles"] = kept.select("song_id", "locale", "title", (F.col("fallback") & F.col("_has").isNull()).alias("fallback")).unionByName(titles)

    out["song_locales"] = tables["song_locales"].join(ids, "song_id", "left_anti").select("song_id", "locale", "is_primary").unionByName(good.select("song_id", "locale", F.lit(True).alias("is_primary")))
    codes = of("codes").groupBy("authority", "code").agg(F.min("song_id").alias("song_id"))
    out["song_codes"] = insert_if_absent(tables["song_codes"].select("song_id", "authority", "code"), codes, ["authority", "code"])

    # in the order of the plan, after those that are there
    fresh_artists = of("artists").groupBy("song_id", "artist_id").agg(F.min("at").alias("at")).join(tables["song_artists"].select("song_id", "artist_id"), ["song_id", "artist_id"], "left_anti")
    last = tables["song_artists"].groupBy("song_id").agg(F.max("display_order").alias("_last"))
    place = F.row_number().over(Window.partitionBy("song_id").orderBy("at", "artist_id"))
    added = fresh_artists.join(last, "song_id", "left").select("song_id", "artist_id", (F.coalesce("_last", F.lit(0)) + place).cast("int").alias("display_order"))
    out["song_artists"] = tables["song_artists"].select("song_id", "artist_id", "display_order").unionByName(added)

    albums = of("albums")
    counts = top_k(albums.where("track_count IS NOT NULL"), ["album_id", "disc"], [F.col("song_id"), F.col("track").asc_nulls_last(), F.col("track_count")], 1).select("album_id", "disc", "track_count")
    out["track_counts"] = insert_if_absent(tables["track_counts"], counts, ["album_id", "disc"])
    tracks = albums.where("track IS NOT NULL").groupBy("album_id", "disc", "track").agg(F.min("song_id").alias("song_id"))
    out["album_tracks"] = insert_if_absent(tables["album_tracks"].select("album_id", "disc", "track", "song_id"), tracks, ["album_id", "disc", "track"])

    chosen = plan["members"].join(ids, "unit_id").select("entry_id", F.col("song_id").alias("_song")).repartition("entry_id").distinct()
    old = tables["mappings"].join(chosen, "entry_id", "left").where("_song IS NULL OR _song <> song_id")
    old = old.select("entry_id", "song_id", "method", "confidence", F.when(F.col("_song").isNotNull(), "rejected").otherwise(F.col("status")).alias("status"))
    out["mappings"] = old.unionByName(chosen.select("entry_id", F.col("_song").alias("song_id"), F.lit("MANUAL").alias("method"), F.lit(1.0).alias("confidence"), F.lit("confirmed").alias("status")))
    out["groups"] = tables["groups"].join(plan["units"].select("group_id", "unit_id").join(ids.withColumnRenamed("song_id", "_song"), "unit_id"), "group_id", "left").select("group_id", F.coalesce("song_id", "_song").alias("song_id"))
    return out
