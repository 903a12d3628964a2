"""Registered queries of loading nested documents into tables, and of the tables as nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixtures import _parts, _spark_sql
from .operators.aggregates import spread
from .plans import loading as N
from .queries import query

# suppliers are artists, parts albums, orders songs; some are in the catalogue, and documents of others are loaded

_HAD = {
    "artists": "SELECT s_suppkey + 1 AS artist_id, 0 AS artist_tag, CAST(NULL AS STRING) AS artwork FROM supplier WHERE s_suppkey % 4 <> 3",
    "artist_titles": "SELECT s_suppkey + 1 AS artist_id, 2 AS locale, s_name AS title, true AS fallback FROM supplier WHERE s_suppkey % 4 <> 3",
    "artist_alias": "SELECT s_suppkey + 1 AS artist_id, concat('alias ', s_suppkey) AS alias FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey % 4 <> 3",
    "artist_authorities": "SELECT s_suppkey + 1 AS artist_id, 1 AS authority, concat('A', s_suppkey) AS authority_code FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 4 <> 3",
    "artist_relations": "SELECT s_suppkey + 1 AS artist_id, s_suppkey // 8 * 4 + 1 AS ref_artist_id, 1 AS relation_to_ref FROM supplier WHERE s_suppkey % 4 <> 3",
    "albums": "SELECT p_partkey + 1 AS album_id, 2 AS album_type, CAST(NULL AS STRING) AS artwork, 1 AS disc_count, CAST(NULL AS DATE) AS release_date FROM part WHERE p_partkey % 3 <> 0",
    "album_titles": "SELECT p_partkey + 1 AS album_id, 2 AS locale, p_name AS title, true AS fallback FROM part WHERE p_partkey % 3 <> 0",
    "album_artists": "SELECT l_partkey + 1 AS album_id, min(l_suppkey) + 1 AS artist_id, 0 AS display_order FROM lineitem WHERE l_partkey % 3 <> 0 AND l_suppkey % 4 <> 3 GROUP BY l_partkey",
    "album_authorities": "SELECT p_partkey + 1 AS album_id, 1 AS authority, concat('P', p_partkey) AS authority_code FROM part WHERE p_partkey % 7 = 1 AND p_partkey % 3 <> 0",
    "album_track_counts": "SELECT p_partkey + 1 AS album_id, 1 AS disc_number, p_size AS track_count FROM part WHERE p_partkey % 3 <> 0",
    "songs": "SELECT o_orderkey + 1 AS song_id, o_orderpriority AS audio, CAST(round(o_totalprice) AS BIGINT) AS duration, o_orderkey % 8 AS genre_tag, CAST(o_orderdate AS DATE) AS release_date FROM orders WHERE o_orderkey % 3 = 0",
    "song_titles": "SELECT o_orderkey + 1 AS song_id, 2 AS locale, concat('song ', o_orderkey) AS title, true AS fallback FROM orders WHERE o_orderkey % 3 = 0",
    "song_artists": "SELECT l_orderkey + 1 AS song_id, min(l_suppkey) + 1 AS artist_id, 0 AS display_order, CAST(NULL AS STRING) AS display_title, 0 AS role FROM lineitem WHERE l_orderkey % 3 = 0 AND l_suppkey % 4 <> 3 GROUP BY l_orderkey",
    "song_authorities": "SELECT o_orderkey + 1 AS song_id, 0 AS authority, concat('S', o_orderkey) AS authority_code FROM orders WHERE o_orderkey % 6 = 0",
    "song_locales": "SELECT o_orderkey + 1 AS song_id, 2 AS locale, true AS is_primary FROM orders WHERE o_orderkey % 3 = 0",
    "album_tracks": "SELECT min(l_partkey) + 1 AS album_id, l_orderkey + 1 AS song_id, l_linenumber AS disc_number, l_orderkey AS track_number FROM lineitem WHERE l_orderkey % 3 = 0 AND l_partkey % 3 <> 0 GROUP BY l_orderkey, l_linenumber",
}
#: What the documents hold, as flat rows: errors of every rule, chains of artists, songs without id.
_GIVEN = {
    "g_artists": "SELECT s_suppkey AS doc, s_suppkey + 1 AS id, concat(s_name, '!') AS title, s_suppkey % 13 <> 6 AS fallback, CASE WHEN s_suppkey % 3 = 0 THEN concat('A', CASE WHEN s_suppkey % 11 = 6 THEN s_suppkey + 3 ELSE s_suppkey END) END AS code, CASE WHEN s_suppkey % 17 = 8 THEN 999999 WHEN s_suppkey % 12 = 7 OR s_suppkey % 24 = 3 THEN s_suppkey + 5 WHEN s_suppkey % 2 = 0 THEN s_suppkey + 2 END AS ref FROM supplier WHERE s_suppkey % 4 <> 0",
    "g_albums": "SELECT p_partkey AS doc, p_partkey + 1 AS id, p_name AS title, CASE WHEN p_partkey % 19 = 4 THEN 'TAPE' ELSE 'EP' END AS kind, CASE WHEN p_partkey % 29 = 3 THEN 'soon' ELSE '2020-02-03' END AS released FROM part WHERE p_partkey % 3 <> 1",
    "g_album_artists": "SELECT l_partkey AS doc, min(l_suppkey) + 1 AS artist FROM lineitem WHERE l_partkey % 3 <> 1 GROUP BY l_partkey",
    "g_songs": "SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey + 1 END AS id, concat('new ', o_orderkey) AS title, CASE WHEN o_orderkey % 23 <> 7 THEN CAST(round(o_totalprice) AS BIGINT) END AS duration FROM orders WHERE o_orderkey % 4 <> 1",
    "g_song_artists": "SELECT l_orderkey AS doc, min(l_suppkey) + 1 AS artist FROM lineitem WHERE l_orderkey % 4 <> 1 GROUP BY l_orderkey",
    "g_tracks": "SELECT l_orderkey AS doc, min(l_partkey) + 1 AS album, l_linenumber AS disc, CASE WHEN l_orderkey % 31 = 2 THEN l_orderkey + 1 ELSE l_orderkey END AS track FROM lineitem WHERE l_orderkey % 4 <> 1 AND l_linenumber < 3 GROUP BY l_orderkey, l_linenumber",
}


def load_tables(t) -> dict[str, DataFrame]:
    return {n: _spark_sql(t, sql) for n, sql in _HAD.items()}


def _documents(t) -> DataFrame:
    """(doc_id, document): one for each artist, album and song; what a list holds is packed by its owner."""
    g = {n: _spark_sql(t, sql) for n, sql in _GIVEN.items()}
    title = "map('en', named_struct('text', title, 'primary', fallback)) AS title"
    of = lambda kind, df: df.select(F.col("doc").alias("doc_id"), F.to_json(F.struct(F.lit("CLIPBOARD").alias("source"), F.array(F.struct(*[c for c in df.columns if c != "doc"])).alias(kind)), {"ignoreNullFields": "false"}).alias("document"))
    artists = g["g_artists"].selectExpr("doc", "id", title, "0 AS artistTag", "CASE WHEN code IS NOT NULL THEN array(named_struct('authority', 'APPLE_MUSIC', 'code', code)) END AS authority", "CASE WHEN ref IS NOT NULL THEN array(named_struct('ref', ref, 'role', 'MEMBER_OF')) END AS relations")
    by = g["g_album_artists"].selectExpr("doc", "array(artist) AS artists")
    albums = g["g_albums"].join(spread(by), "doc", "left").selectExpr("doc", "id", "true AS fallback", "title", "kind AS albumType", "released AS releaseDate", "artists", "array(named_struct('disc', 1, 'trackCount', 9)) AS trackCounts").selectExpr("doc", "id", title, "albumType", "releaseDate", "artists", "trackCounts")
    singers = g["g_song_artists"].selectExpr("doc", "array(named_struct('id', artist, 'role', 'FEAT')) AS artists")
    tracks = g["g_tracks"].groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.col("album").alias("id"), "disc", "track"))).alias("albums"))
    songs = g["g_songs"].join(spread(singers), "doc", "left").join(spread(tracks), "doc", "left").withColumn("fallback", F.lit(True))
    songs = songs.selectExpr("doc", "id", title, "duration", "'DANCE,POP' AS genreTag", "artists", "albums", "array(named_struct('locale', 'en', 'primary', true), named_struct('locale', 'fr', 'primary', false)) AS locale")
    return of("artists", artists).unionByName(of("albums", albums)).unionByName(of("songs", songs))


def _plan(t) -> tuple[dict[str, DataFrame], dict]:
    tables = load_tables(t)
    docs, _ = N.read_documents(_documents(t), "doc_id", "document")
    return tables, N.load_plan(docs, tables, "loader", "query")


_CTE = ", ".join(f"{n} AS MATERIALIZED ({s})" for n, s in (_HAD | _GIVEN).items())
_LOAD = f"""WITH RECURSIVE {_CTE},
e_artists AS (SELECT doc, 'not one fallback' AS rule, 'artist_titles' AS detail FROM g_artists WHERE NOT fallback
 UNION SELECT doc, 'repeated', 'artist_authorities' FROM g_artists WHERE code IN (SELECT code FROM g_artists WHERE code IS NOT NULL GROUP BY code HAVING count(*) > 1)
 UNION SELECT doc, 'owned', 'artist_authorities' FROM g_artists JOIN artist_authorities ON authority_code = code AND artist_id <> id),
fine AS (SELECT * FROM g_artists WHERE doc NOT IN (SELECT doc FROM e_artists)),
open_refs AS (SELECT doc, id, ref FROM g_artists WHERE ref IS NOT NULL AND ref NOT IN (SELECT artist_id FROM artists)),
lost(doc, id, ref) AS (SELECT * FROM open_refs WHERE ref NOT IN (SELECT id FROM fine) UNION SELECT o.* FROM lost l JOIN open_refs o ON o.ref = l.id),
ok_artists AS MATERIALIZED (SELECT * FROM fine WHERE doc NOT IN (SELECT doc FROM lost)),
all_artists AS MATERIALIZED (SELECT artist_id AS id FROM artists UNION SELECT id FROM ok_artists),
e_albums AS (SELECT doc, 'missing' AS rule, 'album_type' AS detail FROM g_albums WHERE kind = 'TAPE' UNION SELECT doc, 'date', 'release_date' FROM g_albums WHERE released = 'soon'
 UNION SELECT doc, 'reference', 'album_artists ' || artist FROM g_albums JOIN g_album_artists USING (doc) WHERE artist NOT IN (SELECT id FROM all_artists)),
ok_albums AS MATERIALIZED (SELECT * FROM g_albums WHERE doc NOT IN (SELECT doc FROM e_albums)),
all_albums AS MATERIALIZED (SELECT album_id AS id FROM albums UNION SELECT id FROM ok_albums),
owner AS (SELECT doc, s.id, t.* EXCLUDE (doc) FROM g_tracks t JOIN g_songs s USING (doc)),
e_songs AS (SELECT doc, 'missing' AS rule, 'duration' AS detail FROM g_songs WHERE duration IS NULL
 UNION SELECT doc, 'repeated', 'album_tracks' FROM owner WHERE (album, disc, track) IN (SELECT (album, disc, track) FROM owner GROUP BY album, disc, track HAVING count(*) > 1)
 UNION SELECT doc, 'owned', 'album_tracks' FROM owner JOIN album_tracks ON album_id = album AND disc_number = disc AND track_number = track WHERE song_id IS DISTINCT FROM id
 UNION SELECT doc, 'reference', 'song_artists ' || artist FROM g_song_artists JOIN g_songs USING (doc) WHERE artist NOT IN (SELECT id FROM all_artists)
 UNION SELECT doc, 'reference', 'album_tracks ' || album FROM owner WHERE album NOT IN (SELECT id FROM all_albums)),
kept_songs AS MATERIALIZED (SELECT * FROM g_songs WHERE doc NOT IN (SELECT doc FROM e_songs)),
ok_songs AS MATERIALIZED (SELECT * FROM kept_songs WHERE id IS NOT NULL UNION ALL SELECT doc, (SELECT max(x) FROM (SELECT song_id AS x FROM songs UNION ALL SELECT id FROM kept_songs)) + row_number() OVER (ORDER BY doc), title, duration FROM kept_songs WHERE id IS NULL)"""


@query(f"""{_LOAD} SELECT 'artists' AS kind, doc, rule, detail FROM e_artists UNION ALL SELECT DISTINCT 'artists', doc, 'reference', 'artist_relations ' || ref FROM lost
UNION ALL SELECT 'albums', doc, rule, detail FROM e_albums UNION ALL SELECT 'songs', doc, rule, detail FROM e_songs""")
def s05_load_errors(t):
    """Documents that are left out whole, with each rule that they break."""
    return _plan(t)[1]["errors"].select("kind", F.col("pos.doc_id").alias("doc"), "rule", "detail")


@query(f"""{_LOAD} SELECT 'titles' AS part, artist_id AS id, concat_ws('|', locale, title, fallback) AS value FROM artist_titles WHERE artist_id NOT IN (SELECT id FROM ok_artists) UNION ALL SELECT 'titles', id, concat_ws('|', 2, title, true) FROM ok_artists
UNION ALL SELECT 'aliases', artist_id, alias FROM artist_alias WHERE artist_id NOT IN (SELECT id FROM ok_artists)
UNION ALL SELECT 'codes', artist_id, authority_code FROM artist_authorities WHERE artist_id NOT IN (SELECT id FROM ok_artists) UNION ALL SELECT 'codes', id, code FROM ok_artists WHERE code IS NOT NULL
UNION ALL SELECT 'relations', artist_id, CAST(ref_artist_id AS VARCHAR) FROM artist_relations WHERE artist_id NOT IN (SELECT id FROM ok_artists) UNION ALL SELECT 'relations', id, CAST(ref AS VARCHAR) FROM ok_artists WHERE ref IS NOT NULL
UNION ALL SELECT 'albums', album_id, concat_ws('|', album_type, disc_count, '-') FROM albums WHERE album_id NOT IN (SELECT id FROM ok_albums) UNION ALL SELECT 'albums', id, '1|-|2020-02-03' FROM ok_albums
UNION ALL SELECT 'album_artists', album_id, CAST(artist_id AS VARCHAR) FROM album_artists WHERE album_id NOT IN (SELECT id FROM ok_albums) UNION ALL SELECT 'album_artists', id, CAST(artist AS VARCHAR) FROM ok_albums JOIN g_album_artists USING (doc)
UNION ALL SELECT 'songs', song_id, concat_ws('|', audio, duration, genre_tag, release_date) FROM songs WHERE song_id NOT IN (SELECT id FROM ok_songs) UNION ALL SELECT 'songs', id, concat_ws('|', '-', duration, 36, '-') FROM ok_songs
UNION ALL SELECT 'song_artists', song_id, concat_ws('|', artist_id, display_order, role) FROM song_artists WHERE song_id NOT IN (SELECT id FROM ok_songs) UNION ALL SELECT 'song_artists', id, concat_ws('|', artist, 0, 1) FROM ok_songs JOIN g_song_artists USING (doc)
UNION ALL SELECT 'locales', song_id, concat_ws('|', locale, is_primary) FROM song_locales WHERE song_id NOT IN (SELECT id FROM ok_songs) UNION ALL SELECT 'locales', id, unnest(['2|true', '8|false']) FROM ok_songs
UNION ALL SELECT 'tracks', song_id, concat_ws('|', album_id, disc_number, track_number) FROM album_tracks WHERE song_id NOT IN (SELECT id FROM ok_songs) UNION ALL SELECT 'tracks', s.id, concat_ws('|', album, disc, track) FROM ok_songs s JOIN g_tracks USING (doc)""")
def s05_loaded(t):
    """Eleven of the sixteen tables after the load: children of loaded owners replaced, those of others kept."""
    tables, plan = _plan(t)
    d = N.apply_load(tables, plan)
    a, b, s = F.col("artist_id"), F.col("album_id"), F.col("song_id")
    return _parts(("titles", d["artist_titles"], a, ["locale", "title", "fallback"]), ("aliases", d["artist_alias"], a, ["alias"]), ("codes", d["artist_authorities"], a, ["authority_code"]), ("relations", d["artist_relations"], a, ["ref_artist_id"]), ("albums", d["albums"], b, ["album_type", "disc_count", "release_date"]), ("album_artists", d["album_artists"], b, ["artist_id"]), ("songs", d["songs"], s, ["audio", "duration", "genre_tag", "release_date"]), ("song_artists", d["song_artists"], s, ["artist_id", "display_order", "role"]), ("locales", d["song_locales"], s, ["locale", "is_primary"]), ("tracks", d["album_tracks"], s, ["album_id", "disc_number", "track_number"]))


@query(f"""{_LOAD}, was(t, id, op) AS (SELECT 'artists', id, CASE WHEN id IN (SELECT artist_id FROM artists) THEN '' ELSE 'INSERT' END FROM ok_artists UNION ALL SELECT 'artist_titles', artist_id, 'DELETE' FROM artist_titles WHERE artist_id IN (SELECT id FROM ok_artists) UNION ALL SELECT 'artist_titles', id, 'INSERT' FROM ok_artists UNION ALL SELECT 'artist_alias', artist_id, 'DELETE' FROM artist_alias WHERE artist_id IN (SELECT id FROM ok_artists)
UNION ALL SELECT 'albums', id, CASE WHEN id IN (SELECT album_id FROM albums) THEN 'UPDATE' ELSE 'INSERT' END FROM ok_albums UNION ALL SELECT 'album_track_counts', album_id, 'DELETE' FROM album_track_counts WHERE album_id IN (SELECT id FROM ok_albums) UNION ALL SELECT 'album_track_counts', id, 'INSERT' FROM ok_albums
UNION ALL SELECT 'songs', id, CASE WHEN id IN (SELECT song_id FROM songs) THEN 'UPDATE' ELSE 'INSERT' END FROM ok_songs UNION ALL SELECT 'album_tracks', song_id, 'DELETE' FROM album_tracks WHERE song_id IN (SELECT id FROM ok_songs) UNION ALL SELECT 'album_tracks', s.id, 'INSERT' FROM ok_songs s JOIN g_tracks USING (doc))
SELECT t AS "table", id AS owner_id, op AS operation, count(*) AS n FROM was WHERE op <> '' GROUP BY ALL""")
def s05_load_log(t):
    """Entries of the change log by table, owner and operation; an artist that stays as it was has none of its own."""
    tables, plan = _plan(t)
    seen = ("artists", "artist_titles", "artist_alias", "albums", "album_track_counts", "songs", "album_tracks")
    return N.load_log(tables, plan).where(F.col("table").isin(*seen)).groupBy("table", "owner_id", "operation").agg(F.count(F.lit(1)).alias("n"))


_NESTED = f"""WITH {_CTE}, direct AS (SELECT song_id, artist_id FROM song_artists UNION SELECT song_id, artist_id FROM album_tracks JOIN album_artists USING (album_id)), linked AS (SELECT * FROM direct UNION SELECT song_id, ref_artist_id FROM direct JOIN artist_relations USING (artist_id))"""


@query(f"""{_NESTED} SELECT song_id, coalesce((SELECT string_agg(concat_ws(':', l.artist_id, t.title, c.authority_code), ',' ORDER BY l.artist_id) FROM linked l LEFT JOIN artist_titles t ON t.artist_id = l.artist_id LEFT JOIN artist_authorities c ON c.artist_id = l.artist_id WHERE l.song_id = s.song_id), '') AS artists,
coalesce((SELECT string_agg(concat_ws(':', k.album_id, a.title, n.track_count), ',' ORDER BY k.album_id) FROM (SELECT DISTINCT song_id, album_id FROM album_tracks) k JOIN album_titles a USING (album_id) LEFT JOIN album_track_counts n USING (album_id) WHERE k.song_id = s.song_id), '') AS albums, list_aggregate(list_filter(['CLASSICAL', 'COUNTRY', 'DANCE'], lambda g: genre_tag & (1 << (list_position(['CLASSICAL', 'COUNTRY', 'DANCE'], g) - 1)) <> 0), 'string_agg', ',') AS genres FROM songs s""")
def v08_song_documents(t):
    """Three levels of every song's document, read back from its JSON."""
    d = N.song_documents(load_tables(t)).select("song_id", F.from_json("document", N.DOCUMENT).alias("j"))
    text = lambda *parts: F.concat_ws(":", *[p.cast("string") for p in parts])
    artists = F.transform("j.artists", lambda a: text(a["id"], a["title"]["en"]["text"], F.get(a["authority"], 0)["code"]))
    albums = F.transform("j.albums", lambda a: text(a["id"], a["title"]["en"]["text"], F.get(a["trackCounts"], 0)["trackCount"]))
    return d.select("song_id", F.array_join(artists, ",").alias("artists"), F.array_join(albums, ",").alias("albums"), F.nullif(F.get("j.songs", 0)["genreTag"], F.lit("")).alias("genres"))


@query(f"""{_NESTED}, seen AS (SELECT DISTINCT artist_id FROM linked), discs AS (SELECT DISTINCT album_id FROM album_tracks)
SELECT 'artist_titles' AS part, artist_id AS id, title AS value FROM artist_titles SEMI JOIN seen USING (artist_id) UNION ALL SELECT 'artist_alias', artist_id, alias FROM artist_alias SEMI JOIN seen USING (artist_id) UNION ALL SELECT 'artist_relations', artist_id, CAST(ref_artist_id AS VARCHAR) FROM artist_relations SEMI JOIN seen USING (artist_id)
UNION ALL SELECT 'album_artists', album_id, concat_ws('|', artist_id, display_order) FROM album_artists SEMI JOIN discs USING (album_id) UNION ALL SELECT 'album_authorities', album_id, authority_code FROM album_authorities SEMI JOIN discs USING (album_id)
UNION ALL SELECT 'songs', song_id, concat_ws('|', audio, duration, genre_tag, release_date) FROM songs UNION ALL SELECT 'song_artists', song_id, concat_ws('|', artist_id, role) FROM song_artists UNION ALL SELECT 'song_authorities', song_id, authority_code FROM song_authorities UNION ALL SELECT 'song_locales', song_id, CAST(is_primary AS VARCHAR) FROM song_locales UNION ALL SELECT 'album_tracks', song_id, concat_ws('|', album_id, disc_number, track_number) FROM album_tracks""")
def v11_round_trip(t):
    """Every song's document, loaded into empty tables: the rows that the songs reach, as they were."""
    tables = load_tables(t)
    docs, _ = N.read_documents(N.song_documents(tables), "song_id", "document")
    empty = {n: d.limit(0) for n, d in tables.items()}
    d = N.apply_load(empty, N.load_plan(docs, empty))
    a, b, s = F.col("artist_id"), F.col("album_id"), F.col("song_id")
    return _parts(("artist_titles", d["artist_titles"], a, ["title"]), ("artist_alias", d["artist_alias"], a, ["alias"]), ("artist_relations", d["artist_relations"], a, ["ref_artist_id"]), ("album_artists", d["album_artists"], b, ["artist_id", "display_order"]), ("album_authorities", d["album_authorities"], b, ["authority_code"]), ("songs", d["songs"], s, ["audio", "duration", "genre_tag", "release_date"]), ("song_artists", d["song_artists"], s, ["artist_id", "role"]), ("song_authorities", d["song_authorities"], s, ["authority_code"]), ("song_locales", d["song_locales"], s, ["is_primary"]), ("album_tracks", d["album_tracks"], s, ["album_id", "disc_number", "track_number"]))
