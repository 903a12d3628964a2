"""Registered queries of the curation plans that change many tables at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixtures import _parts, _spark_sql
from .plans import groups as R
from .plans import merging as G
from .plans import songs as N
from .queries import query

# entity merge: suppliers are artists; chains of up to four, cycles, a source with two targets, one that is not there

_TARGETS = """SELECT s AS source, CASE WHEN s % 10 = 1 THEN s + 1 WHEN s % 10 = 2 THEN s + 2 WHEN s % 30 = 4 THEN s + 1 WHEN s % 20 = 7 THEN s + 1 WHEN s % 20 = 8 THEN s - 1 WHEN s % 20 = 17 THEN s + 1 WHEN s % 40 = 19 THEN -1 END AS target FROM (SELECT s_suppkey AS s FROM supplier) WHERE s % 10 IN (1, 2) OR s % 30 = 4 OR s % 20 IN (7, 8, 17) OR s % 40 = 19 UNION SELECT s_suppkey, s_suppkey + 3 FROM supplier WHERE s_suppkey % 40 = 37"""
_ARTIST_TITLES = "SELECT s_suppkey AS artist_id, 2 AS locale, s_suppkey % 3 <> 0 AS fallback, ' Name ' || s_suppkey // 2 AS title, 'name ' || s_suppkey // 2 AS normalized FROM supplier UNION ALL SELECT s_suppkey, 1, s_suppkey % 3 = 0, s_name, lower(s_name) FROM supplier WHERE s_suppkey % 2 = 0"
_ALIASES = "SELECT DISTINCT l_suppkey AS artist_id, l_returnflag || l_suppkey // 4 AS alias, lower(l_returnflag) || l_suppkey // 4 AS normalized FROM lineitem"
_CODES = "SELECT DISTINCT l_suppkey AS artist_id, l_linenumber % 2 AS authority, CASE WHEN l_linenumber % 2 = 0 THEN 'P' || l_partkey ELSE 'Q' || l_orderkey // 8 END AS code FROM lineitem WHERE l_linenumber < 4"
_RELATIONS = "SELECT s_suppkey AS artist_id, s_suppkey + 1 AS ref_artist_id, 1 AS relation FROM supplier UNION SELECT s_suppkey, s_suppkey // 2, 1 FROM supplier UNION SELECT s_suppkey, s_suppkey // 3, 2 FROM supplier"
_LINKS = "SELECT l_orderkey AS song_id, l_linenumber AS display_order, l_suppkey AS artist_id, l_returnflag AS display_title FROM lineitem"


def merge_tables(t) -> tuple[dict[str, DataFrame], DataFrame]:
    links = _spark_sql(t, _LINKS)
    tables = {"artists": t.supplier.select(F.col("s_suppkey").alias("artist_id")), "codes": _spark_sql(t, _CODES), "titles": _spark_sql(t, _ARTIST_TITLES), "aliases": _spark_sql(t, _ALIASES), "relations": _spark_sql(t, _RELATIONS), "album_artists": links.select(F.col("song_id").alias("album_id"), "display_order", "artist_id"), "song_artists": links}
    return tables, _spark_sql(t, _TARGETS)


_CLOSED = f"""WITH RECURSIVE pairs AS ({_TARGETS}), several AS (SELECT source FROM pairs GROUP BY source HAVING count(*) > 1), walk(source, goal, n) AS (SELECT source, target, 1 FROM pairs UNION ALL SELECT w.source, p.target, n + 1 FROM walk w JOIN pairs p ON p.source = w.goal WHERE n < 50 AND w.goal NOT IN (SELECT source FROM several) AND w.source NOT IN (SELECT source FROM several)),
ends AS (SELECT source, max_by(goal, n) AS target, max(n) AS n, bool_or(source IN (SELECT source FROM several) OR goal IN (SELECT source FROM several)) AS bad FROM walk GROUP BY source),
judged AS (SELECT source, target, CASE WHEN bad THEN 'several targets' WHEN n >= 50 THEN 'cycle' WHEN target NOT IN (SELECT s_suppkey FROM supplier) THEN 'target not found' END AS error FROM ends),
closed AS (SELECT source, target FROM judged WHERE error IS NULL),
titles AS ({_ARTIST_TITLES}), aliases AS ({_ALIASES}), codes AS ({_CODES}), relations AS ({_RELATIONS}), links AS ({_LINKS}),
names AS (SELECT artist_id, 'title' AS kind, CASE WHEN fallback THEN 0 ELSE 1 END AS a, CAST(locale AS VARCHAR) AS b, trim(title) AS alias, normalized FROM titles UNION ALL SELECT artist_id, 'alias', 2, alias, trim(alias), normalized FROM aliases),
had AS (SELECT DISTINCT artist_id AS target, normalized FROM names WHERE artist_id IN (SELECT target FROM closed)),
name_moves AS (SELECT source, target, kind, alias, CASE WHEN h.normalized IS NOT NULL OR row_number() OVER (PARTITION BY target, n.normalized ORDER BY source, a, b, alias) > 1 THEN 'skip-duplicate' ELSE 'add' END AS action FROM names n JOIN closed ON source = artist_id LEFT JOIN had h USING (target, normalized)),
code_ends AS (SELECT c.*, source, coalesce(target, artist_id) AS owner FROM codes c LEFT JOIN closed ON source = artist_id),
code_moves AS (SELECT source, owner AS target, authority, code, CASE WHEN EXISTS (SELECT 1 FROM code_ends o WHERE o.authority = e.authority AND o.code = e.code AND o.owner = e.owner AND (o.source IS NULL OR o.source < e.source)) THEN 'skip-duplicate' WHEN EXISTS (SELECT 1 FROM code_ends o WHERE o.authority = e.authority AND o.code = e.code AND o.owner <> e.owner AND o.source IS NULL) THEN 'skip-owned' ELSE 'move' END AS action FROM code_ends e WHERE source IS NOT NULL),
rel AS (SELECT r.*, coalesce(x.target, artist_id) AS na, coalesce(y.target, ref_artist_id) AS nb, x.target IS NOT NULL OR y.target IS NOT NULL AS touched FROM relations r LEFT JOIN closed x ON x.source = artist_id LEFT JOIN closed y ON y.source = ref_artist_id),
rel_moves AS (SELECT * FROM (SELECT *, CASE WHEN na = nb OR row_number() OVER (PARTITION BY na, nb, relation ORDER BY touched, artist_id, ref_artist_id) > 1 THEN 'delete' ELSE 'update' END AS action FROM rel) WHERE touched)"""


@query(f"{_CLOSED} SELECT 'errors' AS part, source AS id, error AS value FROM judged WHERE error IS NOT NULL UNION ALL SELECT 'closed', source, CAST(target AS VARCHAR) FROM closed UNION ALL SELECT 'codes', source, concat_ws('|', target, authority, code, action) FROM code_moves UNION ALL SELECT 'names', source, concat_ws('|', target, kind, alias, action) FROM name_moves UNION ALL SELECT 'relations', artist_id, concat_ws('|', ref_artist_id, relation, na, nb, action) FROM rel_moves")
def m29_merge_plan(t):
    """Codes, names and relations of the plan, and what cannot be merged."""
    tables, targets = merge_tables(t)
    p = G.merge_plan(tables, targets)
    s = F.col("source")
    return _parts(("errors", p["errors"], s, ["error"]), ("closed", p["closed"], s, ["target"]), ("codes", p["codes"], s, ["target", "authority", "code", "action"]), ("names", p["names"], s, ["target", "kind", "alias", "action"]), ("relations", p["relations"], F.col("artist_id"), ["ref_artist_id", "relation", "new_artist_id", "new_ref_artist_id", "action"]))


_FALLBACK = "(SELECT artist_id, first(title ORDER BY fallback DESC, locale, title) AS name FROM titles GROUP BY artist_id)"


@query(f"{_CLOSED} SELECT 'codes' AS part, artist_id AS id, concat_ws('|', authority, code) AS value FROM codes WHERE artist_id NOT IN (SELECT source FROM closed) UNION ALL SELECT 'codes', target, concat_ws('|', authority, code) FROM code_moves WHERE action = 'move' UNION ALL SELECT 'aliases', artist_id, alias FROM aliases WHERE artist_id NOT IN (SELECT source FROM closed) UNION ALL SELECT 'aliases', target, alias FROM name_moves WHERE action = 'add' UNION ALL SELECT 'relations', na, concat_ws('|', nb, relation) FROM (SELECT DISTINCT na, nb, relation FROM rel WHERE NOT touched OR na <> nb) UNION ALL SELECT 'links', song_id, concat_ws('|', display_order, coalesce(target, l.artist_id), CASE WHEN target IS NULL THEN display_title ELSE name END) FROM links l LEFT JOIN closed ON source = l.artist_id LEFT JOIN {_FALLBACK} f ON f.artist_id = l.artist_id")
def m29_merge_applied(t):
    """Codes, aliases, relations and song links of the catalogue after the merge."""
    tables, targets = merge_tables(t)
    d = G.apply_merge(tables, G.merge_plan(tables, targets))
    a = F.col("artist_id")
    return _parts(("codes", d["codes"], a, ["authority", "code"]), ("aliases", d["aliases"], a, ["alias"]), ("relations", d["relations"], a, ["ref_artist_id", "relation"]), ("links", d["song_artists"], F.col("song_id"), ["display_order", "artist_id", "display_title"]))


@query(f"{_CLOSED} SELECT source, 'codes' AS part, action, count(*) AS n FROM code_moves GROUP BY ALL UNION ALL SELECT source, 'names', action, count(*) FROM name_moves GROUP BY ALL UNION ALL SELECT CASE WHEN artist_id IN (SELECT source FROM closed) THEN artist_id ELSE ref_artist_id END, 'relations', action, count(*) FROM rel_moves GROUP BY ALL UNION ALL SELECT artist_id, p, 'move', count(*) FROM links, (SELECT unnest(['album_artists', 'song_artists']) AS p) WHERE artist_id IN (SELECT source FROM closed) GROUP BY ALL")
def m29_merge_preview(t):
    """Counts only, from the same plan."""
    tables, targets = merge_tables(t)
    return G.merge_counts(G.merge_plan(tables, targets))


# songs from groups: orders are groups, line items their entries; some parts and suppliers are codes that groups share

_ENTRIES = "SELECT DISTINCT l_orderkey AS group_id, l_orderkey * 8 + l_linenumber AS entry_id FROM lineitem"
_ENTRY = "SELECT l_orderkey AS group_id, l_orderkey * 8 + l_linenumber AS entry_id, min(CAST(l_quantity AS BIGINT) * 1000) AS duration, CAST(min(CAST(l_shipdate AS DATE)) AS STRING) AS release_date, min(CASE WHEN l_orderkey % 4 = 0 THEN 'fr' WHEN l_linenumber % 2 = 0 THEN 'en' ELSE '' END) AS audio FROM lineitem GROUP BY l_orderkey, l_linenumber"
_ENTRY_TITLES = "SELECT DISTINCT l_orderkey * 8 + l_linenumber AS entry_id, 2 AS locale, concat(l_returnflag, CASE WHEN l_orderkey % 3 = 0 THEN l_linestatus ELSE '' END) AS title FROM lineitem WHERE l_orderkey % 13 <> 0 UNION SELECT DISTINCT l_orderkey * 8 + l_linenumber, 8, concat('t', l_orderkey) FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 4 <> 1"
_ENTRY_CODES = "SELECT DISTINCT l_orderkey * 8 + l_linenumber AS entry_id, 1 AS authority, concat('C', l_partkey) AS code FROM lineitem WHERE l_partkey % 50 = 0 AND l_linenumber = 1 UNION SELECT DISTINCT l_orderkey * 8 + l_linenumber, 0, concat('D', l_suppkey) FROM lineitem WHERE l_suppkey % 25 = 5 AND l_linenumber = 2"
_ENTRY_ARTISTS = "SELECT DISTINCT l_orderkey * 8 + l_linenumber AS entry_id, 1 AS position, concat('A', l_suppkey) AS code FROM lineitem WHERE l_linenumber < 6"
_ENTRY_ALBUMS = "SELECT l_orderkey * 8 + l_linenumber AS entry_id, concat('AL', l_partkey % 100) AS code, CASE WHEN l_orderkey % 5 = 0 THEN 2 END AS disc, l_orderkey % 20 AS track, 20 + l_orderkey % 3 AS track_count FROM lineitem WHERE l_linenumber = 3"
_SONG_CODES = "SELECT p_partkey + 1 AS song_id, 1 AS authority, concat('C', p_partkey) AS code FROM part WHERE p_partkey % 100 = 0 UNION ALL SELECT s_suppkey + 1, 0, concat('D', s_suppkey) FROM supplier WHERE s_suppkey % 50 = 5"
_ARTIST_CODES = "SELECT concat('A', s_suppkey) AS code, s_suppkey AS artist_id FROM supplier WHERE s_suppkey % 40 <> 7"
_ALBUM_CODES = "SELECT concat('AL', p_partkey) AS code, p_partkey AS album_id FROM part WHERE p_partkey < 100 AND p_partkey <> 13"
_GROUP_SONGS = "SELECT o_orderkey AS group_id, CASE WHEN o_orderkey % 90 = 2 THEN o_orderkey % 150 + 1 END AS song_id FROM orders"
_SONGS = "SELECT p_partkey + 1 AS song_id, CAST(p_size AS BIGINT) * 1000 AS duration, CAST(NULL AS DATE) AS release_date, p_brand AS audio FROM part"
_SONG_TITLES = "SELECT p_partkey + 1 AS song_id, 2 AS locale, p_name AS title, true AS fallback FROM part UNION ALL SELECT p_partkey + 1, 4, p_type, false FROM part"
_SONG_LOCALES = "SELECT p_partkey + 1 AS song_id, 4 AS locale, true AS is_primary FROM part"
_SONG_ARTISTS = "SELECT p_partkey + 1 AS song_id, p_size AS artist_id, 3 AS display_order FROM part"
_TRACKS = "SELECT p_partkey AS album_id, 1 AS disc, p_size % 20 AS track, p_partkey + 1 AS song_id FROM part WHERE p_partkey < 100"
_COUNTS = "SELECT p_partkey AS album_id, 1 AS disc, p_size AS track_count FROM part WHERE p_partkey < 60"
_MAPPINGS = "SELECT DISTINCT l_orderkey * 8 + l_linenumber AS entry_id, l_partkey + 1 AS song_id, 'FUZZY' AS method, 0.9 AS confidence, 'pending' AS status FROM lineitem WHERE l_linenumber = 1"


def _dealt(t, sql: str, by: str) -> DataFrame:
    """The different rows of the SQL: equal ones meet where by is dealt to, so that joins on it need no shuffle of their own."""
    return _spark_sql(t, sql.replace("SELECT DISTINCT", "SELECT").replace(" UNION SELECT", " UNION ALL SELECT")).repartition(by).distinct()


def song_tables(t) -> tuple[DataFrame, dict[str, DataFrame], dict[str, DataFrame]]:
    q = lambda sql: _spark_sql(t, sql)
    # line items dealt by order: entries are made and joined to their groups where they lie
    dealt = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate").repartition("l_orderkey")
    entry = t.spark.sql(_ENTRY.replace("FROM lineitem", "FROM {dealt}"), dealt=dealt)
    each = lambda sql: _dealt(t, sql, "entry_id")
    children = {"titles": each(_ENTRY_TITLES), "codes": each(_ENTRY_CODES), "artists": each(_ENTRY_ARTISTS), "albums": q(_ENTRY_ALBUMS)}
    tables = {"groups": q(_GROUP_SONGS), "songs": q(_SONGS), "song_titles": q(_SONG_TITLES), "song_locales": q(_SONG_LOCALES), "song_codes": q(_SONG_CODES), "song_artists": q(_SONG_ARTISTS), "album_tracks": q(_TRACKS), "track_counts": q(_COUNTS), "mappings": q(_MAPPINGS), "artist_codes": q(_ARTIST_CODES), "album_codes": q(_ALBUM_CODES)}
    return entry, children, tables


_PLAN = f"""WITH RECURSIVE entries AS MATERIALIZED ({_ENTRY}), entry_titles AS ({_ENTRY_TITLES}), entry_codes AS MATERIALIZED ({_ENTRY_CODES}), entry_artists AS ({_ENTRY_ARTISTS}), entry_albums AS ({_ENTRY_ALBUMS}), song_codes AS ({_SONG_CODES}), artist_codes AS ({_ARTIST_CODES}), album_codes AS ({_ALBUM_CODES}), group_songs AS ({_GROUP_SONGS}),
claims AS MATERIALIZED (SELECT DISTINCT 'g' || group_id AS a, 'c' || authority || code AS b FROM entries JOIN entry_codes USING (entry_id) UNION SELECT 'g' || group_id, 's' || song_id FROM group_songs WHERE song_id IS NOT NULL UNION SELECT 'c' || authority || code, 's' || song_id FROM song_codes WHERE code IN (SELECT code FROM entry_codes)),
edges AS MATERIALIZED (SELECT a, b FROM claims UNION SELECT b, a FROM claims),
near(id, label) AS (SELECT DISTINCT a, a FROM edges UNION SELECT e.b, n.label FROM near n JOIN edges e ON e.a = n.id),
labels AS MATERIALIZED (SELECT id, min(label) AS label FROM near GROUP BY id),
found AS (SELECT label, min(CAST(id[2:] AS BIGINT)) FILTER (id[1] = 'g') AS unit_id, min(CAST(id[2:] AS BIGINT)) FILTER (id[1] = 's') AS low, max(CAST(id[2:] AS BIGINT)) FILTER (id[1] = 's') AS high FROM labels WHERE id[1] <> 'c' GROUP BY label),
units AS MATERIALIZED (SELECT g.group_id, coalesce(unit_id, g.group_id) AS unit_id, CASE WHEN low = high THEN low END AS song_id, coalesce(low <> high, false) AS several FROM group_songs g LEFT JOIN labels l ON l.id = 'g' || g.group_id LEFT JOIN found USING (label)),
own AS MATERIALIZED (SELECT unit_id, e.* FROM entries e JOIN units USING (group_id)),
main AS (SELECT unit_id, min_by(audio, entry_id) FILTER (audio <> '') AS audio, coalesce(min_by(CASE audio WHEN 'fr' THEN 8 ELSE 2 END, entry_id) FILTER (audio <> ''), 1) AS locale, min(CAST(release_date AS DATE)) AS release_date, count(*) AS members FROM own GROUP BY unit_id),
durations AS (SELECT unit_id, duration, count(*) AS n FROM own GROUP BY ALL),
lengths AS (SELECT unit_id, CASE WHEN max(n) > 1 THEN min_by(duration, (-n, duration)) ELSE list_sort(list(duration))[(count(*) + 1) // 2] END AS duration FROM durations GROUP BY unit_id),
given AS (SELECT unit_id, t.* FROM own JOIN entry_titles t USING (entry_id) WHERE trim(title) <> ''),
best AS (SELECT unit_id, locale, min_by(title, (entry_id, title)) AS title FROM given GROUP BY ALL),
choice AS (SELECT m.unit_id, count(b.title) AS n, CASE WHEN bool_or(b.locale = m.locale) THEN any_value(m.locale) WHEN count(DISTINCT b.title) = 1 AND bool_or(b.locale = 2) THEN 2 END AS fallback_locale FROM main m LEFT JOIN best b USING (unit_id) GROUP BY m.unit_id),
artists AS (SELECT unit_id, a.code, min((entry_id, position)) AS spot, any_value(c.artist_id) AS artist_id FROM own JOIN entry_artists a USING (entry_id) LEFT JOIN artist_codes c USING (code) GROUP BY ALL),
albums AS (SELECT unit_id, a.code, CASE WHEN disc > 0 THEN disc ELSE 1 END AS disc, CASE WHEN track > 0 THEN track END AS track, min_by(track_count, entry_id) AS track_count, any_value(album_id) AS album_id FROM own JOIN entry_albums a USING (entry_id) LEFT JOIN album_codes USING (code) GROUP BY ALL),
no_artist AS (SELECT unit_id, 'artist not found: ' || string_agg(DISTINCT code, ', ' ORDER BY code) AS e FROM artists WHERE artist_id IS NULL GROUP BY unit_id),
no_album AS (SELECT unit_id, 'album not found: ' || string_agg(DISTINCT code, ', ' ORDER BY code) AS e FROM albums WHERE album_id IS NULL GROUP BY unit_id),
plan AS MATERIALIZED (SELECT m.*, l.duration, u.song_id, list_filter([CASE WHEN n = 0 THEN 'title missing' END, CASE WHEN n > 0 AND fallback_locale IS NULL THEN 'fallback unknown' END, a.e, b.e, CASE WHEN m.unit_id NOT IN (SELECT unit_id FROM artists) THEN 'artist missing' END, CASE WHEN l.duration <= 0 THEN 'duration missing' END, CASE WHEN several THEN 'codes of several songs' END], lambda x: x IS NOT NULL) AS errors FROM main m JOIN lengths l USING (unit_id) JOIN choice USING (unit_id) LEFT JOIN no_artist a USING (unit_id) LEFT JOIN no_album b USING (unit_id) JOIN (SELECT DISTINCT unit_id, song_id, several FROM units) u USING (unit_id))"""


@query(f"{_PLAN} SELECT 'songs' AS part, unit_id AS id, concat_ws('|', coalesce(CAST(song_id AS VARCHAR), '-'), duration, release_date, coalesce(audio, '-'), locale, members, array_to_string(errors, '; ')) AS value FROM plan UNION ALL SELECT 'titles', unit_id, concat_ws('|', locale, title, coalesce(locale = fallback_locale, false)) FROM best JOIN choice USING (unit_id) UNION ALL SELECT DISTINCT 'conflicts', unit_id, concat_ws('|', locale, b.title, g.title, entry_id) FROM given g JOIN best b USING (unit_id, locale) WHERE g.title <> b.title UNION ALL SELECT 'units', group_id, CAST(unit_id AS VARCHAR) FROM units")
def m25_unit_plans(t):
    """The plan of every song: claims settled, titles by locale with conflicts, values and errors."""
    p = N.plan_songs(*song_tables(t))
    u = F.col("unit_id")
    return _parts(("songs", p["songs"], u, ["song_id", "duration", "release_date", "audio", "locale", "members", F.array_join("errors", "; ")]), ("titles", p["titles"], u, ["locale", "title", "fallback"]), ("conflicts", p["conflicts"], u, ["locale", "existing", "incoming", "entry_id"]), ("units", p["units"], F.col("group_id"), ["unit_id"]))


@query(f"""{_PLAN}, good AS MATERIALIZED (SELECT * REPLACE (coalesce(song_id, (SELECT max(p_partkey) + 1 FROM part) + row_number() OVER (PARTITION BY song_id IS NULL ORDER BY unit_id)) AS song_id) FROM plan WHERE len(errors) = 0),
new_titles AS (SELECT song_id, b.locale, b.title, coalesce(b.locale = fallback_locale, false) AS fallback FROM best b JOIN choice USING (unit_id) JOIN good USING (unit_id)),
songs AS ({_SONGS}), song_titles AS ({_SONG_TITLES}), song_locales AS ({_SONG_LOCALES}), song_artists AS ({_SONG_ARTISTS}), tracks AS ({_TRACKS}), counts AS ({_COUNTS}), mappings AS ({_MAPPINGS}),
new_codes AS (SELECT authority, code, min(song_id) AS song_id FROM own JOIN entry_codes USING (entry_id) JOIN good USING (unit_id) WHERE code NOT IN (SELECT code FROM song_codes) GROUP BY ALL),
new_artists AS (SELECT g.song_id, a.artist_id, min(spot) AS spot FROM artists a JOIN good g USING (unit_id) WHERE NOT EXISTS (SELECT 1 FROM song_artists s WHERE s.song_id = g.song_id AND s.artist_id = a.artist_id) GROUP BY ALL),
placed AS (SELECT song_id, artist_id, coalesce((SELECT max(display_order) FROM song_artists s WHERE s.song_id = n.song_id), 0) + row_number() OVER (PARTITION BY song_id ORDER BY spot, artist_id) AS display_order FROM new_artists n),
linked AS (SELECT g.song_id, a.album_id, disc, track, track_count FROM albums a JOIN good g USING (unit_id)),
new_counts AS (SELECT album_id, disc, track_count FROM linked l WHERE NOT EXISTS (SELECT 1 FROM counts c WHERE c.album_id = l.album_id AND c.disc = l.disc) QUALIFY row_number() OVER (PARTITION BY album_id, disc ORDER BY song_id, track NULLS LAST, track_count) = 1),
new_tracks AS (SELECT album_id, disc, track, min(song_id) AS song_id FROM linked l WHERE track IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tracks t WHERE t.album_id = l.album_id AND t.disc = l.disc AND t.track = l.track) GROUP BY ALL),
chosen AS (SELECT entry_id, song_id AS song FROM own JOIN (SELECT unit_id, song_id FROM good) USING (unit_id))
SELECT 'songs' AS part, song_id AS id, concat_ws('|', duration, coalesce(CAST(release_date AS VARCHAR), '-'), coalesce(audio, '-')) AS value FROM (SELECT song_id, duration, release_date, audio FROM songs WHERE song_id NOT IN (SELECT song_id FROM good) UNION ALL SELECT song_id, duration, release_date, audio FROM good)
UNION ALL SELECT 'titles', song_id, concat_ws('|', locale, title, fallback) FROM (SELECT s.song_id, s.locale, s.title, s.fallback AND s.song_id NOT IN (SELECT song_id FROM new_titles WHERE fallback) AS fallback FROM song_titles s WHERE NOT EXISTS (SELECT 1 FROM new_titles n WHERE n.song_id = s.song_id AND n.locale = s.locale) UNION ALL SELECT * FROM new_titles)
UNION ALL SELECT 'locales', song_id, concat_ws('|', locale, is_primary) FROM (SELECT * FROM song_locales WHERE song_id NOT IN (SELECT song_id FROM good) UNION ALL SELECT song_id, locale, true FROM good)
UNION ALL SELECT 'codes', song_id, concat_ws('|', authority, code) FROM (SELECT song_id, authority, code FROM song_codes UNION ALL SELECT song_id, authority, code FROM new_codes)
UNION ALL SELECT 'artists', song_id, concat_ws('|', artist_id, display_order) FROM (SELECT * FROM song_artists UNION ALL SELECT * FROM placed)
UNION ALL SELECT 'counts', album_id, concat_ws('|', disc, track_count) FROM (SELECT * FROM counts UNION ALL SELECT * FROM new_counts)
UNION ALL SELECT 'tracks', album_id, concat_ws('|', disc, track, song_id) FROM (SELECT * FROM tracks UNION ALL SELECT * FROM new_tracks)
UNION ALL SELECT 'mappings', entry_id, concat_ws('|', song_id, method, status) FROM (SELECT entry_id, song_id, method, CASE WHEN song IS NOT NULL THEN 'rejected' ELSE status END AS status FROM mappings LEFT JOIN chosen USING (entry_id) WHERE song IS NULL OR song <> song_id UNION ALL SELECT entry_id, song, 'MANUAL', 'confirmed' FROM chosen)
UNION ALL SELECT 'groups', group_id, coalesce(CAST(coalesce(s.song_id, g.song_id) AS VARCHAR), '-') FROM group_songs s LEFT JOIN units u USING (group_id) LEFT JOIN good g ON g.unit_id = u.unit_id""")
def m26_create_or_merge(t):
    """Every table of the catalogue after the plans without errors."""
    entries, children, tables = song_tables(t)
    d = N.create_or_merge(N.plan_songs(entries, children, tables), tables)
    s = F.col("song_id")
    return _parts(("songs", d["songs"], s, ["duration", "release_date", "audio"]), ("titles", d["song_titles"], s, ["locale", "title", "fallback"]), ("locales", d["song_locales"], s, ["locale", "is_primary"]), ("codes", d["song_codes"], s, ["authority", "code"]), ("artists", d["song_artists"], s, ["artist_id", "display_order"]), ("counts", d["track_counts"], F.col("album_id"), ["disc", "track_count"]), ("tracks", d["album_tracks"], F.col("album_id"), ["disc", "track", "song_id"]), ("mappings", d["mappings"], F.col("entry_id"), ["song_id", "method", "status"]), ("groups", d["groups"], F.col("group_id"), ["song_id"]))


# groups: orders are groups of parts; parts are entries, orders are also issues of the part numbered like their customer

_MEMBERS = "SELECT DISTINCT l_orderkey AS group_id, l_partkey AS entry_id FROM lineitem"
_PARTS = "SELECT p_partkey AS entry_id, p_brand AS title, CASE WHEN p_size % 10 <> 0 THEN p_size * 1000 END AS duration, CASE WHEN p_partkey % 7 = 0 THEN concat('I', p_partkey % 50) ELSE '' END AS isrc FROM part"
_ISSUES = "SELECT o_orderkey AS issue_id, o_custkey AS entry_id, CAST(NULL AS TIMESTAMP) AS resolved_at FROM orders"
_SEEN = "SELECT DISTINCT l_orderkey AS group_id, l_partkey AS entry_id FROM lineitem WHERE l_orderkey % 4 = 0 OR l_orderkey % 4 = 2 AND l_partkey % 2 = 0"
_WANTED = "SELECT DISTINCT l_orderkey AS group_id, l_suppkey AS entry_id FROM lineitem WHERE l_orderkey % 2 = 0 UNION SELECT l_orderkey, -1 FROM lineitem WHERE l_orderkey % 20 = 0 UNION SELECT -5, 1"


def group_tables(t) -> dict[str, DataFrame]:
    q = lambda sql: _spark_sql(t, sql)
    d = {"members": _dealt(t, _MEMBERS, "group_id"), "entries": q(_PARTS), "issues": q(_ISSUES)}
    d["groups"] = t.orders.select(F.col("o_orderkey").alias("group_id")).join(R.details_of(d["members"], d["entries"]), "group_id", "left")
    d["group_issues"] = R.issue_links(d["members"], d["issues"])
    return d


_DETAILS = "SELECT group_id, concat_ws('|', CASE WHEN count(*) > 1 THEN 'EXACT' ELSE '-' END, CASE WHEN count(*) = 1 THEN '-' WHEN count(*) FILTER (isrc <> '') > 0 THEN '0.98' ELSE '0.9' END, string_agg(entry_id, ',' ORDER BY entry_id), coalesce(string_agg(DISTINCT isrc, ',' ORDER BY isrc) FILTER (isrc <> ''), ''), coalesce(string_agg(DISTINCT title, ',' ORDER BY title), ''), coalesce(CAST(min(duration) AS VARCHAR), '-'), coalesce(CAST(max(duration) AS VARCHAR), '-'), coalesce(CAST(max(duration) - min(duration) AS VARCHAR), '-'), array_to_string(list_filter([CASE WHEN count(*) FILTER (isrc <> '') > 0 THEN 'ISRC' END, CASE WHEN count(*) > 1 THEN 'EXACT_METADATA' END], lambda x: x IS NOT NULL), ',')) AS value FROM (SELECT m.group_id, m.entry_id, title, duration, isrc FROM @M m LEFT JOIN @E e ON e.entry_id = m.entry_id) GROUP BY group_id"


def _shown() -> list:
    lists = [F.array_join(F.transform("details.entry_ids", lambda x: x.cast("string")), ","), F.array_join("details.isrcs", ","), F.array_join("details.core_titles", ",")]
    return ["method", "confidence", *lists, "details.min_duration", "details.max_duration", "details.difference", F.array_join("details.methods", ",")]



_EDITS = f"""WITH m AS ({_MEMBERS}), e AS ({_PARTS}), seen AS ({_SEEN}), wanted AS ({_WANTED}), edited AS (SELECT group_id FROM seen UNION SELECT group_id FROM wanted),
stale AS (SELECT group_id FROM (SELECT * FROM m WHERE group_id IN (SELECT group_id FROM edited) EXCEPT SELECT * FROM seen) UNION SELECT group_id FROM (SELECT * FROM seen EXCEPT SELECT * FROM m)),
log AS (SELECT group_id, CASE WHEN group_id NOT IN (SELECT o_orderkey FROM orders) THEN 'group not found' WHEN group_id IN (SELECT group_id FROM stale) THEN 'members changed' WHEN group_id IN (SELECT group_id FROM wanted WHERE entry_id NOT IN (SELECT entry_id FROM e)) THEN 'entry not found' END AS error FROM edited),
good AS (SELECT group_id FROM log WHERE error IS NULL),
final AS (SELECT * FROM m WHERE group_id NOT IN (SELECT group_id FROM good) UNION ALL SELECT * FROM wanted WHERE group_id IN (SELECT group_id FROM good))"""


@query(f"{_EDITS} SELECT 'log' AS part, group_id AS id, coalesce(error, '-') AS value FROM log UNION ALL SELECT 'members', group_id, CAST(entry_id AS VARCHAR) FROM final UNION ALL SELECT DISTINCT 'issues', group_id, CAST(o_orderkey AS VARCHAR) FROM final JOIN orders ON o_custkey = entry_id UNION ALL SELECT 'details', o_orderkey, coalesce(value, '-|-|-|-|-|-|-|-|-') FROM orders LEFT JOIN ({_DETAILS.replace('@M', 'final').replace('@E', 'e')}) d ON d.group_id = o_orderkey")
def m28_edit_groups(t):
    """Edits of members; details and issue links of edited groups alone are made anew, the SQL makes those of all."""
    d = R.edit_groups(group_tables(t), _dealt(t, _SEEN, "group_id"), _dealt(t, _WANTED, "group_id"))
    g = F.col("group_id")
    return _parts(("log", d["log"], g, ["error"]), ("members", d["members"], g, ["entry_id"]), ("issues", d["group_issues"], g, ["issue_id"]), ("details", d["groups"], g, _shown()))


@query(f"WITH m AS (SELECT doc_id - doc_id % 3 AS group_id, doc_id AS entry_id FROM documents WHERE doc_id % 7 <> 1), e AS (SELECT doc_id AS entry_id, lang AS title, n_chars AS duration, CASE WHEN doc_id % 4 = 0 THEN source || doc_id END AS isrc FROM documents) {_DETAILS.replace('@M', 'm').replace('@E', 'e')}")
def m14_group_record(t):
    """Method, confidence and details of groups, with codes and alone."""
    m = t.documents.where("doc_id % 7 <> 1").select((F.col("doc_id") - F.col("doc_id") % 3).alias("group_id"), F.col("doc_id").alias("entry_id"))
    e = t.documents.select(F.col("doc_id").alias("entry_id"), F.col("lang").alias("title"), F.col("n_chars").alias("duration"), F.when(F.col("doc_id") % 4 == 0, F.concat("source", "doc_id")).alias("isrc"))
    text = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("-"))
    return R.details_of(m, e).select("group_id", F.concat_ws("|", *map(text, _shown())).alias("value"))


@query("WITH g AS (SELECT o_orderkey AS group_id, CASE WHEN o_orderstatus = 'F' THEN 'confirmed' ELSE 'pending' END AS status, o_orderkey % 5 = 0 AS done FROM orders), c AS (SELECT o_orderkey AS group_id, CASE WHEN o_orderkey % 3 = 0 THEN 'confirmed' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 6 = 0 THEN o_custkey END AS song FROM orders WHERE o_orderkey % 3 < 2) SELECT 'groups' AS part, g.group_id AS id, concat_ws('|', coalesce(c.status, g.status), coalesce(CAST(song AS VARCHAR), '-'), CASE WHEN c.status <> g.status OR song IS NOT NULL THEN c.status <> 'pending' ELSE done END) AS value FROM g LEFT JOIN c USING (group_id) UNION ALL SELECT 'issues', p_partkey, CAST(p_size % 4 = 0 OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 3 = 0 AND l_orderkey IN (SELECT o_orderkey FROM orders)) AS VARCHAR) FROM part")
def m27_status_and_issues(t):
    """Groups change status; the issues linked to a confirmed group, here parts by line item, are resolved."""
    then = F.lit("2024-01-01 00:00:00").cast("timestamp")
    g = t.orders.select(F.col("o_orderkey").alias("group_id"), F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("pending").alias("status"), F.lit(None).cast("long").alias("song_id"), F.when(F.col("o_orderkey") % 5 == 0, then).alias("resolved_at"))
    c = t.orders.where("o_orderkey % 3 < 2").select(F.col("o_orderkey").alias("group_id"), F.when(F.col("o_orderkey") % 3 == 0, "confirmed").otherwise("pending").alias("status"), F.when(F.col("o_orderkey") % 6 == 0, F.col("o_custkey")).alias("song_id"))
    tables = {"groups": g, "issues": t.part.select(F.col("p_partkey").alias("issue_id"), F.when(F.col("p_size") % 4 == 0, then).alias("resolved_at")), "group_issues": t.lineitem.select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("issue_id"))}
    d = R.change_status(tables, c, F.current_timestamp())
    return _parts(("groups", d["groups"], F.col("group_id"), ["status", "song_id", F.col("resolved_at").isNotNull()]), ("issues", d["issues"], F.col("issue_id"), [F.col("resolved_at").isNotNull()]))


@query("WITH RECURSIVE p AS (SELECT p_partkey AS k FROM part), e AS (SELECT k AS a, k + 1 AS b FROM p WHERE k % 5 <> 0 AND k % 50 <> 3 UNION ALL SELECT k, k + 7 FROM p WHERE k % 40 = 1), n AS (SELECT k AS id FROM p UNION SELECT b FROM e UNION SELECT k + 1 FROM p WHERE k % 5 <> 0), pairs AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, label) AS (SELECT id, id FROM n UNION SELECT b, label FROM r JOIN pairs ON a = r.id) SELECT id, min(label) AS label FROM r GROUP BY id")
def m28_relabel(t):
    """Components kept up after edges went and came, equal to all computed anew."""
    k = t.part.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    edges = k.where("a % 5 <> 0")
    nodes = k.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    labels = R.components(edges, nodes)
    return R.relabel(labels, edges, k.where("a % 40 = 1").select("a", (F.col("a") + 7).alias("b")), edges.where("a % 50 = 3"), nodes)
