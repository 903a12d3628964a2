"""Registered queries of the gallery over orders as albums, suppliers as artists, parts as songs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixtures import _spark_sql
from .plans import gallery as G
from .queries import query

_ITEMS = {
    "albums": "SELECT o_orderkey AS id, concat(o_orderpriority, ' ', o_orderkey // 3) AS title, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS release_date, o_orderkey % 5 AS album_type, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN concat('art', o_orderkey) END AS artwork FROM orders",
    "artists": "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 13 <> 0 THEN s_name END AS title, s_suppkey % 8 AS artist_tag, concat('face', s_suppkey) AS artwork FROM supplier",
    "songs": "SELECT p_partkey AS id, p_name AS title, CAST(power(2, p_partkey % 41) AS BIGINT) + CASE WHEN p_size % 3 = 0 AND p_partkey % 41 <> 8 THEN 256 ELSE 0 END AS genre_tag, p_size % 6 AS vocal, CASE WHEN p_size <> 7 THEN CAST(concat(1960 + p_size, '-03-0', 1 + p_size % 9) AS DATE) END AS release_date FROM part",
}
_CODES = {
    "albums": "SELECT o_orderkey AS id, CAST(power(2, o_custkey % 17) AS INT) AS locale FROM orders WHERE o_orderkey % 7 <> 0 UNION SELECT o_orderkey, 8192 FROM orders WHERE o_orderkey % 4 = 0",
    "artists": "SELECT s_suppkey AS id, CAST(power(2, s_suppkey % 16) AS INT) AS locale FROM supplier WHERE s_suppkey % 6 <> 0",
    "songs": "SELECT p_partkey AS id, CAST(power(2, p_size % 16) AS INT) AS locale FROM part WHERE p_partkey % 5 <> 0 UNION SELECT p_partkey, 0 FROM part WHERE p_partkey % 3 = 0 UNION SELECT p_partkey, 16384 FROM part WHERE p_size % 2 = 1",
}
_TRACKS = "SELECT DISTINCT l_orderkey AS album_id, l_partkey AS song_id FROM lineitem"
_LINKS = "SELECT {} AS id, l_suppkey AS artist_id, min(l_linenumber) AS display_order FROM lineitem GROUP BY {}, l_suppkey"


def gallery_items(t) -> dict[str, DataFrame]:
    """Of every mode its items, with the codes of their locales."""
    out = {}
    for mode, sql in _ITEMS.items():
        codes = _spark_sql(t, _CODES[mode].replace(" UNION SELECT", " UNION ALL SELECT")).repartition("id").distinct().groupBy("id").agg(F.collect_list("locale").alias("locales"))
        out[mode] = _spark_sql(t, sql).join(codes, "id", "left")
    return out


def _links(t, key: str) -> DataFrame:
    return _spark_sql(t, _LINKS.format(key, key))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_NODES = _values([(n["key"], n["label"], n["parent"], (n["own"] or [0])[0], i) for i, n in enumerate(G.tree(G.GENRES))])
_LOCALE = _values([(n["key"], n["label"], c, i) for i, n in enumerate(G.tree(G.LOCALES)) for c in n["own"]])
_LABELS = _values([(g, str(k), x, i) for g, found in (("tag", [(b, x) for x, b in G.TAGS.items()]), ("type", list(enumerate(G.TYPES))), ("vocal", list(enumerate(G.VOCALS)))) for i, (k, x) in enumerate(found)])
_ORACLE = f"""WITH RECURSIVE nodes(key, label, parent, bit, place) AS (VALUES {_NODES}), locale_groups(key, label, code, place) AS (VALUES {_LOCALE}), labels(group_by, key, label, place) AS (VALUES {_LABELS}),
up(bit, key, parent) AS (SELECT bit, key, parent FROM nodes UNION ALL SELECT up.bit, n.key, n.parent FROM up JOIN nodes n ON n.key = up.parent),
depths(key, depth) AS (SELECT key, 0 FROM nodes WHERE parent IS NULL UNION ALL SELECT n.key, depth + 1 FROM depths JOIN nodes n ON n.parent = depths.key),
{", ".join(f"{m} AS ({s})" for m, s in _ITEMS.items())}, {", ".join(f"{m}_codes AS ({s})" for m, s in _CODES.items())},
items AS (SELECT 'albums' AS mode, id, title FROM albums UNION ALL SELECT 'artists', id, title FROM artists UNION ALL SELECT 'songs', id, title FROM songs),
codes AS (SELECT 'albums' AS mode, * FROM albums_codes UNION ALL SELECT 'artists', * FROM artists_codes UNION ALL SELECT 'songs', * FROM songs_codes),
dates AS (SELECT 'albums' AS mode, id, release_date FROM albums UNION ALL SELECT 'songs', id, release_date FROM songs),
keyed AS (SELECT DISTINCT 'songs' AS mode, 'genre' AS group_by, key, id FROM songs JOIN up ON genre_tag & bit <> 0
UNION ALL SELECT DISTINCT i.mode, 'locale', coalesce(g.key, 'undefined'), i.id FROM items i LEFT JOIN codes c USING (mode, id) LEFT JOIN locale_groups g ON g.code = c.locale
UNION ALL SELECT 'artists', 'tag', key, id FROM artists JOIN labels ON group_by = 'tag' AND (artist_tag & CAST(key AS INT) <> 0 OR artist_tag + CAST(key AS INT) = 0)
UNION ALL SELECT 'albums', 'type', CAST(album_type AS VARCHAR), id FROM albums WHERE album_type < 4
UNION ALL SELECT 'songs', 'vocal', CAST(vocal AS VARCHAR), id FROM songs WHERE vocal < 5
UNION ALL SELECT mode, 'year', unnest(CASE WHEN release_date IS NULL THEN ['unknown'] ELSE ['decade:' || year(release_date) // 10 * 10, 'year:' || year(release_date)] END), id FROM dates),
members AS (SELECT k.*, title FROM keyed k JOIN items USING (mode, id)),
named AS (SELECT 'genre' AS group_by, key, label, depth, place FROM nodes JOIN depths USING (key) UNION ALL SELECT DISTINCT 'locale', key, label, 0, place FROM locale_groups UNION ALL SELECT group_by, key, label, 0, place FROM labels),
counted AS (SELECT mode, group_by, key, count(*) AS total FROM members GROUP BY ALL),
told AS (SELECT mode, group_by, key, total, coalesce(label, CASE WHEN key LIKE 'decade:%' THEN key[8:] || 's' WHEN key LIKE 'year:%' THEN key[6:] ELSE 'Unknown' END) AS label, coalesce(depth, CASE WHEN key LIKE 'year:%' THEN 1 ELSE 0 END) AS depth, coalesce(place, CASE WHEN key LIKE 'decade:%' THEN -CAST(key[8:] AS INT) - 10 WHEN key LIKE 'year:%' THEN -CAST(key[6:] AS INT) ELSE 0 END) AS place, CASE WHEN key LIKE 'decade:%' THEN -CAST(key[8:] AS INT) WHEN key LIKE 'year:%' THEN -(CAST(key[6:] AS INT) // 10 * 10) ELSE 0 END AS decade FROM counted LEFT JOIN named USING (group_by, key)),
groups AS (SELECT mode, group_by, key, label, depth, total, row_number() OVER (PARTITION BY mode, group_by ORDER BY decade, place) AS ordinal FROM told)"""
_COLS = "mode, group_by, key, label, depth, ordinal, total"


@query(f"{_ORACLE} SELECT {_COLS} FROM groups")
def v09_gallery_groups(t):
    """Every group of every mode and grouping with its total, in the order shown."""
    return G.groups(G.memberships(gallery_items(t))).select(*_COLS.split(", "))


@query(f"""{_ORACLE}, tracks AS ({_TRACKS}), album_links AS ({_LINKS.format("l_orderkey", "l_orderkey")}), song_links AS ({_LINKS.format("l_partkey", "l_partkey")}),
names AS (SELECT 'albums' AS mode, l.id, string_agg(a.title, ', ' ORDER BY display_order, a.id) AS artists FROM album_links l JOIN artists a ON a.id = artist_id GROUP BY l.id UNION ALL SELECT 'songs', l.id, string_agg(a.title, ', ' ORDER BY display_order, a.id) FROM song_links l JOIN artists a ON a.id = artist_id GROUP BY l.id),
art AS (SELECT 'albums' AS mode, id, artwork FROM albums UNION ALL SELECT 'artists', id, artwork FROM artists UNION ALL SELECT 'songs', song_id, first(artwork ORDER BY album_type = 2 DESC, album_id) FROM tracks JOIN albums ON id = album_id WHERE artwork <> '' GROUP BY song_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY mode, group_by, key ORDER BY lower(title) NULLS LAST, id) AS position FROM members)
SELECT {_COLS}, CASE WHEN total > 24 THEN 2 ELSE 1 END AS page, position, r.id, r.title, artwork, artists, year(release_date) AS year, CASE WHEN mode = 'artists' THEN (SELECT count(*) FROM album_links l WHERE l.artist_id = r.id) END AS album_count, CASE WHEN mode = 'artists' THEN (SELECT count(*) FROM song_links l WHERE l.artist_id = r.id) END AS track_count
FROM groups JOIN ranked r USING (mode, group_by, key) LEFT JOIN names USING (mode, id) LEFT JOIN art USING (mode, id) LEFT JOIN dates USING (mode, id) WHERE position BETWEEN CASE WHEN total > 24 THEN 25 ELSE 1 END AND CASE WHEN total > 24 THEN 48 ELSE 24 END""")
def v09_gallery_pages(t):
    """The second page of every group, or the first of one that has no other, with covers, artists, years and counts."""
    return G.gallery(gallery_items(t), _links(t, "l_orderkey"), _links(t, "l_partkey"), _spark_sql(t, _TRACKS), page=2)
