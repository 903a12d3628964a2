"""Registered queries of typed reading from loose JSON, over documents made of the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .queries import query
from .sources import loose as L

#: One song a document; by the number of the event some value is missing, null or of the wrong type, or the text is no JSON.
_DOCS = """SELECT event_id AS doc_id, concat('{"source":', CASE WHEN event_id % 17 = 0 THEN '5' ELSE '"export"' END, ',"time":"', CASE WHEN event_id % 19 = 0 THEN 'noon' ELSE '2024-01-05' END, '",', CASE WHEN event_id % 23 = 0 THEN '' ELSE '"artists":[],' END, '"albums":', CASE WHEN event_id % 29 = 0 THEN 'null' ELSE '[]' END,
',"songs":[{"id":', CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS STRING) ELSE concat('"', event_id, '"') END, ',"audio":null,"albumID":"al","artistID":', CASE event_id % 7 WHEN 0 THEN '"a1"' WHEN 1 THEN '["a1",2,null]' WHEN 2 THEN 'null' ELSE '["a1","a2"]' END, ',"discNumber":', CASE WHEN event_id % 5 = 0 THEN '"1"' ELSE '1' END, CASE WHEN event_id % 13 = 0 THEN '' ELSE ',"duration":1000' END, ',"isrc":', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE '"q"' END,
',"locale":"en","playCount":', CASE WHEN event_id % 31 = 0 THEN '[]' ELSE CAST(user_id AS STRING) END, ',"releaseDate":', CASE event_id % 4 WHEN 0 THEN '"2024-02-30"' WHEN 1 THEN '"2024-02-03T04:05:06"' WHEN 2 THEN 'null' ELSE '12' END, ',"trackNumber":1,"title":', CASE event_id % 6 WHEN 0 THEN '"plain"' WHEN 1 THEN '{"en":"t","fr":null,"ja":3,"ko":"k"}' ELSE '{"en":"t","fr":null,"ja":null,"ko":null,"zs":null,"zt":"z"}' END, '}]', CASE WHEN event_id % 37 = 0 THEN '' ELSE '}' END) AS doc FROM events"""


def _made(t, sql: str):
    # a file is read by as few tasks as it has row groups; what a document costs is its parsing, so events are dealt anew before
    n = max(t.spark.sparkContext.defaultParallelism, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    return t.events.select("event_id", "user_id").repartition(n, "event_id").selectExpr("event_id AS doc_id", sql.removeprefix("SELECT event_id AS doc_id, ").removesuffix(" FROM events"))


_FIELDS = [("$.source", "s", 0), ("$.time", "d", 0), ("$.artists", "l", 0), ("$.albums", "l", 0), ("$.songs", "l", 0), *((f"$.songs[0].{f.key}", {"text": "s", "int": "i", "date": "d", "texts": "l"}[f.kind], int(f.nullable)) for f in L.CATALOGUE["songs"]), ("$.songs[0].title", "o", 0)]
_VALUES = ", ".join(f"('{p}', '{k}', {n})" for p, k, n in _FIELDS)
_LOC = ", ".join(f"'{x}'" for x in L.LOCALES)


@query(f"""WITH docs AS ({_DOCS}), good AS (SELECT doc_id, doc::JSON AS j FROM docs WHERE json_valid(doc)), rules(p, k, n) AS (VALUES {_VALUES}),
seen AS (SELECT doc_id, p, k, n, json_type(j, p) AS t, json_extract_string(j, p) AS x FROM good, rules WHERE p NOT LIKE '%].%' OR json_type(j, '$.songs') = 'ARRAY')
SELECT doc_id, '$' AS path, 'json' AS rule FROM docs WHERE NOT json_valid(doc)
UNION ALL SELECT doc_id, p, rule FROM (SELECT doc_id, p, CASE WHEN t IS NULL THEN 'missing' WHEN t = 'NULL' THEN CASE WHEN n = 0 THEN 'null' END WHEN CASE k WHEN 's' THEN t <> 'VARCHAR' WHEN 'd' THEN t <> 'VARCHAR' WHEN 'i' THEN t NOT IN ('UBIGINT', 'BIGINT') WHEN 'l' THEN t <> 'ARRAY' ELSE t <> 'OBJECT' END THEN 'type' WHEN k = 'd' AND try_cast(x AS TIMESTAMP) IS NULL THEN 'date' END AS rule FROM seen) WHERE rule IS NOT NULL
UNION ALL SELECT doc_id, '$.songs[0].artistID[' || i || ']', 'type' FROM good, (SELECT unnest([0, 1, 2]) AS i) WHERE json_type(j, '$.songs[0].artistID') = 'ARRAY' AND json_type(j, '$.songs[0].artistID[' || i || ']') <> 'VARCHAR'
UNION ALL SELECT doc_id, p, rule FROM (SELECT doc_id, '$.songs[0].title.' || l AS p, CASE WHEN json_type(j, '$.songs[0].title.' || l) IS NULL THEN 'missing' WHEN json_type(j, '$.songs[0].title.' || l) NOT IN ('NULL', 'VARCHAR') THEN 'type' END AS rule FROM good, (SELECT unnest([{_LOC}]) AS l) WHERE json_type(j, '$.songs[0].title') = 'OBJECT') WHERE rule IS NOT NULL""")
def s01_catalogue_rules(t):
    """Every value of every document that breaks a rule, by its path."""
    docs = _made(t, _DOCS)
    return L.check_catalogue(docs, "doc_id", "doc")[1]


_LOOSE = """SELECT event_id AS doc_id, concat('{"id":', CASE event_id % 5 WHEN 0 THEN concat('"', event_id, ' "') WHEN 1 THEN '-4' WHEN 2 THEN 'true' ELSE CAST(event_id AS STRING) END, ',"kind":', CASE event_id % 4 WHEN 0 THEN '"single"' WHEN 1 THEN '3' WHEN 2 THEN '"no such"' ELSE '9' END, ',"tags":', CASE event_id % 6 WHEN 0 THEN '"Pop, r-x"' WHEN 1 THEN '"5"' WHEN 2 THEN '["POP","hard hardcore,none"]' WHEN 3 THEN '12' WHEN 4 THEN '""' ELSE '{}' END, ',"title":', CASE event_id % 7 WHEN 0 THEN '" plain "' WHEN 1 THEN '{"en":"a","fr":{"text":"b","primary":true}}' WHEN 2 THEN '[{"locale":"ja","title":"c","fallback":true},{"locale":"ja","title":"c","fallback":true}]' WHEN 3 THEN '{"attributes":{"name":"d"}}' WHEN 4 THEN '{"en":"","ko":7}' WHEN 5 THEN '[]' ELSE '{"en":{"text":"e"},"fr":{"text":"f"}}' END, '}') AS doc FROM events"""
_KINDS = {"SINGLE": 0, "EP": 1, "ALBUM": 2, "COMPILATION": 3}
_TAGS = {"POP": 32, "HARD_HARDCORE": 8388608}


@query(f"WITH d AS ({_LOOSE}) SELECT doc_id, CASE WHEN doc_id % 5 NOT IN (1, 2) AND doc_id > 0 THEN doc_id END AS id, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 END AS kind, CASE doc_id % 6 WHEN 1 THEN 5 WHEN 2 THEN 32 | 8388608 WHEN 3 THEN 12 WHEN 4 THEN 0 END AS tags FROM d")
def s04_loose_values(t):
    """Ids, enums and flags in any of their loose forms; null where they break their rule."""
    d = _made(t, _LOOSE).withColumn("v", F.try_parse_json("doc"))
    return d.select("doc_id", L.as_id(L.get(F.col("v"), "id")).alias("id"), L.as_enum(L.get(F.col("v"), "kind"), _KINDS).alias("kind"), L.as_flags(L.get(F.col("v"), "tags"), _TAGS).alias("tags"))


@query("""SELECT event_id AS doc_id, unnest(CASE event_id % 7 WHEN 0 THEN ['1|plain|true|-|$.title'] WHEN 1 THEN ['2|a|false|-|$.title.en', '8|b|true|-|$.title.fr'] WHEN 2 THEN ['64|c|true|-|$.title[0]', '64|c|true|-|$.title[1]'] WHEN 3 THEN ['1|d|true|-|$.title.attributes'] WHEN 4 THEN ['2|-|false|empty|$.title.en', '128|-|false|type|$.title.ko'] WHEN 5 THEN [] ELSE ['2|e|false|-|$.title.en', '8|f|false|-|$.title.fr'] END) AS title FROM events""")
def x23_title_forms(t):
    """Titles of all loose forms with their locale, fallback and path, or the rule that they break."""
    d = _made(t, _LOOSE).select("doc_id", L.get(F.try_parse_json("doc"), "title").alias("v"), F.lit("$.title").alias("p"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return L.title_rows(d, "v", "p").select("doc_id", F.concat_ws("|", *map(text, ("locale", "title", "fallback", "rule", "path"))).alias("title"))
