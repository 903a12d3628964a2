"""Stand-in views over the driver's tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "songs_v": "SELECT p_partkey + 1 AS song_id, p_name AS title, lower(p_name) AS normalized_title, CAST(round(p_retailprice * 100) AS BIGINT) AS duration, CAST(p_size AS BIGINT) AS genre_tag FROM part",
    "song_artists_v": "SELECT p_partkey + 1 AS song_id, CAST(substr(p_brand, 7) AS INT) AS artist_id, 0 AS display_order FROM part UNION ALL SELECT p_partkey + 1, 101 + CAST(p_partkey % 9 AS INT), 1 FROM part WHERE p_partkey % 2 = 0",
    "song_authorities_v": "SELECT p_partkey + 1 AS song_id, 1 AS authority, concat('AM', CAST(p_partkey AS STRING)) AS authority_code FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey + 1, 0, concat('IS', CAST(p_partkey AS STRING)) FROM part WHERE p_partkey % 7 = 0",
    "entries_v": "SELECT p_partkey + 100001 AS entry_id, CASE WHEN p_partkey % 4 = 0 THEN concat(p_name, ' (feat. ', p_type, ')') ELSE p_name END AS raw_title, p_name AS core_title, CAST(round(p_retailprice * 100) AS BIGINT) + (p_partkey % 7 - 3) * 1000 AS raw_duration, CAST(substr(p_brand, 7) AS INT) AS artist_id, CASE WHEN p_partkey % 10 = 0 THEN concat('AM', CAST(p_partkey AS STRING)) END AS apple_id, CASE WHEN p_partkey % 42 = 0 THEN concat('IS', CAST(p_partkey + 7 AS STRING)) WHEN p_partkey % 21 = 0 THEN concat('IS', CAST(p_partkey AS STRING)) END AS isrc FROM part WHERE p_partkey % 3 = 0",
    "titles_v": "SELECT doc_id - doc_id % 4 AS owner_id, CASE lang WHEN 'en' THEN 2 WHEN 'es' THEN 4 WHEN 'fr' THEN 8 ELSE 1 END AS locale, doc_id % 5 = 0 AS fallback, text AS title, doc_id FROM documents",
    "doc_entries_v": "SELECT doc_id AS entry_id, lower(text) AS core_title, lang AS artist, n_chars AS raw_duration FROM documents",
    "before_v": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
    "after_v": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 50 <> 7 UNION ALL SELECT o_orderkey + 10000000, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 100 = 3",
    "plays_old_v": "SELECT user_id AS song_id, count(*) AS play_count FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id",
    "plays_new_v": "SELECT user_id AS song_id, count(*) AS play_count FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND event_type <> 'error' GROUP BY user_id",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Tables:
    """The driver's tables and the stand-in views of one folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        used = [t for t in TABLES if re.search(rf"\bFROM {t}\b", VIEWS[name])]
        sql = VIEWS[name]
        for t in used:
            sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
        return self.spark.sql(sql, **{t: getattr(self, t) for t in used})


def with_views(sql: str) -> str:
    """The SQL with the views that it names as common table expressions."""
    used = [f"{n} AS ({v})" for n, v in VIEWS.items() if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    return f"WITH {', '.join(used)}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {', '.join(used)} {sql}"


def _spark_sql(t, sql: str) -> DataFrame:
    used = [n for n in ("supplier", "lineitem", "part", "orders") if f"FROM {n}" in sql]
    sql = sql.replace(" // ", " DIV ")
    for n in used:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}")
    return t.spark.sql(sql, **{n: getattr(t, n) for n in used})


def _parts(*parts: tuple[str, DataFrame, Column, list]) -> DataFrame:
    """(part, id, value) of several tables: value joins columns, null as nothing."""
    text = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("-"))
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("part"), key.cast("long").alias("id"), F.concat_ws("|", *map(text, cols)).alias("value")) for name, df, key, cols in parts])
