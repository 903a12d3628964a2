"""Registered queries of the batch match plan: conflicts counted without pairs, and the plan applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixtures import _parts
from .plans import applying as P
from .plans import matching as M
from .queries import _ISRC, _coded_docs, query

# one to nine artists of 41 for each document, none for every eleventh
_WHO = "CASE WHEN doc_id % 11 = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1 + doc_id % 9), lambda x: CAST((doc_id * 7 + x * x * 13) % 41 AS INT)))) END"


def _docs_by_artists(t) -> DataFrame:
    k = F.col("entry_id")
    some = F.transform(F.sequence(F.lit(0).cast("long"), k % 9), lambda x: ((k * 7 + x * x * 13) % 41).cast("int"))
    return _coded_docs(t).withColumn("artists", F.when(k % 11 == 0, F.array().cast("array<int>")).otherwise(F.array_distinct(some)))


@query(f"""WITH d AS (SELECT *, {_WHO.replace("doc_id", "entry_id")} AS who FROM ({_ISRC}) WHERE isrc IS NOT NULL), k AS (SELECT isrc AS code, core_title, raw_duration AS ms, who, min(entry_id) AS id, count(*) AS n FROM d GROUP BY ALL),
ends AS (SELECT code, min(ms) AS low, max(ms) AS high, min_by(id, [ms, id]) AS short, min_by(id, [-ms, id]) AS long FROM k GROUP BY code),
p AS (SELECT a.id, a.code, a.n AS members, a.ms, b.id AS other, b.n, a.core_title <> b.core_title AS title, abs(a.ms - b.ms) > 2000 AS duration, len(a.who) > 0 AND len(b.who) > 0 AND NOT list_has_any(a.who, b.who) AS artist FROM k a JOIN k b USING (code))
SELECT id AS entry_id, code, members, CAST(coalesce(sum(n) FILTER (title), 0) AS BIGINT) AS title_partners, CAST(coalesce(sum(n) FILTER (duration), 0) AS BIGINT) AS duration_partners, CAST(coalesce(sum(n) FILTER (artist), 0) AS BIGINT) AS artist_partners, min(other) FILTER (title) AS title_other, CASE WHEN ms - any_value(low) > 2000 THEN any_value(short) WHEN any_value(high) - ms > 2000 THEN any_value(long) END AS duration_other
FROM p JOIN ends USING (code) GROUP BY id, code, members, ms""")
def m09_conflict_counts(t):
    """Of every content of a code: how many entries disagree on title, length and artists; no pairs are made."""
    return M.conflict_counts(_docs_by_artists(t), "isrc")


# the plan applied: orders are entries, customers songs and groups, events issues; a third of what is planned exists

_HAD = {
    "mappings": "SELECT o_orderkey AS entry_id, CASE WHEN o_orderkey % 9 = 0 THEN o_custkey + 1 ELSE o_custkey END AS song_id, CASE WHEN o_orderkey % 2 = 0 THEN 'EXACT' ELSE 'FUZZY' END AS method, CAST(0.9 AS DOUBLE) AS confidence, CASE o_orderkey % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status FROM orders WHERE o_orderkey % 3 = 0",
    "issues": "SELECT event_id AS issue_id, user_id AS entry_id, CASE WHEN event_id % 3 = 0 THEN event_id % 7 END AS song_id, CASE WHEN event_id % 2 = 0 THEN 'EXACT' END AS method, event_type AS reason, props AS details FROM events WHERE event_id % 4 = 0",
    "groups": "SELECT c_custkey AS group_id, CASE WHEN c_custkey % 8 = 0 THEN 'verified' ELSE 'pending' END AS status, CAST(NULL AS STRING) AS method, CAST(NULL AS DOUBLE) AS confidence, CAST(0 AS BIGINT) AS members, CAST(0 AS BIGINT) AS codes, CAST(0 AS BIGINT) AS min_duration, CAST(0 AS BIGINT) AS max_duration FROM customer WHERE c_custkey % 2 = 0",
    "members": "SELECT o_custkey AS group_id, o_orderkey AS entry_id FROM orders WHERE o_custkey % 2 = 0 AND NOT (o_custkey % 6 = 0 AND o_orderkey % 5 = 0)",
    "group_issues": "SELECT o_custkey AS group_id, event_id AS issue_id FROM orders JOIN (SELECT event_id, user_id FROM events WHERE event_id % 8 = 0) AS e ON user_id = o_orderkey WHERE o_custkey % 2 = 0",
}
_PLANNED = {
    "mappings": "SELECT o_orderkey AS entry_id, o_custkey AS song_id, 'EXACT' AS method, CAST(0.9 AS DOUBLE) AS confidence, CASE WHEN o_orderkey % 2 = 0 THEN 'confirmed' ELSE 'pending' END AS status FROM orders UNION ALL SELECT o_orderkey, o_custkey + 2, 'APPLE', CAST(1.0 AS DOUBLE), 'confirmed' FROM orders WHERE o_orderkey % 8 = 0",
    "issues": "SELECT user_id AS entry_id, CASE WHEN event_id % 3 = 0 THEN event_id % 7 END AS song_id, CASE WHEN event_id % 2 = 0 THEN 'EXACT' END AS method, event_type AS reason, concat(' ', props, ' ') AS details FROM events",
    "groups": "SELECT o_orderkey AS entry_id, o_custkey AS group_id FROM orders",
    "entries": "SELECT o_orderkey AS entry_id, CAST(round(o_totalprice) AS BIGINT) AS raw_duration, CASE WHEN o_custkey % 4 = 1 THEN o_orderpriority END AS isrc FROM orders",
}


def _made(t, sqls: dict[str, str]) -> dict[str, DataFrame]:
    out = {}
    for name, sql in sqls.items():
        used = [n for n in ("orders", "events", "customer") if f"FROM {n}" in sql]
        for n in used:
            sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}")
        out[name] = t.spark.sql(sql, **{n: getattr(t, n) for n in used})
    return out


_CHANGES = f"""WITH {", ".join(f"had_{n} AS MATERIALIZED ({s})" for n, s in _HAD.items())}, {", ".join(f"planned_{n} AS MATERIALIZED ({s})" for n, s in _PLANNED.items())},
judged AS (SELECT p.*, h.method AS old_method, h.confidence AS old_confidence, h.status AS old_status, coalesce((SELECT min(c.song_id) FROM had_mappings c WHERE c.entry_id = p.entry_id AND c.status = 'confirmed'), (SELECT min_by(q.song_id, -q.confidence) FROM planned_mappings q WHERE q.entry_id = p.entry_id AND q.status = 'confirmed')) AS owner FROM planned_mappings p LEFT JOIN had_mappings h USING (entry_id, song_id)),
mappings AS (SELECT *, CASE WHEN status = 'confirmed' AND owner <> song_id THEN 'skipped' WHEN old_status IN ('confirmed', 'rejected') THEN 'untouched' WHEN old_status IS NULL THEN 'inserted' WHEN old_method = method AND old_confidence = confidence AND old_status = status THEN 'kept' ELSE 'updated' END AS action FROM judged),
kinds AS (SELECT DISTINCT entry_id, song_id, method, reason, CAST(json(details) AS VARCHAR) AS details FROM planned_issues),
had AS (SELECT entry_id, song_id, method, reason, CAST(json(details) AS VARCHAR) AS details, min(issue_id) AS issue_id FROM had_issues GROUP BY ALL),
issues AS (SELECT k.*, h.issue_id AS old_id FROM kinds k LEFT JOIN had h ON h.entry_id IS NOT DISTINCT FROM k.entry_id AND h.song_id IS NOT DISTINCT FROM k.song_id AND h.method IS NOT DISTINCT FROM k.method AND h.reason = k.reason AND h.details = k.details),
old_sets AS (SELECT group_id, list(entry_id ORDER BY entry_id) AS s FROM had_members WHERE group_id IN (SELECT group_id FROM had_groups WHERE status = 'pending') GROUP BY group_id),
new_sets AS (SELECT group_id AS label, list(entry_id ORDER BY entry_id) AS s FROM planned_groups GROUP BY group_id),
same AS (SELECT label, min(o.group_id) AS old_id FROM new_sets n LEFT JOIN old_sets o USING (s) GROUP BY label),
groups AS (SELECT label, old_id, CASE WHEN old_id IS NULL THEN (SELECT max(group_id) FROM had_groups) + row_number() OVER (PARTITION BY old_id IS NULL ORDER BY label) ELSE old_id END AS group_id FROM same)"""


@query(f"""{_CHANGES}, links AS (SELECT DISTINCT label, groups.group_id, i.* FROM groups JOIN planned_groups p ON p.group_id = label JOIN issues i USING (entry_id))
SELECT 'mappings' AS part, action, count(*) AS n FROM mappings GROUP BY ALL UNION ALL SELECT 'issues', CASE WHEN old_id IS NULL THEN 'inserted' ELSE 'kept' END, count(*) FROM issues GROUP BY ALL UNION ALL SELECT 'groups', CASE WHEN old_id IS NULL THEN 'inserted' ELSE 'kept' END, count(*) FROM groups GROUP BY ALL UNION ALL SELECT 'members', 'inserted', count(*) FROM groups JOIN planned_groups p ON p.group_id = label WHERE old_id IS NULL HAVING count(*) > 0 UNION ALL SELECT 'group_issues', 'inserted', count(*) FROM links l WHERE NOT EXISTS (SELECT 1 FROM had_group_issues h WHERE h.group_id = l.group_id AND h.issue_id = l.old_id) HAVING count(*) > 0""")
def m17_plan_counts(t):
    """The dry run: what a plan would insert, update, keep, skip and leave, by table."""
    return P.change_counts(P.plan_changes(_made(t, _HAD), _made(t, _PLANNED)))


@query(f"""{_CHANGES}, facts AS (SELECT g.group_id AS label, count(*) AS members, count(DISTINCT isrc) AS codes, min(raw_duration) AS low, max(raw_duration) AS high FROM planned_groups g JOIN planned_entries USING (entry_id) GROUP BY g.group_id)
SELECT 'mappings' AS part, entry_id AS id, concat_ws('|', song_id, method, confidence, status) AS value FROM had_mappings h WHERE NOT EXISTS (SELECT 1 FROM mappings m WHERE m.entry_id = h.entry_id AND m.song_id = h.song_id AND action IN ('inserted', 'updated')) UNION ALL SELECT 'mappings', entry_id, concat_ws('|', song_id, method, confidence, status) FROM mappings WHERE action IN ('inserted', 'updated')
UNION ALL SELECT 'issues', entry_id, concat_ws('|', coalesce(CAST(song_id AS VARCHAR), '-'), coalesce(method, '-'), reason, CAST(json(details) AS VARCHAR)) FROM (SELECT entry_id, song_id, method, reason, details FROM had_issues UNION ALL SELECT entry_id, song_id, method, reason, details FROM issues WHERE old_id IS NULL)
UNION ALL SELECT 'groups', group_id, concat_ws('|', status, '-', '-', members, codes, min_duration, max_duration) FROM had_groups UNION ALL SELECT 'groups', group_id, concat_ws('|', 'pending', CASE WHEN members > 1 THEN 'EXACT' ELSE '-' END, CASE WHEN members = 1 THEN '-' WHEN codes > 0 THEN '0.98' ELSE '0.9' END, members, codes, low, high) FROM groups JOIN facts USING (label) WHERE old_id IS NULL
UNION ALL SELECT 'members', group_id, CAST(entry_id AS VARCHAR) FROM had_members UNION ALL SELECT 'members', g.group_id, CAST(entry_id AS VARCHAR) FROM groups g JOIN planned_groups p ON p.group_id = label WHERE old_id IS NULL
UNION ALL SELECT 'log', entry_id, concat_ws('|', CASE action WHEN 'inserted' THEN 'INSERT' ELSE 'UPDATE' END, song_id, coalesce(old_method, '-'), coalesce(old_status, '-'), method, status) FROM mappings WHERE action IN ('inserted', 'updated')""")
def m17_plan_applied(t):
    """The tables after the plan, and the log of its mappings."""
    tables = _made(t, _HAD)
    d = P.apply_changes(tables, P.plan_changes(tables, _made(t, _PLANNED)))
    row = "struct<entry_id:long,song_id:long,method:string,status:string>"
    log = d["log"].where("table_name = 'mappings'").select("operation", F.from_json("old_row", row).alias("old"), F.from_json("new_row", row).alias("new"))
    issue = d["issues"].withColumn("details", P.canonical(F.col("details")))
    e, g = F.col("entry_id"), F.col("group_id")
    return _parts(("mappings", d["mappings"], e, ["song_id", "method", "confidence", "status"]), ("issues", issue, e, ["song_id", "method", "reason", "details"]), ("groups", d["groups"], g, ["status", "method", "confidence", "members", "codes", "min_duration", "max_duration"]), ("members", d["members"], g, ["entry_id"]), ("log", log, F.col("new.entry_id"), ["operation", "new.song_id", "old.method", "old.status", "new.method", "new.status"]))
