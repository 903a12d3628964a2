"""A batch match planned, applied and run again."""

import json

from pyspark.sql import functions as F

from shelfmark.plans import applying as P
from shelfmark.plans import matching as M

ENTRY = "entry_id long, source_id int, core_title string, raw_duration long, artists array<int>, apple_id string, isrc string"
EMPTY = {
    "mappings": "entry_id long, song_id long, method string, confidence double, status string",
    "issues": "issue_id long, entry_id long, song_id long, method string, reason string, details string",
    "groups": "group_id long, status string, method string, confidence double, members long, codes long, min_duration long, max_duration long",
    "members": "group_id long, entry_id long",
    "group_issues": "group_id long, issue_id long",
}


def _rows(df):
    return sorted(str(r) for r in df.collect())


def test_details_are_equal_as_json(spark):
    d = spark.createDataFrame([('{"b": 1, "a": [2, null]}',), ('{"a":[2,null],"b":1}',), ("no json",), (None,), ('{"a":1,"a":2}',)], "d string")
    got = [r.c for r in d.select(P.canonical(F.col("d")).alias("c")).collect()]
    assert got[0] == got[1] == '{"a":[2,null],"b":1}' and got[2:] == ["no json", None, '{"a":1,"a":2}']


def test_a_batch_is_planned_applied_and_not_applied_twice(spark):
    entries = spark.createDataFrame([
        (1, 1, "one", 1000, [1], "AM1", None), (2, 1, "two", 1000, [2], None, "IS2"), (3, 1, "three", 9000, [2], None, "IS2"),
        (4, 1, "new", 5000, [3], None, None), (5, 1, "new", 6000, [3], None, None), (6, 1, "lone", 5000, [4], None, None),
        (7, 2, "one", 1000, [1], "AM1", None), (8, 9, "one", 1000, [1], "AM1", None), (9, 1, "one", 1000, [1], "AM1", None),
    ], ENTRY)
    songs = spark.createDataFrame([(10, "one", 1000, [1]), (20, "two", 1000, [2])], "song_id long, normalized_title string, duration long, artists array<int>")
    codes = spark.createDataFrame([(10, 1, "AM1"), (20, 0, "IS2")], "song_id long, authority int, authority_code string")
    sources = spark.createDataFrame([(1, 1), (2, 0)], "source_id int, source_type int")
    tables = {n: spark.createDataFrame([], s) for n, s in EMPTY.items()}
    tables["mappings"] = spark.createDataFrame([(9, 20, "MANUAL", 1.0, "confirmed"), (2, 20, "EXACT", 0.5, "pending")], EMPTY["mappings"])
    tables["groups"] = spark.createDataFrame([(3, "verified", None, None, 2, 0, 0, 0), (7, "pending", None, None, 1, 0, 0, 0)], EMPTY["groups"])
    tables["members"] = spark.createDataFrame([(3, 4), (3, 5), (7, 6)], EMPTY["members"])

    changes = P.match_batch(tables, entries, songs, codes, sources)
    assert _rows(changes["rejected"]) == sorted(map(str, [r for r in spark.createDataFrame([(7, 2, "source type not matched"), (8, 9, "source not found")], "entry_id long, source_id int, error string").collect()]))
    acts = {(r.entry_id, r.song_id): (r.action, r.status) for r in changes["mappings"].collect()}
    assert acts == {(1, 10): ("inserted", "confirmed"), (9, 10): ("skipped", "confirmed"), (2, 20): ("updated", "pending"), (3, 20): ("inserted", "pending")}
    assert {(r.group_id, r.label, r.members, r.method, r.confidence, r.action) for r in changes["groups"].collect()} == {(8, 4, 2, "EXACT", 0.9, "inserted"), (7, 6, 1, None, None, "kept")}
    reasons = {(r.entry_id, r.reason) for r in changes["issues"].collect()}
    assert {(2, "TITLE_CONFLICT"), (2, "DURATION_MISMATCH"), (3, "TITLE_CONFLICT"), (3, "DURATION_MISMATCH"), (4, "NO_CANDIDATE"), (5, "NO_CANDIDATE"), (6, "NO_CANDIDATE")} <= reasons

    stage = {(r.entry_id, r.reason): json.loads(r.details) for r in changes["issues"].where("song_id IS NOT NULL").collect()}
    assert stage == {(3, "TITLE_CONFLICT"): {"normalized_incoming_title": "three", "normalized_candidate_titles": ["two"]}, (3, "DURATION_MISMATCH"): {"incoming_duration_ms": 9000, "candidate_duration_ms": 1000, "difference_ms": 8000, "tolerance_ms": 2000}}

    after = P.apply_changes(tables, changes)
    after = {n: spark.createDataFrame(after[n].collect(), after[n].schema) for n in [*EMPTY, "log"]}
    assert {(r.group_id, r.entry_id) for r in after["members"].collect()} == {(3, 4), (3, 5), (7, 6), (8, 4), (8, 5)}
    assert after["group_issues"].count() == 3 and after["log"].where("operation = 'UPDATE'").count() == 1
    assert after["issues"].select("issue_id").distinct().count() == after["issues"].count() == changes["issues"].count()

    again = P.match_batch(after, entries, songs, codes, sources)
    assert {r.action for r in P.change_counts({k: v for k, v in again.items() if k != "rejected"}).collect()} <= {"kept", "untouched", "skipped"}
    twice = P.apply_changes(after, again)
    assert all(_rows(after[n]) == _rows(twice[n]) for n in EMPTY) and twice["log"].count() == 0


def test_two_confirmed_songs_of_one_entry_and_empty_plans(spark):
    planned = spark.createDataFrame([(1, 10, "EXACT", 0.98, "confirmed"), (1, 11, "APPLE", 1.0, "confirmed"), (2, 5, "APPLE", 1.0, "confirmed"), (2, 4, "APPLE", 1.0, "confirmed")], EMPTY["mappings"])
    none = spark.createDataFrame([], EMPTY["mappings"])
    assert {(r.entry_id, r.song_id, r.action) for r in P.mapping_changes(none, planned).collect()} == {(1, 10, "skipped"), (1, 11, "inserted"), (2, 4, "inserted"), (2, 5, "skipped")}
    tables = {n: spark.createDataFrame([], s) for n, s in EMPTY.items()}
    plan = {"mappings": none, "issues": tables["issues"], "groups": tables["members"], "entries": spark.createDataFrame([], ENTRY)}
    assert P.change_counts(P.plan_changes(tables, plan)).count() == 0
    assert M.conflict_counts(spark.createDataFrame([], ENTRY), "isrc").count() == 0
