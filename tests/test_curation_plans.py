"""Plans over many tables: merges, claims, groups, ranges; edge cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.curation_queries import merge_tables, song_tables
from shelfmark.fixtures import Tables
from shelfmark.operators.aggregates import chained, representative
from shelfmark.plans import groups as R
from shelfmark.plans import merging as G
from shelfmark.plans import songs as N
from shelfmark.sources import loose as L


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_chains_cycles_and_bad_targets(spark):
    chain = [(k, k + 1) for k in range(1, 40)]
    t = spark.createDataFrame([*chain, (100, 101), (101, 102), (102, 100), (99, 100), (200, 200), (199, 200), (300, 1), (300, 2), (None, 3), (4, None)], "source long, target long")
    closed, errors = G.close_targets(t)
    assert pairs(closed) == [(k, 40) for k in range(1, 40)]
    assert pairs(errors) == [(99, "cycle"), (100, "cycle"), (101, "cycle"), (102, "cycle"), (199, "merged into itself"), (200, "merged into itself"), (300, "several targets")]
    closed, errors = G.close_targets(t.where("false"))
    assert closed.count() == errors.count() == 0


def test_preview_counts_what_is_applied(spark):
    tables, targets = merge_tables(Tables(spark, "/root/testdata/sf0.001"))
    plan = G.merge_plan(tables, targets)
    after = G.apply_merge(tables, plan)
    n = {(r.part, r.action): r.n for r in G.merge_counts(plan).groupBy("part", "action").agg(F.sum("n").alias("n")).collect()}
    gone = [r.source for r in plan["closed"].collect()]
    had = lambda name: tables[name].where(F.col("artist_id").isin(gone)).count()
    assert after["codes"].count() == tables["codes"].count() - had("codes") + n.get(("codes", "move"), 0)
    assert after["aliases"].count() == tables["aliases"].count() - had("aliases") + n["names", "add"]
    assert after["relations"].count() == tables["relations"].count() - n["relations", "delete"]
    assert n["song_artists", "move"] == had("song_artists") and after["song_artists"].where(F.col("artist_id").isin(gone)).count() == 0


def test_claims_by_shared_codes_and_songs(spark):
    groups = spark.createDataFrame([(1, None), (2, None), (3, 9), (4, None), (5, 8), (6, None), (7, 9)], "group_id long, song_id long")
    codes = spark.createDataFrame([(1, 0, "x"), (2, 0, "x"), (2, 1, "y"), (3, 1, "y"), (4, 0, "z"), (5, 0, "z"), (6, 0, None), (4, 1, "x")], "group_id long, authority int, code string")
    owned = spark.createDataFrame([(7, 0, "z"), (70, 5, "q")], "song_id long, authority int, code string")
    assert pairs(N.settle_claims(groups, codes, owned).select("group_id", "unit_id", "several")) == [(1, 1, False), (2, 1, False), (3, 1, False), (4, 4, True), (5, 4, True), (6, 6, False), (7, 1, False)]


@pytest.mark.parametrize("seed", [1, 2])
def test_chained_over_ranges(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), r.randrange(3), r.choice([None, *range(0, 4000, 7)]), i) for i in range(1500)]
    want, last = [], {}
    for k, j, v, i in sorted((x for x in rows if None not in x), key=lambda x: (x[0], x[1], x[2], x[3])):
        if (k, j) in last and v - last[k, j][0] <= 5:
            want.append((i, last[k, j][1]))
        last[k, j] = (v, i)
    got = chained(spark.createDataFrame(rows, "k string, j int, v int, i int"), ["k", "j"], "v", "i", 5)
    assert pairs(got) == sorted(want)


def test_relabelling_equals_a_full_computation(spark):
    r = random.Random(5)
    edges = {tuple(sorted(r.sample(range(80), 2))) for _ in range(50)}
    removed = set(r.sample(sorted(edges), 12))
    added = {tuple(sorted(r.sample(range(90), 2))) for _ in range(8)}
    frame = lambda s: spark.createDataFrame(sorted(s), "a long, b long")
    nodes = spark.range(80)
    got = R.relabel(R.components(frame(edges), nodes), frame(edges), frame(added), frame(removed), nodes)
    every = spark.range(80).union(frame(added).select(F.explode(F.array("a", "b")))).distinct().toDF("id")
    assert pairs(got.select("id", "label")) == pairs(R.components(frame((edges - removed) | added), every).select("id", "label"))


def test_representative_of_many_values(spark):
    rows = [("once", v) for v in (5, 1, 9, 7)] + [("twice", v) for v in (8, 8, 3, 3, 1)] + [("none", None)]
    got = dict(pairs(representative(spark.createDataFrame(rows, "k string, v long"), "k", "v")))
    assert got == {"once": 5, "twice": 3}


def test_loose_values_of_odd_documents(spark):
    docs = [(1, "{"), (2, "[]"), (3, "7"), (4, None), (5, '{"source":"s","time":"2024-01-01","artists":[7],"albums":[],"songs":{}}')]
    parts, bad = L.check_catalogue(spark.createDataFrame(docs, "doc_id int, doc string"), "doc_id", "doc")
    assert pairs(bad) == [(1, "$", "json"), (2, "$", "type"), (3, "$", "type"), (4, "$", "json"), (5, "$.artists[0]", "type"), (5, "$.songs", "type")]
    assert parts["artists"].count() == 1 and parts["songs"].count() == 0


def test_a_check_parses_each_document_once_and_tells_every_path(spark):
    docs = spark.createDataFrame([(1, '{"source":"a","time":"2024-01-05","artists":[],"albums":[7,{"id":"x","artistID":{"k":1}}],"songs":{"a":{}}}'), (2, "["), (3, None), (4, "[]"), (5, '{"source":null,"time":"noon","artists":[null],"albums":[],"songs":[]}')], "doc_id int, doc string")
    _, bad = L.check_catalogue(docs, "doc_id", "doc")
    assert bad._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    got = {tuple(r) for r in bad.where("rule <> 'missing'").collect()}
    assert got == {(1, "$.songs", "type"), (1, "$.albums[0]", "type"), (1, "$.albums[1].artistID", "type"), (1, "$.albums[1].artistID.k", "type"), (2, "$", "json"), (3, "$", "json"), (4, "$", "type"), (5, "$.source", "null"), (5, "$.time", "date"), (5, "$.artists[0]", "type")}


def test_groups_without_a_claim_are_no_nodes(spark, monkeypatch):
    sizes, real = [], N.components
    monkeypatch.setattr(N, "components", lambda edges, nodes: sizes.append(nodes.count()) or real(edges, nodes))
    groups = spark.range(1, 51).selectExpr("id AS group_id", "CASE WHEN id = 50 THEN 7 END AS song_id")
    codes = spark.createDataFrame([(3, 0, "x"), (2, 0, "x"), (99, 0, "x")], "group_id long, authority int, code string")
    owned = spark.createDataFrame([(7, 0, "z")], "song_id long, authority int, code string")
    got = pairs(N.settle_claims(groups, codes, owned))
    assert got == [(i, 2 if i == 3 else i, 7 if i == 50 else None, False) for i in range(1, 51)]
    assert sizes[0] <= 8  # groups 2, 3 and 50, their code (from each group) and song


def test_entries_are_dealt_by_order_and_titles_by_entry_once(spark):
    entries, children, _ = song_tables(Tables(spark, "/root/testdata/sf0.001"))
    for df in (entries, children["titles"], children["artists"]):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    joined = children["titles"].join(spark.range(5).selectExpr("id AS entry_id").hint("merge"), "entry_id")
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_issues_come_once_without_telling_all_links_apart(spark):
    members = spark.createDataFrame([(1, 10), (1, 11), (1, 10), (2, 11), (3, None)], "group_id long, entry_id long")
    issues = spark.createDataFrame([(7, 10), (7, 11), (8, 10), (8, 10), (9, 12), (5, None), (None, 10), (None, 11)], "issue_id long, entry_id long")
    got = R.issue_links(members, issues)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 7), (2, 7), (1, 8), (1, None), (2, None)], key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and plan.splitlines()[1].startswith(":- Project")  # links of issues with one entry go out as joined
