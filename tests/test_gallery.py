"""The gallery's tree, its order of groups, and pages beyond the last."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from shelfmark import gallery_queries
from shelfmark.fixtures import Tables
from shelfmark.plans import gallery as G


def _songs(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, genre_tag long, vocal int, release_date date, locales array<int>")


def test_every_bit_counts_under_its_genre_and_all_above(spark):
    d = spark.createDataFrame([(256 | 1099511627776,), (0,), (None,)], "bits long").select(G.genre_keys(F.col("bits")).alias("k"))
    assert [r.k for r in d.collect()] == [["dance", "bass", "color-bass", "trap"], [], []]
    nodes = {n["key"]: n for n in G.tree(G.GENRES)}
    assert [nodes[k]["depth"] for k in ("dance", "bass", "color-bass", "trap", "r-and-b", "lo-fi")] == [0, 1, 2, 1, 0, 1]
    assert {n["key"]: n["own"] for n in G.tree(G.LOCALES)}["chinese"] == [8192, 16384, 32768]


def test_years_are_newest_first_and_groups_in_the_order_of_the_catalogue(spark):
    day = lambda y: datetime.date(y, 5, 1)
    s = _songs(spark, [(1, "a", 1, 0, day(2019), [8]), (2, "b", 4, 9, day(2023), []), (3, "c", 0, None, day(2026), [7, None]), (4, None, 1, 4, None, None)])
    got = G.groups(G.memberships({"songs": s})).orderBy("group_by", "ordinal").collect()
    shown = lambda g: [(r.label, r.total) for r in got if r.group_by == g]
    assert shown("year") == [("2020s", 2), ("2026", 1), ("2023", 1), ("2010s", 1), ("2019", 1), ("Unknown", 1)]
    assert shown("genre") == [("Classical", 2), ("Dance", 1)]
    assert shown("locale") == [("French", 1), ("Undefined", 3)]
    assert shown("vocal") == [("Acoustic", 1), ("Unknown", 1)]
    assert G.groups(G.memberships({"songs": s.limit(0)})).count() == 0


def test_a_page_beyond_the_last_is_the_first_and_nulls_come_last(spark):
    s = _songs(spark, [(i, None if i == 1 else f"T{i % 2}", 1, 0, None, None) for i in range(5)])
    m = G.memberships({"songs": s}, {"songs": ["genre"]})
    ids = lambda page: [(r.page, r.id) for r in G.pages(m, page, 2).orderBy("position").collect()]
    assert ids(1) == [(1, 0), (1, 2)] and ids(3) == [(3, 1)] and ids(4) == [(1, 0), (1, 2)]
    assert [r.id for r in G.pages(G.memberships({"songs": s}, {"songs": ["genre"]}, F.col("title") == "T1"), 1, 2).collect()] == [3]
    with pytest.raises(ValueError):
        G.memberships({"songs": s}, {"songs": ["tag"]})
    plan = G.pages(m, 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_links_are_cut_to_what_is_shown_before_they_are_summed_up(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    d = gallery_queries.G.gallery(gallery_queries.gallery_items(t), gallery_queries._links(t, "l_orderkey"), gallery_queries._links(t, "l_partkey"), gallery_queries._spark_sql(t, gallery_queries._TRACKS), page=2)
    lines = d._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(re.match(r"[\s:+|-]*", x)[0]) for x in lines]
    scans = [i for i, x in enumerate(lines) if "l_orderkey" in x and "Relation" in x]
    assert len(scans) == 5
    for i in scans:  # the nearest node above a scan of line items with a second input is the semi join
        above = [j for j in range(i) if all(depth[k] > depth[j] for k in range(j + 1, i + 1))][::-1]
        kinds = [lines[j].strip(" :+-") for j in above if "Aggregate" in lines[j] or "Join" in lines[j]]
        assert kinds[0].startswith("Join LeftSemi"), kinds[:2]
