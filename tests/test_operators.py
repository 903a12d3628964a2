"""Golden rows, refusals and properties of operators, functions and readers."""

import json
import plistlib
import random
from difflib import SequenceMatcher

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark import queries
from shelfmark.functions import codecs as C
from shelfmark.functions import text as X
from shelfmark.functions.similarity import title_similarity
from shelfmark.operators import aggregates as A
from shelfmark.operators import joins as J
from shelfmark.operators import predicates as P
from shelfmark.plans import changes as D
from shelfmark.plans import curation as K
from shelfmark.plans import matching as M
from shelfmark.sources import files as S
from shelfmark.streaming.incremental import ingest_new_files


def one(spark, col_of, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(col_of(F.col("x"))).collect()]


def test_text_functions(spark):
    assert one(spark, X.normalize_text, "Ｓｏｎｇ　“Two”!!", None, "日日") == ["song 'two'!", "", "日日"]
    assert one(spark, X.normalize_title, "Song (feat. X)", "(without you)", "A [Club Mix]") == ["song ", "", "a "]
    assert one(spark, X.normalize_core_title, "Song (feat. X)", "Song ft. Y", "Song (without you)") == ["song", "song", "song (without you)"]
    assert one(spark, X.fold_latin, "Ærø ÇŁß", "é") == ["aero clss", "e"]
    assert one(spark, lambda c: X.parse_artists(c), "A & B, Jack & Jack,, C", "") == [["A", "B", "Jack & Jack", "C"], []]
    assert one(spark, lambda c: X.guest_credits(c), "Song (feat. A & B) - with C", None) == [["a", "b", "c"], []]
    assert one(spark, X.simplify_punctuation, "a–b‚c", "dish//", "℃") == ["a-b'c", "dish/", "°C"]
    assert one(spark, X.strip_controls, "a\u0000b​c") == ["abc"]


def test_codecs(spark):
    assert one(spark, C.locale_bit, "en-US", "zh-Hant", "Cantonese", "-", "xx") == [2, 32768, 4096, 0, 1]
    assert one(spark, C.parse_duration, "3:05", "3:65", "x") == [185000, None, None]
    assert [str(d) for d in one(spark, C.to_date_tolerant, "2024-02-30", "2024-02-29T10:00:00Z", "1999", "1999-05")] == ["None", "2024-02-29", "1999-01-01", "1999-05-01"]
    assert one(spark, lambda c: C.encode_flags(c, {"POP": 1 << 5, "TRAP": 1 << 40}), "pop, trap", None, "none") == [(1 << 40) + 32, 0, 0]
    assert dict(C.genre_nodes())["ROCK"] == (1 << 7) + (1 << 35) + (1 << 36) + (1 << 37)
    assert [tuple(r) for r in one(spark, C.code_from_url, "https://open.spotify.com/track/abc?si=1")] == [("SPOTIFY", "abc")]
    assert one(spark, lambda c: F.transform(C.title_rows(c), lambda r: r["title"]), '{"en":"A","fr":"B"}', "Plain") == [["A", "B"], ["Plain"]]


def test_similarity_is_the_library_ratio(spark):
    pairs = [("abcd", "bcde"), ("", "x"), ("same", "same"), ("a" * 250, "ab" * 130)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(title_similarity(F.col("a"), F.col("b"))).collect()] == pytest.approx([SequenceMatcher(None, *p).ratio() for p in pairs])


def test_predicates_refuse(spark):
    df = spark.createDataFrame([(1,)], "n long")
    for bad in (dict(field="x", operator="eq", value=1), dict(field="n", operator="like", value=1), dict(field="n", operator="eq", value=-1)):
        with pytest.raises(ValueError):
            P.apply_rules(df, {"n": "number"}, [bad])
    with pytest.raises(ValueError):
        P.date_pred(F.col("n"), "eq", "2024-02-30")
    with pytest.raises(ValueError):
        P.text_pred(F.col("n"), "matches", "a*b*c*")
    with pytest.raises(ValueError):
        P.flag_pred(F.col("n"), 1 << 50)
    assert P.apply_rules(df, {"n": "flag"}, [dict(field="n", value=0)]).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-50, 50)), max_size=20), st.lists(st.tuples(st.integers(0, 3), st.integers(-50, 50)), max_size=20))
def test_band_join_equals_cross_join(spark, left, right):
    a = spark.createDataFrame([(i, *r) for i, r in enumerate(left)], "a long, k int, x int")
    b = spark.createDataFrame([(i, *r) for i, r in enumerate(right)], "b long, k int, y int")
    got = sorted((r.a, r.b) for r in J.equi_band_join(a, b, ["k"], "x", "y", 7).collect())
    assert got == sorted((i, j) for i, (k, x) in enumerate(left) for j, (q, y) in enumerate(right) if k == q and abs(x - y) <= 7)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=20))
def test_components_equal_union_find(spark, edges):
    parent = list(range(15))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = M.components(spark.createDataFrame(edges, "a long, b long"), spark.range(15))
    assert sorted(map(tuple, got.collect())) == [(i, find(i)) for i in range(15)]


def test_diff_then_apply_gives_after(spark):
    before = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (None, "n")], "k long, v string")
    after = spark.createDataFrame([(1, "a"), (2, "b"), (4, None), (None, "m")], "k long, v string")
    log = D.diff_snapshots(before, after, ["k"], "me", "why")
    assert sorted((r.k if r.k is not None else -1, r.operation) for r in log.collect()) == [(-1, "UPDATE"), (2, "UPDATE"), (3, "DELETE"), (4, "INSERT")]
    assert D.diff_snapshots(after, after, ["k"]).count() == 0
    keyed = lambda df: sorted(str(tuple(r)) for r in df.where("k IS NOT NULL").collect())
    some = log.where("k IS NOT NULL")
    assert keyed(D.apply_changes(before.where("k IS NOT NULL"), some, ["k"])) == keyed(after)


def test_waterfall_and_uniqueness(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "b", "z"), (4, None, "q")], "l long, t string, u string")
    right = spark.createDataFrame([(10, "A", "x"), (20, "b", "y"), (30, "c", "z"), (40, None, "q")], "r long, t string, u string")
    got = J.waterfall_merge(left, right, "l", "r", [["t"], ["u"]], ignore_case=True)
    assert sorted(str(tuple(x)) for x in got.collect()) == sorted(str(x) for x in [(1, 10, "both", 0), (2, 20, "both", 1), (3, 30, "both", 1), (4, 40, "both", 1)])


def test_artist_levels(spark):
    df = spark.createDataFrame([([1, 2], [2, 1]), ([1], [1, 2]), ([1, 3], [1, 2]), ([], [1]), ([3], [1])], "e array<int>, s array<int>")
    assert [r[0] for r in df.select(M.artist_level(F.col("e"), F.col("s"))).collect()] == ["exact", "subset", "partial", "none", "none"]


def test_recording_edges_reach_all_pairs(spark):
    rows = [(i, "t", "a", d) for i, d in enumerate([0, 1500, 3000, 9000, 10500])] + [(9, "", "a", 0), (10, "", "a", 0)]
    d = spark.createDataFrame(rows, "entry_id long, core_title string, artist string, raw_duration long")
    assert sorted(map(tuple, M.group_unmatched(d).collect())) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (9, 9), (10, 10)]


def test_paging_recovers_and_clamps(spark):
    df = spark.range(7).withColumn("v", -F.col("id"))
    assert [r.id for r in A.paginate(df, 99, 3, [("v", True)], "id").collect()] == [6, 5, 4]
    assert A.paginate(df, 1, 0, [], "id").count() == 1
    assert [r.legacy_id for r in A.sequence_ids(df, ["v"], "legacy_id").orderBy("v").collect()] == list(range(7))


def test_merge_rules(spark):
    cur = spark.createDataFrame([(1, 2, True, "A")], "owner_id long, locale int, fallback boolean, title string")
    new = spark.createDataFrame([(1, 2, "B"), (1, 8, "C"), (2, 4, "D"), (2, 8, "E"), (2, 8, "F")], "owner_id long, locale int, title string")
    assert sorted(map(tuple, K.merge_titles(cur, new).collect())) == [(1, 8, False, "C"), (2, 4, True, "D")]
    codes = spark.createDataFrame([(1, "x", 5)], "authority int, code string, owner long")
    add, bad = K.merge_codes(codes, spark.createDataFrame([(1, "x", 6), (1, "y", 6), (1, "x", 5)], "authority int, code string, owner long"))
    assert [r.code for r in add.collect()] == ["y"] and [(r.owner, r.owned_by) for r in bad.collect()] == [(6, 5)]


def catalogue():
    loc = lambda s: {"en": s}
    return {"source": "s", "time": "t", "artists": [{"id": "a1", "title": loc("A & B")}], "albums": [{"id": "b1", "title": loc("Album"), "artistID": ["a1", "a2"]}], "songs": [{"id": "s1", "title": loc("One"), "albumID": "b1", "artistID": ["a2", "a3"], "duration": 1000}, {"id": "s2", "title": None, "albumID": "gone", "artistID": ["a1"], "duration": 5}]}


def test_catalogue_readers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/c.json").write_text(json.dumps(catalogue()))
    got = S.read_catalogue(spark, str(tmp_path / "in/c.json"))
    assert [(r.table, r.pos, r.field) for r in got["violations"].collect()] == [("songs", 1, "title")]
    assert [r.name for r in got["special_names"].collect()] == ["A & B"]
    entries, issues = S.extract_entries(got["songs"], got["albums"])
    assert {r.source_item_id: r.artists for r in entries.collect()} == {"s1": ["a1", "a2", "a3"], "s2": ["a1"]}
    assert [r.path for r in issues.collect()] == ["$.songs[1].albumID"]
    for _ in range(2):  # the second run finds nothing new
        ingest_new_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_other_readers(spark, tmp_path):
    doc = {"Tracks": {"1": {"Track ID": 1, "Name": "A", "Year": 1999}, "2": {"Track ID": 2, "Name": "B"}, "3": {"Track ID": 3}}, "Playlists": [{"Name": "Library", "Playlist Items": [{"Track ID": 1}, {"Track ID": 2}]}]}
    (tmp_path / "l.plist").write_bytes(plistlib.dumps(doc))
    assert sorted((r.track_id, r.play_count, r.release_date) for r in S.read_plist(spark, str(tmp_path / "l.plist")).collect()) == [(1, 0, "1999-01-01"), (2, 0, "0001-01-01")]
    (tmp_path / "a.json").write_text(json.dumps({"7": {"us": "U", "tw": "T", "or": None, "ai": True, "alias": ["x"]}}))
    assert [(r.apple_id, r.title, r.tag) for r in S.read_artist_map(spark, str(tmp_path / "a.json")).collect()] == [("7", "U", 1)]
    S.write_csv(spark.createDataFrame([("b", 2), ("a", None)], "n string, v int"), str(tmp_path / "csv"), ["n"])
    back = S.read_first_existing(spark, [str(tmp_path / "none"), str(tmp_path / "csv")], "n string, v int, legacy_id long")
    assert sorted((r.legacy_id, r.n, r.v) for r in back.collect()) == [(0, "a", None), (1, "b", 2)]
    (tmp_path / "e.json").write_text(json.dumps([{"id": 1, "genre": "POP,TRAP", "titles": [{"locale": "en", "title": "x", "fallback": True}]}, {"id": -1, "genre": "", "titles": []}]))
    got = S.read_edited(spark, str(tmp_path / "e.json"))
    assert sorted((r.id, r.rule) for r in got["violations"].collect()) == [(-1, "fallback"), (-1, "id"), (-1, "titles")]
    pay = spark.createDataFrame([(json.dumps({"data": [{"id": "1", "type": "songs"}, {"id": "2", "type": "songs"}], "resources": {"songs": {"1": {"attributes": {"name": "N", "durationInMillis": 5}}, "9": {}}}}),), ("broken",)], "payload string")
    assert [tuple(r) for r in S.extract_payload(pay).collect()] == [("1", "N", 5, None)]
    html = '<script type="x" id="serialized-server-data">[{"data":{"sections":[{"id":"track-list - 1","items":[{"id":"track-lockup - 5","title":"T"},{"id":"other","title":"U"}]}]}}]</script>'
    assert [tuple(r) for r in S.extract_embedded_json(spark.createDataFrame([(1, html), (2, "<p>")], "page_id long, html string")).collect()] == [(1, "track-lockup - 5", "T")]
    assert not S.table_exists(spark, "nothing_here")


def test_band_links_and_nearest_without_pairs(spark):
    rng = random.Random(5)
    a = spark.createDataFrame([(i, rng.choice("xyz"), rng.randrange(30)) for i in range(120)], "a long, k string, x long")
    b = spark.createDataFrame([(i, rng.choice("xyw"), rng.randrange(30)) for i in range(150)], "b long, k string, y long")
    pairs = [(r.a, r.b, abs(r.x - r.y)) for r in J.equi_band_join(a, b, ["k"], "x", "y", 4).collect()]
    links = {i: [q for p, q, _ in pairs if p == i] for i in {p for p, _, _ in pairs}}
    got = J.band_links(a, b, ["k"], "x", "y", 4, "a", "b").collect()
    assert {r.a: (r.links, r.first) for r in got} == {i: (len(v), min(v)) for i, v in links.items()} and len(got) == len(links)
    value = {r.a: (r.k, r.x) for r in a.collect()}
    assert all(value[r.a] == value[r.class_id] and r.class_id <= r.a for r in got) and len({r.class_id for r in got}) < len(got)
    near = sorted(map(tuple, J.nearest_in_band(a, b, ["k"], "x", "y", 4, "a", "b", 3).collect()))
    assert near == sorted((i, q) for i in links for _, q in sorted((g, q) for p, q, g in pairs if p == i)[:3])


def test_ordered_array_by_all_its_order(spark):
    """Equal line, part and quantity: the flag decides, for every order of the rows."""
    d = spark.createDataFrame([(1, "R"), (1, None), (1, "A")], "n int, v string")
    for rows in (d, d.orderBy("v")):
        assert [r.v for r in rows.agg(A.ordered_array(["n", "v"], "v").alias("v")).selectExpr("explode(v) AS v").collect()] == [None, "A", "R"]


def test_first_audio_of_equal_entries_is_the_least(spark):
    songs = spark.createDataFrame([(1, None, ""), (2, None, "own")], "song_id long, release_date date, audio string")
    rows = [(1, 7, None, "b"), (1, 7, None, "a"), (1, 7, None, "c"), (1, 3, None, " "), (1, None, None, "A"), (2, 1, None, "x")]
    e = spark.createDataFrame(rows, "song_id long, entry_id long, release_date date, audio string")
    for d in (e, e.orderBy(F.desc("audio")), e.orderBy("audio")):
        assert {r.song_id: r.audio for r in K.merge_metadata(songs, d.coalesce(1)).collect()} == {1: "a", 2: "own"}


def test_flags_of_equal_lines_are_in_order(spark, tmp_path):
    rows = [(1, 1, 5, 2.0, f) for f in "RNA"] + [(1, 0, 9, 1.0, "R")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [r.flags for r in queries.QUERIES["a07_ordered_array"](spark, str(tmp_path)).collect()] == ["R,A,-,R"]


def test_album_among_equal_ones(spark):
    """Equal queries share an answer; of equal albums none stands out, in whatever number, unless one has more artists named."""
    titles = spark.createDataFrame([(i, t, t.lower(), 2, False) for i, t in [(1, "Blue"), (2, "Blue"), (3, "Blue"), (4, "Red"), (5, "Red"), (6, "Solo")]], "album_id long, title string, normalized_title string, locale int, fallback boolean")
    albums = spark.createDataFrame([(i, 3 if i == 5 else 1) for i in range(1, 7)], "album_id long, album_type int")
    have = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (3, 11), (4, 10), (6, 12)], "album_id long, artist_id int")
    names = spark.createDataFrame([(10, "Ann", "ann"), (11, "Bo", "bo"), (12, "Cy", "cy")], "artist_id int, name string, normalized string")
    asked = [(1, "Blue", ["Ann"]), (2, "Blue", ["Ann", "Bo"]), (3, "Blue", []), (4, "Red", ["Various Artists"]), (5, "SOLO", []), (6, "Blue", ["Ann", "Bo"]), (7, "None", []), (8, "Red", ["Ann"])]
    q = spark.createDataFrame([(i, t, t.lower(), a, [x.lower() for x in a]) for i, t, a in asked], "query_id long, title string, normalized_title string, artists array<string>, normalized_artists array<string>")
    got = {r.query_id: r.album_id for r in K.resolve_album(q, titles, albums, have, names).collect()}
    assert got == {1: None, 2: 3, 3: None, 4: 5, 5: 6, 6: 3, 7: None, 8: 4}


def test_pairs_of_a_band_counted_by_kind(spark):
    rng = random.Random(9)
    for width in (1, 8, 9, 10, 100):
        a = spark.createDataFrame([(i, rng.choice("xyz"), rng.choice([None, rng.randrange(-3 * width, 4 * width)]), rng.choice("tuv")) for i in range(90)], "a long, k string, x long, one string")
        b = spark.createDataFrame([(i, rng.choice("xyw"), rng.choice([None, rng.randrange(-3 * width, 4 * width)]), rng.choice("tuw")) for i in range(110)], "b long, k string, y long, two string")
        want = {}
        for p in a.collect():
            for q in b.collect():
                if p.k == q.k and p.x is not None and q.y is not None and abs(p.x - q.y) <= width:
                    n, i, j = want.get((p.one, q.two), (0, p.a, q.b))
                    want[p.one, q.two] = (n + 1, min(i, p.a), min(j, q.b))
        got = J.band_counts(a, b, ["k"], "x", "y", width, "one", "two", "a", "b").collect()
        assert {(r.one, r.two): (r.links, r.a, r.b) for r in got} == want and len(want) == 9
