"""Loading of nested documents: every rule, chains of documents left out, odd input, a second load, the way back."""

import json

import pytest

from shelfmark import queries  # noqa: F401  the registry comes first
from shelfmark import loading_queries
from shelfmark.fixtures import Tables
from shelfmark.plans import loading as N

SCHEMAS = {
    "artists": "artist_id bigint, artist_tag int, artwork string", "artist_titles": "artist_id bigint, locale int, title string, fallback boolean", "artist_alias": "artist_id bigint, alias string", "artist_authorities": "artist_id bigint, authority int, authority_code string", "artist_relations": "artist_id bigint, ref_artist_id bigint, relation_to_ref int",
    "albums": "album_id bigint, album_type int, artwork string, disc_count int, release_date date", "album_titles": "album_id bigint, locale int, title string, fallback boolean", "album_artists": "album_id bigint, artist_id bigint, display_order int", "album_authorities": "album_id bigint, authority int, authority_code string", "album_track_counts": "album_id bigint, disc_number int, track_count int",
    "songs": "song_id bigint, audio string, duration bigint, genre_tag bigint, release_date date", "song_titles": "song_id bigint, locale int, title string, fallback boolean", "song_artists": "song_id bigint, artist_id bigint, display_order int, display_title string, role int", "song_authorities": "song_id bigint, authority int, authority_code string", "song_locales": "song_id bigint, locale int, is_primary boolean", "album_tracks": "album_id bigint, song_id bigint, disc_number int, track_number int",
}
EN = {"en": {"text": "t", "primary": True}}


def tables(spark, **rows):
    return {n: spark.createDataFrame(rows.get(n, []), s) for n, s in SCHEMAS.items()}


def loaded(spark, docs, had):
    texts = spark.createDataFrame([(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)], "n long, text string")
    parts, broken = N.read_documents(texts, "n", "text")
    return N.load_plan(parts, had), sorted(r[0] for r in broken.collect())


def errors(plan):
    return sorted((r.kind, r.pos.doc_id, r.rule, r.detail) for r in plan["errors"].collect())


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def artist(i, **more):
    return {"id": i, "title": EN, "artistTag": 0} | more


def song(i, **more):
    return {"id": i, "title": EN, "duration": 5, "genreTag": "POP", "locale": [{"locale": "en", "primary": True}]} | more


def clip(**kinds):
    return {"source": "CLIPBOARD"} | kinds


def test_rules_leave_documents_out_whole(spark):
    had = tables(spark, artists=[(1, 0, None)], artist_authorities=[(1, 1, "A")])
    refs = lambda n: {"relations": [{"ref": n, "role": "MEMBER_OF"}]}
    docs = [
        None, "no json", {"source": "OTHER", "artists": [artist(50)]},
        clip(artists=[artist(2, **refs(3))]), clip(artists=[artist(3, **refs(4))]), clip(artists=[artist(4, **refs(99))]),  # a chain with no ground
        clip(artists=[artist(5, **refs(6))]), clip(artists=[artist(6, **refs(5))]),  # a circle that holds
        clip(artists=[artist(7, authority=[{"authority": "APPLE_MUSIC", "code": "A"}])]), clip(artists=[artist(8, title={"en": {"text": "t", "primary": False}})]),
        clip(artists=[artist(0)]), clip(artists=[artist(9, alias=["x", "x"])]), clip(artists=[artist(10, **{"relations": [{"ref": 1, "role": "no such"}]})]),
        clip(albums=[{"id": 1, "title": EN, "albumType": "EP", "artists": [1, 2], "releaseDate": "2024-02-30"}]), clip(albums=[{"id": 2, "title": EN, "albumType": "EP", "artists": [1, 5]}]),
        clip(songs=[song(None, albums=[{"id": 2, "disc": 1, "track": 1}])]), clip(songs=[song(None, albums=[{"id": 1, "disc": 1, "track": 1}])]), clip(songs=[song(7), song(None)]),
    ]
    plan, broken = loaded(spark, docs, had)
    assert broken == [0, 1, 2]
    assert errors(plan) == [
        ("albums", 13, "date", "release_date"), ("albums", 13, "reference", "album_artists 2"),
        ("artists", 3, "reference", "artist_relations 3"), ("artists", 4, "reference", "artist_relations 4"), ("artists", 5, "reference", "artist_relations 99"),
        ("artists", 8, "owned", "artist_authorities"), ("artists", 9, "not one fallback", "artist_titles"), ("artists", 10, "id", "artist_id"),
        ("artists", 11, "repeated", "artist_alias"), ("artists", 12, "missing", "artist_relations"), ("songs", 16, "reference", "album_tracks 1"),
    ]
    after = N.apply_load(had, plan)
    assert sorted(r.artist_id for r in after["artists"].collect()) == [1, 5, 6]
    assert rows(after["album_tracks"]) == [(2, 8, 1, 1)] and sorted(r.song_id for r in after["songs"].collect()) == [7, 8, 9]
    assert {r.artist_id for r in after["artist_titles"].collect()} == {5, 6}


def test_last_document_counts_and_a_second_load_changes_nothing(spark):
    had = tables(spark, artists=[(1, 0, None)], artist_alias=[(1, "old"), (2, "kept")])
    docs = [clip(artists=[artist(1, alias=["first"])]), clip(artists=[artist(1, alias=[])])]
    plan, _ = loaded(spark, docs, had)
    after = N.apply_load(had, plan)
    assert rows(after["artist_alias"]) == [(2, "kept")]  # an empty list takes the old rows away too
    log = sorted((r.table, r.operation) for r in N.load_log(had, plan).collect())
    assert log == [("artist_alias", "DELETE"), ("artist_titles", "INSERT")]  # the artist itself is as it was
    again, _ = loaded(spark, docs, after)
    twice = N.apply_load(after, again)
    assert all(rows(twice[n]) == rows(after[n]) for n in ("artists", "artist_alias", "artist_titles"))
    assert not [r for r in N.load_log(after, again).collect() if r.table == "artists"]


@pytest.mark.parametrize("docs", [[], [clip(artists=None, songs=[])]])
def test_nothing_to_load(spark, docs):
    had = tables(spark, artists=[(1, 0, None)])
    plan, _ = loaded(spark, docs, had)
    assert errors(plan) == [] and rows(N.apply_load(had, plan)["artists"]) == [(1, 0, None)]


def test_documents_and_back(spark):
    had = tables(
        spark, artists=[(1, 1, "pic"), (2, 0, None), (3, 0, None)], artist_titles=[(1, 2, "a", True), (1, 16384, "甲", False), (2, 1, "b", True), (3, 64, "c", True)], artist_alias=[(1, "x"), (1, "y")], artist_relations=[(1, 3, 1)], artist_authorities=[(3, 6, "d")],
        albums=[(9, 3, None, 2, None)], album_titles=[(9, 2, "al", True)], album_artists=[(9, 2, 0), (9, 1, 1)], album_track_counts=[(9, 1, 8), (9, 2, 7)], album_authorities=[(9, 1, "q")],
        songs=[(4, "en", 7, 33, None), (5, None, 8, 0, None)], song_titles=[(4, 2, "s", True), (5, 8, "é", True)], song_artists=[(4, 2, 0, "as b", 1)], song_authorities=[(4, 0, "i")], song_locales=[(4, 2, True), (4, 8, False), (5, 1, True)], album_tracks=[(9, 4, 2, 3)],
    )
    made = N.song_documents(had)
    four = json.loads(made.where("song_id = 4").first().document)
    assert [a["id"] for a in four["artists"]] == [1, 2, 3] and four["albums"][0]["artists"] == [2, 1] and four["songs"][0]["genreTag"] == "CLASSICAL,POP"
    assert four["artists"][0]["title"] == {"en": {"text": "a", "primary": True}, "zh-Hans": {"text": "甲", "primary": False}}
    assert json.loads(made.where("song_id = 5").first().document)["artists"] == []
    parts, broken = N.read_documents(made, "song_id", "document")
    empty = tables(spark)
    plan = N.load_plan(parts, empty)
    back = N.apply_load(empty, plan)
    assert errors(plan) == [] and broken.count() == 0
    assert {n: rows(back[n]) for n in SCHEMAS} == {n: rows(had[n]) for n in SCHEMAS}


def test_documents_are_parsed_once_for_all_kinds(spark):
    texts = spark.createDataFrame([(1, '{"source":"CLIPBOARD","songs":[{"id":5}]}'), (2, "no"), (3, '{"source":"other"}')], "n long, text string")
    parts, bad = N.read_documents(texts, "n", "text")
    for df in (*parts.values(), bad):
        assert "Scan ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r["id"] for r in parts["songs"].collect()] == [5] and sorted(r[0] for r in bad.collect()) == [2, 3]


def test_a_load_gathers_no_table_in_the_driver(spark, monkeypatch):
    plans, real = [], N.written
    monkeypatch.setattr(N, "written", lambda df, name="part": plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or real(df, name))
    t = Tables(spark, "/root/testdata/sf0.001")
    tables, plan = loading_queries._plan(t)
    plans += [(name, df._jdf.queryExecution().executedPlan().toString()) for name, df in N.apply_load(tables, plan).items()]
    assert {"documents", "errors", "refs", "standing", "groundless", "known", "rows", "song_titles"} <= {n for n, _ in plans}
    found = [(n, x) for n, p in plans for x in p.splitlines() if "BroadcastHashJoin" in x or "BroadcastNestedLoop" in x]
    assert not [(n, x) for n, x in found if "[_part#" not in x]  # numbers of rows by partition, of new ids, are few
