"""Normalisation by fixed tables, over every code point; the operators beside it on odd input."""

import sys
import unicodedata

from pyspark.sql import functions as F

from shelfmark.functions import codecs as C
from shelfmark.functions import text as X
from shelfmark.operators import predicates as P

#: Characters that are easily lost or mistaken, and what they become.
GOLDEN = {0x1427: "-", 0x1428: "-", 0x2E0F: "-", 0x167F: "=", 0x0387: ".", 0x141F: "'", 0x1420: "'", 0x037E: ",", 0xFE31: "|", 0xFE32: "|", 0x2E42: "'", 0xFD3E: "(", 0xFD3F: ")", 0x201A: "'", 0x10101: ".", 0x2103: "°C", 0x2109: "°F", 0x2226: None, 0x2E28: None, 0x3018: "("}


def test_every_code_point(spark):
    codes = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 997 == 0)]
    df = spark.createDataFrame([(c, chr(c)) for c in codes], "c int, x string")
    got = {r.c: (r.a, r.b, r.f) for r in df.select("c", X.simplify_punctuation(F.col("x")).alias("a"), X.simplify_punctuation(F.col("x"), False).alias("b"), X.fold_latin(F.col("x")).alias("f")).collect()}
    changed = {c for c, (a, _, _) in got.items() if a != chr(c)}
    assert changed == {ord(c) for c in X._punctuation(True)} and len(changed) == 326
    assert all(got[c][0] == (to or chr(c)) for c, to in GOLDEN.items())
    assert [got[c][1] for c in (0x2225, 0x2980, 0x2026, 0x22, 0x2057, 0x37E)] == ["||", "|||", "...", "''", "''''", ";"]
    table = {c: to for to, chars in X.FOLDS.items() for c in chars} | X.LIGATURES
    for c, (_, _, folded) in got.items():
        low = chr(c).lower()
        if low in table:
            assert folded == table[low], chr(c)
        elif low.isascii() or unicodedata.category(chr(c)) == "Lo":
            assert folded == low, chr(c)


def test_neighbouring_symbols_become_one(spark):
    rows = ["DISH//", "a--b", "a  b", "éé", "11", "__", "?!?!", "…x…", "́́"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, x string")
    got = [r.x for r in df.select("i", X.simplify_punctuation(F.col("x")).alias("x")).orderBy("i").collect()]
    assert got == ["DISH/", "a-b", "a b", "éé", "11", "-", "?!?!", ".x.", "́"]


def test_codes_of_pages(spark):
    pages = {
        ("artist", "https://music.youtube.com/channel/UC_x-1?y"): ("YOUTUBE_MUSIC", "UC_x-1"),
        ("artist", "https://music.youtube.com/@who"): ("YOUTUBE_MUSIC", "@who"),
        ("song", "https://music.youtube.com/watch?a=1&v=ab_c&t=2"): ("YOUTUBE_MUSIC", "ab_c"),
        ("song", "https://rateyourmusic.com/work/who/song/"): ("RATE_YOUR_MUSIC", "w/who/song"),
        ("song", "https://rateyourmusic.com/song/who/it"): ("RATE_YOUR_MUSIC", "who/it"),
        ("album", "https://rateyourmusic.com/release/single/who/it"): ("RATE_YOUR_MUSIC", "s/who/it"),
        ("artist", "https://www.discogs.com/artist/12-Who?x"): ("DISCOGS", "12"),
        ("song", "https://example.org/track/1"): None,
    }
    for (context, url), want in pages.items():
        r = spark.createDataFrame([(url,)], "u string").select(C.code_from_url(F.col("u"), context).alias("c")).first().c
        assert (tuple(r) if r else None) == want, url


def test_null_arrays_and_patterns(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, [])], "i int, x array<string>")
    assert [r.i for r in df.where(P.array_pred(F.col("x"), "isNot", "a")).orderBy("i").collect()] == [2, 3]
    assert [r.i for r in df.where(P.array_pred(F.col("x"), "is", "a")).collect()] == [1]
