"""The index of characters finds what contains finds, and reads only the partitions that it needs."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from shelfmark.functions.text import fold_latin, fold_latin_long
from shelfmark.operators import trigrams as G


def test_equal_to_contains(spark, tmp_path):
    texts = [(1, "Hello World"), (1, "second text"), (2, "ÉTÉ à la plage"), (3, None), (4, ""), (None, "lost"), (5, "ab"), (6, "abcabcab" * 4000 + "end"), (7, "日本語の歌 😀x"), (8, "abxcab"), (2, "ÉTÉ à la plage")]
    terms = [(0, "hello"), (1, "O w"), (2, "ete A"), (3, "z"), (4, ""), (5, None), (6, "ab"), (7, "b"), (8, "bcabe"), (9, "cabend"), (10, "本語"), (11, "日本語の歌 😀"), (12, "lotext"), (13, "abcab"), (14, "not there")]
    d = spark.createDataFrame(texts, "id long, x string")
    index = G.build_index(d, "id", "x", str(tmp_path / "i"))
    got = sorted(map(tuple, G.search(index, spark.createDataFrame(terms, "n int, t string"), "n", "t").collect()))
    plain = {"É": "e", "à": "a"}
    fold = lambda s: "".join(plain.get(c, c) for c in s).lower()
    assert got == sorted({(n, i) for n, t in terms if t for i, x in texts if i is not None and x and fold(t) in fold(x)})


def test_no_texts_no_terms(spark, tmp_path):
    one = spark.createDataFrame([(1, "abc")], "id long, x string")
    empty = one.limit(0)
    assert G.search(G.build_index(one, "id", "x", str(tmp_path / "a")), empty, "id", "x").count() == 0
    assert G.search(G.build_index(empty, "id", "x", str(tmp_path / "b")), one, "id", "x").count() == 0


def test_reads_few_partitions(spark, tmp_path):
    d = spark.range(3000).selectExpr("id", "concat('name ', id * 7919, ' of ', id) AS x")
    index = G.build_index(d, "id", "x", str(tmp_path / "i"))
    found = G.candidates(index, spark.createDataFrame([(1, "name 15838 ")], "term_id int, term string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    read = re.search(r"PartitionFilters: \[[^\]]*part#\d+ (?:IN \(([\d, ]+)\)|= (\d+))", plan)
    assert read, plan
    assert len((read[1] or read[2]).split(",")) <= G.RAREST < G.PARTS / 4
    assert [r.key for r in found.collect()] == [2]


def test_equal_terms_are_looked_up_once(spark, tmp_path):
    texts = spark.createDataFrame([(1, "Blue Ring 12"), (1, "blue ring 123"), (2, "red rod 3")], "id long, text string")
    index = G.build_index(texts, "id", "text", str(tmp_path / "index"))
    assert index.table("postings").groupBy("key", "gram").count().where("count > 1").count() == 0
    terms = spark.createDataFrame([(7, "rin"), (5, "RIN"), (9, "ing 12"), (8, "nowhere"), (6, None)], "term_id long, term string")
    members, found = G.search_classes(index, terms, "term_id", "term")
    assert sorted(map(tuple, members.collect())) == [(5, 5), (7, 5), (8, 8), (9, 9)]
    assert sorted(map(tuple, found.collect())) == [(5, 1), (9, 1)]
    assert sorted(map(tuple, G.search(index, terms, "term_id", "term").collect())) == [(5, 1), (7, 1), (9, 1)]


def test_postings_are_made_as_lists_in_the_task_that_reads_the_texts(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    rows = sorted((r.choice([0, 0, 0, 1, 2, 3, 4, 5]), "".join(r.choice("abcé😀日 ") for _ in range(r.choice([1, 2, 3, 40])))) for _ in range(80))
    want = sorted({(t[i : i + n], k) for k, t in rows for n in (1, 2, 3) for i in range(len(t) - n + 1)})
    batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[i : i + 13]]), pa.array([t for _, t in rows[i : i + 13]])], ["key", "text"]) for i in range(0, 80, 13)]
    for limit in (50, 300, 10**6):  # a key's texts fill several lists, or one
        monkeypatch.setattr(G, "LISTED", limit)
        lists = [x for b in G._posting_lists(iter(batches)) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert sorted((g, k) for g, keys in lists for k in keys) == want
    assert len(lists) == len({g for g, _ in want})  # a list for each gram, not a row for each key of it
    index = G.build_index(spark.range(500).selectExpr("id", "concat('same words ', id) AS x"), "id", "x", str(tmp_path / "i"))
    assert index.table("lists").count() < index.table("postings").count() / 10


def test_long_texts_fold_as_short_ones(spark):
    every = spark.createDataFrame([(f"a{chr(c)}b",) for c in range(1, 0x2100)] + [(None,), ("ÆŁß x",)], "x string")
    assert every.where(~fold_latin(F.col("x")).eqNullSafe(fold_latin_long(F.col("x")))).count() == 0
