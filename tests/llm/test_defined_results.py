"""Inputs that once raised."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import decontaminate, repeats, rules


def test_many_different_words():
    n = (1 << 21) + 5
    words = [b"%d" % i for i in range(n)]
    ids, _ = rules.Hasher().words(words + words[-3:])
    assert ids.max() == n - 1 and rules.repeated_words(ids) == 6
    r = np.random.default_rng(1).integers(0, 6, 400)
    assert rules.repeated_words(r) == rules.repeated_words(r + (1 << 22))


def test_items_without_id(spark):
    text = "a passage of the benchmark that has no number of its own at all"
    items = spark.createDataFrame([(None, text), (None, text + " again"), (3, "another passage of the benchmark, with a number")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {text} yes"), (2, "clean")], "doc_id long, text string")
    assert {r.doc_id: (r.contaminated, r.n_items, r.item_ids) for r in decontaminate.report(docs, items).collect()} == {1: (True, 1, []), 2: (False, 0, [])}
    assert [r.doc_id for r in decontaminate.decontaminated(docs, items).collect()] == [2]


def removed(rows):
    """Brute force over rows: bytes, removed bytes, spans and hash of the rest of each."""
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    out = []
    for (i, _), b in zip(rows, raw):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        starts = int((gone & ~np.append(False, gone[:-1])).sum())
        out.append((i, len(b), int(gone.sum()), starts, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("large", [4_000, 2])
def test_repeats_of_rows_without_id_or_of_one_id(spark, large, monkeypatch):
    monkeypatch.setattr(repeats, "LARGE", large)
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    long, alone, shared = prose(120), prose(300), prose(60)
    rows = [(None, long), (None, prose(40) + shared), (None, None), (1, long), (1, "short"), (2, long + shared), (1, alone), (3, "x" + shared + prose(20)), (0, shared), (5, prose(90)), (5, prose(90)), (6, alone[:900] + prose(50)), (7, shared), (7, shared)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, t int")
    got = sorted((tuple(x) for x in repeats.without_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    assert got == removed(rows)


def test_decontamination_by_row(spark, monkeypatch):
    item = "a passage of the benchmark that is long enough to be found as a whole in any text"
    items = [(1, item), (1, item), (None, item[5:]), (2, "nothing of the kind is to be found anywhere in these documents at all")]
    docs = [(None, "see " + item), (None, "clean"), (1, item), (1, "clean text"), (1, None), (2, "clean text"), (2, "clean text")]
    want = sorted([(None, True, 2, [1]), (None, False, 0, []), (1, True, 2, [1]), (1, False, 0, []), (1, False, 0, []), (2, False, 0, []), (2, False, 0, [])], key=str)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in decontaminate.report(d, b).collect()), key=str) == want
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    assert len(list(decontaminate.blocks(b))) > 1
    assert sorted((tuple(r) for r in decontaminate.report(d, b).collect()), key=str) == want


def test_blocks_of_equal_and_long_items(spark, monkeypatch):
    r = random.Random(9)
    base = spark.range(200_000).selectExpr("5 AS item_id", "'the very same item, two hundred thousand times over' AS text")
    assert [len(rows) for rows in decontaminate.blocks(base)] == [1]
    monkeypatch.setattr(decontaminate, "PART_CHARS", 2_000)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 8_000)
    long = " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(4_000))
    items = spark.createDataFrame([(8, long)], "item_id long, text string")
    found = list(decontaminate.blocks(items))
    parts = [t for rows in found for _, t in rows]
    assert len(found) > 1 and max(map(len, parts)) <= 2_000 and max(sum(len(t) for _, t in rows) for rows in found) <= 16_000
    for k in range(0, len(long) - 120):
        assert any(long[k : k + 120].strip() in t for t in parts)
    quotes = [(k, "so " + long[k * 3_000 : k * 3_000 + 150] + " it says") for k in range(9)]
    got = decontaminate.report(spark.createDataFrame([*quotes, (99, "clean")], "doc_id long, text string"), items).collect()
    assert {x.doc_id: x.item_ids for x in got} == {**{k: [8] for k, _ in quotes}, 99: []}
