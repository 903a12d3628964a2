"""Periodic runs, nearest vectors and ranked search against brute force and the library's edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import neighbours, queries, runs, search
from shelfmark.llm.common import load

SF = "/root/testdata/sf0.001"


def brute_runs(x):
    n, out = len(x), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((i, j, q) for (i, j), q in out.items())


def test_transform_and_mismatches():
    r = np.random.default_rng(1)
    a = r.integers(0, runs.PRIME, (3, 64)).astype(np.uint64)
    assert (runs.transform(runs.transform(a), True) == a).all()
    x = r.integers(0, 4, 300).astype(np.uint64)
    begin, block = np.array([0, 8, 80, 160]), 8
    got = runs.mismatches(x, begin, block)
    for k, b in enumerate(begin):
        for t in range(2 * block):
            far = x[b + 2 * block - 1 + t :][:block].astype(np.int64)
            assert got[k, t] == ((x[b : b + block].astype(np.int64) - far) ** 2).sum()


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_word_lists(seed):
    r = random.Random(seed)
    for _ in range(30):
        texts = []
        for _ in range(r.randint(1, 4)):
            k, n = r.choice([1, 2, 3, 50]), r.choice([0, 1, 11, 12, 40, 150, 300])
            w = [b"%d" % r.randrange(k) for _ in range(n)]
            for _ in range(r.randint(0, 3)):
                if n > 20:
                    a = r.randrange(n)
                    p, e = r.randint(1, (n - a) // 2 + 1), n
                    e = min(n, a + p * r.randint(1, 5))
                    w = [w[a + (i - a) % p] if a <= i < e else w[i] for i in range(n)]
            texts.append(w)
        for w, got in zip(texts, runs.runs_of(texts)):
            assert sorted(map(tuple, got.tolist())) == brute_runs(w)


def test_long_periods_and_one_word():
    w = [b"%d" % (i % 3001) for i in range(10_000)]
    assert runs.runs_of([w])[0].tolist() == [[0, 10_000, 3001]]
    assert runs.runs_of([[b"a"] * 50_000])[0].tolist() == [[0, 50_000, 1]]


def test_periodic_runs_of_odd_rows(spark, docs, nothing):
    assert runs.periodic_runs(nothing).count() == 0
    odd = spark.createDataFrame([(None, "a " * 12), (None, None), (1, " \x0b\x0c\n"), (1, "x " * 30 + "y"), (1, "x " * 30 + "y"), (2, "é\x85b " * 9)], "doc_id long, text string")
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(odd).collect()), key=str)
    assert got == sorted([(None, [(0, 12, 1)], "a"), (None, [], ""), (1, [], ""), (1, [(0, 30, 1)], "x y"), (1, [(0, 30, 1)], "x y"), (2, [], " ".join(["é\x85b"] * 9))], key=str)


def test_op11_query(spark):
    texts = {r.doc_id: r.text for r in load(spark, SF, "documents", "doc_id", "text").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert got.keys() == texts.keys()
    changed = 0
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if n > 1500:  # brute force takes the square of it
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (j - a) % p] if j >= a else w[j] for j in range(n)]
            changed += 1
        found = brute_runs(w)
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in sorted(found, key=lambda x: (x[0], x[2])))
        gone = {k for s, e, q in found for k in range(s + q, e)}
        top = min(found, key=lambda x: (-(x[1] - x[0]), x[0], x[2]), default=None)
        best = (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2]) if top else (None,) * 4
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[i] == (len(found), *best, sha(lines), sha(" ".join(x for k, x in enumerate(w) if k not in gone))), i
    assert changed


def brute_nearest(rows, k=20, every=20):
    """rows of (id, vector): for each query the ids and scores of the k nearest."""
    ok = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in {i for i, _ in ok if i % every == 0}:
        best = {}
        for i, v in ok:
            for j, u in ok:
                if j == q and i != q and len(u) == len(v):
                    best[i] = max(best.get(i, -np.inf), float((u * v).sum()))
        out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return {q: [(i, -s) for s, i in v] for q, v in out.items() if v}


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_nearest_of_odd_rows(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.standard_normal(6).tolist()) for i in range(120)]
    rows += [(i, rows[3][1]) for i in range(120, 160)]  # equal vectors: ties
    rows += [(160, None), (161, [0.0] * 6), (162, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (163, [math.nan] * 6), (164, [math.inf] + [0.0] * 5), (None, [9.0] * 6), (165, []), (20, rows[20][1]), (40, r.standard_normal(6).tolist()), (33, [50.0] * 6)]
    rows += [(i, r.standard_normal(4).tolist()) for i in range(200, 225)] + [(240, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    got, want = ranked(neighbours.nearest(df)), brute_nearest(rows)
    assert got.keys() == want.keys() and 240 not in got
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12, atol=0)
    assert neighbours.nearest(df.where("false")).count() == 0 and neighbours.nearest(df.where("vec_id % 20 <> 0")).count() == 0


@pytest.mark.parametrize("least, room", [(16_384, 16_000_000), (40, 20_000)])
def test_recall_by_levels_and_query_blocks(spark, least, room, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST", least)
    monkeypatch.setattr(neighbours, "QUERY_BYTES", room)
    df = load(spark, SF.replace("0.001", "0.1"), "embeddings", "vec_id", "embedding")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    x, ids = np.asarray([v for _, v in rows], np.float64), np.asarray([i for i, _ in rows])
    got, hit, total = ranked(neighbours.nearest(df)), 0, 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hit, total = hit + len(want & {i for i, _ in got[q]}), total + 20
        assert len(got[q]) == 20
    assert hit / total >= 0.97


def test_clusters_of_many_norms_and_copies():
    r = np.random.default_rng(3)
    y = r.standard_normal((100, 32))[r.integers(0, 100, 6000)] + 0.3 * r.standard_normal((6000, 32))
    y *= r.uniform(0.2, 3, (6000, 1))
    y[::3] = y[0]
    asked = np.arange(0, 6000, 60)
    own = neighbours.Nearest(asked, y[asked], np.full(len(asked), -np.inf), 20)
    for i in range(0, 6000, 2000):
        own.add(neighbours.Block(np.arange(i, i + 2000), y[i : i + 2000]))
    hit = 0
    for k, q in enumerate(asked):
        s = (y * y[q]).sum(1)
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(6000), -s))[:20].tolist()) & set(own.found[k].tolist()))
    assert hit / (20 * len(asked)) >= 0.97


def brute_search(docs, items):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(i, Counter(term(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    big_n, big_l = len(counted), sum(n for _, _, n in counted)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c, n in counted:
            m = 25 + 75 * n * big_n // big_l
            total = 0
            for w in term(text):
                if c[w]:
                    df = sum(1 for _, x, _ in counted if w in x)
                    total += math.floor(1000 * math.log((2 * big_n + 2) / (2 * df + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m))
            if total > 0:
                scores.append((-total, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:10])]
    return sorted(out, key=str)


@pytest.mark.parametrize("room, cells", [(2_000_000, 2_000_000), (300, 30)])
def test_search_against_brute_force(spark, docs, nothing, room, cells, monkeypatch):
    for name, value in (("BLOCK_BYTES", room), ("CELLS", cells), ("HELD", cells), ("PIECE", cells)):
        monkeypatch.setattr(search, name, value)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(None, rows[10][1]), (3, rows[10][1]), (3, "thest AN an"), (None, None)]
    items = [(1, rows[12][1][:200]), (2, "An AN thest é!"), (2, "an"), (None, rows[20][1]), (5, None), (6, ""), (7, "no-such-word"), (1, rows[12][1][:200]), (8, " ".join(rows[30][1].split()[:40]))]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score long")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    got = sorted((tuple(r) for r in search.search(d, b).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == brute_search(rows, [x for x in items if x[1]])
    assert search.search(nothing, b).count() == 0 and search.search(d, b.where("false")).count() == 0


def test_pieces_end_between_terms(monkeypatch):
    text = ("Straße, O'Neil x" * 50 + "é" * 100).encode()
    whole = search.term_counts(text)
    for n in (1, 7, 64):
        monkeypatch.setattr(search, "PIECE", n)
        assert search.term_counts(text) == whole
