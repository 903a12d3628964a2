"""The URL models against counts kept in plain dictionaries."""

import math
from collections import Counter

from pyspark.sql import functions as F

from shelfmark.llm import urls


def test_scores_equal_exact_counts_over_whole_urls(spark):
    pages = [f"http://h{i}.org/a?story={i}" for i in range(30)] + [f"http://h{i}.com/de/b?casino={i}#x" for i in range(30)]
    asked = ["http://z.net/q?story=1", "http://z.net/q?casino=1", "story=1", "casino=1", None, "", "http://é.net/ü"]
    rows = pages + asked + [pages[0]] * 3
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()}
    assert len(got) == len(rows)
    pair, own = {m: Counter() for m in (0, 1)}, {m: Counter() for m in (0, 1)}
    steps = lambda u: [(raw[max(0, i - 5) : i], raw[i]) for raw in [b"\2" * 5 + (u or "").encode() + b"\3"] for i in range(5, len(raw))]
    keys = spark.createDataFrame(list(enumerate(u or "" for u in rows)), "i int, u string").select("i", F.xxhash64("u").alias("k")).collect()
    train = {r.i for r in keys if r.k % urls.FOLDS}
    assert 0 < len(train) < len(rows)
    for i, u in enumerate(rows):
        if got[i].rule and i in train:
            for ctx, c in steps(u):
                for o in range(6):
                    pair[got[i].verdict == "allow"][ctx[5 - o :], c] += 1
                    own[got[i].verdict == "allow"][ctx[5 - o :]] += 1
    for i, u in enumerate(rows):
        total = 0
        for ctx, c in steps(u):
            p = [1 / 256, 1 / 256]
            for o in range(6):
                for m in (0, 1):
                    p[m] = (pair[m][ctx[5 - o :], c] + 2 * p[m]) / (own[m][ctx[5 - o :]] + 2)
            total += math.log(p[1] / p[0])
        assert abs(got[i].score - total / len(steps(u))) < 1e-8, u
    assert [got[60 + i].verdict for i in range(4)] == ["allow", "block"] * 2
