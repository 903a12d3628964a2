"""Operators over many documents, against brute force; the pipeline; lost-row checks."""

import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from shelfmark.llm import decontaminate, near_dups, repeats, rules, urls


def rows(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def brute_classes(texts):
    own = near_dups.Shingler()
    units = {i: own.units(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if len(units[i]) and len(units[j]) and near_dups.similarity(units[i], units[j]) >= near_dups.SIMILAR:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def test_near_duplicate_classes(docs, nothing):
    got = {r.doc_id: r.class_id for r in near_dups.classes(docs).collect()}
    assert got == brute_classes(rows(docs))
    assert near_dups.classes(nothing).count() == 0


def test_chain_across_centres(spark):
    """Neighbours in a chain are alike, its ends are not: one class all the same."""
    words = [f"w{i}" for i in range(200)]
    chain = [" ".join(words[k * 4 : k * 4 + 120]) for k in range(12)]
    df = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    assert {r.class_id for r in near_dups.classes(df).collect()} == {0}


def test_signatures_estimate_weighted_similarity():
    own = near_dups.Shingler()
    words = [f"w{i % 90}" for i in range(400)]
    x, y = own.units(" ".join(words)), own.units(" ".join([*words[:380], *(f"z{i}" for i in range(20))]))
    s = near_dups.signatures([x, y, x])
    assert (s[0] == s[2]).all() and abs((s[0] == s[1]).mean() - near_dups.similarity(x, y)) < 0.13


def brute_repeats(texts):
    raw = {i: t.encode() for i, t in texts.items()}
    n = repeats.LENGTH
    seen = Counter(b[k : k + n] for b in raw.values() for k in range(len(b) - n + 1))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = True
        starts = int((gone[:-1] & ~np.append(False, gone[:-1])[: len(b)]).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), starts, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("large", [4_000, 2])
def test_repeats(docs, nothing, large, monkeypatch):
    monkeypatch.setattr(repeats, "LARGE", large)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.without_repeats(docs).collect()}
    assert got == brute_repeats(rows(docs))
    assert repeats.without_repeats(nothing).count() == 0


def edit_distance(pattern, text):
    cost = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(cost[j - 1] + (x != y), cost[j] + 1, new[j - 1] + 1))
        cost = new
    return min(cost)


def test_decontamination(docs, nothing, spark):
    texts = rows(docs)
    item = next(t for t in texts.values() if len(t) > 500)
    items = spark.createDataFrame([(1, item[100:250]), (2, "never written anywhere in any of these documents, " * 3), (3, None), (4, ""), (5, item[300:460].replace("e", "E", 4))], "item_id long, text string")
    known = {r.item_id: decontaminate.windows(r.text or "") for r in items.collect()}
    got = {r.doc_id: set(r.item_ids) for r in decontaminate.report(docs, items).collect()}
    for i, t in texts.items():
        t = decontaminate.normal(t)
        if len(t) < 3000:
            assert got[i] == {k for k, ws in known.items() for w in ws if edit_distance(w, t) <= decontaminate.edit_budget(len(w))}
    assert any(got.values())
    assert decontaminate.report(nothing, items).count() == 0 and decontaminate.report(docs, items.limit(0)).where("contaminated").count() == 0
    clean = decontaminate.decontaminated(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, x in got.items() if not x}


def test_urls(spark):
    import re

    pages = [None, "", "no scheme", "http://a.ORG", "http://a.org/x", "https://www.example.org/es/1?q", "http://example.org/en/12#a", "http://example.org/en/2", "http://notorg/x", "http://shop.com/fr/1", "ftp://B.com/de/2", "http://z.net/a/b?c", "http://z.net?x=http://q.org/"] * 8
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    for i, u in enumerate(pages):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = ("", "") if not m else ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2])
        fits = [(len(h + p), v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, max(fits)[2] if fits else None)
        assert got[i].verdict in ("allow", "block") and (not fits or got[i].verdict == max(fits)[1])
    assert urls.judge(df.limit(0)).count() == 0


def test_url_models_tell_paths_apart(spark):
    rows = [f"http://h{i}.org/news/story-{i}" for i in range(60)] + [f"http://h{i}.com/de/casino-{i}" for i in range(60)]
    asked = [f"http://h{i}.net/news/story-{i}" for i in range(100, 120)] + [f"http://h{i}.net/de/casino-{i}" for i in range(100, 120)]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(list(enumerate(rows + asked)), "page_id long, url string")).collect()}
    assert [got[120 + i] for i in range(40)] == ["allow"] * 20 + ["block"] * 20


def test_pipeline_equals_its_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, sf)
        if name != "packing":
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name))
            new = spark.read.parquet(str(tmp_path / name))
            assert new.count() <= seen.count()
            if name == "quality_rules":
                verdict = rules.quality_rules(seen, spark.read.parquet(f"{sf}/labels.parquet"))
                assert sorted(r.doc_id for r in new.collect()) == sorted(r.doc_id for r in verdict.where("kept").collect())
            if name == "near_duplicates":
                assert sorted(r.doc_id for r in new.collect()) == sorted(set(brute_classes(rows(seen)).values()))
            if name == "personal_data":
                assert new.count() == seen.count() and new.where("text rlike '[a-z0-9]@[a-z0-9]+[.]'").count() == 0
            seen = new
        else:
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in seen.collect()}
