"""Near duplicates in large groups: all links are found whatever the size up to which all pairs are made."""

import random

import pytest

from shelfmark.llm import near_dups
from test_corpus_operators import brute_classes


def group(seed: int) -> list[str]:
    """Copies of one text with one to thirty words changed, shortened copies, texts with a common passage, exact copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    base = [word() for _ in range(160)]
    few = [word() for _ in range(4)]
    out = []
    for i in range(70):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 5, 8, 30])):
            w[r.randrange(len(w))] = r.choice(few)  # the same changes recur
        out.append(" ".join(w))
    out += [" ".join(base[: 160 - 3 * i]) for i in range(25)]
    out += [" ".join(base[:110] + [word() for _ in range(50)]) for _ in range(30)]
    other = base[:100] + [word() for _ in range(60)]
    for _ in range(30):
        w = list(other)
        w[r.randrange(160)] = word()
        w[r.randrange(160)] = word()
        out.append(" ".join(w))
    return out + [out[0], out[0].upper(), "", " \n"]


@pytest.mark.parametrize("small", [2, 12])
def test_classes_of_large_groups(spark, monkeypatch, small):
    monkeypatch.setattr(near_dups, "SMALL", small)
    monkeypatch.setattr(near_dups, "SAMPLE", 8)
    texts = dict(enumerate(group(5)))
    got = {r.doc_id: r.class_id for r in near_dups.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_classes(texts)
    assert 10 < len(set(got.values())) < len(texts) - 40


def test_ids_that_are_null_or_repeat(spark):
    """Rows are judged by their text: ids may be null or stand on several texts."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(None, a), (7, a), (7, b), (5, b), (3, b + " end"), (None, "alone " + " ".join(f"c{i}" for i in range(60))), (9, None), (9, None), (None, None), (3, b + " end")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string")
    got = sorted(((r.doc_id, r.class_id, r.n_shingles) for r in near_dups.classes(df).collect()), key=str)
    assert got == sorted([(None, 7, 56), (7, 7, 56), (7, 3, 56), (5, 3, 56), (3, 3, 57), (3, 3, 57), (None, None, 57), (9, 9, 0), (9, 9, 0), (None, None, 0)], key=str)
    kept = near_dups.survivors(df)
    assert kept.columns == df.columns
    want = [(7, a), (3, b + " end"), (None, rows[5][1]), (9, None), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
