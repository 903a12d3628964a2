"""Partial quotes of benchmark items, against an alignment of every stretch of an item."""

import random

from shelfmark.llm import decontaminate


def least_edits(pattern, text):
    """Edits of the best alignment of the pattern to a part of the text."""
    cost = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            a, b, c = cost[j - 1] + (x != y), cost[j] + 1, new[j - 1] + 1
            new.append(a if a <= b and a <= c else b if b <= c else c)
        cost = new
    return min(cost)


def holds(item, text):
    """Whether the whole item (of 180 characters at most) or any 120 characters of it stand in the text with at most 7 % edits."""
    stretches = [item] if len(item) <= 180 else []
    stretches += [item[i : i + 120] for i in range(len(item) - 119)] if len(item) > 120 else []
    return any(s in text for s in stretches) or any(least_edits(s, text) <= len(s) * 7 // 100 for s in stretches)


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 7))) for _ in range(n))[:n]


def edited(r, text, n):
    c = list(text)
    for _ in range(n):
        at = r.randrange(1, len(c) - 1)
        c[at : at + 1] = r.choice([[], ["z"], [c[at], "q"]])
    return "".join(c)


def test_long_quotes_of_an_item_are_found(spark):
    r = random.Random(3)
    short, long = "x" + prose(r, 178) + "y", "x" + prose(r, 231) + "y"
    docs = [f"{prose(r, 90)} {q} {prose(r, 90)}" for q in (short[15:165], short[30:], long[20:170], long[113:], long[7:127], long[20:120], "")]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame([(1, short), (2, long)], "item_id long, text string")
    got = {x.doc_id: x.item_ids for x in decontaminate.report(df, items).collect()}
    assert got == {0: [1], 1: [1], 2: [2], 3: [2], 4: [2], 5: [], 6: []}
    assert sorted(x.doc_id for x in decontaminate.decontaminated(df, items).collect()) == [5, 6]


def test_edited_quotes_equal_brute_force():
    r = random.Random(8)
    seen = set()
    for length in (60, 119, 121, 150, 181, 200):
        item = "x" + prose(r, length - 2) + "y"
        index = decontaminate.Index([(5, item)])
        for edits in (0, 4, 8, 9, 10, 13):
            at = r.randint(0, max(0, length - 130))
            quote = edited(r, item[at : at + r.randint(112, 150)], edits)
            text = decontaminate.normal(r.choice(["", prose(r, 40) + " "]) + quote + r.choice(["", " " + prose(r, 40)]))
            want = holds(item, text)
            assert decontaminate.leaks([text], index) == [{5} if want else set()], (length, edits)
            seen.add(want)
    assert seen == {True, False}
