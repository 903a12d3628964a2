"""URL filters: host and path rules, then two character language models against each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, stored

#: Fixed values: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Bytes of context at most, and the weight of the shorter context.
ORDER = 5
BACKOFF = 2.0
#: Grams in more than this part of all rows are broadcast; rows of one url are dealt to so many keys.
HOT = 2000
SALTS = 16
#: One of so many different ruled urls trains no model; the cut is calibrated on those.
FOLDS = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host up to / ? # or the end, A-Z lower-cased; path up to ? or #. Without :// both are empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, url, host, path, and the longest fitting rule with its verdict, or nulls."""
    host, path = host_and_path(F.col("url"))
    df = pages.select(F.col("page_id").cast("long"), "url").withColumns({"host": host, "path": path})
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return df.withColumns({"rule": rule, "verdict": verdict})


def _grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(url, gram, times): every byte of every url, and its end, behind the ORDER bytes before it, as an exact number."""
    raw = [b"\2" * ORDER + u.encode() + b"\3" for u in urls]
    size = np.asarray([len(r) for r in raw])
    c = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    inside = np.ones(len(c), bool)
    begin = np.cumsum(size) - size
    for k in range(ORDER):
        inside[begin + k] = False
    at = np.flatnonzero(inside)
    gram = np.zeros(len(at), np.int64)
    for o in range(ORDER + 1):
        gram |= c[at - o] << (8 * o)
    of = np.repeat(np.arange(len(urls)), size - ORDER)
    order = np.lexsort((gram, of))
    of, gram = of[order], gram[order]
    first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (gram[1:] != gram[:-1])))
    return of[first], gram[first], np.diff(np.append(first, len(of)))


def grams(known: DataFrame) -> DataFrame:
    """(k1, k2, gram, n, good, bad) for every different url, in rows of its different grams. known: k1, k2, text, good, bad."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for first, last in chunks(texts, 200_000):
                of, gram, n = _grams(texts[first:last])
                take = pa.array(of + first)
                yield pa.record_batch([b.column(0).take(take), b.column(1).take(take), pa.array(gram), pa.array(n), b.column(3).take(take), b.column(4).take(take)], names=["k1", "k2", "gram", "n", "good", "bad"])

    return known.select("k1", "k2", "text", "good", "bad").mapInArrow(cut, "k1 long, k2 long, gram long, n long, good long, bad long")


def _held_out() -> Column:
    return F.pmod(F.col("k1"), F.lit(FOLDS)) == 0


def log_ratios(rows: DataFrame) -> DataFrame:
    """(gram, times, ratio): log P(accepted model) - log P(rejected model) of the last byte, in billionths.

    Counts are exact, of each order's contexts and of the bytes behind them, and are rows of Spark tables that grow
    with the input. Contexts back off by their counts. A key of any join here stands in at most 256 rows.
    """
    train = F.col("n") * (~_held_out()).cast("int")
    seen = rows.groupBy("gram").agg(F.sum("n").alias("times"), F.sum(train * F.col("good")).alias("c1"), F.sum(train * F.col("bad")).alias("c0"))
    seen = stored(seen, "grams")
    model = None
    for o in range(ORDER + 1):
        pair = F.col("gram").bitwiseAND(F.lit((1 << 8 * (o + 1)) - 1))
        pairs = seen if o == ORDER else seen.groupBy(pair.alias("gram")).agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
        pairs = pairs.withColumn("context", F.shiftright("gram", 8))
        own = pairs.groupBy("context").agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0"))
        pairs = pairs.join(own, "context")
        if model is None:
            pairs = pairs.withColumns({"q1": F.lit(1 / 256), "q0": F.lit(1 / 256)})
        else:
            shorter = model.select(F.col("gram").alias("shorter"), F.col("p1").alias("q1"), F.col("p0").alias("q0"))
            pairs = pairs.join(shorter, F.col("gram").bitwiseAND(F.lit((1 << 8 * o) - 1)) == F.col("shorter"))
        model = pairs.withColumns({f"p{m}": (F.col(f"c{m}") + BACKOFF * F.col(f"q{m}")) / (F.col(f"n{m}") + BACKOFF) for m in "10"})
    return model.select("gram", "times", F.round((F.log("p1") - F.log("p0")) * 1e9).cast("long").alias("ratio"))


def scores(known: DataFrame) -> DataFrame:
    """(k1, k2, good, bad, score) of every different url: the mean log ratio over its bytes and its end.

    Grams in over a HOTth of all rows are joined by a broadcast of those few; the others by their value.
    """
    rows = grams(known)
    model = stored(log_ratios(rows), "model")
    most = model.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0] / HOT
    hot = model.where(F.col("times") > most).select("gram", "ratio")
    d = rows.join(F.broadcast(hot), "gram", "left")
    cold = d.where("ratio IS NULL").drop("ratio").join(model.where(F.col("times") <= most).select("gram", "ratio"), "gram")
    both = d.where("ratio IS NOT NULL").unionByName(cold)
    total = both.groupBy("k1", "k2").agg(F.max("good").alias("good"), F.max("bad").alias("bad"), F.sum("n").alias("size"), F.sum(F.col("n") * F.col("ratio")).alias("sum"))
    return stored(total.select("k1", "k2", "good", "bad", (F.col("sum") / F.col("size") / 1e9).alias("score")), "url-scores")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, bins: int = 2001) -> DataFrame:
    """Rule verdicts, and for the other urls the models'.

    Every row with a rule's verdict trains the model of that verdict with its whole url, but for those of one in
    FOLDS of the different urls; the threshold is the cut of the score histogram of these held-out rows (of all ruled ones
    where either verdict is missing among them) that makes the least balanced error. A null url is the empty text; it
    and urls without :// have empty host and path and no rule. Repeated rows are judged each. Different urls are
    told apart by two 64-bit hashes.
    Urls may be of any length; columns other than page_id and url are ignored.
    """
    text = F.coalesce("url", F.lit(""))
    df = ruled(pages, rules).withColumns({"text": text, "k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(7), text)})
    known = df.groupBy("k1", "k2", "text").agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"))
    judged = scores(known)
    squeezed = F.col("score") / (1 + F.abs("score"))  # any score has a cell
    cell = F.floor((squeezed + 1) * (bins - 1) / 2).alias("cell")
    judged = judged.withColumn("cell", cell)
    kinds = F.explode(F.array(F.struct(F.lit("allow").alias("verdict"), F.col("good").alias("n")), F.struct(F.lit("block").alias("verdict"), F.col("bad").alias("n"))))
    seen = judged.select("cell", _held_out().alias("held"), kinds.alias("k")).where("k.n > 0").groupBy("cell", "held", "k.verdict").agg(F.sum("k.n").alias("n")).collect()
    # one url may be most rows: its rows are dealt by page
    salted = judged.select("k1", "k2", "score", "cell", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    scored = df.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["k1", "k2", "salt"]).select("page_id", "host", "path", "rule", "verdict", "score", "cell")
    n = np.zeros((2, bins))
    both = len({r.verdict for r in seen if r.held}) == 2
    for r in seen:
        if r.held or not both:
            n[int(r.verdict == "allow"), int(r.cell)] += r.n
    cut = (bins - 1) // 2
    if n[0].sum() and n[1].sum():
        # allow from a cell on: good ones below it and bad ones from it on are errors
        wrong = np.append(0, np.cumsum(n[1])) / n[1].sum() + 1 - np.append(0, np.cumsum(n[0])) / n[0].sum()
        best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
        cut = int(best[len(best) // 2])
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("cell") >= cut, "allow").otherwise("block"))).drop("cell")
