"""Operators that judge each document, against plain versions of their contracts."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from shelfmark.llm import automaton, crf, pii, rules, secrets, tokens

PIECE, BYTE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def rows(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def test_token_counts_equal_the_library(docs, nothing):
    model, got = sentencepiece.SentencePieceProcessor(model_file=PIECE), by_id(tokens.token_counts(docs, PIECE, 100))
    for i, t in rows(docs).items():
        n = len(model.encode(t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 100)
    assert tokens.token_counts(nothing, PIECE).count() == 0


def test_packing_is_gapless_and_exact(docs, nothing):
    tok = Tokenizer.from_file(BYTE)
    out = tokens.pack(docs, BYTE, capacity=128).collect()
    want = {i: tok.encode(t, add_special_tokens=False).ids + [2] for i, t in rows(docs).items()}
    pieces = {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes()) and len(ids) == r.length <= 128
    for i, ids in want.items():
        p = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in p] == list(range(len(p))) and sum(r.length for r in p) == len(ids)
        assert all(r.length == 128 for r in p[1:]) and [r.start for r in p] == [sum(x.length for x in p[:k]) for k in range(len(p))]
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 128
    assert len(seqs) <= 1.1 * sum(map(len, want.values())) / 128 + 2
    assert tokens.pack(nothing, BYTE).count() == 0


def test_base_spans(docs, nothing):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    got = by_id(pii.personal_data(docs))
    for i, t in rows(docs).items():
        base = [("email", *m.span()) for m in email.finditer(t)]
        base += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        digits = lambda s: re.sub("[^0-9]", "", s)
        base += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        base += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(got[i].spans.split(","))
    assert pii.personal_data(nothing).count() == 0
    text = next(t for t in rows(docs).values() if "@" in t)
    clean = pii.redact(text, pii.base_spans(text))
    assert "@" not in clean and "[email]" in clean and "[card]" in clean and "10.0.0.300" in clean


def test_votes_learn_that_versions_are_not_addresses():
    rows = [(1, 1, 0, 1, 0, 1, 0, 0, 50), (1, -1, 0, 0, -1, -1, 0, 0, 50)]
    p, reliability = pii.weigh(np.asarray(rows)[:, :-1], np.asarray(rows)[:, -1].astype(float))
    assert p[0] > 0.9 and p[1] < 0.1 and (reliability[0] > 0.8).all()


def secret_spans(t):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def test_secrets(docs, nothing):
    got = by_id(secrets.secrets(docs))
    for i, t in rows(docs).items():
        base = secret_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[0] == k for x in base) for k in ("assign", "access", "hex"))
    assert secrets.secrets(nothing).count() == 0
    extra = secrets.find_secrets(["ghp_" + "z1" * 18, "x -----BEGIN RSA PRIVATE KEY----- y", "ghp_short"])
    assert [[secrets.RULES[k][0] for k, _, _ in x] for x in extra] == [["github"], ["private_key"], []]


def test_lanes_agree_with_one_lane():
    table, _ = automaton.compile_rules(["ab+c", "[0-9]{3}"], search=True)
    data = np.frombuffer(("abbbc12345x" * 5000 + "b" * 30000 + "c").encode(), np.uint8)
    assert (automaton.states(table, data, lanes=64) == automaton.states(table, data, lanes=10**6)).all()


def test_rule_counts(docs, nothing, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = by_id(rules.quality_rules(docs, labels))
    for i, t in rows(docs).items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(zip(words, words[1:], words[2:]))
        hit = {k + d for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert tuple(got[i])[1:6] == want
        assert got[i].base_failed == (len(words) < 50 or 100 * len(hit) > 50 * len(words)) and not (got[i].base_failed and got[i].kept)
    assert rules.quality_rules(nothing, labels).count() == 0


def labelled(spark, n=240):
    good = "The quiet river ran past the old mill and on to the sea.\nThere was little to be said of it, and less was said."
    rows = [(i, (f"BUY!! NOW!! {i} $$$ *** CHEAP!!\n" * 12) if i % 3 == 0 else f"{good} Number {i}.\n" * 4, int(i % 3 != 0)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_quality_models_on_held_out_rows(spark):
    d = labelled(spark)
    labels = d.select("doc_id", "quality")
    scored = by_id(crf.line_quality(d.select("doc_id", "text"), labels))
    for r in d.collect():
        s = scored[r.doc_id]
        assert s.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and s.predicted == int(s.score >= 0.5) == r.quality
    kept = by_id(rules.quality_rules(d.select("doc_id", "text"), labels.where("doc_id < 120")))
    assert all((kept[r.doc_id].quality >= 0.5) == bool(r.quality) for r in d.collect() if r.doc_id >= 120)


def test_line_quality_edges(docs, nothing, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = by_id(crf.line_quality(docs, labels))
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    assert crf.line_quality(nothing, labels).count() == 0


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    u, trans = r.normal(size=4), r.normal(size=(2, 2))
    total, good = 0.0, np.zeros(4)
    for k in range(16):
        y = [(k >> i) & 1 for i in range(4)]
        w = np.exp(sum(u[i] * y[i] for i in range(4)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        total, good = total + w, good + w * np.asarray(y)
    assert np.allclose(crf.marginals(u, trans, np.asarray([0, 0, 4])), good / total)
