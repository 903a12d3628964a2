"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, a span classifier decides."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base kinds in order, then the kinds that only the method adds.
BASE = ("email", "ip", "card", "phone")
EXTRA = ("spoken_email", "ip6", "plain_phone", "iban", "national_id", "name", "birth_date")
KINDS = BASE + EXTRA
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "spoken_email": r"\b[\w.]{1,64} ?[\[(]?\bat\b[\])]? ?[\w-]{1,63} ?[\[(]?\bdot\b[\])]? ?[a-z]{2,8}\b",
    "ip6": r"\b(?:[0-9a-f]{1,4}:){5,7}[0-9a-f]{1,4}\b",
    "plain_phone": r"(?<![\w+.])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?!\w)",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "national_id": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Madame|Monsieur)\.? [A-ZÀ-Þ][\w'-]{1,30}(?: [A-ZÀ-Þ][\w'-]{1,30})?",
    "birth_date": r"\b(?:born|dob|date of birth|geboren|nacido|née?)\b[ :,a-z]{0,12}[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}",
}
#: Written for this library from common knowledge: frequent top-level domains, country calling codes, the countries
#: whose IBANs are frequent, and frequent given names. Not complete: a labeler may be wrong, its reliability is estimated.
_DOMAINS = "com org net edu gov mil int info biz name io ai app dev me tv co de fr es it uk eu ie nl be ch at dk se no fi pl pt cz gr hu ro ru ua tr il in cn jp kr au nz ca us mx br ar cl za".split()
GAZETTEER = {
    "email": frozenset(_DOMAINS),
    "spoken_email": frozenset(_DOMAINS),
    "phone": frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()),
    "iban": frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split()),
    "name": frozenset("Alice Anna Antonio Carlos Carmen Charles Charlotte Christine Claire Daniel David Elena Elizabeth Emma Eva François Frank Hans Heinrich Isabel James Jean Jennifer John José Juan Julia Karl Klaus Laura Linda Louis Lucia Luis Manuel Marc María Maria Marie Mary Michael Miguel Nicolas Patricia Paul Pedro Peter Pierre Richard Robert Sarah Sophie Stefan Susan Thomas Ursula William Wolfgang".split()),
}
POSITIVE = re.compile(r"(?i)\b(e-?mail|mail|correo|courriel|phone|tel|call|fax|mobile|telefon|teléfono|téléphone|card|visa|credit|account|iban|ssn|social security|address|name|contact|born|ip|host|server|login)\b[^\n]{0,25}$")
NEGATIVE = re.compile(r"(?i)\b(version|v|release|section|chapter|isbn|issn|order|page|figure|table|build|serial|part no)\.?\s{0,2}$")
_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9]++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_TITLES = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Madame", "Monsieur")
_WORD = re.compile(r"\w+")
_RUNS = re.compile(r"[A-ZÀ-Þ]+|[^\W\dA-ZÀ-Þ_]+|\d+")
VOTES = ("regex", "gazetteer", "context", "against", "edge")
#: What the classifier sees besides kind and votes: two bits of form, the span's shape and the word before it, both
#: hashed to so many buckets, which bounds the table of patterns that reaches the driver.
SEEN = ("many_digits", "separators", "shape", "word")
SHAPES = 16
WORDS = 32
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        parts = [p.lstrip("0") for p in s.split(".")]
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
    digits = "".join(c for c in s if "0" <= c <= "9")
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "iban":
        t = s.replace(" ", "")
        return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1
    if kind == "national_id":
        return s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the email pattern, from one @ to the next, in linear time."""
    end = at = 0
    while (sign := text.find("@", at)) >= 0:
        first = max(end, at)
        begin = first + len(text[first:sign].rstrip(_LOCAL))
        at = sign + 1
        if begin < sign and (m := _DOMAIN.match(text, at)):
            yield begin, m.end()
            end = m.end()


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the ip pattern: of each dotted run of numbers four parts after four, in linear time."""
    for m in _DOTTED.finditer(text):
        ends = [x.end() for x in _DIGITS.finditer(text, m.start(), m.end())]
        begins = [m.start(), *(e + 1 for e in ends)]
        for k in range(0, len(ends) - 3, 4):
            yield begins[k], ends[k + 3]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds: leftmost matches that do not overlap, failing ones dropped."""
    out = []
    if "@" in text:
        out += [(0, s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        out += [(1, s, e) for s, e in _ips(text) if _valid("ip", text[s:e])]
        for k in (2, 3):
            if k != 3 or "+" in text:
                out += [(k, m.start(), m.end()) for m in _COMPILED[KINDS[k]].finditer(text) if _valid(KINDS[k], m[0])]
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Base spans, then spans of the added kinds that overlap neither those nor each other."""
    out = base_spans(text)
    taken: list[tuple[int, int]] = []  # joined, in order
    for s, e in sorted((s, e) for _, s, e in out):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    digit = bool(_DIGIT.search(text))
    for k in range(len(BASE), len(KINDS)):
        kind = KINDS[k]
        if kind == "spoken_email" and not ("at" in text and "dot" in text) or kind == "name" and not any(t in text for t in _TITLES) or kind == "ip6" and text.count(":") < 5:
            continue
        if kind not in ("spoken_email", "name", "ip6") and not digit:
            continue
        for m in _COMPILED[kind].finditer(text):
            i = bisect_left(taken, (m.end(), 0))
            if not i or taken[i - 1][1] <= m.start():
                out.append((k, m.start(), m.end()))
                taken.insert(i, (m.start(), m.end()))
    return out


def votes(text: str, k: int, s: int, e: int) -> tuple[int, ...]:
    """Each labeler's vote on a span: 1 for, -1 against, 0 none; then what only the classifier sees: see SEEN."""
    kind, span = KINDS[k], text[s:e]
    digits = sum(c.isdigit() for c in span)
    known = GAZETTEER.get(kind)
    if kind in ("email", "spoken_email"):
        hit = re.split(r"[.\s]", span)[-1].lower()
    elif kind == "phone":
        hit = next((span[1 : 1 + n] for n in (2, 1) if span[1 : 1 + n] in known), "")
    elif kind == "iban":
        hit = span[:2]
    else:
        hit = span.replace(".", " ").split()[1:2] if kind == "name" else ""
        hit = hit[0] if hit else ""
    before = text[max(0, s - 40) : s]
    edge = (s == 0 or not (text[s - 1].isalnum() or text[s - 1] in "._-")) and (e == len(text) or not (text[e].isalnum() or text[e] == "_"))
    return (
        1 if _valid(kind, span) else -1,
        0 if known is None else 1 if hit in known else -1,
        1 if POSITIVE.search(before) else 0,
        -1 if NEGATIVE.search(before) else 0,
        1 if edge else -1,
        int(digits >= 9),
        int(any(c in " -.()" for c in span)),
        zlib.crc32(_shape(span).encode()) % SHAPES,
        zlib.crc32((_WORD.findall(before.lower()) or [""])[-1].encode()) % WORDS,
    )


def _shape(span: str) -> str:
    """Runs of capitals, letters and digits as one sign each, other characters as they are."""
    return _RUNS.sub(lambda m: "A" if m[0][0].isupper() else "0" if m[0][0].isdigit() else "a", span)


def weigh(table: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: P(personal) of each, and each labeler's reliability.

    Labelers are taken as independent given the truth, with smoothed rates that lean towards honest voting, so
    that a corpus with few candidates keeps to the majority.
    """
    v = table[:, 1 : 1 + len(VOTES)] + 1
    lean = np.asarray([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])  # truth: not, is
    p = 1 / (1 + np.exp(-(v - 1).sum(1)))
    rate = np.ones((len(VOTES), 2, 3))
    for _ in range(rounds):
        prior = ((n * p).sum() + 2) / (n.sum() + 4)
        for j in range(len(VOTES)):
            for y, w in ((0, 1 - p), (1, p)):
                c = np.bincount(v[:, j], weights=n * w, minlength=3) + 5 * lean[y]
                rate[j, y] = c / c.sum()
        odds = np.log(prior / (1 - prior)) + sum(np.log(rate[j, 1, v[:, j]] / rate[j, 0, v[:, j]]) for j in range(len(VOTES)))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - p).max() < 1e-7:
            break
        p = new
    return p, np.stack([rate[:, 1, 2], rate[:, 0, 0]], 1)


def _inputs(table: np.ndarray) -> np.ndarray:
    kinds = np.eye(len(KINDS))[table[:, 0]]
    v = table[:, 1 : 1 + len(VOTES)]
    digits, separators, shape, word = table[:, -4:].T
    return np.concatenate([kinds, v == 1, v == -1, digits[:, None], separators[:, None], np.eye(SHAPES)[shape], np.eye(WORDS)[word], np.ones((len(table), 1))], 1).astype(float)


def fit(rows: list) -> dict:
    """The span classifier: logistic regression on the weighed patterns. rows: (kind, votes, SEEN, count)."""
    if not rows:
        rows = [(k, 1, 0, 0, 0, 1, 0, 0, 0, 0, 1) for k in range(len(BASE))]
    a = np.asarray(rows, np.int64)
    p, reliability = weigh(a[:, :-1], a[:, -1].astype(float))
    x, n = _inputs(a[:, :-1]), a[:, -1].astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * q * (1 - q))[:, None]).T @ x + np.eye(len(w)) * 0.5
        w = w - np.linalg.solve(h, x.T @ (n * (q - p)) + 0.5 * w)
    return {"w": w, "reliability": reliability}


def pattern_counts(docs: DataFrame) -> DataFrame:
    """How often each (kind, votes, SEEN) occurs among all candidates; a bounded table."""
    names = ["kind", *VOTES, *SEEN]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *votes(t, k, s, e)) for t in b.column(0).to_pylist() if t for k, s, e in candidates(t)]
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.record_batch([pa.array(c, pa.int32()) for c in cols], names=names)

    return docs.select("text").mapInArrow(scan, ", ".join(f"{n} int" for n in names)).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def decide(text: str, w: np.ndarray, keep_at: float = 0.5) -> list[tuple[int, int, int]]:
    """All spans of a text: base ones stay, added ones where the classifier says so."""
    found = candidates(text)
    extra = [x for x in found if x[0] >= len(BASE)]
    if extra:
        table = np.asarray([(k, *votes(text, k, s, e)) for k, s, e in extra])
        keep = 1 / (1 + np.exp(-np.clip(_inputs(table) @ w, -30, 30))) >= keep_at
        found = [x for x in found if x[0] < len(BASE)] + [x for x, y in zip(extra, keep) if y]
    return sorted(found)


def trained(docs: DataFrame) -> dict:
    """The classifier of this corpus: votes over all its candidates."""
    return fit(sorted(tuple(r) for r in pattern_counts(docs).collect()))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span as [kind]; of overlapping spans, the union goes under the first's name."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text. A null or empty text has none; repeated rows give repeated results."""
    w = trained(docs)["w"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                found = decide(t, w) if t else []
                base = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in found if k < len(BASE))
                rows.append((*(sum(x[0] == k for x in found) for k in range(4)), hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in found)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.record_batch([b.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 6, kinds))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, SCHEMA)


def redacted(docs: DataFrame) -> DataFrame:
    """The same rows and columns with personal data replaced in text; a null text stays null."""
    w = trained(docs)["w"]
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [redact(t, decide(t, w)) if t else t for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(scan, docs.schema)
