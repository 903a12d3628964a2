"""Secret scans with one automaton for all rules."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import STOP, compile_rules, states
from .common import chunks

_KEY = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
#: Fixed values: (kind, pattern, least length of the last run, characters of that run). The first three are the base kinds, in order.
RULES = [
    ("assign", _KEY + "[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]", 8, "A-Za-z0-9+/_.=-"),
    ("access", "AKIA[A-Z0-9]", 12, "A-Z0-9"),
    ("hex", "[0-9a-f]{32}", 1, "0-9a-f"),
    ("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 1, "-"),
    ("github", "gh[pousr]_[A-Za-z0-9]", 36, "A-Za-z0-9"),
    ("slack", "xox[abprs]-[A-Za-z0-9-]", 10, "A-Za-z0-9-"),
    ("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]", 8, "A-Za-z0-9_-"),
    ("google", "AIza[A-Za-z0-9_-]", 35, "A-Za-z0-9_-"),
    ("stripe", "[sr]k_(live|test)_[A-Za-z0-9]", 16, "A-Za-z0-9"),
    ("url_login", "://[A-Za-z0-9._-]+:[A-Za-z0-9._~!$&*+=-]+@", 1, "@"),
]
BASE = 3
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _class(chars: str) -> np.ndarray:
    import re

    return np.asarray([bool(re.match(f"[{chars}]", chr(c))) if c < 128 else False for c in range(256)])


class Scanner:
    """All rules in one pass over bytes.

    The automaton finds the end of each rule's shortest match; the rule's own automaton read backwards finds
    where it began; the match then runs on over the rule's last class. Matches of a kind do not overlap, the
    leftmost first, and those with too short a last run are dropped.
    """

    def __init__(self, rules: list[tuple[str, str, int, str]] = RULES) -> None:
        self.rules = rules
        self.table, self.masks = compile_rules([r[1] for r in rules], search=True)
        self.back = [compile_rules([r[1]], search=False, backwards=True) for r in rules]
        self.run = [_class(r[3]) for r in rules]
        self.hot = self.masks[np.arange(len(self.masks))] != 0

    def scan(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """(rule, start, end) over texts that STOP bytes part."""
        seen = states(self.table, data)
        hits = np.flatnonzero(self.hot[seen])
        masks = self.masks[seen[hits]]
        found = []
        for k in range(len(self.rules)):
            free = 0
            ends = hits[(masks >> k) & 1 == 1].tolist()
            for e in ends:
                if e < free:
                    continue
                start = self._begin(k, data, e, free)
                if start is None:
                    continue
                end = e + 1
                while end < len(data) and self.run[k][data[end]]:
                    end += 1
                free = end
                if end - e >= self.rules[k][2]:
                    found.append((k, start, end))
        return found

    def _begin(self, k: int, data: np.ndarray, e: int, free: int) -> int | None:
        table, masks = self.back[k]
        s, at, best = 0, e, None
        while at >= free and data[at] != STOP:
            s = int(table[s, data[at]])
            if masks[s]:
                best = at
            elif s and (table[s, :STOP] == s).all():
                break
            at -= 1
        return best


_scanner: list[Scanner] = []


def find_secrets(texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans (rule, start, end) of every text in code points."""
    if not _scanner:
        _scanner.append(Scanner())
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = _scanner[0].scan(data)
    if found:
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte; the ends of texts count as one
        for k, s, e in found:
            i = int(np.searchsorted(begin, s, side="right")) - 1
            out[i].append((k, int(points[s] - points[begin[i]]), int(points[e] - points[begin[i]])))
    return out


def secrets(docs: DataFrame) -> DataFrame:
    """Secrets in every whole text. A null or empty text has none; repeated rows give repeated results.

    Texts may be of any length; columns other than doc_id and text are ignored.
    """
    names = [r[0] for r in RULES]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, rows = [t or "" for t in b.column(1).to_pylist()], []
            for i, j in chunks(texts):
                for found in find_secrets(texts[i:j]):
                    spans = [(s, k, e) for k, s, e in found]
                    base = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(x for x in spans if x[1] < BASE))
                    rows.append((*(sum(x[1] == k for x in spans) for k in range(BASE)), hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.record_batch([b.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 5, kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, SCHEMA)
