"""Typed rule filters: Column builders over a catalogue of fields; a list of rules is a conjunction."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_latin

MAX_RULES = 20
#: What a pattern may hold besides letters, digits and white space.
_PATTERN_SIGNS = ".,:_/^$*+?[]-"
_SAFE = 2**53 - 1
_COMPARE = {"gt": "__gt__", "gte": "__ge__", "eq": "__eq__", "ne": "__ne__", "lte": "__le__", "lt": "__lt__"}


def _compare(col: Column, op: str, value) -> Column:
    if op not in _COMPARE:
        raise ValueError(f"unknown operator {op}")
    return getattr(col, _COMPARE[op])(F.lit(value))


def number_pred(col: Column, op: str, value: int) -> Column:
    if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value <= _SAFE:
        raise ValueError("a number rule takes a non-negative safe integer")
    return _compare(col, op, value)


def date_pred(col: Column, op: str, value: str) -> Column:
    """Compares the ISO day; impossible days are refused."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        raise ValueError("a date rule takes YYYY-MM-DD")
    return _compare(F.to_date(col), op, date.fromisoformat(value))


def duration_pred(col: Column, op: str, ms: int, slack: int = 1000) -> Column:
    """Milliseconds with a second of slack, which counts as equal."""
    d = col - F.lit(ms)
    made = {"eq": F.abs(d) < slack, "ne": F.abs(d) >= slack, "gt": d >= slack, "gte": d > -slack, "lt": d <= -slack, "lte": d < slack}
    if op not in made:
        raise ValueError(f"unknown operator {op}")
    return made[op]


def flag_pred(col: Column, mask: int, known: int = (1 << 41) - 1) -> Column:
    """All asked bits set; 0 asks for exactly none."""
    if mask & ~known:
        raise ValueError("unknown bits")
    return col == 0 if mask == 0 else col.bitwiseAND(F.lit(mask).cast("long")) == mask


def enum_pred(col: Column, value, members) -> Column:
    if value not in members:
        raise ValueError(f"{value!r} is not a member")
    return col == value


def text_pred(col: Column, op: str, value: str) -> Column:
    """is, isNot, contains, notContains, matches; both sides without accents and case.

    A pattern has at most 80 characters, letters, digits, white space and a few signs, and at most two
    quantifiers, no two of them side by side.
    """
    if len(value) > 200:
        raise ValueError("a text rule takes at most 200 characters")
    have, want = fold_latin(col), fold_latin(F.lit(value))
    if op in ("is", "isNot"):
        return (have == want) if op == "is" else (have != want)
    if op in ("contains", "notContains"):
        hit = F.contains(have, want)
        return hit if op == "contains" else ~hit
    if op == "matches":
        plain = all(unicodedata.category(c)[0] in "LN" or c.isspace() or c in _PATTERN_SIGNS for c in value)
        if not value or len(value) > 80 or not plain or re.search(r"[*+?]{2}", value) or len(re.findall(r"[*+?]", value)) > 2:
            raise ValueError("this pattern is not supported")
        try:
            re.compile(value)
        except re.error as e:
            raise ValueError("this is no pattern") from e
        return F.rlike(have, want)
    raise ValueError(f"unknown operator {op}")


def array_pred(col: Column, op: str, value: str) -> Column:
    """Positive operators ask for some element; negative ones that no element equals or contains. A null array has none."""
    if op in ("isNot", "notContains"):
        return ~F.coalesce(F.exists(col, lambda x: text_pred(x, "is" if op == "isNot" else "contains", value)), F.lit(False))
    return F.coalesce(F.exists(col, lambda x: text_pred(x, op, value)), F.lit(False))


def rel_pred(df: DataFrame, related: DataFrame, key: str, wanted: bool = True) -> DataFrame:
    return df.join(related.select(key).distinct(), key, "left_semi" if wanted else "left_anti")


def apply_rules(df: DataFrame, catalogue: dict[str, str], rules: list[dict]) -> DataFrame:
    """catalogue: field to kind (number, date, duration, flag, text, array, or a tuple of enum members)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    made = {"number": number_pred, "date": date_pred, "duration": duration_pred, "text": text_pred, "array": array_pred}
    preds: list[Column] = []
    for r in rules:
        kind = catalogue.get(r["field"])
        if kind is None:
            raise ValueError(f"unknown field {r['field']}")
        col = F.col(r["field"])
        if kind == "flag":
            preds.append(flag_pred(col, r["value"]))
        elif isinstance(kind, tuple):
            preds.append(enum_pred(col, r["value"], kind))
        else:
            preds.append(made[kind](col, r["operator"], r["value"]))
    return df.where(reduce(Column.__and__, preds)) if preds else df


def visible(df: DataFrame, resource: str, status: str | None = None, category: str | None = None, everything: bool = False) -> DataFrame:
    """Default visibility: confirmed mappings, open issues, groups not yet confirmed; everything lifts it for the last two.

    A status asked for goes before it. Of mappings the category incoming is those of source type 1, pending the
    pending ones.
    """
    if category not in (None, "incoming", "pending"):
        raise ValueError(f"unknown category {category}")
    if resource == "mappings" and category:
        df = df.where(F.col("source_type") == 1) if category == "incoming" else df if status else df.where(F.col("status") == "pending")
    if status is not None:
        return df.where(F.col("status") == status)
    if category or everything and resource in ("issues", "groups"):
        return df
    rules: dict[str, Callable[[], Column]] = {"mappings": lambda: F.col("status") == "confirmed", "issues": lambda: F.col("resolved_at").isNull(), "groups": lambda: F.col("status") != "confirmed"}
    return df.where(rules[resource]()) if resource in rules else df


def search(df: DataFrame, key: str, term: str, sources: list[tuple[DataFrame, str]]) -> DataFrame:
    """Rows of which the key occurs in some source (key, text) whose text contains the term."""
    keys = reduce(DataFrame.unionByName, (s.where(text_pred(F.col(c), "contains", term)).select(key) for s, c in sources))
    return df.join(keys.distinct(), key, "left_semi")


def row_search(df: DataFrame, term: str) -> DataFrame:
    return df.where(F.contains(fold_latin(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})), fold_latin(F.lit(term))))


def group_member_filter(groups: DataFrame, members: DataFrame, key: str, rules: list[tuple[Column, bool]]) -> DataFrame:
    """Positive rules ask for some member; negative ones that none fits."""
    for pred, positive in rules:
        groups = groups.join(members.where(pred).select(key).distinct(), key, "left_semi" if positive else "left_anti")
    return groups


def mapped_filter(best: DataFrame, mode: str, status: str = "status") -> DataFrame:
    """MAPPED, UNMAPPED, or a status of the best mapping."""
    if mode == "MAPPED":
        return best.where(F.col(status).isNotNull())
    return best.where(F.col(status).isNull() if mode == "UNMAPPED" else F.col(status) == mode)
