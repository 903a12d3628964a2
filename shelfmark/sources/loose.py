"""Typed reading of loose JSON: every value that breaks a rule is a row with its path, nothing is raised.

A document is a VARIANT. Rules name where a value lies and what it must be; each is checked with the type that the
variant itself has, so that "12" is a text and 12 a number. Lists are taken apart by variant_explode, so that a
document of any length becomes rows, and an element has the path of its place.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import locale_bit

#: What a variant's type is called, by the kind that a rule asks for.
KINDS = {"text": "STRING", "int": "BIGINT", "number": "DECIMAL|DOUBLE|FLOAT|BIGINT", "flag": "BOOLEAN", "list": "ARRAY", "object": "OBJECT"}
#: Forms of a date.
DATE_FORMS = ("yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")


@dataclass(frozen=True)
class Field:
    """A key of an object: its kind of KINDS, or date or texts (a list of texts); whether it may be null, or not be there."""

    key: str
    kind: str
    nullable: bool = False
    optional: bool = False


#: The rules of catalogue documents.
LOCALES = ("en", "fr", "ja", "ko", "zs", "zt")
LOCALIZED = tuple(Field(k, "text", nullable=True) for k in LOCALES)
CATALOGUE = {
    "artists": (Field("id", "text"), Field("artwork", "text", nullable=True)),
    "albums": (Field("id", "text"), Field("artistID", "texts"), Field("artwork", "text", nullable=True), Field("compilation", "flag"), Field("discCount", "int"), Field("preRelease", "flag"), Field("releaseDate", "date", nullable=True), Field("single", "flag"), Field("trackCount", "object"), Field("upc", "text", nullable=True)),
    "songs": (Field("id", "text"), Field("audio", "text", nullable=True), Field("albumID", "text"), Field("artistID", "texts"), Field("discNumber", "int"), Field("duration", "int"), Field("isrc", "text", nullable=True), Field("locale", "text", nullable=True), Field("playCount", "int"), Field("releaseDate", "date", nullable=True), Field("trackNumber", "int")),
}


def kind_of(v: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, DECIMAL, DOUBLE, ARRAY, OBJECT, or VOID for a JSON null; null where there is nothing."""
    return F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)


def get(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$['{key}']", kind)


def is_date(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(form)) for form in DATE_FORMS]).isNotNull()


def broken(v: Column, field: Field, path: Column, kind: Column | None = None) -> Column:
    """struct(path, rule) where the value at a key breaks its rule, else null: missing, null, type or date. kind: what kind_of says of it, where known."""
    kind = kind_of(get(v, field.key)) if kind is None else kind
    wanted = {"date": "text", "texts": "list"}.get(field.kind, field.kind)
    absent = F.lit(None) if field.optional else F.lit("missing")
    wrong = F.when(~kind.isin(*KINDS[wanted].split("|")), F.lit("type"))
    if field.kind == "date":
        wrong = wrong.when(~is_date(get(v, field.key, "string")), F.lit("date"))
    rule = F.when(kind.isNull(), absent).when(kind == "VOID", F.lit(None) if field.nullable else F.lit("null")).otherwise(wrong)
    return F.when(rule.isNotNull(), F.struct(F.concat(path, F.lit(f".{field.key}")).alias("path"), rule.cast("string").alias("rule")))


def elements(rows: DataFrame, v: str, path: str) -> DataFrame:
    """One row for each element of a list, or value of an object: the other columns, pos, key, value, at (its path).

    What is neither list nor object has none.
    """
    keep = [c for c in rows.columns if c not in (v, path)]
    rows = rows.select(*keep, F.col(path).alias("_path"), F.when(kind_of(F.col(v)).isin("ARRAY", "OBJECT"), F.col(v)).alias("_v")).where("_v IS NOT NULL")
    d = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    at = F.when(F.col("key").isNull(), F.concat("_path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("_path", F.lit("."), "key"))
    return d.select(*keep, "pos", "key", "value", at.alias("at"))


def _listed(v: Column, level: str, path: Column, objects: bool = False) -> Column:
    """array of (level, path, value): the elements of a list, with objects also the values of an object; else null."""
    one = lambda at, x: F.struct(F.lit(level).alias("level"), F.concat(path, at).alias("path"), x.alias("value"))
    found = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: one(F.concat(F.lit("["), i.cast("string"), F.lit("]")), x))
    if not objects:
        return found
    return F.coalesce(found, F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: one(F.concat(F.lit("."), e["key"]), e["value"])))


#: What is checked as an object, by its level.
_LEVELS = {"document": (Field("source", "text"), Field("time", "date"), *(Field(k, "list") for k in CATALOGUE)), **{k: (*f, Field("title", "object")) for k, f in CATALOGUE.items()}, "title": LOCALIZED}


def check_catalogue(docs: DataFrame, doc_id: str, text: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(artists, albums and songs as rows (doc_id, pos, value), violations (doc_id, path, rule)) of catalogue documents.

    Rules: json for a text that is none; the document an object, source and time texts; the three lists there; each
    element as CATALOGUE says, its title with all of LOCALES, texts or null. A value that is no object breaks the rule of
    its own path alone. A text is parsed once and the kind of each value found once: documents become rows of what
    is to be checked (the document, its elements, their titles and listed texts), and each row an array of what is broken.
    """
    d = docs.select(doc_id, F.try_parse_json(text).alias("_doc"))
    piece = lambda level, path, value: F.struct(F.lit(level).alias("level"), path.alias("path"), value.alias("value"))
    none = F.array().cast("array<struct<level:string,path:string,value:variant>>")
    level, path, v = F.col("_p.level"), F.col("_p.path"), F.col("_p.value")
    lists = [F.coalesce(_listed(get(F.col("_doc"), k), k, F.lit(f"$.{k}")), none) for k in CATALOGUE]
    rows = d.select(doc_id, F.explode(F.concat(F.array(piece("document", F.lit("$"), F.col("_doc"))), *lists)).alias("_p"))
    below = F.when(level.isin(*CATALOGUE), F.array(piece("title", F.concat(path, F.lit(".title")), get(v, "title"))))
    for name, fields in CATALOGUE.items():
        for f in fields:
            if f.kind == "texts":
                below = F.concat(below, F.coalesce(F.when(level == name, _listed(get(v, f.key), "listed", F.concat(path, F.lit(f".{f.key}")), objects=True)), none))
    rows = rows.select(doc_id, F.explode(F.concat(F.array(F.col("_p")), F.coalesce(below, none))).alias("_p"))
    choose = lambda of: reduce(lambda c, kv: c.when(level == kv[0], of(kv[1])), _LEVELS.items(), F)
    rows = rows.select(doc_id, "_p", kind_of(v).alias("_kind"), choose(lambda fields: F.array(*[kind_of(get(v, f.key)) for f in fields])).alias("_kinds"))
    each = choose(lambda fields: F.array(*[broken(v, f, path, F.get("_kinds", F.lit(i))) for i, f in enumerate(fields)]))
    own = lambda rule: F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))
    kind = F.col("_kind")
    found = F.when((level == "document") & v.isNull(), own("json")).when(level == "listed", F.when(F.coalesce(kind != "STRING", F.lit(True)), own("type")))
    found = found.when(F.coalesce(kind != "OBJECT", F.lit(True)), F.when(level != "title", own("type"))).otherwise(F.array_compact(each))
    parts = {k: d.select(doc_id, F.posexplode(F.try_variant_get("_doc", f"$.{k}", "array<variant>")).alias("pos", "value")) for k in CATALOGUE}
    return parts, rows.select(doc_id, F.explode(found).alias("_x")).select(doc_id, "_x.path", "_x.rule")


def as_id(v: Column) -> Column:
    """A positive whole number, or a text of digits that is one; else null."""
    kind = kind_of(v)
    text = F.trim(F.try_variant_get(v, "$", "string"))
    n = F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint")).when((kind == "STRING") & text.rlike("^[0-9]+$"), F.try_to_number(text, F.lit("9" * 18)).cast("long"))
    return F.when(n > 0, n)


def as_enum(v: Column, names: dict[str, int]) -> Column:
    """The value of an enum by name, in any case, blanks and hyphens as underscores, or by number; else null."""
    kind, text = kind_of(v), F.translate(F.upper(F.trim(F.try_variant_get(v, "$", "string"))), "- ", "__")
    by_name = F.coalesce(*[F.when(text == n, F.lit(x)) for n, x in names.items()])
    number = F.try_variant_get(v, "$", "int")
    return F.when(kind == "STRING", by_name).when((kind == "BIGINT") & number.isin(*names.values()), number)


def as_flags(v: Column, bits: dict[str, int]) -> Column:
    """A mask: a number, a text of one, names between commas, or a list of these; null where a name is unknown."""
    kind, text = kind_of(v), F.trim(F.try_variant_get(v, "$", "string"))
    mask = F.try_variant_get(v, "$", "bigint")
    table = F.create_map(*(F.lit(x) for kv in bits.items() for x in kv))

    def of_text(t: Column) -> Column:
        names = F.filter(F.transform(F.split(t, ","), lambda n: F.translate(F.upper(F.trim(n)), "- ", "__")), lambda n: (n != "") & (n != "NONE"))
        named = F.aggregate(names, F.lit(0).cast("long"), lambda a, n: a.bitwiseOR(table[n].cast("long")))
        return F.when(t.rlike("^[0-9]{1,18}$"), F.try_to_number(t, F.lit("9" * 18)).cast("long")).otherwise(named)

    parts = F.transform(F.try_variant_get(v, "$", "array<string>"), F.trim)
    listed = F.aggregate(parts, F.lit(0).cast("long"), lambda a, t: a.bitwiseOR(of_text(t)))
    return F.when(kind == "BIGINT", mask).when(kind == "STRING", of_text(text)).when(kind == "ARRAY", listed)


def title_rows(rows: DataFrame, v: str, path: str) -> DataFrame:
    """The other columns, locale, title, fallback, rule, path: one row for each title of any loose form, each once.

    An object of locales, whose values are texts or objects (text, primary); a list of objects (locale, title or text,
    fallback or primary); a text, which is the undetermined locale's and the fallback; an object with attributes that
    has one of these as name or title. rule is type where a title is no text, empty where it is blank.
    """
    keep = [c for c in rows.columns if c not in (v, path)]
    inner = F.coalesce(get(get(F.col(v), "attributes"), "title"), get(get(F.col(v), "attributes"), "name"))
    d = rows.select(*keep, F.coalesce(inner, F.col(v)).alias("_v"), F.when(inner.isNotNull(), F.concat(path, F.lit(".attributes"))).otherwise(F.col(path)).alias("_p"))
    kind = kind_of(F.col("_v"))
    plain = d.where(kind == "STRING").select(*keep, F.lit("und").alias("tag"), F.col("_v").alias("t"), F.lit(True).alias("fallback"), F.col("_p").alias("path"))
    each = elements(d, "_v", "_p")
    value = F.col("value")
    is_object = kind_of(value) == "OBJECT"
    named = each.where("key IS NOT NULL").select(*keep, F.col("key").alias("tag"), F.when(is_object, get(value, "text")).otherwise(value).alias("t"), F.coalesce(get(value, "primary", "boolean"), F.lit(False)).alias("fallback"), F.col("at").alias("path"))
    listed = each.where("key IS NULL").select(*keep, F.coalesce(get(value, "locale", "string"), F.lit("und")).alias("tag"), F.coalesce(get(value, "title"), get(value, "text")).alias("t"), F.coalesce(get(value, "fallback", "boolean"), get(value, "primary", "boolean"), F.lit(False)).alias("fallback"), F.col("at").alias("path"))
    out = plain.unionByName(named).unionByName(listed)
    title = F.trim(F.try_variant_get("t", "$", "string"))
    rule = F.when(F.coalesce(kind_of(F.col("t")) != "STRING", F.lit(True)), "type").when(title == "", "empty")
    return out.select(*keep, locale_bit(F.lower("tag")).alias("locale"), F.when(rule.isNull(), title).alias("title"), "fallback", rule.alias("rule"), "path").distinct()


def one_of(titles: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """keys, rule: owners with no title at all, or not exactly one that is flagged."""
    n = titles.groupBy(*keys).agg(F.count_if(F.col("rule").isNull()).alias("n"), F.count_if(F.col("rule").isNull() & F.col(flag)).alias("flagged"))
    return n.where("n = 0 OR flagged <> 1").select(*keys, F.when(F.col("n") == 0, "no title").otherwise("not one " + flag).alias("rule"))
