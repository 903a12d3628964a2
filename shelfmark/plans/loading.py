"""Nested documents of artists, albums and songs into the tables of a catalogue, and the tables back into documents.

One description of the tables, CATALOGUE, serves both ways: fan_out takes documents apart, documents puts them together
from the leaves up. A load is one plan: every document is checked first, a document that breaks a rule is left out whole,
with all rows that it would give in any table, and the rest changes the tables in order of what refers to what.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import ALBUM_TYPES, AUTHORITIES, GENRES, LOCALE_CODES, ROLES, decode_flags, encode_flags
from ..operators.aggregates import sequence_ids, spread, written
from .changes import diff_snapshots

#: How an artist relates to another.
RELATIONS = {"NONE": 0, "MEMBER_OF": 1}
_GENRE_BITS = {g: 1 << i for i, g in enumerate(GENRES)}


@dataclass(frozen=True)
class Child:
    """A table that is a list within its owner's document.

    columns: column -> where its value lies in an element; "" is the element itself, "#" its place, from 0. unique: columns
    that no two rows of one owner share; wide: that no two rows of the table share. ref: the column that names a row of the
    main table to. one: the flag that exactly one row of an owner has. names: columns that documents give by name.
    by_key: the list is an object, its elements are its keys and values.
    """

    table: str
    field: str
    columns: dict[str, str]
    unique: tuple[str, ...] = ()
    wide: tuple[str, ...] = ()
    ref: str = ""
    to: str = ""
    one: str = ""
    names: dict[str, dict[str, int]] = field(default_factory=dict)
    nullable: tuple[str, ...] = ()
    by_key: bool = False


@dataclass(frozen=True)
class Kind:
    """A main table: its key, column -> field of the document, its children. dealt: a document without id gets the next one."""

    table: str
    key: str
    columns: dict[str, str]
    schema: str
    children: tuple[Child, ...]
    names: dict[str, dict[str, int]] = field(default_factory=dict)
    flags: dict[str, dict[str, int]] = field(default_factory=dict)
    dates: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    dealt: bool = False


def _titles(table: str) -> Child:
    return Child(table, "title", {"locale": "key", "title": "value.text", "fallback": "value.primary"}, unique=("locale",), one="fallback", names={"locale": LOCALE_CODES}, by_key=True)


def _codes(table: str) -> Child:
    return Child(table, "authority", {"authority": "authority", "authority_code": "code"}, wide=("authority", "authority_code"), names={"authority": AUTHORITIES})


_SHARED = "id bigint, title map<string,struct<text:string,primary:boolean>>, authority array<struct<authority:string,code:string>>"
#: Main tables in order of what refers to what: three main tables, thirteen children.
CATALOGUE = (
    Kind("artists", "artist_id", {"artist_tag": "artistTag", "artwork": "artwork"}, f"{_SHARED}, artistTag bigint, artwork string, alias array<string>, relations array<struct<ref:bigint,role:string>>",
         (_titles("artist_titles"), Child("artist_alias", "alias", {"alias": ""}, unique=("alias",)), _codes("artist_authorities"),
          Child("artist_relations", "relations", {"ref_artist_id": "ref", "relation_to_ref": "role"}, unique=("ref_artist_id", "relation_to_ref"), ref="ref_artist_id", to="artists", names={"relation_to_ref": RELATIONS})), required=("artist_tag",)),
    Kind("albums", "album_id", {"album_type": "albumType", "artwork": "artwork", "disc_count": "discCount", "release_date": "releaseDate"}, f"{_SHARED}, albumType string, artwork string, discCount int, releaseDate string, artists array<bigint>, trackCounts array<struct<disc:int,trackCount:int>>",
         (_titles("album_titles"), Child("album_artists", "artists", {"artist_id": "", "display_order": "#"}, unique=("display_order",), ref="artist_id", to="artists"), _codes("album_authorities"),
          Child("album_track_counts", "trackCounts", {"disc_number": "disc", "track_count": "trackCount"}, unique=("disc_number",))), names={"album_type": ALBUM_TYPES}, dates=("release_date",), required=("album_type",)),
    Kind("songs", "song_id", {"audio": "audio", "duration": "duration", "genre_tag": "genreTag", "release_date": "releaseDate"}, f"{_SHARED}, audio string, duration bigint, genreTag string, releaseDate string, artists array<struct<id:bigint,displayTitle:string,role:string>>, albums array<struct<id:bigint,disc:int,track:int>>, locale array<struct<locale:string,primary:boolean>>",
         (_titles("song_titles"), Child("song_artists", "artists", {"artist_id": "id", "display_order": "#", "display_title": "displayTitle", "role": "role"}, unique=("display_order",), ref="artist_id", to="artists", names={"role": ROLES}, nullable=("display_title",)), _codes("song_authorities"),
          Child("song_locales", "locale", {"locale": "locale", "is_primary": "primary"}, unique=("locale",), one="is_primary", names={"locale": LOCALE_CODES}),
          Child("album_tracks", "albums", {"album_id": "id", "disc_number": "disc", "track_number": "track"}, wide=("album_id", "disc_number", "track_number"), ref="album_id", to="albums")), flags={"genre_tag": _GENRE_BITS}, dates=("release_date",), required=("duration", "genre_tag"), dealt=True),
)
DOCUMENT = "source string, " + ", ".join(f"{k.table} array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in k.schema.split(', '))}>>" for k in CATALOGUE)


def _lookup(value: Column, table: dict, back: bool = False) -> Column:
    pairs = F.create_map(*(F.lit(x) for name, n in table.items() for x in ((n, name) if back else (name, n))))
    return F.try_element_at(pairs, value)


def read_documents(docs: DataFrame, doc_id: str, text: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """({main table: rows (pos, fields)}, documents (doc_id) that are no object of source CLIPBOARD) of JSON texts.

    pos is (doc_id, place in the list), so a later document has the greater one. A value of a wrong type reads as null.
    """
    # written typed, as every kind and each of its rules reads it: documents are made and parsed once, a kind reads its own list alone
    d = written(docs.select(F.col(doc_id).alias("doc_id"), F.from_json(text, DOCUMENT, {"mode": "PERMISSIVE"}).alias("j")), "parsed")
    ok = F.coalesce(F.col("j.source") == "CLIPBOARD", F.lit(False))
    parts = {k.table: d.where(ok).select("doc_id", F.posexplode(F.col("j")[k.table]).alias("_place", "_r")).select(F.struct("doc_id", F.col("_place").alias("place")).alias("pos"), "_r.*") for k in CATALOGUE}
    return parts, d.where(~ok).select("doc_id")


def fan_out(kind: Kind, docs: DataFrame) -> dict[str, DataFrame]:
    """{table: rows keyed by pos} of typed documents of a kind (pos, id and the fields of its schema)."""

    def value(c: Column, col: str, spec: Kind | Child) -> Column:
        if col in getattr(spec, "flags", {}):
            return encode_flags(c, spec.flags[col])
        return _lookup(c, spec.names[col]) if col in spec.names else c

    out = {kind.table: docs.select("pos", F.col("id").alias(kind.key), *[value(F.col(f), c, kind).alias(c) for c, f in kind.columns.items()])}
    for child in kind.children:
        items = F.map_entries(child.field) if child.by_key else F.col(child.field)
        rows = docs.select("pos", F.posexplode(items).alias("_place", "_e"))
        at = lambda p: F.col("_place") if p == "#" else F.col("_e" + (f".{p}" if p else ""))
        out[child.table] = rows.select("pos", *[value(at(p), c, child).alias(c) for c, p in child.columns.items()])
    return out


def _own_errors(kind: Kind, rows: dict[str, DataFrame], tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, pos, rule, detail): what is wrong with a document by itself, or with what it shares with others but refs."""
    tell = lambda df, rule, detail: df.select(F.lit(kind.table).alias("kind"), "pos", F.lit(rule).alias("rule"), F.lit(detail).alias("detail")).distinct()
    main, key = rows[kind.table], F.col(kind.key)
    found = [tell(main.where((key <= 0) if kind.dealt else (key.isNull() | (key <= 0))), "id", kind.key)]
    found += [tell(main.where(F.col(c).isNull()), "missing", c) for c in kind.required]
    found += [tell(main.where(F.col(c).isNotNull() & F.col(c).try_cast("date").isNull()), "date", c) for c in kind.dates]
    for child in kind.children:
        own = rows[child.table]
        needed = [c for c in child.columns if c not in child.nullable]
        found.append(tell(own.where(reduce(Column.__or__, (F.col(c).isNull() for c in needed))), "missing", child.table))
        if child.unique:
            found.append(tell(own.groupBy("pos", *child.unique).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated", child.table))
        if child.one:
            flagged = own.where(child.one).groupBy("pos").agg(F.count(F.lit(1)).alias("n"))
            found.append(tell(main.join(spread(flagged), "pos", "left").where("n IS NULL OR n <> 1"), f"not one {child.one}", child.table))
        if child.wide:
            keyed = own.join(spread(main.select("pos", kind.key)), "pos").dropna(subset=list(child.wide))
            shared = keyed.groupBy(*child.wide).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*child.wide)
            found.append(tell(keyed.join(spread(shared), list(child.wide), "left_semi"), "repeated", child.table))
            held = tables[child.table].select(*child.wide, F.col(kind.key).alias("_owner"))
            found.append(tell(keyed.join(spread(held), list(child.wide)).where(~F.col("_owner").eqNullSafe(key)), "owned", child.table))
    return reduce(DataFrame.unionByName, found)


def _settled(kind: Kind, rows: dict[str, DataFrame], bad: DataFrame, known: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(ids of the kind that stand after the load, errors of rule reference).

    A reference holds if it names a row that the catalogue has or a document of the load that is not left out. Documents
    of one kind may refer to each other, so leaving one out may leave out others: each round keeps those
    whose references still hold. Rounds are as many as the longest chain of documents left out; only references to rows
    that the catalogue does not have are looked at. A document that is left out anyway is told of its references too.
    """
    main = rows[kind.table]
    alive = main.join(spread(bad.select("pos").distinct()), "pos", "left_anti").select("pos", F.col(kind.key).alias("id"))
    refs = {}
    for c in kind.children:
        if c.ref:
            given = rows[c.table].where(F.col(c.ref).isNotNull()).select("pos", F.col(c.ref).alias("ref"), F.lit(c.table).alias("detail"))
            refs.setdefault(c.to, []).append(given.join(spread(known[c.to].withColumnRenamed("id", "ref")), "ref", "left_anti").select("pos", "ref", "detail"))
    within = refs.pop(kind.table, [])
    groundless = [r for some in refs.values() for r in some]
    if within:
        unknown = written(reduce(DataFrame.unionByName, within), "refs")
        standing = alive if not groundless else alive.join(spread(reduce(DataFrame.unionByName, groundless).select("pos").distinct()), "pos", "left_anti")
        ids = written(standing.where("id IS NOT NULL"), "standing")
        more = True
        while more:
            last = unknown.join(spread(ids.select(F.col("id").alias("ref"))), "ref", "left_anti").select("pos", "ref", "detail")
            kept = written(ids.join(spread(last.select("pos").distinct()), "pos", "left_anti"), "standing")
            more = kept.count() < ids.count()
            ids = kept
        groundless.append(last)
    if not groundless:
        return known[kind.table].unionByName(alive.where("id IS NOT NULL").select("id")).distinct(), bad.limit(0)
    errors = written(reduce(DataFrame.unionByName, groundless).select(F.lit(kind.table).alias("kind"), "pos", F.lit("reference").alias("rule"), F.concat_ws(" ", "detail", F.col("ref").cast("string")).alias("detail")).distinct(), "groundless")
    left = alive.join(spread(errors.select("pos").distinct()), "pos", "left_anti")
    return known[kind.table].unionByName(left.where("id IS NOT NULL").select("id")).distinct(), errors


def load_plan(docs: dict[str, DataFrame], tables: dict[str, DataFrame], actor: str = "", reason: str = "") -> dict:
    """{rows: {table: rows to stand for the owners}, owners: {main table: ids}, errors: (kind, pos, rule, detail)}.

    docs: {main table: (pos, fields)}; of several documents of one id the last alone counts. A document that breaks a rule
    is left out whole. Rules: id (not positive, or none where ids are not dealt), missing (a required value, or one of a
    child's; a name that is unknown counts as missing, an unknown flag as none), date (no date), repeated (rows of one owner that must differ, or a code or track that two documents claim), owned (a code or
    track that another owner has), not one (not exactly one fallback title or primary locale), reference (to a row that
    neither the catalogue has nor the load brings). Songs without id take the next ids in order of pos.
    An empty load, and lists that are null or empty, are no error but for the rule not one. Ids and places of documents
    compress well, so their joins are shuffled and no table is gathered in the driver.
    """
    known = {k.table: tables[k.table].select(F.col(k.key).alias("id")) for k in CATALOGUE}
    plan: dict = {"rows": {}, "owners": {}, "errors": None}
    errors = []
    for kind in CATALOGUE:
        given = docs[kind.table]
        last = given.where("id IS NOT NULL").groupBy("id").agg(F.max("pos").alias("pos"))
        chosen = given.where("id IS NOT NULL").join(spread(last), ["id", "pos"], "left_semi").unionByName(given.where("id IS NULL"))
        rows = fan_out(kind, written(chosen, "documents"))
        own = written(_own_errors(kind, rows, tables), "errors")
        known[kind.table], unresolved = _settled(kind, rows, own, known)
        known[kind.table] = written(known[kind.table], "known")
        bad = own.unionByName(unresolved)
        errors.append(bad)
        good = rows[kind.table].join(spread(bad.select("pos").distinct()), "pos", "left_anti")
        if kind.dealt:
            top = tables[kind.table].select(kind.key).unionByName(good.select(kind.key)).agg(F.coalesce(F.max(kind.key), F.lit(0))).first()[0]
            fresh = sequence_ids(good.where(F.col(kind.key).isNull()), [F.col("pos")], "_n")
            fresh = fresh.withColumn(kind.key, (F.lit(top + 1) + F.col("_n")).cast("long")).drop("_n")
            good = good.where(F.col(kind.key).isNotNull()).unionByName(fresh)
        good = written(good, "rows")
        ids = good.select("pos", kind.key)
        like = lambda df, table: df.select(*[F.col(f.name).try_cast(f.dataType) for f in tables[table].schema])
        plan["rows"][kind.table] = like(good, kind.table)
        plan["owners"][kind.table] = ids.select(kind.key)
        for child in kind.children:
            plan["rows"][child.table] = like(rows[child.table].join(spread(ids), "pos"), child.table)
    plan["errors"] = reduce(DataFrame.unionByName, errors)
    plan["actor"], plan["reason"] = actor, reason
    return plan


def apply_load(tables: dict[str, DataFrame], plan: dict) -> dict[str, DataFrame]:
    """The tables after a plan: main rows inserted or set, all children of its owners replaced, those of other owners kept."""
    out = dict(tables)
    for kind in CATALOGUE:
        owners = plan["owners"][kind.table]
        for name in (kind.table, *(c.table for c in kind.children)):
            out[name] = tables[name].join(spread(owners), kind.key, "left_anti").select(*tables[name].columns).unionByName(plan["rows"][name])
    return out


def load_log(tables: dict[str, DataFrame], plan: dict) -> DataFrame:
    """(table, owner_id, operation, old_row, new_row, actor, reason): what applying a plan does.

    Main rows are logged where they are new or differ; every child of an owner as a deletion of each old row and an
    insertion of each new one.
    """
    out = []
    image = lambda df: F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    cols = lambda df, name, key, op, old, new: df.select(F.lit(name).alias("table"), F.col(key).cast("long").alias("owner_id"), op.alias("operation"), old.cast("string").alias("old_row"), new.cast("string").alias("new_row"))
    for kind in CATALOGUE:
        owners, key = plan["owners"][kind.table], kind.key
        old, new = tables[kind.table].join(owners, key, "left_semi"), plan["rows"][kind.table]
        d = diff_snapshots(old.select(*new.columns), new, [key])
        out.append(cols(d, kind.table, key, F.col("operation"), F.col("old_row"), F.col("new_row")))
        for child in kind.children:
            was, now = tables[child.table].join(owners, key, "left_semi"), plan["rows"][child.table]
            was = was.select(*now.columns)
            out.append(cols(was, child.table, key, F.lit("DELETE"), image(was), F.lit(None)))
            out.append(cols(now, child.table, key, F.lit("INSERT"), F.lit(None), image(now)))
    return reduce(DataFrame.unionByName, out).withColumns({"actor": F.lit(plan["actor"]), "reason": F.lit(plan["reason"])})


def nested(kind: Kind, tables: dict[str, DataFrame]) -> DataFrame:
    """(key, doc): the nested document of every row of a main table; each child is aggregated once, by its owner."""
    types = {x.split(" ", 1)[0]: x.split(" ", 1)[1] for x in kind.schema.split(", ")}

    def shown(c: str, spec: Kind | Child) -> Column:
        if c in getattr(spec, "flags", {}):
            return F.array_join(decode_flags(F.col(c), spec.flags[c]), ",")
        return _lookup(F.col(c).cast("int"), spec.names[c], back=True) if c in spec.names else F.col(c)

    d = tables[kind.table].select(kind.key, *[shown(c, kind).cast(types[f]).alias(f) for c, f in kind.columns.items()])
    for child in kind.children:
        own = tables[child.table]
        place = [c for c, p in child.columns.items() if p == "#"]
        parts = {p: shown(c, child) for c, p in child.columns.items() if p != "#"}
        if child.by_key:
            element = F.struct(parts.pop("key").alias("key"), F.struct(*[v.alias(p.removeprefix("value.")) for p, v in parts.items()]).alias("value"))
        else:
            element = parts[""] if "" in parts else F.struct(*[v.alias(p) for p, v in parts.items()])
        order = F.struct(*[F.col(c) for c in (place or child.columns)])
        packed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), element.alias("e")))), lambda x: x["e"])
        value = F.map_from_entries(packed) if child.by_key else packed
        d = d.join(own.groupBy(kind.key).agg(value.cast(types[child.field]).alias(child.field)), kind.key, "left")
        empty = F.map_from_arrays(F.array(), F.array()) if child.by_key else F.array()
        d = d.withColumn(child.field, F.coalesce(child.field, empty.cast(types[child.field])))
    return d.select(kind.key, F.struct(F.col(kind.key).alias("id"), *list(types)[1:]).alias("doc"))


def song_documents(tables: dict[str, DataFrame]) -> DataFrame:
    """(song_id, document): every song with its albums, and the artists of both and those that these relate to, as JSON.

    Levels are built from the leaves up: artists, albums and songs become documents once each and are then gathered under
    the songs that name them, so the work is the number of links and not of songs times the depth.
    """
    made = {k.table: nested(k, tables) for k in CATALOGUE}
    tracks = tables["album_tracks"].select("song_id", "album_id").distinct()
    direct = tables["song_artists"].select("song_id", "artist_id").unionByName(tracks.join(tables["album_artists"], "album_id").select("song_id", "artist_id")).distinct()
    related = direct.join(tables["artist_relations"].select("artist_id", "ref_artist_id"), "artist_id").select("song_id", F.col("ref_artist_id").alias("artist_id"))
    links = {"artists": ("artist_id", direct.unionByName(related).distinct()), "albums": ("album_id", tracks)}
    d = made["songs"].select("song_id", F.array("doc").alias("songs"))
    by_key = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)  # noqa: E731  documents hold maps, which have no order
    for name, (key, pairs) in links.items():
        got = pairs.join(made[name], key).groupBy("song_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "doc")), by_key), lambda x: x["doc"]).alias(name))
        d = d.join(got, "song_id", "left")
    empty = {n: F.coalesce(n, F.array().cast(d.schema[n].dataType)).alias(n) for n in links}
    return d.select("song_id", F.to_json(F.struct(F.lit("CLIPBOARD").alias("source"), empty["artists"], empty["albums"], "songs"), {"ignoreNullFields": "false"}).alias("document"))
