"""A match plan as changes of tables: the dry run counts them, the application makes them, a second run finds none.

Tables: mappings (matching.MAPPING), issues (issue_id, entry_id, song_id, method, reason, details as JSON), groups
(group_id, status, method, confidence, members, codes, min_duration, max_duration), members (group_id, entry_id),
group_issues (group_id, issue_id). Planned: mappings, issues without issue_id, groups (entry_id, group_id: any label) and
entries (entry_id, raw_duration, isrc). Every change is found by joins on keys; the one number that comes to the driver
is the largest id of a table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import sequence_ids, written
from . import matching as M

#: The source type that is matched, who matches and why, and the issues that the stages' reasons become.
STORE = 1
ACTOR, REASON = "matcher", "automatic matching"
REASONS = {"title": "TITLE_CONFLICT", "duration": "DURATION_MISMATCH", "artist": "ARTIST_CONFLICT", "authority": "AUTHORITY_CONFLICT", "multiple": "MULTIPLE_CANDIDATES", "no_candidate": "NO_CANDIDATE"}
_JSON = {"ignoreNullFields": "false"}
ISSUE = ["entry_id", "song_id", "method", "reason", "details"]


def canonical(details: Column) -> Column:
    """JSON without blanks, its keys in order; text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(details)), details)


def _next_id(df: DataFrame, col: str) -> int:
    return (df.agg(F.max(col)).first()[0] or 0) + 1


def mapping_changes(current: DataFrame, planned: DataFrame) -> DataFrame:
    """Planned mappings with before (struct or null) and action.

    skipped: confirmed, while the entry is confirmed for another song, in the table or by a surer row of the plan (of
    ties the least song). untouched: the pair is confirmed or rejected already. kept: equal. Else inserted or updated.
    """
    taken = current.where("status = 'confirmed'").groupBy("entry_id").agg(F.min("song_id").alias("_taken"))
    surest = planned.where("status = 'confirmed'").groupBy("entry_id").agg(F.min_by("song_id", F.struct(-F.col("confidence"), F.col("song_id"))).alias("_surest"))
    row = F.struct("method", "confidence", "status")
    d = planned.join(taken, "entry_id", "left").join(surest, "entry_id", "left").join(current.select("entry_id", "song_id", row.alias("before")), ["entry_id", "song_id"], "left")
    elsewhere = (F.col("status") == "confirmed") & (F.coalesce("_taken", "_surest") != F.col("song_id"))
    action = F.when(elsewhere, "skipped").when(F.col("before.status").isin("confirmed", "rejected"), "untouched").when(F.col("before").isNull(), "inserted").when(F.col("before") == row, "kept").otherwise("updated")
    return d.select(*M.MAPPING, "before", action.alias("action"))


def issue_changes(current: DataFrame, planned: DataFrame) -> DataFrame:
    """Planned issues, equal ones once, with issue_id and action: kept where an equal one exists, else inserted.

    Equal: null equal to null in all columns, details as canonical JSON. New ids follow the largest, in order of entry.
    """
    key = F.sha2(F.to_json(F.struct("entry_id", "song_id", "method", "reason", canonical(F.col("details")).alias("details")), _JSON), 256)
    there = current.groupBy(key.alias("_key")).agg(F.min("issue_id").alias("_id"))
    new = planned.select(*ISSUE, key.alias("_key")).groupBy("_key").agg(F.min(F.struct(*ISSUE)).alias("_row")).select("_key", "_row.*")
    d = written(new.join(there, "_key", "left"), "issues")
    order = ["entry_id", "reason", F.col("song_id").asc_nulls_first(), F.col("method").asc_nulls_first(), "_key"]
    fresh = sequence_ids(d.where("_id IS NULL"), order, "_at").withColumn("issue_id", F.col("_at") + _next_id(current, "issue_id"))
    out = lambda df, action: df.select("issue_id", *ISSUE, F.lit(action).alias("action"))
    return out(fresh, "inserted").unionByName(out(d.where("_id IS NOT NULL").withColumn("issue_id", F.col("_id").cast("long")), "kept"))


def group_changes(groups: DataFrame, members: DataFrame, planned: DataFrame, entries: DataFrame) -> DataFrame:
    """Planned groups: group_id, label, what they are (status, method, confidence, members, codes, min_ and max_duration), action.

    A pending group of exactly the same members is kept (the least of several), found by counts of shared members, as no
    group's members are gathered in a row. Others are inserted; ids follow the largest, in order of label.
    """
    p = planned.select("entry_id", F.col("group_id").alias("label")).distinct()
    own = members.join(groups.where("status = 'pending'").select("group_id"), "group_id", "left_semi").select("group_id", "entry_id").distinct()
    size, there = p.groupBy("label").agg(F.count(F.lit(1)).alias("_p")), own.groupBy("group_id").agg(F.count(F.lit(1)).alias("_c"))
    shared = p.join(own, "entry_id").groupBy("label", "group_id").agg(F.count(F.lit(1)).alias("_n"))
    same = shared.join(size, "label").join(there, "group_id").where("_n = _p AND _n = _c").groupBy("label").agg(F.min("group_id").alias("_id"))
    code = F.when(F.trim("isrc") != "", F.col("isrc"))
    facts = p.join(entries.select("entry_id", "raw_duration", "isrc"), "entry_id", "left").groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.count_distinct(code).alias("codes"), F.min("raw_duration").alias("min_duration"), F.max("raw_duration").alias("max_duration"))
    many = F.col("members") > 1
    facts = facts.withColumns({"status": F.lit("pending"), "method": F.when(many, "EXACT"), "confidence": F.when(many & (F.col("codes") > 0), 0.98).when(many, 0.90)})
    d = written(facts.join(same, "label", "left"), "groups")
    fresh = sequence_ids(d.where("_id IS NULL"), ["label"], "_at").withColumn("group_id", F.col("_at") + _next_id(groups, "group_id"))
    out = lambda df, action: df.select("group_id", "label", "status", "method", "confidence", "members", "codes", "min_duration", "max_duration", F.lit(action).alias("action"))
    return out(fresh, "inserted").unionByName(out(d.where("_id IS NOT NULL").withColumn("group_id", F.col("_id").cast("long")), "kept"))


def plan_changes(tables: dict[str, DataFrame], planned: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All changes of a plan, nothing of it applied: mappings, issues, groups; members and group_issues that are new."""
    mappings = written(mapping_changes(tables["mappings"], planned["mappings"]), "mapping_changes")
    issues = written(issue_changes(tables["issues"], planned["issues"]), "issue_changes")
    groups = written(group_changes(tables["groups"], tables["members"], planned["groups"], planned["entries"]), "group_changes")
    belongs = planned["groups"].select("entry_id", F.col("group_id").alias("label")).distinct().join(groups.select("label", "group_id", "action"), "label")
    members = belongs.where("action = 'inserted'").select("group_id", "entry_id")
    links = belongs.join(issues.select("entry_id", "issue_id"), "entry_id").select("group_id", "issue_id").distinct()
    return {"mappings": mappings, "issues": issues, "groups": groups, "members": members, "group_issues": links.join(tables["group_issues"], ["group_id", "issue_id"], "left_anti")}


def change_counts(changes: dict[str, DataFrame]) -> DataFrame:
    """part, action, n: the dry run's summary."""
    return reduce(DataFrame.unionByName, [d.groupBy(F.lit(name).alias("part"), (F.col("action") if "action" in d.columns else F.lit("inserted")).alias("action")).agg(F.count(F.lit(1)).alias("n")) for name, d in changes.items()])


def change_log(changes: dict[str, DataFrame]) -> DataFrame:
    """table_name, row_pk, operation, old_row, new_row (JSON with nulls), actor, reason: of rows inserted or updated."""
    keys = {"mappings": ["entry_id", "song_id"], "issues": ["issue_id"], "groups": ["group_id"]}

    def logged(name: str) -> DataFrame:
        d = changes[name].where(F.col("action").isin("inserted", "updated"))
        old = F.to_json(F.struct("entry_id", "song_id", "before.*"), _JSON) if name == "mappings" else F.lit(None).cast("string")
        new = F.to_json(F.struct(*[c for c in d.columns if c not in ("before", "action", "label")]), _JSON)
        inserted = F.col("action") == "inserted"
        return d.select(F.lit(name).alias("table_name"), F.to_json(F.struct(*keys[name]), _JSON).alias("row_pk"), F.when(inserted, "INSERT").otherwise("UPDATE").alias("operation"), F.when(~inserted, old).alias("old_row"), new.alias("new_row"), F.lit(ACTOR).alias("actor"), F.lit(REASON).alias("reason"))

    return reduce(DataFrame.unionByName, map(logged, keys))


def apply_changes(tables: dict[str, DataFrame], changes: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after the changes, and log. Of the mappings only planned pairs are replaced; the rest only gain rows."""
    put = changes["mappings"].where(F.col("action").isin("inserted", "updated"))
    after = {"mappings": tables["mappings"].join(put.select("entry_id", "song_id"), ["entry_id", "song_id"], "left_anti").select(*M.MAPPING).unionByName(put.select(*M.MAPPING))}
    for name in ("issues", "groups", "members", "group_issues"):
        d = changes[name]
        new = d.where("action = 'inserted'") if "action" in d.columns else d
        after[name] = tables[name].unionByName(new.select(*tables[name].columns))
    return {**tables, **after, "log": change_log(changes)}


def stage_details(issues: DataFrame, entries: DataFrame, songs: DataFrame, mappings: DataFrame) -> DataFrame:
    """The stages' issues (entry_id, song_id, method, reason) with what disagrees, as details in JSON.

    Titles, lengths or artists of both sides for an issue of that kind, the entry's codes for one of authority, and for
    several candidates their number and best confidence, as one title may have any number of them.
    """
    many = mappings.groupBy("entry_id").agg(F.count(F.lit(1)).alias("candidates"), F.max("confidence").alias("best_confidence"))
    e = entries.select("entry_id", F.col("core_title").alias("normalized_incoming_title"), F.col("raw_duration").alias("incoming_duration_ms"), F.array_sort("artists").alias("incoming_artist_ids"), "apple_id", "isrc")
    titles = F.col("core_titles") if "core_titles" in songs.columns else F.array("normalized_title")
    s = songs.select("song_id", F.array_sort(titles).alias("normalized_candidate_titles"), F.col("duration").alias("candidate_duration_ms"), F.array_sort("artists").alias("candidate_artist_ids"))
    d = issues.join(e, "entry_id").join(s, "song_id", "left").join(many, "entry_id", "left")
    ours, theirs = F.col("incoming_artist_ids"), F.col("candidate_artist_ids")
    far = F.abs(F.col("incoming_duration_ms") - F.col("candidate_duration_ms")).alias("difference_ms")
    kinds = {
        "title": ["normalized_incoming_title", "normalized_candidate_titles"],
        "duration": ["incoming_duration_ms", "candidate_duration_ms", far, F.lit(M.TOLERANCE).alias("tolerance_ms")],
        "artist": ["incoming_artist_ids", "candidate_artist_ids", F.array_except(theirs, ours).alias("missing_artist_ids"), F.array_except(ours, theirs).alias("extra_artist_ids")],
        "authority": ["apple_id", "isrc"],
        "multiple": ["candidates", "best_confidence"],
    }
    details = F.coalesce(*[F.when(F.col("reason") == r, F.to_json(F.struct(*cols), _JSON)) for r, cols in kinds.items()])
    return d.select("entry_id", "song_id", "method", "reason", details.alias("details"))


def plan_issues(plan: dict[str, DataFrame], entries: DataFrame, songs: DataFrame, code: str = "isrc") -> DataFrame:
    """The issues of a match_source plan, as ISSUE.

    Disagreements with entries of the same code are one issue for each entry and reason: it holds the number of entries
    that disagree and one of them, where one for each pair would grow with the square of a code's entries. An entry
    without a candidate names its group by its size and least entry, not by all its members.
    """
    name = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[F.col("reason")]
    rest = [F.lit(None).cast("long").alias("song_id"), F.lit(None).cast("string").alias("method")]
    stages = stage_details(plan["stage_issues"], entries, songs, plan["mappings"]).select("entry_id", F.col("song_id").cast("long").alias("song_id"), "method", name.alias("reason"), "details")
    found = M.entries_in_conflict(entries, code, plan["conflict_counts"])
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("reason"), F.col(f"{r}_partners").alias("partners"), (F.col(f"{r}_other") if r != "artist" else F.lit(None)).cast("long").alias("candidate_entry_id")) for r in ("title", "duration", "artist")]))
    pairs = found.select("entry_id", "code", each.alias("x")).select("entry_id", "code", "x.*").where("partners > 0")
    pairs = pairs.select("entry_id", rest[0], F.lit("EXACT").alias("method"), name.alias("reason"), F.to_json(F.struct(F.col("code").alias("authority_code"), "partners", "candidate_entry_id"), _JSON).alias("details"))
    sizes = plan["groups"].groupBy("group_id").agg(F.count(F.lit(1)).alias("group_members"), F.min("entry_id").alias("group_first_entry"))
    alone = plan["issues"].join(sizes, "group_id", "left").join(entries.select("entry_id", "core_title", "raw_duration"), "entry_id")
    alone = alone.select("entry_id", *rest, name.alias("reason"), F.to_json(F.struct("apple_id", "isrc", F.col("core_title").alias("normalized_title"), F.col("raw_duration").alias("duration_ms"), "group_members", "group_first_entry"), _JSON).alias("details"))
    return stages.unionByName(pairs).unionByName(alone)


def match_batch(tables: dict[str, DataFrame], entries: DataFrame, songs: DataFrame, codes: DataFrame, sources: DataFrame | None = None, fuzzy: bool = True) -> dict[str, DataFrame]:
    """plan_changes of a whole batch; with sources (source_id, source_type) only entries of known sources of type STORE are matched.

    rejected: the entries that are not, with what is wrong, where sources are given.
    """
    rejected = {}
    if sources is not None:
        d = entries.join(sources.select("source_id", "source_type"), "source_id", "left")
        error = F.when(F.col("source_type").isNull(), "source not found").when(F.col("source_type") != STORE, "source type not matched")
        rejected = {"rejected": d.select("entry_id", "source_id", error.alias("error")).where("error IS NOT NULL")}
        entries = d.where(F.col("source_type") == STORE).drop("source_type")
    entries = written(entries, "entries")
    plan = M.match_source(entries, songs, codes, fuzzy)
    planned = {"mappings": plan["mappings"], "issues": plan_issues(plan, entries, songs), "groups": plan["groups"], "entries": entries}
    return {**plan_changes(tables, planned), **rejected}
