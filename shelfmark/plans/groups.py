"""Upkeep of groups: their details, edits of members, what they link to, and relabelling after changed edges.

entries: entry_id, title (normalised core title), duration, isrc, item_id (null where it has none).
groups: group_id, status, song_id, method, confidence, details (struct, see details_of), resolved_at.
members: group_id, entry_id. issues: issue_id, entry_id, resolved_at. group_issues: group_id, issue_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.aggregates import spread, written
from .matching import components

#: Confidence of a group with a shared code and without, and the names of the ways it was found.
BY_CODE = 0.98
BY_METADATA = 0.90
METHODS = ("ISRC", "EXACT_METADATA")


def details_of(members: DataFrame, entries: DataFrame) -> DataFrame:
    """group_id, method, confidence, details: what a group of these members is.

    details: entry_ids, isrcs and core_titles (distinct, in order), min_duration, max_duration, difference, methods.
    A group of one has no method of confidence; one with an isrc has 0.98, else 0.90, both by exact data. The members of
    a group stand in its details by definition, so that a group must fit in a row; nothing else is gathered.
    """
    d = members.select("group_id", "entry_id").distinct().join(entries, "entry_id", "left")
    filled = lambda c: F.array_sort(F.collect_set(F.when(F.trim(c) != "", F.col(c))))
    g = d.groupBy("group_id").agg(F.array_sort(F.collect_list("entry_id")).alias("entry_ids"), filled("isrc").alias("isrcs"), filled("title").alias("core_titles"), F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"))
    many, coded = F.size("entry_ids") > 1, F.size("isrcs") > 0
    methods = F.array_compact(F.array(F.when(coded, F.lit(METHODS[0])), F.when(many, F.lit(METHODS[1]))))
    details = F.struct("entry_ids", "isrcs", "core_titles", "min_duration", "max_duration", (F.col("max_duration") - F.col("min_duration")).alias("difference"), methods.alias("methods"))
    return g.select("group_id", F.when(many, "EXACT").alias("method"), F.when(many & coded, BY_CODE).when(many, BY_METADATA).alias("confidence"), details.alias("details"))


def issue_links(members: DataFrame, issues: DataFrame) -> DataFrame:
    """group_id, issue_id: the issues of a group's members, each once.

    Only an issue that names several entries can come twice to a group, so that these alone are told apart after the join.
    """
    each = issues.where("entry_id IS NOT NULL").select("issue_id", "entry_id").repartition("issue_id").distinct().withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("issue_id")))
    own = members.select("group_id", "entry_id").distinct()
    found = lambda which: own.join(each.where(which), "entry_id").select("group_id", "issue_id")
    return found("_n = 1").unionByName(found("_n > 1").distinct())


def judge_edits(members: DataFrame, groups: DataFrame, entries: DataFrame, seen: DataFrame, wanted: DataFrame) -> DataFrame:
    """group_id, error: of each edited group whether its edit holds.

    seen and wanted: group_id, entry_id: the members as the editor saw them and as they are to be; a group with wanted
    or seen rows is edited. Errors: the group is unknown, its members changed since, a wanted entry is unknown. Only
    members of edited groups are looked at: the rest leaves at a semi join on the group.
    """
    edited = wanted.select("group_id").unionByName(seen.select("group_id")).distinct()
    own = members.join(edited, "group_id", "left_semi").select("group_id", "entry_id").distinct()
    both = own.withColumn("_now", F.lit(1)).join(seen.select("group_id", "entry_id").distinct().withColumn("_then", F.lit(1)), ["group_id", "entry_id"], "full_outer")
    stale = both.where("_now IS NULL OR _then IS NULL").select("group_id").distinct().withColumn("_stale", F.lit(True))
    lost = wanted.where("entry_id IS NOT NULL").select("group_id", "entry_id").distinct().join(entries.select("entry_id"), "entry_id", "left_anti").select("group_id").distinct().withColumn("_lost", F.lit(True))
    known = groups.select("group_id").withColumn("_known", F.lit(True))
    d = edited.join(known, "group_id", "left").join(stale, "group_id", "left").join(lost, "group_id", "left")
    return d.select("group_id", F.when(F.col("_known").isNull(), "group not found").when(F.col("_stale"), "members changed").when(F.col("_lost"), "entry not found").alias("error"))


def edit_groups(tables: dict[str, DataFrame], seen: DataFrame, wanted: DataFrame) -> dict[str, DataFrame]:
    """The tables after all edits that hold: members replaced, details and issue links of the changed groups anew.

    A group whose members are the wanted ones already is not touched. Groups without an edit keep their rows as they
    are: their entries are neither read nor summed up again. log: group_id, error of every edit.
    """
    log = written(judge_edits(tables["members"], tables["groups"], tables["entries"], seen, wanted), "edits")
    good = log.where("error IS NULL").select("group_id")
    new = wanted.where("entry_id IS NOT NULL").join(good, "group_id", "left_semi").select("group_id", "entry_id").distinct()
    old = tables["members"].join(good, "group_id", "left_semi").select("group_id", "entry_id").distinct()
    both = old.withColumn("_o", F.lit(1)).join(new.withColumn("_n", F.lit(1)), ["group_id", "entry_id"], "full_outer")
    touched = written(both.where("_o IS NULL OR _n IS NULL").select("group_id").distinct(), "touched")
    members = tables["members"].join(touched, "group_id", "left_anti").select("group_id", "entry_id").unionByName(new.join(touched, "group_id", "left_semi"))
    members = written(members, "members")
    return {**refresh(tables, members, touched), "members": members, "log": log}


def refresh(tables: dict[str, DataFrame], members: DataFrame, touched: DataFrame) -> dict[str, DataFrame]:
    """groups and group_issues with the touched groups' details and links made anew from their members."""
    own = members.join(touched, "group_id", "left_semi")
    entries = tables["entries"].join(own.select("entry_id").distinct(), "entry_id", "left_semi")
    d = touched.join(details_of(own, entries), "group_id", "left").withColumnsRenamed({"method": "_method", "confidence": "_confidence", "details": "_details"}).withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False))
    new: dict[str, Column] = {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("method", "confidence", "details")}
    groups = tables["groups"].join(d, "group_id", "left").select(*[new.get(c, F.col(c)).alias(c) for c in tables["groups"].columns])
    group_issues = tables["group_issues"].join(touched, "group_id", "left_anti").select("group_id", "issue_id").unionByName(issue_links(own, tables["issues"]))
    return {"groups": groups, "group_issues": group_issues}


def change_status(tables: dict[str, DataFrame], changes: DataFrame, now: Column) -> dict[str, DataFrame]:
    """groups and issues after changes (group_id, status, song_id): a pending group loses its time, others get one if they have none.

    A group that has the status already, and no new song, stays as it is. Where a group is confirmed, the open issues
    linked to it are resolved.
    """
    c = changes.dropDuplicates(["group_id"]).select("group_id", F.col("status").alias("_status"), F.col("song_id").alias("_song"))
    g = tables["groups"].join(c, "group_id", "left")
    moved = F.coalesce((F.col("_status") != F.col("status")) | (F.col("_song").isNotNull() & ~F.col("_song").eqNullSafe(F.col("song_id"))), F.lit(False))
    new: dict[str, Column] = {
        "status": F.coalesce("_status", "status"),
        "song_id": F.coalesce("_song", "song_id"),
        "resolved_at": F.when(moved & (F.col("_status") == "pending"), None).when(moved, F.coalesce("resolved_at", now)).otherwise(F.col("resolved_at")),
    }
    groups = g.select(*[new.get(x, F.col(x)).alias(x) for x in tables["groups"].columns])
    confirmed = c.where("_status = 'confirmed'").join(tables["groups"].select("group_id"), "group_id", "left_semi")
    hit = tables["group_issues"].join(confirmed, "group_id", "left_semi").select("issue_id").distinct().withColumn("_hit", F.lit(True))
    issues = tables["issues"].join(hit, "issue_id", "left").withColumn("resolved_at", F.when(F.col("_hit"), F.coalesce("resolved_at", now)).otherwise(F.col("resolved_at"))).drop("_hit")
    return {"groups": groups, "issues": issues}


def relabel(labels: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, label after edges came and went: only components that a change touches are computed again.

    labels: id, label of the nodes so far, by edges (a, b), which are those before the change. Components of the ends
    of added and removed edges, with new nodes, are computed anew from their own edges; all others keep their label.
    A label is the least id of its component, so that the result is that of a full computation.
    """
    labels, nodes = spread(labels), spread(nodes)
    one = lambda df: df.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    ends = spread(one(added).unionByName(one(removed)).distinct())
    touched = spread(written(labels.join(ends, "id", "left_semi").select("label").distinct(), "touched"))  # read twice
    again = spread(written(labels.join(touched, "label", "left_semi").select("id").unionByName(nodes.select("id").join(labels, "id", "left_anti")).unionByName(ends).distinct(), "again"))
    pair = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # an edge lies in one component, so that its first end tells whether it is looked at
    kept = pair(edges).join(again.withColumnRenamed("id", "a"), "a", "left_semi").join(spread(pair(removed)), ["a", "b"], "left_anti")
    new = components(kept.unionByName(pair(added)).distinct(), again)
    return labels.join(touched, "label", "left_anti").select("id", "label").unionByName(new.select("id", "label"))
