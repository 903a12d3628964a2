"""Change capture and reconciliation of keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_JSON = {"ignoreNullFields": "false"}


def _paired(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    cols = before.columns
    one = before.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.struct(*cols).alias("_before"))
    two = after.select(*[F.col(k).alias(f"_a_{k}") for k in keys], F.struct(*cols).alias("_after"))
    same = reduce(Column.__and__, (F.col(f"_b_{k}").eqNullSafe(F.col(f"_a_{k}")) for k in keys))
    return one.join(two, same, "full_outer").select(*[F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in keys], "_before", "_after")


def _operation() -> Column:
    return F.when(F.col("_before").isNull(), "INSERT").when(F.col("_after").isNull(), "DELETE").when(~F.col("_before").eqNullSafe(F.col("_after")), "UPDATE")


def diff_snapshots(before: DataFrame, after: DataFrame, keys: list[str], actor: str = "", reason: str = "") -> DataFrame:
    """One row for each changed key: operation, both images as JSON with nulls, actor and reason."""
    d = _paired(before, after, keys).withColumn("operation", _operation()).where("operation IS NOT NULL")
    return d.select(*keys, "operation", F.to_json("_before", _JSON).alias("old_row"), F.to_json("_after", _JSON).alias("new_row"), F.lit(actor).alias("actor"), F.lit(reason).alias("reason"))


def apply_changes(before: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """The snapshot after a change log."""
    kept = before.join(log.select(*keys), keys, "left_anti")
    new = log.where("operation <> 'DELETE'").select(F.from_json("new_row", before.schema).alias("r")).select("r.*")
    return kept.select(*before.columns).unionByName(new)


def sync_children(current: DataFrame, desired: DataFrame, keys: list[str]) -> DataFrame:
    """Every child with its action: INSERT, UPDATE, DELETE or KEEP; values are the desired ones, of deleted rows the current."""
    row = F.coalesce("_after", "_before")
    d = _paired(current, desired, keys).withColumn("action", F.coalesce(_operation(), F.lit("KEEP")))
    return d.select(*[row[c].alias(c) for c in current.columns], "action")


def replace_children(current: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """All children of the owners that new names are replaced."""
    return current.join(new.select(owner).distinct(), owner, "left_anti").select(*current.columns).unionByName(new.select(*current.columns))


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after an insert of absent keys and an update of different rows, with what happened."""
    d = _paired(current, new, keys)
    done = F.when(F.col("_before").isNull(), "inserted").when(F.col("_after").isNull() | F.col("_before").eqNullSafe(F.col("_after")), "kept").otherwise("updated")
    row = F.coalesce("_after", "_before")
    return d.select(*[row[c].alias(c) for c in current.columns], done.alias("done"))


def insert_if_absent(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    fresh = new.select(*current.columns).dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")
    return current.unionByName(fresh.select(*current.columns))


def missing_refs(df: DataFrame, col: str, ref: DataFrame, ref_col: str, label: str) -> DataFrame:
    """Ids that do not resolve, each once, with a label."""
    ids = df.where(F.col(col).isNotNull()).select(F.col(col).alias("missing_id")).distinct()
    return ids.join(ref.select(F.col(ref_col).alias("missing_id")), "missing_id", "left_anti").withColumn("label", F.lit(label))


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_exactly_one(df: DataFrame, key: str, flag: Column) -> DataFrame:
    """Owners without exactly one flagged row."""
    return df.groupBy(key).agg(F.count_if(flag).alias("n")).where("n <> 1")


def validate(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Every row with the labels of the rules that it breaks, as an array."""
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(label)) for label, ok in rules])))


def update_columns(df: DataFrame, key: str, changes: DataFrame, cols: list[str]) -> DataFrame:
    """Columns set where the key matches, the rest kept."""
    new = changes.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in cols])
    out = df.join(new, key, "left")
    return out.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def insert_new(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows of which no equal one exists, null equal to null."""
    other = existing.select(*[F.col(k).alias(f"_e_{k}") for k in keys]).distinct()
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in keys))
    return new.join(other, same, "left_anti")
