"""Version resolution: the latest version of each row of a change log.

A version is newer by (_commit_seq, _seq); ties go to the hot tier. A window over the key with row_number() = 1 becomes a group limit below the
exchange, so each task first keeps one version per key, and filters on the key or the user reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEQ, COMMIT, DELETED, USER, TIER = "_seq", "_commit_seq", "_deleted", "_user_id", "_tier"


def with_system_columns(df: DataFrame) -> DataFrame:
    """Rows without a commit count as commit 0, rows without a tombstone mark as live, rows without a tier as cold."""
    commit = F.coalesce(F.col(COMMIT), F.lit(0)) if COMMIT in df.columns else F.lit(0)
    gone = F.coalesce(F.col(DELETED), F.lit(False)) if DELETED in df.columns else F.lit(False)
    df = df.withColumn(COMMIT, commit.cast("long")).withColumn(DELETED, gone)
    return df if TIER in df.columns else df.withColumn(TIER, F.lit(1))


def row_key(pk: str, kind: str = "string") -> list[Column]:
    """The key of a row's version chain: the primary key, and for a null or empty one the version itself."""
    none = F.col(pk).isNull()
    if kind == "string":
        none = none | (F.col(pk) == "")
    return [F.col(pk), F.when(none, F.col(SEQ))]


def resolve(log: DataFrame, pk: str, by_user: bool = False, snapshot: int | None = None, include_deleted: bool = False) -> DataFrame:
    """The current rows of a log, or those as of the commit ``snapshot``; later versions are ignored before winners are chosen."""
    log = with_system_columns(log)
    if snapshot is not None:
        log = log.filter(F.col(COMMIT) <= snapshot)
    keys = ([F.col(USER)] if by_user else []) + row_key(pk, log.schema[pk].dataType.typeName())
    newest = Window.partitionBy(*keys).orderBy(F.col(COMMIT).desc(), F.col(SEQ).desc(), F.col(TIER).asc())
    out = log.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank", TIER)
    return out if include_deleted else out.filter(~F.col(DELETED))


def resolve_by_aggregate(log: DataFrame, pk: str, snapshot: int | None = None) -> DataFrame:
    """The same by ``max_by`` with partial aggregation; good where most keys have many versions."""
    log = with_system_columns(log)
    if snapshot is not None:
        log = log.filter(F.col(COMMIT) <= snapshot)
    columns = [c for c in log.columns if c not in (pk, TIER)]
    row = F.max_by(F.struct(*columns), F.struct(COMMIT, SEQ, -F.col(TIER))).alias("_row")
    chosen = log.groupBy(F.col(pk), row_key(pk, log.schema[pk].dataType.typeName())[1].alias("_own")).agg(row)
    return chosen.select(pk, *(F.col("_row")[c].alias(c) for c in columns)).filter(~F.col(DELETED))


def count_current(log: DataFrame, pk: str, by_user: bool = False, snapshot: int | None = None) -> DataFrame:
    """The number of current rows; only the key and the system columns are read."""
    needed = [pk, SEQ] + [c for c in (COMMIT, DELETED, TIER, USER) if c in log.columns]
    return resolve(log.select(*dict.fromkeys(needed)), pk, by_user, snapshot).agg(F.count(F.lit(1)).alias("n"))


def overlay(base: DataFrame, staged: DataFrame, pk: str | list[str], columns: list[str]) -> DataFrame:
    """Read-your-writes: current rows ``base`` under a transaction's ``staged`` mutations.

    ``staged`` holds the key, ``_op`` (insert, update, delete), ``_order`` and the columns, with ``_set``, the names that an update assigns. Mutations of a key are folded in order: a delete
    removes what came before; an insert replaces; an update overwrites the columns it sets. A key of user and primary key lays over the rows of all users at once."""
    keys = [pk] if isinstance(pk, str) else list(pk)
    later_break = Window.partitionBy(*keys).orderBy(F.col("_order")).rowsBetween(1, Window.unboundedFollowing)
    breaks = F.max(F.when(F.col("_op") != "update", 1).otherwise(0)).over(later_break)
    live = staged.withColumn("_cut", F.coalesce(breaks, F.lit(0))).filter("_cut = 0")
    touched = lambda c: F.when((F.col("_op") != "update") | F.array_contains("_set", F.lit(c)), F.col("_order"))
    folded = live.groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys)).agg(
        *(F.max_by(F.struct(F.col(c).alias("v")), touched(c)).alias(f"_v_{c}") for c in columns if c not in keys),
        F.max(F.when(F.col("_op") == "delete", 1).otherwise(0)).alias("_gone"),
        F.max(F.when(F.col("_op") == "insert", 1).otherwise(0)).alias("_new"),
    )
    same = [base[k].eqNullSafe(folded[f"_k_{k}"]) for k in keys]
    joined = base.withColumn("_there", F.lit(True)).join(folded, same, "full_outer")
    present = F.col("_gone").isNull() | ((F.col("_gone") == 0) & ((F.col("_new") == 1) | F.col("_there").isNotNull()))
    key = lambda c: F.when(F.col("_there"), base[c]).otherwise(F.col(f"_k_{c}")).alias(c)
    values = [key(c) if c in keys else F.when(F.col(f"_v_{c}").isNotNull(), F.col(f"_v_{c}")["v"]).when(F.coalesce(F.col("_new"), F.lit(0)) == 1, F.lit(None)).otherwise(base[c]).alias(c) for c in columns]
    return joined.filter(present).select(*values)


def changes(log: DataFrame, pk: str, columns: list[str], by_user: bool = False) -> DataFrame:
    """The change feed of a log: op, the new values, the old ones and what an update changed, by version order.

    An insert carries the new row, an update the new row and the old values of changed columns, a delete the old row."""
    log = with_system_columns(log)
    keys = ([F.col(USER)] if by_user else []) + row_key(pk, log.schema[pk].dataType.typeName())
    order = Window.partitionBy(*keys).orderBy(COMMIT, SEQ)
    before = F.lag(F.struct(DELETED, *columns)).over(order)
    fed = log.withColumn("_old", before)
    alive = F.col("_old").isNotNull() & ~F.col("_old")[DELETED]
    op = F.when(F.col(DELETED), F.when(alive, F.lit("delete"))).when(alive, F.lit("update")).otherwise(F.lit("insert"))
    moved = F.filter(F.array(*(F.when(~F.col(c).eqNullSafe(F.col("_old")[c]), F.lit(c)) for c in columns)), lambda c: c.isNotNull())
    kept = ([USER] if by_user else []) + [SEQ, COMMIT, DELETED, *columns]
    out = fed.withColumn("op", op).filter("op is not null").withColumn("changed", F.when(F.col("op") == "update", moved).otherwise(F.array().cast("array<string>")))
    return out.select("op", *kept, "changed", F.when(F.col("op") != "insert", F.col("_old")).alias("old"))
