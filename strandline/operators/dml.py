"""INSERT, UPDATE and DELETE as new versions in a table's log."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..sources.catalog import ColumnDef, TableDef
from ..types import coerce
from . import versions as V


class ConstraintError(ValueError):
    pass


def now_ms() -> int:
    return int(time.time() * 1000)


def default_value(column: ColumnDef, user: str, ms: int) -> Column:
    """The value of an omitted column: null, a literal, or one of the default functions."""
    text = column.default
    if text is None:
        return F.lit(None).cast(column.kind.spark)
    name = text.upper().rstrip("()").strip()
    made = {"NOW": F.current_timestamp, "CURRENT_TIMESTAMP": F.current_timestamp, "SNOWFLAKE_ID": lambda: ids.row_ids(ms), "UUID_V7": ids.uuid_v7, "ULID": ids.ulid, "CURRENT_USER": lambda: F.lit(user)}.get(name)
    return (made() if made else F.expr(text)).cast(column.kind.spark)


def prepared(rows: DataFrame, table: TableDef, user: str, ms: int | None = None) -> DataFrame:
    """Rows to insert, with defaults for omitted columns and values coerced to the declared types."""
    have = {c.lower(): c for c in rows.columns}
    unknown = set(have) - set(table.names())
    if unknown:
        raise ConstraintError(f"{table.full_name} has no column {', '.join(sorted(unknown))}")
    ms = ms or now_ms()
    out = []
    for c in table.columns:
        value = coerce(F.col(f"`{have[c.name]}`"), c.kind, rows.schema[have[c.name]].dataType) if c.name in have else default_value(c, user, ms)
        out.append(value.alias(c.name, metadata=c.kind.metadata))
    return rows.select(*out)


def not_null(rows: DataFrame, table: TableDef) -> DataFrame:
    """The rows, checked as they pass: a null where none may be raises. No extra scan."""
    for c in table.columns:
        if not c.nullable:
            rows = rows.withColumn(c.name, F.when(F.col(c.name).isNull(), F.raise_error(F.lit(f"{table.full_name}.{c.name} may not be null")).cast(c.kind.spark)).otherwise(F.col(c.name)))
    return rows


def generated_key(table: TableDef) -> bool:
    """Keys from SNOWFLAKE_ID, UUID_V7 or ULID are unique by themselves."""
    default = (table.column(table.pk).default or "").upper()
    return default.startswith(("SNOWFLAKE_ID", "UUID_V7", "ULID"))


def check_unique(rows: DataFrame, current: DataFrame | None, table: TableDef) -> None:
    """No key twice in the batch, none that is there already: one job over the keys alone."""
    keys = [V.USER, table.pk] if table.by_user and V.USER in rows.columns else [table.pk]
    batch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if current is not None:
        batch = batch.join(current.select(*keys).withColumn("_old", F.lit(True)), keys, "left")
    else:
        batch = batch.withColumn("_old", F.lit(None).cast("boolean"))
    bad = batch.filter((F.col("_n") > 1) | F.col("_old")).select(table.pk, "_n").first()
    if bad is not None:
        where = " in the batch" if bad["_n"] > 1 else ""
        raise ConstraintError(f"duplicate key{where}: {table.full_name}.{table.pk} = {bad[0]}")


def versioned(rows: DataFrame, table: TableDef, commit: int, user: str | None, deleted: bool = False, ms: int | None = None) -> DataFrame:
    """Rows of the declared columns as versions of one commit."""
    out = rows.withColumn(V.SEQ, ids.row_ids(ms or now_ms(), ids.SEQ_EPOCH_MS)).withColumn(V.COMMIT, F.lit(commit).cast("long")).withColumn(V.DELETED, F.lit(deleted))
    if table.by_user:
        out = out.withColumn(V.USER, F.col(V.USER) if V.USER in rows.columns else F.lit(user))
    return out.select(*table.schema().fieldNames())


def updated(current: DataFrame, table: TableDef, assign: dict[str, Column], where: Column) -> DataFrame:
    """Current rows that ``where`` selects, with assignments evaluated on their old values."""
    if table.kind == "STREAM":
        raise ConstraintError("a STREAM table takes no UPDATE")
    if table.pk in assign:
        raise ConstraintError(f"the primary key {table.pk} can't be updated")
    for name in assign:
        table.column(name)
    hit = current.filter(where)
    typed = {n: coerce(v, table.column(n).kind, hit.select(v.alias("v")).schema["v"].dataType) for n, v in assign.items()}
    keep = [V.USER] if table.by_user else []
    return hit.select(*(typed[n].alias(n) if n in typed else F.col(n) for n in table.names()), *keep)


def removed(current: DataFrame, table: TableDef, where: Column) -> DataFrame:
    """Tombstones for the current rows that ``where`` selects."""
    return current.filter(where).select(*table.names(), *([V.USER] if table.by_user else []))
