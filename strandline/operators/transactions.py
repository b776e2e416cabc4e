"""Explicit transactions: staged mutations, read-your-writes, one commit."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import TableDef
from ..sources.files import Store
from . import versions as V


class TransactionError(RuntimeError):
    pass


class Transaction:
    """Mutations in order, by table, in files of their own that no table lists. Tables see nothing before the commit."""

    def __init__(self, store: Store, owner: str, snapshot: int, most_bytes: int = 1024**3):
        self.store, self.id, self.owner, self.snapshot, self.most_bytes = store, uuid.uuid4().hex, owner, snapshot, most_bytes
        self.staged: dict[str, list[DataFrame]] = {}
        self.order, self.bytes = 0, 0
        self.open = True

    def stage(self, table: TableDef, rows: DataFrame, op: str, assigned: list[str], user: str | None) -> int:
        """Keep the rows of one statement, as they are now; returns how many."""
        if not self.open:
            raise TransactionError("the transaction is over")
        if table.kind not in ("USER", "SHARED"):
            raise TransactionError(f"a transaction takes no writes to {table.kind} tables")
        self.order += 1
        kept = rows.withColumn("_op", F.lit(op)).withColumn("_order", F.lit(self.order)).withColumn("_set", F.array(*(F.lit(a) for a in assigned)).cast("array<string>"))
        if table.by_user and V.USER not in rows.columns:
            kept = kept.withColumn(V.USER, F.lit(user))
        place = ["_transactions", self.id, str(self.order)]
        kept.write.parquet(self.store.uri(*place))
        self.bytes += self.store.size(*place)
        if self.bytes > self.most_bytes:
            self.open = False
            raise TransactionError(f"the transaction holds more than {self.most_bytes} bytes and was aborted")
        written = rows.sparkSession.read.schema(kept.schema).parquet(self.store.uri(*place))
        self.staged.setdefault(table.full_name, []).append(written)
        return written.count()

    def discard(self) -> None:
        """Remove the staged files."""
        self.store.delete("_transactions", self.id)

    def mutations(self, name: str) -> DataFrame | None:
        out = None
        for df in self.staged.get(name, []):
            out = df if out is None else out.unionByName(df)
        return out

    def over(self, base: DataFrame, table: TableDef, user: str | None) -> DataFrame:
        """The table's rows with the staged ones on top; of one user, or of all in one plan."""
        staged = self.mutations(table.full_name)
        if staged is None:
            return base
        if table.by_user and user is not None:
            staged = staged.filter(F.col(V.USER) == user)
        keys = [V.USER, table.pk] if table.by_user else [table.pk]
        columns = [*table.names(), *([V.USER] if table.by_user else [])]
        laid = V.overlay(base.select(*columns), staged, keys, columns)
        extra: dict[str, Column] = {V.SEQ: F.lit(None).cast("long"), V.COMMIT: F.lit(None).cast("long"), V.DELETED: F.lit(False)}
        for name, value in extra.items():
            laid = laid.withColumn(name, value)
        return laid

    def folded(self, table: TableDef) -> tuple[DataFrame, DataFrame] | None:
        """What the commit writes: (rows, tombstones), one per key and user."""
        staged = self.mutations(table.full_name)
        if staged is None:
            return None
        keys = ([V.USER] if table.by_user else []) + [table.pk]
        last = staged.groupBy(*keys).agg(F.max_by("_op", "_order").alias("_last"), *(F.max_by(c, "_order").alias(c) for c in table.names() if c not in keys))
        gone = last.filter("_last = 'delete'").drop("_last")
        return staged, gone
