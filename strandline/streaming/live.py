"""Live queries: a bounded snapshot, then the changes after it."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import ids
from ..operators import versions as V

DEFAULT_ROWS, DEFAULT_BATCH = 100, 1000


def snapshot_boundary(ms: int | None = None) -> int:
    """The greatest version id up to now; no query is needed."""
    return ids.seq_ceiling(int(time.time() * 1000) if ms is None else ms)


def initial_rows(current: DataFrame, columns: list[str], where=None, since: int | None = None, until: int | None = None, limit: int | None = DEFAULT_ROWS) -> DataFrame:
    """Current rows with since < _seq <= until, by _seq. One row more than ``limit`` tells that there are more."""
    out = current.filter(~F.col(V.DELETED)) if V.DELETED in current.columns else current
    if since is not None:
        out = out.filter(F.col(V.SEQ) > since)
    if until is not None:
        out = out.filter(F.col(V.SEQ) <= until)
    if where is not None:
        out = out.filter(where)
    out = out.select(*dict.fromkeys([*columns, V.SEQ])).orderBy(V.SEQ)
    return out if limit is None else out.limit(limit + 1)


def last_rows(current: DataFrame, columns: list[str], n: int, where=None) -> DataFrame:
    """The newest ``n`` rows, oldest first."""
    out = current.filter(~F.col(V.DELETED)) if V.DELETED in current.columns else current
    out = out if where is None else out.filter(where)
    return out.select(*dict.fromkeys([*columns, V.SEQ])).orderBy(F.col(V.SEQ).desc()).limit(n).orderBy(V.SEQ)


def pages(snapshot: DataFrame, size: int = DEFAULT_BATCH, since: int | None = None):
    """A written snapshot in batches, by the last _seq seen (no offsets are skipped over again)."""
    while True:
        rows = (snapshot if since is None else snapshot.filter(F.col(V.SEQ) > since)).orderBy(V.SEQ).limit(size + 1).collect()
        if not rows:
            return
        yield rows[:size]
        if len(rows) <= size:
            return
        since = rows[size - 1][V.SEQ]


def changes_between(log, after: int, upto: int, user: str | None = None) -> DataFrame:
    """The change feed of the commits in (after, upto]: their keys come from the segments of those commits, the old values from the segments that can hold those keys."""
    table = log.table
    scoped = lambda df: df if user is None else df.filter(F.col(V.USER) == user)
    keys = ([V.USER] if table.by_user else []) + [table.pk]
    fresh = scoped(log.log(after_commit=after, upto_commit=upto, user=user)).filter((F.col(V.COMMIT) > after) & (F.col(V.COMMIT) <= upto))
    if table.kind == "STREAM":
        history = fresh
    else:
        low, high = fresh.agg(F.min(table.pk), F.max(table.pk)).first()
        touched = fresh.select(*keys).distinct()
        history = scoped(log.log(keys=None if low is None else (low, high), upto_commit=upto, user=user)).filter(F.col(V.COMMIT) <= upto).join(touched, keys, "left_semi")
    return V.changes(history, table.pk, table.names(), table.by_user).filter(F.col(V.COMMIT) > after)


def filtered_changes(feed: DataFrame, where=None, columns: list[str] | None = None, leaving: bool = True) -> DataFrame:
    """Changes whose row matches. An update that leaves the predicate becomes a delete (``leaving``), one that enters it an insert."""
    names = columns or [c for c in feed.columns if c not in ("op", "old", "changed", V.USER, V.SEQ, V.COMMIT, V.DELETED)]
    if where is not None:
        user = [V.USER] if V.USER in feed.columns else []
        rest = ["op", "changed", "old", V.SEQ, V.COMMIT, *user]
        now = feed.withColumn("_now", F.coalesce(where, F.lit(False))).select(*rest, "_now", F.struct(*names).alias("_n"), *(F.col("old")[c].alias(c) for c in names))
        feed = now.withColumn("_was", F.coalesce(where, F.lit(False)) & F.col("old").isNotNull()).select(*rest, "_now", "_was", "_n.*")
        op = F.when(F.col("op") == "delete", F.when(F.col("_was"), F.lit("delete"))).when(F.col("op") == "insert", F.when(F.col("_now"), F.lit("insert")))
        op = op.when(F.col("_now") & F.col("_was"), F.lit("update")).when(F.col("_now"), F.lit("insert"))
        if leaving:
            op = op.when(F.col("_was"), F.lit("delete"))
        feed = feed.withColumn("op", op).filter("op is not null")
    return feed.select("op", V.SEQ, V.COMMIT, *names, "changed", "old")


class Subscription:
    """A snapshot, then :meth:`poll` for what came later. Every commit comes, in the order of commits, and each once its rows are written; a poll that fails is repeated by the next.

    The engine keeps the versions that a subscription needs until it stops, or is not polled for the time that the settings give."""

    def __init__(self, engine, table, columns: list[str], where=None, user: str | None = None, options: dict | None = None, owner: str = "", query: str = ""):
        self.id, self.owner, self.query, self.active = uuid.uuid4().hex, owner, query, True
        self.engine, self.table, self.columns, self.where, self.user = engine, table, columns, where, user
        self.options = options or {}
        self.until = snapshot_boundary()
        self._commit, self._polls = engine.log(table).last_commit(), 0
        engine.hold(self.id, self._commit)

    def _current(self) -> DataFrame:
        rows = self.engine.log(self.table).current(user=self.user)
        return rows if self.user is None else rows.filter(F.col(V.USER) == self.user)

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        """Rows as they are now, in files of the subscription's own."""
        uri = self.engine.store.uri("_live", self.id, name)
        df.write.parquet(uri)
        return df.sparkSession.read.schema(df.schema).parquet(uri)

    def snapshot(self) -> DataFrame:
        n = self.options.get("last_rows")
        if n is not None:
            return last_rows(self._current(), self.columns, int(n), self.where)
        since = self.options.get("from")
        return initial_rows(self._current(), self.columns, self.where, None if since is None else int(since), None, None)

    def batches(self):
        """The snapshot in batches: it is resolved, sorted and written once."""
        yield from pages(self._written(self.snapshot(), f"snapshot-{uuid.uuid4().hex}"), int(self.options.get("batch_size", DEFAULT_BATCH)))

    def poll(self) -> DataFrame:
        """The changes since the snapshot or the last poll. Only segments of later commits, and those that can hold their keys, are read."""
        if not self.active or not self.engine.held(self.id):
            raise RuntimeError("the subscription has ended; subscribe again")
        log = self.engine.log(self.table)
        last = log.last_commit()
        feed = changes_between(log, self._commit, last, self.user) if last > self._commit else None
        out = filtered_changes(feed, self.where) if feed is not None else None
        if out is None:
            log = V.changes(log.read([]), self.table.pk, self.table.names(), self.table.by_user)
            out = filtered_changes(log, self.where)
        else:
            out = self._written(out, f"poll-{self._polls:08d}-{uuid.uuid4().hex[:8]}")
            for old in self.engine.store.names("_live", self.id):
                if old.startswith("poll-") and old < f"poll-{self._polls - 8:08d}":
                    self.engine.store.delete("_live", self.id, old)
        self._polls += 1
        self._commit = max(self._commit, last)
        self.engine.hold(self.id, self._commit)
        return out.orderBy(V.COMMIT, V.SEQ)

    def stop(self) -> None:
        self.active = False
        self.engine.release(self.id)
        self.engine.store.delete("_live", self.id)


def log_stream(spark, path: str, schema) -> DataFrame:
    """The hot segments of a table as a stream of versions."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def follow(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, where=None, once: bool = True) -> StreamingQuery:
    """Hand matching versions to ``sink`` per micro-batch, with a checkpoint; ``once``: what is there, then stop."""
    out = stream if where is None else stream.filter(where)
    writer = out.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
