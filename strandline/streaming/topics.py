"""Durable topics: an append-only log per partition, consumer groups with claims and acknowledgements.

A topic's state is a versioned file that only one writer can create: its batches with the first offset of each partition, the next offsets, and up to which commit of each source it has been
published. Messages are written before with numbers from 0, so a batch shows at once, offsets have no gaps and no repeats, and a commit is published once however often it is tried. Claims and
acknowledgements of a group are a versioned file too, so they outlive the driver and no two consumers get one claim.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.catalog import Catalog, NotFound
from ..sources.files import Store

VISIBILITY_MS = 60_000
SCHEMA = T.StructType(
    [
        T.StructField("topic_id", T.StringType()), T.StructField("partition_id", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("key", T.StringType()),
        T.StructField("payload", T.BinaryType()), T.StructField("timestamp_ms", T.LongType()), T.StructField("user_id", T.StringType()), T.StructField("op", T.StringType()),
    ]
)


def message_key(pk: str) -> Column:
    return F.col(pk).cast("string")


def payload(mode: str, pk: str, columns: list[str], changed: Column | None = None) -> Column:
    """``key``: the key alone; ``full``: the row; ``diff``: the key and the changed columns."""
    if mode == "key":
        return F.to_json(F.struct(pk)).cast("binary")
    if mode == "diff" and changed is not None:
        keep = lambda c: F.when(F.array_contains(changed, F.lit(c)) | F.lit(c == pk), F.col(c)).alias(c)
        return F.to_json(F.struct(*(keep(c) for c in columns))).cast("binary")
    return F.to_json(F.struct(*columns)).cast("binary")


def partitioned(key: Column, body: Column, partitions: int) -> Column:
    """The partition by the key's hash (the row's, without a key)."""
    return F.pmod(F.xxhash64(F.coalesce(key, body.cast("string"))), F.lit(partitions)).cast("int")


def routed(rows: DataFrame, topic: str, partitions: int, key: Column, body: Column, op: Column, user: Column, order: list[Column], first: dict[int, int] | None = None, ms: int | None = None) -> DataFrame:
    """Messages of ``rows``, with offsets without gaps from ``first``, in one plan; :meth:`Topics.publish` numbers rows of any number."""
    out = rows.withColumn("_key", key).withColumn("_body", body).withColumn("_op", op).withColumn("_user", user)
    out = out.withColumn("partition_id", partitioned(F.col("_key"), F.col("_body"), partitions))
    start = F.lit(0).cast("long")
    for p, o in (first or {}).items():
        start = F.when(F.col("partition_id") == p, F.lit(o).cast("long")).otherwise(start)
    place = F.row_number().over(Window.partitionBy("partition_id").orderBy(*order, "_key", "_body")) - 1
    when = F.lit(int(time.time() * 1000) if ms is None else ms).cast("long")
    return out.select(F.lit(topic).alias("topic_id"), "partition_id", (start + place).cast("long").alias("offset"), F.col("_key").alias("key"), F.col("_body").alias("payload"), when.alias("timestamp_ms"), F.col("_user").alias("user_id"), F.col("_op").alias("op"))


def since(messages: DataFrame, start: dict[int, int] | int) -> DataFrame:
    """Messages from the start offsets on, of the partitions that have one."""
    if isinstance(start, int):
        wanted = F.col("offset") >= start
    else:
        wanted = F.lit(False)
        for p, o in start.items():
            wanted = wanted | ((F.col("partition_id") == p) & (F.col("offset") >= o))
    return messages.filter(wanted)


def consume(messages: DataFrame, start: dict[int, int] | int, limit: int) -> DataFrame:
    """Messages from the start offsets on, by partition and offset."""
    return since(messages, start).orderBy("offset", "partition_id").limit(limit)


class Topics:
    """The topics of an engine."""

    def __init__(self, store: Store, catalog: Catalog):
        self.store, self.catalog, self.spark = store, catalog, store.spark

    def create(self, name: str, partitions: int, if_not_exists: bool = False) -> None:
        if if_not_exists and self.catalog.get("topics", name):
            return
        self.catalog.put("topics", name, {"name": name, "partitions": partitions, "sources": [], "retention_ms": None}, new=True)

    def drop(self, name: str) -> None:
        self.catalog.drop("topics", name)
        self.store.delete("topics", name)

    def state(self, name: str) -> dict:
        topic = self.catalog.need("topics", name)
        version, found = self.store.state("topics", name)
        return {"version": version, **(found or {"next": [0] * topic["partitions"], "batches": [], "positions": {}})}

    def _swap(self, name: str, state: dict) -> bool:
        return self.store.swap({k: v for k, v in state.items() if k != "version"}, state["version"], "topics", name)

    def clear(self, name: str) -> None:
        """Remove the messages; offsets go on."""
        while True:
            state = self.state(name)
            if self._swap(name, {**state, "batches": []}):
                break
        for b in state["batches"]:
            self.store.delete("topics", name, b["path"])

    def add_source(self, name: str, table: str, op: str, where: str | None, mode: str, since: int = 0) -> None:
        topic = dict(self.catalog.need("topics", name))
        topic["sources"] = [*topic["sources"], {"table": table, "op": op, "where": where, "payload": mode, "since": since}]
        self.catalog.put("topics", name, topic)

    def routes(self, table: str) -> dict[str, list[dict]]:
        """The sources of a table, by topic."""
        found = {t["name"]: [s for s in t["sources"] if s["table"] == table] for t in self.catalog.all("topics")}
        return {name: routes for name, routes in found.items() if routes}

    def publish(self, name: str, rows: DataFrame, state: dict, positions: dict[str, int]) -> int | None:
        """Append messages (key, payload, op, user_id, in the order of at, seq) on top of ``state`` and move the sources' positions; returns how many, or None if another writer came first.

        Rows are dealt by ranges of their order; each task numbers its own after a count by range, so no task sees all rows of a partition."""
        partitions = len(state["next"])
        path = f"batch-{int(time.time() * 1e6):020d}-{uuid.uuid4().hex[:8]}"
        made = rows.withColumn("partition_id", partitioned(F.col("key"), F.col("payload"), partitions)).repartitionByRange("at", "seq", "key").withColumn("part", F.spark_partition_id())
        place = F.row_number().over(Window.partitionBy("part", "partition_id").orderBy("at", "seq", "key", "payload")) - 1
        when = F.lit(int(time.time() * 1000)).cast("long")
        made = made.select(F.lit(name).alias("topic_id"), "partition_id", place.cast("long").alias("offset"), "key", "payload", when.alias("timestamp_ms"), "user_id", "op", "part")
        made.write.option("compression", "zstd").parquet(self.store.uri("topics", name, path))
        written = self.spark.read.schema(made.schema).parquet(self.store.uri("topics", name, path))
        counts = written.groupBy("part", "partition_id").count().collect()  # tasks by partitions
        first, following = {}, list(state["next"])
        for r in sorted(counts, key=lambda r: r["part"]):
            first.setdefault(str(r["part"]), {})[str(r["partition_id"])] = following[r["partition_id"]]
            following[r["partition_id"]] += r["count"]
        n = sum(r["count"] for r in counts)
        batches = [*state["batches"], {"path": path, "first": first, "newest_ms": int(time.time() * 1000), "n": n}] if n else state["batches"]
        if not self._swap(name, {**state, "next": following, "batches": batches, "positions": {**state["positions"], **positions}}):
            self.store.delete("topics", name, path)
            return None
        if not n:
            self.store.delete("topics", name, path)
        return n

    def messages(self, name: str, batches: list | None = None) -> DataFrame:
        """All messages with their offsets."""
        found = self.state(name)["batches"] if batches is None else batches
        if not found:
            return self.spark.createDataFrame([], SCHEMA)
        schema = T.StructType([*SCHEMA.fields, T.StructField("part", T.IntegerType())])
        read = self.spark.read.schema(schema).parquet(*(self.store.uri("topics", name, b["path"]) for b in found))
        read = read.withColumn("_batch", F.regexp_extract(F.col("_metadata.file_path"), "/(batch-[^/]+)/", 1))
        first = self.spark.createDataFrame([(b["path"], int(part), int(p), o) for b in found for part, own in b["first"].items() for p, o in own.items()], "_b string, _part int, _p int, _first long")
        joined = read.join(first, (F.col("_batch") == F.col("_b")) & (F.col("part") == F.col("_part")) & (F.col("partition_id") == F.col("_p")))
        return joined.withColumn("offset", F.col("offset") + F.col("_first")).select(*SCHEMA.fieldNames())

    def _group(self, name: str, group: str) -> tuple[int, dict]:
        version, found = self.store.state("topics", name, "groups", group)
        return version, found or {"next": {}, "claims": {}}

    def committed(self, name: str, group: str) -> dict[int, int]:
        return {int(p): o for p, o in self._group(name, group)[1]["next"].items()}

    def groups(self, name: str) -> list[str]:
        return self.store.names("topics", name, "groups")

    @staticmethod
    def _start(state: dict, position) -> dict[int, int]:
        """The first offset asked for, by partition."""
        if isinstance(position, str) and position.lower() not in ("earliest", "latest"):
            raise NotFound(f"no position {position}")
        begin = state["next"] if isinstance(position, str) and position.lower() == "latest" else [int(position) if isinstance(position, int) else 0] * len(state["next"])
        return dict(enumerate(begin))

    def _since(self, name: str, state: dict, start: dict[int, int]) -> DataFrame:
        """Messages from the start offsets on; batches that end before every start are not read."""
        return since(self.messages(name, [b for b, ends in self._ends(state) if any(ends.get(p, 0) > o for p, o in start.items())]), start)

    def reading(self, name: str, position=None, partition: int | None = None) -> DataFrame:
        """All messages of all partitions (or one) from a position on, in no order and without claims: for any number of them, since none comes to the driver."""
        state = self.state(name)
        start = self._start(state, position)
        return self._since(name, state, start if partition is None else {partition: start[partition]})

    def consume(self, name: str, group: str | None = None, position=None, limit: int = 100, partition: int | None = None, now_ms: int | None = None) -> list:
        """Messages of all partitions (or one), which the driver holds: ``limit`` is a page. A group goes on from its acknowledged offsets, past what other calls claimed in the last minute;
        a claim that isn't acknowledged in time is handed out again."""
        now = int(time.time() * 1000) if now_ms is None else now_ms
        while True:
            state = self.state(name)
            start = self._start(state, position)
            if group is not None:
                version, held = self._group(name, group)
                live = {int(p): upto for p, (upto, expires) in held["claims"].items() if expires > now}
                for p in start:
                    start[p] = max(int(held["next"].get(str(p), start[p])), live.get(p, 0))
            if partition is not None:
                start = {partition: start[partition]}
            rows = consume(self._since(name, state, start), start, limit).collect()
            if group is None or not rows:
                return rows
            claims = {p: c for p, c in held["claims"].items() if c[1] > now}
            for r in rows:
                p = str(r["partition_id"])
                claims[p] = [max(r["offset"] + 1, claims.get(p, [0, 0])[0]), now + VISIBILITY_MS]
            if self.store.swap({**held, "claims": claims}, version, "topics", name, "groups", group):
                return rows

    @staticmethod
    def _ends(state: dict) -> list[tuple[dict, dict[int, int]]]:
        """Each batch with the offset after its last, by partition."""
        out, after = [], dict(enumerate(state["next"]))
        for b in reversed(state["batches"]):
            own: dict[int, int] = {}
            for firsts in b["first"].values():
                for p, o in firsts.items():
                    own[int(p)] = min(own.get(int(p), o), o)
            out.append((b, {p: after[p] for p in own}))
            after |= own
        return out[::-1]

    def ack(self, name: str, group: str, partition: int, offset: int) -> None:
        """Everything up to ``offset`` is done; an older acknowledgement changes nothing."""
        self.catalog.need("topics", name)
        while True:
            version, held = self._group(name, group)
            done = {**held["next"], str(partition): max(held["next"].get(str(partition), 0), offset + 1)}
            if self.store.swap({**held, "next": done}, version, "topics", name, "groups", group):
                return

    def retain(self, name: str, cutoff_ms: int) -> int:
        """Drop batches whose messages are all older than the cutoff; returns how many messages went."""
        while True:
            state = self.state(name)
            old = [b for b in state["batches"] if b["newest_ms"] < cutoff_ms]
            if not old or self._swap(name, {**state, "batches": [b for b in state["batches"] if b not in old]}):
                break
        for b in old:
            self.store.delete("topics", name, b["path"])
        return sum(b["n"] for b in old)
