"""System tables and views, computed when they are read."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame

from . import security
from .types import SPELLINGS, parse_type

#: Views that every user may read.
OPEN = ("system.datatypes", "system.describe", "system.columns", "system.tables")


def _users(s):
    mask = lambda v: v if s.role in security.ADMINS else "***"
    return [(u["name"], u["role"], u.get("email"), mask(u["password_hash"]), bool(u.get("deleted")), u["created_ms"]) for u in s.catalog.all("users")], "user_id string, role string, email string, password_hash string, deleted boolean, created_ms long"


def _namespaces(s):
    return [(n["name"], json.dumps(n["options"]), n["created_ms"]) for n in s.catalog.all("namespaces")], "namespace_id string, options string, created_ms long"


def _visible(s):
    return [t for t in s.catalog.tables() if security.may_read(t.kind, s.access(t), s.role)]


def _tables(s):
    return [(t.namespace, t.name, t.kind, t.schema_version, json.dumps(t.options), t.comment, t.created_ms) for t in _visible(s)], "namespace_id string, table_name string, table_type string, schema_version int, options string, comment string, created_ms long"


def _columns(s):
    rows = [(t.namespace, t.name, c.name, i + 1, c.type, c.nullable, c.primary_key, c.default) for t in _visible(s) for i, c in enumerate(t.columns)]
    return rows, "namespace_id string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable boolean, is_primary_key boolean, column_default string"


def _schemas(s):
    rows = [(t.namespace, t.name, int(v), i, n, k) for t in _visible(s) for v, cols in t.history.items() for i, n, k in cols]
    return rows, "namespace_id string, table_name string, schema_version int, column_id int, column_name string, data_type string"


def _storages(s):
    return [(x["name"], x["type"], x.get("base_directory"), "***" if "credentials" in x else None) for x in s.catalog.all("storages")], "storage_id string, storage_type string, base_directory string, credentials string"


def _jobs(s):
    return [(j["job_id"], j["job_type"], j["target"], j["status"], j["message"], j["created_ms"], j.get("finished_ms")) for j in s.catalog.all("jobs")], "job_id string, job_type string, target string, status string, message string, created_ms long, finished_ms long"


def _manifest(s):
    rows = [(t.full_name, m.version, x.path, x.tier, x.schema_version, x.rows, x.seq[0], x.seq[1], x.commit[0], x.commit[1], str(x.pk[0]), str(x.pk[1]), x.tombstones) for t in s.catalog.tables() for m in [s.engine.log(t).manifest()] for x in m.segments]
    return rows, "table string, version long, path string, tier string, schema_version int, rows long, min_seq long, max_seq long, min_commit long, max_commit long, min_key string, max_key string, tombstones long"


def _topics(s):
    return [(t["name"], t["partitions"], json.dumps(s.engine.topics.state(t["name"])["next"]), json.dumps(t["sources"])) for t in s.catalog.all("topics")], "topic_id string, partitions int, next_offsets string, sources string"


def _topic_offsets(s):
    topics = s.engine.topics
    return [(t["name"], g, p, n) for t in s.catalog.all("topics") for g in topics.groups(t["name"]) for p, n in topics.committed(t["name"], g).items()], "topic_id string, group_id string, partition_id int, next_offset long"


def _stats(s):
    e = s.engine
    rows = [("uptime_seconds", str(int(time.time() - e.started))), ("tables", str(len(s.catalog.names("tables")))), ("namespaces", str(len(s.catalog.names("namespaces")))), ("subscriptions", str(len(e.subscriptions))), ("transactions", str(len(e.transactions))), ("slow_queries", str(len(e.slow)))]
    return rows, "metric string, value string"


def _live(s):
    return [(x.id, x.owner, x.query, x.active) for x in s.engine.subscriptions.values()], "live_id string, session_id string, query string, active boolean"


def _sessions(s):
    return [(s.id, s.user, s.role, s.namespace)], "session_id string, user_id string, role string, namespace string"


def _transactions(s):
    return [(t.id, t.owner, t.snapshot, t.order, t.bytes) for t in s.engine.transactions.values()], "transaction_id string, owner string, snapshot long, statements int, bytes long"


def _settings(s):
    pairs = {k: v for k, v in vars(s.engine.settings).items() if k != "extra"} | s.engine.settings.extra
    return [(k, str(v)) for k, v in sorted(pairs.items())], "name string, value string"


def _server_logs(s):
    return [(f"{t:.3f}", q) for t, q in s.engine.slow], "seconds string, message string"


def _cluster(s):
    sc = s.spark.sparkContext
    infos = sc._jsc.sc().statusTracker().getExecutorInfos()
    return [(sc.applicationId, x.host(), x.port(), x.numRunningTasks()) for x in infos], "application string, host string, port int, running_tasks int"


def _cluster_groups(s):
    return [("spark", s.spark.sparkContext.master, s.spark.sparkContext.defaultParallelism)], "group string, master string, parallelism int"


def _datatypes(s):
    example = {"DECIMAL": "DECIMAL(38,10)", "EMBEDDING": "EMBEDDING(3)"}
    return [(k, ", ".join(v), parse_type(example.get(k, k)).spark.simpleString()) for k, v in SPELLINGS.items()], "data_type string, spellings string, spark_type string"


def _audit_log(s):
    return [(j["created_ms"], j["job_type"], j["target"], j["status"]) for j in s.catalog.all("jobs")], "at_ms long, action string, target string, status string"


def _job_nodes(s):
    return [(j["job_id"], "driver", j["status"]) for j in s.catalog.all("jobs")], "job_id string, node string, status string"


VIEWS = {
    "users": _users, "namespaces": _namespaces, "tables": _tables, "columns": _columns, "describe": _columns, "schemas": _schemas, "table_schemas": _schemas, "storages": _storages, "jobs": _jobs, "job_nodes": _job_nodes, "audit_log": _audit_log,
    "manifest": _manifest, "topics": _topics, "topic_offsets": _topic_offsets, "stats": _stats, "live": _live, "sessions": _sessions, "transactions": _transactions, "settings": _settings, "server_logs": _server_logs, "cluster": _cluster, "cluster_groups": _cluster_groups, "datatypes": _datatypes,
}


def read(session, name: str) -> DataFrame:
    from .sources.catalog import NotFound

    if name not in VIEWS:
        raise NotFound(f"system.{name} not found")
    rows, schema = VIEWS[name](session)
    return session.spark.createDataFrame(rows, schema)


def information_schema(session, name: str) -> DataFrame:
    """``tables`` and ``columns`` with the standard's names."""
    if name == "tables":
        return session.spark.createDataFrame([("strandline", t.namespace, t.name, "BASE TABLE") for t in _visible(session)], "table_catalog string, table_schema string, table_name string, table_type string")
    rows = [("strandline", t.namespace, t.name, c.name, i + 1, c.default, "YES" if c.nullable else "NO", c.type) for t in _visible(session) for i, c in enumerate(t.columns)]
    return session.spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, column_default string, is_nullable string, data_type string")
