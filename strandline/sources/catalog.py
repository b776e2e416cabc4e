"""The catalog: namespaces, tables, storages, users, topics, views and jobs as JSON files below the engine's root."""

from __future__ import annotations

import re
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

from ..types import ColumnType, parse_type
from .files import Store

KINDS = ("USER", "SHARED", "STREAM", "SYSTEM")
ACCESS = ("public", "private", "restricted", "dba")
#: Names that no namespace may take.
RESERVED_NAMESPACES = ("system", "sys", "root", "main", "sql", "admin", "internal", "information_schema", "pg_catalog")
SYSTEM_COLUMNS = ("_seq", "_commit_seq", "_deleted", "_user_id")
DEFAULT_FUNCTIONS = ("NOW", "CURRENT_TIMESTAMP", "SNOWFLAKE_ID", "UUID_V7", "ULID", "CURRENT_USER")


class CatalogError(ValueError):
    pass


class NotFound(CatalogError):
    pass


class AlreadyExists(CatalogError):
    pass


@dataclass
class ColumnDef:
    """A column; ``column_id`` never changes, so a renamed column keeps its data."""

    column_id: int
    name: str
    type: str
    nullable: bool = True
    primary_key: bool = False
    default: str | None = None
    index: str | None = None

    @property
    def kind(self) -> ColumnType:
        return parse_type(self.type)


@dataclass
class TableDef:
    namespace: str
    name: str
    kind: str
    columns: list[ColumnDef]
    schema_version: int = 1
    next_column_id: int = 1
    options: dict = field(default_factory=dict)
    comment: str | None = None
    created_ms: int = 0
    updated_ms: int = 0
    table_id: str = ""
    #: columns of every schema version by id, name and type: how to read its segments
    history: dict[str, list] = field(default_factory=dict)

    @property
    def full_name(self) -> str:
        return f"{self.namespace}.{self.name}"

    @property
    def pk(self) -> str:
        return next(c.name for c in self.columns if c.primary_key)

    @property
    def by_user(self) -> bool:
        return self.kind in ("USER", "STREAM")

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name == name.lower():
                return c
        raise NotFound(f"column {name} not found in {self.full_name}")

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def schema(self) -> T.StructType:
        """Declared columns, then the system columns."""
        fields = [T.StructField(c.name, c.kind.spark, True, c.kind.metadata) for c in self.columns]
        fields += [T.StructField("_seq", T.LongType(), False), T.StructField("_commit_seq", T.LongType(), False), T.StructField("_deleted", T.BooleanType(), False)]
        return T.StructType(fields + ([T.StructField("_user_id", T.StringType(), False)] if self.by_user else []))

    def remember(self) -> None:
        """Note the columns of the present schema version."""
        self.history[str(self.schema_version)] = [[c.column_id, c.name, c.type] for c in self.columns]


def table_from(d: dict) -> TableDef:
    return TableDef(**{**d, "columns": [ColumnDef(**c) for c in d["columns"]]})


def checked_name(name: str, what: str) -> str:
    name = name.lower()
    if not re.fullmatch(r"[a-z_][a-z0-9_]{0,63}", name):
        raise CatalogError(f"bad {what} name: {name}")
    return name


def new_table(namespace: str, name: str, kind: str, columns: list[ColumnDef], options: dict | None = None, comment: str | None = None) -> TableDef:
    """A checked definition with numbered columns."""
    if kind not in KINDS:
        raise CatalogError(f"unknown table kind: {kind}")
    for i, c in enumerate(columns):
        c.column_id, c.name = i + 1, checked_name(c.name, "column")
        if c.name in SYSTEM_COLUMNS:
            raise CatalogError(f"{c.name} is a system column")
        if c.primary_key:
            c.nullable = False
    names = [c.name for c in columns]
    if len(set(names)) != len(names):
        raise CatalogError("duplicate column name")
    if sum(c.primary_key for c in columns) != 1:
        raise CatalogError("a table has exactly one primary key column")
    now = int(time.time() * 1000)
    table = TableDef(namespace, checked_name(name, "table"), kind, columns, 1, len(columns) + 1, dict(options or {}), comment, now, now)
    table.remember()
    return table


class Catalog:
    """Objects by group and name. Every change is one file, replaced as a whole."""

    GROUPS = ("namespaces", "tables", "storages", "users", "topics", "views", "jobs", "exports", "snapshots")

    def __init__(self, store: Store):
        self.store = store
        self._seen: dict = {}

    def put(self, group: str, name: str, value: dict, new: bool = False) -> None:
        import json

        if not self.store.create(json.dumps(value, indent=1), "_catalog", group, f"{name}.json", overwrite=not new):
            raise AlreadyExists(f"{group[:-1]} {name} already exists")
        self._seen[group, name] = value

    def get(self, group: str, name: str) -> dict | None:
        if (group, name) not in self._seen and self.store.exists("_catalog", group, f"{name}.json"):
            self._seen[group, name] = self.store.read_json("_catalog", group, f"{name}.json")
        return self._seen.get((group, name))

    def need(self, group: str, name: str) -> dict:
        value = self.get(group, name)
        if value is None:
            raise NotFound(f"{group[:-1]} {name} not found")
        return value

    def names(self, group: str) -> list[str]:
        return [n[:-5] for n in self.store.names("_catalog", group) if n.endswith(".json") and not n.startswith(".")]

    def all(self, group: str) -> list[dict]:
        return [self.need(group, n) for n in self.names(group)]

    def drop(self, group: str, name: str) -> None:
        self.need(group, name)
        self.store.delete("_catalog", group, f"{name}.json")
        self._seen.pop((group, name), None)

    def refresh(self) -> None:
        self._seen.clear()

    def table(self, full_name: str) -> TableDef:
        return table_from(self.need("tables", full_name))

    def has_table(self, full_name: str) -> bool:
        return self.get("tables", full_name) is not None

    def put_table(self, table: TableDef, new: bool = False) -> None:
        table.updated_ms = int(time.time() * 1000)
        self.put("tables", table.full_name, asdict(table), new)

    def tables(self, namespace: str | None = None) -> list[TableDef]:
        return [t for t in map(table_from, self.all("tables")) if namespace in (None, t.namespace)]
