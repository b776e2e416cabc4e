"""Column types: SQL spellings, logical types and their Spark types.

The logical type of a column is kept in its field's metadata, since TEXT, JSON, FILE and UUID are all strings to Spark.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The spellings of each logical type.
SPELLINGS = {
    "BOOLEAN": ("BOOLEAN", "BOOL"),
    "SMALLINT": ("SMALLINT", "INT2", "SMALLSERIAL"),
    "INT": ("INT", "INTEGER", "INT4", "MEDIUMINT", "SERIAL"),
    "BIGINT": ("BIGINT", "INT8", "BIGSERIAL"),
    "FLOAT": ("FLOAT", "REAL", "FLOAT4"),
    "DOUBLE": ("DOUBLE", "DOUBLE PRECISION", "FLOAT8", "FLOAT64"),
    "DECIMAL": ("DECIMAL", "NUMERIC"),
    "TEXT": ("TEXT", "CHAR", "CHARACTER", "VARCHAR", "NVARCHAR", "CLOB", "STRING"),
    "BYTES": ("BYTES", "BINARY", "VARBINARY", "BLOB", "BYTEA"),
    "JSON": ("JSON", "JSONB"),
    "TIMESTAMP": ("TIMESTAMP",),
    "DATETIME": ("DATETIME",),
    "DATE": ("DATE",),
    "TIME": ("TIME",),
    "UUID": ("UUID",),
    "EMBEDDING": ("EMBEDDING",),
    "FILE": ("FILE",),
}
SERIALS = ("SMALLSERIAL", "SERIAL", "BIGSERIAL")
MAX_DIMENSION = 8192
_BY_SPELLING = {s: k for k, all_ in SPELLINGS.items() for s in all_}
_SIMPLE = {
    "BOOLEAN": T.BooleanType(), "SMALLINT": T.ShortType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(),
    "TEXT": T.StringType(), "BYTES": T.BinaryType(), "JSON": T.StringType(), "TIMESTAMP": T.TimestampNTZType(), "DATETIME": T.TimestampType(), "DATE": T.DateType(),
    "TIME": T.LongType(), "UUID": T.StringType(), "FILE": T.StringType(),
}


class TypeError_(ValueError):
    """A spelling that is no column type."""


@dataclass(frozen=True)
class ColumnType:
    """A logical type with its parameters: (precision, scale) of DECIMAL, (dimension,) of EMBEDDING."""

    name: str
    params: tuple[int, ...] = ()

    @property
    def spark(self) -> T.DataType:
        if self.name == "DECIMAL":
            return T.DecimalType(*self.params)
        if self.name == "EMBEDDING":
            return T.ArrayType(T.FloatType(), True)
        return _SIMPLE[self.name]

    def __str__(self) -> str:
        return self.name + (f"({','.join(map(str, self.params))})" if self.params else "")

    @property
    def metadata(self) -> dict:
        return {"logical_type": str(self)}


def parse_type(text: str) -> ColumnType:
    """The type of a spelling such as ``VARCHAR(20)`` or ``EMBEDDING(3)``."""
    m = re.fullmatch(r"\s*([A-Za-z][A-Za-z0-9 ]*?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*", text)
    name = _BY_SPELLING.get(re.sub(r"\s+", " ", m[1].upper())) if m else None
    if name is None:
        raise TypeError_(f"unknown column type: {text}")
    numbers = tuple(int(x) for x in m.groups()[1:] if x is not None)
    if name == "DECIMAL":
        precision, scale = (numbers + (0,))[:2] if numbers else (38, 10)
        if not 1 <= precision <= 38 or scale > precision:
            raise TypeError_(f"DECIMAL precision must be 1 to 38 and not below the scale: {text}")
        return ColumnType(name, (precision, scale))
    if name == "EMBEDDING":
        if len(numbers) != 1 or not 1 <= numbers[0] <= MAX_DIMENSION:
            raise TypeError_(f"EMBEDDING takes a dimension of 1 to {MAX_DIMENSION}: {text}")
        return ColumnType(name, numbers)
    return ColumnType(name)


def from_spark(kind: T.DataType) -> ColumnType:
    """The logical type of a Spark type without metadata."""
    for name in ("BOOLEAN", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "TEXT", "BYTES", "TIMESTAMP", "DATETIME", "DATE"):
        if _SIMPLE[name] == kind:
            return ColumnType(name)
    if isinstance(kind, T.DecimalType):
        return ColumnType("DECIMAL", (kind.precision, kind.scale))
    raise TypeError_(f"no column type for {kind.simpleString()}")


def coerce(value: Column, kind: ColumnType, have: T.DataType) -> Column:
    """``value`` as a column of ``kind`` on write: numbers in strings, embeddings in JSON text, times of day as microseconds."""
    if kind.name == "EMBEDDING":
        vector = F.from_json(value, "array<float>") if isinstance(have, T.StringType) else value.cast("array<float>")
        size = kind.params[0]
        return F.when(vector.isNull(), vector).when(F.size(vector) == size, vector).otherwise(F.raise_error(F.concat(F.lit(f"EMBEDDING({size}) got a vector of length "), F.size(vector).cast("string"))))
    if kind.name == "TIME" and isinstance(have, T.StringType):
        part = lambda i: F.split_part(value, F.lit(":"), F.lit(i))
        return ((part(1).cast("long") * 3600 + part(2).cast("long") * 60) * 1_000_000 + (part(3).cast("decimal(12,6)") * 1_000_000).cast("long")).cast("long")
    if kind.name == "JSON" and not isinstance(have, T.StringType):
        return F.to_json(value) if isinstance(have, (T.StructType, T.ArrayType, T.MapType)) else value.cast("string")
    if kind.name == "UUID" and isinstance(have, T.StringType):
        plain = F.lower(F.regexp_replace(value, "[{}-]", ""))
        parts = [F.substring(plain, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return F.when(value.isNull(), value).when(plain.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts)).otherwise(F.raise_error(F.concat(F.lit("not a UUID: "), value)))
    return value.cast(kind.spark)
