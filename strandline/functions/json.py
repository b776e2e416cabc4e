"""JSON functions over text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path(*keys) -> str:
    """A JSON path of object keys and array positions."""
    return "$" + "".join(f"[{k}]" if isinstance(k, int) else "['" + str(k).replace("'", "\\'") + "']" for k in keys)


def _col(doc) -> Column:
    return F.col(doc) if isinstance(doc, str) else doc


def json_as_text(doc, *keys) -> Column:
    """``doc ->> key``: the value as text, null if absent or JSON null."""
    return F.get_json_object(_col(doc), path(*keys))


def json_get(doc, *keys) -> Column:
    """``doc -> key``: the value as JSON text."""
    return F.to_json(F.variant_get(F.try_parse_json(_col(doc)), path(*keys), "variant"))


def _at(doc, keys) -> Column:
    return json_as_text(doc, *keys) if keys else _col(doc)


def json_contains(doc, key, *parents) -> Column:
    """``doc ? key``: is the key there, also with JSON null."""
    return F.coalesce(F.array_contains(F.json_object_keys(_at(doc, parents)), F.lit(key)), F.lit(False))


def json_length(doc, *keys) -> Column:
    """Elements of an array or keys of an object."""
    at = _at(doc, keys)
    return F.coalesce(F.json_array_length(at), F.size(F.json_object_keys(at)))


def json_object_keys(doc, *keys) -> Column:
    return F.json_object_keys(_at(doc, keys))


def json_get_int(doc, *keys) -> Column:
    return F.try_variant_get(F.try_parse_json(_col(doc)), path(*keys), "bigint")


def json_get_float(doc, *keys) -> Column:
    return F.try_variant_get(F.try_parse_json(_col(doc)), path(*keys), "double")


def json_get_bool(doc, *keys) -> Column:
    return F.try_variant_get(F.try_parse_json(_col(doc)), path(*keys), "boolean")


def json_get_str(doc, *keys) -> Column:
    return F.try_variant_get(F.try_parse_json(_col(doc)), path(*keys), "string")
