"""FILE columns: uploaded bytes beside their table, and the JSON reference kept in the row."""

from __future__ import annotations

import hashlib
import json
import mimetypes
import re
import uuid

from pyspark.sql import DataFrame

from ..plans.tokens import SqlError, replace, tokenize
from .files import Store

#: Files of a table are spread over so many folders.
FOLDERS = 64


def save(store: Store, folder: list[str], name: str, data: bytes) -> dict:
    """Write one file; returns its reference."""
    file_id = uuid.uuid4().hex
    sub = f"f{int(file_id[:8], 16) % FOLDERS:04d}"
    plain = re.sub(r"[^A-Za-z0-9._-]", "_", name.rsplit("/", 1)[-1])[-80:] or "file"
    store.write_bytes(data, *folder, "files", sub, f"{file_id}-{plain}")
    return {"id": file_id, "sub": sub, "name": name, "size": len(data), "mime": mimetypes.guess_type(name)[0] or "application/octet-stream", "sha256": hashlib.sha256(data).hexdigest(), "path": f"files/{sub}/{file_id}-{plain}"}


def placed(sql: str, files: dict[str, bytes], store: Store, folder: list[str]) -> str:
    """The statement with every ``FILE("name")`` replaced by a reference to the uploaded bytes."""
    tokens, edits = tokenize(sql), []
    for i, t in enumerate(tokens[:-3]):
        if t.upper == "FILE" and tokens[i + 1].text == "(" and tokens[i + 2].kind in ("string", "quoted") and tokens[i + 3].text == ")":
            name = tokens[i + 2].value
            if name not in files:
                raise SqlError(f"no file {name} was sent")
            ref = json.dumps(save(store, folder, name, files[name]))
            edits.append((t.start, tokens[i + 3].end, "'" + ref.replace("'", "''") + "'"))
    return replace(sql, edits)


def listing(store: Store, folder: list[str]) -> DataFrame:
    """All files of a table, as Spark reads binary files."""
    return store.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(store.uri(*folder, "files"))


def load(store: Store, folder: list[str], ref: str) -> bytes:
    """The bytes of one reference, checked against its hash."""
    r = json.loads(ref)
    row = store.spark.read.format("binaryFile").load(store.uri(*folder, *r["path"].split("/"))).select("content").first()
    data = bytes(row["content"])
    if hashlib.sha256(data).hexdigest() != r["sha256"]:
        raise OSError(f"{r['name']} does not have its hash")
    return data
