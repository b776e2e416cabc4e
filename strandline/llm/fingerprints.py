"""Document fingerprints: MinHash signatures over five-word shingles, computed in vectorised numpy.

A fingerprint is the signature of ``n`` (128) permutations, 16 bits each, as hexadecimal text. The likeness of two fingerprints is the
share of equal values, corrected for the chance agreement of 16-bit values. Equal texts have equal fingerprints.

:func:`similar_documents` joins the fingerprints' bands (25 bands of 5 values; a pair at 0.8 shares none with probability 5e-5) in Spark and verifies the Jaccard similarity of what they find exactly, with the
blocks of ``jaccard_join``. Bands are reduced to stars and their components with partial aggregation, so no pairs of a band are listed; :func:`similar_fingerprints` adds its groups to the
rows of :func:`edited_fingerprints`.

:func:`edited_fingerprints` also fingerprints each document's edited text, whose last half comes from the next document by id. The
next document is found without a global window: ids are cut into ranges at quantiles of a sample of 20 ids a range (at most ``most_ranges`` ranges), each range is a partition, sorted
by itself, and the first document of each range, found by its id, is added to the range before as a helper. Texts are shuffled once.

Cases: null counts as empty; a text without words has the fingerprint of all bits set. Ids that are equal follow each other in the order of
their texts' hashes, null ids come last. One document is its own next. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, small_batches
from .jaccard_join import Bands, Joined
from .shingles import MinHash, shingles

RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, similar_id long, n_similar long"

#: Sampled ids for each range.
SAMPLED = 20
#: Kinds of rows in the order of a text's rows: its group, the text, and the first text of the next range.
GROUP, TEXT, HELPER = 0, 1, 2


def signatures(raw: list[bytes], n: int) -> np.ndarray:
    """16-bit signatures of texts as bytes."""
    bounds = np.concatenate(([0], np.cumsum([len(b) for b in raw]))).astype(np.int64)
    names, at = shingles(np.frombuffer(b"".join(raw), np.uint8), bounds)
    return (MinHash.get(n).sign(names, at) >> np.uint32(16)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    share = (a == b).mean(axis=-1)
    return np.maximum(0.0, (share - 2.0**-16) / (1 - 2.0**-16))


def _fingerprint_rows(n: int):
    def rows(batches):
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes().hex() for s in signatures(raw, n)], pa.string())], ["doc_id", "fingerprint"])

    return rows


def fingerprints(documents: DataFrame, n: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row."""
    small_batches(documents.sparkSession)
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprint_rows(n), "doc_id long, fingerprint string")


def similar_documents(documents: DataFrame, n: int = 128, bands: int = 25, rows: int = 5, threshold: float = 0.8, tolerance: float = 1e-9, block: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k2 (hash of the text), similar_id (the least id of the near-duplicate group) and n_similar (other documents linked, copies included) of every row."""
    if bands * rows > n:
        raise ValueError("the bands need more values than a fingerprint has")
    joined = Joined(documents, Bands(n, bands, rows, 16), threshold, tolerance, block, id_col, text_col)
    # written here, so that all that led to it goes before the result is used
    found = materialise(joined.result().select("doc_id", "k2", F.col("group_id").alias("similar_id"), F.col("n_links").alias("n_similar")))
    joined.drop()
    return found


def similar_fingerprints(documents: DataFrame, n: int = 128, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of :func:`edited_fingerprints` with similar_id and n_similar."""
    # equal rows share their group
    groups = similar_documents(documents, n, threshold=threshold, id_col=id_col, text_col=text_col).distinct()
    return _edited(documents, n, id_col=id_col, text_col=text_col, groups=groups, **options)


def _edited_rows(n: int):
    names = [f.split(" ")[0] for f in RESULT.split(", ")]

    def made(ids, own, following, groups):
        """Rows for texts ``own``, each followed by ``following``."""
        edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(own, following)]
        raw = [e.encode() for e in edited]
        mine = signatures([t.encode() for t in [*own, following[-1]]], n)
        other = signatures(raw, n)
        sha = [hashlib.sha256(b).hexdigest() for b in raw]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array(sha), pa.array([s.tobytes().hex() for s in mine[:-1]]), pa.array([s.tobytes().hex() for s in other]),
                pa.array(likeness(mine[:-1], other)), pa.array(likeness(mine[:-1], mine[1:])), pa.array([g[0] for g in groups], pa.int64()), pa.array([g[1] for g in groups], pa.int64()),
            ],
            names,
        )

    def rows(batches):
        held = None  # the last row, which waits for its next: range, id, text, group
        group = (None, None)  # of the rows that come: groups lie before their documents
        for batch in batches:
            ids, own, following, groups, at = [], [], [], [], 0
            for part, doc_id, text, kind, similar_id, n_similar in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if kind == GROUP:
                    group = (similar_id, n_similar)
                    continue
                if held is not None and held[0] == part:
                    ids.append(held[1])
                    own.append(held[2])
                    groups.append(held[3])
                    following.append(text or "")
                    at += len(text or "") + len(held[2])
                held = None if kind == HELPER else (part, doc_id, text or "", group)
                if at > 4_000_000:
                    yield from runs(ids, own, following, groups)
                    ids, own, following, groups, at = [], [], [], [], 0
            yield from runs(ids, own, following, groups)

    def runs(ids, own, following, groups):
        """Stretches in which each text follows the one before."""
        start = 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or following[i - 1] is not own[i]:
                yield made(ids[start:i], own[start:i], following[start:i], groups[start:i])
                start = i

    return rows


def range_of(ids: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most the id, looked up in two levels; null ids lie behind all."""
    wide = max(1, math.isqrt(len(cuts)))
    pieces = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    piece = F.from_json(F.lit(json.dumps(pieces)), "array<array<bigint>>")
    first = F.from_json(F.lit(json.dumps([p[0] for p in pieces])), "array<bigint>")
    at = F.size(F.filter(first, lambda c: c <= ids))  # pieces that begin at or before the id
    within = F.size(F.filter(F.get(piece, at - 1), lambda c: c <= ids))
    return F.when(ids.isNull(), len(cuts)).when(at == 0, 0).otherwise((at - 1) * wide + within).cast("int")


def _edited(documents: DataFrame, n: int = 128, rows_in_range: int = 2000, most_ranges: int = 100_000, id_col: str = "doc_id", text_col: str = "text", groups: DataFrame | None = None) -> DataFrame:
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k2"), F.col(text_col).alias("text"))
    known = docs.filter("doc_id is not null").select("doc_id")
    count = known.count()
    ranges = max(1, min(most_ranges, -(-count // rows_in_range)))
    # cuts at quantiles of a bounded sample; they only decide how evenly the work is dealt
    hashed = F.pmod(F.xxhash64(F.lit(41), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    sample = np.sort(known.filter(hashed < SAMPLED * ranges / max(count, 1)).toArrow().column("doc_id").to_numpy()) if ranges > 1 else np.zeros(0, np.int64)
    cuts = np.unique(sample[np.arange(1, ranges) * len(sample) // ranges]).tolist() if len(sample) else []
    part = range_of(F.col("doc_id"), cuts) if cuts else F.lit(0)
    # the least id of each range (null if it has null ids alone); at most most_ranges rows
    heads = sorted((r["r"], r["m"]) for r in docs.groupBy(part.alias("r")).agg(F.min("doc_id").alias("m")).collect())
    before = [(heads[i - 1][0], m) for i, (_, m) in enumerate(heads)]
    wanted = spark.createDataFrame(before, "part int, head long")
    order = F.struct(F.col("k2"), F.col("text"))
    helpers = docs.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("part", "doc_id").agg(F.min_by("text", order).alias("text"))
    none = F.lit(None).cast("long")
    both = docs.select(part.alias("part"), "doc_id", "k2", "text", F.lit(TEXT).alias("kind"), none.alias("similar_id"), none.alias("n_similar"))
    both = both.unionAll(helpers.select("part", "doc_id", F.lit(0).cast("long"), "text", F.lit(HELPER), none, none))
    if groups is not None:  # they travel as rows before their documents, so that nothing is joined to the texts or their fingerprints
        both = both.unionAll(groups.select(part.alias("part"), "doc_id", "k2", F.lit(None).cast("string"), F.lit(GROUP), "similar_id", "n_similar"))
    sorted_rows = both.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", F.col("kind") == HELPER, F.col("doc_id").asc_nulls_last(), "k2", "kind", "text")
    return sorted_rows.select("part", "doc_id", "text", "kind", "similar_id", "n_similar").mapInArrow(_edited_rows(n), RESULT)


def edited_fingerprints(documents: DataFrame, n: int = 128, rows_in_range: int = 2000, most_ranges: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, see RESULT and the module's text."""
    return _edited(documents, n, rows_in_range, most_ranges, id_col, text_col).drop("similar_id", "n_similar")
