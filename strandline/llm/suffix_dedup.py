"""Exact removal of repeated byte strings, by distributed prefix doubling over sampled positions.

A string of ``length`` (200) bytes that starts at two or more places of the corpus has all its bytes
removed, at every place. Strings are judged on the input and never cross documents.

Ranks (``ranks``): 8 bytes rank as themselves, and 16, 32, 64 and 128 bytes by the pair of ranks of the two halves, at offsets that double; the last lengths by ranks
that overlap. A rank is equal wherever its bytes are, so a task ranks its own positions and Spark decides which ranks occur again:

* Positions are sampled by content: every window of ``length`` bytes picks the position of least rank of 48 bytes (leftmost on ties). Equal windows pick
  the same position, so equality of windows is decided among equal sampled positions only; about 1.3 % of all bytes are sampled.
  The windows that pick one position form its *run*, a stretch of at most 350 bytes.
* Each round sorts the entries by the rank of their core, which all their windows hold, and looks at that of their hull, which they span.
  A core that occurs once is unique: its windows leave. If all entries with one core share one hull, whole windows repeat:
  past the threshold. Otherwise one entry of each distinct hull goes on to the next round, with a longer core.
* Rounds: the core is 48 bytes (32 and 32, 16 apart) and the hull a run; then 185 bytes (128 and 128) and up to 16 neighbouring windows; then 200 bytes (128 and 128, 72 apart), one
  window, ranked in two families.

Core and hull are ranked in different families of 64 bits, so strings of one core are taken as equal by mistake with probability 2**-64, and strings without a
common core never unless 128 bits agree.

Each round is written once, and its shuffle files go when it is written. Whole texts are shuffled twice: to the entries that the first round leaves open, and to the result; the last round
takes the bytes it needs along. Ranks are counted with partial aggregation and joined back (sort-merge, so AQE may split a hot rank); no group is collected, apart from the entries of one document.

Cases: null text counts as empty (n_bytes 0, sha256 of nothing). Equal rows, also with equal ids, are separate
documents and so repeat each other. A null id stays null. Texts under ``length`` bytes are never changed.
An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_written, fresh, materialise, small_batches, texts
from .ranks import U64, Ranks, mix64, octets

PREFIX = 48
BLOCK = 16
CHUNK = 1 << 15

#: pos: first window << 16 | bytes from there to the sampled position << 8 | windows.
PLACE = ["k1", "k2", "pos"]
ENTRIES = "k1 long, k2 int, pos long, core long, hull long"
#: own: is a result wanted for it? bytes: those of the hull.
BLOCKS = "k1 long, k2 int, pos long, own boolean, core long, hull long, bytes binary"
WINDOWS = "k1 long, k2 int, pos long, own boolean, core long, hull long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def names(schema: str) -> list[str]:
    return [f.split(" ")[0] for f in schema.split(", ")]


def top_rank(length: int) -> int:
    """The bytes of the greatest rank: a power of two that fits into every core."""
    return 1 << ((length - BLOCK + 1).bit_length() - 1)


def runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that pick one position: first window, sampled position, windows, core rank, hull rank.

    ``data`` holds whole texts side by side, ``ends`` the end of the text that each byte lies in."""
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none
    a, b, top = Ranks.get(1), Ranks.get(2), top_rank(length)
    eight = octets(data)
    prefix = a.apart(a.doubled(eight, 8, 32), PREFIX - 32)
    low = (prefix & ~U64(0xFFFFF)) | np.arange(len(prefix), dtype=U64)
    width, have = length - PREFIX + 1, 1
    while have < width:  # sliding minimum by doubling
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    pick = (low[:n] & U64(0xFFFFF)).astype(np.int64)
    inside = np.arange(n) + length <= ends[:n]
    starts = np.flatnonzero(inside & np.concatenate(([True], (pick[1:] != pick[:-1]) | ~inside[:-1] | (ends[1:n] != ends[: n - 1]))))
    if not len(starts):
        return none, none, none, none, none
    gone = np.concatenate((np.flatnonzero(~inside), [n]))
    stop = np.minimum(np.append(starts[1:], n), gone[np.searchsorted(gone, starts)])
    at = pick[starts]
    whole = b.cover(b.doubled(eight, 8, top), top, starts, stop + length - 1)
    hull = b.pair(whole, mix64(((at - starts) << 20 | (stop - starts)).astype(U64)))
    return starts, at, stop - starts, prefix[at].view(np.int64), hull.view(np.int64)


def _chunks(bounds: np.ndarray, length: int):
    """Groups of whole texts, or pieces of one long text that overlap by length - 1: (document, from, to) lists."""
    group, size = [], 0
    for d in range(len(bounds) - 1):
        start, end = int(bounds[d]), int(bounds[d + 1])
        if end - start < length:
            continue
        while end - start > CHUNK:
            yield [(d, start, start + CHUNK)]
            start += CHUNK - length + 1
        if size + end - start > CHUNK and group:
            yield group
            group, size = [], 0
        group.append((d, start, end))
        size += end - start
    if group:
        yield group


def _anchor_rows(length: int):
    def rows(batches):
        for batch in batches:
            k1, k2 = batch.column(0), batch.column(1)
            data, bounds = texts(batch.column(2))
            for group in _chunks(bounds, length):
                sizes = np.array([e - s for _, s, e in group])
                part = np.concatenate([data[s:e] for _, s, e in group])
                first = np.cumsum(sizes) - sizes
                start, pick, count, core, hull = runs(part, np.repeat(first + sizes, sizes), length)
                which = np.searchsorted(first, start, "right") - 1
                doc = np.array([d for d, _, _ in group])[which]
                at = start - first[which] + np.array([s - bounds[d] for d, s, _ in group])[which]
                pos = at << 16 | (pick - start) << 8 | count
                yield pa.RecordBatch.from_arrays([k1.take(pa.array(doc)), k2.take(pa.array(doc)), pa.array(pos), pa.array(core), pa.array(hull)], names(ENTRIES))

    return rows


def blocks(first, rel, count, length: int):
    """Cuts runs at multiples of ``BLOCK`` windows, counted back from the sampled position.

    Gives for each block: its run, first window, windows, and the start and length of its core."""
    high, low = rel // BLOCK, (rel - count + 1) // BLOCK
    n = high - low + 1
    run = np.repeat(np.arange(len(first)), n)
    j = high[run] - (np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n))
    point, widest = (first + rel)[run], length - PREFIX
    back, least = np.minimum(rel[run], j * BLOCK + BLOCK - 1), np.maximum((rel - count + 1)[run], j * BLOCK)
    start = point - j * BLOCK
    return run, point - back, back - least + 1, start, length - (np.minimum(j * BLOCK + BLOCK - 1, widest) - j * BLOCK)


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte strings of a buffer, as a binary array."""
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size)))
    index = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[index])])


def _block_rows(length: int):
    def rows(batches):
        a, b, top = Ranks.get(3), Ranks.get(4), top_rank(length)
        for batch in batches:
            data, bounds = texts(batch.column(2))
            found = batch.column(3)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
            flat = found.flatten()
            pos, own = (x.to_numpy(zero_copy_only=False) for x in flat.flatten())
            place = bounds[doc] + (pos >> 16)  # where each run starts among the batch's bytes
            order = np.argsort(place, kind="stable")
            doc, pos, own, place = doc[order], pos[order], own[order], place[order]
            for lo in range(0, len(data), CHUNK):
                s, e = np.searchsorted(place, [lo, lo + CHUNK])
                if s == e:
                    continue
                part = data[lo : lo + CHUNK + 3 * length]
                run, q, n, c, clen = blocks(place[s:e] - lo, pos[s:e] >> 8 & 0xFF, pos[s:e] & 0xFF, length)
                eight = octets(part)
                point = (place[s:e] - lo + (pos[s:e] >> 8 & 0xFF))[run]
                core = a.pair(a.cover(a.doubled(eight, 8, top), top, c, c + clen), mix64((point - c).astype(U64)))
                hull = b.pair(b.cover(b.doubled(eight, 8, top), top, q, q + n - 1 + length), mix64(((point - q) << 8 | n).astype(U64)))
                at = doc[s:e][run]
                start = q + lo - bounds[at]
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(start << 16 | (point - q) << 8 | n), pa.array(own[s:e][run]), pa.array(core.view(np.int64)), pa.array(hull.view(np.int64)), _slices(part, q, q + n - 1 + length)],
                    names(BLOCKS),
                )

    return rows


def _window_rows(length: int):
    def rows(batches):
        families, top = (Ranks.get(5), Ranks.get(6)), top_rank(length)
        for batch in batches:
            data, bounds = texts(batch.column(4))
            n = np.diff(bounds) - length + 1
            row = np.repeat(np.arange(batch.num_rows), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            q = bounds[row] + step
            eight = octets(data)
            core, hull = (f.cover(f.doubled(eight, 8, top), top, q, q + length) for f in families)
            pos = (batch.column(2).to_numpy()[row] >> 16) + step << 16 | 1
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(pos), batch.column(3).take(at), pa.array(core.view(np.int64)), pa.array(hull.view(np.int64))], names(WINDOWS))

    return rows


def merged(pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte runs covered by windows."""
    lo = pos >> 16
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], (lo + (pos & 0xFF) - 1 + length)[order]
    reach = np.maximum.accumulate(hi)
    new = np.concatenate(([True], lo[1:] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(lo) - 1]))
    return lo[new], reach[last]


def _result_rows(length: int):
    def rows(batches):
        for batch in batches:
            data, bounds = texts(batch.column(1))
            found = batch.column(2)
            size, gone, spans, sha = np.diff(bounds), [], [], []
            for d in range(batch.num_rows):
                text = data[bounds[d] : bounds[d + 1]]
                pos = found[d].values if found[d].is_valid else None
                if pos is None or not len(pos):
                    gone.append(0)
                    spans.append(0)
                    sha.append(hashlib.sha256(text).hexdigest())
                    continue
                lo, hi = merged(pos.to_numpy(zero_copy_only=False), length)
                digest, at = hashlib.sha256(), 0
                for s, e in zip(lo.tolist(), hi.tolist()):
                    digest.update(text[at:s])
                    at = e
                digest.update(text[at:])
                gone.append(int((hi - lo).sum()))
                spans.append(len(lo))
                sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names(RESULT))

    return rows


def _again(entries: DataFrame) -> DataFrame:
    """Places whose core occurs again, with whether all of that core share one hull."""
    ranks = entries.groupBy("core").agg(F.count(F.lit(1)).alias("c"), F.min("hull").alias("a"), F.max("hull").alias("b")).filter("c > 1")
    return entries.join(ranks.select(fresh("core").alias("core"), (F.col("a") == F.col("b")).alias("settled")).hint("merge"), "core")


def _split(ranked: DataFrame, entry) -> tuple[DataFrame, DataFrame]:
    """Places that repeat, and one entry for each distinct hull of the cores that are not settled: core, hull, c, one."""
    mixed = ranked.filter("not settled")
    one = materialise(mixed.groupBy("core", "hull").agg(F.count(F.lit(1)).alias("c"), F.min(entry).alias("one")))
    twice = one.filter("c > 1").select(fresh("core").alias("core"), fresh("hull").alias("hull")).hint("merge")
    again = mixed.filter("own").join(twice, ["core", "hull"])
    return ranked.filter("settled and own").select(*PLACE).unionAll(again.select(*PLACE)), one


def repeated_windows(docs: DataFrame, length: int = 200) -> DataFrame:
    """Windows that repeat: (k1, k2, pos). ``docs``: k1, k2, text."""
    if not 2 * PREFIX <= length <= 300:
        raise ValueError(f"length must be {2 * PREFIX} to 300")
    sampled = materialise(docs.mapInArrow(_anchor_rows(length), ENTRIES))
    ranked = materialise(_again(sampled).withColumn("own", F.lit(True)))
    drop_written(sampled)
    runs_again, one = _split(ranked, F.struct(*PLACE))
    lone = one.groupBy(F.col("one.k1").alias("e1"), F.col("one.k2").alias("e2")).agg(F.collect_list(F.struct(F.col("one.pos").alias("pos"), (F.col("c") == 1).alias("own"))).alias("entries"))
    here = docs.join(lone.hint("merge"), F.col("k1").eqNullSafe(F.col("e1")) & (F.col("k2") == F.col("e2")))
    cut = materialise(here.select("k1", "k2", "text", "entries").mapInArrow(_block_rows(length), BLOCKS))
    ranked = materialise(_again(cut))
    drop_written(cut)
    blocks_again, one = _split(ranked, F.struct(*PLACE, "own", "bytes"))
    windows = one.select("one.k1", "one.k2", "one.pos", (F.col("one.own") & (F.col("c") == 1)).alias("own"), "one.bytes").mapInArrow(_window_rows(length), WINDOWS)
    windows = materialise(windows)
    twice = windows.groupBy("core", "hull").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(fresh("core").alias("core"), fresh("hull").alias("hull")).hint("merge")
    return runs_again.unionAll(blocks_again).unionAll(windows.filter("own").join(twice, ["core", "hull"]).select(*PLACE))


def suffix_dedup(documents: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256. See the module's text for the cases."""
    small_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("k1"), F.hash(F.coalesce(F.col(text_col), F.lit(""))).alias("k2"), F.col(text_col).alias("text"))
    # equal rows gave the same places, so each counts once
    spans = materialise(repeated_windows(docs, length).distinct().groupBy(F.col("k1").alias("e1"), F.col("k2").alias("e2")).agg(F.collect_list("pos").alias("spans")))
    joined = docs.join(spans.hint("merge"), F.col("k1").eqNullSafe(F.col("e1")) & (F.col("k2") == F.col("e2")), "left")
    return joined.select(F.col("k1").alias("doc_id"), "text", "spans").mapInArrow(_result_rows(length), RESULT)
