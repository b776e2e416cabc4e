"""Hierarchical multi-length packing of token sequences.

A document is its ids (byte-level BPE) and the end id 1. Each task packs what it reads, so nothing is shuffled:

1. Route: a document over the largest tier (2048) fills whole windows of its own; the rest of it, and any shorter document,
   goes to the smallest tier (256, 512, 1024, 2048) that holds it.
2. Pack each tier, longest first: a window starts with the tier's longest document; its gap takes the longest documents
   of shorter or the same tiers that fit, and what is then left of the gap is filled by cutting one more document, whose
   remainder is routed again. So every window is full.
3. What the last window of a task lacks is not padded: its pieces are cut into windows that are powers of two.
4. Balance: the windows of one tier are dealt to step groups of about ``step_tokens`` tokens in snake order of their
   attention cost (the sum of squared piece lengths).

Memory: a task holds ``buffer_tokens`` ids and one document more. A run of a task again gives the same rows;
sequence_id is the task's partition << 40 plus a count.

Cases: null and empty texts are the end id alone (one piece of length 1). Documents with equal ids are packed each by itself.
A null id stays null. Texts of any length are cut into as many windows as they need. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches, vocab_path
from .tokens import encoder

END_ID = 1
TIERS = (256, 512, 1024, 2048)
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Pool:
    """Pieces not yet placed, sorted by length: (length, document, start)."""

    def __init__(self, pieces=()):
        self.items = sorted(pieces)

    def __len__(self):
        return len(self.items)

    def longest(self):
        return self.items.pop()

    def fitting(self, room: int):
        """The longest piece of at most ``room``, or None."""
        i = bisect_right(self.items, (room, float("inf"), 0))
        return self.items.pop(i - 1) if i else None

    def cut(self, room: int):
        """``room`` ids off the shortest piece that is longer, or None."""
        i = bisect_right(self.items, (room, float("inf"), 0))
        if i == len(self.items):
            return None
        length, doc, start = self.items.pop(i)
        insort(self.items, (length - room, doc, start + room))
        return (room, doc, start)


def tier_of(length: int, tiers) -> int:
    return next(t for t in tiers if length <= t)


def pack(lengths, tiers=TIERS, left=(), last=True):
    """Windows as (tier, pieces), and what waits for more documents. ``lengths``: (document, ids); ``left``: pieces that waited."""
    top, windows, rest = tiers[-1], [], list(left)
    for doc, n in lengths:
        full = n // top
        windows += [(top, [(top, doc, i * top)]) for i in range(full)]
        if n % top:
            rest.append((n % top, doc, full * top))
    pool = Pool(rest)
    waiting = []
    while len(pool):
        first = pool.longest()
        tier = tier_of(first[0], tiers)
        window, room = [first], tier - first[0]
        while room and (piece := pool.fitting(room)):
            window.append(piece)
            room -= piece[0]
        if room and (piece := pool.cut(room)):
            window.append(piece)
            room = 0
        if not room:
            windows.append((tier, window))
        else:  # no piece is left that could fill it
            waiting += window
    if not last:
        return windows, waiting
    while waiting:
        size, room = 1 << (sum(p[0] for p in waiting).bit_length() - 1), 0
        size = min(size, top)
        window, room = [], size
        while room:
            length, doc, start = waiting.pop(0)
            take = min(length, room)
            window.append((take, doc, start))
            if take < length:
                waiting.insert(0, (length - take, doc, start + take))
            room -= take
        windows.append((size, window))
    return windows, []


def step_groups(windows, step_tokens: int) -> list[int]:
    """A group for each window: within a tier, dealt in snake order of attention cost."""
    out, base = [0] * len(windows), 0
    for tier in sorted({t for t, _ in windows}):
        own = sorted((-sum(p[0] ** 2 for p in ps), i) for i, (t, ps) in enumerate(windows) if t == tier)
        n = max(1, -(-len(own) * tier // step_tokens))
        for rank, (_, i) in enumerate(own):
            lap, at = divmod(rank, n)
            out[i] = base + (at if lap % 2 == 0 else n - 1 - at)
        base += n
    return out


def _rows(path: str, tiers, buffer_tokens: int, step_tokens: int, added: bool):
    def rows(batches):
        ctx = TaskContext.get()
        base = (ctx.partitionId() if ctx else 0) << 40
        ids, names, left, fresh = {}, {}, [], []
        state = {"sequence": 0, "group": 0, "next": 0, "tokens": 0}

        def flush(last):
            nonlocal left, fresh
            windows, left = pack(fresh, tiers, left, last)
            groups = step_groups(windows, step_tokens)
            cols = [[] for _ in range(9)]
            for (tier, pieces), group in zip(windows, groups):
                offset = 0
                for length, doc, start in pieces:
                    own = ids[doc]
                    for c, v in zip(cols, (names[doc], start, length, zlib.crc32(own[start : start + length].tobytes()), len(own), base + state["sequence"], offset, tier, base + state["group"] + group)):
                        c.append(v)
                    offset += length
                state["sequence"] += 1
            state["group"] += max(groups, default=-1) + 1
            keep = {doc for _, doc, _ in left}
            for doc in [d for d in ids if d not in keep]:
                del ids[doc], names[doc]
            fresh, state["tokens"] = [], 0
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            names_ = [f.split(" ")[0] for f in RESULT.split(", ")]
            for i in range(0, len(cols[0]), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 20_000], k) for c, k in zip(cols, kinds)], names_)

        for batch in batches:
            encode = encoder(path, added).ids
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                own = np.append(encode(text), END_ID).astype("<u4")
                doc = state["next"]
                state["next"] += 1
                ids[doc], names[doc] = own, batch.column(0)[i].as_py()
                fresh.append((doc, len(own)))
                state["tokens"] += len(own)
                if state["tokens"] >= buffer_tokens:
                    yield from flush(False)
        yield from flush(True)

    return rows


def pack_documents(documents: DataFrame, tiers=TIERS, vocabulary: str | None = None, buffer_tokens: int = 4_000_000, step_tokens: int = 65_536, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = True) -> DataFrame:
    """One row per piece; sequences of one tier's size, or of a smaller power of two at a task's end. ``added_tokens``: texts are split at the vocabulary's added tokens."""
    tiers = tuple(sorted(tiers))
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    small_batches(documents.sparkSession)
    path = vocabulary or vocab_path()
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_rows(path, tiers, buffer_tokens, step_tokens, added_tokens), RESULT)
