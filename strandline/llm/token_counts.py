"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole. The byte lengths of its ids give the span of every token; an interval join in
each task (binary search over sorted bounds) then counts tokens by section. Sections are an array of (name, start, end) in
code points, or the document's lines by default, each with its line feed.

A token that crosses a section's boundary is counted once, by ``rule``:
``majority`` (default): the section that holds most of its bytes, the earlier one on a tie;
``start``: the section that holds its first byte; ``end``: the one that holds its last.
Bytes outside all sections form the section ``null`` (index -1). So the counts of a document add up to its tokens.

Cases: null and empty texts give one row of index 0, with no tokens (with given sections: one row per section). Sections that overlap are clipped to what earlier
ones leave, those beyond the text to its end; empty ones count 0 tokens. Rows with equal ids are counted each by itself. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches, texts, vocab_path
from .tokens import encoder

RULES = ("majority", "start", "end")
RESULT = "doc_id long, section int, name string, start_char long, end_char long, n_tokens long, n_crossing long, doc_tokens long"


def line_bounds(data: np.ndarray) -> np.ndarray:
    """Byte bounds of the lines, each with its line feed."""
    cuts = np.flatnonzero(data == 10) + 1
    if not len(cuts) or cuts[-1] != len(data):
        cuts = np.append(cuts, len(data))
    return np.concatenate(([0], cuts))


def attribute(size: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens counted by piece, and those of them that cross a bound. ``size``: bytes per token; ``bounds``: byte bounds from 0 to the end."""
    end = np.cumsum(size)
    start = end - size
    n = len(bounds) - 1
    first = np.minimum(np.searchsorted(bounds, start, "right") - 1, n - 1)
    last = np.maximum(np.searchsorted(bounds, end, "left") - 1, first)
    to = last.copy() if rule == "end" else first.copy()
    cross = np.flatnonzero(last > first)
    if rule == "majority":
        for i in cross.tolist():  # few tokens cross
            k = np.arange(first[i], last[i] + 1)
            held = np.minimum(bounds[k + 1], end[i]) - np.maximum(bounds[k], start[i])
            to[i] = k[int(np.argmax(held))]
    return np.bincount(to, minlength=n), np.bincount(to[cross], minlength=n)


def _pieces(given, n_chars: int):
    """Disjoint char pieces that cover 0..n_chars: bounds, and the given section of each piece (-1: none)."""
    bounds, owner, at = [0], [], 0
    for i, s in sorted(enumerate(given), key=lambda x: (x[1]["start"] or 0, x[0])):
        lo, hi = max(at, min(s["start"] or 0, n_chars)), min(s["end"] if s["end"] is not None else n_chars, n_chars)
        if hi <= lo:
            continue
        if lo > at:
            bounds.append(lo)
            owner.append(-1)
        bounds.append(hi)
        owner.append(i)
        at = hi
    if at < n_chars:
        bounds.append(n_chars)
        owner.append(-1)
    return np.array(bounds), np.array(owner, np.int64)


def _rows(path: str, rule: str, sections: bool, added: bool):
    names = [f.split(" ")[0] for f in RESULT.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def rows(batches):
        for batch in batches:
            code = encoder(path, added)
            data, bounds = texts(batch.column(1))
            given_all = batch.column(2).to_pylist() if sections else None
            cols, held = [[] for _ in names], 0

            def out():
                arrays = [pa.array(np.concatenate(c)) if k != 2 else pa.array([x for part in c for x in part], pa.string()) for k, c in enumerate(cols[1:], 1)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(cols[0]))), *(a.cast(k) for a, k in zip(arrays, kinds[1:]))], names)

            for d in range(batch.num_rows):
                own = data[bounds[d] : bounds[d + 1]]
                ids = code.ids(own.tobytes().decode("utf-8")).astype(np.int64)
                char = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))  # code points before each byte
                if sections:
                    given = given_all[d] or []
                    edge, owner = _pieces(given, int(char[-1]))
                    pieces = np.append(np.flatnonzero((own & 0xC0) != 0x80), len(own))[edge]
                    count, cross = attribute(code.size[ids], pieces, rule) if len(owner) else (np.zeros(0, int), np.zeros(0, int))
                    index = np.concatenate((np.arange(len(given)), [-1] if (owner == -1).any() else [])).astype(np.int64)
                    slot = np.where(owner < 0, len(given), owner)
                    n_tok, n_cross = np.bincount(slot, count, len(index)).astype(np.int64), np.bincount(slot, cross, len(index)).astype(np.int64)
                    label = [g["name"] for g in given] + [None] * (len(index) - len(given))
                    start = np.array([g["start"] if g["start"] is not None else 0 for g in given] + [-1] * (len(index) - len(given)), np.int64)
                    stop = np.array([g["end"] if g["end"] is not None else char[-1] for g in given] + [-1] * (len(index) - len(given)), np.int64)
                else:
                    pieces = line_bounds(own)
                    n_tok, n_cross = attribute(code.size[ids], pieces, rule)
                    index = np.arange(len(n_tok))
                    label = ["line"] * len(index)
                    start, stop = char[pieces[:-1]], char[pieces[1:]]
                m = len(index)
                for c, v in zip(cols, (np.full(m, d), index, label, start, stop, n_tok, n_cross, np.full(m, len(ids)))):
                    c.append(v)
                held += m
                if held >= 50_000:
                    yield out()
                    cols, held = [[] for _ in names], 0
            if held:
                yield out()

    return rows


def token_counts(documents: DataFrame, sections_col: str | None = None, rule: str = "majority", vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = True) -> DataFrame:
    """One row per document and section: its bounds in code points, tokens, tokens that cross a bound, and the document's tokens. ``added_tokens``: as in ``packing``."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(documents.sparkSession)
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    if sections_col:
        cols.append(F.col(sections_col).alias("sections"))
    return documents.select(*cols).mapInArrow(_rows(vocabulary or vocab_path(), rule, bool(sections_col), added_tokens), RESULT)
