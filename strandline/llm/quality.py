"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text go into bins; the score is the logistic of a sum of lookup tables, one per feature and one per chosen pair of features.
Tables are learned by cyclic boosting: feature after feature, a shallow tree of at most three leaves over the bins is fitted to the
gradient and added with a small rate. Then the pairs whose quadrant tree lowers the loss most get tables of their own, boosted likewise with trees
of depth two. Scoring is one vectorised addition of bins per table.

Learning takes at most ``sample_rows`` labelled rows (20,000; those of least hash, spread over the corpus), whose ids are broadcast; everything else runs over all rows.

Cases: null counts as empty. Empty texts get a score like any other (all features 0). With no labelled row the score is 0.5; with labels of one
kind it is that kind's smoothed share. Labels that are null, or whose row has no document, are not used. A null id is neither learned from nor held out. Equal rows get equal
scores. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import crc_mod, hashed_sample, small_batches, texts

FEATURES = ("log_chars", "log_words", "word_length", "distinct_words", "repeated_words", "upper", "symbols", "marks", "digits", "pipes", "line_words", "distinct_lines", "ends")
RESULT = "doc_id long, held_out boolean, score double, predicted int"


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[ord(c) for c in chars]] = 1
    return out


LETTER = np.zeros(256, np.uint8)
LETTER[65:91] = LETTER[97:123] = LETTER[194:245] = 1
UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
SYMBOL = _table("#$%&*+/<=>@\\^_`{}~[]")
MARK = _table("!?")
DIGIT = _table("0123456789")
PIPE = _table("|")
END = _table(".")
LEAD = np.ones(256, np.uint8)
LEAD[128:192] = 0


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, features) of UTF-8 texts that lie side by side."""
    n = len(bounds) - 1

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (sums[bounds[1:]] - sums[bounds[:-1]]).astype(np.float64)

    high = np.zeros(len(data), bool)
    if len(data):
        high[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    chars, letters = count(LEAD[data]), count(LETTER[data])
    upper = count((UPPER[data] > 0) | high)
    words, distinct, again, lines, distinct_lines = (np.zeros(n) for _ in range(5))
    raw = data.tobytes()
    for d in range(n):
        text = raw[bounds[d] : bounds[d + 1]]
        w, rows = text.split(), text.split(b"\n")
        words[d], distinct[d], again[d] = len(w), len(set(w)), sum(map(eq, w, w[1:]))
        lines[d], distinct_lines[d] = len(rows), len(set(rows))
    share = lambda x, y: x / np.maximum(y, 1)
    return np.stack(
        [
            np.log1p(chars), np.log1p(words), share(letters, words), share(distinct, words), share(again, words), share(upper, letters), share(count(SYMBOL[data]), words),
            share(count(MARK[data]), words), share(count(DIGIT[data]), chars), share(count(PIPE[data]), words), np.log1p(share(words, lines)), share(distinct_lines, lines), share(count(END[data]), words),
        ],
        axis=1,
    )


def _gain(g, h, l2):
    return g * g / (h + l2)


def _leaves(g: np.ndarray, h: np.ndarray, leaves: int, l2: float, least: float) -> np.ndarray:
    """Values per bin of a tree with at most ``leaves`` leaves over ordered bins (greedy best splits)."""
    parts = [(0, len(g))]
    G, H = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for p, (s, e) in enumerate(parts):
            cut = np.arange(s + 1, e)
            if not len(cut):
                continue
            left, hl = G[cut] - G[s], H[cut] - H[s]
            right, hr = G[e] - G[cut], H[e] - H[cut]
            gain = np.where((hl >= least) & (hr >= least), _gain(left, hl, l2) + _gain(right, hr, l2) - _gain(G[e] - G[s], H[e] - H[s], l2), 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], p, int(cut[k]))
        if best[1] is None:
            break
        s, e = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(s, best[2]), (best[2], e)]
    out = np.zeros(len(g))
    for s, e in parts:
        out[s:e] = (G[e] - G[s]) / (H[e] - H[s] + l2)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[float, np.ndarray]:
    """The best tree of depth two over a grid: one cut of the first axis, then one cut of the second on each side."""
    best, table = 0.0, np.zeros_like(g)
    whole = _gain(g.sum(), h.sum(), l2)
    for cut in range(1, len(g)):
        total, value = -whole, np.zeros_like(g)
        for side in (slice(0, cut), slice(cut, len(g))):
            gs, hs = g[side].sum(axis=0), h[side].sum(axis=0)
            leaf = _leaves(gs, hs, 2, l2, least)
            value[side] = leaf
            edges = np.flatnonzero(np.diff(leaf)) + 1
            total += sum(_gain(a.sum(), b.sum(), l2) for a, b in zip(np.split(gs, edges), np.split(hs, edges)))
        if total > best:
            best, table = total, value
    return best, table


class AdditiveModel:
    """Lookup tables per feature and per pair of features; plain arrays, a few KB."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, pairs: int = 6, rounds: int = 80, pair_rounds: int = 30, rate: float = 0.2, l2: float = 1.0):
        self.bins, self.pair_bins, self.n_pairs, self.rounds, self.pair_rounds, self.rate, self.l2 = bins, pair_bins, pairs, rounds, pair_rounds, rate, l2
        self.base, self.edges, self.tables, self.coarse, self.pairs, self.pair_tables = 0.0, [], [], [], [], []

    @staticmethod
    def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.arange(1, bins) / bins))

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        if not len(y):
            return self
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(p / (1 - p)))
        if y.min() == y.max():
            return self
        self.edges = [self._cuts(c, self.bins) for c in x.T]
        self.coarse = [self._cuts(c, self.pair_bins) for c in x.T]
        binned = [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)]
        rough = [np.searchsorted(e, c, "right") for e, c in zip(self.coarse, x.T)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        score = np.full(len(y), self.base)

        def slopes():
            q = 1 / (1 + np.exp(-score))
            return y - q, q * (1 - q)

        for _ in range(self.rounds):
            for k, b in enumerate(binned):
                if len(self.edges[k]) == 0:
                    continue
                g, h = slopes()
                step = self.rate * _leaves(np.bincount(b, g, len(self.tables[k])), np.bincount(b, h, len(self.tables[k])), 3, self.l2, 1e-3)
                self.tables[k] += step
                score += step[b]
        g, h = slopes()
        grid = lambda i, j, v: np.bincount(rough[i] * (len(self.coarse[j]) + 1) + rough[j], v, (len(self.coarse[i]) + 1) * (len(self.coarse[j]) + 1)).reshape(len(self.coarse[i]) + 1, -1)
        ranked = sorted(((-_quadrants(grid(i, j, g), grid(i, j, h), self.l2, 1e-3)[0], i, j) for i in range(len(rough)) for j in range(i + 1, len(rough))))
        self.pairs = [(i, j) for gain, i, j in ranked[: self.n_pairs] if gain < 0]
        self.pair_tables = [np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)) for i, j in self.pairs]
        for _ in range(self.pair_rounds):
            for t, (i, j) in zip(self.pair_tables, self.pairs):
                g, h = slopes()
                step = self.rate * _quadrants(grid(i, j, g), grid(i, j, h), self.l2, 1e-3)[1]
                t += step
                score += step[rough[i], rough[j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for e, t, c in zip(self.edges, self.tables, x.T):
            out += t[np.searchsorted(e, c, "right")]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            out += t[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-out))


def _feature_rows(batches):
    for batch in batches:
        x = features(*texts(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c) for c in x.T)], ["label", "h", *FEATURES])


def learn(documents: DataFrame, labels: DataFrame, learnable: Column | None = None, sample_rows: int = 20_000, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """A model of ``label_col`` from at most ``sample_rows`` labelled documents; ``learnable`` says which ids may be learned from."""
    small_batches(documents.sparkSession)
    usable = labels if learnable is None else labels.filter(learnable)
    # own names only, so that no column of the documents can clash with them
    usable = usable.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).filter("i is not null and y in (0, 1)").distinct()
    sample = hashed_sample(usable, sample_rows, F.xxhash64("i"), "i", "y")
    texts_ = documents.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("text"))
    # ids that repeat give several rows: those of least hash of id, label and text count, as many as the sample has
    rows = texts_.join(F.broadcast(sample), F.col("d") == F.col("i")).select(F.col("y").cast("double").alias("label"), "text", F.xxhash64("i", "y", "text").alias("h"))
    found = rows.mapInArrow(_feature_rows, "label double, h long, " + ", ".join(f"{f} double" for f in FEATURES)).orderBy("h", *FEATURES).limit(2 * sample_rows).toArrow()
    y, x = found.column("label").to_numpy(), np.stack([found.column(f).to_numpy() for f in FEATURES], axis=1)
    order = np.lexsort((*x.T, y))  # the same model however Spark returns the rows
    return AdditiveModel().fit(x[order], y[order])


def _score_rows(model: AdditiveModel):
    def rows(batches):
        for batch in batches:
            score = model.score(features(*texts(batch.column(2))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows


def quality_scores(documents: DataFrame, model: AdditiveModel, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score_rows(model), RESULT)


def good_documents(documents: DataFrame, model: AdditiveModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score at least ``threshold``; all columns stay as they are."""
    small_batches(documents.sparkSession)

    @F.pandas_udf("double")
    def score(text):
        bounds = [(t or "").encode() for t in text]
        at = np.concatenate(([0], np.cumsum([len(b) for b in bounds]))).astype(np.int64)
        import pandas as pd

        return pd.Series(model.score(features(np.frombuffer(b"".join(bounds), np.uint8), at)))

    return documents.filter(score(F.col(text_col)) >= threshold)


def held_out_third(id_col: str = "doc_id") -> Column:
    """Ids that are kept from learning: crc32 of the id's text mod 3 is 1."""
    return crc_mod(id_col, 3) == 1
