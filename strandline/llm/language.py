"""Language identification by a convolutional network over bytes, trained and applied in numpy.

Windows of ``WINDOW`` (256) bytes go through a byte embedding, filters of widths 2, 3 and 4, a rectifier, a maximum over positions and a
softmax. For prediction the embedding is folded into tables by byte and by pair of bytes, so a filter is a sum of looked-up rows.
Every window of a text is scored (the last is filled with zeros), and the text's probabilities are the mean over its windows by bytes.

Training takes at most ``per_language`` (1000) documents of each language, those of least hash, one seeded window each, of the ``most_languages`` (256) most
frequent languages, and ``sample_rows`` (24,000) in all; everything else runs over all rows.

Cases: null texts and those without a letter are ``und`` with score 0, and so is every text where nothing could be learned. Null
languages aren't learned. A null id may be learned from. Equal rows get equal predictions. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import crc_mod, small_batches, texts

WINDOW, EMBED, FILTERS, WIDTHS = 256, 8, 16, (2, 3, 4)
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


def windows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed windows (k, WINDOW) of all texts, the text of each, and the bytes in it."""
    sizes = np.diff(bounds)
    n = -(-sizes // WINDOW)
    first = np.cumsum(n) - n
    out = np.zeros(int(n.sum()) * WINDOW, np.uint8)
    out[np.arange(len(data)) + np.repeat(first * WINDOW - bounds[:-1], sizes)] = data
    owner = np.repeat(np.arange(len(sizes)), n)
    held = np.minimum(sizes[owner] - (np.arange(len(owner)) - first[owner]) * WINDOW, WINDOW)
    return out.reshape(-1, WINDOW), owner, held


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class ByteConv:
    """The network; parameters are plain arrays."""

    def __init__(self, languages: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        k = len(languages)
        self.languages, self.rng = languages, rng
        self.p = {"E": rng.normal(0, 0.5, (256, EMBED)), "W": rng.normal(0, 0.05, (FILTERS * len(WIDTHS), k)), "c": np.zeros(k)}
        for w in WIDTHS:
            self.p[f"K{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {n: v.astype(np.float32) for n, v in self.p.items()}

    def _step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy of a batch of windows."""
        p, n = self.p, len(x)
        e = p["E"][x]
        parts, kept = [], []
        for w in WIDTHS:
            patches = np.concatenate([e[:, k : WINDOW - w + 1 + k] for k in range(w)], axis=2)
            z = patches @ p[f"K{w}"] + p[f"b{w}"]
            at = z.argmax(axis=1)
            top = np.take_along_axis(z, at[:, None, :], 1)[:, 0]
            kept.append((at, top > 0))
            parts.append(np.maximum(top, 0))
        h = np.concatenate(parts, axis=1)
        q = _softmax(h @ p["W"] + p["c"])
        q[np.arange(n), y] -= 1
        q /= n
        grad = {"W": h.T @ q, "c": q.sum(axis=0), "E": np.zeros_like(p["E"])}
        back = q @ p["W"].T
        for i, w in enumerate(WIDTHS):
            at, on = kept[i]
            d = back[:, i * FILTERS : (i + 1) * FILTERS] * on  # (n, F)
            codes = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(w)]  # (n, F, w): only the positions of the maxima
            seen = p["E"][codes].reshape(n, FILTERS, w * EMBED)
            grad[f"K{w}"] = np.einsum("nfd,nf->df", seen, d)
            grad[f"b{w}"] = d.sum(axis=0)
            down = (d[:, :, None] * p[f"K{w}"].T[None]).reshape(n, FILTERS, w, EMBED)
            np.add.at(grad["E"], codes.ravel(), down.reshape(-1, EMBED))
        return grad

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 48, rate: float = 0.01) -> ByteConv:
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            pick = self.rng.integers(0, len(x), batch)
            for k, g in self._step(x[pick], y[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                self.p[k] -= (rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self

    def tables(self) -> dict:
        """The filters as sums of looked-up rows: by pair of bytes, and by byte where a width is odd."""
        out = {}
        for w in WIDTHS:
            single = [self.p["E"] @ self.p[f"K{w}"][k * EMBED : (k + 1) * EMBED] for k in range(w)]
            single[0] = single[0] + self.p[f"b{w}"]
            for k in range(0, w - 1, 2):
                out[w, k] = (single[k][:, None, :] + single[k + 1][None, :, :]).reshape(65536, FILTERS).astype(np.float32)
            if w % 2:
                out[w, w - 1] = single[-1].astype(np.float32)
        return out

    def predict(self, x: np.ndarray, tables: dict, piece: int = 128) -> np.ndarray:
        """Probabilities of windows."""
        out = np.zeros((len(x), len(self.languages)))
        for s in range(0, len(x), piece):
            b = x[s : s + piece]
            pair = (b[:, :-1].astype(np.int32) << 8) | b[:, 1:]
            parts = []
            for w in WIDTHS:
                n, z = WINDOW - w + 1, None
                for k in range(0, w - 1, 2):
                    rows = tables[w, k][pair[:, k : k + n]]
                    z = rows if z is None else np.add(z, rows, out=z)
                if w % 2:
                    z += tables[w, w - 1][b[:, w - 1 : w - 1 + n]]
                parts.append(np.maximum(z.max(axis=1), 0))
            out[s : s + piece] = _softmax(np.concatenate(parts, axis=1) @ self.p["W"] + self.p["c"])
        return out


def learn(documents: DataFrame, learnable: Column, per_language: int = 1000, sample_rows: int = 24_000, most_languages: int = 256, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> ByteConv | None:
    """A network from a bounded sample of documents with a language; None if there is none."""
    language, number = F.col(lang_col).cast("string"), F.xxhash64(F.lit(21), id_col)
    at = F.pmod(F.xxhash64(F.lit(22), id_col), F.greatest(F.length(text_col) - WINDOW, F.lit(1))).cast("int") + 1
    # own names only, so that no column of the documents can clash with them
    rows = documents.filter(F.col(lang_col).isNotNull() & F.coalesce(learnable, F.lit(True))).select(language.alias("l"), F.pmod(number, F.lit(1 << 40)).alias("h"), F.substring(F.col(text_col), at, F.lit(WINDOW)).alias("t"))
    rows = rows.filter("length(t) > 0")
    # a count per language bounds the hashes to look at, so that ranking them stays small however many rows and tasks there are
    counts = rows.groupBy(F.col("l").alias("l2")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l2").limit(most_languages)
    few = rows.join(F.broadcast(counts), F.col("l") == F.col("l2")).filter((F.col("h") / float(1 << 40) < 4.0 * per_language / F.col("n")) | (F.col("n") <= 8 * per_language))
    # equal ids share a hash: ties go by the text, so that the sample is the same however rows lie
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).filter(F.col("r") <= per_language)
    found = ranked.orderBy("r", "h", "l", "t").limit(sample_rows).select("l", "t").toArrow()
    if not found.num_rows:
        return None
    pairs = sorted(zip(found.column("l").to_pylist(), found.column("t").to_pylist()))  # the same network however Spark returns the rows
    languages = sorted({lang for lang, _ in pairs})
    raw = [t.encode()[:WINDOW].ljust(WINDOW, b"\0") for _, t in pairs]
    x = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, WINDOW)
    y = np.array([languages.index(lang) for lang, _ in pairs])
    return ByteConv(languages).fit(x, y)


def _has_letter(text: np.ndarray) -> bool:
    if ASCII_LETTER[text].any():
        return True
    return bool((text >= 128).any()) and any(c.isalpha() for c in text.tobytes().decode("utf-8"))


def _rows(net: ByteConv | None):
    def rows(batches):
        tables = net.tables() if net else None
        for batch in batches:
            data, bounds = texts(batch.column(2))
            pred, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if net:
                x, owner, held = windows(data, bounds)
                sums = np.zeros((batch.num_rows, len(net.languages)))
                np.add.at(sums, owner, net.predict(x, tables) * held[:, None])
                sums /= np.maximum(sums.sum(axis=1, keepdims=True), 1e-12)
                for d in range(batch.num_rows):
                    if bounds[d + 1] > bounds[d] and _has_letter(data[bounds[d] : bounds[d + 1]]):
                        best = int(sums[d].argmax())
                        pred[d], score[d] = net.languages[best], min(1.0, float(sums[d, best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows


def identify_languages(documents: DataFrame, net: ByteConv | None, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_rows(net), RESULT)


def held_out_fifth(id_col: str = "doc_id") -> Column:
    """Ids that are kept from learning: crc32 of the id's text mod 5 is 0."""
    return crc_mod(id_col, 5) == 0
