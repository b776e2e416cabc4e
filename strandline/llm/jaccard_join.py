"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles; two link if their Jaccard similarity is at least ``threshold`` (0.8).

1. Copies: documents with equal shingle sets are one class of copies (a 128-bit name of the set) and are never paired.
2. Candidates: MinHash bands (40 of 6 values; a pair at 0.8 shares none with probability 5e-6). A key is reduced with partial aggregation to its least and greatest class; keys with both equal are
   dropped. The others link their classes to the least one, and the components of these stars are the candidate groups. Nothing lists the pairs of a key.
   Texts of one template, far below the threshold, can chain into one large group. A group of over ``split`` (8,192) classes is therefore split again, by exact prefixes (:class:`Prefixes`): in an order of all
   shingles from rare to frequent, two sets of that similarity share one of the first n - ceil(threshold n) + 1 shingles of each (n: its size). Which order it is changes the work only, never the
   result: it comes from counts in a bounded sample of those groups (about ``order_rows`` documents, ``order_shingles`` shingles) and, for all others, from their names. Texts of one template differ in
   their rare shingles, so they fall apart however many there are, as long as less than ``threshold`` of their shingles is the template's.
3. Pruning: the classes of a group are dealt to blocks of about ``block`` classes; each pair of blocks is a task's unit. There, the pairs that share a key and whose sizes allow the similarity are
   compared by the MinHash values that came along, in steps; after each step the pairs whose posterior probability (uniform prior) of reaching the threshold is below
   ``tolerance`` are dropped.
4. Verification: the rest is verified exactly by the intersections of the sets. A unit returns the number of linked documents for each class and a spanning forest of its links, not the pairs.
5. Groups: the components of the forests, that is of verified links only.

Joins with tables of classes or keys are merge joins at every size: those tables have no size bound, so they are never broadcast.

Signatures are computed once, for the classes of candidate groups only. A group of m different texts is copied m / block times, and at most m**2 / 2 pairs are compared, spread over all tasks; copies cost nothing.

Cases: null and empty texts, and texts of blanks, have no shingles; they are copies of each other. Texts under five words have one shingle. Equal rows, also with equal ids, are
rows of their own and copies. class_id is the least id reachable by links, copy_of the least id of the documents with an equal set, null if all ids among them are
null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_written, fresh, materialise, small_batches, texts
from .components import components
from .ranks import U64, mix64
from .shingles import MinHash, shingles

VALUES, STEP = 240, 24
SIGNED = "doc_id long, k2 long, c1 long, c2 long, keys array<long>"
MEMBER = "node long, sets array<long>, keys array<long>, sign binary"
FOUND = "node long, weight long, other long"


def _sets(data, bounds):
    """Sorted distinct shingles of each text."""
    names, at = shingles(data, bounds)
    return [np.unique(names[at[d] : at[d + 1]]) for d in range(len(at) - 1)]


def _bounds(sets) -> np.ndarray:
    return np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def _lists(arrays) -> pa.ListArray:
    flat = np.concatenate(arrays).view(np.int64) if len(arrays) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(_bounds(arrays).astype(np.int32)), pa.array(flat))


def _signed(sets, n: int = VALUES) -> np.ndarray:
    return MinHash.get(n).sign(np.concatenate(sets) if sets else np.zeros(0, U64), _bounds(sets))


class Prefixes:
    """Keys of exact candidates: the rarest shingles of each set. ``common``: shingles that are frequent, ``counts``: how frequent; all others are rarer."""

    def __init__(self, common: np.ndarray, counts: np.ndarray, threshold: float):
        order = np.argsort(common)
        self.common, self.counts, self.threshold = common[order], counts[order], threshold

    def of(self, sets: list[np.ndarray]) -> list[np.ndarray]:
        if not sets or not len(self.common):
            return [s[: self.length(len(s))] for s in sets]
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(self.common, flat), len(self.common) - 1)
        count = np.where(self.common[at] == flat, self.counts[at], 0)
        out = []
        for s, lo in zip(sets, _bounds(sets)):
            n = self.length(len(s))
            own = count[lo : lo + len(s)]
            rare = np.flatnonzero(own == 0)[:n] if n else np.zeros(0, np.int64)
            if len(rare) < n:  # sets are sorted by name, which decides between equal counts
                rare = np.argsort(own, kind="stable")[:n]
            out.append(s[rare])
        return out

    def length(self, n: int) -> int:
        return n - int(np.ceil(self.threshold * n - 1e-9)) + 1 if n else 0


class Bands:
    """Keys of likely candidates: ``bands`` bands of ``rows`` values of the signature, of which the upper ``bits`` bits count."""

    def __init__(self, values: int, bands: int, rows: int, bits: int = 32):
        self.values, self.bands, self.rows, self.bits = values, bands, rows, bits

    def of(self, sets: list[np.ndarray], sign: np.ndarray | None = None) -> list[np.ndarray]:
        """The keys of each set; ``sign``: their signatures of ``values`` values, if they are known."""
        sign = (_signed(sets, self.values) if sign is None else sign) >> np.uint32(32 - self.bits)
        out = np.zeros((len(sign), self.bands), U64)
        parts = sign[:, : self.bands * self.rows].reshape(len(sign), self.bands, self.rows).astype(U64)
        for r in range(self.rows):
            out = mix64(out + parts[:, :, r] + U64(r + 1))
        out = mix64(out ^ np.arange(self.bands, dtype=U64))
        return [row if len(s) else row[:0] for row, s in zip(out, sets)]


#: The bands of the join's own signatures.
BANDS = Bands(VALUES, 40, 6)


def _packed_rows(batches):
    """Texts as zstd, so that the shuffle that looks for the members' texts writes less."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data, bounds = texts(batch.column(2))
        packed = [press.compress(data[s:e].tobytes()) for s, e in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc_id", "k2", "z"])


def _unpacked(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of packed texts."""
    press = zstandard.ZstdDecompressor()
    raw = [press.decompress(z.as_buffer()) for z in col]
    return np.frombuffer(b"".join(raw), np.uint8), _bounds(raw)


def _signed_rows(keys):
    def rows(batches):
        for batch in batches:
            sets = _sets(*texts(batch.column(2)))
            name = lambda seed: pa.array(np.array([int(mix64(s ^ U64(seed)).sum(dtype=U64)) for s in sets], U64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), name(0), name(0x5851F42D4C957F2D), _lists(keys.of(sets))], ["doc_id", "k2", "c1", "c2", "keys"])

    return rows


def _member_rows(keys):
    def rows(batches):
        for batch in batches:
            sets = _sets(*_unpacked(batch.column(1)))
            sign = _signed(sets)
            shared = keys.of(sets, sign if keys.values == VALUES else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets), _lists(shared), pa.array([x.tobytes() for x in sign], pa.binary())], ["node", "sets", "keys", "sign"])

    return rows


def _shingle_rows(batches):
    for batch in batches:
        sets = _sets(*_unpacked(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))], ["s"])


def shingle_order(texts_: DataFrame, threshold: float, rows: int = 20_000, most: int = 500_000) -> Prefixes:
    """An order of all shingles, from the counts of the ``most`` most frequent ones among about ``rows`` of the packed texts (columns id, z), by hash."""
    count = texts_.count()
    part = F.pmod(F.xxhash64(F.lit(31), "id"), F.lit(1 << 40)) / float(1 << 40)
    sample = texts_.filter(part < rows / max(count, 1)).select("z")
    counts = sample.mapInArrow(_shingle_rows, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = counts.orderBy(F.desc("n"), "s").limit(most).toArrow()
    return Prefixes(found.column("s").to_numpy().astype(np.int64).view(U64), found.column("n").to_numpy().astype(np.int64), threshold)


def _prefix_rows(order: Prefixes):
    def rows(batches):
        for batch in batches:
            keys = order.of(_sets(*_unpacked(batch.column(2))))
            size = np.array([len(k) for k in keys], np.int64)
            at = np.repeat(np.arange(len(keys)), size)
            group = batch.column(1).to_numpy().astype(np.int64)[at].view(U64)  # groups are split apart
            flat = mix64((np.concatenate(keys) if len(keys) else np.zeros(0, U64)) ^ mix64(group))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(flat.view(np.int64))], ["c1", "key"])

    return rows


def star_groups(keyed: DataFrame) -> DataFrame:
    """(id, component): the groups of classes that share keys, from (c1, key)."""
    shared = keyed.groupBy("key").agg(F.min("c1").alias("a"), F.max("c1").alias("b")).filter("a <> b").select(fresh("key").alias("key"), "a")
    return materialise(components(keyed.join(shared.hint("merge"), "key").filter("c1 <> a").select(F.col("c1").alias("u"), F.col("a").alias("v"))))


@lru_cache(maxsize=8)
def least_matches(total: int, step: int, threshold: float, tolerance: float) -> tuple[int, ...]:
    """After each step: the fewest matches with which P(J >= threshold | matches), uniform prior, is at least ``tolerance``."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    high = grid >= threshold
    out = []
    for n in range(step, total + 1, step):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log - log.max())
            if p[high].sum() / p.sum() >= tolerance:
                break
        out.append(m)
    return tuple(out)


def intersections(a: list[np.ndarray], b: list[np.ndarray], piece: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by blocks of an incidence matrix."""
    both = a + b
    values, inverse = np.unique(np.concatenate(both), return_inverse=True)
    shared = np.bincount(inverse) > 1
    column = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    keep = shared[inverse]
    row, column = row[keep], column[inverse[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(a), len(b)), np.float64)
    for lo in range(0, int(shared.sum()), piece):
        s, e = np.searchsorted(column, [lo, lo + piece])
        x = np.zeros((len(both), piece), np.float32)
        x[row[s:e], column[s:e] - lo] = 1
        out += x[: len(a)] @ x[len(a) :].T
    return np.rint(out).astype(np.int64)


def candidates(a: list[np.ndarray], b: list[np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the pairs of two lists of keys that share a key; with ``same``, i < j within one list. All pairs where those are fewer than the shared keys."""
    n, m = len(a), len(b)
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    row_a, row_b = np.repeat(np.arange(n), [len(k) for k in a]), np.repeat(np.arange(m), [len(k) for k in b])
    order = np.argsort(flat_b, kind="stable")
    flat_b, row_b = flat_b[order], row_b[order]
    first, last = np.searchsorted(flat_b, flat_a, "left"), np.searchsorted(flat_b, flat_a, "right")
    count = last - first
    if count.sum() > n * m:
        return np.triu_indices(n, 1) if same else tuple(x.ravel() for x in np.indices((n, m)))
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    code = np.unique(np.repeat(row_a, count) * m + row_b[at])
    i, j = code // m, code % m
    return (i[i < j], j[i < j]) if same else (i, j)


def links(a: dict, b: dict, same: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the linked pairs of two lists of classes (sets, keys, sign); with ``same``, i < j within one list."""
    i, j = candidates(a["keys"], b["keys"], same)
    size_a, size_b = np.array([len(s) for s in a["sets"]]), np.array([len(s) for s in b["sets"]])
    fit = np.minimum(size_a[i], size_b[j]) >= threshold * np.maximum(size_a[i], size_b[j]) - 1e-9
    i, j = i[fit], j[fit]
    matches = np.zeros(len(i), np.int64)
    for k, least in enumerate(least_matches(VALUES, STEP, threshold, tolerance)):
        if not len(i):
            return i, j
        part = slice(k * STEP, (k + 1) * STEP)
        for lo in range(0, len(i), 8192):
            p = slice(lo, lo + 8192)
            matches[p] += (a["sign"][i[p], part] == b["sign"][j[p], part]).sum(axis=1)
        alive = matches >= least
        i, j, matches = i[alive], j[alive], matches[alive]
    if not len(i):
        return i, j
    if len(i) > 64:  # only the sets that are still in question
        some_a, at_a = np.unique(i, return_inverse=True)
        some_b, at_b = np.unique(j, return_inverse=True)
        common = intersections([a["sets"][x] for x in some_a], [b["sets"][x] for x in some_b])[at_a, at_b]
    else:
        common = np.array([len(np.intersect1d(a["sets"][x], b["sets"][y], assume_unique=True)) for x, y in zip(i, j)])
    linked = common >= threshold * (size_a[i] + size_b[j] - common) - 1e-9
    return i[linked], j[linked]


def _forest(i, j):
    """Those pairs that join two parts so far."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(i, j):
        if (p := find(x)) != (q := find(y)):
            root[p] = q
            yield x, y


def _unit(nodes, weights, blocks, members, threshold, tolerance):
    """(node, weight of linked documents, None) and (node, 0, other node of the forest) of one pair of blocks."""
    order = np.argsort(blocks, kind="stable")
    nodes, weights = nodes[order], weights[order]
    cut = int(np.searchsorted(blocks[order], blocks.max())) if blocks.min() != blocks.max() else 0
    same = cut == 0

    def side(part):
        return {"sets": [members[k][0] for k in part], "keys": [members[k][1] for k in part], "sign": np.stack([members[k][2] for k in part])}

    a, b = (side(order),) * 2 if same else (side(order[:cut]), side(order[cut:]))
    i, j = links(a, b, same, threshold, tolerance)
    na, nb = (nodes, nodes) if same else (nodes[:cut], nodes[cut:])
    wa, wb = (weights, weights) if same else (weights[:cut], weights[cut:])
    total = np.zeros(len(nodes), np.int64)
    np.add.at(total, i, wb[j])
    np.add.at(total, j + (0 if same else cut), wa[i])
    for k in np.flatnonzero(total):
        yield nodes[k], total[k], None
    for u, v in _forest(na[i].tolist(), nb[j].tolist()):
        yield u, 0, v


def _unit_rows(threshold: float, tolerance: float):
    def out(rows):
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["node", "weight", "other"])

    def rows(batches):
        key, nodes, weights, blocks, members, held = None, [], [], [], [], []
        alike = True

        def close():
            # a lone pair of different blocks may hold one block only
            if len(nodes) > 1 and (alike or len(set(blocks)) > 1):
                held.extend(_unit(np.array(nodes), np.array(weights), np.array(blocks), members, threshold, tolerance))

        for batch in batches:
            comp, x, y, node, weight, block = (batch.column(k).to_pylist() for k in range(6))
            for r in range(batch.num_rows):
                now = (comp[r], x[r], y[r])
                if now != key:
                    close()
                    key, alike, nodes, weights, blocks, members = now, x[r] == y[r], [], [], [], []
                    if len(held) > 20_000:
                        yield out(held)
                        held = []
                if nodes and nodes[-1] == node[r]:
                    continue  # an equal row
                nodes.append(node[r])
                weights.append(weight[r])
                blocks.append(block[r])
                sets, keys = (batch.column(k)[r].values.to_numpy(zero_copy_only=False).view(U64) for k in (6, 7))
                members.append((sets, keys, np.frombuffer(batch.column(8)[r].as_py(), np.uint32)))
        close()
        yield out(held)

    return rows


class Joined:
    """The signed rows (doc_id, k2, c1, c2), the classes with candidates (``members``), and their links and groups. ``keys``: what candidates share."""

    def __init__(self, documents: DataFrame, keys: Bands, threshold: float, tolerance: float, block: int, id_col: str, text_col: str, order_rows: int = 20_000, order_shingles: int = 500_000, split: int = 8192):
        small_batches(documents.sparkSession)
        docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k2"), F.col(text_col).alias("text"))
        self.rows = materialise(docs.mapInArrow(_signed_rows(keys), SIGNED))
        packed = docs.mapInArrow(_packed_rows, "doc_id long, k2 long, z binary")
        self.classes = self.rows.groupBy("c1", "c2").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "k2")).alias("one"))
        # a key that two classes share by half of their name only makes a group larger
        near = star_groups(self.rows.select("c1", F.explode("keys").alias("key")))
        large = materialise(near.join(near.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > split).select("component").hint("merge"), "component").select("id", "component"))
        if large.take(1):
            one = large.join(self.classes.select("c1", "one"), F.col("c1") == F.col("id")).select("id", "component", F.col("one.doc_id").alias("e1"), F.col("one.k2").alias("e2"))
            held = materialise(packed.join(one.hint("merge"), F.col("doc_id").eqNullSafe(F.col("e1")) & (F.col("k2") == F.col("e2"))).select("id", "component", "z"))
            order = shingle_order(held, threshold, order_rows, order_shingles)
            split = star_groups(held.mapInArrow(_prefix_rows(order), "c1 long, key long"))
            near = near.join(large.select("component").distinct().hint("merge"), "component", "left_anti").select("id", "component").unionAll(split.select("id", "component"))
        parts = near.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
        members = near.join(parts, "component").join(self.classes, F.col("c1") == F.col("id"))
        # nodes have numbers of their own, so that no two classes share one; they are written once
        members = members.select(F.monotonically_increasing_id().alias("id"), "c1", "c2", "component", "n", "parts", F.col("one.doc_id").alias("e1"), F.col("one.k2").alias("e2"))
        self.members = materialise(members.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "c1", "c2"), "parts").cast("int")))
        chosen = packed.join(self.members.select("id", "e1", "e2").hint("merge"), F.col("doc_id").eqNullSafe(F.col("e1")) & (F.col("k2") == F.col("e2")))
        held = materialise(chosen.select(F.col("id").alias("node"), "z").mapInArrow(_member_rows(keys), MEMBER))
        units = held.join(self.members.hint("merge"), F.col("node") == F.col("id")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        units = units.select("component", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "node", "n", "block", "sets", "keys", "sign")
        units = units.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y", "node")
        found = materialise(units.mapInArrow(_unit_rows(threshold, tolerance), FOUND))
        drop_written(held)
        self._made = [self.rows, self.members, found]
        self.links = found.groupBy("node").agg(F.sum("weight").alias("linked"))
        self.groups = components(found.filter("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v"))).select(F.col("id").alias("member"), F.col("component").alias("g"))

    def drop(self) -> None:
        """Remove what was written, once the result is."""
        for df in self._made:
            drop_written(df)

    def result(self) -> DataFrame:
        """doc_id, k2, class_id, n_links, group_id."""
        linked = self.members.select("id", F.col("c1").alias("m1"), F.col("c2").alias("m2")).join(self.links, F.col("id") == F.col("node")).join(self.groups, F.col("id") == F.col("member"), "left").select("m1", "m2", "linked", "g")
        by_class = self.classes.join(linked, (F.col("c1") == F.col("m1")) & (F.col("c2") == F.col("m2")), "left")
        by_class = materialise(by_class.select("c1", "c2", "class_id", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "g"))
        self._made.append(by_class)
        heads = by_class.filter("g is not null").groupBy("g").agg(F.min("class_id").alias("head")).select(F.col("g").alias("g2"), "head")
        by_class = by_class.join(heads, F.col("g") == F.col("g2"), "left").select(F.col("c1").alias("d1"), F.col("c2").alias("d2"), "class_id", "n_links", F.when(F.col("g").isNotNull(), F.col("head")).otherwise(F.col("class_id")).alias("group_id"))
        return self.rows.join(by_class.hint("merge"), (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2"))).select("doc_id", "k2", "class_id", "n_links", "group_id")


def jaccard_join(documents: DataFrame, threshold: float = 0.8, tolerance: float = 1e-9, block: int = 512, order_rows: int = 20_000, order_shingles: int = 500_000, split: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (its near-duplicate group), n_links (other documents linked, copies included), copy_of (documents with an equal
    shingle set), kept (one id per group)."""
    rows = Joined(documents, BANDS, threshold, tolerance, block, id_col, text_col, order_rows, order_shingles, split).result()
    return rows.select("doc_id", F.col("group_id").alias("class_id"), "n_links", F.col("class_id").alias("copy_of"), F.col("doc_id").eqNullSafe(F.col("group_id")).alias("kept"))


def near_dedup(documents: DataFrame, threshold: float = 0.8, tolerance: float = 1e-9, block: int = 512, order_rows: int = 20_000, order_shingles: int = 500_000, split: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with one row of each group: that of the least id. Documents without words stay, once per group as well."""
    rows = Joined(documents, BANDS, threshold, tolerance, block, id_col, text_col, order_rows, order_shingles, split).result()
    keep = rows.filter(F.col("doc_id").eqNullSafe(F.col("group_id"))).groupBy("group_id").agg(F.min(F.struct("doc_id", "k2")).alias("one"), F.count(F.lit(1)).alias("_n"))
    # groups of null ids alone share the null group: each text of theirs stays once
    nulls = rows.filter("group_id is null").select(F.col("doc_id").alias("_e1"), F.col("k2").alias("_e2"), F.lit(2).cast("long").alias("_n")).distinct()
    keep = materialise(keep.filter("group_id is not null").select(F.col("one.doc_id").alias("_e1"), F.col("one.k2").alias("_e2"), "_n").unionAll(nulls)).hint("merge")
    # whole rows travel as one struct, so that no column of theirs can clash with ours
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = documents.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), text.alias("_k2"))
    joined = rows.join(keep, F.col("_id").eqNullSafe(F.col("_e1")) & (F.col("_k2") == F.col("_e2")))
    once = joined.filter("_n = 1").select("_row.*")
    more = joined.filter("_n > 1").dropDuplicates(["_id", "_k2"]).select("_row.*")
    return once.unionAll(more)
