"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors link if their labels are equal and their cosine, in double precision, is at least ``threshold`` (0.93).

1. Classes: equal vectors of a label are one node with a weight; copies link to each other without being searched.
2. Shards: centroids of each label come from a bounded sample (``sample_rows``, 50,000, those of least hash; at most ``most_centroids``, 4096,
   shared over the labels by size).
   Every node joins the shards of its ``overlap`` (3) nearest centroids of its label; a label that the sample lacks is one shard.
   A shard of many nodes is dealt to blocks, and every pair of blocks is a unit of its own, so no task holds more than two blocks.
   A pair of blocks more than one apart is not in the united lists; the search builds its graph where it needs it.
3. Build: in each unit the nearest candidates of a node are pruned robustly (a neighbour goes if a closer one is ``alpha`` times nearer to
   it than the node is), to ``degree`` out-edges. Edges hold both ways, and a maximum spanning tree of the unit is added, so whatever is linked in a unit
   is joined in its graph by edges that are links themselves, however large the groups are.
4. Union: the adjacency lists that a node got in its shards are united.
5. Search: in each unit, every node is searched for from itself and the unit's medoids by a greedy beam; from what the beam found, the search
   expands through every neighbour within ``slack`` of the threshold until nothing new is in range.
6. Verify: pairs are kept by their exact cosine. A pair that shares several shards counts in the first of them, so links are counted without listing them. A unit
   returns link weights and a spanning forest; components of the forests are the groups.

:func:`audit_recall` compares the links of a fixed set of queries (every id divisible by 100) with brute force, in blocks; the registered query logs it, as a warning below 0.99.

Cases: vectors that are null, zero, or hold a null or non-finite component, and rows whose label is null, link with nothing: n_links 0 and a component of their own. Vectors
of different lengths don't link. Equal rows, also with equal ids, are rows of their own. A null id stays null (its own component is null, kept is true). An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import hashed_sample, materialise, small_batches
from .components import components
from .jaccard_join import FOUND, _forest

DEGREE, CANDIDATES, ALPHA, BEAM, SLACK = 24, 64, 1.2, 32, 0.06


def unit_rows(vectors: list) -> np.ndarray:
    """Vectors as rows of length one, in double precision."""
    x = np.array(vectors, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(x: np.ndarray, k: int, seed: int = 1, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        to = np.concatenate([(x[s : s + 4096] @ c.T).argmax(axis=1) for s in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, to, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def spanning_tree(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n - 1 edges of a maximum spanning tree of a matrix of cosines (Prim)."""
    n = len(near)
    best, via, left = near[0].copy(), np.zeros(n, np.int64), np.ones(n, bool)
    left[0], best[0] = False, -4
    to = np.zeros(n - 1, np.int64)
    for k in range(n - 1):
        to[k] = node = best.argmax()
        left[node], best[node] = False, -4
        closer = left & (near[node] > best)
        best[closer], via[closer] = near[node][closer], node
    return via[to], to


def robust_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbours of unit rows: what pruning leaves of the nearest, at most ``degree`` out-edges, and a spanning tree, all in both directions."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    out = np.full((n, degree), -1, np.int64)
    y = x.astype(np.float32)
    near = y @ y.T
    m = min(CANDIDATES, n - 1)
    np.fill_diagonal(near, -2)
    u, v = spanning_tree(near)
    dist = np.sqrt(np.maximum(2 - 2 * near, 0))
    for s in range(0, n, 256):
        rows = np.arange(s, min(s + 256, n))
        cand = np.argpartition(-near[rows], m - 1, axis=1)[:, :m]
        own = np.take_along_axis(dist[rows], cand, 1)
        order = np.argsort(own, axis=1, kind="stable")
        cand, own = np.take_along_axis(cand, order, 1), np.take_along_axis(own, order, 1)
        alive = np.ones(cand.shape, bool)
        for r in range(degree):
            first = alive.argmax(axis=1)
            some = alive[np.arange(len(rows)), first]
            if not some.any():
                break
            pick = cand[np.arange(len(rows)), first]
            out[rows[some], r] = pick[some]
            alive[np.arange(len(rows)), first] = False
            alive &= ~((alpha * dist[pick[:, None], cand] <= own) & some[:, None])
    i, k = np.nonzero(out >= 0)
    u, v = np.concatenate((u, i)), np.concatenate((v, out[i, k]))
    code = np.unique(np.concatenate((u * n + v, v * n + u)))
    return np.split(code % n, np.searchsorted(code // n, np.arange(1, n)))


def medoids(x: np.ndarray, k: int = 8) -> np.ndarray:
    """The row nearest to the mean, then rows farthest from those chosen."""
    out = [int((x @ x.mean(axis=0)).argmax())]
    far = x @ x[out[0]]
    for _ in range(min(k, len(x)) - 1):
        out.append(int(far.argmin()))
        far = np.maximum(far, x @ x[out[-1]])
    return np.unique(out)


def range_search(x: np.ndarray, adjacency: list[np.ndarray], queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (position among the queries, node) visited within ``threshold``, by greedy search from the query's own node and the medoids, and range expansion."""
    n, y = len(x), x.astype(np.float32)
    size = np.array([len(a) for a in adjacency], np.int64)
    flat = np.concatenate(adjacency) if len(adjacency) else np.zeros(0, np.int64)
    at = np.cumsum(size) - size
    q = len(queries)
    seen, done = np.full((q, n), -2.0, np.float32), np.zeros((q, n), bool)
    start = medoids(x)
    seen[:, start] = y[queries] @ y[start].T
    seen[np.arange(q), queries] = 1

    def expand(i, node):
        done[i, node] = True
        count = size[node]
        to = flat[np.repeat(at[node] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        who = np.repeat(i, count)
        code = np.unique(who * n + to)
        who, to = code // n, code % n
        new = seen[who, to] == -2.0
        who, to = who[new], to[new]
        for s in range(0, len(who), 65536):
            a, b = who[s : s + 65536], to[s : s + 65536]
            seen[a, b] = np.maximum(np.einsum("ij,ij->i", y[queries[a]], y[b]), -1.99)

    beam, active = min(BEAM, n), np.arange(q)
    while len(active):
        own = seen[active]
        bar = np.partition(own, n - beam, axis=1)[:, n - beam]
        open_ = np.where(done[active] | (own < bar[:, None]) | (own == -2.0), -3.0, own)
        best = np.argpartition(-open_, min(4, n) - 1, axis=1)[:, : min(4, n)]
        value = np.take_along_axis(open_, best, 1)
        some = value > -2.5
        if not some.any():
            break
        i, k = np.nonzero(some)
        expand(active[i], best[i, k])
        active = active[some.any(axis=1)]
    while True:
        i, node = np.nonzero((seen >= threshold - SLACK) & ~done)
        if not len(i):
            break
        for s in range(0, len(i), 8192):
            expand(i[s : s + 8192], node[s : s + 8192])
    return np.nonzero(seen >= threshold - 1e-4)


def shared_budget(wanted: dict, most: int) -> dict:
    """What each key gets of ``most``: all it wants if that fits, else one and a part of the rest by what it wants more. There are at most ``most`` keys."""
    more = sum(wanted.values()) - len(wanted)
    rest = most - len(wanted)
    return dict(wanted) if more <= rest else {key: 1 + (k - 1) * rest // more for key, k in wanted.items()}


def _assigned(model: dict, overlap: int):
    """(id, shards): the nearest centroids of the label; a label without centroids is shard -1 - hash by itself."""

    def rows(batches):
        for batch in batches:
            labels, vectors, out = batch.column(1).to_pylist(), batch.column(2).to_pylist(), []
            x = [None] * len(labels)
            by: dict = {}
            for r, (label, v) in enumerate(zip(labels, vectors)):
                by.setdefault((label, len(v)), []).append(r)
            for (label, dim), own in by.items():
                base, c = model.get((label, dim), (None, None))
                if c is None:
                    for r in own:
                        x[r] = [-1]
                    continue
                near = unit_rows([vectors[r] for r in own]) @ c.T
                k = min(overlap, len(c))
                best = np.argpartition(-near, k - 1, axis=1)[:, :k]
                for r, b in zip(own, best):
                    x[r] = sorted((base + b).tolist())
            out.append(pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.int32()))], ["id", "shards"]))
            yield from out

    return rows


def _units(batches, keys: int):
    """Groups of rows by the first ``keys`` columns, which come sorted: lists of row tuples without repeats of a node."""
    key, rows = None, []
    for batch in batches:
        for r in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
            if r[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = r[:keys], []
            if not rows or rows[-1][keys] != r[keys]:
                rows.append(r)
    if rows:
        yield key, rows


UNIT_KEYS = ["label", "dim", "shard", "x", "y"]


def _build_rows(batches):
    for _, rows in _units(batches, len(UNIT_KEYS)):
        nodes = np.array([r[5] for r in rows], np.int64)
        graph = robust_graph(unit_rows([r[8] for r in rows]))
        lists = [nodes[g] for g in graph]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(lists, pa.list_(pa.int64()))], ["id", "near"])


def _found_pairs(key, rows, threshold: float):
    """Verified pairs (i, j), i < j, of a unit that count in it, and its nodes and weights."""
    nodes, weights = np.array([r[5] for r in rows], np.int64), np.array([r[6] for r in rows], np.int64)
    blocks, x = np.array([r[7] for r in rows]), unit_rows([r[8] for r in rows])
    order = np.argsort(nodes)
    ranked = nodes[order]
    adjacency = []
    for r in rows:
        to = np.array(r[10] if r[10] is not None else [], np.int64)
        where = np.minimum(np.searchsorted(ranked, to), len(nodes) - 1)
        adjacency.append(order[where[ranked[where] == to]])
    if key[4] - key[3] > 1:  # no graph was built over both blocks
        adjacency = [np.union1d(a, g) for a, g in zip(adjacency, robust_graph(x))]
    pairs = []
    for s in range(0, len(nodes), 256):
        i, j = range_search(x, adjacency, np.arange(s, min(s + 256, len(nodes))), threshold)
        pairs.append(np.stack([i + s, j]))
    i, j = np.concatenate(pairs, axis=1)
    code = np.unique(np.minimum(i, j) * len(nodes) + np.maximum(i, j))
    i, j = code // len(nodes), code % len(nodes)
    keep = (i != j) & (np.einsum("ij,ij->i", x[i], x[j]) >= threshold)
    i, j = i[keep], j[keep]
    if key[3] != key[4]:
        cross = blocks[i] != blocks[j]
        i, j = i[cross], j[cross]
    width = max(len(r[9]) for r in rows)
    shards = np.array([list(r[9]) + [-2] * (width - len(r[9])) for r in rows])
    if len(i):  # the first shard that both are in
        common = (shards[i][:, :, None] == shards[j][:, None, :]).any(axis=2) & (shards[i] != -2) & (shards[i] < key[2])
        first = ~common.any(axis=1)
        i, j = i[first], j[first]
    return i, j, nodes, weights


def _search_rows(threshold: float):
    def rows(batches):
        for key, unit in _units(batches, len(UNIT_KEYS)):
            if len(unit) < 2:
                continue
            i, j, nodes, weights = _found_pairs(key, unit, threshold)
            total = np.zeros(len(nodes), np.int64)
            np.add.at(total, i, weights[j])
            np.add.at(total, j, weights[i])
            hit = np.flatnonzero(total)
            forest = list(_forest(nodes[i].tolist(), nodes[j].tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((nodes[hit], np.array([u for u, _ in forest], np.int64)))),
                    pa.array(np.concatenate((total[hit], np.zeros(len(forest), np.int64)))),
                    pa.array([None] * len(hit) + [v for _, v in forest], pa.int64()),
                ],
                ["node", "weight", "other"],
            )

    return rows


def valid(vector: str, label: str):
    """Whether a row can link at all."""
    v = F.col(vector)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda e: e != 0), F.lit(False))


def _by_label(sample: pa.Table) -> dict:
    """Matrices of the sampled vectors by (label, length), in the order of their names; no vector becomes Python objects."""
    if not sample.num_rows:
        return {}
    order = np.argsort(sample.column("c1").to_numpy(), kind="stable")
    labels, dims = np.array(sample.column("label").to_pylist(), object)[order], sample.column("dim").to_numpy()[order]
    lists = sample.column("v").combine_chunks()
    flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1][order]
    keys, groups = list(zip(labels, dims.tolist())), {}
    for i, key in enumerate(keys):
        groups.setdefault(key, []).append(at[i])
    return {key: flat[np.array(starts)[:, None] + np.arange(key[1])] for key, starts in sorted(groups.items())}


def vector_dedup(
    embeddings: DataFrame, threshold: float = 0.93, overlap: int = 3, shard_nodes: int = 1200, block: int = 1024, sample_rows: int = 50_000, most_centroids: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    small_batches(embeddings.sparkSession, 2048)
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v")).withColumn("ok", valid("v", "label"))
    named = rows.withColumn("c1", F.when(F.col("ok"), F.xxhash64("label", "v"))).withColumn("c2", F.when(F.col("ok"), F.xxhash64(F.lit(3), "v", "label")))
    keys = materialise(named.select("vec_id", "c1", "c2"))
    nodes = materialise(named.filter("ok").groupBy("c1", "c2", "label", F.size("v").alias("dim")).agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("head")))
    sample = hashed_sample(nodes.select("label", "dim", "v", "c1"), sample_rows, F.xxhash64(F.lit(9), "c1"), "c1").toArrow()
    sizes = {(r["label"], r["dim"]): r["n"] for r in nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(most_centroids).collect()}
    sampled = {key: vectors for key, vectors in _by_label(sample).items() if key in sizes}
    wanted = {key: max(1, min(-(-overlap * sizes[key] // shard_nodes), len(vectors) // 8 + 1)) for key, vectors in sampled.items()}
    model, base = {}, 0
    for key, k in shared_budget(wanted, most_centroids).items():
        model[key] = (base, centroids(unit_rows(sampled[key]), k))
        base += len(model[key][1])
    shards = nodes.select("c1", "label", "v").mapInArrow(_assigned(model, overlap), "id long, shards array<int>")
    placed = nodes.join(shards, F.col("c1") == F.col("id")).select("id", "label", "dim", "v", "n", "shards", F.explode("shards").alias("shard"))
    parts = placed.groupBy("label", "dim", "shard").agg(F.greatest(F.when(F.count(F.lit(1)) > 2 * block, F.ceil(F.count(F.lit(1)) / block)), F.lit(1)).cast("int").alias("parts"))
    same = [F.col("label") == F.col("l2"), F.col("dim") == F.col("d2"), F.col("shard") == F.col("s2")]
    placed = placed.join(parts.select(F.col("label").alias("l2"), F.col("dim").alias("d2"), F.col("shard").alias("s2"), "parts"), same)
    placed = materialise(placed.withColumn("block", F.pmod(F.xxhash64(F.lit(8), "id"), "parts").cast("int")).select("id", "label", "dim", "v", "n", "shards", "shard", "parts", "block"))
    both = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("x", F.least("block", "with")).withColumn("y", F.greatest("block", "with"))

    def dealt(df, *more):
        cols = [*UNIT_KEYS, "id", "n", "block", "v", "shards", *more]
        return df.repartition(*UNIT_KEYS).sortWithinPartitions(*UNIT_KEYS, "id").select(cols)

    near = dealt(both.filter("y - x <= 1")).mapInArrow(_build_rows, "id long, near array<long>")
    union = near.groupBy(F.col("id").alias("i2")).agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    found = materialise(dealt(both.join(union, F.col("id") == F.col("i2"), "left"), "near").mapInArrow(_search_rows(threshold), FOUND))
    links = found.groupBy("node").agg(F.sum("weight").alias("linked"))
    groups = components(found.filter("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v"))).select(F.col("id").alias("g1"), F.col("component").alias("g"))
    known = nodes.select("c1", "c2", "n", "head").join(links, F.col("c1") == F.col("node"), "left").join(groups, F.col("c1") == F.col("g1"), "left").withColumn("g", F.coalesce("g", "c1"))
    heads = known.groupBy(F.col("g").alias("h")).agg(F.min("head").alias("component_id"))
    known = known.join(heads, F.col("g") == F.col("h")).select(F.col("c1").alias("d1"), F.col("c2").alias("d2"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    lone = keys.filter("c1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = keys.filter("c1 is not null").join(known, (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2"))).select("vec_id", "n_links", "component_id").unionAll(lone)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def audit_recall(embeddings: DataFrame, result: DataFrame, threshold: float = 0.93, every: int = 100, most_queries: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> float:
    """Found links over all links of the vectors whose id is divisible by ``every``, by brute force against all rows; ``most_queries`` at a time."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v")).filter(valid("v", "label"))
    asked = rows.filter(F.col("id") % every == 0)
    blocks, hits, total = max(1, -(-asked.count() // most_queries)), 0, 0
    for block in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        a, b = _audited(rows, some.collect(), result, threshold)
        hits, total = hits + a, total + b
    return 1.0 if not total else hits / total


def _audited(rows: DataFrame, asked: list, result: DataFrame, threshold: float) -> tuple[int, int]:
    """(found links, all links) of the rows ``asked``."""
    if not asked:
        return 0, 0
    queries: dict = {}
    for r in asked:
        queries.setdefault((r["label"], len(r["v"])), []).append((r["id"], r["v"]))
    queries = {k: (np.array([i for i, _ in own]), unit_rows([v for _, v in own])) for k, own in queries.items()}

    def counts(batches):
        found: dict = {}  # one sum for each query and task
        for batch in batches:
            by: dict = {}
            for label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault((label, len(v)), []).append(v)
            for key, own in by.items():
                if key in queries:
                    found[key] = found.get(key, 0) + (queries[key][1] @ unit_rows(own).T >= threshold).sum(axis=1)
        for key, hits in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(queries[key][0]), pa.array(hits)], ["id", "hits"])

    want = rows.select("label", "v").mapInArrow(counts, "id long, hits long").groupBy("id").agg((F.sum("hits") - 1).alias("hits"))
    both = want.join(result.select(F.col("vec_id").alias("r"), "n_links"), F.col("id") == F.col("r")).agg(F.sum(F.least("hits", "n_links")).alias("a"), F.sum("hits").alias("b")).first()
    return both["a"] or 0, both["b"] or 0
