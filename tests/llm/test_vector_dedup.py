import random

import numpy as np
import pytest

from strandline.llm import queries
from strandline.llm import vector_dedup as module
from strandline.llm.vector_dedup import audit_recall, medoids, range_search, robust_graph, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, n long, shard string, id string"


def corpus(seed, n=400, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = rng.normal(size=dim)
        label = int(rng.integers(0, 3))
        for _ in range(int(rng.choice([1, 1, 2, 5]))):
            rows.append((len(rows), (base + rng.normal(0, 0.12, dim)).astype(np.float32).tolist(), label))
    heavy = rng.normal(size=dim)
    for _ in range(150):
        rows.append((len(rows), (heavy + rng.normal(0, 0.1, dim)).astype(np.float32).tolist(), 1))
    rows += [(len(rows) + i, rows[7][1], rows[7][2]) for i in range(20)]
    nan, inf = float("nan"), float("inf")
    odd = [(9000, None, 1), (9001, [0.0] * dim, 1), (9002, [nan] * dim, 1), (9003, [inf] + [1.0] * (dim - 1), 1), (9004, [None] + [1.0] * (dim - 1), 1), (9005, rows[3][1], None), (9006, [1.0, 2.0], 1), (9007, [2.0, 4.0], 1), (9008, [], 1), (9009, [2.0, 4.0], 77)]
    return rows + odd + [rows[0], rows[0]]


def brute(rows, threshold=0.93):
    ok = [v is not None and len(v) and all(e is not None and np.isfinite(e) for e in v) and any(v) and label is not None for _, v, label in rows]
    n = len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    unit = [np.array(v, np.float64) / np.linalg.norm(v) if o else None for (_, v, _), o in zip(rows, ok)]
    links = [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    head = {}
    for i in range(n):
        head[find(i)] = min(head.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], head[find(i)], rows[i][0] == head[find(i)]) for i in range(n))


@pytest.mark.parametrize("block,nodes", [(1024, 1200), (40, 100)])
def test_brute_force(spark, block, nodes):
    rows = corpus(1)
    df = spark.createDataFrame([(*r, 1, "s", "i") for r in rows], SCHEMA).repartition(3)
    out = vector_dedup(df, block=block, shard_nodes=nodes)
    got = sorted(tuple(r) for r in out.collect())
    want = brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
    assert sum(g == w for g, w in zip(got, want)) >= 0.97 * len(want)
    assert audit_recall(df, out, every=10) >= 0.9


def test_graph_and_search_find_the_range():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[100:160] = x[99] + rng.normal(0, 0.1, (60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = robust_graph(x)
    assert all(len(set(g[g >= 0])) == (g >= 0).sum() and k not in g for k, g in enumerate(graph))
    i, j = range_search(x, [g[g >= 0] for g in graph], np.arange(300), 0.93)
    near = x @ x.T >= 0.93
    assert near[i, j].sum() >= 0.97 * near.sum()
    assert len(medoids(x[:3])) <= 3


def test_null_ids_and_empty_table(spark):
    rows = [(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (None, None, 1)]
    df = spark.createDataFrame([(*r, 1, "s", "i") for r in rows], SCHEMA)
    got = {tuple(r) for r in vector_dedup(df).collect()}
    assert got == {(None, 1, 5, False), (5, 1, 5, True), (None, 0, None, True)}
    assert vector_dedup(df.limit(0)).collect() == []
    random.seed(0)


def grouped(seed, sizes, dim=16, cosine=0.96):
    """Vectors in groups of about this cosine, far from each other, in random order."""
    rng, out = np.random.default_rng(seed), []
    for n in sizes:
        base = rng.normal(size=dim)
        base /= np.linalg.norm(base)
        e = rng.normal(size=(n, dim))
        e -= (e @ base)[:, None] * base
        out.append(cosine**0.5 * base + (1 - cosine) ** 0.5 * e / np.linalg.norm(e, axis=1, keepdims=True))
    out = np.concatenate(out)
    return out[rng.permutation(len(out))]


@pytest.mark.parametrize("sizes", [[100] * 12, [70] * 17, [300] * 4 + [70, 90, 150, 200]])
def test_labels_of_large_groups_only(spark, sizes):
    x = grouped(3, sizes).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1, 1, "s", "i") for i, v in enumerate(x)], SCHEMA).repartition(3)
    got = {r.vec_id: r for r in vector_dedup(df).collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.93
    assert sum(got[i].n_links for i in got) >= 0.999 * (near.sum() - len(x))
    assert all(got[i].component_id == got[j].component_id for i, j in zip(*np.nonzero(near)))
    assert len({r.component_id for r in got.values()}) == len(sizes)


def test_centroids_are_shared_over_labels(spark, monkeypatch):
    seen, real = {}, module._assigned
    monkeypatch.setattr(module, "_assigned", lambda model, overlap: seen.update(model) or real(model, overlap))
    x = np.random.default_rng(4).normal(size=(400, 8))
    df = spark.createDataFrame([(i, v.tolist(), i % 4, 1, "s", "i") for i, v in enumerate(x)], SCHEMA)
    vector_dedup(df, shard_nodes=30, most_centroids=12)
    assert [len(seen[str(label), 8][1]) for label in range(4)] == [3, 3, 3, 3]
    assert len({base for base, _ in seen.values()}) == 4


def test_blocks_far_apart_are_searched_as_one_graph():
    x = grouped(6, [140] * 14)
    block = np.arange(len(x)) % 2 * 2
    near = [None] * len(x)
    for b in (0, 2):
        own = np.flatnonzero(block == b)
        for i, g in zip(own, robust_graph(x[own])):
            near[i] = own[np.asarray(g)[np.asarray(g) >= 0]]
    rows = [("a", 16, 0, 0, 2, i, 1, block[i], x[i].tolist(), [0], near[i]) for i in range(len(x))]
    i, j, _, _ = module._found_pairs(rows[0][:5], rows, 0.93)
    want = np.triu((x @ x.T >= 0.93) & (block[:, None] != block), 1)
    assert len(i) >= 0.999 * want.sum() and want[i, j].all()


def test_audit_asks_all_queries_and_the_query_logs_it(spark, monkeypatch, tmp_path, caplog):
    x = grouped(8, [40, 60])
    df = spark.createDataFrame([(i, v.tolist(), 1, 1, "s", "i") for i, v in enumerate(x)], SCHEMA)
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    lossy = spark.createDataFrame([(i, int(n) if i % 2 else 0) for i, n in enumerate(want)], "vec_id long, n_links long")
    assert audit_recall(df, lossy, every=1, most_queries=7) == pytest.approx(want[1::2].sum() / want.sum())
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(queries, "vector_dedup", lambda embeddings, threshold: lossy)
    queries.op7_vector_dedup(spark, str(tmp_path))
    assert any("audited recall 0.0000" in r.getMessage() and r.levelname == "WARNING" for r in caplog.records)
