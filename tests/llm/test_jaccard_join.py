import random
from collections import defaultdict

import numpy as np
import pytest

from strandline.llm.components import components
from strandline.llm.jaccard_join import intersections, jaccard_join, least_matches, near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, c1 string, one string, _row int, _k2 int, _e1 int, _n int, key int"


def shingle_set(text):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs, threshold=0.8):
    sets = [shingle_set(t) for _, t in docs]
    n = len(docs)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    count, same = [0] * n, defaultdict(list)
    for i in range(n):
        same[sets[i]].append(i)
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a | b and len(a & b) >= threshold * len(a | b) - 1e-12):
                count[i] += 1
                count[j] += 1
                root[find(i)] = find(j)
    ids = lambda members: min((docs[k][0] for k in members if docs[k][0] is not None), default=None)
    group = defaultdict(list)
    for i in range(n):
        group[find(i)].append(i)
    return sorted(((docs[i][0], ids(same[sets[i]]), count[i], ids(group[find(i)])) for i in range(n)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    for base in range(25):
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 40, 150, 400]))]
        for _ in range(rng.choice([1, 2, 6, 25])):
            own = list(words)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            docs.append((len(docs) * 3 % 1009, rng.choice([" ", "\n"]).join(own)))
    docs += [(2000, None), (2001, ""), (2002, " \n "), docs[4], docs[4], (None, "a null id of some words"), (2003, "a null id of some words"), (2004, "z " * 30_000)]
    rng.shuffle(docs)
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", 1, 2, 3, 4, 5) for i, t in docs], SCHEMA)


@pytest.mark.parametrize("seed,block", [(1, 128), (2, 4)])
def test_brute_force(spark, seed, block):
    docs = corpus(seed)
    got = jaccard_join(frame(spark, docs).repartition(4), block=block).collect()
    assert sorted(((r.doc_id, r.copy_of, r.n_links, r.class_id) for r in got), key=str) == brute(docs)


def test_exact_whatever_the_order(spark):
    """The sample decides about the work, never about the links."""
    docs = corpus(6)
    want = brute(docs)
    for options in ({"order_rows": 5}, {"order_shingles": 3}, {"order_rows": 1000}):
        got = jaccard_join(frame(spark, docs), block=8, split=4, **options).collect()
        assert sorted(((r.doc_id, r.copy_of, r.n_links, r.class_id) for r in got), key=str) == want


def test_links_at_the_threshold(spark):
    """Pairs just at and just under 0.8 and sets of all small sizes."""
    docs = []
    for n in range(1, 60):
        words = [f"n{n}x{i}" for i in range(n + 4)]
        docs += [(n * 10, " ".join(words))]
        for k, cut in enumerate((1, 2, 3, n // 5, n // 4)):
            if 0 < cut < n:
                docs.append((n * 10 + k + 1, " ".join(words[:-cut])))
    got = jaccard_join(frame(spark, docs), block=16).collect()
    assert sorted(((r.doc_id, r.copy_of, r.n_links, r.class_id) for r in got), key=str) == brute(docs)


def templates(n, seed=4):
    """Texts of one template: any two have a similarity of about 0.4."""
    rng = random.Random(seed)
    shared = [f"t{i}" for i in range(180)]
    return [(i, " ".join(shared + [f"u{rng.random()}" for _ in range(132)])) for i in range(n)]


@pytest.mark.parametrize("n", [100, 400])
def test_templates_are_no_candidates(spark, n):
    """Any number of texts that share 0.4 falls apart into no candidates at all, so the work grows with the texts."""
    from strandline.llm.jaccard_join import BANDS, Joined

    docs = templates(n)
    a, b = shingle_set(docs[0][1]), shingle_set(docs[1][1])
    assert 0.35 < len(a & b) / len(a | b) < 0.45
    assert Joined(frame(spark, docs), BANDS, 0.8, 1e-9, 16, "doc_id", "text", split=64).members.count() == 0
    docs += [(5000, docs[0][1] + " end"), (5001, docs[0][1] + " other")]
    got = {r.doc_id: (r.n_links, r.class_id) for r in jaccard_join(frame(spark, docs), block=16, split=64).collect()}
    assert got[0] == got[5000] == got[5001] == (2, 0) and got[1] == (0, 1)


def test_candidates_are_the_pairs_that_share_a_key():
    from strandline.llm.jaccard_join import candidates

    rng = np.random.default_rng(5)
    for n, m, values in ((9, 9, 40), (30, 20, 500), (6, 7, 3)):
        a = [np.unique(rng.integers(0, values, 4)).astype(np.uint64) for _ in range(n)]
        b = [np.unique(rng.integers(0, values, 4)).astype(np.uint64) for _ in range(m)]
        for other, same in ((b, False), (a, True)):
            got = set(zip(*(x.tolist() for x in candidates(a, other, same))))
            want = {(i, j) for i in range(n) for j in range(len(other)) if (not same or i < j) and set(a[i]) & set(other[j])}
            assert want <= got and (got == want or len(got) == (n * (n - 1) // 2 if same else n * m))


def test_one_of_each_group_stays(spark):
    docs = corpus(3)
    df = frame(spark, docs)
    out = near_dedup(df)
    assert out.columns == df.columns
    kept = sorted((r.doc_id for r in out.collect()), key=str)
    assert kept == sorted({g for _, _, _, g in brute(docs)}, key=str)


def test_pruning_bounds_and_intersections():
    least = least_matches(240, 24, 0.8, 1e-9)
    assert all(m < 0.8 * 24 * (k + 1) for k, m in enumerate(least)) and least[-1] > 100
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 3000, 500)).astype(np.uint64) for _ in range(12)]
    got = intersections(sets[:5], sets[5:], piece=64)
    assert all(got[i, j] == len(set(sets[i]) & set(sets[5 + j])) for i in range(5) for j in range(7))


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(300) if i % 50 != 49] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randint(2000, 2060), rng.randint(2000, 2060)) for _ in range(30)] + [(-5, 7), (9, 9)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        p, q = find(u), find(v)
        if p != q:
            root[max(p, q)] = min(p, q)
    assert got == {x: find(x) for x in root if x != 9} | ({9: find(9)} if find(9) != 9 else {9: 9} if 9 in got else {})


def test_empty_table(spark):
    df = frame(spark, [])
    assert jaccard_join(df).collect() == [] and near_dedup(df).collect() == []
