import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from strandline.llm.mixing import mix_documents, mixture, sainte_lague

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank string, shard string, _row int"


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "c", "d", None, "é"])
        text = " ".join("w" for _ in range(rng.randint(0, 300)))
        rows.append((i, text, "en", source, len(text), "r", "s", 1))
    return rows + [(1000, None, None, "z", 0, None, None, None), rows[5], rows[5], (None, "one two", None, "b", 7, None, None, None)]


def targets(rows, cap=3):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, free, out = sum(sizes.values()), set(order), {}
    while True:
        level = (total - sum(out.values())) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return sizes, out | {s: level * weight[s] for s in free}
        out |= {s: cap * sizes[s] for s in over}
        free -= over


def test_targets_and_bounds(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixture(df, shard_tokens=5000).collect()
    assert len(got) == len(rows)
    sizes, want = targets(rows)
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 64, s
    again = mixture(df.repartition(7), shard_tokens=5000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_blocks_by_brute_force(spark):
    """Every block of a shard in its seeded order, taken until the rest of the quota is used up."""
    from strandline.llm.mixing import _places

    df = spark.createDataFrame(corpus(4, 150), SCHEMA)
    places = _places(df, 17, 32, 3000, 3, "doc_id", "text", "source").collect()
    shards = defaultdict(list)
    for r in places:
        shards[r["rank"], r.shard].append(r)
    want, spread = Counter(), 0
    for rows in shards.values():
        one = rows[0]
        words = [r.k1 for r in sorted(rows, key=lambda r: r.lo) for _ in range(r.size)]
        assert len(words) == one.s_size
        order = sorted(range(one.blocks), key=lambda b: (one.step * b + one.shift) % one.blocks)
        assert sorted((one.step * b + one.shift) % one.blocks for b in range(one.blocks)) == list(range(one.blocks))
        queue = [w for b in order for w in words[b * 32 : b * 32 + 32]]
        want.update(Counter(words * one.rounds + queue[: one.rest]))
        used = -(-one.rest // 32)
        spread += used > 3 and max(order[:used]) - min(order[:used]) >= used
        assert one.rounds * one.s_size + one.rest <= 3 * one.s_size
    got = Counter()
    for r in mixture(df, shard_tokens=3000).collect():
        got[r.doc_id] += r.taken
    assert +got == +want and spread


def test_many_shards_go_by_groups(spark, monkeypatch):
    from strandline.llm import mixing

    rows = corpus(5)
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(mixing, "GROUP", 4)
    taken, source = Counter(), {r[0]: r[3] for r in rows}
    for r in mixture(df, shard_tokens=500).collect():
        assert r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    sizes, want = targets(rows)
    assert all(abs(taken[s] - want[s]) <= 32 + 0.03 * want[s] for s in sizes)


def test_sainte_lague_is_by_highest_quotients(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([0, 1, 5, 50, 700, rng.randint(1, 9999)]), h) for g, h in ((0, 100), (1, 7), (2, 1), (3, 0), (4, 1000)) for i in range(rng.randint(1, 40))]
    got = sainte_lague(spark.createDataFrame(rows, "g int, i int, v long, h long"), ["g"], "v", "h", [F.col("i")], "q").collect()
    want = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        seats = sorted(((-v / (2 * j + 1), i) for _, i, v, h in own if v for j in range(h)))[: own[0][3]]
        want |= {(g, i): sum(s[1] == i for s in seats) for _, i, _, _ in own}
    assert {(r.g, r.i): r.q for r in got} == want


def test_mixed_documents(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, SCHEMA)
    out = mix_documents(df)
    assert out.columns == df.columns
    sizes, want = targets(rows)
    taken = Counter()
    for r in out.collect():
        taken[r.source] += len(r.text.split())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 700 + 64
    counts = Counter(r.doc_id for r in out.collect())
    assert max(counts.values()) <= 9


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixture(df).collect() == [] and mix_documents(df).collect() == []
