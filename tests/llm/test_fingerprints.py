import hashlib
import random

import numpy as np

from strandline.llm.fingerprints import edited_fingerprints, fingerprints, likeness, range_of, signatures, similar_fingerprints

SCHEMA = "doc_id long, text string, lang string, part int, head long"


def corpus(seed=2, n=90):
    rng = random.Random(seed)
    pool = ["the", "öl", "wh,", "12", "𝔘x", "na"]
    ids = rng.sample(range(-50, 5000), n)
    rows = [(i, " ".join(rng.choice(pool) + str(rng.randint(0, 30)) for _ in range(rng.choice([0, 1, 4, 5, 60, 300])))) for i in ids]
    return rows + [(7000, None), (7001, ""), (7002, " \n\t"), (7003, rows[0][1]), (7003, rows[0][1]), (7003, "other text"), (None, "null id here")]


def brute_signature(text, n=128):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    parts = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    return parts


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en", 1, 2) for i, t in rows], SCHEMA).repartition(5)
    got = edited_fingerprints(df, rows_in_range=9).collect()
    assert len(got) == len(rows)
    plain = {(r.doc_id, r.fingerprint) for r in fingerprints(df).collect()}
    assert {(r.doc_id, r.fingerprint) for r in got} == plain
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(t or "")
    single = sorted((i for i in by_id if i is not None and len(by_id[i]) == 1))
    order = sorted(i for i in by_id if i is not None) + [None]
    for r in got:
        if r.doc_id not in single:
            continue
        own = by_id[r.doc_id][0]
        nxt = by_id[order[(order.index(r.doc_id) + 1) % len(order)]]
        edits = [own[: len(own) - len(own) // 2] + t[: len(own) // 2] for t in nxt]
        assert r.n_chars == len(own)
        assert r.edited_sha256 in {hashlib.sha256(e.encode()).hexdigest() for e in edits}
        for e, t in zip(edits, nxt):
            if hashlib.sha256(e.encode()).hexdigest() == r.edited_sha256:
                a, b = brute_signature(own), brute_signature(e)
                if a or b:
                    assert abs(r.near_edited - len(a & b) / len(a | b)) < 0.25
                else:
                    assert r.near_edited == 1.0
    last = next(r for r in got if r.doc_id is None)
    first = by_id[order[0]][0]
    t = "null id here"
    assert last.edited_sha256 == hashlib.sha256((t[:6] + first[:6]).encode()).hexdigest()


def test_next_and_edited_likeness_are_those_of_the_fingerprints(spark):
    """near_next and near_edited equal the likeness of the fingerprints themselves, and come near the Jaccard similarity of the shingle sets."""
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 500)}" for _ in range(400)]
    rows = []
    for i in range(40):
        own = list(base) if i % 2 else [f"v{rng.randint(0, 500)}" for _ in range(400)]
        for _ in range(i % 5):
            own[rng.randrange(400)] = "x"
        rows.append((i * 3, " ".join(own)))
    got = sorted(edited_fingerprints(spark.createDataFrame([(i, t, "", 0, 0) for i, t in rows], SCHEMA), rows_in_range=7).collect())
    of = lambda h: np.frombuffer(bytes.fromhex(h), ">u2")
    for k, r in enumerate(got):
        nxt = got[(k + 1) % len(got)]
        assert r.near_next == likeness(of(r.fingerprint), of(nxt.fingerprint)) and r.near_edited == likeness(of(r.fingerprint), of(r.edited_fingerprint))
        a, b = (brute_signature(dict(rows)[x.doc_id]) for x in (r, nxt))
        assert abs(r.near_next - len(a & b) / len(a | b)) < 0.2


def test_groups_by_brute_force(spark):
    """Bands, then exact verification: links and groups equal those of all pairs of shingle sets."""
    rng = random.Random(12)
    rows = [r for r in corpus(9, 40) if r[0] is not None]
    for k in range(12):
        words = [f"w{rng.randint(0, 900)}" for _ in range(120)]
        for m in range(rng.choice([1, 3, 6])):
            own = list(words)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(120)] = "edit"
            rows.append((10_000 + 10 * k + m, " ".join(own)))
    rows += [(20_000, "long " * 200_000), (20_001, "long " * 100_000)]
    sets = [brute_signature(t or "") for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a | b and len(a & b) >= 0.8 * len(a | b)):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    df = spark.createDataFrame([(i, t, "", 0, 0) for i, t in rows], SCHEMA)
    got = similar_fingerprints(df, rows_in_range=11).collect()
    assert sorted((r.doc_id, r.similar_id, r.n_similar) for r in got) == sorted((rows[i][0], least[find(i)], links[i]) for i in range(len(rows)))
    plain = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(tuple(r[c] for c in plain) for r in got) == sorted(tuple(r) for r in edited_fingerprints(df, rows_in_range=11).collect())


def test_ranges(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    for n in (1, 2, 10, 1000):
        cuts = sorted(rng.sample(range(-5000, 5000), n))
        ids = [rng.randint(-6000, 6000) for _ in range(300)] + cuts
        got = spark.createDataFrame([(i,) for i in [*ids, None]], "i long").select("i", range_of(F.col("i"), cuts).alias("r")).collect()
        assert all(r.r == (n if r.i is None else sum(c <= r.i for c in cuts)) for r in got)


def test_signature_estimates_jaccard():
    rng = random.Random(1)
    for share in (0.2, 0.5, 0.8, 0.95):
        a = [f"w{rng.random()}" for _ in range(3000)]
        cut = int(len(a) * share)
        b = a[:cut] + [f"v{rng.random()}" for _ in range(len(a) - cut)]
        sig = signatures([" ".join(a).encode(), " ".join(b).encode()], 512)
        x, y = brute_signature(" ".join(a)), brute_signature(" ".join(b))
        assert abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.07


def test_one_row_and_no_row(spark):
    one = edited_fingerprints(spark.createDataFrame([(5, "abcdef", "", 0, 0)], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert edited_fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    assert np.all(signatures([b""], 8) == 0xFFFF)
