import hashlib
import random
from collections import defaultdict

import pytest

from strandline.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id long, text string, lang string, k1 string"


def brute(docs, length=200):
    seen = defaultdict(int)
    raw = [(t or "").encode() for _, t in docs]
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for (doc_id, _), b in zip(docs, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, None, "x") for i, t in docs], SCHEMA)
    return sorted((tuple(r) for r in suffix_dedup(df, **kw).collect()), key=str)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 8))) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    rng = random.Random(seed)
    shared = [words(rng, n) for n in (30, 45, 80, 200)]
    docs = []
    for i in range(60):
        parts = [words(rng, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            cut = rng.randint(0, 40)
            s = s[cut : len(s) - rng.randint(0, 40)]
            if rng.random() < 0.5:
                at = rng.randint(0, len(s))
                s = s[:at] + rng.choice("xyz") + s[at:]
            parts += [s, words(rng, rng.randint(0, 30))]
        docs.append((i, "".join(parts)))
    docs += [(3, docs[3][1]), (3, docs[3][1]), (None, docs[5][1]), (100, None), (101, ""), (102, "a" * 500), (103, "ab" * 300), (104, "x" * 200), (105, words(rng, 5) * 40)]
    assert run(spark, docs) == brute(docs)


def test_lengths_around_the_threshold(spark):
    rng = random.Random(9)
    for n in (199, 200, 201):
        s = "".join(rng.choices("abcdefgh", k=n))
        docs = [(1, "Q" + s + "R"), (2, "S" + s + "T"), (3, s[:100])]
        assert run(spark, docs) == brute(docs)


def test_long_text_over_several_pieces(spark, monkeypatch):
    rng = random.Random(4)
    big = "".join(rng.choices("abcdefgh ", k=1_200_000))
    docs = [(1, big), (2, big[500_000:560_000]), (3, big[524_000:525_000])]
    got = {r[0]: r for r in run(spark, docs)}
    assert got[1][2] == 60_000 and got[2][2] == 60_000 and got[3][2] == 1000
    assert got[1][4] == hashlib.sha256((big[:500_000] + big[560_000:]).encode()).hexdigest()


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("a,b", [("!", "/"), (" ", '"'), ("a", "b")])
def test_thue_morse(spark, a, b):
    """Strings of 128 bytes that are each other's complement differ, however alike they are built."""
    rng = random.Random(3)
    head, tail = ("".join(rng.choices("abcdefgh", k=n)) for n in (200, 400))
    docs = [(1, head + thue_morse(128, a, b) + tail), (2, head + thue_morse(128, b, a) + tail)]
    got = run(spark, docs)
    assert got == brute(docs) and [r[2:4] for r in got] == [(600, 2), (600, 2)]


def test_structured_texts(spark):
    """Periodic texts, Thue-Morse texts with one changed letter, and pieces of them at all kinds of shifts."""
    rng = random.Random(8)
    docs = []
    for i in range(30):
        base = rng.choice([thue_morse(1024, "x", "y"), "abc" * 300, "ab" * 99 + "c" + "ab" * 150, "\n" * 450, thue_morse(512, "0", "1") + thue_morse(512, "1", "0")])
        cut = rng.randint(0, 300)
        text = base[cut : cut + rng.randint(180, 700)]
        at = rng.randint(0, len(text) - 1)
        docs.append((i, text if rng.random() < 0.3 else text[:at] + rng.choice("xyab#") + text[at + 1 :]))
    assert run(spark, docs) == brute(docs)


@pytest.mark.parametrize("length", [96, 143, 300])
def test_other_lengths(spark, length):
    rng = random.Random(length)
    base = words(rng, 400)
    docs = [(i, base[(s := rng.randint(0, 900)) : s + rng.randint(80, 900)] + words(rng, 9)) for i in range(20)]
    assert run(spark, docs, length=length) == brute(docs, length)


def test_ranks_are_equal_for_equal_bytes_only():
    import numpy as np

    from strandline.llm.ranks import Ranks, octets

    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(97, 99, 3000, dtype=np.uint8), np.frombuffer(b"ab" * 800, np.uint8)])
    family = Ranks.get(7)
    raw = data.tobytes()
    for size in (8, 16, 32, 64):
        ranks = family.doubled(octets(data), 8, size)
        assert len(ranks) == len(data) - size + 1
        pieces = [raw[i : i + size] for i in range(len(ranks))]
        assert len(set(zip(pieces, ranks.tolist()))) == len(set(pieces)) == len(set(ranks.tolist()))


def test_empty_table(spark):
    assert run(spark, []) == []
