import random

import numpy as np

from strandline.llm import language, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, score string"
WORDS = {"en": "the of and thing shall with from house water".split(), "de": "der und nicht schön straße über zwei kein".split(), "fr": "le été une être où garçon pas très".split()}


def corpus(seed, n=600):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choice(WORDS[lang]) for _ in range(rng.choice([3, 20, 200])))
        out.append((i, text, lang if i % 7 else None, "s", len(text), "x", "y"))
    return out


def test_languages_held_out(spark):
    rows = corpus(1) + [(9000, None, "en", "s", 0, "", ""), (9001, "", "en", "s", 0, "", ""), (9002, "12 ... 34", None, "s", 0, "", ""), (9003, "é", None, "s", 1, "", ""), (None, "the of and water", None, None, 1, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    held = language.held_out_fifth()
    net = language.learn(df, ~held, per_language=100)
    got = {r.doc_id: r for r in language.identify_languages(df, net, held).collect()}
    assert len(got) == len(rows) and set(net.languages) == set(WORDS)
    truth = {r[0]: r[2] for r in rows if r[2] and r[0] < 9000}
    tested = [i for i in truth if got[i].held_out]
    assert len(tested) > 50 and sum(got[i].lang_pred == truth[i] for i in tested) >= 0.97 * len(tested)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (9000, 9001, 9002)) and got[9003].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].lang_pred == "en" and got[None].held_out is False
    again = language.learn(df.repartition(5), ~held, per_language=100)
    assert all(np.array_equal(net.p[k], again.p[k]) for k in net.p)


def test_tables_give_what_the_layers_give():
    net = language.ByteConv(["a", "b"])
    x = np.random.default_rng(1).integers(0, 256, (5, language.WINDOW), dtype=np.uint8)
    e, parts = net.p["E"][x], []
    for w in language.WIDTHS:
        patches = np.concatenate([e[:, k : language.WINDOW - w + 1 + k] for k in range(w)], axis=2)
        parts.append(np.maximum((patches @ net.p[f"K{w}"] + net.p[f"b{w}"]).max(axis=1), 0))
    want = language._softmax(np.concatenate(parts, axis=1) @ net.p["W"] + net.p["c"])
    assert np.allclose(net.predict(x, net.tables(), piece=2), want, atol=1e-5)


def test_every_byte_lies_in_one_window():
    raw = [b"", b"a" * 255, b"b" * 256, b"c" * 257, b"d" * 1000]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    x, owner, held = language.windows(np.frombuffer(b"".join(raw), np.uint8), bounds)
    for d, r in enumerate(raw):
        assert b"".join(x[k, : held[k]].tobytes() for k in np.flatnonzero(owner == d)) == r


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None, "s", 3, "", "")], SCHEMA)
    held = language.held_out_fifth()
    assert language.learn(df, ~held) is None
    assert language.identify_languages(df, None, held).first().lang_pred == "und"
    assert language.identify_languages(df.limit(0), None, held).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.learn(df, labels)
    assert quality.quality_scores(df, model, quality.held_out_third()).first().score == 0.5
    assert quality.quality_scores(df.limit(0), model, quality.held_out_third()).collect() == []


def test_quality_held_out(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(sum(WORDS.values(), [])) for _ in range(rng.choice([20, 100]))]
        good = rng.random() < 0.8
        text = " ".join(words).capitalize() + "." if good else rng.choice([" ".join(words[:2] * 30), " ".join(w.upper() + "!!" for w in words), " ".join(w + "###" for w in words), " | ".join(words)])
        rows.append((i, text, "en", "s", len(text), "x", "y"))
        if i % 2:
            labels.append((i, int(good), 0, "z"))
    labels += [(5000, 1, 0, "z"), (None, 1, 0, "z"), (3, None, 0, "z")]
    rows += [(6000, None, None, None, None, None, None), (6001, "", "en", "s", 0, "", ""), (None, "Und nicht.", "de", "s", 3, "", "")]
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    held = quality.held_out_third()
    model = quality.learn(df, lab, ~held)
    got = {r.doc_id: r for r in quality.quality_scores(df, model, held).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    truth = {i: q for i, q, _, _ in labels if i is not None and i < 900 and q is not None and got[i].held_out}
    assert len(truth) > 90 and sum(got[i].predicted == q for i, q in truth.items()) >= 0.97 * len(truth)
    assert model.pairs and all(t.shape == (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1) for (i, j), t in zip(model.pairs, model.pair_tables))
    kept = {r.doc_id for r in quality.good_documents(df, model).collect()}
    assert kept == {i for i, r in got.items() if r.predicted} and quality.good_documents(df, model).columns == df.columns
    assert got[6000].score == got[6001].score


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.AdditiveModel().fit(x[:2000], y[:2000])
    assert (0, 1) in model.pairs and ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95


CLASH = "doc_id long, text string, lang string, _i string, _l string, _h string, _n string, _r string, _y string, _t string, l string, h string, t string, i string, y string, d string, r string, n string"


def clashing(rows, spark):
    """(id, text, lang) with columns named like those the operators use themselves, rows repeated, ties, nulls and a very long text."""
    rows = [*rows, *rows[:40], (rows[1][0], "another text of an id that repeats", rows[1][2]), (None, None, None), (7000, "the house and water " * 60_000, "en")]
    return spark.createDataFrame([(*r, *("x" for _ in range(15))) for r in rows], CLASH), rows


def test_languages_by_brute_force(spark, tmp_path):
    """The whole query: every text's prediction from the plain layers, window by window."""
    from strandline.llm import queries

    df, rows = clashing([(i, t, lang) for i, t, lang, *_ in corpus(2, 120)], spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    held = language.held_out_fifth()
    net = language.learn(df, ~held)
    twin = language.learn(df.repartition(6).orderBy("lang"), ~held)
    assert all(np.array_equal(net.p[k], twin.p[k]) for k in net.p)

    def predicted(text):
        raw = (text or "").encode()
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        total = np.zeros(len(net.languages))
        for s in range(0, len(raw), language.WINDOW):
            piece = raw[s : s + language.WINDOW]
            e = net.p["E"][np.frombuffer(piece.ljust(language.WINDOW, b"\0"), np.uint8)]
            parts = []
            for w in language.WIDTHS:
                patches = np.concatenate([e[k : language.WINDOW - w + 1 + k] for k in range(w)], axis=1)
                parts.append(np.maximum((patches @ net.p[f"K{w}"] + net.p[f"b{w}"]).max(axis=0), 0))
            z = np.concatenate(parts) @ net.p["W"] + net.p["c"]
            total += len(piece) * np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        return net.languages[int(total.argmax())], float(total.max() / total.sum())

    got = sorted(((r.doc_id, r.held_out, r.lang_pred, r.score) for r in queries.op5_language(spark, str(tmp_path)).collect()), key=str)
    import zlib

    want = sorted(((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0, *predicted(t)) for i, t, _ in rows), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-4)


def test_quality_by_brute_force(spark, tmp_path):
    """The whole query: the model is that of the labelled texts, and every score the sum of its looked-up values."""
    import zlib

    from strandline.llm import queries

    df, rows = clashing([(i, t if i % 3 else t.upper() + " ##!!" * 9, lang) for i, t, lang, *_ in corpus(5, 200)], spark)
    labels = [(i, int(i % 3 > 0), 0, "z") for i in range(0, 200, 2)] + [(4, 1, 0, "z"), (5000, 1, 0, "z"), (None, 1, 0, "z"), (8, None, 0, "z")]
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, i string").write.parquet(f"{tmp_path}/labels.parquet")
    third = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    one = lambda t: quality.features(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0]
    pairs = {(i, q) for i, q, _, _ in labels if i is not None and q is not None and not third(i)}
    learned = [(float(q), one(t)) for i, t, _ in rows for j, q in pairs if i == j]
    y, x = np.array([q for q, _ in learned]), np.array([f for _, f in learned])
    order = np.lexsort((*x.T, y))
    model = quality.AdditiveModel().fit(x[order], y[order])

    def score(f):
        z = model.base + sum(t[int(sum(c <= v for c in e))] for e, t, v in zip(model.edges, model.tables, f))
        for (a, b), t in zip(model.pairs, model.pair_tables):
            z += t[int(sum(c <= f[a] for c in model.coarse[a])), int(sum(c <= f[b] for c in model.coarse[b]))]
        return 1 / (1 + np.exp(-z))

    got = sorted(((r.doc_id, r.held_out, r.predicted, r.score) for r in queries.op6_quality(spark, str(tmp_path)).collect()), key=str)
    want = sorted(((i, third(i), int(score(one(t)) >= 0.5), float(score(one(t)))) for i, t, _ in rows), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-9)
