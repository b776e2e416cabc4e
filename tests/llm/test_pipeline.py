import random
from collections import Counter

import corpus_pipeline as p
from strandline.llm.jaccard_join import jaccard_join
from strandline.llm.secret_scan import secret_scan

WORDS = "the of and thing shall with from house water over under again".split()


def corpus(tmp_path, spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.85
        words = [rng.choice(WORDS) + str(rng.randint(0, 200)) for _ in range(rng.choice([30, 80]))]
        text = " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(good), 0))
    clean = [r for r, lab in zip(rows, labels) if lab[1]]
    rows += [(1000 + k, r[1], "en", r[3], r[4]) for k, r in enumerate(clean[:40])]
    rows += [(2000, clean[0][1] + " password=abcdefgh", "en", "s9", 9), (2001, None, None, None, None), (2002, "", "en", "s1", 0), rows[0], (None, "Some words without an id here.", None, "s2", 4)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, labels


def test_stages(spark, tmp_path):
    d, rows, labels = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, outputs = docs.columns, []
    for i, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/out{i}")
        docs = spark.read.parquet(f"{d}/out{i}")
        if i < len(p.STAGES) - 1:
            assert docs.columns == columns, name
        outputs.append(docs)
    good = {i for i, q, _ in labels if q}
    assert {r.doc_id for r in outputs[0].collect() if r.doc_id is not None and r.doc_id < 400} == good
    groups = jaccard_join(outputs[0]).collect()
    assert Counter(r.doc_id for r in outputs[1].collect()) == Counter({g: 1 for g in {r.class_id for r in groups}})
    assert {r.doc_id for r in outputs[2].collect()} == {r.doc_id for r in outputs[1].collect()}
    assert sum(r.n_assign + r.n_access + r.n_hex for r in secret_scan(outputs[2]).collect()) == 0
    mixed = Counter(r.doc_id for r in outputs[3].collect())
    assert mixed and max(mixed.values()) <= 3
    pieces = outputs[4].groupBy("sequence_id").sum("length").collect()
    assert pieces and all(r[1] <= 2048 for r in pieces)
    assert p.run(spark, d).groupBy("doc_id").count().count() == len(mixed)


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert p.run(spark, d).count() == 0
