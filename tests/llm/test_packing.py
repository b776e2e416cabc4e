import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from strandline.llm import queries
from strandline.llm._common import vocab_path
from strandline.llm.packing import pack, pack_documents, step_groups

SCHEMA = "doc_id long, text string, lang string, length string, tier string"


def check(rows, texts):
    tok = Tokenizer.from_file(vocab_path())
    ids = {d: np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for d, t in texts.items()}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length, r.tier, r.step_group))
    for d, own in ids.items():
        at = 0
        for s, n in sorted(pieces[d]):
            assert s == at and n > 0
            at += n
        assert at == len(own)
    for w in windows.values():
        at = 0
        for o, n, _, _ in sorted(w):
            assert o == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0 and at == w[0][2]


def test_round_trip_with_tokenizers_ids(spark):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choice(["the", "öl", "wh,", "12", "don't", "\n\n", "𝔘"]) for _ in range(rng.choice([0, 1, 30, 200, 900, 5000]))) for i in range(120)}
    texts |= {500: None, 501: "", 502: "<|endoftext|> x" * 400, 503: "z" * 30_000, 504: "a <|endoftext|> b", 505: "x" + " " * 2_000_000 + "y", 506: "\n" * 1_100_000, None: "null id"}
    df = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in texts.items()], SCHEMA).repartition(3)
    check(pack_documents(df).collect(), texts)
    check(pack_documents(df, buffer_tokens=3000).collect(), texts)


def test_packing_is_full_and_groups_are_balanced():
    rng = random.Random(1)
    windows, left = pack([(i, rng.randint(1, 5000)) for i in range(500)], last=False)
    assert all(sum(p[0] for p in ps) == t for t, ps in windows)
    tail, none = pack([], left=left)
    assert not none and all(sum(p[0] for p in ps) == t and t & (t - 1) == 0 for t, ps in tail)
    groups = defaultdict(int)
    big = [w for w in windows if w[0] == 2048]
    for (_, ps), g in zip(big, step_groups(big, 65_536)):
        groups[g] += sum(p[0] ** 2 for p in ps)
    assert max(groups.values()) < 1.5 * min(groups.values())


def test_other_files_are_left_to_tokenizers(tmp_path):
    """The fast path is taken only where the file's normaliser, splitting, merges and added tokens are what it assumes."""
    import json

    from strandline.llm.tokens import Encoder, is_plain

    with open(vocab_path(), encoding="utf-8") as f:
        file = json.load(f)
    assert is_plain(file)
    changes = [
        {"normalizer": {"type": "Lowercase"}},
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}},
        {"added_tokens": [{**file["added_tokens"][0], "lstrip": True}]},
        {"model": {**file["model"], "ignore_merges": True}},
    ]
    text = "Two  WORDS and <|endoftext|> don't"
    for i, change in enumerate(changes):
        path = f"{tmp_path}/{i}.json"
        with open(path, "w", encoding="utf-8") as f:
            json.dump({**file, **change}, f)
        assert not is_plain({**file, **change})
        assert Encoder(path).ids(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c", "en", "", "")] * 3, SCHEMA)
    assert sum(r.length for r in pack_documents(df).collect()) == 3 * 4
    assert pack_documents(df.limit(0)).collect() == []


def test_query_splits_at_added_tokens(spark, tmp_path):
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>\n\n <|endoftext", "plain"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tok = Tokenizer.from_file(vocab_path())
    ids = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in ids[0]
    packed, counted = queries.op2_packing(spark, str(tmp_path)).collect(), queries.op10_token_counts(spark, str(tmp_path)).collect()
    stage = corpus_pipeline.packing_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    for i, own in enumerate(ids):
        want = np.array([*own, 1], "<u4")
        for rows in (packed, stage):
            mine = [r for r in rows if r.doc_id == i]
            assert all(r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].tobytes()) for r in mine)
        assert {r.doc_tokens for r in counted if r.doc_id == i} == {len(own)}
