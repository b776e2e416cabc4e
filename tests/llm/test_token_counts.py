import random

import pytest
from tokenizers import Tokenizer

from strandline.llm._common import vocab_path
from strandline.llm.token_counts import token_counts


def brute(text, sections, rule):
    """Token byte spans from the tokenizer's own offsets-free pieces; counts by section index, -1 for none."""
    tok = Tokenizer.from_file(vocab_path())
    from strandline.llm.tokens import encoder

    size = encoder(vocab_path()).size
    at, out, total = 0, {}, 0
    chars = [0]
    for c in text:
        chars.append(chars[-1] + len(c.encode()))
    owner = [-1] * chars[-1]
    for i, (_, s, e) in sorted(enumerate(sections), key=lambda x: (x[1][1], x[0])):
        for b in range(chars[min(s, len(text))], chars[min(e, len(text))]):
            if owner[b] == -1:
                owner[b] = i
    # pieces: maximal runs of one owner
    for t in tok.encode(text, add_special_tokens=False).ids:
        span = range(at, at + int(size[t]))
        at += int(size[t])
        total += 1
        runs = []
        for b in span:
            if runs and runs[-1][0] == owner[b]:
                runs[-1][1] += 1
            else:
                runs.append([owner[b], 1])
        own = runs[0][0] if rule == "start" else runs[-1][0] if rule == "end" else max(runs, key=lambda r: r[1])[0]
        out[own] = out.get(own, 0) + 1
    return out, total


def text(rng, n):
    return "".join(rng.choice(["the ", "öl", "wh,", "12", "\n", "\n\n", "𝔘 ", "don't ", "     "]) for _ in range(n))


@pytest.mark.parametrize("rule", ["majority", "start", "end"])
def test_sections_against_brute_force(spark, rule):
    rng = random.Random(7)
    rows = []
    for i in range(40):
        t = text(rng, rng.randint(0, 80))
        cuts = sorted(rng.randint(0, len(t) + 3) for _ in range(6))
        rows.append((i, t, [("a", cuts[0], cuts[1]), ("b", cuts[1], cuts[2]), ("c", cuts[4], cuts[5])][: rng.randint(0, 3)], "extra"))
    df = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<name:string,start:int,end:int>>, n_tokens string")
    got = {}
    for r in token_counts(df, "parts", rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.n_tokens, r.doc_tokens)
    for i, t, parts, _ in rows:
        want, total = brute(t, parts, rule)
        mine = got.get(i, {})
        assert {k: v[0] for k, v in mine.items() if v[0]} == want
        assert all(v[1] == total for v in mine.values())


def test_lines(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, 50)) for i in range(20)] + [(100, None), (101, ""), (102, "\n"), (3, "a\nb"), (3, "a\nb"), (205, "a <|endoftext|> b\nc"), (206, "a" + " " * 1_200_000 + "b"), (None, "x" * 100_000 + "\n" + "y " * 50_000)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    tok = Tokenizer.from_file(vocab_path())
    for i, t in rows:
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)
        lines = (t or "").splitlines(keepends=True) if t else [""]
        if i == 3:
            continue
        assert [(r.start_char, r.end_char) for r in own] == [(sum(map(len, lines[:k])), sum(map(len, lines[: k + 1]))) for k in range(len(lines))]
        assert sum(r.n_tokens for r in own) == len(tok.encode(t or "", add_special_tokens=False).ids)
    alone = len(rows[3][1].splitlines(keepends=True)) or 1
    assert sum(r.doc_id == 3 for r in got) == alone + 2 * 2


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
