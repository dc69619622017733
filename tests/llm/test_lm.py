"""The language model against a plain one over dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quire.llm import lm


def plain(docs):
    """{doc_id: (n_tokens, n_known, N, base, score)} by the definitions, without arrays."""
    toks = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"] for i, t in docs}
    train = [toks[i] for i, _ in docs if zlib.crc32(str(i).encode()) % 10]
    uni = Counter(w for t in train for w in t)
    n, v = sum(uni.values()), len(uni)
    two = Counter(p for t in train for p in zip([None, *t], t, strict=False))
    a, total, kinds = Counter(), Counter(), defaultdict(Counter)
    for (x, y), c in two.items():
        a[y] += 1
        total[x] += c
        kinds[x][min(c, 3)] += 1
    disc = lambda cs: lm.discounts([sum(c == k for c in cs) for k in (1, 2, 3, 4)])
    d1, d2 = disc(list(a.values())), disc(list(two.values()))
    left = sum(d1[min(c, 3) - 1] for c in a.values()) / len(two) if two else 1.0

    def p1(w):
        return (max(a[w] - d1[min(a[w], 3) - 1], 0) / len(two) if a[w] else 0) + left / (v + 1)

    def p2(w, x):
        if not total[x]:
            return p1(w)
        c = two[x, w]
        g = sum(d2[k - 1] * m for k, m in kinds[x].items()) / total[x]
        return (max(c - d2[min(c, 3) - 1], 0) / total[x] if c else 0) + g * p1(w)

    out = {}
    for i, t in toks.items():
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        out[i] = (len(t), sum(uni[w] > 0 for w in t), n, base, sum(math.log10(p2(w, x)) for x, w in zip([None, *t], t, strict=False)))
    # the probabilities of all words and an unseen one add up to 1
    for x in [None, *list(uni)[:20], "never seen"]:
        assert sum(p2(w, x) for w in [*uni, "never seen"]) == pytest.approx(1)
    return out


def test_equals_plain_model(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(150)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(9001, None), (9002, ""), (9003, "The the THE zz" * 50), (9004, "İstanbul é É x\x0by")]
    got = {r.doc_id: r for r in lm.score_held_out(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain(rows)
    assert len(got) == len(rows)
    for i, (n, known, total, base, score) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, zlib.crc32(str(i).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_better_than_base_on_held_out_text(spark, data):
    rows = lm.score_held_out(spark.read.parquet(f"{data}/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_held_out(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b", 1), (None, None, 2)], "doc_id long, text string, n_tokens int")
    assert sorted((r.n_tokens, r.held_out, r.base_score, r.score) for r in lm.score_held_out(rows).collect()) == [(1, True, 0.0, 0.0), (3, True, 0.0, 0.0)]
