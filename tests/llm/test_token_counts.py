import random

import numpy as np
import pytest
import regex

from scenewright.llm import token_counts as tc

MODEL = tc.unigram(tc.default_path())


def plain(word, model=MODEL):
    best = [(0.0, 0)] + [None] * len(word)
    for j in range(1, len(word) + 1):
        options = [(best[i][0] + model.log_p[word[i:j]], best[i][1] + 1) for i in range(max(0, j - model.longest), j) if word[i:j] in model.log_p]
        best[j] = max(options, key=lambda o: (o[0], -o[1]))
    return best[-1]


def check(words, model=MODEL):
    score, count = model.forward(words)
    for w, s, c in zip(words, score, count, strict=True):
        want = plain(w, model)
        assert abs(s - want[0]) < 1e-9 and c == want[1], w


@pytest.mark.parametrize("narrow", [0, 6, 10**9])
def test_forward_scores(monkeypatch, narrow):
    monkeypatch.setattr(tc, "NARROW", narrow)
    rng = random.Random(3)
    words = {b"", b"a", b" the", b"theth", "ñandú漢字".encode(), b"a" * 700, bytes(range(256))}
    while len(words) < 400:
        words.add("".join(rng.choices(["the", "re", "in", "é", "x", "ing", "0"], k=rng.randrange(1, 7))).encode())
    check(sorted(words, key=lambda w: hash(w)))


def test_other_probabilities():
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b"cd", b"bcd"]
    check([b"abcd", b"abcdabcd", b"xabcx", b"dcba"], tc.Unigram(pieces, np.array([-5.0] * 256 + [-3.0, -7.0, -4.0, -3.0])))
    with pytest.raises(ValueError):
        tc.Unigram(pieces[1:], np.zeros(len(pieces) - 1))


def test_agrees_with_the_tokenizers_library():
    from tokenizers import Tokenizer, models

    pieces = [chr(c) for c in range(97, 123)] + ["th", "the", "he", "re", "there", "in", "ing"]
    log_p = [-6.0 - 0.01 * k for k in range(26)] + [-3.1, -2.9, -3.3, -3.7, -6.2, -3.05, -3.9]
    truth = Tokenizer(models.Unigram([("<u>", -99.0), *zip(pieces, log_p, strict=True)], 0))
    model = tc.Unigram([bytes([b]) for b in range(256) if not 97 <= b < 123] + [p.encode() for p in pieces], np.array([-50.0] * 230 + log_p))
    rng = random.Random(1)
    words = ["".join(rng.choices(["the", "re", "in", "g", "h", "t"], k=rng.randrange(1, 9))) for _ in range(200)]
    assert model.forward([w.encode() for w in words])[1].tolist() == [len(truth.encode(w).ids) for w in words]


def test_query(spark):
    rows = {r.doc_id: r for r in tc.op2_token_counts(spark, "/root/testdata/sf0.001").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert set(rows) == set(docs)
    known = {}
    for d, t in docs.items():
        pre = regex.findall(tc.PATTERN, t)
        for p in pre:
            if p not in known:
                known[p] = plain(p.encode())
        assert rows[d].n_pretokens == len(pre) and rows[d].n_tokens == sum(known[p][1] for p in pre)
        assert abs(rows[d].score - sum(known[p][0] for p in pre)) < 1e-6


def test_edges(spark, monkeypatch):
    df = spark.createDataFrame([(1, None, 5), (1, "", 6), (None, "the the", 7), (2, "x" * 30_000, 8), (2, "x" * 30_000, 8)], "doc_id long, text string, n_tokens int")
    got = sorted([tuple(r)[:3] for r in tc.count(df).collect()], key=repr)
    assert got[:2] == [(1, 0, 0), (1, 0, 0)] and got[2] == got[3] and (None, 2, 2) in got
    assert tc.count(df.limit(0)).collect() == []
