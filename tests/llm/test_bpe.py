import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scenewright.llm import bpe

PATH = bpe.default_path()
TRUTH = Tokenizer.from_file(PATH)
ENCODER = bpe.Encoder(bpe.vocabulary(PATH))


def agree(texts):
    ids, counts = ENCODER.encode(texts)
    ends = np.cumsum(counts)
    mine = [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)]
    theirs = [e.ids for e in TRUTH.encode_batch(texts, add_special_tokens=False)]
    for t, a, b in zip(texts, mine, theirs, strict=True):
        assert a == b, t
    assert [x.decode() for x in ENCODER.decode(ids, counts)] == [TRUTH.decode(x, skip_special_tokens=False) for x in theirs]


def test_edges():
    agree(["", " ", "aaaaaaaaaaaaaaaaaaaa", "a" * 5000, "<|endoftext|>", "x<|endoftext|><|endoftext|> y <|endoftext", "I'll we've  \n\n  tabs\t\tx", "ñandú çà ß 漢字 🙂🙂", "\x1c\x1d \x85  　x", " " * 300, "1234567890" * 50, "the theth " * 500])


def test_all_characters():
    agree([" ".join(f"x{chr(c)}{chr(c)}y {chr(c)}" for c in range(a, min(a + 500, 0x30000)) if not 0xD800 <= c < 0xE000) for a in range(0, 0x30000, 500)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=8))
def test_random(texts):
    agree(texts)


def test_malformed_ids_decode_as_the_library_does():
    v = bpe.vocabulary(PATH)
    rng = np.random.default_rng(1)
    for _ in range(50):
        ids = rng.integers(0, len(v.piece_len), 20)
        assert ENCODER.decode(ids, np.array([20]))[0].decode() == TRUTH.decode(ids.tolist(), skip_special_tokens=False)


def test_order_of_merges_is_checked(tmp_path):
    import json

    spec = json.load(open(PATH))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "v.json"))


def test_query_over_the_table(spark):
    rows = bpe.op7_bpe(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = TRUTH.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_rows_of_all_kinds(spark):
    schema = "doc_id long, token_ids string, text string, ids_sha256 int"
    df = spark.createDataFrame([(1, "x", None, 1), (1, None, "", 2), (None, "y", "a a", 3), (2, "", "longword" * 50_000, 4)], schema)
    out = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.digests(df).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (1, 0, empty) in out and len(out) == 3
    full = bpe.encode(df)
    assert sorted(full.columns) == sorted(df.columns)
    assert {len(r.token_ids) for r in full.collect() if not r.text} == {0}
    assert bpe.digests(df.limit(0)).collect() == [] and bpe.encode(df.limit(0)).collect() == []
