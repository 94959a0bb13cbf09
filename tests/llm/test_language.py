import numpy as np
import pyarrow as pa
import zlib

from scenewright.llm import language
from scenewright.llm._text import column_bytes

SF = "/root/testdata/sf0.01"


def slow_counts(text):
    cls = [b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in text.encode()]
    out = np.zeros(language.DIMS)
    for k in range(len(cls) - 2):
        a, b, c = cls[k : k + 3]
        if (a, b) == (32, 32) or (b, c) == (32, 32):
            continue
        h = a
        for x in (b, c):
            h = (h * 0x01000193 & 0xFFFFFFFF) ^ x
        out[(h * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
    return out


def test_trigram_counts(monkeypatch):
    texts = ["", "a", "ab", "abc", "The  cat, çà!\n" * 30, "ñ", "x" * 500, "", "zz zz zz"]
    buf, offsets = column_bytes(pa.array(texts))
    want = np.array([slow_counts(t) for t in texts])
    assert (language.trigrams(buf, offsets) == want).all()
    from scenewright.llm import _text

    monkeypatch.setattr(_text, "SEGMENT", 7)
    assert (language.trigrams(buf, offsets) == want).all()


def test_against_plain_em(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    model = language.train(docs)
    names = sorted(model)
    p = np.array([model[n][:-1] + 0.1 for n in names])
    p /= p.sum(1, keepdims=True)
    rows = {r.doc_id: r for r in language.predict(docs, model).collect()}

    def em(c, allowed):
        pi = np.array([1 / len(allowed) if j in allowed else 0.0 for j in range(len(names))])
        for _ in range(language.ROUNDS):
            pi = pi * (p @ (c / (pi @ p))) / c.sum()
        return pi, c @ np.log(pi @ p)

    for r in docs.collect():
        c = slow_counts(r.text)
        price = language.PENALTY * 0.5 * np.log(c.sum())
        best = max((c @ np.log(p[j]), [float(j == k) for k in range(len(names))]) for j in range(len(names)))
        full = em(c, range(len(names)))[0]
        order = np.argsort(-full, kind="stable")
        for size in range(2, len(names) + 1):
            pi, like = em(c, set(order[:size].tolist()))
            if like - price * (size - 1) > best[0]:
                best = (like - price * (size - 1), pi.tolist())
        got = {x.lang: x.share for x in rows[r.doc_id].languages}
        want = {n: v for n, v in zip(names, best[1], strict=True) if v > 0}
        assert rows[r.doc_id].lang_pred == names[int(np.argmax(best[1]))]
        if set(got) == set(want):
            assert all(abs(got[k] - want[k]) < 2e-3 for k in want)
        else:
            assert sum(abs(got.get(n, 0) - want.get(n, 0)) for n in names) < 0.02


def test_a_mixed_text_has_both_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    long = {r.lang: r.text for r in docs.filter("n_chars between 1500 and 2500").collect()}
    df = spark.createDataFrame([(1, long["de"][:1400] + "\n" + long["es"][:1000])], "doc_id long, text string")
    got = language.predict(df, model).collect()[0]
    assert {x.lang for x in got.languages} == {"de", "es"} and got.lang_pred == "de" and 0.4 < got.score < 0.75


def test_query(spark):
    rows = language.op4_language_mixture(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.96


def test_edges(spark):
    schema = "doc_id long, lang string, text string, score int"
    learn = spark.createDataFrame([(1, "aa", "ka la ma ka la ma", 1), (2, "bb", "xo yo zo xo yo zo", 1), (3, None, "qq", 1), (4, "aa", None, 2)], schema)
    model = language.train(learn)
    assert set(model) == {"aa", "bb"}
    df = spark.createDataFrame([(1, None, None, 1), (1, None, "", 1), (None, "x", "12 +!", 2), (5, "x", "é", 3), (6, "x", "ka la", 3), (6, "x", "漢字 漢字", 3), (7, "x", "xo yo " * 100_000, 1)], schema)
    got = [(r.doc_id, r.lang_pred) for r in language.predict(df, model).collect()]
    assert sorted(got, key=repr) == sorted([(1, "und"), (1, "und"), (None, "und"), (5, "aa"), (6, "aa"), (6, got[5][1]), (7, "bb")], key=repr)
    assert {r.score for r in language.predict(df, model).filter("lang_pred = 'und'").collect()} == {0.0}
    assert language.predict(df.limit(0), model).collect() == [] and language.train(df.limit(0)) == {}
    assert {r.lang_pred for r in language.predict(df, {}).collect()} == {"und"}
