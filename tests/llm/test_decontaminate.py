import random
import re

import numpy as np
import pyarrow as pa
import pytest

from scenewright.llm import decontaminate

SF = "/root/testdata/sf0.01"


def plain_words(text):
    return [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]


def plain_distance(item, text):
    """The least edits between the item and any stretch of the text: a whole table of distances."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for k, x in enumerate(item, 1):
            new.append(min(row[k - 1] + (x != w), row[k] + 1, new[k - 1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def brute_force(docs, items):
    out = []
    for d, text in docs:
        words = plain_words(text)
        for i, t in items:
            item = plain_words(t)
            most = int(0.2 * len(item) + 1e-9)
            if len(item) >= decontaminate.LEAST_WORDS and len(words) >= len(item) - most and (e := plain_distance(item, words)) <= most:
                out.append((d, i, e, len(item)))
    return sorted(out, key=repr)


def words_hashed(text):
    return next(w for _, _, w, _ in decontaminate.words_of(pa.array([text])))


def edited(rng, words, edits, new):
    x = list(words)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(x))
        if kind == 0:
            x[at] = new()
        elif kind == 1:
            x.insert(at, new())
        else:
            del x[at]
    return x


def test_distance_is_exact():
    rng = random.Random(4)
    for _ in range(300):
        item, text = ([rng.choice("abcd") for _ in range(rng.randrange(1, 90))] for _ in range(2))
        items = decontaminate.Items([0], [" ".join(item)])
        assert items.distance(0, words_hashed(" ".join(text))) == plain_distance(item, text)


def hits(items, text):
    return {k: e for _, _, w, at in decontaminate.words_of(pa.array([" ".join(text)])) for _, k, e, _ in items.matches(w, at)}


def spread(rng, words, edits, new, how):
    """So many edits: anywhere and of any kind, or substitutions at even distances."""
    if how == "anywhere":
        return edited(rng, words, edits, new)
    x = list(words)
    for k in range(edits):
        x[(2 * k + 1) * len(x) // (2 * edits)] = new()
    return x


@pytest.mark.parametrize("size", range(1, 5))
def test_items_too_short_for_edits_are_all_found(size):
    rng = random.Random(size)
    new = lambda: "".join(rng.choices("abcdefghij", k=4))
    texts = [" ".join(new() for _ in range(size)) for _ in range(60)]
    items = decontaminate.Items(list(range(60)), texts, least_words=1)
    for i, t in enumerate(texts):
        text = [new() for _ in range(20)] * (i % 3 > 0) + t.split() + [new() for _ in range(20)] * (i % 3 > 1)
        assert hits(items, text).get(i) == 0


@pytest.mark.parametrize("how", ["anywhere", "evenly"])
@pytest.mark.parametrize("sizes", [(5, 5), (6, 9), (10, 14), (15, 30), (31, 60), (61, 200), (300, 350)])
def test_recall_at_the_largest_distance(sizes, how):
    rng = random.Random(sizes[0])
    new = lambda: "".join(rng.choices("abcdefghij", k=4))
    m = 60 if sizes[0] < 60 else 10
    texts = [" ".join(new() for _ in range(rng.randint(*sizes))) for _ in range(m)]
    items, found = decontaminate.Items(list(range(m)), texts), 0
    for i, t in enumerate(texts):
        words = t.split()
        assert hits(items, words).get(i) == 0
        text = [new() for _ in range(20)] * (i % 3 > 0) + spread(rng, words, int(0.2 * len(words) + 1e-9), new, how) + [new() for _ in range(20)] * (i % 3 > 1)
        got = hits(items, text)
        assert i not in got or got[i] == plain_distance(words, text)
        found += i in got
    assert found >= decontaminate.TARGET * m


def test_items_with_common_words_against_brute_force(spark):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choices("abcde", k=rng.randrange(1, 15)))) for i in range(40)]
    docs = [(d, " ".join(rng.choices("abcdefgh", k=rng.randrange(0, 30)))) for d in range(60)]
    want = {(d, i, e, len(t.split())) for d, x in docs for i, t in items if (e := plain_distance(t.split(), x.split())) <= int(0.2 * len(t.split()) + 1e-9)}
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r)[:4] for r in decontaminate.matches(df, bench, least_words=1).collect()}
    assert {g[:2] for g in got} <= {w[:2] for w in want} and len(got & want) >= decontaminate.TARGET * len(want) > 140
    left = sorted(r.doc_id for r in decontaminate.clean(df, bench, least_words=1).collect())
    assert left == sorted({d for d, _ in docs} - {g[0] for g in got})


def test_embedding_keeps_near_sequences_near():
    """Steps in which two walks differ: few for a few edits, most for other sequences."""
    rng = np.random.default_rng(2)
    near, far = [], []
    for _ in range(100):
        x = rng.integers(1, 2**63, 60, dtype=np.uint64)
        y = np.delete(x, 3)
        emitted = []
        for s in (x, y, rng.permutation(x)):
            bits, at, out = decontaminate.mix(s ^ decontaminate._SEED[0]), 0, []
            for j in range(50):
                out.append(s[at])
                at += int(bits[at] >> np.uint64(j)) & 1
            emitted.append(np.array(out))
        near.append((emitted[0] != emitted[1]).mean())
        far.append((emitted[0] != emitted[2]).mean())
    assert np.mean(near) < 0.5 < 0.9 < np.mean(far)


def test_query_against_brute_force(spark):
    """Every short document against every item, by the distance that test_distance_is_exact holds."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 1500").collect()]
    rows = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    items, small = decontaminate.Items([r.item_id for r in rows], [r.text for r in rows]), {d for d, _ in docs}
    got = sorted((tuple(r)[:4] for r in decontaminate.op6_decontaminate(spark, SF).collect() if r.doc_id in small), key=repr)
    want = []
    for d, t in docs:
        words = words_hashed(t or "")
        for k, own in enumerate(items.words):
            most = int(0.2 * len(own) + 1e-9)
            if len(own) >= decontaminate.LEAST_WORDS and len(words) >= len(own) - most and (e := items.distance(k, words)) <= most:
                want.append((d, items.ids[k], e, len(own)))
    assert got == sorted(want, key=repr) and len(got) > 5


def test_edges(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, item.upper().replace(" ", ",\n"), "x"), (1, f"zero {item} eleven", "x"), (None, item, None), (2, None, "x"), (3, "", "x"), (4, "one two three", "x"), (5, "one two three four zz five six seven eight nine ten", "x"), (6, "word " * 200_000 + item, "x"), (7, "one two three four aa bb cc eight nine ten", "x"), (8, "short item", "x")]
    items = [(1, item), (2, None), (3, ""), (4, "short item"), (1, item), (5, "word word word word word word")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = brute_force([d[:2] for d in docs if d[0] != 6], items) + [(6, 1, 0, 10)] * 2 + [(6, 5, 0, 6)]
    for limit in (decontaminate.ITEM_BYTES, 30):
        got = sorted((tuple(r)[:4] for r in decontaminate.matches(df, bench, item_bytes=limit).collect()), key=repr)
        assert got == sorted(plain, key=repr)
        kept = decontaminate.clean(df, bench, item_bytes=limit)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 7, 8]
    assert decontaminate.matches(df.limit(0), bench).collect() == [] and decontaminate.matches(df, bench.limit(0)).collect() == []
    assert decontaminate.clean(df, bench.limit(0)).count() == len(docs)
