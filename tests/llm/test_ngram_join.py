import random
import re

import numpy as np
import pytest

from scenewright.llm import ngram_join
from scenewright.operators.components import components

SF = "/root/testdata/sf0.01"


def plain_sets(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_force(rows):
    sets = [plain_sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    seen = set()
    for members in where.values():
        for k, i in enumerate(members):
            for j in members[:k]:
                if root(i) != root(j) and (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                        parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, set_id string, n_shingles int")
    return sorted(map(tuple, ngram_join.join(df, **options).collect()), key=repr)


def test_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, ngram_join.op8_ngram_jaccard(spark, SF).collect()), key=repr) == brute_force(rows)


def near_copies(seed, n, words=60, most=12):
    """Texts around a few bases, many of them close to the threshold, with shared passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    bases = [[word() for _ in range(words)] for _ in range(6)]
    hot = [word() for _ in range(15)]
    rows = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.randrange(most)):
            at = rng.randrange(len(text))
            text[at : at + rng.choice([0, 1, 1, 2])] = [word() for _ in range(rng.choice([0, 1, 1, 2]))]
        if rng.random() < 0.3:
            text[rng.randrange(words // 2) : 0] = hot
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("options", [{}, {"short": 2}, {"short": 2, "hot": 8, "piece": 7, "bits": 1 << 18}, {"short": 6, "hot": 3, "piece": 50, "bits": 64}])
def test_near_the_threshold(spark, options):
    """With long lists, shingles in several buckets, lists in pieces, and more sets than the bitmap is for."""
    rows = near_copies(len(options), 300)
    assert run(spark, rows, **options) == brute_force(rows)


def test_rows_without_an_id_or_with_the_same_one(spark):
    """Rows link by their texts alone; a null id is followed like any other, and never names a component."""
    rng = random.Random(1)
    base = [f"w{k}" for k in range(60)]
    swap = lambda *at: " ".join("other" + str(k) if k in at else w for k, w in enumerate(base))
    chain = [(9, swap(0, 59)), (None, swap(0)), (1, swap(1, 0)), (4, swap(0, 1, 2)), (None, swap(0))]
    rows = [*chain, (3, "a b c d e f g"), (3, "q r s t u v w"), (2, "a b c d e f g"), (8, "q r s t u v w"), (None, "only null ids here now x"), (None, "only null ids here now x")]
    rng.shuffle(rows)
    assert run(spark, rows) == brute_force(rows) == run(spark, rows, short=1, hot=1, piece=1, bits=8)
    got = {r[0]: r[2] for r in run(spark, rows)}
    assert got[2] == 2 and got[8] == 3 and got[9] == got[4] == got[1] == 1


def test_short_texts_and_other_cases(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("ab", k=rng.randrange(9)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\n\x0b\x0c\r"), (203, "A b C D e f"), (204, "a B c d E F"), (204, "a B c d E F"), (None, "a b c d e f"), (None, "q r s t u v"), (205, "word " * 100_000), (206, "word " * 90_000), (207, "a b c d e"), (208, "é É")]
    assert run(spark, rows) == brute_force(rows)
    assert run(spark, []) == []


def test_prefix_matches_hold_for_every_choice():
    """Linked sets share l of the prefixes' tokens whichever l each of the two has chosen."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(5, 80))
        universe = np.unique(rng.integers(0, 2**63, 3 * n, dtype=np.uint64))
        x = np.sort(rng.choice(universe, n, replace=False))
        y = np.sort(np.unique(np.concatenate([rng.choice(x, max(1, n - int(rng.integers(0, n // 5 + 1))), replace=False), rng.choice(universe, int(rng.integers(0, n // 5 + 1)), replace=False)])))
        both = len(np.intersect1d(x, y))
        if 5 * both < 4 * (len(x) + len(y) - both):
            continue
        sketch = rng.integers(2, 256, 1 << 20).astype(np.uint8)
        token, row, level, chosen, _ = ngram_join.prefixes(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), sketch)
        low = min(chosen)
        a, b = ({t for t, r, v in zip(token.tolist(), row, level, strict=True) if r == k and v <= low} for k in (0, 1))
        assert len(a & b) >= low


def test_parity_bitmaps_never_exclude_a_link():
    rng = np.random.default_rng(8)
    excluded = 0
    for _ in range(400):
        universe = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
        x = rng.choice(universe, int(rng.integers(20, 300)), replace=False)
        y = np.unique(np.concatenate([rng.choice(x, max(1, len(x) - int(rng.integers(0, len(x) // 3))), replace=False), rng.choice(universe, int(rng.integers(1, 40)), replace=False)]))
        both = len(np.intersect1d(x, y))
        n = np.array([len(x), len(y)])
        out = ngram_join._apart(n, [ngram_join.parity(x), ngram_join.parity(y)], np.array([0]), np.array([1]))[0]
        excluded += out
        assert not (out and 5 * both >= 4 * (len(x) + len(y) - both))
    assert excluded > 50


def test_sketch_counts(spark):
    """The sketch holds every row's distinct shingles once, below 64 exactly."""
    texts = [f"a b c d e {i % 7} f g" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    first = ngram_join._sketch_pass(df, 1 << 20)
    sketch = ngram_join._sketch(first.filter("block IS NOT NULL"), 1 << 20)
    import pyarrow as pa

    want = np.zeros(1 << 20, int)
    for _, _, tokens, _ in ngram_join.shingle_sets(pa.array(texts)):
        np.add.at(want, ngram_join._counter(tokens, 1 << 20), 1)
    assert (sketch == want).all() and want.max() == 60


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {i: i for p in links for i in p}
    for _ in range(100):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    touched = {i for a, b in links if a != b for i in (a, b)}
    assert all(got.get(i, i) == label[i] for i in touched)
