from collections import defaultdict
from hashlib import sha256

from compare import same
from pyspark.sql import functions as F

from scenewright.llm import exact_dedup

SCHEMA = "doc_id long, text string, digest string, salt int, p double"
ROWS = [(1, "a", "x", 1, 0.5), (2, "a", None, 2, None), (3, "", "y", 3, 1.0), (4, None, None, None, 2.0), (5, "A", "z", 5, 3.0), (5, "A", "z", 5, 3.0), (None, "b", "q", 1, 1.0), (None, None, None, None, None), (7, "w " * 200_000, "long", 1, 1.0), (8, "w " * 200_000, "long", 1, 1.0)]


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for r in rows:
        g = groups[r[1] or ""]
        top = max((x for x in g if x is not None), default=None)
        out.append((r[0], top, len(g), r[0] == top, sha256((r[1] or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_report(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(map(tuple, exact_dedup.report(df).collect()), key=repr) == expected(ROWS)


def test_colliding_digests_compare_texts(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for digest in (lambda t: F.lit(b"x"), lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 1))):
        assert sorted(map(tuple, exact_dedup.report(df, digest=digest, salts=3).collect()), key=repr) == expected(ROWS)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.report(df).collect() == []
    assert exact_dedup.deduplicate(df).collect() == []


def test_hot_group_and_kept_rows(spark):
    rows = [(i, "same" if i % 3 == 0 else f"t{i % 50}", None, i, 1.0) for i in range(1000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, exact_dedup.report(df).collect()), key=repr) == expected(rows)
    kept = {r[0] for r in expected(rows) if r[3]}
    out = exact_dedup.deduplicate(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == kept and all(r.salt == r.doc_id for r in out.collect())


def test_deduplicate_edges(spark):
    out = exact_dedup.deduplicate(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted([(r.doc_id, r.text) for r in out], key=repr) == sorted([(2, "a"), (4, None), (5, "A"), (None, "b"), (8, "w " * 200_000)], key=repr)


def test_oracle(spark):
    assert same(spark, exact_dedup.op10_exact_dedup, exact_dedup.ORACLE, "/root/testdata/sf0.01") == 1000
