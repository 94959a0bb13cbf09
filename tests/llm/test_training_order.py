import hashlib

import numpy as np
import pytest

from scenewright.llm import training_order as to

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation(n):
    p = to.feistel(np.arange(n), n, 7)
    assert sorted(p.tolist()) == list(range(n))
    assert to.feistel(p, n, 7, inverse=True).tolist() == list(range(n))
    if n > 60:
        assert p.tolist() != to.feistel(np.arange(n), n, 8).tolist() and abs(np.corrcoef(p, np.arange(n))[0, 1]) < 0.3


def ids_of(text):
    encode, end = to.encoding(to.default_path())
    return [*encode.encode_ordinary(text or ""), end]


def test_round_trip_and_resumption(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3, "doc_id")
    path = f"file://{tmp_path}/shards"
    manifest = to.write(docs, path, length=64, shard=50).collect()
    n = len(manifest)
    assert sorted(r.slot for r in manifest) == list(range(n))
    every = to.read(path, 0, n + 5, length=64, shard=50)
    assert every.shape == (n, 64) and (to.read(path, 77, 120, length=64, shard=50) == every[77:197]).all()
    assert (np.concatenate([to.read(path, s, 7, length=64, shard=50) for s in range(0, n, 7)]) == every).all()
    for r in manifest:
        assert r.ids_sha256 == hashlib.sha256(every[r.slot].astype("<u4").tobytes()).hexdigest()
        raw = (tmp_path / "shards" / f"shard-{r.shard:08d}.bin").read_bytes()[r.byte_offset : r.byte_offset + 128]
        assert raw == every[r.slot].tobytes()
    # back in the order of the numbers the sequences are the tasks' streams
    inverse = every[to.feistel(np.arange(n), n, 1)].reshape(-1).tolist()
    end = to.encoding(to.default_path())[1]
    texts = sorted(tuple(ids_of(r.text)) for r in docs.collect())
    found, one = [], []
    for x in inverse:
        one.append(x)
        if x == end:
            found.append(tuple(one))
            one = []
    assert sorted(t for t in found if t != (end,)) == texts
    owner = {r.slot: r.doc_id for r in manifest}
    by_id = {r.doc_id: ids_of(r.text) for r in docs.collect()}
    for s in range(0, n, 9):
        first = [int(x) for x in every[s]][:5]
        own = by_id[owner[s]]
        cut = first[: first.index(end) + 1] if end in first else first
        assert any(own[k : k + len(cut)] == cut for k in range(len(own)))


def test_edges(spark, tmp_path):
    rows = [(1, None, 5), (2, "", 6), (2, "", 6), (None, "a b c", 7), (5, "x " * 40_000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int").coalesce(2)
    out = to.write(df, f"file://{tmp_path}/a", length=100, shard=16).collect()
    assert sorted(r.slot for r in out) == list(range(len(out)))
    total = to.read(f"file://{tmp_path}/a", 0, 10_000, length=100, shard=16)
    assert len(total) == len(out) and (total != 50256).sum() == sum(len(ids_of(t)) - 1 for _, t, _ in rows)
    assert to.write(df.limit(0), f"file://{tmp_path}/b").collect() == [] and len(to.read(f"file://{tmp_path}/b", 0, 5)) == 0


def test_writing_again_gives_the_same_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for name in "ab":
        to.write(docs, f"file://{tmp_path}/{name}", length=32, shard=20).collect()
    a, b = ({p.name: p.read_bytes() for p in (tmp_path / n).iterdir()} for n in "ab")
    assert a == b and len(a) > 3


def test_the_stream_does_not_depend_on_the_splits(spark, tmp_path):
    """Other partitions give the same files, and back in order the sequences are the texts by id, then by hash."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(70).select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, "no id"), (3, "another text of three"), (3, "another text of three"), (9_000, None)], docs.schema))
    found = []
    for n in (1, 5):
        path = f"file://{tmp_path}/{n}"
        manifest = to.write(docs.repartition(n), path, length=48, shard=30).collect()
        assert all(r.path == f"{path}/shard-{r.shard:08d}.bin" for r in manifest)
        found.append({p.name: p.read_bytes() for p in (tmp_path / str(n)).iterdir() if not p.name.startswith(".")})
    assert found[0] == found[1]
    rows = docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()
    stream = [x for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h)) for x in ids_of(r.text)]
    n = len(manifest)
    back = to.read(path, 0, n, length=48, shard=30)[to.feistel(np.arange(n), n, 1)].reshape(-1).tolist()
    assert back[: len(stream)] == stream and set(back[len(stream) :]) <= {50256} and len(back) - len(stream) < 48
