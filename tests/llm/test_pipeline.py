import corpus_pipeline
from test_bpe import TRUTH
from test_decontaminate import brute_force as held
from test_decontaminate import plain_words
from test_ngram_join import brute_force as components

from scenewright.llm import quality

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = {r.doc_id: r.score for r in quality.predict(docs, model).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if score[r.doc_id] >= corpus_pipeline.LEAST_QUALITY)
    rows = sorted((d, t) for t, d in {t: d for d, t in rows}.items())
    rows = [(d, t) for (d, t), (_, _, c) in zip(rows, sorted(components(rows)), strict=True) if d == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    triple = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in ((i, plain_words(t)) for i, t in items)}
    kept = {}
    for d, t in rows:
        w = plain_words(t)
        own = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
        if not held([(d, t)], [x for x in items if triple[x[0]] & own]):
            kept[d] = t
    assert set(got) == set(kept) and 0 < len(kept) < 200
    assert all(got[d].token_ids == TRUTH.encode(t, add_special_tokens=False).ids and got[d].n_tokens == len(got[d].token_ids) for d, t in kept.items())


def test_stages_keep_columns_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10_000, "", None, None, 0), (10_000, "", None, None, 0), (10_001, None, "en", "s", None)], docs.schema)
    docs = docs.limit(60).unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        out = stage(spark, docs, SF)
        if name == "BPE encoding":
            assert out.columns == empty.columns == [*docs.columns, "token_ids", "n_tokens"] and out.count() == docs.count()
        else:
            assert out.columns == empty.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        assert empty.count() == 0 and out.count() > 0
