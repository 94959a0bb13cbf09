"""Tables whose columns are named like those that the operators use themselves, and ids of other types."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from scenewright.llm import bpe, decontaminate, exact_dedup, language, ngram_join, quality, sentence_spans, token_counts

SF = "/root/testdata/sf0.001"
NAMES = ["__score", "_score", "score", "key", "__key", "__doc", "__sum", "__again", "__cover", "__sentences", "__removed", "__text_is_null", "rest", "absent", "w", "d", "s", "p", "r", "id", "sum", "hash", "place", "set_id", "n_shingles", "text_hash", "block", "counts", "held_out", "label", "item_id", "languages"]
PASSAGE = "Here is a first passage of eight words. It goes on with a second sentence of some length."


@pytest.fixture(scope="module")
def plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    more = [(9001, PASSAGE, "en", "s", 1), (9002, f"Before it. {PASSAGE}", "en", "s", 1), (9003, None, None, None, None), (None, "short", "en", None, 5)]
    return docs.unionByName(spark.createDataFrame(more, docs.schema))


@pytest.fixture(scope="module")
def wide(plain):
    return plain.select("*", *[F.lit(f"value of {n}").alias(n) for n in NAMES])


def rows(df, *columns):
    return sorted((tuple(map(repr, r)) for r in df.select(*columns or [F.col(f"`{c}`") for c in df.columns]).collect()))


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, plain, wide, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    a, b = run(spark, plain, SF), run(spark, wide, SF)
    assert b.columns[: len(wide.columns)] == wide.columns
    got = b.collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(r.doc_id) for r in a.collect()) and all(r[n] == f"value of {n}" for r in got for n in NAMES)


def test_operators(spark, plain, wide):
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert rows(quality.predict(wide, quality.fit(wide, labels))) == rows(quality.predict(plain, quality.fit(plain, labels)))
    kept = quality.predict(wide, quality.fit(wide, labels), keep=True)
    assert kept.columns == [*wide.columns, "___score"] and kept.count() == plain.count()
    assert rows(language.predict(wide, language.train(wide))) == rows(language.predict(plain, language.train(plain)))
    assert rows(exact_dedup.report(wide)) == rows(exact_dedup.report(plain))
    assert rows(exact_dedup.deduplicate(wide), "doc_id", "text") == rows(exact_dedup.deduplicate(plain), "doc_id", "text")
    assert rows(ngram_join.join(wide)) == rows(ngram_join.join(plain))
    assert rows(decontaminate.matches(wide, bench)) == rows(decontaminate.matches(plain, bench))
    assert rows(bpe.digests(wide)) == rows(bpe.digests(plain)) and rows(token_counts.count(wide)) == rows(token_counts.count(plain))
    a, b = sentence_spans.remove(plain, report=True), sentence_spans.remove(wide, report=True)
    assert b.columns == [*wide.columns, "___sentences", "___removed"]
    assert rows(b, "doc_id", "text", *b.columns[-2:]) == rows(a, "doc_id", "text", *a.columns[-2:])
    assert [r.text for r in b.filter("doc_id = 9002").collect()] == ["Before it. "]


def test_ids_of_other_types(spark, plain):
    """Results by text are the same whatever the ids are."""
    named = plain.withColumn("doc_id", F.concat(F.lit("doc-"), "doc_id"))
    for operator, columns in ((ngram_join.join, ["n_shingles"]), (exact_dedup.report, ["group_size", "text_sha256"]), (bpe.digests, ["n_tokens", "ids_sha256"]), (lambda d: sentence_spans.remove(d, report=True), ["__sentences"])):
        out = operator(named)
        assert out.schema["doc_id"].dataType.simpleString() == "string" and rows(out, *columns) == rows(operator(plain), *columns)
    two = [("a-1", PASSAGE), ("b-2", f"{PASSAGE} And more."), ("b-2", "Alone. Here."), (None, PASSAGE)]
    left = [r.text for r in sentence_spans.remove(spark.createDataFrame(two, "doc_id string, text string")).collect()]
    assert sum(PASSAGE in t for t in left) == 1 and "Alone. Here." in left
