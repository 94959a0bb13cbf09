"""Quality classification by nearest-neighbour voting in a latent-semantic space.

A text is a bag of hashed byte trigrams (case and punctuation kept) and of a few shape terms: how many words and lines
repeat, how long words are, what share of bytes is upper case, punctuation or digits.  Terms are weighted by the logarithm
of their count and by their inverse document frequency over *all* documents; a truncated singular value decomposition of
a bounded sample of labelled texts gives the latent space.  The sample's unit vectors and labels are broadcast, every
document's cosine with each of them is computed exactly in blocks, and its nearest neighbours vote with weights that grow
with the similarity.  The score is the share of the votes for label 1, each label's votes weighted by its share among the
labels, so a sample with as many rows of either label keeps the labels' odds.

Bounds: `sample` labelled rows of each label (documented parameter), `RANK` numbers for each in the broadcast; document
frequencies are summed by term in the cluster, `TERMS` numbers reach the driver whatever the input size.

Defined results: null and empty texts are scored as texts without terms, which fall to the labels' shares; a null
doc_id hashes as empty text; labels with null or other values than 0 and 1 aren't used; of contradicting labels of one
doc_id the lower counts; without any usable label each score is 0.5; of labelled vectors with equal cosines at the edge of
the neighbours any may vote; repeated rows get equal scores; an empty table gives no rows; texts of any length are scored
whole; extra columns don't matter, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.llm._text import column_bytes, distinct_rows, doc_groups, held_out, ngram_counts, unused, word_hashes

GRAMS = 2048
BINS = 8
SHAPES = 8
TERMS = GRAMS + SHAPES * BINS
RANK = 64
SAMPLE = 2048
NEIGHBOURS = 15
BLOCK = 1 << 20
#: Similarities are raised to this power before they weigh votes.
SHARPNESS = 8.0
SHAPE_WEIGHT = 3.0

_IDENTITY = np.arange(256, dtype=np.uint32)
_LOWER, _UPPER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_LOWER[97:123] = _UPPER[65:91] = _DIGIT[48:58] = True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _share(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(flags)])
    return (upto[offsets[1:]] - upto[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


def shapes(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1 that describe the form of each text, an array (rows, SHAPES)."""
    n = len(offsets) - 1
    words, at = word_hashes(buf, offsets)
    count = np.diff(at)
    row = np.repeat(np.arange(n), count)
    _, distinct_at = distinct_rows(words, row, n)
    repeats = 1 - np.diff(distinct_at) / np.maximum(count, 1)
    again = np.zeros(len(words) + 1, np.int64)
    if len(words) > 1:
        again[2:] = np.cumsum((words[1:] == words[:-1]) & (row[1:] == row[:-1]))
    size = np.diff(offsets)
    return np.stack([
        np.minimum(np.log2(count + 1) / 16, 1),
        repeats,
        (again[at[1:]] - again[np.minimum(at[:-1] + 1, at[1:])]) / np.maximum(count, 1),
        np.minimum(size / np.maximum(count, 1) / 20, 1),
        _share(_UPPER[buf], offsets),
        np.minimum(_share(_MARK[buf], offsets) * 4, 1),
        np.minimum(_share(_DIGIT[buf], offsets) * 4, 1),
        np.minimum(_share(_LINE[buf], offsets) * 20, 1),
    ], 1)


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Weights of the terms of each text before the inverse document frequency, an array (rows, TERMS) of float32."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    out[:, :GRAMS] = np.log1p(ngram_counts(buf, offsets, _IDENTITY, 3, GRAMS))
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    out /= np.maximum(norm, 1e-9)[:, None]
    full = np.diff(offsets) > 0
    soft = shapes(buf, offsets) * (BINS - 1)  # each number is shared between the two nearest bins
    low = np.minimum(soft.astype(np.int64), BINS - 2)
    for k in range(SHAPES):
        part = (soft[:, k] - low[:, k]) * full
        out[np.arange(n), GRAMS + k * BINS + low[:, k]] = SHAPE_WEIGHT / SHAPES * (full - part)
        out[np.arange(n), GRAMS + k * BINS + low[:, k] + 1] = SHAPE_WEIGHT / SHAPES * part
    return out


@dataclass
class Model:
    """What scoring needs: term weights, the latent basis, and the labelled vectors with the weight of their votes."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    prior: float

    def project(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.idf) @ self.basis
        return z / np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z)), 1e-9)[:, None]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The weighted vote of the nearest labelled vectors, by exact cosines with all of them."""
        if not len(self.labels):
            return np.full(len(x), self.prior)
        z = self.project(x)
        cosine = z @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1).astype(np.float64), 0) ** SHARPNESS * self.votes[near]
        total = weight.sum(1)
        empty = (total <= 1e-12) | ~x.any(1)
        return np.where(empty, self.prior, (weight * self.labels[near]).sum(1) / np.where(empty, 1, total))


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE, seed: int = 7) -> Model:
    """Document frequencies from all of `docs`; the latent space and the voters from at most `sample` rows of each label."""
    spark = docs.sparkSession
    usable = (
        labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
        .filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    )
    usable = usable.join(docs.select(F.col(f"`{doc_id}`").alias("doc_id")).distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id", F.lit(seed))
    counts = {r.label: r.n for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen: dict[object, int] = {}
    for value in counts:
        chosen |= {r.doc_id: value for r in usable.filter(F.col("label") == value).orderBy(order, "doc_id").limit(sample).collect()}
    shipped = spark.sparkContext.broadcast(chosen)  # 2 * sample ids at most
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def count(batches):
        df = np.zeros(TERMS + 1, np.int64)
        picked: dict[object, bytes] = {}
        for batch in batches:
            buf, offsets = column_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in doc_groups(offsets, BLOCK):
                x = features(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                df[:TERMS] += (x > 0).sum(0)
                df[TERMS] += b - a
                for i in range(a, b):
                    if ids[i] in shipped.value:
                        picked[ids[i]] = max(picked.get(ids[i], b""), x[i - a].tobytes())
        at = np.flatnonzero(df)
        names = [f"t{i}" for i in at] + [f"d{i}" for i in picked]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([*df[at].tolist(), *[0] * len(picked)], pa.int64()), pa.array([*[None] * len(at), *picked.values()], pa.binary())], ["term", "n", "vector"])

    df = np.zeros(TERMS + 1)
    found: dict[str, bytes] = {}
    for r in rows.mapInArrow(count, "term string, n long, vector binary").groupBy("term").agg(F.sum("n").alias("n"), F.max("vector").alias("vector")).toLocalIterator():
        if r.vector is None:
            df[int(r.term[1:])] = r.n
        else:
            found[r.term[1:]] = bytes(r.vector)
    idf = (np.log((df[TERMS] + 1) / (df[:TERMS] + 1)) + 1).astype(np.float32)
    ids = sorted((i for i in chosen if str(i) in found), key=str)
    y = np.array([chosen[i] for i in ids], np.float64)
    prior = counts.get(1, 0) / max(sum(counts.values()), 1) if counts else 0.5
    if not len(ids):
        return Model(idf, np.zeros((TERMS, RANK), np.float32), np.zeros((0, RANK), np.float32), y, y, prior)
    x = np.frombuffer(b"".join(found[str(i)] for i in ids), np.float32).reshape(len(ids), TERMS) * idf
    q = np.random.default_rng(seed).standard_normal((TERMS, RANK + 16)).astype(np.float32)
    for _ in range(4):  # randomised subspace iteration
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    model = Model(idf, np.ascontiguousarray((q @ vt.T)[:, :RANK]).astype(np.float32), np.zeros((0, RANK), np.float32), y, np.array([counts[v] / (y == v).sum() for v in y.astype(int)]), prior)
    model.vectors = model.project(x / idf)
    return model


def predict(docs: DataFrame, model: Model, *, text: str = "text", doc_id: str = "doc_id", keep: bool = False) -> DataFrame:
    """doc_id and score of every row of `docs`; with `keep`, all columns and as the last one the score: `__score`, after more
    underscores where a column has such a name."""
    source = docs if keep else docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    column = docs.columns.index(text) if keep else 1
    (name,) = unused(source.columns, "__score") if keep else ("score",)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # TERMS * RANK numbers and 2 * sample vectors at most

    def run(batches):
        m = shipped.value
        for batch in batches:
            buf, offsets = column_bytes(batch.column(column))
            scores = [m.score(features(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in doc_groups(offsets, BLOCK)]
            score = pa.array(np.clip(np.concatenate(scores), 0, 1) if scores else np.zeros(0), pa.float64())
            if keep:
                yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, name])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), score], ["doc_id", "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    if keep:
        return source.mapInArrow(run, StructType([*source.schema.fields, StructField(name, DoubleType())]))
    return source.mapInArrow(run, StructType([source.schema["doc_id"], StructField("score", DoubleType())]))


def op1_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = held_out(F.col("doc_id"), 5, 0)
    scored = predict(docs, fit(docs, labels.filter(~out)))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
