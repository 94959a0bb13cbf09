"""Language identification by multilingual mixture inference.

Each language is a distribution over hashed byte trigrams, counted over every training text.  A document is a mixture of
languages: expectation-maximisation estimates the proportions from its trigrams' likelihoods, and the set of languages is
the one of the highest likelihood less a penalty for each language beyond the first (half the logarithm of the number of
trigrams, times a factor, since overlapping trigrams aren't independent).  Only nested sets are compared: the best single
language, and the languages of the full mixture by descending proportion.

Training and inference are two narrow passes; what leaves a task is its count table, summed by (language, bucket), and the
model is `languages x DIMS` numbers, whatever the corpus size.

Defined results: null text and text without a letter give `und` and score 0; a text with letters of which no trigram was
learned gets the most frequent language and its share; without any learned language all texts are `und`; a null doc_id
hashes as empty text; a null lang is not learned from; of languages with equal shares the first by name is predicted; texts of
any length are read whole; repeated rows get equal results; an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.llm._text import column_bytes, doc_groups, held_out, ngram_counts

DIMS = 4096
#: Languages that a model may have; more is an error, since the model is broadcast.
MOST_LANGUAGES = 512
BLOCK = 1 << 20
ROUNDS = 12
PENALTY = 6.0

_CLASS = np.full(256, 32, np.uint32)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def trigrams(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return ngram_counts(buf, offsets, _CLASS, 3, DIMS, skip=32)


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Trigram counts of each language (the last number: its texts), from all rows whose lang isn't null."""
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).filter("lang IS NOT NULL")

    def count(batches):
        table: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            names = langs.dictionary.to_pylist()
            which = np.asarray(langs.indices)
            buf, offsets = column_bytes(batch.column(0))
            for a, b in doc_groups(offsets, BLOCK):
                c = trigrams(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for k in np.unique(which[a:b]):
                    mine = which[a:b] == k
                    own = table.setdefault(names[k], np.zeros(DIMS + 1, np.int64))
                    own[:DIMS] += c[mine].sum(0).astype(np.int64)
                    own[DIMS] += int(mine.sum())
        for name, own in table.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["lang", "bucket", "n"])

    summed = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    model: dict[str, np.ndarray] = {}
    for r in summed.orderBy("lang", "bucket").toLocalIterator():  # languages x DIMS rows, whatever the input
        if r.lang not in model and len(model) == MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        model.setdefault(r.lang, np.zeros(DIMS + 1))[r.bucket] = r.n
    return model


class Mixture:
    """Proportions of languages in texts."""

    def __init__(self, model: dict[str, np.ndarray], penalty: float = PENALTY, rounds: int = ROUNDS) -> None:
        self.names = sorted(model)
        counts = np.array([model[n][:DIMS] for n in self.names]).reshape(len(self.names), DIMS)
        seen = np.array([model[n][DIMS] for n in self.names])
        p = counts + 0.1
        self.p = (p / p.sum(1, keepdims=True)).astype(np.float32) if len(p) else p.astype(np.float32)
        self.log_p = np.log(self.p)
        self.share = seen / max(seen.sum(), 1)
        self.penalty, self.rounds = penalty, rounds

    def em(self, c: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions from this start (languages at 0 stay at 0), and the log-likelihood."""
        total = np.maximum(c.sum(1, keepdims=True), 1)
        pi = pi.astype(np.float32)
        for _ in range(self.rounds):
            pi = pi * ((c / (pi @ self.p)) @ self.p.T) / total
            pi /= np.maximum(pi.sum(1, keepdims=True), 1e-30)
        return pi, np.einsum("ij,ij->i", c, np.log(pi @ self.p), dtype=np.float64)

    def infer(self, c: np.ndarray) -> np.ndarray:
        """The proportions of the selected languages, 0 elsewhere; rows without trigrams get the languages' shares."""
        n, k = len(c), len(self.names)
        total = c.sum(1)
        single = (c @ self.log_p.T).astype(np.float64)
        best = single.argmax(1)
        out = np.zeros((n, k), np.float32)
        out[np.arange(n), best] = 1
        top = single[np.arange(n), best]
        price = self.penalty * 0.5 * np.log(np.maximum(total, 2))
        if k > 1:
            pi, like = self.em(c, np.full((n, k), 1 / k))
            rest = np.flatnonzero(like - price > top)  # no set of two or more can win where the full mixture can't with the price of two
            if len(rest):
                order = np.argsort(-pi[rest], axis=1, kind="stable")
                value = top[rest].copy()
                for size in range(2, k + 1):
                    start = np.zeros((len(rest), k), np.float32)
                    np.put_along_axis(start, order[:, :size], 1 / size, axis=1)
                    got, own = (pi[rest], like[rest]) if size == k else self.em(c[rest], start)
                    own = own - price[rest] * (size - 1)
                    better = own > value
                    value[better] = own[better]
                    out[rest[better]] = got[better]
        out[total == 0] = self.share
        return out


def has_letter(column: pa.Array, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(_LETTER[buf])])
    found = upto[offsets[1:]] > upto[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)).tolist():
        found[i] = any(ch.isalpha() for ch in buf[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def predict(docs: DataFrame, model: dict[str, np.ndarray], *, text: str = "text", doc_id: str = "doc_id", penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, languages (an array of lang and share, by descending share)."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    shipped = rows.sparkSession.sparkContext.broadcast(model)  # languages x DIMS numbers
    kind = rows.schema["doc_id"].dataType.simpleString()
    pairs = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches):
        mixture = Mixture(shipped.value, penalty)
        names = mixture.names
        for batch in batches:
            buf, offsets = column_bytes(batch.column(1))
            for a, b in doc_groups(offsets, BLOCK):
                own, off = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                letters = has_letter(batch.column(1), own, off) if names else np.zeros(b - a, bool)
                pi = mixture.infer(trigrams(own, off)).astype(np.float64) if names else np.zeros((b - a, 1))
                top = pi.argmax(1)
                score = np.where(letters, np.clip(pi[np.arange(b - a), top], 0, 1), 0.0)
                lang = [names[t] if ok else "und" for t, ok in zip(top.tolist(), letters.tolist(), strict=True)]
                sets = [[{"lang": names[j], "share": float(x[j])} for j in np.argsort(-x, kind="stable") if x[j] > 0] if ok else [] for x, ok in zip(pi, letters.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lang, pa.string()), pa.array(score), pa.array(sets, pairs)], ["doc_id", "lang_pred", "score", "languages"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, languages array<struct<lang string, share double>>")


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out(F.col("doc_id"), 3, 1)
    return predict(docs, train(docs.filter(~out))).select("doc_id", out.alias("held_out"), "lang_pred", "score", "languages")
