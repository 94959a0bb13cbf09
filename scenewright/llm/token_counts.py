"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

A text's pre-tokens are segmented into vocabulary pieces so that the sum of the pieces' log probabilities is greatest; of
equally good segmentations one with the fewest pieces counts.  The distinct pre-tokens of a block of texts are inserted in
a trie (sorted, so each level is one pass over arrays); the forward score of a node, the best score of any segmentation
of the bytes from the root to it, is computed once from the nodes above it, whichever pre-tokens share that prefix.
Terminals keep their counts, which the texts look up.

The vocabulary is a file of pieces by rank; a piece's probability falls with its rank, p = 1 / ((rank + 1) * H), as for
words in natural text.  Any other table of log probabilities can be given.  Nothing is trained or shuffled.

Defined results: null and empty texts have no tokens and score 0; bytes without a piece of their own would make a text
impossible, so a vocabulary that lacks one is refused; texts and pre-tokens of any length are counted whole; repeated rows
repeat their result; extra columns don't matter.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.llm._text import column_bytes, doc_groups, mix
from scenewright.llm.bpe import PATTERN

BLOCK, CACHED = 8 << 20, 400_000
#: Levels with fewer nodes are computed one node at a time.
NARROW = 6
_R = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1


class Unigram:
    """Pieces (bytes) with log probabilities."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray) -> None:
        if {bytes([b]) for b in range(256)} - set(pieces):
            raise ValueError("every byte needs a piece")
        self.log_p = dict(zip(pieces, log_p.tolist(), strict=True))
        self.longest = max(map(len, pieces))
        rng = np.random.default_rng(5)
        self.byte = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        self.pow = np.array([pow(_R, k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        value = self.byte.tolist()
        key = np.array([sum(value[b] * pow(_R, k, 1 << 64) for k, b in enumerate(reversed(p))) + len(p) & _M for p in pieces], np.uint64)
        key = mix(key)
        order = np.argsort(key)
        self.keys, self.values = key[order], np.asarray(log_p, np.float64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces are equal")

    def forward(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(score, number of pieces) of each word's best segmentation."""
        order = sorted(range(len(words)), key=words.__getitem__)
        ordered = [words[i] for i in order]
        length = np.array([len(w) for w in ordered], np.int64)
        buf = np.frombuffer(b"".join(ordered), np.uint8)
        start = np.cumsum(length) - length
        score, count = np.zeros(len(words)), np.zeros(len(words), np.int64)
        # nodes of the trie: parent, byte, forward score and pieces; 0 is the root
        parent, byte, best, pieces = [np.zeros(1, np.int64)], [np.zeros(1, np.uint8)], [np.zeros(1)], [np.zeros(1, np.int64)]
        size = 1
        above = np.zeros(len(words), np.int64)
        active = np.flatnonzero(length > 0)
        levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = [(parent[0], byte[0], best[0], pieces[0])]
        first_of = [0]
        depth = 0
        while len(active):
            depth += 1
            b = buf[start[active] + depth - 1]
            up = above[active]
            new = np.ones(len(active), bool)
            new[1:] = (up[1:] != up[:-1]) | (b[1:] != b[:-1])
            node = np.cumsum(new) - 1
            own_parent, own_byte = up[new] - first_of[-1], b[new]
            s, c = self._level(levels, own_parent, own_byte, depth)
            levels.append((own_parent, own_byte, s, c))
            if len(levels) > self.longest + 1:
                levels[len(levels) - self.longest - 2] = None  # no piece reaches back so far
            done = length[active] == depth
            at = active[done]
            score[at], count[at] = s[node[done]], c[node[done]]
            first_of.append(size)
            above[active] = node + size
            size += int(new.sum())
            active = active[~done]
        back = np.empty(len(words), np.int64)
        back[order] = np.arange(len(words))
        return score[back], count[back]

    def _level(self, levels, parent: np.ndarray, byte: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(parent)
        if n < NARROW:
            return self._narrow(levels, parent, byte, depth)
        s, c = np.full(n, -np.inf), np.zeros(n, np.int64)
        key, at, last = np.zeros(n, np.uint64), parent, byte
        for back in range(1, min(depth, self.longest) + 1):
            key = key + self.byte[last] * self.pow[back - 1]
            found = mix(key + np.uint64(back))
            where = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[where] == found)
            up_parent, up_byte, up_score, up_count = levels[depth - back]
            if len(hit):
                value, number = up_score[at[hit]] + self.values[where[hit]], up_count[at[hit]] + 1
                better = (value > s[hit]) | (value == s[hit]) & (number < c[hit])
                s[hit[better]], c[hit[better]] = value[better], number[better]
            last, at = up_byte[at], up_parent[at]
        return s, c

    def _narrow(self, levels, parent, byte, depth):
        out = []
        for at, last in zip(parent.tolist(), byte.tolist(), strict=True):
            best, tail = (-np.inf, 0), b""
            for back in range(1, min(depth, self.longest) + 1):
                tail = bytes([last]) + tail
                up_parent, up_byte, up_score, up_count = levels[depth - back]
                p = self.log_p.get(tail)
                if p is not None:
                    value, number = float(up_score[at]) + p, int(up_count[at]) + 1
                    if value > best[0] or value == best[0] and number < best[1]:
                        best = (value, number)
                last, at = int(up_byte[at]), int(up_parent[at])
            out.append(best)
        return np.array([x for x, _ in out]), np.array([x for _, x in out], np.int64)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def unigram(path: str) -> Unigram:
    """The vocabulary of a file of lines "base64 rank", with probabilities by rank."""
    with open(path, "rb") as f:
        ranked = sorted((int(r), base64.b64decode(p)) for p, r in map(bytes.split, f))
    n = np.arange(1, len(ranked) + 1)
    return Unigram([p for _, p in ranked], -np.log(n * (1.0 / n).sum()))


class Counter:
    """Counts texts; keeps the terminals of pre-tokens it has met, up to CACHED."""

    def __init__(self, model: Unigram, pattern: str = PATTERN) -> None:
        self.model, self.pattern = model, regex.compile(pattern)
        self.index: dict[str, int] = {}
        self.score, self.count = np.zeros(0), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens, tokens and score of each text."""
        if len(self.index) > CACHED:
            self.__init__(self.model, self.pattern.pattern)
        index, fresh, words = self.index, [], []
        for text in texts:
            tokens = self.pattern.findall(text)
            for t in set(tokens).difference(index):
                index[t] = len(index)
                fresh.append(t)
            words.append(np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens)))
        if fresh:
            s, c = self.model.forward([t.encode() for t in fresh])
            self.score, self.count = np.concatenate([self.score, s]), np.concatenate([self.count, c])
        n = np.array([len(w) for w in words], np.int64)
        return n, np.array([self.count[w].sum() for w in words], np.int64), np.array([self.score[w].sum() for w in words])


def count(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, score of every row of `docs`."""
    path = path or default_path()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        counter = Counter(unigram(path))
        for batch in batches:
            _, offsets = column_bytes(batch.column(1))
            for a, b in doc_groups(offsets, BLOCK):
                pre, tokens, score = counter(["" if t is None else t for t in batch.column(1).slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(pre), pa.array(tokens), pa.array(score, pa.float64())], ["doc_id", "n_pretokens", "n_tokens", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_pretokens long, n_tokens long, score double")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(spark.read.parquet(f"{sf_dir}/documents.parquet"))
