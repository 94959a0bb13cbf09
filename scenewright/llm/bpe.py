"""BPE encoding and decoding by a pair occurrence index.

The distinct pre-tokens of a block of texts are laid into one array of symbols with links to the next and previous
symbol.  An index maps each rank (a pair that the vocabulary merges) to all positions of that pair in the block.  Active
ranks are applied in ascending order, each to all its positions at once; what a merge makes of its neighbours joins the
lists of the ranks of the new pairs, and positions that a merge has used up are skipped when their list's turn comes.
A merge never makes a pair of a lower rank (checked when the vocabulary is loaded), so every rank has one turn.

The results are those of the tokenizers library for byte-level BPE files: split at the added tokens, then by the byte-level
pattern, then merge; decoding joins the tokens' bytes and replaces malformed UTF-8.

Defined results: null text is encoded as empty: no ids; texts of any length are encoded whole; a pre-token of any length
takes time in proportion to it; repeated rows repeat their result; an empty table gives no rows; extra columns don't
matter to the digests, and stay beside the ids but for one that has their name.  Executors keep a vocabulary and a bounded cache of pre-tokens; both are rebuilt anywhere,
so a lost executor costs only its tasks.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from scenewright.llm._text import column_bytes, doc_groups

#: The byte-level pattern of the vocabulary's format (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of text encoded at once, and pre-tokens whose ids a worker keeps.
BLOCK, CACHED = 12 << 20, 400_000


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """A byte-level BPE vocabulary of the tokenizers library's file format."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
        if model["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or any(model.get(k, v) not in (v, "" if v is None else v) for k, v in plain.items()):
            raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or need word boundaries aren't supported")
        vocab: dict[str, int] = model["vocab"]
        self.added: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.pattern = regex.compile(PATTERN)
        chars = byte_chars()
        self.byte_id = np.zeros(256, np.int32)
        for c, b in chars.items():
            self.byte_id[b] = vocab[c]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        key = self.left << 32 | self.right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        first = np.full(1 + max(int(max(vocab.values())), *self.added.values(), 0), -1, np.int64)
        first[self.made[::-1]] = np.arange(len(merges))[::-1]
        if (np.maximum(first[self.left], first[self.right]) >= np.arange(len(merges))).any() or len(np.unique(key)) < len(key):
            raise ValueError("a merge comes before one that makes its parts")
        size = len(first)
        pieces = [b""] * size
        for t, i in vocab.items():
            pieces[i] = bytes(chars[c] for c in t) if all(c in chars for c in t) else t.encode()
        for t, i in self.added.items():
            pieces[i] = bytes(chars[c] for c in t) if all(c in chars for c in t) else t.encode()
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where the vocabulary has none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the pre-tokens in a row, and how many each has."""
        buf = np.frombuffer(b"".join(words), np.uint8)
        length = np.array([len(w) for w in words], np.int64)
        n = len(buf)
        sym = self.byte_id[buf].astype(np.int64)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(length)
        nxt[ends[length > 0] - 1] = -1
        prv[(ends - length)[length > 0]] = -1
        lists: dict[int, list[np.ndarray]] = {}

        def enter(at: np.ndarray) -> list[int]:
            """Adds the pairs that begin at these positions to the index; the ranks that weren't active."""
            rank = self.rank_of(sym[at], sym[nxt[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return []
            if len(at) > 1:
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
                cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            else:
                cuts = ()
            fresh = []
            edges = [0, *(cuts.tolist() if len(cuts) else ()), len(at)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                r = int(rank[a])
                if r in lists:
                    lists[r].append(at[a:b])
                else:
                    lists[r] = [at[a:b]]
                    fresh.append(r)
            return fresh

        active = enter(np.flatnonzero(nxt >= 0))
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            parts = lists.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            a, b, made = self.left[r], self.right[r], self.made[r]
            after = nxt[at]
            good = (after >= 0) & (sym[at] == a) & (sym[after] == b)
            if not good.all():
                at, after = at[good], after[good]
            if a == b and len(at) > 1:  # in a run of equal symbols every second pair is merged, from the left
                joined = after[:-1] == at[1:]
                index = np.arange(len(at))
                begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~joined]), index, 0))
                even = (index - begin) % 2 == 0
                at, after = at[even], after[even]
            if not len(at):
                continue
            beyond = nxt[after]
            sym[at] = made
            sym[after] = -1
            nxt[at] = beyond
            nxt[after] = -1
            inner = beyond >= 0
            prv[beyond[inner]] = at[inner]
            before = prv[at]
            before = before[before >= 0]
            changed = np.concatenate([before, at[inner]])
            if len(changed) > 1:
                changed = np.unique(changed)
            for x in enter(changed):
                heapq.heappush(active, x)
        left = sym >= 0
        counts = np.add.reduceat(left, np.minimum(ends - length, max(n - 1, 0))) if n else np.zeros(len(words), np.int64)
        return sym[left].astype(np.int32), np.where(length > 0, counts, 0)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start[i] : start[i] + length[i]] of all i in a row."""
    total = int(length.sum())
    where = np.repeat(start - (np.cumsum(length) - length), length)
    where += np.arange(total)
    return flat[where]


class Encoder:
    """Encodes blocks of texts; keeps the ids of pre-tokens it has met, up to CACHED."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.v = vocab
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def _learn(self, fresh: list[str]) -> None:
        added = self.v.added
        ids, counts = self.v.merge([b"" if t in added else t.encode() for t in fresh])
        for k, t in enumerate(fresh):
            if t in added:  # a pre-token never looks like one: texts are split at them first
                at = int(counts[:k].sum())
                ids, counts[k] = np.insert(ids, at, added[t]), 1
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
        self.length = np.concatenate([self.length, counts])
        self.flat = np.concatenate([self.flat, ids])

    def pieces(self, text: str) -> list[str]:
        v = self.v
        if v.split is None or not v.split.search(text):
            return v.pattern.findall(text)
        out, at = [], 0
        for m in v.split.finditer(text):
            out += v.pattern.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + v.pattern.findall(text[at:])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        if len(self.index) > CACHED:
            self.forget()
        index, fresh, words, sizes = self.index, [], [], []
        for text in texts:
            tokens = self.pieces(text)
            try:
                words.append(np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens)))
            except KeyError:
                for t in tokens:
                    if t not in index:
                        index[t] = len(index)
                        fresh.append(t)
                words.append(np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens)))
            sizes.append(len(tokens))
        if fresh:
            self._learn(fresh)
        word = np.concatenate(words) if words else np.zeros(0, np.int64)
        length = self.length[word]
        ids = _gather(self.flat, self.start[word], length)
        upto = np.concatenate([[0], np.cumsum(length)])
        ends = np.cumsum(sizes)
        return ids, upto[ends] - upto[ends - sizes]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 of each text whose ids stand in a row; malformed sequences become U+FFFD."""
        v = self.v
        length = v.piece_len[ids]
        data = _gather(v.piece_bytes, v.piece_at[ids], length).tobytes()
        upto = np.concatenate([[0], np.cumsum(length)])
        ends = np.cumsum(counts)
        return [data[a:b].decode("utf-8", "replace").encode() for a, b in zip(upto[ends - counts].tolist(), upto[ends].tolist(), strict=True)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _blocks(column: pa.Array, encoder: Encoder) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The ids of runs [a, b) of the column's rows."""
    _, offsets = column_bytes(column)
    for a, b in doc_groups(offsets, BLOCK):
        texts = ["" if t is None else t for t in column.slice(a, b - a).to_pylist()]
        yield a, b, *encoder.encode(texts)


def encode(docs: DataFrame, *, text: str = "text", path: str | None = None, ids: str = "token_ids") -> DataFrame:
    """`docs` with a column of token ids; a column of that name is replaced."""
    path = path or default_path()
    rest = docs.drop(ids)
    schema = f"{ids} array<int>"

    def run(batches):
        encoder = Encoder(vocabulary(path))
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            parts, counts = [], [np.zeros(1, np.int64)]
            for _, _, got, n in _blocks(column, encoder):
                parts.append(got)
                counts.append(n)
            values = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, ids])

    from pyspark.sql.types import StructType

    return rest.mapInArrow(run, StructType([*rest.schema.fields, *StructType.fromDDL(schema).fields]))


def digests(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or default_path()
    rows = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].cast("string").alias("text"))

    def run(batches):
        encoder = Encoder(vocabulary(path))
        for batch in batches:
            for a, b, ids, counts in _blocks(batch.column(1), encoder):
                raw = ids.astype("<u4").tobytes()
                ends = 4 * np.cumsum(counts)
                of_ids = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip((ends - 4 * counts).tolist(), ends.tolist(), strict=True)]
                of_text = [hashlib.sha256(x).hexdigest() for x in encoder.decode(ids, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
