"""Benchmark decontamination: CGK embeddings, bit-sampling LSH over item-sized windows, exact edit verification.

A document holds an item if some stretch of its words is within floor(`MOST_EDITS` * words of the item) word edits
(insertions, deletions, substitutions) of the whole item.  Words are runs of letters and digits with A-Z lower-cased, so
case, punctuation and line breaks don't matter.

A CGK walk reads a sequence from a place: step j emits the symbol under the pointer, and the pointer moves on if bit j of
its word's random hash is set.  Two sequences a few edits apart then emit the same symbol in many steps (edit distance
becomes Hamming distance).  The symbols are word pairs.  Every word of every document begins a window, read forwards and
backwards; every item is read the same ways, once from its first and once from its last word.  The window of an item has
`SPAN` steps for each of its words (rounded down to its class of sizes), which take the walk over about two thirds of the
item, so that both directions cover it all.  An item of more than WINDOW words is cut into windows of equal size, of which
one at least has no larger share of the edits than the item.

A hash table samples steps of the window: the first among its first FIRST steps, the second anywhere behind it (items of
fewer than SINGLE words: the first alone).  WALKS walks, two directions and TABLES tables for each repeat this, so that few
items are missed (see `TARGET`).  Sampling is evaluated step by step: only a window whose first sample some item shares is
walked on, which gives the same candidates as complete lookups.  Items of so few words that no edit is allowed are looked
up by a hash of the whole window.  Candidates are verified exactly by Myers' bit-parallel edit distance over the whole item.

The items' tables are broadcast in blocks of at most `ITEM_BYTES` of benchmark text; a larger benchmark takes more
blocks, one pass over the documents for each.  Nothing is shuffled.

Defined results: null texts and texts without words hold nothing; items with fewer than `least_words` words (LEAST_WORDS
unless given) are held by nothing (such phrases occur everywhere); repeated rows give repeated results; repeated items are
separate items; an empty table of documents or items gives no rows; texts of any length are searched whole; an item
that a text holds several times counts once, with its fewest edits; extra columns don't matter.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.llm._text import NOT_ALNUM, column_bytes, doc_groups, mix, word_hashes

MOST_EDITS = 0.2
LEAST_WORDS = 5
ITEM_BYTES = 4 << 20
BLOCK = 4 << 20
FIRST, TABLES, WALKS, SINGLE, SPAN, WINDOW = 8, 16, 2, 7, 1.3, 100
#: The part of items at MOST_EDITS, however the edits are spread, that tests expect to be found.
TARGET = 0.95
#: Each class of item sizes begins at so many times the words of the one before.
GROWTH = 1.2
_SEED = [np.uint64(0x243F6A8885A308D3 + 0x9E3779B97F4A7C15 * r & 0xFFFFFFFFFFFFFFFF) for r in range(WALKS)]
_BITS = 20
HITS, FILTERED_WORDS = 1 << 18, 64
#: Symbols that windows which are walked on may hold at once.
EMITTED = 1 << 22


def words_of(column: pa.Array):
    buf, offsets = column_bytes(column)
    for a, b in doc_groups(offsets, BLOCK):
        yield a, b, *word_hashes(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], NOT_ALNUM)


def pairs_of(words: np.ndarray) -> np.ndarray:
    """The symbol at each word: a hash of it and the next one."""
    after = np.zeros_like(words)
    after[:-1] = words[1:]
    return mix(words * np.uint64(0xA0761D6478BD642F) ^ after)


def _key(symbols: np.ndarray) -> np.ndarray:
    """One number for the sampled symbols (rows: samples)."""
    out = symbols[0]
    for v in symbols[1:]:
        out = mix(out * np.uint64(0xE7037ED1A0B428DB) ^ v)
    return out


def _matched(keys: np.ndarray, item: np.ndarray, key: np.ndarray, start: np.ndarray):
    """(item, start) of all equal keys, in parts of about HITS, however many items share a key."""
    low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
    found = np.flatnonzero(high > low)
    low, count, start = low[found], (high - low)[found], start[found]
    upto, done = np.cumsum(count), 0
    while done < len(found):
        to = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + HITS, "right")))
        c = count[done:to]
        yield item[np.repeat(low[done:to], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)], np.repeat(start[done:to], c)
        done = to


def most_edits(n: int) -> int:
    return int(MOST_EDITS * n + 1e-9)


def size_class(n: int) -> int:
    """The least number of words in the class of items with n words."""
    low = 1.0
    while low * GROWTH <= n:
        low = max(low * GROWTH, int(low) + 1)
    return int(low)


def steps_of(n: int) -> int:
    """Steps of the window of an item with n words."""
    return max(2, int(SPAN * size_class(n)))


def samples(n: int, walk: int, back: bool) -> list[tuple[int, ...]]:
    """The steps that each table samples of the windows of items with n words."""
    steps = steps_of(n)
    rng = np.random.default_rng([11, size_class(n), walk, int(back)])
    first = [t % min(FIRST, steps - 1) for t in range(TABLES)]
    return [(f,) if n < SINGLE else (f, int(rng.integers(f + 1, steps))) for f in first]


def _window_key(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each place."""
    key = np.full(max(len(words) - n + 1, 0), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(n):
        key = mix(key * np.uint64(0xE7037ED1A0B428DB) ^ words[k : k + len(key)])
    return key


class _Walker:
    """Walks from many places of padded words at once."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, walk: int, back: bool) -> None:
        self.words, self.pairs, self.seed, self.move = words, pairs[:-1] if back else pairs[1:], _SEED[walk], -1 if back else 1

    def bit(self, at: np.ndarray, step: int) -> np.ndarray:
        own = mix(self.words[at] ^ np.uint64(int(self.seed) + (step >> 6) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        return ((own >> np.uint64(step & 63)) & np.uint64(1)).astype(np.int64)


class Items:
    """The items' words and their LSH tables."""

    def __init__(self, ids: list, texts: list[str | None], least_words: int = LEAST_WORDS) -> None:
        self.ids, self.words = ids, []
        for _, _, words, at in words_of(pa.array(texts, pa.string())):
            self.words += [words[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.peq: dict[int, dict[int, int]] = {}
        searched = np.flatnonzero(self.size >= max(1, least_words))
        self.exact: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        loose = [i for i in searched.tolist() if most_edits(len(self.words[i]))]
        for n in sorted({len(self.words[i]) for i in searched.tolist()} - {len(self.words[i]) for i in loose}):
            own = np.array([i for i in searched.tolist() if len(self.words[i]) == n])
            key = np.concatenate([_window_key(self.words[i], n) for i in own.tolist()])
            order = np.argsort(key, kind="stable")
            self.exact[n] = key[order], own[order]
        cuts = [(i, np.linspace(0, len(self.words[i]), -(-len(self.words[i]) // WINDOW) + 1).astype(np.int64)) for i in loose]
        self.part_item = np.array([i for i, c in cuts for _ in c[1:]], np.int64)
        self.part_at = np.concatenate([c[:-1] for _, c in cuts] or [np.zeros(0, np.int64)])
        self.part_size = np.concatenate([np.diff(c) for _, c in cuts] or [np.zeros(0, np.int64)])
        self.longest = max(map(steps_of, np.unique(self.part_size).tolist()), default=0)
        self.tables = {(walk, back): self._build(walk, back) for walk in range(WALKS) for back in (False, True)} if loose else {}

    def _build(self, walk: int, back: bool):
        """By first step: (bitmap, sorted symbols, steps that their windows need, [(steps of the class, second step, sorted keys, windows)])."""
        size, pad = self.part_size, 2
        words, first = np.zeros(int(size.sum()) + 2 * pad * len(size) + 1, np.uint64), np.cumsum(size + 2 * pad) - size - pad
        pairs = np.zeros(len(words) + 1, np.uint64)
        for i, begin, n, at in zip(self.part_item.tolist(), self.part_at.tolist(), size.tolist(), first.tolist(), strict=True):
            own = self.words[i][begin : begin + n]
            words[at : at + n] = own
            pairs[at + 1 : at + n] = pairs_of(own)[:-1]
        walker = _Walker(words, pairs, walk, back)
        low = np.array([size_class(n) for n in size.tolist()])
        out: list[tuple[list, list]] = [([], []) for _ in range(FIRST)]
        for group in [np.flatnonzero((low == n) & small) for n in np.unique(low).tolist() for small in (size < SINGLE, size >= SINGLE)]:
            if not len(group):
                continue
            n = int(size[group[0]])
            begin, end = first[group], first[group] + size[group]
            at = end - 1 if back else begin
            emitted = np.zeros((steps_of(n), len(group)), np.uint64)
            for j in range(len(emitted)):
                inside = (at >= begin) & (at < end)
                here = np.where(inside, at, 0)
                emitted[j] = np.where(inside, walker.pairs[here], np.uint64(0))  # 0 beyond the window's end
                at = np.where(inside, at + walker.move * walker.bit(here, j), at)
            for sampled in sorted(set(samples(n, walk, back))):
                whole = np.flatnonzero((emitted[list(sampled)] != 0).all(0))
                if len(whole):
                    key = _key(emitted[list(sampled)][:, whole])
                    order = np.argsort(key, kind="stable")
                    symbols, tables = out[sampled[0]]
                    symbols.append((emitted[sampled[0], whole], np.full(len(whole), len(emitted))))
                    tables.append((len(emitted), sampled[-1], key[order], group[whole[order]]))
        return [self._first_step(*x) for x in out]

    @staticmethod
    def _first_step(found: list, tables: list):
        symbol = np.concatenate([s for s, _ in found] or [np.zeros(0, np.uint64)])
        need = np.concatenate([n for _, n in found] or [np.zeros(0, np.int64)])
        order = np.lexsort((-need, symbol))
        symbol, need = symbol[order], need[order]
        keep = np.ones(len(symbol), bool)
        keep[1:] = symbol[1:] != symbol[:-1]
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[(symbol >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return bitmap, symbol[keep], need[keep], tables

    def _hits(self, words: np.ndarray):
        """(item, word at which the item would begin, word that begins the window) of all windows that share a table's key with an item."""
        for n, (keys, item) in self.exact.items():
            key = _window_key(words, n)
            for i, at in _matched(keys, item, key, np.arange(len(key))):
                yield i, at, at
        if not self.tables:
            return
        pad = self.longest + 1
        padded, pairs = np.zeros(len(words) + 2 * pad, np.uint64), np.zeros(len(words) + 2 * pad + 1, np.uint64)
        padded[pad : pad + len(words)] = words
        pairs[pad + 1 : pad + len(words) + 1] = pairs_of(words)
        for (walk, back), steps in self.tables.items():
            walker = _Walker(padded, pairs, walk, back)
            bits = mix(padded ^ _SEED[walk])
            at = np.arange(pad, pad + len(words))
            for f, (bitmap, symbols, most, tables) in enumerate(steps):
                here = walker.pairs[at]
                live = np.flatnonzero(bitmap[(here >> np.uint64(64 - _BITS)).astype(np.int64)])
                if len(live) and len(symbols):
                    place = np.minimum(np.searchsorted(symbols, here[live]), len(symbols) - 1)
                    ok = symbols[place] == here[live]
                    live, need = live[ok], most[place[ok]]
                    order = np.argsort(need, kind="stable")
                    live, need = live[order], need[order]
                    done = 0
                    while done < len(live):
                        to = min(len(live), done + max(1, EMITTED // self.longest))
                        for part, start in self._walk_on(walker, tables, f, live[done:to], at[live[done:to]], need[done:to]):
                            yield self.part_item[part], start - self.part_at[part] - (self.part_size[part] - 1 if back else 0), start
                        done = to
                at = at + walker.move * ((bits[at] >> np.uint64(f)) & np.uint64(1)).astype(np.int64)

    def _walk_on(self, walker: _Walker, tables, f: int, start: np.ndarray, at: np.ndarray, need: np.ndarray):
        """(window of an item, start) of the windows from `start`, whose walks stand at `at` in step f, that share a key; need is ascending."""
        emitted = np.zeros((int(need[-1]) - f, len(start)), np.uint64)
        for j in range(f, int(need[-1])):
            low = int(np.searchsorted(need, j, "right"))
            emitted[j - f, low:] = walker.pairs[at[low:]]
            at[low:] += walker.move * walker.bit(at[low:], j)
        for steps, second, keys, item in tables:
            own = np.arange(int(np.searchsorted(need, steps, "left")), len(start))
            if not len(own):
                continue
            key = _key(emitted[[0, second - f] if second > f else [0]][:, own])
            yield from _matched(keys, item, key, start[own])

    def candidates(self, words: np.ndarray, at: np.ndarray):
        """(row, item, word at which the item would begin), in parts, as far as enough of the item's words are near their places."""
        held, n = [], 0
        for item, begin, start in self._hits(words):
            held.append(np.stack([np.searchsorted(at, start, "right") - 1, item, begin]))
            n += len(item)
            if n >= HITS:
                yield self._filtered(words, held)
                held, n = [], 0
        if held:
            yield self._filtered(words, held)

    def _filtered(self, words: np.ndarray, held: list[np.ndarray]) -> np.ndarray:
        both = np.concatenate(held, axis=1)
        both = both[:, np.lexsort(both)]
        keep = np.ones(both.shape[1], bool)
        keep[1:] = (both[:, 1:] != both[:, :-1]).any(0)
        both = both[:, keep]
        return both[:, self._near(words, both[1], both[2])]

    def _near(self, words: np.ndarray, item: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Whether all words of the item but the edits allowed occur within twice so many places of theirs; items over FILTERED_WORDS pass."""
        size = self.size[item]
        out = np.ones(len(item), bool)
        for n in np.unique(size[size <= FILTERED_WORDS]).tolist():
            most, of = most_edits(n), np.flatnonzero(size == n)
            for part in np.array_split(of, -(-len(of) * n // (1 << 20))):
                own = np.stack([self.words[i] for i in item[part].tolist()])
                there = np.clip(begin[part, None] + np.arange(-2 * most, n + 2 * most), 0, len(words) - 1)
                around, same = words[there], np.zeros(own.shape, bool)
                for shift in range(4 * most + 1):
                    same |= around[:, shift : shift + n] == own
                out[part] = same.sum(1) >= n - most
        return out

    def distance(self, i: int, text: np.ndarray) -> int:
        """The least number of word edits between item i and any stretch of the text (Myers)."""
        words = self.words[i]
        m = len(words)
        if i not in self.peq:
            own: dict[int, int] = defaultdict(int)
            for k, w in enumerate(words.tolist()):
                own[w] |= 1 << k
            self.peq[i] = dict(own)
        peq, full, top = self.peq[i], (1 << m) - 1, 1 << (m - 1)
        pv, mv, score, best = full, 0, m, m
        for w in text.tolist():
            eq = peq.get(w, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv) & full, pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = ph << 1 & full, mh << 1 & full
            pv, mv = mh | ~(xv | ph) & full, ph & xv
            if score < best:
                best = score
        return best

    def matches(self, words: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, edits, words of the item): the fewest edits for each item that a row holds."""
        todo: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
        for row, item, begin in self.candidates(words, at):
            size = self.size[item]
            slack = 2 * np.floor(MOST_EDITS * size + 1e-9).astype(np.int64)
            for r, i, x, y in zip(row.tolist(), item.tolist(), np.maximum(begin - slack, at[row]).tolist(), np.minimum(begin + size + slack, at[row + 1]).tolist(), strict=True):
                if x < y:
                    todo[r, i].add((x, y))
        out = []
        for (r, i), regions in todo.items():
            most, best = most_edits(len(self.words[i])), len(self.words[i])
            regions = sorted(regions)
            merged = [list(regions[0])]
            for x, y in regions[1:]:
                if x <= merged[-1][1]:
                    merged[-1][1] = max(y, merged[-1][1])
                else:
                    merged.append([x, y])
            for x, y in merged:
                if y - x >= len(self.words[i]) - most:
                    best = min(best, self.distance(i, words[x:y]))
                if best == 0:
                    break
            if best <= most:
                out.append((r, i, best, len(self.words[i])))
        return out


def item_blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> list[tuple[list, list]]:
    """The items, collected in blocks of about `limit` bytes of text, one at a time."""
    rows = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    n = max(1, -(-size // limit))
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect() if n > 1 else rows.collect()
        yield [r.item_id for r in part], [r.text for r in part]


def matches(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", item_bytes: int = ITEM_BYTES, least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for each row of `docs` and item that it holds: doc_id, item_id, edits, item_words, similarity."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema[item_id].dataType.simpleString()
    out = None
    for ids, texts in item_blocks(benchmark, item_id, item_text, item_bytes):
        shipped = docs.sparkSession.sparkContext.broadcast((ids, texts))  # item_bytes at most, and the largest item

        def run(batches, shipped=shipped):
            items = Items(*shipped.value, least_words)
            for batch in batches:
                for a, b, words, at in words_of(batch.column(1)):
                    found = items.matches(words, at)
                    if found:
                        r, i, edits, size = zip(*found, strict=True)
                        named = pa.array([items.ids[k] for k in i])
                        similar = [1 - e / s for e, s in zip(edits, size, strict=True)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(r)), named, pa.array(edits, pa.int32()), pa.array(size, pa.int32()), pa.array(similar)], ["doc_id", "item_id", "edits", "item_words", "similarity"])

        part = rows.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, edits int, item_words int, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_text: str = "text", item_id: str = "item_id", item_bytes: int = ITEM_BYTES, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of `docs`, with all columns, that hold no item."""
    schema, names = docs.schema, docs.columns
    at = names.index(text)
    for ids, texts in item_blocks(benchmark, item_id, item_text, item_bytes):
        shipped = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches, shipped=shipped):
            items = Items(*shipped.value, least_words)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, _, words, offsets in words_of(batch.column(at)):
                    keep[[a + r for r, *_ in items.matches(words, offsets)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
