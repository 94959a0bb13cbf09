"""Exact similarity self-join on word shingles with adaptive multi-match prefixes.

Two texts link when their sets of five-word shingles have a Jaccard similarity of at least 0.8.  Shingles have one global
order, rarest first, from a count sketch of bounded size over all documents.  Linked sets share at least l of their first
n - ceil(0.8 n) + l shingles, for every l; each document chooses its own l, the one for which the estimated cost (postings
met in the lists of its prefix, plus verification of the candidates that can reach l matches) is least.  A longer prefix
so asks for more shared prefix shingles before a pair is verified.  For two documents the smaller of their l holds.

Stages, each written or shuffled in packed form:

1. sketch: one pass gives each row its set's id and size, and the sketch (of bounded size, summed by block in the cluster);
2. postings: (shingle, set, size, level, l, end) of all prefixes, packed by bucket and shuffled.  Equal sets have one id,
   so groups of exact copies count once; a shingle that the sketch gives more than HOT sets is dealt over several buckets;
3. lists: in a bucket, lists of up to SHORT sets give their pairs, with counts; longer lists are kept, in parts.  Each set learns how
   many of its prefix shingles another set's prefix has.  Of two sets, the one whose prefix ends first in the global order
   can't share its unmatched prefix shingles with the other, which bounds the overlap (`_possible`): documents that only
   have a passage in common go here, as do pairs with fewer matches than the smaller l asks for;
4. one more pass ships the shingles, and a parity bitmap of them, of the sets that are left; a bitmap of their texts' hashes
   says which, or a semi-join where they are too many for it;
5. long lists: two parity bitmaps differ in at most as many bits as the sets differ in shingles, which rules out most
   pairs.  Each member is first paired with the list's leader, the member with the fewest unmatched shingles, by a join;
   members that verified links already join aren't paired again.  What is left (members outside the list's largest component
   against all members) is paired exactly in pieces of PIECE members, so no list is one task.  A large group of near copies
   costs about as many pairs as it has members, and no link between different components is lost;
6. each pair is verified exactly, 100 * intersection >= 80 * union, and the links form components of sets (distributed),
   named by the smallest doc_id of their rows.

Sets are compared by 64-bit hashes of their shingles and named by a 64-bit hash of the set; a false result needs a
collision (about n^2 / 2^65 for n distinct sets).

Defined results: null text counts as empty; a text without words has an empty set, links with nothing and is its own
component; a text of one to four words has one shingle, the sequence; equal sets always link; repeated rows are rows of
their own with the same component; rows are linked by their texts alone, so rows that share a doc_id with different texts
don't link by that, and rows with a null doc_id link, and join others, like any row; a component in which no row has a
doc_id is null; texts of any length are taken whole; an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.functions.store import drop, saved
from scenewright.llm._text import column_bytes, doc_groups, mix, shingles, word_hashes
from scenewright.operators.components import components

WIDTH = 5
NUMBER, OF = 4, 5  # the similarity as a fraction
#: Bits of the candidates' bitmap; for more than an eighth as many sets a semi-join takes its place.
BITS = 1 << 26
#: Counters of the sketch: one for so many bytes of text, within these; and its blocks.
BYTES_A_COUNTER, LEAST_COUNTERS, MOST_COUNTERS, BLOCKS = 40, 1 << 18, 1 << 26, 256
BLOCK = 2 << 20
#: Prefix extensions that a document may choose from, and what one verification costs, in postings.
CHOICES, VERIFY = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32), 20.0
SHORT = 24
#: Sets of one shingle that go to one bucket, about; members of a long list that are paired in one place.
HOT, PIECE = 1024, 256
SALTS = 64
LEAST_BUCKETS = 64
#: Postings that a task holds before it sends them, and rows of an Arrow batch while whole texts are read.
HELD, ROWS = 300_000, 2000
#: Added to the level of a shingle whose sets are dealt over several buckets.
DEALT = 128
#: Bits of a set's parity bitmap: four for each shingle, within these.
LEAST_PARITY, MOST_PARITY = 256, 8192


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows [a, b) with their sorted distinct shingles and offsets."""
    buf, offsets = column_bytes(column)
    for a, b in doc_groups(offsets, BLOCK):
        words, at = word_hashes(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b, *shingles(words, at, WIDTH)


def set_ids(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for the empty one."""
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    n = np.diff(at)
    name = mix((upto[at[1:]] - upto[at[:-1]]) ^ mix(n.astype(np.uint64)))
    return np.where(n > 0, name, np.uint64(0)).view(np.int64)


def need(n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of this size with any set it links to."""
    return -(-NUMBER * n // OF)


def _counter(tokens: np.ndarray, counters: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) * np.uint64(counters) >> np.uint64(32)).astype(np.int64)


def sketch_size(docs: DataFrame) -> int:
    """Counters for all texts of `docs`."""
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    return min(MOST_COUNTERS, max(LEAST_COUNTERS, size // BYTES_A_COUNTER)) // BLOCKS * BLOCKS


def _sketch_pass(docs: DataFrame, counters: int) -> DataFrame:
    """A row for each row of docs (block null), and the sketch's blocks (block not null)."""
    names = ["doc_id", "text_hash", "set_id", "n_shingles", "block", "counts"]

    def blocks(counts, kind):
        """The gaps between counters that aren't 0, then what they hold beyond 1; byte by byte, the low ones first."""
        used, data = [], []
        for i, part in enumerate(counts.reshape(BLOCKS, -1)):
            at = np.flatnonzero(part)
            if len(at):
                gap, more = np.diff(at, prepend=-1) - 1, part[at] - np.uint16(1)
                press = zlib.compressobj(1, strategy=zlib.Z_RLE)
                used.append(i)
                data.append(press.compress(b"".join((x >> k & 0xFF).astype(np.uint8).tobytes() for x, k in ((gap, 0), (gap, 8), (gap, 16), (more, 0), (more, 8)))) + press.flush())
        n = len(used)
        return pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(used, pa.int32()), pa.array(data, pa.binary())], names)

    def run(batches):
        counts, rows, kind = np.zeros(counters, np.uint16), 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b, tokens, at in shingle_sets(batch.column(1)):
                n = b - a
                if rows + n > 0xFFFF:  # a counter holds as many
                    yield blocks(counts, kind)
                    counts[:], rows = 0, 0
                rows += n
                np.add.at(counts, _counter(tokens, counters), np.uint16(1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), batch.column(2).slice(a, n), pa.array(set_ids(tokens, at)), pa.array(np.diff(at), pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if kind is not None:
            yield blocks(counts, kind)

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, set_id long, n_shingles long, block int, counts binary")


#: Counts as one byte: exact below 64, then eight steps for each doubling.
_COUNT_OF = np.concatenate([np.arange(64.0), 64 * 2.0 ** (np.arange(192) / 8)])


def _sketch(blocks: DataFrame, counters: int) -> np.ndarray:
    """Sums the blocks in the cluster; MOST_COUNTERS bytes at most reach the driver."""
    per = counters // BLOCKS

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = total.setdefault(i, np.zeros(per, np.int64))
                raw = np.frombuffer(zlib.decompress(data), np.uint8)
                byte = raw.reshape(5, -1).astype(np.int64)
                at = np.cumsum((byte[0] | byte[1] << 8 | byte[2] << 16) + 1) - 1
                own[at] += 1 + (byte[3] | byte[4] << 8)
        coded = [(np.searchsorted(_COUNT_OF, v, "right") - 1).astype(np.uint8).tobytes() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(coded, pa.binary())], ["block", "counts"])

    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = np.zeros((BLOCKS, per), np.uint8)
    for r in blocks.select("block", "counts").repartition(min(n, BLOCKS), "block").mapInArrow(run, "block int, counts binary").toLocalIterator():
        out[r.block] = np.frombuffer(bytes(r.counts), np.uint8)
    return out.reshape(-1)


def prefixes(tokens: np.ndarray, at: np.ndarray, sketch: np.ndarray, others: float | None = None) -> tuple[np.ndarray, ...]:
    """The chosen prefix of each set: token, row, level (the least l whose prefix has the token); each row's l, and where
    its prefix ends in the global order (rounded down, so only an inequality tells)."""
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    seen = sketch[_counter(tokens, len(sketch))]
    order = np.lexsort((tokens, seen, row))
    tokens, seen = tokens[order], seen[order]
    # what the counter holds beyond other shingles' share, one at least
    others = noise(sketch) if others is None else others
    cost = np.concatenate([[0.0], np.cumsum(np.maximum(_COUNT_OF[seen] - others, 1.0))])
    least, base = need(n), n - need(n)
    best, chosen = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for choice in CHOICES:
        last = np.minimum(base + choice, n)
        postings = cost[at[:-1] + last] - cost[at[:-1]]
        price = np.where(choice <= least, postings + VERIFY * (postings - last) / choice, np.inf)
        better = price < best
        best, chosen = np.where(better, price, best), np.where(better, choice, chosen)
    place = np.arange(len(tokens)) - np.repeat(at[:-1], n)
    used = (place < (base + chosen)[row]) & (seen > 1)  # no other row has a shingle that was counted once
    end = np.zeros(len(n), np.uint32)
    full = n > 0
    last = (at[:-1] + np.minimum(base + chosen, n) - 1)[full]
    end[full] = seen[last].astype(np.uint32) << np.uint32(24) | (tokens[last] >> np.uint64(40)).astype(np.uint32)
    return tokens[used], row[used], np.maximum(place - base[row] + 1, 1)[used], chosen, end


def noise(sketch: np.ndarray) -> float:
    """The mean of the counters: what other shingles add to one, about."""
    held = sum(np.bincount(part, minlength=256) for part in np.array_split(sketch, max(1, len(sketch) >> 20)))
    return float((held * _COUNT_OF).sum() / len(sketch))


def _postings(docs: DataFrame, sketch, buckets: int, hot: int = HOT) -> DataFrame:
    """Rows (bucket, m, data): data is m tokens, set ids, sizes, levels (DEALT added for a shingle in several buckets), l and
    prefix ends, one array after the other."""

    def packed(parts):
        token, *rest, bucket = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(bucket, kind="stable")
        bucket, columns = bucket[order], [token[order], *(x[order] for x in rest)]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        edges = [0, *cuts.tolist(), len(bucket)] if len(bucket) else [0]
        spans = list(zip(edges[:-1], edges[1:], strict=True))
        return pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in spans], pa.int32()), pa.array([b - a for a, b in spans], pa.int32()), pa.array([b"".join(c[a:b].tobytes() for c in columns) for a, b in spans], pa.binary())], ["bucket", "m", "data"])

    def run(batches):
        table, others = sketch.value
        known: set[int] = set()
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for a, b, tokens, at in shingle_sets(batch.column(1)):
                ids = set_ids(tokens, at)
                fresh = np.array([i not in known and not known.add(i) for i in ids.tolist()], bool) & (ids != 0)
                token, row, level, chosen, end = prefixes(tokens, at, table, others)
                keep = fresh[row]
                token, row, level = token[keep], row[keep], level[keep]
                pieces = np.ceil(_COUNT_OF[table[_counter(token, len(table))]] / hot).astype(np.uint64)
                piece = np.where(pieces > 1, mix(ids[row].view(np.uint64)) % pieces, np.uint64(0))
                place = np.where(piece > 0, mix(token + piece * np.uint64(0x9E3779B97F4A7C15)), token)
                bucket = ((place & np.uint64(0xFFFFF)) * np.uint64(buckets) >> np.uint64(20)).astype(np.int32)
                marked = level.astype(np.uint8) + np.uint8(DEALT) * (pieces > 1)
                parts.append((token, ids[row], np.diff(at)[row].astype(np.uint32), marked, chosen[row].astype(np.uint8), end[row], bucket))
                if sum(len(p[0]) for p in parts) >= HELD:
                    yield packed(parts)
                    parts = []
        if parts:
            yield packed(parts)

    return docs.mapInArrow(run, "bucket int, m int, data binary")


_FIELDS = (np.uint64, np.int64, np.uint32, np.uint8, np.uint8, np.uint32)


def _unpack(m: int, data: bytes, fields=_FIELDS) -> list[np.ndarray]:
    out, at = [], 0
    for kind in fields:
        out.append(np.frombuffer(data, kind, m, at))
        at += m * np.dtype(kind).itemsize
    return out


def _allowed(n1, n2, level1, level2, l1, l2) -> np.ndarray:
    """Sizes that can link, and a token that counts for the smaller l."""
    low, high = np.minimum(n1, n2).astype(np.int64), np.maximum(n1, n2).astype(np.int64)
    return (OF * low >= NUMBER * high) & (np.maximum(level1, level2) <= np.minimum(l1, l2))


def _counted(a: np.ndarray, b: np.ndarray, needs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs (smaller id first), how often each came, and the matches it needs."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high, needs = low[order], high[order], needs[order]
    first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])) if len(low) else np.zeros(0, np.int64)
    return low[first], high[first], np.diff(np.append(first, len(low))), needs[first]


_OUT = "kind int, a long, b long, matches long, needs int, data binary"


def _out(kind: int, a, b, matches, needs, data=None) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(matches, pa.int64()), pa.array(needs, pa.int32()), pa.array(data, pa.binary()) if data is not None else pa.nulls(n, pa.binary())], ["kind", "a", "b", "matches", "needs", "data"])


def _in_bucket(token, ids, n, level, ell, end, short: int = SHORT) -> Iterator[pa.RecordBatch]:
    """Kind 0: pairs of short lists; 2: long lists, or this bucket's part of one; 3: in `matches` how many of a set's tokens another set has too,
    plus 2^32 times those of them in long lists; in b its size and prefix end, in `needs` its l."""
    order = np.lexsort((ids, token))
    token, ids, n, level, ell, end = (x[order] for x in (token, ids, n, level, ell, end))
    if len(token) > 1:  # an equal set from another batch
        same = np.concatenate([[False], (token[1:] == token[:-1]) & (ids[1:] == ids[:-1])])
        if same.any():
            token, ids, n, level, ell, end = (x[~same] for x in (token, ids, n, level, ell, end))
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(token)))
    long = (size > short) | (level[begin] >= DEALT)
    level = level % np.uint8(DEALT)
    found = []
    for m in np.unique(size[(size > 1) & ~long]).tolist():
        i, j = np.triu_indices(m, 1)
        start = begin[(size == m) & ~long][:, None]
        x, y = (start + i).ravel(), (start + j).ravel()
        ok = _allowed(n[x], n[y], level[x], level[y], ell[x], ell[y])
        x, y = x[ok], y[ok]
        found.append((ids[x], ids[y], np.minimum(ell[x], ell[y]).astype(np.int64)))
    if found:
        yield _out(0, *_counted(*(np.concatenate(x) for x in zip(*found, strict=True))))
    for start, m in zip(begin[long].tolist(), size[long].tolist(), strict=True):
        yield _out(2, [int(token[start].view(np.int64))], [0], [m], [0], [b"".join(x[start : start + m].tobytes() for x in (ids, n, level, ell, end))])
    met, of = np.repeat((size > 1) | long, size), np.repeat(long, size)
    matched, first, back = np.unique(ids[met], return_index=True, return_inverse=True)
    counts = np.bincount(back, minlength=len(first)) + (np.bincount(back[of[met]], minlength=len(first)) << 32)
    yield _out(3, matched, n[met][first].astype(np.int64) << 32 | end[met][first].astype(np.int64), counts, ell[met][first].astype(np.int32))


def _lists(postings: DataFrame, partitions: int, short: int = SHORT) -> DataFrame:
    def run(batches):
        bucket, parts = None, []
        for batch in batches:
            for i, m, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i != bucket and parts:
                    yield from _in_bucket(*(np.concatenate(x) for x in zip(*parts, strict=True)), short)
                    parts = []
                bucket = i
                parts.append(_unpack(m, data))
        if parts:
            yield from _in_bucket(*(np.concatenate(x) for x in zip(*parts, strict=True)), short)

    return postings.repartitionById(partitions, F.pmod("bucket", F.lit(partitions))).sortWithinPartitions("bucket").mapInArrow(run, _OUT)


def _known(matched: DataFrame) -> DataFrame:
    """id, n, ell, end, longs (its tokens in long lists) and slack, the most shingles that the set can share with one whose
    prefix ends later."""
    of = matched.groupBy("a").agg(F.sum("matches").alias("s"), F.max("b").alias("b"), F.max("needs").cast("long").alias("ell"))
    of = of.select(F.col("a").alias("id"), F.shiftright("b", 32).alias("n"), "ell", F.col("b").bitwiseAND(F.lit(0xFFFFFFFF)).alias("end"), F.col("s").bitwiseAND(F.lit(0xFFFFFFFF)).alias("m"), F.shiftright("s", 32).alias("longs"))
    prefix = F.least(F.col("n") - F.ceil(F.col("n") * NUMBER / OF) + F.col("ell"), F.col("n"))
    return of.select("id", "n", "ell", "end", "longs", (F.col("n") - prefix + F.col("m")).alias("slack"))


def _likely(short: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of short lists that can still link: enough matches, counting all tokens in long lists as matches, and enough
    possible overlap."""
    sides = [known.select(F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "end", "longs", "slack")]) for c in ("a", "b")]
    pairs = short.groupBy("a", "b").agg(F.sum("matches").alias("matches"), F.min("needs").alias("needs")).join(sides[0], "a").join(sides[1], "b")
    most = F.when(F.col("end_a") < F.col("end_b"), F.col("slack_a")).when(F.col("end_a") > F.col("end_b"), F.col("slack_b")).otherwise(F.greatest("slack_a", "slack_b"))
    enough = F.col("matches") + F.least("longs_a", "longs_b") >= F.col("needs")
    return pairs.filter(enough & ((NUMBER + OF) * most >= NUMBER * (F.col("n_a") + F.col("n_b")))).select("a", "b")


def _bin(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(1.05))).cast("int")


def _members(long: DataFrame, known: DataFrame) -> DataFrame:
    """A row for each member of a long list that may link to another one: token, id, n, level, ell, end, slack.

    A member is compared with what each class of sizes in the list allows at best (by a combinable aggregate), not with
    other members: the smallest size, the latest end, and the greatest slack and earliest end of those whose slack can
    bound a linked pair.  So more may pass than any pair of them allows, and never less."""

    def entries(batches):
        for batch in batches:
            for token, m, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, n, level, ell, end = _unpack(m, data, _FIELDS[1:])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, token), pa.int64()), pa.array(ids), pa.array(level.astype(np.int64))], ["token", "id", "level"])

    rows = long.select(F.col("a").alias("token"), F.col("matches").alias("m"), "data").mapInArrow(entries, "token long, id long, level long")
    # the tables that meet by token are written first, so that a frequent one is a join that adaptive execution can split
    rows = saved(rows.join(known, "id").select("token", "id", "n", "level", "ell", "end", "slack"), "entries")
    strong = F.expr(f"{NUMBER + OF} * slack >= {NUMBER} * (n + ceil(n * {NUMBER} / {OF}))")
    if_strong = lambda c: F.when(strong, F.col(c))
    bands = rows.groupBy("token", _bin(F.col("n")).alias("bin")).agg(
        F.min("n").alias("low"), F.max("end").alias("last"), F.min("id").alias("i"), F.max("id").alias("j"),
        F.max(if_strong("slack")).alias("slack"), F.min(if_strong("end")).alias("first"), F.min(if_strong("id")).alias("si"), F.max(if_strong("id")).alias("sj"),
    ).groupBy("token").agg(F.collect_list(F.struct("bin", "low", "last", "i", "j", "slack", "first", "si", "sj")).alias("bands"))

    def partner(b):
        sizes = NUMBER * (F.col("n") + F.greatest(b["low"], F.expr(f"ceil(n * {NUMBER} / {OF})")))
        near = F.abs(b["bin"] - _bin(F.col("n"))) <= 6  # 1.05 ** 5 is more than the 1.25 that sizes may differ by
        ends_first = ((b["i"] != F.col("id")) | (b["j"] != F.col("id"))) & ((NUMBER + OF) * F.col("slack") >= sizes) & (b["last"] >= F.col("end"))
        ends_last = ((b["si"] != F.col("id")) | (b["sj"] != F.col("id"))) & ((NUMBER + OF) * b["slack"] >= sizes) & (b["first"] <= F.col("end"))
        return near & (ends_first | F.coalesce(ends_last, F.lit(False)))

    return rows.join(saved(bands, "bands"), "token").filter(F.exists("bands", partner)).drop("bands")


def _possible(n1, n2, end1, end2, slack1, slack2) -> np.ndarray:
    """Whether the overlap can be large enough: of two sets, the one whose prefix ends first bounds it by its slack."""
    most = np.where(end1 < end2, slack1, np.where(end1 > end2, slack2, np.maximum(slack1, slack2)))
    return (NUMBER + OF) * most >= NUMBER * (n1 + n2)


def _of_pieces(rows: DataFrame, of_piece, schema: str) -> DataFrame:
    """Runs of_piece(...) over the rows of each piece (the first column); it returns columns."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def finish(parts):
        columns = of_piece(*(np.concatenate(x) if isinstance(x[0], np.ndarray) else [v for p in x for v in p] for x in zip(*parts, strict=True)))
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def run(batches):
        token, parts = None, []
        for batch in batches:
            columns = [c.to_pylist() if pa.types.is_binary(c.type) else np.asarray(c) for c in batch.columns]
            cuts = (np.flatnonzero(np.diff(columns[0])) + 1).tolist()
            for s, e in zip([0, *cuts], [*cuts, len(columns[0])], strict=True):
                if e > s and columns[0][s] != token and parts:
                    yield from finish(parts)
                    parts = []
                if e > s:
                    token = columns[0][s]
                    parts.append([c[s:e] for c in columns[1:]])
        if parts:
            yield from finish(parts)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, rows.columns[0]).sortWithinPartitions(rows.columns[0]).mapInArrow(run, schema)


def parity(tokens: np.ndarray) -> bytes:
    """A bitmap in which each shingle turns one bit over; of two sets' bitmaps at most as many bits differ as shingles."""
    bits = min(MOST_PARITY, max(LEAST_PARITY, 1 << (4 * len(tokens) - 1).bit_length()))
    return np.packbits(np.bincount((tokens >> np.uint64(8)).astype(np.int64) & (bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _fold(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) as they would be with fewer words."""
    return np.bitwise_xor.reduce(bitmaps.reshape(len(bitmaps), -1, words), axis=1)


def _apart(n: np.ndarray, bitmaps: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the parity bitmaps of the pairs differ in more bits than linked sets can."""
    width = np.array([len(b) // 8 for b in bitmaps])
    of_width = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
    place = np.zeros(len(n), np.int64)
    for own in of_width.values():
        place[own] = np.arange(len(own))
    whole = {w: np.frombuffer(b"".join(bitmaps[i] for i in own), np.uint64).reshape(len(own), w) for w, own in of_width.items()}
    out = np.zeros(len(x), bool)
    for u in whole:
        for v in whole:
            at = np.flatnonzero((width[x] == u) & (width[y] == v))
            if len(at):
                w = min(u, v)
                p, q = _fold(whole[u], w), _fold(whole[v], w)
                for s in range(0, len(at), 1 << 16):
                    k = at[s : s + (1 << 16)]
                    differ = np.bitwise_count(p[place[x[k]]] ^ q[place[y[k]]]).sum(1, dtype=np.int64)
                    out[k] = (NUMBER + OF) * differ > (OF - NUMBER) * (n[x[k]] + n[y[k]])
    return out


def _stars(members: DataFrame) -> DataFrame:
    """Each member with the list's leader: a, b."""
    leader = members.groupBy("token").agg(F.max_by(F.struct(*[F.col(c).alias(f"l_{c}") for c in ("id", "n", "end", "slack", "bitmap")]), F.struct(F.col("slack") / F.col("n"), F.xxhash64("id"))).alias("x")).select("token", "x.*")
    leader = saved(leader, "leaders")
    columns = ["id", "n", "end", "slack", "l_id", "l_n", "l_end", "l_slack", "bitmap", "l_bitmap"]

    def near(batches):
        for batch in batches:
            ids, n, end, slack, lead, l_n, l_end, l_slack = (np.asarray(c) for c in batch.columns[:8])
            m = len(ids)
            ok = np.flatnonzero((ids != lead) & (OF * np.minimum(n, l_n) >= NUMBER * np.maximum(n, l_n)) & _possible(n, l_n, end, l_end, slack, l_slack))
            ok = ok[~_apart(np.concatenate([n, l_n]), [*batch.column(8).to_pylist(), *batch.column(9).to_pylist()], ok, ok + m)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array(lead[ok])], ["a", "b"])

    return members.join(leader, "token").select(*columns).mapInArrow(near, "a long, b long").distinct()


def _left_in_lists(members: DataFrame, labels: DataFrame, piece: int = PIECE) -> DataFrame:
    """Possible pairs of members of a long list that no component joins yet: a, b.

    The members outside the list's largest component meet all its members, in pieces of either."""

    def of_piece(other, ids, n, level, ell, end, slack, comp, bitmap):
        """Members outside (other = 1) with all members that are in this piece."""
        x, y = np.flatnonzero(other == 1), np.flatnonzero(other != 1)
        x, y = np.repeat(x, len(y)), np.tile(y, len(x))
        ok = (comp[x] != comp[y]) & (OF * np.minimum(n[x], n[y]) >= NUMBER * np.maximum(n[x], n[y]))
        ok &= _possible(n[x], n[y], end[x], end[y], slack[x], slack[y]) & _allowed(n[x], n[y], level[x], level[y], ell[x], ell[y])
        x, y = x[ok], y[ok]
        near = ~_apart(n, bitmap, x, y)
        return [np.minimum(ids[x], ids[y])[near], np.maximum(ids[x], ids[y])[near]]

    named = members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    parts = named.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    lists = parts.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("m"), F.max("c").alias("c")).filter("m > c")
    lists = saved(lists, "lists")
    pieces = lambda x: F.ceil(x / piece).cast("int")
    rows = named.join(lists.select("token", "main", pieces(F.col("m")).alias("all"), pieces(F.col("m") - F.col("c")).alias("some")), "token")
    values = ["id", "n", "level", "ell", "end", "slack", "comp", "bitmap"]
    own = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    dealt = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    outside = rows.filter("comp <> main").select("token", own("some").alias("p"), dealt("all").alias("q"), F.lit(1).alias("other"), *values)
    every = rows.select("token", dealt("some").alias("p"), own("all").alias("q"), F.lit(0).alias("other"), *values)
    both = outside.unionByName(every).select(F.xxhash64("token", "p", "q").alias("piece"), "other", *values)
    return _of_pieces(both, of_piece, "a long, b long").distinct()


def contents(docs: DataFrame, sets: DataFrame, wanted: DataFrame, size: int = BITS) -> DataFrame:
    """set_id, data (the shingles), bitmap of the wanted sets (set_id).  sets: (set_id, text_hash), the hash of a text that has the set."""
    spark = docs.sparkSession
    wanted = saved(wanted.join(sets, "set_id").select("set_id", "text_hash"), "wanted")
    place = lambda: F.pmod(F.col("text_hash"), F.lit(size))
    full = wanted.count() > size // 8
    if full:  # the bitmap would let too much pass
        docs = docs.join(wanted.select("text_hash").distinct(), "text_hash", "left_semi")
        bits = np.full(size // 8, 255, np.uint8)
    else:
        bits = np.zeros(size // 8, np.uint8)
        at = place() + 1  # the bitmap functions' bucket 1 begins at 1
        blocks = wanted.select(at.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
        for r in blocks.toLocalIterator():  # so many bits, whatever the input
            part = np.frombuffer(bytes(r.bits), np.uint8)
            bits[(r.block - 1) * len(part) : r.block * len(part)] = part
    shipped = spark.sparkContext.broadcast(bits)

    def run(batches):
        table = shipped.value
        known: set[int] = set()  # of this task
        for batch in batches:
            p = np.asarray(batch.column(1))
            chosen = batch.filter(pa.array(table[p >> 3] >> (p & 7).astype(np.uint8) & 1 > 0))
            for _, _, tokens, at in shingle_sets(chosen.column(0)):
                ids = set_ids(tokens, at)
                fresh = [k for k, i in enumerate(ids.tolist()) if i not in known and not known.add(i)]
                each = [tokens[at[k] : at[k + 1]] for k in fresh]
                yield pa.RecordBatch.from_arrays([pa.array(ids[fresh]), pa.array([t.tobytes() for t in each], pa.binary()), pa.array([parity(t) for t in each], pa.binary())], ["set_id", "data", "bitmap"])

    found = docs.select("text", place().alias("p")).mapInArrow(run, "set_id long, data binary, bitmap binary")
    found = found.join(wanted.select("set_id"), "set_id", "left_semi")
    return found.groupBy("set_id").agg(F.first("data").alias("data"), F.first("bitmap").alias("bitmap"))


def verify(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids that link.  held: contents."""
    both = (
        pairs.select("a", "b")
        .join(held.select(F.col("set_id").alias("a"), F.col("data").alias("da")), "a")
        .join(held.select(F.col("set_id").alias("b"), F.col("data").alias("db")), "b")
    )

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(OF * both >= NUMBER * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "da", "db").mapInArrow(compare, "a long, b long")


def join(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", short: int = SHORT, hot: int = HOT, piece: int = PIECE, bits: int = BITS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs`; the last four only change the way there."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(ROWS))
    try:
        return _join(docs, text, doc_id, short, hot, piece, bits)
    finally:
        conf.set(key, before)


def _join(docs: DataFrame, text: str, doc_id: str, short_lists: int, hot: int, piece: int, bits: int) -> DataFrame:
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    counters = sketch_size(rows)
    first = saved(_sketch_pass(rows, counters), "sets")
    of_rows = first.filter("block IS NULL").select("doc_id", "text_hash", "set_id", "n_shingles")
    table = _sketch(first.filter("block IS NOT NULL"), counters)
    sketch = spark.sparkContext.broadcast((table, noise(table)))
    # a set's copies meet by salt first; the salts lead back to the rows
    salted = of_rows.filter("n_shingles > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    sets = salted.groupBy("set_id", "salt").agg(F.min("doc_id").alias("rep"), F.min("text_hash").alias("text_hash")).groupBy("set_id").agg(F.min("rep").alias("rep"), F.min("text_hash").alias("text_hash"), F.collect_set("salt").alias("salts"))
    sets = saved(sets, "reps")

    spent: list[DataFrame] = []  # tables that nothing reads once the links have met

    def held_for_now(df: DataFrame, name: str) -> DataFrame:
        spent.append(saved(df, name))
        return spent[-1]

    lists = held_for_now(_lists(_postings(rows, sketch, max(LEAST_BUCKETS, partitions), hot), partitions, short_lists), "lists")
    known = held_for_now(_known(lists.filter("kind = 3")), "known")
    short = held_for_now(_likely(lists.filter("kind = 0").select("a", "b", "matches", "needs"), known), "short")
    members = held_for_now(_members(lists.filter("kind = 2"), known), "members")
    wanted = short.select(F.explode(F.array("a", "b")).alias("set_id")).unionByName(members.select(F.col("id").alias("set_id"))).distinct()
    held = held_for_now(contents(rows, sets, wanted, bits), "contents")
    links = None
    if not members.isEmpty():
        members = held_for_now(members.join(held.select(F.col("set_id").alias("id"), "bitmap"), "id").select("token", "id", "n", "level", "ell", "end", "slack", "bitmap"), "members")
        links = held_for_now(verify(held_for_now(_stars(members), "stars"), held), "links")
        labels = components(links)
        of = [labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in ("a", "b")]
        short = short.join(of[0], "a", "left").join(of[1], "b", "left").filter("ca IS NULL OR cb IS NULL OR ca <> cb").select("a", "b")
        short = short.unionByName(_left_in_lists(members, labels, piece)).distinct()
    found = verify(short, held)
    links = found if links is None else found.unionByName(links)

    labels = components(links)
    drop(*spent)
    named = labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())
    linked = sets.join(named.withColumnRenamed("node", "set_id"), "set_id", "left")
    least = linked.filter("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("least"))
    names = linked.join(least, "component", "left").select("set_id", F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"), F.explode("salts").alias("salt"))
    full = salted.join(names, ["set_id", "salt"]).select("doc_id", "n_shingles", "component_id")
    return full.unionByName(of_rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
