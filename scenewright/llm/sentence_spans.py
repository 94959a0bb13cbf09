"""Substring dedup by sliding sentence spans.

A sentence ends after a word with a final . ! or ? (quotes and brackets may follow) and at a line break.  Every run of
consecutive sentences is hashed: for each sentence the shortest run that begins with it, and the shortest that ends with
it, of at least SENTENCES sentences and LEAST_WORDS words; case of A-Z and white space don't matter.  The first occurrence
of a run, by doc_id, the text's hash and then by place, stays; every later one is a repeat, and the sentences that any repeat covers are
removed.

1. One pass hashes all runs; a task keeps the first occurrence of each hash and sends (hash, row, place) packed by
   bucket, so a passage that is everywhere leaves a task once.  In a bucket the first occurrence of each hash that came
   more than once is found.
2. A second pass hashes the runs again, and sends those whose hash a fixed-size bitmap of repeated hashes may hold; the
   join with the first occurrences is exact and can be split at a frequent hash.
3. The repeats of a document, packed as covered sentences, join the documents by row and the text is cut.

A row is known by its doc_id and the hash of its whole text.

Defined results: null text counts as empty and stays null; a null doc_id comes after all others; rows that repeat a
doc_id and the whole text are the same document and both stay, but rows without a doc_id are separate documents, of which
the further ones with an equal text are repeats of the first; rows that repeat a doc_id with another text are separate
documents; ids that aren't integers come in the order of the hashes of their texts; texts without a long enough run are
unchanged; texts of any length are cut whole; an empty table gives no rows; extra columns stay as they are, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenewright.functions.store import saved
from scenewright.llm._text import column_bytes, doc_groups, hash_runs, mix, spans, unused

SENTENCES, LEAST_WORDS = 2, 15
#: Bits of the bitmap of repeated hashes, whatever the input.
BITS = 1 << 26
BLOCK, SEGMENT_WORDS = 2 << 20, 200_000
HELD = 400_000
LAST = np.iinfo(np.int64).max

_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True
_CLOSER = np.zeros(256, bool)
_CLOSER[[34, 39, 41, 93]] = True


def sentences(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, hash, words) of each sentence, and the n + 1 offsets of each row's sentences."""
    first, last = spans(buf, offsets)
    n = len(first)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    hashes = np.concatenate([hash_runs(buf, first[a : a + SEGMENT_WORDS], last[a : a + SEGMENT_WORDS]) for a in range(0, n, SEGMENT_WORDS)])
    tail = last - 1
    for _ in range(2):
        tail = np.where(_CLOSER[buf[tail]] & (tail > first), tail - 1, tail)
    stop = _STOP[buf[tail]]
    lines = np.concatenate([[0], np.cumsum(buf == 10)])
    begin = np.ones(n, bool)
    begin[1:] = stop[:-1] | (lines[first[1:]] > lines[last[:-1]])
    edges = np.searchsorted(first, offsets, "left")
    begin[edges[:-1][edges[:-1] < n]] = True
    at = np.flatnonzero(begin)
    words = np.diff(np.append(at, n))
    place = np.arange(n) - np.repeat(at, words)
    scale = np.ones(int(words.max()), np.uint64)
    scale[1:] = np.uint64(0x9E3779B97F4A7C15)
    scale = np.cumprod(scale, dtype=np.uint64)
    total = np.add.reduceat(hashes * scale[place], at)
    return first[at], mix(total + words.astype(np.uint64)), words, np.searchsorted(at, edges, "left")


def runs(hashes: np.ndarray, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first sentence, one after the last) of all runs of all rows, each run once; sentences count over all rows."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    upto = np.concatenate([[0], np.cumsum(words)])
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    row_start = np.repeat(offsets[:-1], np.diff(offsets))
    i = np.arange(n)
    end = np.maximum(i + SENTENCES, np.searchsorted(upto, upto[i] + LEAST_WORDS, "left"))
    start = np.minimum(i + 1 - SENTENCES, np.searchsorted(upto, upto[i + 1] - LEAST_WORDS, "right") - 1)
    ok, ok2 = end <= row_end, start >= row_start
    a, b = np.concatenate([i[ok], start[ok2]]), np.concatenate([end[ok], i[ok2] + 1])
    code = np.unique(a * (n + 1) + b)
    a, b = code // (n + 1), code % (n + 1)
    size = b - a
    at = np.cumsum(size) - size
    total = int(size.sum())
    place = np.arange(total) - np.repeat(at, size)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max(initial=1)) - 1, np.uint64(0xC2B2AE3D27D4EB4F), np.uint64)]), dtype=np.uint64)
    value = np.add.reduceat(hashes[np.repeat(a, size) + place] * powers[place], at) if total else np.zeros(0, np.uint64)
    return mix(value + size.astype(np.uint64) * np.uint64(0x165667B19E3779F9)), a, b


def _runs_of(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, doc, hash of the text, first sentence, one after the last) of blocks of rows; sentences count within each row."""
    for batch in batches:
        ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
        sums = batch.column(2).to_numpy(zero_copy_only=False)
        buf, offsets = column_bytes(batch.column(1))
        for a, b in doc_groups(offsets, BLOCK):
            _, hashes, words, at = sentences(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            h, s, e = runs(hashes, words, at)
            row = np.searchsorted(at, s, "right") - 1
            yield h, ids[a:b][row], sums[a:b][row], s - at[row], e - at[row]


def _firsts(h, doc, sum_, place) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each hash with its first occurrence and whether it came more than once."""
    order = np.lexsort((place, sum_, doc, h))
    h, doc, sum_, place = h[order], doc[order], sum_[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (sum_[1:] != sum_[:-1]) | (place[1:] != place[:-1])
    many = np.add.reduceat(new, first) > 1 if len(h) else np.zeros(0, bool)
    return h[first], doc[first], sum_[first], place[first], many


def repeated(docs: DataFrame) -> DataFrame:
    """hash, doc, sum, place: the first occurrence of each run that comes more than once.  docs: id (long), text, sum (its hash)."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * partitions

    def packed(parts):
        h, doc, sum_, place, many = _firsts(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        bucket = (h & np.uint64(0xFFFFF)) * np.uint64(buckets) >> np.uint64(20)
        order = np.argsort(bucket, kind="stable")
        bucket, columns = bucket[order], [x[order] for x in (h, doc, sum_, place.astype(np.uint32), many)]
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else [0]
        cut = list(zip(edges[:-1], edges[1:], strict=True))
        return pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in cut], pa.int32()), pa.array([b - a for a, b in cut], pa.int32()), pa.array([b"".join(c[a:b].tobytes() for c in columns) for a, b in cut], pa.binary())], ["bucket", "m", "data"])

    def send(batches):
        parts = []
        for h, doc, sum_, s, _ in _runs_of(batches):
            parts.append((h, doc, sum_, s))
            if sum(len(p[0]) for p in parts) >= HELD:
                yield packed(parts)
                parts = []
        if parts:
            yield packed(parts)

    def meet(batches):
        bucket, parts = None, []

        def found():
            h, doc, sum_, place, many = (np.concatenate(x) for x in zip(*parts, strict=True))
            often = np.unique(h[many])
            h1, doc1, sum1, place1, many1 = _firsts(h, doc, sum_, place.astype(np.int64))
            keep = many1 | np.isin(h1, often)
            return pa.RecordBatch.from_arrays([pa.array(h1[keep].view(np.int64)), pa.array(doc1[keep], pa.int64()), pa.array(sum1[keep], pa.int64()), pa.array(place1[keep], pa.int64())], ["hash", "doc", "sum", "place"])

        for batch in batches:
            for k, m, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != bucket and parts:
                    yield found()
                    parts = []
                bucket = k
                parts.append((np.frombuffer(data, np.uint64, m), np.frombuffer(data, np.int64, m, 8 * m), np.frombuffer(data, np.int64, m, 16 * m), np.frombuffer(data, np.uint32, m, 24 * m), np.frombuffer(data, bool, m, 28 * m)))
        if parts:
            yield found()

    blobs = docs.mapInArrow(send, "bucket int, m int, data binary")
    return blobs.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "hash long, doc long, sum long, place long")


def covered(docs: DataFrame, first: DataFrame) -> DataFrame:
    """doc, sum, cover: the sentences of each document that repeats cover, as arrays of first sentences and ends."""
    spark = docs.sparkSession
    place = F.pmod("hash", F.lit(BITS)) + 1
    bits = np.zeros(BITS // 8, np.uint8)
    for r in first.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).toLocalIterator():
        part = np.frombuffer(bytes(r.bits), np.uint8)
        bits[(r.block - 1) * len(part) : r.block * len(part)] = part
    shipped = spark.sparkContext.broadcast(bits)

    def likely(batches):
        table = shipped.value
        for h, doc, sum_, s, e in _runs_of(batches):
            p = h & np.uint64(BITS - 1)
            hit = table[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1 > 0
            yield pa.RecordBatch.from_arrays([pa.array(h[hit].view(np.int64)), pa.array(doc[hit], pa.int64()), pa.array(sum_[hit], pa.int64()), pa.array(s[hit], pa.int64()), pa.array(e[hit], pa.int64())], ["hash", "at_doc", "at_sum", "s", "e"])

    met = docs.mapInArrow(likely, "hash long, at_doc long, at_sum long, s long, e long").join(first, "hash")
    again = met.filter("at_doc <> doc OR at_sum <> sum OR s <> place")
    return again.groupBy(F.col("at_doc").alias("doc"), F.col("at_sum").alias("sum")).agg(F.collect_set(F.struct("s", "e")).alias("cover"))


def _number(docs: DataFrame, doc_id: str) -> Column:
    """The place of a row's id in the order of documents."""
    id_ = F.col(f"`{doc_id}`")
    if docs.schema[doc_id].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return id_.cast("long")
    return F.when(id_.isNotNull(), F.xxhash64(id_.cast("string")))


def remove(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", report: bool = False) -> DataFrame:
    """`docs` with repeated sentences cut from the text; with `report`, two further columns, the numbers of sentences and of
    those removed: __sentences and __removed, after more underscores where a column has such a name."""
    from pyspark.sql.types import LongType, StructField, StructType

    doc_, sum_name, again_, cover_, all_, gone_ = unused(docs.columns, "__doc", "__sum", "__again", "__cover", "__sentences", "__removed")
    plain = docs.select(_number(docs, doc_id).alias("id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("sum", F.xxhash64("text"))
    first = saved(repeated(plain), "repeats")
    cover = saved(covered(plain, first), "cover")
    number, sum_ = _number(docs, doc_id), F.xxhash64(F.col(f"`{text}`").cast("string"))
    again = F.row_number().over(Window.partitionBy(sum_name).orderBy(doc_)) > 1  # rows without an id and with an equal text
    named = docs.filter(number.isNotNull()).withColumns({doc_: number, sum_name: sum_, again_: F.lit(False)})
    unnamed = docs.filter(number.isNull()).withColumns({doc_: F.lit(LAST), sum_name: sum_}).withColumn(again_, again)
    joined = named.unionByName(unnamed).join(cover.withColumnsRenamed({"doc": doc_, "sum": sum_name, "cover": cover_}), [doc_, sum_name], "left")
    joined = joined.select(*[F.col(f"`{c}`") for c in docs.columns], again_, cover_)
    at = docs.columns.index(text)
    extra = [StructField(all_, LongType()), StructField(gone_, LongType())] if report else []
    schema = StructType([*docs.schema.fields, *extra])

    def cut(batches):
        for batch in batches:
            column, cover = batch.column(at), batch.column(batch.num_columns - 1)
            buf, offsets = column_bytes(column)
            pieces: list[bytes | None] = []
            counts, gone_counts = [], []
            known = column.is_valid().to_pylist()
            copies = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
            for a, b in doc_groups(offsets, BLOCK):
                own = buf[offsets[a] : offsets[b]]
                off = offsets[a : b + 1] - offsets[a]
                start, hashes, words, rows = sentences(own, off)
                _, first_of, end_of = runs(hashes, words, rows) if copies[a:b].any() else (None, None, None)
                for i in range(a, b):
                    s, e = int(rows[i - a]), int(rows[i - a + 1])
                    gone = np.zeros(e - s + 1, np.int64)
                    for c in (cover[i].as_py() or []) if cover[i].is_valid else []:
                        gone[c["s"]] += 1
                        gone[c["e"]] -= 1
                    if copies[i]:
                        here = (first_of >= s) & (first_of < e)
                        np.add.at(gone, first_of[here] - s, 1)
                        np.add.at(gone, end_of[here] - s, -1)
                    out = np.cumsum(gone[:-1]) > 0
                    raw = own[off[i - a] : off[i - a + 1]].tobytes()
                    if out.any():
                        base = int(off[i - a])
                        edge = [0, *(start[s + 1 : e] - base).tolist(), len(raw)]
                        raw = b"".join(raw[edge[k] : edge[k + 1]] for k in np.flatnonzero(~out).tolist())
                    pieces.append(raw if known[i] else None)
                    counts.append(e - s)
                    gone_counts.append(int(out.sum()))
            columns = [*batch.columns[:at], pa.array([None if p is None else p.decode() for p in pieces], pa.string()), *batch.columns[at + 1 : -2]]
            if report:
                columns += [pa.array(counts, pa.int64()), pa.array(gone_counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return joined.mapInArrow(cut, schema)


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences, n_removed and the SHA-256 of what is left, for all rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove(docs, report=True)
    total, gone = out.columns[-2:]
    return out.select("doc_id", F.col(total).alias("n_sentences"), F.col(gone).alias("n_removed"), F.octet_length(F.coalesce("text", F.lit(""))).alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
