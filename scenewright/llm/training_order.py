"""Training-order materialisation: token ids in fixed-stride shards, sequences in a keyed pseudo-random order.

The texts in the order of their doc_id (null last), then of their texts' hashes, each followed by the end-of-text id, are
one stream, which is cut into sequences of SEQUENCE ids, the last one padded with end-of-text; so the sequences don't depend
on how the table is split.  Sequence number i of N goes to slot P(i), where P is a keyed Feistel permutation of the next even
power of two, walked along its cycle until it falls below N.  P needs no table: any executor computes any slot, and the
inverse finds the sequence that a slot holds.

1. One pass encodes, and writes the ids of each map task, compressed, to the shared folder.
2. The texts' lengths, range-partitioned by the order, give each text its place in the stream by a running sum (one number
   for each partition on the driver); the places are written to one folder for each map task of step 1.
3. The ids are read with their places, cut where sequences end, and go to the partition that owns the slots, packed and
   compressed by shard.
4. Each partition writes its shards, `SHARD` slots of SEQUENCE ids each, little-endian, under a temporary name that is then
   moved in place, so a repeated task leaves the same file.

`read` returns the sequences from any slot on by seeking to slot * stride in its shard: training can stop and resume at
any slot.  Ids take two bytes where the vocabulary allows it, four otherwise.

Defined results: null texts count as empty, and empty texts give an end-of-text id alone; texts of any length are cut
over as many sequences as they need; an empty table gives a manifest without shards; repeated rows are written each, one after
the other; extra columns don't matter.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.functions import store
from scenewright.llm._text import column_bytes, doc_groups, mix
from scenewright.llm.bpe import PATTERN

SEQUENCE, SHARD = 1024, 2048
ROUNDS = 6
BLOCK = 8 << 20
#: Ids that a task holds before it writes or sends them, and how hard they are compressed.
HELD, LEVELS = 2 << 20, (9, 6)


def feistel(i: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A permutation of range(n), keyed."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (1 << 64) - 1))

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        if inverse:
            for k in keys[::-1]:
                left, right = right ^ (mix(left ^ k) & mask), left
        else:
            for k in keys:
                left, right = right, left ^ (mix(right ^ k) & mask)
        return left << np.uint64(half) | right

    x = once(np.asarray(i).astype(np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(p): int(r) for p, r in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), len(ranks)


def _tokens(docs: DataFrame, path: str, kind: str) -> DataFrame:
    """task, block (of the task), ids, sums and sizes (of its rows), data (their token ids, each row's with an end)."""
    dtype = _dtype(path)

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        task, press = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=LEVELS[0])
        encode, end = encoding(path)[0].encode_ordinary, encoding(path)[1]
        held, sizes, ids, sums, n, block = [], [], [], [], 0, 0

        def packed():
            data = press.compress(np.concatenate(held).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([block], pa.int32()), pa.array([ids], pa.list_(id_kind)), pa.array([sums], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([data], pa.binary())], ["task", "block", "ids", "sums", "sizes", "data"])

        for batch in batches:
            id_kind = batch.column(0).type
            _, offsets = column_bytes(batch.column(1))
            for a, b in doc_groups(offsets, BLOCK):
                parts = [encode(t or "") for t in batch.column(1).slice(a, b - a).to_pylist()]
                for part in parts:
                    part.append(end)
                sizes += [len(part) for part in parts]
                held.append(np.fromiter(chain.from_iterable(parts), dtype, sum(sizes[len(sizes) - len(parts) :])))
                ids += batch.column(0).slice(a, b - a).to_pylist()
                sums += batch.column(2).slice(a, b - a).to_pylist()
                n += len(held[-1])
                if n >= HELD:
                    yield packed()
                    held, sizes, ids, sums, n, block = [], [], [], [], 0, block + 1
        if held:
            yield packed()

    return docs.mapInArrow(run, f"task int, block int, ids array<{kind}>, sums array<long>, sizes array<int>, data binary")


def _places(made: DataFrame) -> tuple[DataFrame, int]:
    """task, block, k, place: where the k-th text of a block begins in the stream; and the length of the stream."""
    rows = made.select("task", "block", F.posexplode(F.arrays_zip("ids", "sums", "sizes")).alias("k", "x")).select("task", "block", "k", F.col("x.ids").alias("id"), F.col("x.sums").alias("sum"), F.col("x.sizes").alias("n"))
    order = [F.col("id").isNull(), "id", "sum", "task", "block", "k"]
    n = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def running(batches):
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.column(3).to_numpy().astype(np.int64)
            upto = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), part, np.int32)), *batch.columns[:3], pa.array(upto - size + done), pa.array(size)], ["part", "task", "block", "k", "place", "n"])
            done += int(upto[-1]) if len(size) else 0

    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("task", "block", "k", "n")
    placed = store.saved(ranged.mapInArrow(running, "part int, task int, block int, k int, place long, n long"), "places")
    begin, at = {}, 0
    for r in sorted(placed.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r.part):  # one number for each partition
        begin[r.part] = at
        at += r.n
    first = F.create_map(*[F.lit(x) for kv in begin.items() for x in kv]) if begin else F.create_map(F.lit(0), F.lit(0))
    return placed.select("task", "block", "k", (F.col("place") + F.element_at(first, F.col("part"))).alias("place")), at


def _dtype(path: str) -> np.dtype:
    return np.dtype("<u2") if encoding(path)[1] < 1 << 16 else np.dtype("<u4")


def write(docs: DataFrame, path: str, *, key: int = 1, text: str = "text", doc_id: str = "doc_id", length: int = SEQUENCE, shard: int = SHARD, vocabulary: str | None = None) -> DataFrame:
    """Writes shards under `path`, a folder that all executors share, and returns the manifest of sequences: slot, shard,
    byte_offset, doc_id (of the row that its first id belongs to), ids_sha256, path (of the shard)."""
    vocabulary = vocabulary or default_path()
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("sum", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = store.saved(_tokens(rows, vocabulary, kind), "tokens")
    places, length_of_all = _places(made)
    total = -(-length_of_all // length)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    side = store.place(spark, "places-by-task")
    places.repartition(partitions, "task").sortWithinPartitions("task", "block", "k").write.partitionBy("task").parquet(side)
    dtype, end = _dtype(vocabulary), encoding(vocabulary)[1]
    shards = -(-total // shard)
    owned_by = max(1, min(shards, partitions))

    def places_of(task: int) -> dict[int, np.ndarray]:
        """The places of a task's texts by block, in order."""
        from pyarrow import parquet

        files, folder = fs.FileSystem.from_uri(side)
        found = [f.path for f in files.get_file_info(fs.FileSelector(f"{folder}/task={task}")) if f.path.endswith(".parquet")]
        table = pa.concat_tables([parquet.ParquetFile(files.open_input_file(f)).read() for f in found])
        block, k, place = (table.column(c).to_numpy() for c in ("block", "k", "place"))
        order = np.lexsort((k, block))
        block, place = block[order], place[order]
        return {int(b): place[block == b] for b in np.unique(block)}

    def send(batches):
        import zstandard

        press, unpress = zstandard.ZstdCompressor(level=LEVELS[1]), zstandard.ZstdDecompressor()
        known, of = None, {}
        for batch in batches:
            for task, block, ids, sizes, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if task != known:
                    known, of = task, places_of(task)
                flat, size, place = np.frombuffer(unpress.decompress(data), dtype), np.array(sizes, np.int64), of[block]
                count = (place + size - 1) // length - place // length + 1
                row = np.repeat(np.arange(len(size)), count)
                number = (place // length)[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                begin, stop = np.maximum(place[row], number * length), np.minimum((place + size)[row], (number + 1) * length)
                source = (np.cumsum(size) - size)[row] + begin - place[row]
                slot = feistel(number, total, key)
                order = np.argsort(slot // shard, kind="stable")
                row, number, begin, stop, source, slot = (x[order] for x in (row, number, begin, stop, source, slot))
                which, n = slot // shard, stop - begin
                ids_ = np.repeat(source - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                flat, upto = flat[ids_], np.concatenate([[0], np.cumsum(n)])
                edges = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)]
                spans = list(zip(edges[:-1], edges[1:], strict=True))
                lists = lambda x: pa.array([x[p:q] for p, q in spans], pa.list_(pa.int64()))  # noqa: B023, E731
                owners = [[ids[r] if at else None for r, at in zip(row[p:q].tolist(), (begin[p:q] % length == 0).tolist(), strict=True)] for p, q in spans]
                yield pa.RecordBatch.from_arrays([pa.array(which[edges[:-1]], pa.int64()), lists(slot), lists(begin % length), lists(n), pa.array(owners, batch.column(2).type), pa.array([press.compress(flat[upto[p] : upto[q]].tobytes()) for p, q in spans], pa.binary())], ["shard", "slots", "at", "sizes", "owners", "data"])

    def store_shards(batches):
        import zstandard

        files, folder = fs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        unpress = zstandard.ZstdDecompressor()
        current, block, owners, filled, kind_of = None, None, [], 0, None

        def written():
            first = current * shard
            slots = np.arange(first, first + len(block))
            last = int(feistel(np.array([total - 1]), total, key)[0])  # the sequence that is padded
            if filled != block.size - (total * length - length_of_all if first <= last < first + len(block) else 0):
                raise RuntimeError(f"shard {current} lacks ids")
            name = f"{folder}/shard-{current:08d}.bin"
            temporary = f"{folder}/.{uuid.uuid4().hex}"
            with files.open_output_stream(temporary) as f:
                f.write(block.tobytes())
            files.move(temporary, name)
            sha = [hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in block]
            n = len(slots)
            return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.full(n, current)), pa.array((slots - first) * length * dtype.itemsize), pa.array(owners, kind_of), pa.array(sha), pa.array([f"{path.rstrip('/')}/shard-{current:08d}.bin"] * n)], ["slot", "shard", "byte_offset", "doc_id", "ids_sha256", "path"])

        for batch in batches:
            kind_of = batch.column(4).type.value_type
            for k, slots, at, sizes, names, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != current:
                    if block is not None:
                        yield written()
                    current, filled = k, 0
                    block = np.full((min(shard, total - k * shard), length), end, dtype)
                    owners = [None] * len(block)
                n = np.array(sizes, np.int64)
                to = (np.array(slots, np.int64) - k * shard) * length + np.array(at, np.int64)
                ids = np.frombuffer(unpress.decompress(data), dtype)
                block.reshape(-1)[np.repeat(to - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
                filled += len(ids)
                for s, a, name in zip(slots, at, names, strict=True):
                    if a == 0:
                        owners[s - k * shard] = name
        if block is not None:
            yield written()

    schema = f"slot long, shard long, byte_offset long, doc_id {kind}, ids_sha256 string, path string"
    if not total:
        return spark.createDataFrame([], schema)
    sent = made.select("task", "block", "ids", "sizes", "data").mapInArrow(send, f"shard long, slots array<long>, at array<long>, sizes array<long>, owners array<{kind}>, data binary")
    owned = sent.repartitionById(owned_by, (F.col("shard") * owned_by / F.lit(shards)).cast("int")).sortWithinPartitions("shard")
    return owned.mapInArrow(store_shards, schema)


def read(path: str, slot: int, n: int, *, length: int = SEQUENCE, shard: int = SHARD, vocabulary: str | None = None) -> np.ndarray:
    """Sequences slot .. slot + n - 1 (fewer at the end) as an array (n, length), by seeking in the shards."""
    dtype = _dtype(vocabulary or default_path())
    files, folder = fs.FileSystem.from_uri(path)
    stride, out = length * dtype.itemsize, []
    while n > 0:
        name = f"{folder}/shard-{slot // shard:08d}.bin"
        if files.get_file_info(name).type == fs.FileType.NotFound:
            break
        with files.open_input_file(name) as f:
            size = f.size() // stride
            take = min(n, size - slot % shard)
            if take <= 0:
                break
            f.seek(slot % shard * stride)
            out.append(np.frombuffer(f.read(take * stride), dtype).reshape(take, length))
        slot, n = slot + take, n - take
    return np.concatenate(out) if out else np.zeros((0, length), dtype)


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the whole table's sequences to a new folder in the shared one, where they stay; the manifest, one row for each
    sequence, says where."""
    folder = f"{store.folder(spark)}/scenewright-shards-{uuid.uuid4().hex}"
    return write(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"file://{folder}" if folder.startswith("/") else folder)
