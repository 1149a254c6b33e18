"""Block exchange: how the text operators move data once and still ask global questions.

Documents are gathered into blocks of bounded text size. A block emits two kinds of
rows: ``b<block>`` rows with the block's own payload, and ``w<bucket>`` rows with the
packed keys (words, grams, chunks) that must meet equal keys of other blocks. One
exchange by ``key`` carries both. A first consumer answers the bucket rows, its answers
go back by block, and a co-group joins them with the block payload; Spark reuses the
exchange, so the payload is shuffled once however many consumers there are.

A key that a third of all rows share meets once per block, not once per row.
"""

from __future__ import annotations

import pickle
import struct
from collections.abc import Iterator
from itertools import count
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlog.functions.runtime import shuffle_partitions, written

#: Text bytes gathered into one block.
BLOCK_BYTES = 8 << 20
SCHEMA = "key string, payload binary"
ARROW = pa.schema([("key", pa.string()), ("payload", pa.binary())])
#: Column of the row key that ``numbered`` adds.
ROW = "__row"


def pack(*parts: Any) -> bytes:
    """Compressed concatenation of byte strings and arrays."""
    raw = [p.tobytes() if isinstance(p, np.ndarray) else bytes(p) for p in parts]
    head = struct.pack(f"<{len(raw) + 1}Q", len(raw), *map(len, raw))
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(raw))


def unpack(blob: bytes) -> list[memoryview]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    (n,) = struct.unpack_from("<Q", raw)
    at, out = 8 * (n + 1), []
    for size in struct.unpack_from(f"<{n}Q", raw, 8):
        out.append(raw[at : at + size])
        at += size
    return out


def pack_ids(ids: list) -> bytes:
    return pickle.dumps(ids, protocol=5)


def unpack_ids(blob: Any) -> list:
    return pickle.loads(blob)


def pack_strings(values: list[bytes]) -> tuple[np.ndarray, bytes]:
    return np.fromiter(map(len, values), np.uint32, len(values)), b"".join(values)


def unpack_strings(sizes: Any, blob: Any) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, np.uint32), dtype=np.int64).tolist()
    data, at, out = bytes(blob), 0, []
    for end in ends:
        out.append(data[at:end])
        at = end
    return out


def gather(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[str, list, list[bytes]]]:
    """``(block, ids, texts as UTF-8)``; columns are id and text, a null text is empty.

    A document longer than ``limit`` gets a block of its own. Block names depend only on
    the partition and the order in it, so a task run again names its blocks alike.
    """
    part, seq, size = TaskContext.get().partitionId(), 0, 0
    ids: list = []
    texts: list[bytes] = []
    for batch in batches:
        for k, v in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            v = v or b""
            if texts and size + len(v) > limit:
                yield f"{part}-{seq}", ids, texts
                seq, size, ids, texts = seq + 1, 0, [], []
            ids.append(k)
            texts.append(v)
            size += len(v) + 64
    if texts:
        yield f"{part}-{seq}", ids, texts


def rows(pairs: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.binary())], schema=ARROW
    )


def exchange(df: DataFrame) -> DataFrame:
    """Deal rows out by key; identical plans share one exchange."""
    return df.repartition(shuffle_partitions(df.sparkSession), "key")


def of_kind(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[str, bytes]]:
    """Rows of one kind. Filtering here, not in the plan, keeps the exchange shareable."""
    for batch in batches:
        for i, key in enumerate(batch.column(0).to_pylist()):
            if key and key[0] == kind:
                yield key, batch.column(1)[i].as_py()


def by_bucket(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of the keys of each of ``n`` buckets."""
    bucket = (keys % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in range(n):
        if cuts[b] < cuts[b + 1]:
            yield b, order[cuts[b] : cuts[b + 1]]


def _spark_hash(text: str) -> int:
    """Spark's hash of an ASCII string, by which ``exchange`` deals out."""
    data = text.encode()
    cut = len(data) & ~3
    h = 42
    for k in (*struct.unpack_from(f"<{cut // 4}I", data), *data[cut:]):
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
        h ^= k
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (h >> 31 << 32)


def bucket_keys(n: int) -> list[str]:
    """A key for each of ``n`` buckets, which ``exchange`` puts into a partition of its own."""
    found: dict[int, str] = {}
    for i in count():
        found.setdefault(_spark_hash(f"w{i}") % n, f"w{i}")
        if len(found) == n:
            return [found[b] for b in range(n)]


def even_block(block: str, n: int) -> str:
    """A name for the block by which ``exchange`` deals blocks out evenly over ``n`` partitions, whatever number of blocks a task has."""
    part, seq = map(int, block.split("-"))
    at = (int(part * 0.6180339887498949 % 1 * n) + seq) % n
    return next(name for i in count() if _spark_hash(f"b{(name := f'{block}-{i}')}") % n == at)


def payloads(table: pa.Table, kind: str) -> list[bytes]:
    """Payloads of a co-group's side whose keys are of one kind (any, if it is empty)."""
    if not table.num_rows or not (table.column("key")[0].as_py() or " ").startswith(kind):
        return []
    return table.column("payload").to_pylist()


def cogroup(left: DataFrame, right: DataFrame, function, schema: str) -> DataFrame:
    """Join block payloads with the answers for the block."""
    return left.groupBy("key").cogroup(exchange(right).groupBy("key")).applyInArrow(function, schema)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a unique long for every row, written once so that all readers see the same."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is not in the one column of ``gone``; a null id stays.

    An anti-join whose wide side travels compressed. Rows are packed by a hash of their id,
    the ids to drop go ahead of them to the same partition, and each packed row group is
    filtered by itself, so neither side has to fit a task and the plan is one at any size.
    """
    width = shuffle_partitions(docs.sparkSession)
    at = docs.columns.index(id_col)

    def bucket(value: Any) -> int:
        return xxhash.xxh3_64_intdigest(str(value)) % width

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = np.fromiter(map(bucket, table.column(at).to_pylist()), np.uint64, table.num_rows)
            out = []
            for b, rows_at in by_bucket(keys, width):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_table(table.take(pa.array(rows_at)))
                out.append((f"k{b:08d}1", sink.getvalue().to_pybytes()))
            held.clear()
            return rows(out)

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > 2 * BLOCK_BYTES:
                yield flush()
                size = 0
        if held:
            yield flush()

    def pack_gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list] = {}
            for value in batch.column(0).to_pylist():
                by.setdefault(bucket(value), []).append(value)
            yield rows([(f"k{b:08d}0", pack_ids(values)) for b, values in by.items()])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, drop = "", set()
        for batch in batches:
            for key, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key[:-1] != own:
                    own, drop = key[:-1], set()
                if key[-1] == "0":
                    drop.update(unpack_ids(payload.as_py()))
                    continue
                with pa.ipc.open_stream(pa.BufferReader(payload.as_py())) as stream:
                    for part in stream:
                        if drop:
                            part = part.filter(pa.array([v is None or v not in drop for v in part.column(at).to_pylist()]))
                        yield part

    sent = docs.mapInArrow(pack_rows, SCHEMA).union(gone.mapInArrow(pack_gone, SCHEMA))
    dealt = sent.repartition(width, F.substring("key", 1, 9)).sortWithinPartitions("key")
    return dealt.mapInArrow(keep, docs.schema)
