"""Tables of whole numbers that move between tasks as packed blocks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A missing number, and the least time of nothing.
NONE, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Rows that are dealt out at once.
BLOCK = 1_000_000
BLOCKS = "bucket int, kind string, data binary"

Table = dict[str, np.ndarray]


def pack(table: Table) -> bytes:
    """Columns as small numbers over their least value in units of their divisor, by bytes, compressed. The first ascends."""
    heads, parts = [], []
    for i, (name, a) in enumerate(table.items()):
        a = a.astype(np.int64, copy=False)
        real = a[(a != NONE) & (a != MOST)]
        low, high = (int(real.min()), int(real.max())) if len(real) else (0, 0)
        if high - low >= 1 << 62:
            code, unit = a.view(np.uint64), 0
        else:
            unit = int(np.gcd.reduce(real - low)) or 1 if len(real) else 1
            code = np.where(a == NONE, 0, np.where(a == MOST, 1, (np.clip(a, low, high) - low) // unit + 2)).astype(np.uint64)
            if i == 0:
                code = np.diff(code, prepend=np.uint64(0))  # wraps around where it does not ascend
        width = next(w for w in (1, 2, 4, 8) if w == 8 or int(code.max(initial=0)) < 1 << 8 * w)
        heads.append((name, low, unit, width))
        parts.append(code.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())
    head = json.dumps([len(next(iter(table.values()))), heads]).encode()
    body = len(head).to_bytes(4, "little") + head + b"".join(parts)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpack(data: bytes) -> Table:
    body = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    at = 4 + int.from_bytes(body[:4], "little")
    n, heads = json.loads(body[4:at])
    out: Table = {}
    for i, (name, low, unit, width) in enumerate(heads):
        raw = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n)
        at += n * width
        code = np.ascontiguousarray(raw.T).view(f"<u{width}").reshape(n).astype(np.uint64)
        if not unit:
            out[name] = code.view(np.int64)
            continue
        if i == 0:
            code = np.cumsum(code, dtype=np.uint64)
        code = code.view(np.int64)
        out[name] = np.where(code == 0, NONE, np.where(code == 1, MOST, (code - 2) * unit + low))
    return out


def joined(tables: list[Table]) -> Table:
    """One table of all rows; a column that some tables lack is 0 there."""
    names = dict.fromkeys(c for t in tables for c in t)
    size = lambda t: len(next(iter(t.values())))
    return {c: np.concatenate([t[c] if c in t else np.zeros(size(t), np.int64) for t in tables]) for c in names}


def taken(table: Table, which: np.ndarray) -> Table:
    return {c: a[which] for c, a in table.items()}


def deal(kind: str, table: Table, n: int) -> Iterator[tuple[int, str, bytes]]:
    """Blocks of a table for ``n`` buckets by its first column; rows without a number there are spread."""
    key = next(iter(table.values()))
    mixed = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    bucket = np.where(key == NONE, np.arange(len(key)), mixed.astype(np.int64)) % n
    order = np.lexsort((key, bucket))
    ends = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(ends)):
        yield int(b), kind, pack(taken(table, order[ends[b] : ends[b + 1]]))


def _batch(blocks: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*blocks, strict=True), kinds, strict=True)], ["bucket", "kind", "data"])


def _sent(blocks: Iterator[tuple[int, str, bytes]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, str, bytes]] = []
    for block in blocks:
        held.append(block)
        if len(held) >= 500:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def dealt(rows: DataFrame, kind: str, n: int) -> DataFrame:
    """Blocks of a frame of whole numbers, by its first column."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Table] = []
        size = 0
        for batch in batches:
            held.append({name: c.cast(pa.int64()).fill_null(NONE).to_numpy(zero_copy_only=False) for name, c in zip(batch.schema.names, batch.columns, strict=True)})
            size += len(batch)
            if size >= BLOCK:
                yield from _sent(deal(kind, joined(held), n))
                held, size = [], 0
        if size:
            yield from _sent(deal(kind, joined(held), n))

    return rows.mapInArrow(kernel, BLOCKS)


Work = Callable[[dict[str, Table]], Iterator[tuple[str, Table]]]


def worked(blocks: DataFrame, work: Work, n: int) -> DataFrame:
    """Blocks of what ``work`` makes of the tables of each bucket, by kind; tables of kind ``result`` go on as they are."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[Table]] = {}
        for batch in batches:
            done = []
            for bucket, kind, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if kind == "result":
                    done.append((bucket, kind, data))
                else:
                    held.setdefault(kind, []).append(unpack(data))
            if done:
                yield _batch(done)
        tables = {kind: joined(own) for kind, own in held.items()}
        held.clear()
        for kind, table in work(tables):
            if len(next(iter(table.values()))):
                yield from _sent(deal(kind, table, n))

    return blocks.repartitionById(n, "bucket").mapInArrow(kernel, BLOCKS)


def results(blocks: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of the tables of kind ``result``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(2).to_pylist():
                table = unpack(data)
                yield pa.RecordBatch.from_arrays([pa.array(table[c]) for c in columns], columns)

    return blocks.where("kind = 'result'").mapInArrow(kernel, ", ".join(f"{c} long" for c in columns))
