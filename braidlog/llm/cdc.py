"""Exact deduplication by content-defined chunk recipes.

Texts without white space are cut where a rolling hash of the last 32 bytes says so, so
equal texts have equal cuts and a passage inserted early moves no later cut. Each block
sends every distinct chunk once; chunks that share a hash meet in one bucket, where their
bytes are compared and each different content gets its own verified identifier. Documents
then compare ordered identifier lists: long texts are never moved again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from braidlog.functions.runtime import shuffle_partitions, written
from braidlog.llm import blocks as B

WHITE_SPACE = b" \t\n\v\f\r"
#: Chunk sizes in bytes: no cut before the first, an average near 2 KB after it, always one at the last.
LEAST, MOST, AVERAGE_BITS = 1024, 16384, 11
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, np.uint32)
_CONTINUATION = re.compile(rb"[\x80-\xBF]+")


def candidates(text: bytes, piece: int = 1 << 20) -> np.ndarray:
    """Ends of 32-byte windows whose rolling hash has its top bits clear, in bounded memory."""
    out = []
    for at in range(0, len(text), piece):
        low = max(0, at - 31)
        h = _GEAR[np.frombuffer(text, np.uint8, min(len(text), at + piece) - low, low)]
        for step in (1, 2, 4, 8, 16):
            h[step:] = h[step:] + (h[:-step] << np.uint32(step)) if len(h) > step else h[step:]
        ends = np.flatnonzero(h >> np.uint32(32 - AVERAGE_BITS) == 0) + low + 1
        out.append(ends[ends > at])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def chunks(text: bytes) -> list[bytes]:
    """The content-defined chunks of a text; their concatenation is the text."""
    out, at = [], 0
    ends = candidates(text).tolist() if len(text) > LEAST else []
    for end in [*ends, len(text)]:
        while end - at > MOST:
            out.append(text[at : at + MOST])
            at += MOST
        if end - at >= LEAST or end == len(text) > at:
            out.append(text[at:end])
            at = end
    return out


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, id, n_points, text_sha256, recipe)`` of every row: its verified chunk identifiers in order."""
    kind = docs.schema[id_col].dataType
    width = shuffle_partitions(docs.sparkSession)

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in B.gather(batches):
            local: dict[bytes, int] = {}
            points, digests, sizes, codes = [], [], [], []
            for text in texts:
                points.append(len(text) if text.isascii() else len(text.decode()))
                bare = text.translate(None, WHITE_SPACE)
                digests.append(hashlib.sha256(bare).digest())
                own = [local.setdefault(c, len(local)) for c in chunks(bare)]
                sizes.append(len(own))
                codes += own
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, local), np.uint64, len(local))
            contents = list(local)
            out = [(f"b{block}", B.pack(B.pack_ids(ids), np.array(points, np.int64), b"".join(digests), np.array(sizes, np.int64), np.array(codes, np.uint32), hashes))]
            for bucket, at in B.by_bucket(hashes, width):
                out.append((f"w{bucket}", B.pack(block.encode(), at.astype(np.uint32), hashes[at], *B.pack_strings([contents[i] for i in at.tolist()]))))
            yield B.rows(out)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [payload for _, payload in B.of_kind(batches, "w")]
        contents: dict[int, list[bytes]] = {}
        for payload in held:
            _, _, hashes, sizes, blob = B.unpack(payload)
            for h, content in zip(np.frombuffer(hashes, np.uint64).tolist(), B.unpack_strings(sizes, blob), strict=True):
                known = contents.setdefault(h, [content])
                if content not in known:
                    known.append(content)
        numbers = {h: {c: i for i, c in enumerate(sorted(known))} for h, known in contents.items() if len(known) > 1}
        contents.clear()
        for payload in held:
            block, at, hashes, sizes, blob = B.unpack(payload)
            number = np.zeros(len(at) // 4, np.uint16)
            for i, h in enumerate(np.frombuffer(hashes, np.uint64).tolist()):
                if h in numbers:
                    number[i] = numbers[h][B.unpack_strings(sizes, blob)[i]]
            yield B.rows([(f"b{bytes(block).decode()}", B.pack(at, number))])

    schema = StructType(
        [
            StructField("row", StringType()),
            StructField("id", kind),
            StructField("n_points", LongType()),
            StructField("text_sha256", StringType()),
            StructField("recipe", BinaryType()),
        ]
    )
    arrow_kind = to_arrow_type(kind)

    def list_ids(left: pa.Table, right: pa.Table) -> pa.Table:
        names, keys, counts, texts, lists = [], [], [], [], []
        answers = [B.unpack(p) for p in B.payloads(right, "b")]
        for payload in B.payloads(left, "b"):
            ids, points, digests, sizes, codes, hashes = B.unpack(payload)
            ids, digests, hashes = B.unpack_ids(ids), bytes(digests), np.frombuffer(hashes, np.uint64)
            verified = np.zeros(len(hashes), [("hash", "<u8"), ("number", "<u2")])
            verified["hash"] = hashes
            for at, number in answers:
                verified["number"][np.frombuffer(at, np.uint32)] = np.frombuffer(number, np.uint16)
            whole = verified[np.frombuffer(codes, np.uint32)].tobytes()
            end = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
            block = left.column("key")[0].as_py()
            names += [f"{block}-{i}" for i in range(len(ids))]
            keys += ids
            counts += np.frombuffer(points, np.int64).tolist()
            texts += [digests[i : i + 32].hex() for i in range(0, len(digests), 32)]
            lists += [whole[10 * a : 10 * b] for a, b in zip([0, *end[:-1]], end, strict=True)]
        return pa.table({"row": pa.array(names, pa.string()), "id": pa.array(keys, arrow_kind), "n_points": pa.array(counts, pa.int64()), "text_sha256": pa.array(texts, pa.string()), "recipe": pa.array(lists, pa.binary())})

    sent = B.exchange(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(to_blocks, B.SCHEMA))
    return B.cogroup(sent, sent.mapInArrow(verify, B.SCHEMA), list_ids, schema)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` of every row of ``docs``.

    Texts are equal when they are identical without white space; null counts as empty, and
    all empty texts are one group. Of a group the row with the most code points stays, then
    the smallest id (null last), then the first of repeated rows: exactly one row of each
    group is kept. An empty table gives an empty result; other columns are not read.
    """
    rows = written(recipes(docs, id_col, text_col), "recipes")
    rank = F.struct((-F.col("n_points")).alias("p"), F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("row").alias("row"))
    best = rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("best"))
    best = written(best, "best")  # a join of two plain tables, which Spark can split where a recipe is hot
    return rows.join(best, "recipe").select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``dedup`` keeps, with all their columns: exactly one of each group.

    Rows are dropped by a key of their own, so repeated rows, null ids and several texts of
    one id are rows like others.
    """
    keyed = B.numbered(docs)
    key = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), F.col(B.ROW).alias("row"))
    gone = dedup(keyed.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text").where("not kept")
    return B.without(keyed, gone.select(F.col("key.row").alias(B.ROW)), B.ROW).drop(B.ROW)
