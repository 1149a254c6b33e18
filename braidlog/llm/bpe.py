"""Byte-level BPE encoding and decoding over a global table of distinct words.

Texts are cut into pre-tokens; each block numbers its distinct pre-tokens and keeps every
document as the positions' numbers. The distinct words of all blocks meet in one shuffle,
where each is encoded exactly once; the ids return to the blocks, and documents are
reassembled by position. Texts themselves never move. Decoding looks token ids up in the
token-byte table, whose size the vocabulary bounds (about 50,000 entries), so it is sent
to every task.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from braidlog.functions.runtime import shuffle_partitions
from braidlog.llm import blocks as B

#: A vocabulary larger than this is refused: the token-byte table is sent to every task.
MAX_VOCABULARY = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{len(ranks)} tokens; at most {MAX_VOCABULARY} fit the token-byte table")
    return ranks


def splitter(pattern: str) -> regex.Pattern:
    """The pre-token pattern with white space as Unicode defines it, control characters excluded."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


#: The pattern of byte-level tokenizers, and its form for texts of only these characters, in which letters,
#: digits and white space can be listed; the plain engine is then faster and finds the same.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_OTHER = re.compile(r"[^\t-\r\x20-\x7E\u00C0-\u024F\u2010-\u2027\u2030-\u205E]")
_LETTER = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\t-\r\x20{_LETTER}0-9]+|[\t-\r\x20]+(?![^\t-\r\x20])|[\t-\r\x20]+")


def finder(pattern: str) -> Callable[[str], list[str]]:
    """All pre-tokens of a text."""
    any_text = splitter(pattern).findall
    if pattern != BYTE_LEVEL:
        return any_text
    other, latin = _OTHER.search, _LATIN.findall
    return lambda text: any_text(text) if other(text) else latin(text)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` of every row of ``docs``.

    A null or empty text has no ids; null and repeated ids stay rows of their own; other
    columns are not read. An empty table gives an empty result. A text of any length is
    encoded whole.
    """
    kind = docs.schema[id_col].dataType
    width = shuffle_partitions(docs.sparkSession)

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(pattern)
        for block, ids, texts in B.gather(batches):
            local: dict[str, int] = {}
            number, sizes, codes = local.setdefault, [], []
            for text in texts:
                own = [number(w, len(local)) for w in find(text.decode())]
                sizes.append(len(own))
                codes.append(np.array(own, np.uint32))
            flat = np.concatenate(codes).view(np.uint8).reshape(-1, 4)
            planes = np.ascontiguousarray(flat.T)
            out = [(f"b{block}", B.pack(B.pack_ids(ids), np.array(sizes, np.int64), planes))]
            words = [w.encode() for w in local]
            keys = np.fromiter(map(crc32, words), np.uint64, len(words))
            for bucket, at in B.by_bucket(keys, width):
                out.append((f"w{bucket}", B.pack(block.encode(), at.astype(np.uint32), *B.pack_strings([words[i] for i in at.tolist()]))))
            yield B.rows(out)

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        known: dict[bytes, list[int]] = {}
        for _, payload in B.of_kind(batches, "w"):
            block, at, sizes, blob = B.unpack(payload)
            found = []
            for word in B.unpack_strings(sizes, blob):
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = piece(word)
                found.append(ids)
            counts = np.fromiter(map(len, found), np.uint32, len(found))
            flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum()))
            yield B.rows([(f"b{bytes(block).decode()}", B.pack(at, counts, flat))])

    out_schema = StructType([StructField("id", kind), StructField("ids", ArrayType(IntegerType()))])
    arrow_kind = to_arrow_type(kind)

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, offsets, values = [], [np.zeros(1, np.int64)], []
        answers = [B.unpack(p) for p in B.payloads(right, "b")]
        if left.num_rows and answers:
            at = np.concatenate([np.frombuffer(a[0], np.uint32) for a in answers])
            counts = np.concatenate([np.frombuffer(a[1], np.uint32) for a in answers]).astype(np.int64)
            flat = np.concatenate([np.frombuffer(a[2], np.uint32) for a in answers]).astype(np.int32)
            begins = np.empty(len(at), np.int64)
            begins[at] = np.cumsum(counts) - counts
            lengths = np.empty(len(at), np.int64)
            lengths[at] = counts
        else:
            begins = lengths = np.zeros(0, np.int64)
            flat = np.zeros(0, np.int32)
        for payload in B.payloads(left, "b"):
            ids, sizes, planes = B.unpack(payload)
            codes = np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int64)
            sizes = np.frombuffer(sizes, np.int64)
            per = lengths[codes]
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(per)])
            total = int(ends[-1])
            values.append(flat[np.repeat(begins[codes] - ends[:-1], per) + np.arange(total)] if total else flat[:0])
            keys += B.unpack_ids(ids)
            offsets.append(ends[np.cumsum(sizes)] + offsets[-1][-1])
        cuts = pa.array(np.concatenate(offsets).astype(np.int32))
        lists = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(values) if values else flat))
        return pa.table({"id": pa.array(keys, arrow_kind), "ids": lists})

    sent = B.exchange(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(to_blocks, B.SCHEMA))
    return B.cogroup(sent, sent.mapInArrow(encode_words, B.SCHEMA), reassemble, out_schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the decoded bytes of an ``array<int>`` column by a join with the token-byte table.

    Null ids give null; an id outside the table raises. Columns named ``out_col`` are replaced.
    """
    keep = [f for f in encoded.schema.fields if f.name != out_col]
    schema = StructType([*keep, StructField(out_col, BinaryType())])
    size = max(ranks.values(), default=-1) + 1
    table: list[bytes | None] = [None] * size
    for token, rank in ranks.items():
        table[rank] = token

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(t or b"") for t in table], np.int64)
        begins = np.cumsum(sizes) - sizes
        blob = np.frombuffer(b"".join(t or b"" for t in table), np.uint8)
        gaps = np.array([t is None for t in table])
        for batch in batches:
            out = []
            lists = batch.column(ids_col)
            for i in range(batch.num_rows):
                if not lists[i].is_valid:
                    out.append(None)
                    continue
                ids = lists[i].values.to_numpy(zero_copy_only=False).astype(np.int64) if len(lists[i]) else np.zeros(0, np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() >= size or gaps[ids].any()):
                    raise ValueError("an id is not in the token-byte table")
                per = sizes[ids]
                ends = np.cumsum(per)
                out.append(blob[np.repeat(begins[ids] - ends + per, per) + np.arange(int(per.sum()))].tobytes())
            columns = [batch.column(f.name) for f in keep] + [pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in keep] + [out_col])

    return encoded.select(*[F.col(f"`{f.name}`") for f in keep]).mapInArrow(look_up, schema)
