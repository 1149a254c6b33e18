"""Packing token sequences into windows by non-negative least squares.

Documents longer than a window are cut into whole windows first. Of the remainders only
the histogram of lengths matters: combinations of two or three lengths that fill a window
exactly are enumerated, non-negative least squares finds how often to repeat each so that
the histogram is used up, and the repeats are rounded to what is there. What is left over
is packed greedily: the longest length and then the longest that fits, as often as that
fills a window; the rest is laid end to end and cut at the windows' borders.

The histogram has as many bins as a window has tokens, so the plan's size is fixed. Parts of
bounded size number their own remainders by length; running totals over parts turn these
numbers into global ranks, and a rank decides its window. Nothing is sorted and no length,
however frequent, is gathered in one task.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from braidlog.functions.runtime import shuffle_partitions, written
from braidlog.llm.bpe import BYTE_LEVEL, finder

WINDOW, END = 1024, 0
#: Gradient, as a share of the largest bin, up to which a solution counts as optimal.
TOLERANCE = 1e-3
#: Tokens after which a part ends; rows in an output batch; words that a task remembers.
PART_TOKENS, TEXT_BATCH, MOST_WORDS = 1 << 21, 256, 400_000


def read_tokenizer(tokenizer_json: str) -> dict[bytes, int]:
    """Ranks of a byte-level BPE tokenizer file, after proof that they merge as the file does.

    Merging the adjacent pair of lowest rank equals the file's merge list exactly if the
    n-th merge makes the n-th token after the 256 bytes. Other tokenizers raise.
    """
    model = json.loads(tokenizer_json)
    merges, vocabulary, added = model["model"]["merges"], model["model"]["vocab"], {t["content"] for t in model["added_tokens"]}
    splits = model.get("pre_tokenizer") or {}
    if splits.get("type") != "ByteLevel" or splits.get("add_prefix_space") or model.get("normalizer"):
        raise ValueError("not a plain byte-level tokenizer")
    for i, merge in enumerate(merges):
        if vocabulary["".join(merge.split(" ") if isinstance(merge, str) else merge)] != 256 + i:
            raise ValueError(f"merge {i} does not make token {256 + i}")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in added}


def added_tokens(tokenizer_json: str) -> dict[str, int]:
    """Ids of the tokens that the file adds to its vocabulary; other than plain literals raise."""
    added = json.loads(tokenizer_json)["added_tokens"]
    for token in added:
        flags = [name for name in ("lstrip", "rstrip", "single_word", "normalized") if token.get(name)]
        if flags or not token["content"]:
            raise ValueError(f"added token {token['content']!r} with {flags} is not supported")
    return {token["content"]: token["id"] for token in added}


class Words(dict):
    """Ids of pre-tokens as little-endian bytes, made when first asked for."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self._piece = tiktoken.Encoding("words", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MOST_WORDS:
            self.clear()
        ids = self[word] = array("I", self._piece(word.encode())).tobytes()
        return ids


def combinations(window: int, present: np.ndarray) -> np.ndarray:
    """Pairs and triples of present lengths that fill a window, as sorted rows; a pair has a 0."""
    a = np.arange(1, window)
    pairs = np.stack([np.zeros_like(a), a, window - a], 1)
    first, second = np.meshgrid(a, a, indexing="ij")
    triples = np.stack([first, second, window - first - second], 2).reshape(-1, 3)
    rows = np.concatenate([pairs, triples])
    rows = rows[(rows[:, 0] <= rows[:, 1]) & (rows[:, 1] <= rows[:, 2])]
    known = np.concatenate([[True], present[1:] > 0])
    return rows[known[rows].all(1)]


def solve(counts: np.ndarray, combos: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
    """Repeats x >= 0 that minimise ``||A x - counts||`` by coordinate descent; counts[0] is ignored.

    Every step lowers the objective, and the descent ends when the conditions of optimality
    hold: no gradient is above ``tolerance`` times the largest bin (or half a document).
    """
    rest = counts.astype(float).copy()
    rest[0] = 0.0
    weight = np.ones((len(combos), 3))
    weight[combos == 0] = 0.0
    norm = np.zeros(len(combos))
    for i in range(3):
        same = (combos == combos[:, i : i + 1]) * weight
        norm += same.sum(1) * weight[:, i]
    x, least = np.zeros(len(combos)), max(0.5, tolerance * float(rest.max(initial=0.0)))
    while True:
        pull = (rest[combos] * weight).sum(1)
        moves = np.flatnonzero((pull > least) | ((pull < -least) & (x > 0)))
        if not len(moves):
            break
        for k in moves[np.argsort(-np.abs(pull[moves]), kind="stable")].tolist():
            a, b, c = combos[k].tolist()
            step = max(-x[k], ((rest[a] if a else 0.0) + rest[b] + rest[c]) / norm[k])
            if step:
                x[k] += step
                for length in (a, b, c):
                    if length:
                        rest[length] -= step
    return x


def plan(counts: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, repeats)`` whose use of every length stays within the histogram."""
    combos, left, out = combinations(window, counts), counts.astype(np.int64).copy(), []
    left[0] = 0
    x = solve(counts, combos) if len(combos) else np.zeros(0)
    for k in np.argsort(-x, kind="stable").tolist():
        if x[k] < 0.5:
            break
        lengths = tuple(v for v in combos[k].tolist() if v)
        need = {v: lengths.count(v) for v in lengths}
        times = min(int(round(x[k])), *(int(left[v]) // n for v, n in need.items()))
        if times > 0:
            out.append((lengths, times))
            for v, n in need.items():
                left[v] -= n * times
    return out + best_fits(left, window)


def best_fits(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Windows filled by the longest length and then the longest that fits; ``left`` loses what they use."""
    out, longest = [], window - 1
    while longest > 0:
        if not left[longest]:
            longest -= 1
            continue
        need, gap = {longest: 1}, window - longest
        while gap and len(fits := np.flatnonzero(left[: gap + 1] > [need.get(v, 0) for v in range(gap + 1)])):
            v = int(fits[-1])
            n = min(gap // v, int(left[v]) - need.get(v, 0))
            need[v], gap = need.get(v, 0) + n, gap - n * v
        if gap:
            longest -= 1
            continue
        times = min(int(left[v]) // n for v, n in need.items())
        for v, n in need.items():
            left[v] -= n * times
        out.append((tuple(v for v, n in need.items() for _ in range(n)), times))
    return out


def slots(chosen: list[tuple[tuple[int, ...], int]], window: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """For each length, rows (first rank, first sequence, offset) of its places; and how many are placed."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    used, sequence = np.zeros(window, np.int64), 0
    for lengths, times in chosen:
        at = 0
        for v in lengths:
            by.setdefault(v, []).append((int(used[v]), sequence, at))
            used[v] += times
            at += v
        sequence += times
    return {v: np.array(rows, np.int64) for v, rows in by.items()}, used


def tokenised(docs: DataFrame, tokenizer_json: str, window: int, id_col: str, text_col: str) -> DataFrame:
    """One row for every document: its windows' checksums and its remainder with a rank within the task."""
    kind = docs.schema[id_col].dataType
    fields = [("part", LongType()), ("nth", LongType()), ("id", kind), ("doc_tokens", LongType()), ("first_full", LongType()), ("full_crc", BinaryType()), ("rest", IntegerType()), ("rank", LongType()), ("ids", BinaryType())]
    schema = StructType([StructField(n, t) for n, t in fields])
    ranks, added = read_tokenizer(tokenizer_json), added_tokens(tokenizer_json)
    literals = "|".join(map(re.escape, sorted(added, key=len, reverse=True)))  # the leftmost, then the longest
    arrow = [(n, to_arrow_type(t)) for n, t in fields]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, find = Words(ranks).__getitem__, finder(BYTE_LEVEL)
        cut = re.compile(f"({literals})").split if added else lambda text: [text]

        def encoded(text: str) -> bytes:
            pieces = cut(text)  # every second one is an added token
            return b"".join(array("I", [added[p]]).tobytes() if i % 2 else b"".join(map(words, find(p))) for i, p in enumerate(pieces))

        part, seen, n, full, size = TaskContext.get().partitionId() << 32, [0] * window, 0, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXT_BATCH):
                own = batch.slice(at, TEXT_BATCH)
                out = []
                for key, text in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True):
                    ids = np.frombuffer(encoded(text or "") + bytes([END, 0, 0, 0]), "<u4")
                    whole = len(ids) // window
                    checks = np.array([crc32(ids[i * window : (i + 1) * window]) for i in range(whole)], "<u4")
                    rest = len(ids) - whole * window
                    size += len(ids)
                    if size > PART_TOKENS and n:
                        part, seen, n, full, size = part + 1, [0] * window, 0, 0, len(ids)
                    out.append((part, n, key, len(ids), full, checks.tobytes(), rest, seen[rest], ids[whole * window :].tobytes()))
                    seen[rest] += 1
                    n, full = n + 1, full + whole
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), arrow, strict=True)], names=[k for k, _ in arrow])

    return written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, schema), "tokens", merge=False)


def pack(docs: DataFrame, tokenizer_json: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of every piece of every document.

    A document is its tokens and an end id 0, so an empty or null text is one token. Only
    the very last sequence can be shorter than a window. Null and repeated ids are packed
    like others; other columns are not read; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType
    rows = tokenised(docs, tokenizer_json, window, id_col, text_col)
    histogram = np.zeros(window, np.int64)
    for length, n in rows.groupBy("rest").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``window`` rows
        histogram[length] = n
    places, used = slots(chosen := plan(histogram, window), window)
    n_planned = sum(times for _, times in chosen)

    limit = F.element_at(F.array(*[F.lit(int(u)) for u in used]), F.col("rest") + 1)
    counts = rows.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("rest").orderBy("part")) - F.col("n"))
    over = F.greatest(F.lit(0), F.col("before") + F.col("n") - F.greatest("before", limit)) * F.col("rest")
    fulls = rows.groupBy("part").agg(F.sum(F.octet_length("full_crc") / 4).cast("long").alias("n_full"))
    ranks = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("rest", "before"))).alias("ranks"), F.sum(over).alias("n_left"))
    running = Window.orderBy("part")  # over two sums for each part
    sums = ranks.select("part", "n_left").join(fulls, "part").select(
        F.col("part").alias("of_part"),
        (F.sum("n_left").over(running) - F.col("n_left")).alias("left_first"),
        (F.sum("n_full").over(running) - F.col("n_full")).alias("full_first"),
        F.sum("n_full").over(Window.partitionBy()).alias("n_fulls"),
    )
    starts = sums.join(ranks, F.col("of_part") == F.col("part")).select("of_part", F.col("ranks.rest").alias("rests"), F.col("ranks.before").alias("befores"), "left_first", "full_first", "n_fulls")
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kinds = [kind, *[LongType()] * 6]
    arrow = [to_arrow_type(k) for k in kinds]

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        here = right.to_pylist()[0]
        before = dict(zip(here["rests"], here["befores"], strict=True))
        stream = here["left_first"]
        for row in left.sort_by("nth").to_pylist():
            key, total, n_full = row["id"], row["doc_tokens"], len(row["full_crc"]) // 4
            at = n_planned + here["full_first"] + row["first_full"]
            out += [(key, i * window, window, c, total, at + i, 0) for i, c in enumerate(np.frombuffer(row["full_crc"], "<u4").tolist())]
            length, ids, begin = row["rest"], row["ids"], n_full * window
            rank = before[length] + row["rank"]
            if not length:
                continue
            if rank < used[length]:
                where = places[length]
                first, sequence, offset = where[np.searchsorted(where[:, 0], rank, "right") - 1].tolist()
                out.append((key, begin, length, crc32(ids), total, sequence + rank - first, offset))
                continue
            done = 0
            while done < length:
                sequence, offset = divmod(stream, window)
                size = min(length - done, window - offset)
                out.append((key, begin + done, size, crc32(ids[4 * done : 4 * (done + size)]), total, n_planned + here["n_fulls"] + sequence, offset))
                done, stream = done + size, stream + size
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, arrow, strict=True)})

    n = shuffle_partitions(docs.sparkSession)
    pieces = rows.repartition(n, "part").groupBy("part").cogroup(starts.repartition(n, "of_part").groupBy("of_part"))
    schema = StructType([StructField(n, k) for n, k in zip(names, kinds, strict=True)])
    return pieces.applyInArrow(place, schema).withColumnRenamed("id", id_col)
