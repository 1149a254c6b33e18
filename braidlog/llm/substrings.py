"""Removal of long byte strings that repeat across documents, decided by suffix arrays.

Every window of ``length`` bytes has an anchor: the position of the smallest hash among its
``ANCHOR``-byte strings, so equal windows have equal anchors at equal offsets. Windows in a
row that share an anchor form a segment. Segments whose anchor string occurs in a single
document cannot repeat and go no further; the others meet by anchor. There, contexts that
no other segment of the anchor shares are trimmed off, equal rests are kept once, and the
suffix array of all rests (built by linear grouping) puts equal windows side by side. The
smallest document of each class of windows returns to the blocks, which mark and cut the
covered bytes. Segments of an anchor that very many blocks have, or that has very many
different ones, do not meet in one task: their windows are dealt out one by one by their
own hash.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from braidlog.functions.runtime import shuffle_partitions
from braidlog.llm import blocks as B
from braidlog.llm.suffix import suffix_array

LENGTH, ANCHOR = 50, 20
#: Blocks (twice where several ids have it) with one anchor beyond which its windows are dealt out singly.
MANY_BLOCKS = 4096
#: The same for different segments of one anchor, counted in each block: they are compared in one array of one task.
MANY_SEGMENTS = 8192
#: Bytes hashed at once, bytes put into one suffix array at least, and the rank of a null id.
PIECE, ARRAY_BYTES, LAST = 1 << 18, 1 << 16, np.iinfo(np.int64).max
#: Segments that are decided at once, if no anchor has more.
TOGETHER = 1 << 15
SEPARATOR = b"\xff"  # no byte of UTF-8
_STEP = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(50).integers(1, 1 << 63, 256, np.uint64)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_STEP, n, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` bytes from every position, by doubling."""
    h, have = _TABLE[data], 1
    out = None
    taken, rest, n = 0, k, len(data) - k + 1
    while rest:
        if rest & 1:
            part = h[taken : taken + n]
            out = part if out is None else out * _power(have) + part
            taken += have
        rest >>= 1
        if rest:
            h = h[:-have] * _power(have) + h[have:]
            have *= 2
    return _mix(out)


def segments(data: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(first window, end window, anchor, anchor hash, mark)`` of the segments of ``data``, which holds one window at least.

    The mark is a hash of a segment's two ends, its size and its anchor's place, which is all of
    one of up to four anchors' length: equal segments have equal marks.
    """
    low = np.uint64((1 << 24) - 1)
    firsts, anchors, hashes, marks = [], [], [], []
    n, width = len(data) - length + 1, length - k + 1
    for at in range(0, n, PIECE):
        h = string_hashes(data[at : min(len(data), at + PIECE + length - 1)], k)
        x = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        have = 1
        while 2 * have <= width:
            x = np.minimum(x[:-have], x[have:])
            have *= 2
        if width > have:
            x = np.minimum(x[: have - width], x[width - have :])
        spot = (x & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
        firsts.append(first + at)
        anchors.append(spot[first] + at)
        hashes.append(h[spot[first]])
        last = np.append(first[1:], len(spot)) - 1
        mark = ((spot[first] - first) << 16 | (last - first)).astype(np.uint64)
        for at_string in (first, first + min(k, length - k), last + max(0, length - 2 * k), last + length - k):
            mark = _mix(mark * np.uint64(_STEP) + h[at_string])
        marks.append(mark)
    first, anchor, h, mark = (np.concatenate(x) for x in (firsts, anchors, hashes, marks))
    return first, np.append(first[1:], n), anchor, h, mark


def common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


def shared_context(before: list[bytes], after: list[bytes]) -> tuple[list[int], list[int]]:
    """For each segment, the longest context before and from its anchor that another segment has too."""
    out = []
    for sides in (before, after):
        most = [0] * len(sides)
        order = sorted(range(len(sides)), key=sides.__getitem__)
        for i, j in zip(order, order[1:], strict=False):
            n = common(sides[i], sides[j])
            most[i], most[j] = max(most[i], n), max(most[j], n)
        out.append(most)
    return out[0], out[1]


def smallest(rests: list[bytes], owners: list[int], length: int) -> list[list[int]]:
    """For each window of each string, the smallest owner of an equal window, by the suffix array of all strings."""
    text = SEPARATOR.join(rests)
    starts, at = [], 0
    of: list[int] = []
    valid = bytearray(len(text))
    for k, rest in enumerate(rests):
        starts.append(at)
        for i in range(at, at + len(rest) - length + 1):
            valid[i] = 1
        of += [k] * (len(rest) + 1)
        at += len(rest) + 1
    least = [0] * len(text)
    run: list[int] = []
    last, low = None, 0
    for i in suffix_array(text):
        if not valid[i]:
            continue
        window = text[i : i + length]
        if window != last:
            for j in run:
                least[j] = low
            run, last, low = [], window, owners[of[i]]
        run.append(i)
        low = min(low, owners[of[i]])
    for j in run:
        least[j] = low
    return [least[s : s + len(r) - length + 1] for s, r in zip(starts, rests, strict=True)]


def first_owners(found: list, length: int) -> list[list[tuple[int, int]]]:
    """For each ``(anchor hash, anchor offset, segment, owner)``, runs ``(windows, smallest owner)`` over its windows."""
    by_anchor: dict[int, list[int]] = {}
    for i, (h, _, _, _) in enumerate(found):
        by_anchor.setdefault(h, []).append(i)
    out = [[(len(text) - length + 1, owner)] for _, _, text, owner in found]
    rests: dict[bytes, int] = {}
    uses: list[tuple[int, int, bytes]] = []

    def apply(i: int, at: int, runs: list[tuple[int, int]], size: int) -> None:
        [(windows, owner)] = out[i]
        out[i] = [*([(at, owner)] if at else []), *runs, *([(windows - at - size, owner)] if windows > at + size else [])]

    def settle() -> None:
        keys = list(rests)
        runs = {k: [(len(list(same)), m) for m, same in groupby(row)] for k, row in zip(keys, smallest(keys, [rests[k] for k in keys], length), strict=True)}
        for i, at, rest in uses:
            apply(i, at, runs[rest], len(rest) - length + 1)
        rests.clear()
        uses.clear()

    size = 0
    for together in by_anchor.values():
        if len(together) < 2:
            continue
        before, after = shared_context([found[i][2][: found[i][1]][::-1] for i in together], [found[i][2][found[i][1] :] for i in together])
        own: dict[bytes, int] = {}
        mine = []
        for i, left, right in zip(together, before, after, strict=True):
            if left + right >= length:
                _, anchor, text, owner = found[i]
                rest = text[anchor - left : anchor + right]
                own[rest] = min(own.get(rest, owner), owner)
                mine.append((i, anchor - left, rest))
        if len(own) == 1:  # one string in all segments: its windows occur nowhere else
            for i, at, rest in mine:
                apply(i, at, [(len(rest) - length + 1, own[rest])], len(rest) - length + 1)
            continue
        for rest, owner in own.items():
            size += len(rest) + 1
            rests[rest] = min(rests.get(rest, owner), owner)
        uses += mine
        if size >= ARRAY_BYTES:
            settle()
            size = 0
    if uses:
        settle()
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", many_blocks: int = MANY_BLOCKS, many_segments: int = MANY_SEGMENTS) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept)`` of every row; ``kept`` is the UTF-8 text without the removed bytes.

    A byte goes if a string of ``length`` bytes over it also starts in a row of smaller id;
    strings are judged on the input and never cross rows. Texts shorter than ``length``
    stay whole, a null text is empty. Rows with equal ids do not remove each other's
    bytes; a null id counts as the largest. Other columns are not read; an empty table
    gives an empty result. ``many_blocks`` and ``many_segments`` only decide how work is dealt out.
    """
    if length < ANCHOR:
        raise ValueError(f"strings of at least {ANCHOR} bytes are compared")
    kind = docs.schema[id_col].dataType
    width = shuffle_partitions(docs.sparkSession)
    bucket_key = B.bucket_keys(width)  # one bucket for each task, which holds it

    def scan(texts: list[bytes]) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        for i, text in enumerate(texts):
            if len(text) >= length:
                yield i, segments(np.frombuffer(text, np.uint8), length, ANCHOR)

    def distinct(texts: list[bytes], owners: np.ndarray, count: bool = False) -> tuple[list, np.ndarray, np.ndarray, np.ndarray | None]:
        """Segments of the block, its distinct anchors, whether several ids of the block have them, and on demand how many different segments."""
        own = list(scan(texts))
        hashes = np.concatenate([np.zeros(0, np.uint64), *[s[3] for _, s in own]])
        owner = np.repeat(owners[[i for i, _ in own]], [len(s[3]) for _, s in own]) if own else np.zeros(0, np.int64)
        mark = np.concatenate([np.zeros(0, np.uint64), *[s[4] for _, s in own]]) if count else None
        order = np.lexsort((mark, hashes)) if count else np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first) if len(first) else np.zeros(0, bool)
        if not count:
            return own, hashes[first], several, None
        mark = mark[order]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (mark[1:] != mark[:-1])]) if len(first) else np.zeros(0, bool)
        return own, hashes[first], several, np.add.reduceat(new, first, dtype=np.uint32) if len(first) else np.zeros(0, np.uint32)

    def ranks(ids: list) -> np.ndarray:
        return np.array([LAST if i is None else i for i in ids], np.int64)

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in B.gather(batches):
            block = B.even_block(block, width)
            out = [(f"b{block}", B.pack(B.pack_ids(ids), *B.pack_strings(texts)))]
            _, anchors, several, different = distinct(texts, ranks(ids), True)
            for bucket, at in B.by_bucket(anchors, width):
                out.append((bucket_key[bucket], B.pack(block.encode(), np.array([bucket]), anchors[at], np.packbits(several[at]), different[at])))
            yield B.rows(out)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[bytes(x) for x in B.unpack(payload)] for _, payload in B.of_kind(batches, "w")]
        if not held:
            return
        arrays = [np.frombuffer(x[2], np.uint64) for x in held]
        _, place = np.unique(np.concatenate(arrays), return_inverse=True)
        weight = np.concatenate([1 + np.unpackbits(np.frombuffer(x[3], np.uint8), count=len(a)).astype(np.int64) for x, a in zip(held, arrays, strict=True)])
        total = np.bincount(place, weight)
        segments_of = np.bincount(place, np.concatenate([np.frombuffer(x[4], np.uint32) for x in held]))
        many, hot = (total > 1)[place], ((total > many_blocks) | (segments_of > many_segments))[place]
        at = 0
        for (block, bucket, *_), anchors in zip(held, arrays, strict=True):
            yield B.rows([(f"b{block.decode()}", B.pack(bucket, *(np.packbits(x[at : at + len(anchors)]) for x in (many, hot))))])
            at += len(anchors)

    def collect(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[str, bytes]] = []
        for payload in B.payloads(left, "b"):
            ids, sizes, blob = B.unpack(payload)
            texts, owners, block = B.unpack_strings(sizes, blob), ranks(B.unpack_ids(ids)), left.column("key")[0].as_py()
            own, anchors, _, _ = distinct(texts, owners)
            bits = {int(np.frombuffer(b, np.int64)[0]): (np.frombuffer(m, np.uint8), np.frombuffer(t, np.uint8)) for b, m, t in map(B.unpack, B.payloads(right, "b"))}
            many, hot = np.zeros(len(anchors), bool), np.zeros(len(anchors), bool)
            for bucket, at in B.by_bucket(anchors, width):
                for flags, packed in zip((many, hot), bits[bucket], strict=True):
                    flags[at] = np.unpackbits(packed, count=len(at)).astype(bool)
            chosen, single = anchors[many], set(anchors[hot].tolist())
            known: dict[bytes, int] = {}  # equal strings have equal anchors
            least, offsets, keys, where = array("q"), array("H"), array("Q"), array("i")
            for i, (first, end, anchor, h, _) in own if len(chosen) else ():
                hit = chosen[np.minimum(np.searchsorted(chosen, h), len(chosen) - 1)] == h
                text, owner = texts[i], int(owners[i])
                spans = zip(first[hit].tolist(), end[hit].tolist(), anchor[hit].tolist(), h[hit].tolist(), strict=True)
                if single:
                    spans = ((a, b, p, x) for s, e, q, y in spans for a, b, p, x in (((w, w + 1, w, xxhash.xxh3_64_intdigest(text[w : w + length])) for w in range(s, e)) if y in single else ((s, e, q, y),)))
                for a, b, p, x in spans:
                    string = text[a : b + length - 1]
                    k = known.get(string)
                    if k is None:
                        k = known[string] = len(least)
                        least.append(owner)
                        offsets.append(p - a)
                        keys.append(x)
                    elif owner < least[k]:
                        least[k] = owner
                    where.extend((i, a, k))
            if not where:
                continue
            out.append((block, B.pack(b"o", np.frombuffer(where, np.int32).reshape(-1, 3).T.copy())))
            hashes, strings = np.frombuffer(keys, np.uint64), list(known)
            owner, offset = np.frombuffer(least, np.int64), np.frombuffer(offsets, np.uint16)
            for bucket, at in B.by_bucket(hashes, width):
                out.append((bucket_key[bucket], B.pack(block.encode(), at.astype(np.uint32), hashes[at], owner[at], offset[at], *B.pack_strings([strings[k] for k in at.tolist()]))))
        return pa.table({"key": pa.array([k for k, _ in out], pa.string()), "payload": pa.array([v for _, v in out], pa.binary())})

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for key, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key[0] == "w":
                    held.append([bytes(x) for x in B.unpack(payload)])
                else:
                    yield B.rows([(key, payload)])  # occurrences go on to their block
        n_parts = 1 + sum(len(x[2]) // 8 for x in held) // TOGETHER
        places = [dict(B.by_bucket(np.frombuffer(x[2], np.uint64) // np.uint64(width), n_parts)) for x in held]  # segments of one anchor stay together
        answered: list[list[tuple[np.ndarray, ...]]] = [[] for _ in held]
        for part in range(n_parts):
            number: dict[tuple[int, bytes], int] = {}
            found: list[list] = []
            spots = []
            for (_, _, hashes, owner, offset, sizes, blob), place in zip(held, places, strict=True):
                mine = []
                if (own := place.get(part)) is not None:
                    ends = np.cumsum(np.frombuffer(sizes, np.uint32), dtype=np.int64)[own]
                    starts = ends - np.frombuffer(sizes, np.uint32)[own]
                    for h, o, p, a, b in zip(*(x.tolist() for x in (np.frombuffer(hashes, np.uint64)[own], np.frombuffer(owner, np.int64)[own], np.frombuffer(offset, np.uint16)[own], starts, ends)), strict=True):
                        text = blob[a:b]
                        k = number.setdefault((h, text), len(found))
                        if k == len(found):
                            found.append([h, p, text, o])
                        elif o < found[k][3]:
                            found[k][3] = o
                        mine.append(k)
                spots.append(mine)
            number.clear()
            answers = first_owners(found, length)
            for (_, at, *_), place, mine, done in zip(held, places, spots, answered, strict=True):
                if mine:
                    runs = [answers[k] for k in mine]
                    counts = np.fromiter(map(len, runs), np.uint32, len(runs))
                    flat = np.array([run for own in runs for run in own], np.int64).reshape(-1, 2)
                    done.append((np.frombuffer(at, np.uint32)[place[part]], counts, flat[:, 0].astype(np.uint16), flat[:, 1].copy()))
        for (block, *_), done in zip(held, answered, strict=True):
            yield B.rows([(block.decode(), B.pack(b"m", *map(np.concatenate, zip(*done, strict=True))))])

    schema = StructType([StructField("id", kind), *[StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")], StructField("kept", BinaryType())])
    arrow_kind = to_arrow_type(kind)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, totals, removed, spans, kept = [], [], [], [], []
        parts = [B.unpack(p) for p in B.payloads(right, "b")]
        runs = [x[1:] for x in parts if bytes(x[0]) == b"m"]
        places = [np.frombuffer(x[1], np.int32).reshape(3, -1) for x in parts if bytes(x[0]) == b"o"]
        for payload in B.payloads(left, "b"):
            ids, sizes, blob = B.unpack(payload)
            texts, ids = B.unpack_strings(sizes, blob), B.unpack_ids(ids)
            base = np.cumsum([0, *(len(t) + 1 for t in texts)])  # a place between texts takes the ends of spans
            gone = np.zeros(int(base[-1]), bool)
            if places and runs:
                at, counts, windows, owner = (np.concatenate([np.frombuffer(r[k], t) for r in runs]) for k, t in enumerate((np.uint32, np.uint32, np.uint16, np.int64)))
                counts, windows = counts.astype(np.int64), windows.astype(np.int64)
                first_run, n_runs = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                first_run[at], n_runs[at] = np.cumsum(counts) - counts, counts
                begin = np.cumsum(windows) - windows
                begin -= np.repeat(begin[np.cumsum(counts) - counts], counts)  # windows before a run within its segment
                doc, start, segment = (x.astype(np.int64) for x in np.concatenate(places, axis=1))
                times = n_runs[segment]
                run = np.repeat(first_run[segment] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
                doc, start = np.repeat(doc, times), np.repeat(start, times)
                hit = owner[run] < ranks(ids)[doc]
                run, at_byte = run[hit], (base[doc] + start)[hit]
                at_byte = at_byte + begin[run]
                edge = np.zeros(len(gone), np.int32)  # for each byte, so narrow and in place
                np.add.at(edge, at_byte, np.int32(1))
                np.add.at(edge, at_byte + windows[run] + length - 1, np.int32(-1))
                gone = np.cumsum(edge, out=edge) > 0
            for key, text, a in zip(ids, texts, base.tolist(), strict=False):
                mask = gone[a : a + len(text)]
                keys.append(key)
                totals.append(len(text))
                removed.append(int(np.count_nonzero(mask)))
                spans.append(int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(mask[0]) if removed[-1] else 0)
                kept.append(np.frombuffer(text, np.uint8)[~mask].tobytes() if removed[-1] else text)
        return pa.table({"id": pa.array(keys, arrow_kind), "n_bytes": pa.array(totals, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    sent = B.exchange(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(to_blocks, B.SCHEMA))
    met = B.exchange(B.cogroup(sent, sent.mapInArrow(answer, B.SCHEMA), collect, B.SCHEMA))
    return B.cogroup(sent, met.mapInArrow(decide, B.SCHEMA), cut, schema).withColumnRenamed("id", id_col)
