"""Self-join of documents by the Jaccard similarity of their word n-gram sets.

The plan is a prefix-filter join. Every n-gram is counted over the whole corpus, and a
document's n-grams are ordered rare first, by count and then by hash. Two documents that
are similar enough share an n-gram among the first few of each, the prefix. So

1. equal sets are collapsed to one representative by a digest;
2. n-grams meet by bucket, and the counts of those in several representatives go back; a
   prefix that consists of n-grams of one document alone needs no further step;
3. representatives that share a prefix n-gram are compared by length, by position in the
   order and by a suffix filter (a bound of the symmetric difference from 64 partial counts);
   each task passes on only a spanning forest of the pairs that survive;
4. components of these candidates gather the full sets, and every pair that is not already
   connected is verified exactly, once;
5. components of the verified links are the result.

Links between documents that are connected anyway are not listed, so no group of copies
ever makes a quadratic number of rows. A long posting list is dealt into parts by document.
Its parts are compared within themselves; then whoever is outside the list's largest
component meets every part, in cells of bounded size, so all pairs that are not connected
have met. A candidate component too large for one task is verified in the same way: in
parts with a few pilots in each, then the rest against every part.

N-grams are compared as 64-bit hashes and whole sets as 128-bit digests of them: two
different n-grams are taken for one with a probability of 2**-64, two sets of 2**-128.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlog.functions.components import connected_components
from braidlog.functions.runtime import shuffle_partitions, written
from braidlog.llm import blocks as B

#: Postings of one n-gram in a part, and of either side of a cell; n-grams and rows of one part of a cluster.
PART_POSTINGS, CELL_POSTINGS, PART_GRAMS, PART_ROWS = 1 << 15, 1 << 13, 1 << 18, 1 << 8
PARTIAL_COUNTS, MOST_WORDS, MATRIX_BYTES, MOST_KINDS = 64, 400_000, 32 << 20, 1 << 11
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def gram_sets(texts: list[bytes], n: int, known: WordHashes) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words is one gram, without words none."""
    out = []
    for text in texts:
        words = text.lower().split()
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(n, len(h))
        if not size:
            out.append(h)
            continue
        g = np.full(len(h) - size + 1, size, np.uint64) * _MIX[2]
        for k in range(size):
            g = mix(g + h[k : len(h) - size + 1 + k])
        out.append(np.unique(g))
    return out


def halves(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 48 bits of sorted hashes, as two arrays that compress well.

    Counting needs no more: n-grams that agree in them share a count, which is an order like any other.
    """
    return (grams >> np.uint64(48)).astype(np.uint16), (grams >> np.uint64(16)).astype(np.uint32)


def joined(high, low) -> np.ndarray:
    return np.frombuffer(high, np.uint16).astype(np.uint64) << np.uint64(32) | np.frombuffer(low, np.uint32)


def prefix(grams: np.ndarray, several: np.ndarray, counts: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of the prefix that others have too, their places in the rare-first order, and their counts.

    ``several`` are the first bits of n-grams of several representatives, sorted, with their ``counts``.
    """
    num, den = share
    size = len(grams) - -(-num * len(grams) // den) + 1
    if not len(several):
        return grams[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
    short = grams >> np.uint64(16)
    at = np.minimum(np.searchsorted(several, short), len(several) - 1)
    common = np.flatnonzero(several[at] == short)
    alone = len(grams) - len(common)
    times = counts[at[common]]
    first = np.argsort(times, kind="stable")[: max(0, size - alone)]
    return grams[common[first]], alone + np.arange(len(first)), times[first]


def signature(grams: np.ndarray) -> np.ndarray:
    """Counts of n-grams by residue, modulo 256."""
    return np.bincount((grams % np.uint64(PARTIAL_COUNTS)).astype(np.int64), minlength=PARTIAL_COUNTS).astype(np.uint8)


def feasible(na: np.ndarray, pa_: np.ndarray, nb: np.ndarray, pb: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Length and positional filters of postings of one n-gram, and the symmetric difference that a link allows.

    Representatives differ, so a link of equal lengths needs a difference of two, others of one.
    """
    num, den = share
    both = na + nb
    need = -(-num * both // (num + den))
    spare = both - 2 * need
    ok = np.minimum(na, nb) * den >= num * np.maximum(na, nb)
    ok &= np.minimum(na - pa_, nb - pb) >= need
    return ok & (spare >= np.where(na == nb, 2, 1)), spare


def plausible(n: np.ndarray, pos: np.ndarray, sig: np.ndarray, a, b, share: tuple[int, int]) -> np.ndarray:
    """Length, positional and suffix filters of pairs of postings; never false for a link's first common n-gram."""
    ok, spare = feasible(n[a], pos[a], n[b], pos[b], share)
    hit = np.flatnonzero(ok)
    if len(hit):
        one = lambda x: x[hit] if np.ndim(x) else x
        gap = sig[one(a)] - sig[one(b)]
        ok[hit] = np.minimum(gap, -gap).sum(-1, dtype=np.int64) <= spare[hit]
    return ok


def paired(n: np.ndarray, pos: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Which postings of one n-gram have any partner by length and position, judged by kinds of postings."""
    kinds, kind, times = np.unique(n << 24 | np.minimum(pos, (1 << 24) - 1), return_inverse=True, return_counts=True)
    if len(kinds) > MOST_KINDS:
        return np.ones(len(n), bool)
    kn, kp = kinds >> 24, kinds & ((1 << 24) - 1)
    ok, _ = feasible(kn[:, None], kp[:, None], kn[None], kp[None], share)
    ok[np.diag_indices(len(kinds))] &= times > 1
    return ok.any(1)[kind]


class Forest:
    """Union-find that lists the edges which joined something."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)
            self.edges.append((a, b))


def connect(m: int, test, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges, found by ``test(i, js)``, that connect ``range(m)`` as far as all its edges would; connected pairs are skipped."""
    label, out = np.arange(m) if label is None else label.copy(), []
    for i in range(1, m):
        js = np.flatnonzero(label[:i] != label[i])
        hit = js[test(i, js)] if len(js) else js
        for k in np.unique(label[hit], return_index=True)[1] if len(hit) else ():
            j = int(hit[k])
            out.append((i, j))
            label[label == label[j]] = label[i]
    return out


def classes(docs: DataFrame, n: int, share: tuple[int, int], part_postings: int) -> DataFrame:
    """Steps 1 and 2 as one table of four kinds of rows.

    ``c`` (every row: id, rep, size, block, idx), ``p`` (packed postings by bucket), ``h``
    (packed postings of long lists) and ``t`` (texts of representatives with postings, by block).
    """
    width = shuffle_partitions(docs.sparkSession)

    def prepare(texts: list[bytes], ids: list, known: WordHashes) -> tuple[list[np.ndarray], list[bytes]]:
        sets = gram_sets(texts, n, known)
        return sets, [xxhash.xxh3_128_digest(s.tobytes()) if len(s) and i is not None else b"" for s, i in zip(sets, ids, strict=True)]

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for block, ids, texts in B.gather(batches):
            sets, digests = prepare(texts, ids, known)
            out = [(f"b{block}", B.pack(B.pack_ids(ids), *B.pack_strings(texts)))]
            local: dict[bytes, int] = {}
            for i, d in enumerate(digests):
                if d and (d not in local or ids[i] < ids[local[d]]):
                    local[d] = i
            keys, rows = np.frombuffer(b"".join(local), np.uint64).reshape(-1, 2), np.fromiter(local.values(), np.uint32, len(local))
            own = np.array([ids[i] for i in rows.tolist()], np.int64)
            for bucket, at in B.by_bucket(keys[:, 0], width):
                out.append((f"w{bucket}", B.pack(b"d", block.encode(), keys[at], rows[at], own[at])))
            grams, counts = np.unique(np.concatenate([*(sets[i] for i in rows.tolist()), np.zeros(0, np.uint64)]), return_counts=True)
            for bucket, at in B.by_bucket(grams >> np.uint64(16), width):
                out.append((f"w{bucket}", B.pack(b"g", block.encode(), *halves(grams[at]), counts[at].astype(np.uint32))))
            yield B.rows(out)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {b"d": [], b"g": []}
        for _, payload in B.of_kind(batches, "w"):
            kind, block, *arrays = B.unpack(payload)
            held[bytes(kind)].append((bytes(block), *map(bytes, arrays)))
        best: dict[bytes, tuple[int, bytes, int]] = {}
        for block, keys, rows, own in held[b"d"]:
            for i, (row, key) in enumerate(zip(np.frombuffer(rows, np.uint32).tolist(), np.frombuffer(own, np.int64).tolist(), strict=True)):
                d = keys[16 * i : 16 * i + 16]
                best[d] = min(best.get(d, (key, block, row)), (key, block, row))
        for block, keys, rows, _ in held[b"d"]:
            found = [best[keys[i : i + 16]] for i in range(0, len(keys), 16)]
            mine = np.array([(b, r) == (block, row) for (_, b, r), row in zip(found, np.frombuffer(rows, np.uint32).tolist(), strict=True)], np.uint8)
            yield B.rows([(f"b{block.decode()}", B.pack(b"d", rows, np.array([k for k, _, _ in found], np.int64), mine))])
        if held[b"g"]:
            arrays = [joined(high, low) for _, high, low, _ in held[b"g"]]
            flat = np.concatenate(arrays)
            order = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) != 0]))
            sums = np.add.reduceat(np.concatenate([np.frombuffer(c, np.uint32) for *_, c in held[b"g"]])[order].astype(np.int64), first)
            total = np.empty(len(flat), np.int64)
            total[order] = np.repeat(sums, np.diff(np.append(first, len(flat))))
            del flat, order
            at = 0
            for (block, high, low, _), grams in zip(held[b"g"], arrays, strict=True):
                times = total[at : at + len(grams)]
                at += len(grams)
                if (often := times > 1).any():
                    yield B.rows([(f"b{block.decode()}", B.pack(b"g", np.frombuffer(high, np.uint16)[often], np.frombuffer(low, np.uint32)[often], times[often]))])

    schema = "kind string, key string, payload binary, id long, rep long, size long, idx int"

    def post(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds, keys, loads, numbers = [], [], [], [[], [], [], []]
        answers = [B.unpack(p) for p in B.payloads(right, "b")]
        many = [(joined(a[1], a[2]), np.frombuffer(a[3], np.int64)) for a in answers if bytes(a[0]) == b"g"]
        grams, times = (np.concatenate(x) for x in zip(*many, strict=True)) if many else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(grams)
        grams, times = grams[order], times[order]
        known = WordHashes()
        for payload in B.payloads(left, "b"):
            ids, sizes, blob = B.unpack(payload)
            ids, texts, block = B.unpack_ids(ids), B.unpack_strings(sizes, blob), left.column("key")[0].as_py()
            sets, digests = prepare(texts, ids, known)
            rep_of: dict[int, tuple[int, bool]] = {}
            for a in answers:
                if bytes(a[0]) == b"d":
                    for row, key, mine in zip(np.frombuffer(a[1], np.uint32).tolist(), np.frombuffer(a[2], np.int64).tolist(), bytes(a[3]), strict=True):
                        rep_of[row] = (key, bool(mine))
            by_digest = {digests[row]: key for row, (key, _) in rep_of.items()}
            for i, (key, s, d) in enumerate(zip(ids, sets, digests, strict=True)):
                for column, value in zip(numbers, (key, by_digest.get(d, key), len(s), i), strict=True):
                    column.append(value)
            kinds, keys, loads = ["c"] * len(ids), [block] * len(ids), [None] * len(ids)
            reps = [i for i, (_, mine) in rep_of.items() if mine and len(sets[i])]
            firsts = [prefix(sets[i], grams, times, share) for i in reps]
            if not firsts:
                continue
            flat, pos, often = (np.concatenate(x) for x in zip(*firsts, strict=True))
            doc = np.repeat(np.arange(len(reps)), [len(x) for x, _, _ in firsts])
            used = np.unique(doc).tolist()
            if not used:
                continue
            own = np.array([ids[i] for i in reps], np.int64)
            signatures = np.zeros((len(reps), PARTIAL_COUNTS), np.uint8)
            for k in used:
                signatures[k] = signature(sets[reps[k]])
            lengths = np.array([len(sets[i]) for i in reps], np.int64)
            parts = -(-often // part_postings)
            turn = (mix(own.view(np.uint64)[doc] + mix(flat)) % parts.astype(np.uint64)).astype(np.uint64)
            cell = mix(flat + turn * _MIX[2])
            for kind, chosen in (("p", np.arange(len(flat))), ("h", np.flatnonzero(parts > 1))):
                dealt = cell[chosen] if kind == "p" else flat[chosen]
                for bucket, at in B.by_bucket(mix(dealt), width):
                    at = chosen[at]
                    kinds.append(kind)
                    keys.append(f"p{bucket}")
                    loads.append(B.pack((cell if kind == "p" else flat)[at], own[doc[at]], lengths[doc[at]].astype(np.uint32), pos[at].astype(np.uint32), signatures[doc[at]]))
            picked = [reps[k] for k in used]
            kinds.append("t")
            keys.append(block)
            loads.append(B.pack(np.array(picked, np.uint32), own[used], *B.pack_strings([texts[i] for i in picked])))
        rest = [None] * (len(kinds) - len(numbers[0]))
        columns = (
            (kinds, pa.string()), (keys, pa.string()), (loads, pa.binary()), (numbers[0] + rest, pa.int64()),
            (numbers[1] + rest, pa.int64()), (numbers[2] + rest, pa.int64()), (numbers[3] + rest, pa.int32()),
        )
        return pa.table({name: pa.array(values, t) for name, (values, t) in zip(("kind", "key", "payload", "id", "rep", "size", "idx"), columns, strict=True)})

    sent = B.exchange(docs.mapInArrow(to_blocks, B.SCHEMA))
    return written(B.cogroup(sent, sent.mapInArrow(answer, B.SCHEMA), post, schema), "grams")


_POSTING = (np.uint64, np.int64, np.uint32, np.uint32, np.uint8)


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges, strict=True) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def candidates(table: DataFrame, share: tuple[int, int], cell_postings: int) -> DataFrame:
    """Step 3: ``(a, b)`` edges that connect all plausible pairs."""

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = [B.unpack(payload) for _, payload in B.of_kind(batches, "p")]
        forest = Forest()
        if loads:
            cell, own, n, pos, sig = (np.concatenate([np.frombuffer(x[k], t) for x in loads]) for k, t in enumerate(_POSTING))
            del loads
            order = np.lexsort((own, n, cell))
            cell, own, n, pos, sig = cell[order], own[order], n[order].astype(np.int64), pos[order].astype(np.int64), sig.reshape(-1, PARTIAL_COUNTS)[order]
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            sizes = np.diff(np.append(first, len(cell)))
            twos = first[sizes == 2]
            for a in twos[plausible(n, pos, sig, twos, twos + 1, share)].tolist():
                forest.join(int(own[a]), int(own[a + 1]))
            for at, m in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                rows = np.arange(at, at + m)
                rows = rows[paired(n[rows], pos[rows], share)] if m > 16 else rows
                if len(rows) < 2:
                    continue
                roots = np.array([forest.root(int(x)) for x in own[rows]], np.int64)
                for i, j in connect(len(rows), lambda i, js, rows=rows: plausible(n, pos, sig, rows[i], rows[js], share), roots):
                    forest.join(int(own[rows[i]]), int(own[rows[j]]))
        yield _edges(forest.edges)

    met = B.exchange(table.where("kind = 'p'").select("key", "payload")).mapInArrow(span, "a long, b long")
    long = table.where("kind = 'h'").select("key", "payload")
    return met if long.isEmpty() else _across(long, written(met, "met"), share, cell_postings)


def _with_partners(postings: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The postings for which some length of their list allows a link; a list has an entry for each length."""
    num, den = share
    lengths = postings.groupBy("gram", "n").agg(F.min("pos").alias("pos")).groupBy("gram").agg(F.collect_list(F.struct("n", "pos")).alias("lengths"))

    def link(other):
        both = F.col("n") + other["n"]
        need = F.ceil(num * both / float(num + den) - 1e-9)
        near = F.least("n", other["n"]) * den >= F.greatest("n", other["n"]) * num
        return near & (F.least(F.col("n") - F.col("pos"), other["n"] - other["pos"]) >= need) & (both - 2 * need >= F.when(F.col("n") == other["n"], 2).otherwise(1))

    kinds = postings.select("gram", "n", "pos").distinct().join(lengths, "gram").where(F.exists("lengths", link)).drop("lengths")
    return postings.join(kinds, ["gram", "n", "pos"])


def _across(long: DataFrame, met: DataFrame, share: tuple[int, int], cell_postings: int) -> DataFrame:
    """``met`` and edges between the parts of long posting lists.

    Of each list the postings outside its largest component meet all its postings, in cells
    of at most ``cell_postings`` on either side; what is connected already is not compared.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, payload in B.of_kind(batches, "p"):
            gram, own, n, pos, sig = (np.frombuffer(x, t) for x, t in zip(B.unpack(payload), _POSTING, strict=True))
            columns = [pa.array(x) for x in (gram.view(np.int64), own, n.astype(np.int64), pos.astype(np.int64))]
            columns.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(PARTIAL_COUNTS), len(gram), [None, pa.py_buffer(sig)]).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "id", "n", "pos", "sig"])

    def meet(group: pa.Table) -> pa.Table:
        own, label, n, pos = (group.column(c).to_numpy() for c in ("id", "label", "n", "pos"))
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(-1, PARTIAL_COUNTS)
        left = np.flatnonzero(group.column("left").to_numpy(zero_copy_only=False))
        right = np.flatnonzero(~group.column("left").to_numpy(zero_copy_only=False))
        forest, label = Forest(), label.copy()
        for i in right.tolist():
            js = left[label[left] != label[i]]
            hit = js[plausible(n, pos, sig, i, js, share)] if len(js) else js
            for k in np.unique(label[hit], return_index=True)[1] if len(hit) else ():
                j = int(hit[k])
                forest.edges.append((int(own[i]), int(own[j])))
                label[label == label[j]] = label[i]
        return pa.Table.from_batches([_edges(forest.edges)])

    found = written(connected_components(met, "a", "b"), "met")
    postings = _with_partners(written(long.mapInArrow(listed, "gram long, id long, n long, pos long, sig binary"), "long"), share)
    postings = written(postings.join(found, F.col("id") == F.col("node"), "left").select("gram", "id", "n", "pos", "sig", F.coalesce("component", "id").alias("label")), "long")
    facts = postings.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("gram").agg(F.sum("k").alias("m"), F.max_by("label", F.struct("k", "label")).alias("main"), F.max("k").alias("most"))
    facts = written(facts.where("m > most"), "facts")
    deal = lambda c, seed, size: F.pmod(F.xxhash64(F.lit(seed), c), F.ceil(size / cell_postings).cast("long"))
    upto = lambda size: F.sequence(F.lit(0).cast("long"), F.ceil(size / cell_postings).cast("long") - 1)
    known, outside = postings.join(facts, "gram"), F.col("label") != F.col("main")
    columns = ("gram", "id", "n", "pos", "sig", "label")
    lefts = known.select(*columns, F.lit(True).alias("left"), deal("id", 0, F.col("m")).alias("p"), F.explode(upto(F.col("m") - F.col("most"))).alias("q"))
    rights = known.where(outside).select(*columns, F.lit(False).alias("left"), F.explode(upto(F.col("m"))).alias("p"), deal("id", 1, F.col("m") - F.col("most")).alias("q"))
    return met.union(lefts.union(rights).groupBy("gram", "p", "q").applyInArrow(meet, "a long, b long"))


def _cells(table: DataFrame, members: DataFrame, n: int, share: tuple[int, int]) -> DataFrame:
    """Verify the cells of ``members(key, idx, label, cells array<string>)``: ``(a, b)`` edges that connect them.

    Documents of equal label count as connected.
    """
    num, den = share

    def sets(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        wanted = {r["idx"]: r for r in right.to_pylist()}
        known = WordHashes()
        for payload in B.payloads(left, "") if wanted else ():
            rows, own, sizes, blob = B.unpack(payload)
            texts = B.unpack_strings(sizes, blob)
            for row, key, text in zip(np.frombuffer(rows, np.uint32).tolist(), np.frombuffer(own, np.int64).tolist(), texts, strict=True):
                if (member := wanted.get(row)) is None:
                    continue
                grams = gram_sets([text], n, known)[0].tobytes()
                for cell in member["cells"]:
                    for column, value in zip(out, (cell, key, member["label"], grams), strict=True):
                        column.append(value)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
        return pa.table({name: pa.array(c, k) for name, c, k in zip(("cell", "id", "label", "grams"), out, kinds, strict=True)})

    def verify(group: pa.Table) -> pa.Table:
        own, label = group.column("id").to_numpy(), group.column("label").to_numpy()
        grams = [np.frombuffer(g, np.uint64) for g in group.column("grams").to_pylist()]
        order = sorted(range(len(own)), key=lambda i: (len(grams[i]), own[i]))
        own, label, grams = own[order], label[order], [grams[i] for i in order]
        n = np.array([len(g) for g in grams], np.int64)
        flat = np.concatenate(grams)
        _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[column] > 1
        columns, column = np.unique(column[shared], return_inverse=True)
        row = np.repeat(np.arange(len(own)), n)[shared]
        words = -(-len(columns) // 64)
        if len(own) * words * 8 <= MATRIX_BYTES:
            matrix = np.zeros((len(own), words), np.uint64)
            np.bitwise_or.at(matrix, (row, column // 64), np.uint64(1) << (column % 64).astype(np.uint64))
            common = lambda i, js: np.bitwise_count(matrix[js] & matrix[i]).sum(1, dtype=np.int64)
        else:
            by_column, ends = row[np.argsort(column, kind="stable")], np.cumsum(np.bincount(column, minlength=len(columns)))
            starts, of_row = np.append(0, ends[:-1]), np.searchsorted(row, np.arange(len(own) + 1))

            def common(i: int, js: np.ndarray) -> np.ndarray:
                mine = column[of_row[i] : of_row[i + 1]]
                who = [by_column[a:b] for a, b in zip(starts[mine].tolist(), ends[mine].tolist(), strict=True)]
                return np.bincount(np.concatenate([*who, by_column[:0]]), minlength=len(own))[js]


        def linked(i: int, js: np.ndarray) -> np.ndarray:
            near = n[js] * den >= num * n[i]
            out = np.zeros(len(js), bool)
            if near.any():
                inter = common(i, js[near])
                out[near] = den * inter >= num * (n[i] + n[js[near]] - inter)
            return out

        edges = connect(len(own), linked, label)
        return pa.table({"a": pa.array([int(own[i]) for i, _ in edges], pa.int64()), "b": pa.array([int(own[j]) for _, j in edges], pa.int64())})

    texts = B.exchange(table.where("kind = 't'").select("key", "payload"))
    cells = B.cogroup(texts, members, sets, "cell string, id long, label long, grams binary")
    return cells.groupBy("cell").applyInArrow(verify, "a long, b long")


def linked_components(table: DataFrame, clusters: DataFrame, n: int, share: tuple[int, int], part_grams: int, part_rows: int) -> DataFrame:
    """Steps 4 and 5: ``(node, component)`` of the true links within the candidate clusters."""
    rows = table.where("kind = 'c' and id = rep").select("id", "size", F.col("key").alias("block"), "idx")
    own = rows.join(clusters, rows["id"] == clusters["node"]).select("id", "size", "block", "idx", F.col("component").alias("cluster"))
    by_size = F.struct("size", "id")
    facts = own.groupBy("cluster").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("members"), F.array_distinct(F.array(F.min("id"), F.max("id"), F.min(by_size)["id"], F.max(by_size)["id"])).alias("pilots"))
    facts = written(facts, "facts")  # so that the join can be split where a cluster is hot
    parts = F.ceil(F.greatest(F.col("weight") / part_grams, F.col("members") / part_rows)).cast("long")
    members = written(own.join(facts, "cluster").withColumns({"parts": parts, "part": F.pmod(F.xxhash64("id"), parts)}), "members")
    name = lambda *c: F.concat_ws("-", *[x.cast("string") for x in c])
    everywhere = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda i: name(F.col("cluster"), i))
    cells = F.when(F.array_contains("pilots", F.col("id")), everywhere).otherwise(F.array(name(F.col("cluster"), F.col("part"))))
    first = written(_cells(table, members.select(F.col("block").alias("key"), "idx", F.col("id").alias("label"), cells.alias("cells")), n, share), "links")
    found = connected_components(first, "a", "b")
    large = members.where("parts > 1")
    if large.isEmpty():
        return found
    found = written(found, "found")
    large = large.join(found, large["id"] == found["node"], "left").select(*members.columns, F.coalesce("component", "id").alias("label"))
    counts = large.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("cluster").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    large = written(large.join(counts, "cluster"), "large")
    outside = F.col("label") != F.col("main")
    rest = large.where(outside).groupBy("cluster").agg(F.ceil(F.sum("size") / part_grams).cast("long").alias("rest_parts"))
    again = large.join(rest, "cluster").withColumns({"rest_part": F.pmod(F.xxhash64(F.lit(1), "id"), F.col("rest_parts")), "parts": F.ceil(F.col("weight") / part_grams).cast("long")})
    again = again.withColumn("part", F.pmod(F.xxhash64(F.lit(2), "id"), F.col("parts")))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    with_rest = F.transform(upto("rest_parts"), lambda j: name(F.col("cluster"), F.col("part"), j))
    with_parts = F.transform(upto("parts"), lambda i: name(F.col("cluster"), i, F.col("rest_part")))
    cells = F.when(outside, F.array_union(with_rest, with_parts)).otherwise(with_rest)
    second = _cells(table, again.select(F.col("block").alias("key"), "idx", "label", cells.alias("cells")), n, share)
    return connected_components(first.union(second), "a", "b")


def components(
    docs: DataFrame, n: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text",
    part_postings: int = PART_POSTINGS, cell_postings: int = CELL_POSTINGS, part_grams: int = PART_GRAMS, part_rows: int = PART_ROWS,
) -> DataFrame:
    """``(id, n_shingles, component_id)`` of every row.

    Words are runs without ASCII white space, A-Z lower-cased; the set is the distinct
    ``n``-word shingles, or the whole sequence where there are fewer words. Rows link when
    ``share[1] * intersection >= share[0] * union``, and the component is the smallest id
    reachable. A text without words (null, empty) has no shingles and no links. Ids must be
    integers; a null id stays a row with a null component and no links. Repeated rows are
    one class. Other columns are not read; an empty table gives an empty result. The last
    four parameters bound what one task compares, not what is found.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    table = classes(own, n, share, part_postings)
    near = connected_components(candidates(table, share, cell_postings), "a", "b")
    links = written(linked_components(table, near, n, share, part_grams, part_rows), "components")
    rows = table.where("kind = 'c'").select("id", "rep", "size")
    return rows.join(links, rows["rep"] == links["node"], "left").select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")
    )


def keep_one(
    docs: DataFrame, n: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", repeats: bool = True
) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component, with all columns.

    Components are found over rows, so several texts of one id are judged each by itself.
    With ``repeats`` the rows without id stay and link nothing, and linked rows that share the
    smallest id all stay; otherwise exactly one row of each component stays, null ids last.
    """
    keyed = B.numbered(docs)
    own = keyed.where(F.col(id_col).isNotNull()) if repeats else keyed
    found = components(own, n, share, B.ROW, text_col).select(F.col(B.ROW).alias("row"), "component_id")
    rank = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("row").alias("row"))
    rows = own.select(F.col(B.ROW).alias("row"), F.col(id_col).alias("id")).join(found, "row")
    rows = written(rows.where(F.col("component_id").isNotNull()), "rows")
    best = rows.groupBy("component_id").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("k")).where("k > 1")
    best = written(best, "best")  # so that the join can be split where a component is hot
    lost = F.col("id") != F.col("best.id") if repeats else F.col("row") != F.col("best.row")
    drop = rows.join(best, "component_id").where(lost).select(F.col("row").alias(B.ROW))
    return B.without(keyed, drop, B.ROW).drop(B.ROW)
