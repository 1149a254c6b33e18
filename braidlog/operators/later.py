"""``traces.later_events`` of a log whose source knows each event with two objects as numbers (``Log.paired``).

Events move to their first object, then to their second one and back, as packed blocks of
numbers. Where all events of an object meet, each knows its successor, then its horizon; the
pairs are made there, batch by batch, and do not move. All events of one object are held by
one task, so the pairs of a single object are not spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlog.functions.numbers import NONE, Table, dealt, joined, taken, unpack, worked
from braidlog.functions.runtime import shuffle_partitions

#: Pairs in one batch.
PAIRS = 1 << 19
_TENS = 10 ** np.arange(19, dtype=np.int64)  # a long has 19 digits at most


def sound(rows: DataFrame) -> bool:
    """Whether every row is an event of its own with all its numbers."""
    whole = F.expr("id >= 0 and a is not null and b is not null and us is not null")
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(whole, 1)).alias("whole"), F.count_distinct("id").alias("ids")).first()
    return n["n"] == n["whole"] == n["ids"]


def _order(ids: np.ndarray, *before: np.ndarray, last: tuple[np.ndarray, ...] = ()) -> np.ndarray:
    """The order by keys (the last first), then by ids as text, then by ``last``."""
    digits = np.maximum(1, np.searchsorted(_TENS, ids, "right"))
    return np.lexsort((*last, digits, ids.astype(np.uint64) * _TENS.astype(np.uint64)[19 - digits], *before))


def _followed(rows: Table, own: str) -> tuple[Table, np.ndarray, np.ndarray]:
    """Rows in order, and time and id of the next event of the object."""
    rows = taken(rows, _order(rows["id"], rows["us"], rows[own]))
    us, ids = np.full(len(rows["id"]), NONE), np.full(len(rows["id"]), NONE)
    same = np.flatnonzero(rows[own][1:] == rows[own][:-1])
    us[same], ids[same] = rows["us"][same + 1], rows["id"][same + 1]
    return rows, us, ids


def _later(us: np.ndarray, ids: np.ndarray, us2: np.ndarray, ids2: np.ndarray) -> np.ndarray:
    """Whether the second event is the later one."""
    out = us2 > us
    tie = np.flatnonzero(us2 == us)
    out[tie] = ids2[tie].astype(str) > ids[tie].astype(str)
    return out


def _bounded(rows: Table, own: str) -> Table:
    """Rows of the second object, with the horizon: the later one of both successors, none if one is missing."""
    rows, us, ids = _followed(rows, own)
    us_first, id_first = rows.pop("us_next"), rows.pop("id_next")
    both = (us != NONE) & (us_first != NONE)
    far = _later(us_first, id_first, us, ids)
    return rows | {"us_end": np.where(both, np.where(far, us, us_first), NONE), "id_end": np.where(both, np.where(far, ids, id_first), NONE)}


def _pairs(rows: Table, own: str, other: str | None) -> Iterator[pa.RecordBatch]:
    """Pairs of events of one object up to the horizon, without those that share the other object too."""
    n = len(rows["id"])
    end = rows["us_end"] != NONE
    marks = np.flatnonzero(end)
    key = np.concatenate([rows[own], rows[own][marks]])
    us, ids = np.concatenate([rows["us"], rows["us_end"][marks]]), np.concatenate([rows["id"], rows["id_end"][marks]])
    kind = np.concatenate([np.zeros(n, np.int8), np.ones(len(marks), np.int8)])
    order = _order(ids, us, key, last=(kind,))
    upto = np.cumsum(order < n)  # events up to each row
    first = order[order < n]  # events in order
    place = np.empty(n, np.int64)
    place[first] = np.arange(n)
    object_of = rows[own][first]
    ends = np.searchsorted(object_of, rows[own], "right")
    at = order >= n
    ends[marks[order[at] - n]] = upto[at]
    count = np.maximum(0, ends - place - 1)
    total = np.cumsum(count[first])
    text = pa.array(rows["id"][first]).cast(pa.string())
    others = None if other is None else rows[other][first]
    begin = total - count[first]
    for low in range(0, int(total[-1]) if n else 0, PAIRS):
        number = np.arange(low, min(low + PAIRS, int(total[-1])))
        src = np.searchsorted(total, number, "right")
        dst = src + 1 + number - begin[src]
        if others is not None:
            apart = others[src] != others[dst]
            src, dst = src[apart], dst[apart]
        yield pa.RecordBatch.from_arrays([text.take(pa.array(src)), text.take(pa.array(dst))], ["src", "dst"])


def later_events(rows: DataFrame) -> DataFrame:
    """``(src, dst)`` of ``(a, b, us, id)``; the name of an event's object ``a`` comes before that of ``b``."""
    n = shuffle_partitions(rows.sparkSession)

    def by_first(tables: dict[str, Table]) -> Iterator[tuple[str, Table]]:
        if "row" in tables:
            rows, us, ids = _followed(tables["row"], "a")
            yield "next", {"b": rows["b"], "a": rows["a"], "us": rows["us"], "id": rows["id"], "us_next": us, "id_next": ids}

    def by_second(tables: dict[str, Table]) -> Iterator[tuple[str, Table]]:
        if "next" in tables:
            rows = _bounded(tables["next"], "b")
            yield "end", {c: rows[c] for c in ("a", "us", "id", "us_end", "id_end")}

    def made(own: str, other: str | None, kind: str):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [unpack(data) for batch in batches for k, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True) if k == kind]
            if held:
                table = joined(held)
                held.clear()
                yield from _pairs(_bounded(table, own) if kind == "next" else table, own, other)

        return kernel

    known = worked(dealt(rows.select("a", "b", "us", "id"), "row", n), by_first, n)
    ended = worked(known, by_second, n)
    pairs = lambda blocks, *how: blocks.repartitionById(n, "bucket").mapInArrow(made(*how), "src string, dst string")
    return pairs(known, "b", "a", "next").union(pairs(ended, "a", None, "end"))
