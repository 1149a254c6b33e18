"""Histograms over pairs of objects that share an event, from a log whose source numbers them (``model.Numbered``).

Events move to their case, then to their objects of one stage after the other, as packed blocks
of numbers. Where all events of an object meet, its lifespan and its neighbours are known, and
the first row of each pair of objects is marked, so a pair is counted once and is never a row
by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlog.functions.numbers import MOST, NONE, Table, Work, dealt, results, taken, worked
from braidlog.functions.runtime import shuffle_partitions
from braidlog.model import Numbered

#: Of pairs of types: for lifespans their number and that of each relation, for neighbours a histogram.
SPANS, COUNTS = ["a", "b", "total", "d", "di", "i", "ii"], ["a", "b", "hits", "ones", "least", "most"]


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Which rows are the first of their keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= np.diff(k[order]) != 0
    out = np.zeros(len(order), bool)
    out[order[new]] = True
    return out


def _row(columns: list[str], *values: int) -> tuple[str, Table]:
    return "result", {c: np.array([v], np.int64) for c, v in zip(columns, values, strict=True)}


def _relations(a: int, b: int, s1: np.ndarray, e1: np.ndarray, s2: np.ndarray, e2: np.ndarray, both: bool = True) -> Iterator[tuple[str, Table]]:
    """Relations of lifespans, and with ``both`` those the other way round; a lifespan without times has none."""
    timed = (s1 <= e1) & (s2 <= e2)
    d, di = timed & (s2 <= s1) & (e1 <= e2), timed & (s1 <= s2) & (e2 <= e1)
    i = timed & ((e1 < s2) | ((s1 < s2) & (s2 <= e1) & (e1 < e2)))
    ii = timed & ((e2 < s1) | ((s2 < s1) & (s1 <= e2) & (e2 < e1)))
    n = [int(x.sum()) for x in (d, di, i, ii)]
    if len(timed):
        yield _row(SPANS, a, b, len(timed), *n)
        if both:
            yield _row(SPANS, b, a, len(timed), n[1], n[0], n[3], n[2])


def _histogram(a: int, b: int, n: np.ndarray, weight: np.ndarray) -> Iterator[tuple[str, Table]]:
    """How many objects have neighbours, how many have one, and the least and most of those that have any."""
    some = (n > 0) & (weight > 0)
    if some.any():
        yield _row(COUNTS, a, b, int(weight[some].sum()), int(weight[some & (n == 1)].sum()), int(n[some].min()), int(n[some].max()))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)


def _span(ts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.minimum.reduceat(np.where(ts == NONE, MOST, ts), starts), np.maximum.reduceat(ts, starts)


def _totals(log: Numbered, spans: bool, n: int) -> DataFrame:
    types = log.types()
    at = {t: i for i, t in enumerate(types)}
    lead, inner, stages = log.leading, log.inner, log.stages
    shared = [t for stage in stages for t in stage]
    stage_of = {t: k for k, stage in enumerate(stages) for t in stage}

    def forward(rows: Table, after: int) -> Iterator[tuple[str, Table]]:
        """Rows to their object in the next stage in which they have one, as the key of a table of its own."""
        left = np.ones(len(rows["inner"]), bool)
        for t in shared:
            if stage_of[t] > after:
                own = left & (rows[t] != NONE)
                if own.any():
                    yield f"{stage_of[t]}:{t}", {"key": rows[t][own]} | {c: v[own] for c, v in rows.items() if stage_of.get(c, len(stages)) > stage_of[t]}
                left &= ~own

    def cases(tables: dict[str, Table]) -> Iterator[tuple[str, Table]]:
        rows = tables.get("event")
        if rows is None:
            return
        rows = taken(rows, (rows["pe"] != NONE) | (rows["inner"] == 1))
        rows = taken(rows, np.argsort(rows["pe"], kind="stable"))
        pe, own = rows.pop("pe"), rows["inner"] == 1
        known = pe != NONE
        new = np.ones(len(pe), bool)
        new[1:] = (np.diff(pe) != 0) | ~known[1:]
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        for t in shared:
            rows[f"{lead}>{t}"] = (known & (rows[t] != NONE) & _firsts(group, rows[t])).astype(np.int64)
        if spans:
            low, high = _span(rows["ts"], starts)
            some = known[starts]
            yield from _relations(at[lead], at[lead], low[some], high[some], low[some], high[some], False)
            rows[f"{lead}<"], rows[f"{lead}+"] = low[group], high[group]
            s, e = np.where(rows["ts"] == NONE, MOST, rows["ts"])[own], rows["ts"][own]
            yield from _relations(at[inner], at[inner], s, e, s, e, False)
            s, e = (x[known[own]] for x in (s, e))
            yield from _relations(at[lead], at[inner], rows[f"{lead}<"][own & known], rows[f"{lead}+"][own & known], s, e)
        else:
            listed = _sums(~own, starts)
            yield from _histogram(at[lead], at[inner], np.where(known[starts], _sums(own, starts), 0), listed)
            yield from _histogram(at[inner], at[lead], known[own].astype(np.int64), np.ones(own.sum(), np.int64))
            for t in shared:
                yield from _histogram(at[lead], at[t], _sums(rows[f"{lead}>{t}"], starts), listed)
                yield from _histogram(at[inner], at[t], (rows[t][own] != NONE).astype(np.int64), np.ones(own.sum(), np.int64))
        for t in stages[0]:  # several objects of a type in the event of a case
            one = np.flatnonzero((rows[f"{lead}>{t}"] == 1) & ~own)
            many = one[np.isin(group[one], np.flatnonzero(np.bincount(group[one], minlength=1) > 1))]
            if len(many):
                cut = np.split(rows[t][many], np.flatnonzero(np.diff(group[many])) + 1)
                yield f"mates:{t}", {"key": np.concatenate([np.repeat(x, len(x) - 1) for x in cut]), "other": np.concatenate([np.tile(x, len(x))[np.tile(x, len(x)) != np.repeat(x, len(x))] for x in cut])}
        heads = np.flatnonzero(_sums(~own, starts) > 1)
        if spans and len(heads):  # an event that is listed at several times: each of its objects has them all
            at_heads = [np.where(x == MOST, NONE, x) for x in (np.minimum.reduceat(np.where(own | (rows["ts"] == NONE), MOST, rows["ts"]), starts), np.maximum.reduceat(np.where(own, NONE, rows["ts"]), starts))]
            more = np.flatnonzero(~own & known & np.isin(group, heads))
            for t in stages[0]:
                one = more[rows[f"{lead}>{t}"][more] == 1]
                for times in at_heads:
                    yield f"0:{t}", {"key": rows[t][one], "ts": times[group[one]]} | {c: np.full(len(one), NONE) for c in shared if stage_of[c] > 0} | {"inner": np.zeros(len(one), np.int64)}
        yield from forward(rows, -1)

    def meeting(k: int) -> Work:
        def work(tables: dict[str, Table]) -> Iterator[tuple[str, Table]]:
            for kind, table in tables.items():
                if kind[0].isdigit() and int(kind.partition(":")[0]) > k or kind.startswith("other:") and k + 1 < len(stages):
                    yield kind, table
            for t in stages[k]:
                rows = tables.get(f"{k}:{t}")
                if rows is None:
                    continue
                rows = taken(rows, np.argsort(rows["key"], kind="stable"))
                key = rows.pop("key")
                new = np.ones(len(key), bool)
                new[1:] = np.diff(key) != 0
                starts, group = np.flatnonzero(new), np.cumsum(new) - 1
                later = [u for u in shared if stage_of[u] > k]
                before = [z for z in [lead, *shared] if f"{z}>{t}" in rows]
                for u in later:
                    rows[f"{t}>{u}"] = ((rows[u] != NONE) & _firsts(group, rows[u])).astype(np.int64)
                mates = tables.get(f"mates:{t}")
                if mates is not None:
                    mates = taken(mates, _firsts(mates["key"], mates["other"]))
                if spans:
                    low, high = _span(rows["ts"], starts)
                    yield from _relations(at[t], at[t], low, high, low, high, False)
                    rows[f"{t}<"], rows[f"{t}+"] = low[group], high[group]
                    s = np.where(rows["ts"] == NONE, MOST, rows["ts"])
                    for z in [*before, inner]:
                        which = (rows["inner"] if z == inner else rows[f"{z}>{t}"]) == 1
                        s1, e1 = (s, rows["ts"]) if z == inner else (rows[f"{z}<"], rows[f"{z}+"])
                        yield from _relations(at[z], at[t], s1[which], e1[which], rows[f"{t}<"][which], rows[f"{t}+"][which])
                    if mates is not None:
                        place = np.searchsorted(key[starts], mates["key"])
                        yield f"other:{t}", {"key": mates["other"], "low": low[place], "high": high[place], "own": np.zeros(len(place), np.int64)}
                        place = np.unique(place)
                        yield f"other:{t}", {"key": key[starts][place], "low": low[place], "high": high[place], "own": np.ones(len(place), np.int64)}
                else:
                    weight = np.zeros(len(starts), np.int64)
                    listed = tables.get(f"listed:{t}")
                    if listed is not None:
                        place = np.minimum(np.searchsorted(key[starts], listed["key"]), len(starts) - 1)
                        hit = key[starts][place] == listed["key"]
                        np.add.at(weight, place[hit], 1)
                    for z in [*before, inner]:
                        yield from _histogram(at[t], at[z], _sums(rows["inner"] if z == inner else rows[f"{z}>{t}"], starts), weight)
                    for u in later:
                        yield from _histogram(at[t], at[u], _sums(rows[f"{t}>{u}"], starts), weight)
                    if mates is not None:
                        yield from _histogram(at[t], at[t], np.bincount(np.searchsorted(key[starts], mates["key"]), minlength=len(starts)), weight)
                for z in before:
                    del rows[f"{z}>{t}"]
                yield from forward(rows, k)
            for kind, table in tables.items():
                if kind.startswith("other:") and k + 1 == len(stages):
                    own = table["own"] == 1
                    at_key = np.argsort(table["key"][own])
                    keys, low, high = (table[c][own][at_key] for c in ("key", "low", "high"))
                    place = np.searchsorted(keys, table["key"][~own])
                    t = at[kind.partition(":")[2]]
                    yield from _relations(t, t, table["low"][~own], table["high"][~own], low[place], high[place], False)

        return work

    blocks = worked(dealt(log.rows.select("pe", "inner", *(["ts"] if spans else []), *shared), "event", n), cases, n)
    for k, stage in enumerate(stages):
        for t in [] if spans else stage:
            blocks = blocks.unionByName(dealt(log.listed[t].where("key is not null"), f"listed:{t}", n))
        blocks = worked(blocks, meeting(k), n)
    return results(blocks, SPANS if spans else COUNTS)


def _named(log: Numbered) -> list[Column]:
    names = F.array(*[F.lit(t) for t in log.types()])
    return [names[F.col("a").cast("int")].alias("source_type"), names[F.col("b").cast("int")].alias("target_type")]


def temporal(log: Numbered) -> DataFrame:
    """``relations.temporal_relations`` with each object and itself."""
    found = _totals(log, True, shuffle_partitions(log.rows.sparkSession)).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in SPANS[2:]])
    return found.select(*_named(log), "total", F.col("d").alias("n_D"), F.col("di").alias("n_Di"), F.col("i").alias("n_I"), F.col("ii").alias("n_Ii"), F.col("total").alias("n_P"))


def neighbours(log: Numbered) -> DataFrame:
    """``(source_type, target_type, hits, ones, least, most)``: histograms of different neighbours over listed objects that have any."""
    found = _totals(log, False, shuffle_partitions(log.rows.sparkSession)).groupBy("a", "b")
    found = found.agg(F.sum("hits").alias("hits"), F.sum("ones").alias("ones"), F.min("least").alias("least"), F.max("most").alias("most"))
    return found.select(*_named(log), "hits", "ones", "least", "most")
