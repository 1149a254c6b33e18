"""Interval patterns over constraint instances, action scheduling, and impact between time windows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlog.model import Log
from braidlog.operators import filters, performance
from braidlog.operators.petri import Net


def allen(kind: str, s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Interval relations: before, meets, overlaps, during, starts, finishes, equal."""
    tests = {
        "before": e1 < s2,
        "meets": e1 == s2,
        "overlaps": (s1 < s2) & (s2 < e1) & (e1 < e2),
        "during": (s2 < s1) & (e1 < e2),
        "starts": (s1 == s2) & (e1 < e2),
        "finishes": (s2 < s1) & (e1 == e2),
        "equal": (s1 == s2) & (e1 == e2),
    }
    return tests[kind]


def matches(instances: DataFrame, pattern: tuple) -> DataFrame:
    """Instance combinations that satisfy a pattern tree.

    A pattern is a constraint name or ``(relation, left, right)``; the interval of an inner
    node spans both sides. ``instances(name, start, end)``. Each inner node is one join.
    """
    if isinstance(pattern, str):
        return instances.where(F.col("name") == pattern).select(F.array(F.struct("name", "start", "end")).alias("used"), "start", "end")
    kind, left, right = pattern
    a = matches(instances, left).select(F.col("used").alias("u1"), F.col("start").alias("s1"), F.col("end").alias("e1"))
    b = matches(instances, right).select(F.col("used").alias("u2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    joined = a.join(b, allen(kind, F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")))
    return joined.select(F.concat("u1", "u2").alias("used"), F.least("s1", "s2").alias("start"), F.greatest("e1", "e2").alias("end"))


def count_before(instances: DataFrame, left: str, right: str, bin_width: int = 3_600_000_000) -> DataFrame:
    """One row ``(n, first)``: how many instance pairs satisfy ``("before", left, right)``, and the earliest start of one.

    Counts what ``matches`` lists. Ends and starts are put in order within bins of time, and
    running totals over the bins add what lies before: no pair is made.
    """
    ends = instances.where(F.col("name") == left).select(F.col("end").alias("at"), F.lit(1).alias("is_end"), F.col("start").alias("start"))
    starts = instances.where(F.col("name") == right).select(F.col("start").alias("at"), F.lit(0).alias("is_end"), F.lit(None).cast("long").alias("start"))
    points = ends.union(starts).withColumn("bin", F.floor(F.col("at") / bin_width))
    bins = points.groupBy("bin").agg(F.sum(1 - F.col("is_end")).alias("k"))
    bins = bins.select("bin", (F.sum("k").over(Window.orderBy("bin")) - F.col("k")).alias("earlier"), F.sum("k").over(Window.partitionBy()).alias("total"))  # a row for each bin
    up_to = F.sum(1 - F.col("is_end")).over(Window.partitionBy("bin").orderBy("at", "is_end").rowsBetween(Window.unboundedPreceding, 0))
    later = points.withColumn("up_to", up_to).where("is_end = 1").join(bins, "bin").select("start", (F.col("total") - F.col("earlier") - F.col("up_to")).alias("n"))
    return later.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min(F.when(F.col("n") > 0, F.col("start"))).alias("first"))


def schedule(actions: list[tuple[str, float]], precedence: list[tuple[str, str]]) -> list[tuple[str, float, float]]:
    """Earliest ``(action, start, end)`` hours; the longest duration of an action counts, predecessors end first."""
    longest: dict[str, float] = {}
    for name, hours in actions:
        longest[name] = max(hours, longest.get(name, 0.0))
    start: dict[str, float] = {}

    def begin(name: str, path: tuple[str, ...] = ()) -> float:
        if name in path:
            raise ValueError(f"{name} precedes itself")
        if name not in start:
            start[name] = max((begin(a, (*path, name)) + longest[a] for a, b in precedence if b == name and a in longest), default=0.0)
        return start[name]

    return sorted(((n, begin(n), begin(n) + h) for n, h in longest.items()), key=lambda x: (x[1], x[0]))


def hours(amount: float, unit: str) -> float:
    return amount * {"seconds": 1 / 3600, "minutes": 1 / 60, "hours": 1, "days": 24, "weeks": 168, "months": 720, "years": 8760}[unit]


def structural(net: Net, activities: list[str]) -> dict[str, set[str]]:
    """Object types and downstream activities that a change of some activities touches."""
    types: set[str] = set()
    after: set[str] = set()
    for a in activities:
        if a in net.transitions:
            types |= {net.places[p].object_type for p in net.pre(a) | net.post(a)}
            after |= {net.transitions[t].label for t in net.descendants(a) if t in net.transitions and net.transitions[t].label}
    return {"types": types, "activities": after - set(activities)}


def operational(marking: DataFrame, places: list[str]) -> DataFrame:
    """Objects whose tokens are in some places now. ``marking(place, object_id, n)``."""
    return marking.where(F.col("place").isin(places) & (F.col("n") > 0)).select("object_id").distinct()


def performance_change(log: Log, measure: str, before: tuple[datetime, datetime], after: tuple[datetime, datetime], aggregate: str = "avg") -> DataFrame:
    """A performance measure by activity in two time windows, and the difference."""

    def of(window: tuple[datetime, datetime], name: str) -> DataFrame:
        times = performance.event_times(filters.by_event_time(log, *window))
        return performance.by_activity(times, measure, [aggregate]).select("activity", F.col(aggregate).alias(name))

    return of(before, "before").join(of(after, "after"), "activity", "full_outer").select("activity", "before", "after", (F.col("after") - F.col("before")).alias("delta"))
