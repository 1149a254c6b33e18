"""Log filters. Each returns a log or a DataFrame of what is kept; all are lazy."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlog.functions.runtime import written
from braidlog.model import Log
from braidlog.operators.traces import follows


def _most_frequent(counts: DataFrame, key: str, share: float) -> DataFrame:
    """Keys in descending count up to and with the one at which the cumulative share exceeds ``share``.

    Running sums go over the distinct counts, of which there are few (below the square root
    of twice the rows), not over the keys; only the count that crosses the share is ordered
    by key, to take its first ones.
    """
    counts = written(counts.select(key, "n"), "counts")
    groups = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    down = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    before, total = F.coalesce(F.sum(F.col("n") * F.col("k")).over(down), F.lit(0)), F.sum(F.col("n") * F.col("k")).over(Window.partitionBy())
    fit = F.floor((F.lit(share) * total - before) / F.col("n")) + 1
    kept = groups.select("n", "k", F.least(F.col("k"), F.greatest(fit, F.lit(0))).alias("m")).where("m > 0")
    whole = counts.join(kept.where("m = k").select("n"), "n", "left_semi").select(key, "n")
    crossing = kept.where("m < k").first()  # one row at most
    if crossing is None:
        return whole
    return whole.union(counts.where(F.col("n") == crossing.n).orderBy(key).limit(crossing.m).select(key, "n"))


def frequent_activities(log: Log, share: float) -> DataFrame:
    return _most_frequent(log.events.groupBy("activity").agg(F.count(F.lit(1)).alias("n")), "activity", share)


def by_activity_share(log: Log, share: float) -> Log:
    """Keep the events of the most frequent activities."""
    return log.with_events(log.events.join(F.broadcast(frequent_activities(log, share).select("activity")), "activity", "left_semi"))  # activities are few


def by_variant_share(pe_events: DataFrame, variants: DataFrame, share: float) -> DataFrame:
    """Executions of the most frequent variants; above 0.9999 all. ``variants`` maps ``pe_id`` to ``variant``."""
    if share > 0.9999:
        return pe_events
    keep = _most_frequent(variants.groupBy("variant").agg(F.count(F.lit(1)).alias("n")), "variant", share)
    return pe_events.join(variants.join(keep, "variant", "left_semi"), "pe_id", "left_semi")


def by_executions(log: Log, pe_events: DataFrame, pe_ids: DataFrame) -> Log:
    """Keep the events of the given executions."""
    ids = pe_events.join(pe_ids, "pe_id", "left_semi").select("event_id").distinct()
    return log.with_events(log.events.join(ids, "event_id", "left_semi"))


def window_test(strategy: str, start: Column, end: Column, low: datetime, high: datetime) -> Column:
    """Whether an execution ``[start, end]`` belongs to the window; both bounds count.

    ``start`` and ``end`` test one bound of the execution, ``contained`` both, ``spanning``
    whether a bound of the window falls into the execution, ``overlapping`` whether they meet at all.
    """
    low_c, high_c = F.lit(low), F.lit(high)
    tests = {
        "start": start.between(low_c, high_c),
        "end": end.between(low_c, high_c),
        "contained": (start >= low_c) & (end <= high_c),
        "spanning": ((start <= low_c) & (low_c <= end)) | ((start <= high_c) & (high_c <= end)),
        "overlapping": (start <= high_c) & (end >= low_c),
    }
    return tests[strategy]


def by_time(log: Log, pe_events: DataFrame, low: datetime, high: datetime, strategy: str) -> DataFrame:
    """Executions that lie in a time window by ``strategy``."""
    spans = pe_events.join(log.events.select("event_id", "ts"), "event_id").groupBy("pe_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return spans.where(window_test(strategy, F.col("start"), F.col("end"), low, high))


def by_event_time(log: Log, low: datetime | None = None, high: datetime | None = None) -> Log:
    """Keep the events of a time window; at least one bound is needed."""
    if low is None and high is None:
        raise ValueError("give a bound")
    test = F.lit(True)
    if low is not None:
        test = test & (F.col("ts") >= F.lit(low))
    if high is not None:
        test = test & (F.col("ts") <= F.lit(high))
    return log.with_events(log.events.where(test))


def by_objects(log: Log, object_ids: DataFrame) -> Log:
    """Keep the relations of the given objects, and their events."""
    return log.with_relations(log.e2o.join(object_ids.select("object_id"), "object_id", "left_semi"))


def by_activity_count(log: Log, least: int) -> Log:
    """Keep the events of activities with at least ``least`` events."""
    many = log.events.groupBy("activity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return log.with_events(log.events.join(F.broadcast(many), "activity", "left_semi"))


def on_paths(log: Log, object_type: str, pairs: list[tuple[str, str]], positive: bool = True) -> DataFrame:
    """Events of one type's traces that lie on (or, negatively, not on) a listed directly-follows pair."""
    edges = follows(log).where(F.col("object_type") == object_type)
    listed = F.struct("src_activity", "dst_activity").isin([F.struct(F.lit(a), F.lit(b)) for a, b in pairs])
    hit = edges.where(listed).select(F.explode(F.array("src", "dst")).alias("event_id")).distinct()
    own = log.events.join(log.e2o.where(F.col("object_type") == object_type).select("event_id").distinct(), "event_id", "left_semi")
    return own.join(hit, "event_id", "left_semi" if positive else "left_anti")


def clean_rare_arcs(log: Log, object_type: str, least: int) -> DataFrame:
    """Drop events until every directly-follows pair of the type occurs ``least`` times.

    An event that is only on rare pairs goes, which makes new pairs; a round that drops
    nothing ends the loop. The event set is written between rounds.
    """
    current = log
    while True:  # every round but the last drops events
        edges = follows(current).where(F.col("object_type") == object_type)
        common = edges.groupBy("src_activity", "dst_activity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        good = edges.join(F.broadcast(common), ["src_activity", "dst_activity"], "left_semi")  # pairs of activities are few
        ids = written(good.select(F.explode(F.array("src", "dst")).alias("event_id")).distinct(), "arcs")
        before, after = current.e2o.where(F.col("object_type") == object_type).select("event_id").distinct().count(), ids.count()
        if before == after:
            return ids
        current = replace(log, events=log.events.join(ids, "event_id", "left_semi"), e2o=log.e2o.join(ids, "event_id", "left_semi"))


def by_rules(log: Log, rules: DataFrame) -> Log:
    """Keep a relation if its activity has no rule ``(activity, allowed)`` or its type is allowed.

    ``rules`` has one row for each activity, ``allowed`` is an array of types.
    """
    joined = log.timed().join(F.broadcast(rules), "activity", "left")  # one row for each activity
    ok = F.col("allowed").isNull() | F.array_contains("allowed", F.col("object_type"))
    return log.with_relations(joined.where(ok).select(*log.e2o.columns))


def keep(log: Log, activities: list[str] | None = None, types: list[str] | None = None) -> Log:
    """Keep event types and object types; events keep living without objects."""
    out = log if activities is None else log.with_events(log.events.where(F.col("activity").isin(activities)))
    if types is None:
        return out
    return replace(out, objects=out.objects.where(F.col("object_type").isin(types)), e2o=out.e2o.where(F.col("object_type").isin(types)))


def resources_to_attributes(log: Log, types: list[str]) -> DataFrame:
    """Events with a ``resource_<type>`` array for each given type."""
    own = log.e2o.where(F.col("object_type").isin(types))
    wide = own.groupBy("event_id").pivot("object_type", types).agg(F.sort_array(F.collect_set("object_id")))
    none = F.array().cast("array<string>")
    return log.events.join(wide, "event_id", "left").select("event_id", "activity", "ts", *[F.coalesce(F.col(f"`{t}`"), none).alias(f"resource_{t}") for t in types])


def drop_empty_events(log: Log) -> Log:
    """Drop events without objects."""
    return replace(log, events=log.events.join(log.e2o.select("event_id").distinct(), "event_id", "left_semi"))


def sample_executions(pe_events: DataFrame, percent: float, seed: int = 0) -> DataFrame:
    """A seeded share of whole executions, decided by a hash of their id."""
    chosen = F.pmod(F.xxhash64(F.lit(seed), "pe_id"), F.lit(1_000_000)) < int(percent * 10_000)
    return pe_events.where(chosen)


def safe_name(name: Column) -> Column:
    """Letters, digits and underscores only."""
    return F.regexp_replace(F.trim(name), r"[^0-9A-Za-z_]+", "_")
