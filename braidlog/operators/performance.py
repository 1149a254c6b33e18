"""Waiting and service times from the event graph, by activity and optionally by object type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlog.functions.runtime import shuffle_partitions
from braidlog.model import Log
from braidlog.operators import executions
from braidlog.operators.traces import event_graph, follows, micros, seconds

AGGREGATES = {"avg": F.avg, "med": F.median, "std": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max}


def _neighbours(log: Log) -> DataFrame:
    """Event graph edges with the time and types of the predecessor."""
    types = log.e2o.groupBy("event_id").agg(F.collect_set("object_type").alias("src_types"))
    source = log.events.join(types, "event_id").select(F.col("event_id").alias("src"), micros("ts").alias("src_us"), "src_types")
    return event_graph(log).join(source, "src")


def event_times(log: Log, object_type: str | None = None) -> DataFrame:
    """Per event with predecessors, in seconds: flow, sojourn, synchronization, elapsed, and by type pooling, lagging, readiness.

    A type that no predecessor has gives null.
    """
    has = F.array_contains("src_types", object_type) if object_type else F.lit(False)
    own = F.when(has, F.col("src_us"))
    pre = _neighbours(log).groupBy("dst").agg(
        F.min("src_us").alias("first"), F.max("src_us").alias("last"), F.min(own).alias("own_first"), F.max(own).alias("own_last")
    )
    at = log.events.select(F.col("event_id").alias("dst"), "activity", micros("ts").alias("us"))
    col = lambda x: seconds(x)
    return pre.join(at, "dst").select(
        F.col("dst").alias("event_id"),
        "activity",
        col(F.col("us") - F.col("first")).alias("flow"),
        col(F.col("us") - F.col("last")).alias("sojourn"),
        col(F.col("last") - F.col("first")).alias("synchronization"),
        col(F.col("us") - F.col("last")).alias("elapsed"),
        col(F.col("own_last") - F.col("own_first")).alias("pooling"),
        col(F.col("own_last") - F.col("first")).alias("lagging"),
        col(F.col("own_first") - F.col("first")).alias("readiness"),
    )


def remaining_times(log: Log) -> DataFrame:
    """Seconds from each event to its latest successor in the event graph."""
    target = log.events.select(F.col("event_id").alias("dst"), micros("ts").alias("dst_us"))
    post = event_graph(log).join(target, "dst").groupBy("src").agg(F.max("dst_us").alias("last"))
    at = log.events.select(F.col("event_id").alias("src"), "activity", micros("ts").alias("us"))
    return post.join(at, "src").select(F.col("src").alias("event_id"), "activity", seconds(F.col("last") - F.col("us")).alias("remaining"))


def by_activity(times: DataFrame, measure: str, aggregates: list[str] | None = None) -> DataFrame:
    """Aggregate one measure by activity; events without it do not count."""
    chosen = aggregates or list(AGGREGATES)
    return times.where(F.col(measure).isNotNull()).groupBy("activity").agg(F.count(measure).alias("n"), *[AGGREGATES[a](measure).alias(a) for a in chosen])


def object_frequency(log: Log, object_type: str) -> DataFrame:
    """Objects of a type per event, zeros included, by activity."""
    n = log.e2o.where(F.col("object_type") == object_type).groupBy("event_id").agg(F.count_distinct("object_id").alias("n"))
    counts = log.events.join(n, "event_id", "left").select("activity", F.coalesce("n", F.lit(0)).alias("n"))
    return counts.groupBy("activity").agg(F.count(F.lit(1)).alias("n_events"), F.sum("n").alias("n_objects"), F.min("n").alias("least"), F.max("n").alias("most"))


def activity_frequency(log: Log, object_type: str) -> DataFrame:
    """Events of each activity per object of a type, zeros included."""
    objects = log.objects.where(F.col("object_type") == object_type)
    n_objects = objects.agg(F.count_distinct("object_id").alias("n_all"))
    n = log.timed().where(F.col("object_type") == object_type).groupBy("activity", "object_id").agg(F.count_distinct("event_id").alias("n"))
    out = n.groupBy("activity").agg(F.count(F.lit(1)).alias("n_with"), F.sum("n").alias("n_events"), F.max("n").alias("most"))
    return out.join(F.broadcast(n_objects)).select("activity", F.col("n_all").alias("n_objects"), "n_with", "n_events", "most")  # one row


def non_negative(value: Column) -> Column:
    return F.when(value >= 0, value)


def replay_times(visits: DataFrame, log: Log) -> DataFrame:
    """Waiting, service, sojourn, synchronization, pooling, lagging and flow times from token visits.

    ``visits(object_id, object_type, event_id, arrived, left)`` has one row for each token
    an event consumes. Of several visits of an object the latest counts. Negative times are null.
    """
    at = log.events.select("event_id", "activity", micros("ts").alias("us"))
    came = visits.select("event_id", "object_id", "object_type", micros("arrived").alias("came"))
    # Dealt out once, by event: all that follows is about one event.
    latest = came.repartition(shuffle_partitions(visits.sparkSession), "event_id").groupBy("event_id", "object_id", "object_type").agg(F.max("came").alias("came"))
    each = latest.groupBy("event_id", "object_type").agg(F.min("came").alias("type_first"), F.max("came").alias("type_last"))
    own = Window.partitionBy("event_id")
    whole = each.withColumns({"first": F.min("type_first").over(own), "last": F.max("type_last").over(own)}).join(at, "event_id")
    s = lambda x: non_negative(seconds(x))
    return whole.select(
        "event_id", "activity", "object_type",
        s(F.col("us") - F.col("last")).alias("waiting"), s(F.col("us") - F.col("us")).alias("service"), s(F.col("us") - F.col("last")).alias("sojourn"),
        s(F.col("last") - F.col("first")).alias("synchronization"), s(F.col("type_last") - F.col("type_first")).alias("pooling"),
        s(F.col("type_last") - F.col("first")).alias("lagging"), s(F.col("us") - F.col("first")).alias("flow"),
    )


def correlated_metrics(log: Log, pe_events: DataFrame, activities: list[str] | None = None, sync: tuple[str, str] | None = None) -> DataFrame:
    """Times in seconds and frequencies of every correlated graph, or of its part with the given activities.

    The context of a graph is the direct predecessors of its first event, whether of the part or
    not. ``waiting`` runs from the latest of them to the first event, ``service`` from the first
    to the last event, ``sojourn`` from the context (without one: the first event) to the last
    event, and ``sync`` is the gap between the latest predecessors that share an object of either
    of two types. Without a context, waiting and sync are null. Graphs without an event of the
    part have no row. Events of equal time are ordered by id. ``n_interacting`` counts activities
    with an event of several types. Two events of one graph may be far apart, so only the first
    and last of each graph are compared with others.
    """
    at = log.events.select("event_id", "activity", micros("ts").alias("us"))
    inner = pe_events.join(at, "event_id")
    if activities is not None:
        inner = inner.where(F.col("activity").isin(activities))
    ends = inner.groupBy("pe_id").agg(F.min(F.struct("us", "event_id")).alias("lo"), F.max("us").alias("last"), F.count(F.lit(1)).alias("n_events"))
    ends = ends.select("pe_id", F.col("lo.event_id").alias("dst"), F.col("lo.us").alias("first"), "last", "n_events")
    linked = follows(log).join(ends.select("dst").distinct(), "dst", "left_semi").groupBy("src", "dst").agg(F.collect_set("object_type").alias("types"))
    before = linked.join(at.select(F.col("event_id").alias("src"), F.col("us").alias("src_us")), "src")
    latest = [F.max("src_us").alias("context")]
    if sync is not None:
        latest += [F.max(F.when(F.array_contains("types", t), F.col("src_us"))).alias(f"side_{i}") for i, t in enumerate(sync)]
    context = before.groupBy("dst").agg(*latest)
    own = inner.select("pe_id", "event_id", "activity").join(log.e2o, "event_id")
    mixed = own.groupBy("pe_id", "event_id", "activity").agg(F.count_distinct("object_type").alias("n")).where("n > 1")
    interacting = mixed.groupBy("pe_id").agg(F.count_distinct("activity").alias("n_interacting"))
    objects = own.groupBy("pe_id").agg(F.count_distinct("object_id").alias("n_objects"), F.count_distinct("object_type").alias("n_types"))
    out = ends.join(context, "dst", "left").join(objects, "pe_id", "left").join(interacting, "pe_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    gap = F.abs(F.col("side_0") - F.col("side_1")) if sync is not None else F.lit(None).cast("long")
    return out.select(
        "pe_id", seconds(F.col("first") - F.col("context")).alias("waiting"), seconds(F.col("last") - F.col("first")).alias("service"),
        seconds(F.col("last") - F.coalesce("context", "first")).alias("sojourn"), seconds(gap).alias("sync"),
        "n_events", zero("n_objects"), zero("n_types"), zero("n_interacting"),
    )


def correlated_objects(log: Log, pe_events: DataFrame) -> DataFrame:
    """``(pe_id, object_type, n_objects)``: distinct objects of each type in every correlated graph."""
    return pe_events.join(log.e2o, "event_id").groupBy("pe_id", "object_type").agg(F.count_distinct("object_id").alias("n_objects"))


def connected_objects(log: Log, object_type: str) -> DataFrame:
    """``correlated_objects`` of the graphs that one type's objects connect: a case that is a component by itself is counted where it lies."""
    components = lambda own: executions.component_executions(own.with_relations(own.e2o.where(F.col("object_type") == object_type)))
    if log.cases_of(object_type) is None:
        return correlated_objects(log, components(log))
    ids = F.array_distinct(F.flatten(F.transform("events", lambda e: F.transform(e["objects"], lambda o: F.struct(o["object_type"].alias("t"), o["object_id"].alias("i"))))))
    counts = executions.let(ids, lambda every: F.transform(F.array_distinct(F.transform(every, lambda o: o["t"])), lambda t: F.struct(t.alias("object_type"), F.size(F.filter(every, lambda o: (o["t"] == t) & o["i"].isNotNull())).cast("long").alias("n_objects"))))
    done, other = executions.worked(log, object_type, F.struct(F.array_min(F.transform("events", lambda e: e["event_id"])).alias("pe_id"), counts.alias("counts")))
    found = done.select("w.pe_id", F.explode("w.counts").alias("c")).select("pe_id", "c.object_type", "c.n_objects")
    return found if other is None else found.unionByName(correlated_objects(other, components(other)))
