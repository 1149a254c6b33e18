"""Features of events and executions for predictive monitoring.

Every event feature is a function ``(log, pe_events, **parameters)`` that gives
``(pe_id, event_id, value)``; ``averaged`` turns it into one value for each event, the mean
over all executions that contain it. Execution features give ``(pe_id, value)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlog.functions.runtime import shuffle_partitions
from braidlog.model import Log
from braidlog.operators.executions import execution_edges, execution_objects
from braidlog.operators.performance import AGGREGATES
from braidlog.operators.traces import micros, seconds


def _base(log: Log, pe: DataFrame) -> DataFrame:
    return pe.join(log.events.select("event_id", "activity", micros("ts").alias("us"), "attrs"), "event_id")


def _so_far(*keys: str) -> Window:
    """Events of the execution up to and with the current time, ties included."""
    return Window.partitionBy("pe_id", *keys).orderBy("us").rangeBetween(Window.unboundedPreceding, 0)


def _value(df: DataFrame, value: Column) -> DataFrame:
    return df.select("pe_id", "event_id", value.cast("double").alias("value"))


def _pre(log: Log, pe: DataFrame) -> DataFrame:
    """Predecessors of every event within its execution, with their data."""
    edges = execution_edges(log, pe).select("pe_id", "src", F.col("dst").alias("event_id")).distinct()
    source = log.events.select(F.col("event_id").alias("src"), F.col("activity").alias("src_activity"), micros("ts").alias("src_us"), F.col("attrs").alias("src_attrs"))
    return edges.join(source, "src")


def _per_event(log: Log, pe: DataFrame, values: DataFrame, default: float | None = None) -> DataFrame:
    """Values of ``(pe_id, event_id, value)`` for every event, a default elsewhere."""
    joined = pe.join(values, ["pe_id", "event_id"], "left")
    value = F.col("value").cast("double")
    return joined.select("pe_id", "event_id", (value if default is None else F.coalesce(value, F.lit(default))).alias("value"))


def current_activity(log: Log, pe: DataFrame, activity: str) -> DataFrame:
    """1 if, of the events so far, one of the activity has no successor among them."""
    times = log.events.select("event_id", "activity", micros("ts").alias("us"))
    edges = execution_edges(log, pe).select("pe_id", F.col("src").alias("event_id"), "dst").distinct()
    first_next = edges.join(log.events.select(F.col("event_id").alias("dst"), micros("ts").alias("dst_us")), "dst").groupBy("pe_id", "event_id").agg(F.min("dst_us").alias("until"))
    spans = pe.join(times, "event_id").join(first_next, ["pe_id", "event_id"], "left")
    # an event is open from its own time until just before its first successor's time
    marks = spans.where(F.col("activity") == activity).select("pe_id", F.col("us").alias("at"), F.lit(1).alias("step"))
    ends = spans.where((F.col("activity") == activity) & F.col("until").isNotNull()).select("pe_id", F.greatest("until", "us").alias("at"), F.lit(-1).alias("step"))
    points = spans.select("pe_id", F.col("us").alias("at"), F.lit(0).alias("step"), "event_id")
    line = points.unionByName(marks.union(ends).withColumn("event_id", F.lit(None).cast("string")), allowMissingColumns=True)
    w = Window.partitionBy("pe_id").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    open_now = line.select("pe_id", "event_id", F.sum("step").over(w).alias("n")).where("event_id is not null")
    return _value(open_now, F.when(F.col("n") > 0, 1).otherwise(0))


def preceding_activities(log: Log, pe: DataFrame, activity: str) -> DataFrame:
    n = _pre(log, pe).groupBy("pe_id", "event_id").agg(F.sum(F.when(F.col("src_activity") == activity, 1).otherwise(0)).alias("value"))
    return _per_event(log, pe, n, 0.0)


def previous_activity_count(log: Log, pe: DataFrame, activity: str) -> DataFrame:
    return _value(_base(log, pe), F.sum(F.when(F.col("activity") == activity, 1).otherwise(0)).over(_so_far()))


def event_activity(log: Log, pe: DataFrame, activity: str) -> DataFrame:
    return _value(_base(log, pe), F.when(F.col("activity") == activity, 1).otherwise(0))


def event_identity(log: Log, pe: DataFrame) -> DataFrame:
    return _value(pe, F.lit(1))


def previous_values(log: Log, pe: DataFrame, attribute: str, aggregate: str = "avg") -> DataFrame:
    """Aggregate of a numeric attribute over the events so far."""
    number = F.expr(f"try_cast(attrs['{attribute}'] as double)")
    return _value(_base(log, pe).withColumn("x", number), AGGREGATES[aggregate]("x").over(_so_far()))


def preceding_values(log: Log, pe: DataFrame, attribute: str, aggregate: str = "avg") -> DataFrame:
    """Aggregate of a numeric attribute over the direct predecessors."""
    number = F.expr(f"try_cast(src_attrs['{attribute}'] as double)")
    return _per_event(log, pe, _pre(log, pe).groupBy("pe_id", "event_id").agg(AGGREGATES[aggregate](number).alias("value")))


def attribute_value(log: Log, pe: DataFrame, attribute: str) -> DataFrame:
    return _value(_base(log, pe), F.expr(f"try_cast(attrs['{attribute}'] as double)"))


def resource_workload(log: Log, pe: DataFrame, object_type: str, horizon: float) -> DataFrame:
    """Events within the trailing horizon (seconds) that share a resource of the type, itself included."""
    w = Window.partitionBy("object_id").orderBy("us").rangeBetween(-int(horizon * 1e6), 0)
    own = log.timed().where(F.col("object_type") == object_type).select("event_id", "object_id", micros("ts").alias("us"))
    n = own.select("event_id", F.count(F.lit(1)).over(w).alias("n")).groupBy("event_id").agg(F.sum("n").alias("value"))
    return pe.join(n, "event_id", "left").select("pe_id", "event_id", F.coalesce("value", F.lit(0)).cast("double").alias("value"))


def total_workload(log: Log, pe: DataFrame, horizon: float) -> DataFrame:
    """Events of the whole log within the trailing horizon.

    Bins of one horizon bound what a task reads: an event needs its own bin and the one
    before. In them events are counted once, in order of time: an event's figure is the count
    up to its time without the count before the horizon, so no frame is gone through again
    for each event. Events without a time are counted among themselves.
    """
    width = max(1, int(horizon * 1e6))
    us, at = F.col("us"), log.events.select("event_id", micros("ts").alias("us")).withColumn("bin", F.floor(F.col("us") / width).cast("long"))
    row = lambda bin_, key, kind: F.struct(bin_.alias("bin"), key.alias("key"), F.lit(kind).alias("kind"))
    own = F.col("bin")
    rows = F.array(row(own, us - width, 0), row(own, us, 1), row(own, us, 2), F.when(own.isNotNull(), row(own + 1, us, 1)))
    each = at.select("event_id", "us", F.explode(F.array_compact(rows)).alias("r")).select("r.*", F.when(F.col("r.kind") != 1, F.col("event_id")).alias("event_id"), F.when(F.col("r.kind") != 1, us).alias("us"))
    w = Window.partitionBy("bin").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = each.withColumn("n", F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).over(w)).where("kind != 1")
    side = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("n")))
    n = counted.groupBy("event_id", "us").agg((side(2) - side(0)).alias("value"), F.sum(F.when(F.col("kind") == 2, 1).otherwise(0)).cast("int").alias("times"))
    n = n.select("event_id", F.explode(F.array_repeat("value", F.col("times"))).alias("value"))  # an event listed twice
    return pe.join(n, "event_id").select("pe_id", "event_id", F.col("value").cast("double").alias("value"))


def event_resource(log: Log, pe: DataFrame, object_type: str, object_id: str) -> DataFrame:
    own = log.e2o.where((F.col("object_type") == object_type) & (F.col("object_id") == object_id)).select("event_id", F.lit(1).alias("value")).distinct()
    return pe.join(own, "event_id", "left").select("pe_id", "event_id", F.coalesce("value", F.lit(0)).cast("double").alias("value"))


def _whole() -> Window:
    return Window.partitionBy("pe_id")


def execution_duration(log: Log, pe: DataFrame) -> DataFrame:
    return _value(_base(log, pe), seconds(F.max("us").over(_whole()) - F.min("us").over(_whole())))


def elapsed_time(log: Log, pe: DataFrame) -> DataFrame:
    return _value(_base(log, pe), seconds(F.col("us") - F.min("us").over(_whole())))


def remaining_time(log: Log, pe: DataFrame) -> DataFrame:
    return _value(_base(log, pe), seconds(F.max("us").over(_whole()) - F.col("us")))


def _pre_times(log: Log, pe: DataFrame, object_type: str | None = None) -> DataFrame:
    types = log.e2o.groupBy(F.col("event_id").alias("src")).agg(F.collect_set("object_type").alias("types"))
    pre = _pre(log, pe).join(types, "src")
    own = F.when(F.array_contains("types", object_type) if object_type else F.lit(False), F.col("src_us"))
    agg = pre.groupBy("pe_id", "event_id").agg(F.min("src_us").alias("first"), F.max("src_us").alias("last"), F.min(own).alias("own_first"), F.max(own).alias("own_last"))
    return agg.join(log.events.select("event_id", micros("ts").alias("us")), "event_id")


def _timing(value: Callable[[], Column], typed: bool = False) -> Callable[..., DataFrame]:
    def feature(log: Log, pe: DataFrame, object_type: str | None = None) -> DataFrame:
        """Seconds; 0 for events without predecessors in the execution (or, by type, without such)."""
        times = _value(_pre_times(log, pe, object_type if typed else None), seconds(value()))
        return _per_event(log, pe, times, 0.0)

    return feature


flow_time = _timing(lambda: F.col("us") - F.col("first"))
synchronization_time = _timing(lambda: F.col("last") - F.col("first"))
sojourn_time = _timing(lambda: F.col("us") - F.col("last"))
waiting_time = _timing(lambda: F.col("us") - F.col("last"))
service_time = _timing(lambda: F.col("us") - F.col("us"))
pooling_time = _timing(lambda: F.col("own_last") - F.col("own_first"), True)


def lagging_time(log: Log, pe: DataFrame, object_type: str) -> DataFrame:
    """Latest predecessor with the type less the earliest of the latest predecessors of all types."""
    types = log.e2o.select(F.col("event_id").alias("src"), "object_type").distinct()
    latest = _pre(log, pe).join(types, "src").groupBy("pe_id", "event_id", "object_type").agg(F.max("src_us").alias("last"))
    own = F.max(F.when(F.col("object_type") == object_type, F.col("last")))
    return _per_event(log, pe, latest.groupBy("pe_id", "event_id").agg(seconds(own - F.min("last")).alias("value")), 0.0)


def total_object_count(log: Log, pe: DataFrame, horizon: float) -> DataFrame:
    """Distinct objects of the whole log within the trailing horizon.

    An object counts at an event if its latest relation up to then is within the horizon, so
    each stretch in which an object is alive adds one at its begin and takes one at its end.
    """
    width = int(horizon * 1e6)
    own = log.timed().select("object_id", micros("ts").alias("us")).distinct()
    nxt = F.lead("us").over(Window.partitionBy("object_id").orderBy("us"))
    alive = own.select("us", F.least(F.col("us") + width + 1, F.coalesce(nxt, F.col("us") + width + 1)).alias("until"))
    marks = alive.select("us", F.lit(1).alias("step")).union(alive.select("until", F.lit(-1))).groupBy("us").agg(F.sum("step").alias("step"))
    events = log.events.select("event_id", micros("ts").alias("us"))
    counts = running_total(marks, "us", "step")
    at = events.select("us").distinct().join(counts, "us").select("us", F.col("total").alias("value"))
    n = events.join(at, "us").select("event_id", "value")
    return pe.join(n, "event_id").select("pe_id", "event_id", F.col("value").cast("double").alias("value"))


def running_total(df: DataFrame, order: str, value: str, bins: int | None = None) -> DataFrame:
    """Running sums over a distinct order column in two levels: within ranges, then over the ranges' totals.

    There are four ranges for each shuffle partition if ``bins`` is not given.
    """
    bins = bins or 4 * shuffle_partitions(df.sparkSession)
    bounds = df.agg(F.min(order).alias("low"), F.max(order).alias("high"))
    binned = df.join(F.broadcast(bounds)).withColumn("bin", F.floor((F.col(order) - F.col("low")) * bins / (F.col("high") - F.col("low") + 1)).cast("int"))  # one row
    totals = binned.groupBy("bin").agg(F.sum(value).alias("t"))
    before = totals.select("bin", (F.sum("t").over(Window.orderBy("bin")) - F.col("t")).alias("before"))  # ``bins`` rows
    inner = F.sum(value).over(Window.partitionBy("bin").orderBy(order))
    return binned.withColumn("inner", inner).join(F.broadcast(before), "bin").select(order, (F.col("inner") + F.col("before")).alias("total"))


def previous_object_count(log: Log, pe: DataFrame) -> DataFrame:
    """Distinct objects of the execution's events so far."""
    first = pe.join(log.timed().select("event_id", "object_id", micros("ts").alias("us")), "event_id").groupBy("pe_id", "object_id").agg(F.min("us").alias("us"))
    return _count_firsts(log, pe, first)


def previous_type_count(log: Log, pe: DataFrame, object_type: str) -> DataFrame:
    """Distinct objects of a type among the execution's events so far."""
    own = log.timed().where(F.col("object_type") == object_type)
    first = pe.join(own.select("event_id", "object_id", micros("ts").alias("us")), "event_id").groupBy("pe_id", "object_id").agg(F.min("us").alias("us"))
    return _count_firsts(log, pe, first)


def _count_firsts(log: Log, pe: DataFrame, first: DataFrame) -> DataFrame:
    marks = first.select("pe_id", "us", F.lit(None).cast("string").alias("event_id"), F.lit(1).alias("step"))
    points = _base(log, pe).select("pe_id", "us", "event_id", F.lit(0).alias("step"))
    return _value(points.unionByName(marks).withColumn("n", F.sum("step").over(_so_far())).where("event_id is not null"), F.col("n"))


def number_of_objects(log: Log, pe: DataFrame) -> DataFrame:
    n = log.e2o.groupBy("event_id").agg(F.count_distinct("object_id").alias("value"))
    return pe.join(n, "event_id", "left").select("pe_id", "event_id", F.coalesce("value", F.lit(0)).cast("double").alias("value"))


def event_type_count(log: Log, pe: DataFrame, object_type: str) -> DataFrame:
    return number_of_objects(log.with_relations(log.e2o.where(F.col("object_type") == object_type)), pe)


def has_object(log: Log, pe: DataFrame, object_id: str) -> DataFrame:
    own = log.e2o.where(F.col("object_id") == object_id).select("event_id", F.lit(1).alias("value")).distinct()
    return pe.join(own, "event_id", "left").select("pe_id", "event_id", F.coalesce("value", F.lit(0)).cast("double").alias("value"))


def averaged(values: DataFrame) -> DataFrame:
    """One value for each event: the mean over its executions."""
    return values.groupBy("event_id").agg(F.avg("value").alias("value"))


EVENT_FEATURES: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        current_activity, preceding_activities, previous_activity_count, event_activity, event_identity, previous_values, preceding_values, attribute_value, resource_workload, total_workload,
        event_resource, execution_duration, elapsed_time, remaining_time, lagging_time, total_object_count, previous_object_count, previous_type_count, number_of_objects, event_type_count, has_object,
    )
} | {"flow_time": flow_time, "synchronization_time": synchronization_time, "sojourn_time": sojourn_time, "waiting_time": waiting_time, "service_time": service_time, "pooling_time": pooling_time}


def execution_features(log: Log, pe: DataFrame, objects: list[str] = (), activities: list[str] = ()) -> DataFrame:
    """All execution features in one pass.

    Events, starting and ending events, throughput time, identity, objects, unique
    activities, seconds between the last two event times, service time and its mean per
    event (0, as events have one time), and 1/0 columns for asked objects and activities.
    """
    edges = execution_edges(log, pe).select("pe_id", "src", "dst").distinct()
    with_pre = edges.select("pe_id", F.col("dst").alias("event_id"), F.lit(1).alias("has_pre")).distinct()
    with_post = edges.select("pe_id", F.col("src").alias("event_id"), F.lit(1).alias("has_post")).distinct()
    base = _base(log, pe).join(with_pre, ["pe_id", "event_id"], "left").join(with_post, ["pe_id", "event_id"], "left")
    times = F.sort_array(F.collect_set("us"), False)
    figures = base.groupBy("pe_id").agg(
        F.count_distinct("event_id").alias("n_events"),
        F.sum(F.when(F.col("has_pre").isNull(), 1).otherwise(0)).alias("n_starting"),
        F.sum(F.when(F.col("has_post").isNull(), 1).otherwise(0)).alias("n_ending"),
        seconds(F.max("us") - F.min("us")).alias("throughput"),
        F.lit(1).alias("identity"),
        F.count_distinct("activity").alias("n_activities"),
        F.coalesce(seconds(F.get(times, F.lit(0)) - F.get(times, F.lit(1))), F.lit(0.0)).alias("delta_last_event"),
        F.lit(0.0).alias("service_time"),
        F.lit(0.0).alias("avg_service_time"),
        *[F.max(F.when(F.col("activity") == a, 1).otherwise(0)).alias(f"activity_{a}") for a in activities],
    )
    own = execution_objects(log, pe).groupBy("pe_id").agg(F.count_distinct("object_id").alias("n_objects"), *[F.max(F.when(F.col("object_id") == o, 1).otherwise(0)).alias(f"object_{o}") for o in objects])
    return figures.join(own, "pe_id", "left")


def extract(log: Log, pe: DataFrame, features: list[tuple[str, dict]]) -> DataFrame:
    """One wide row ``(pe_id, event_id, f1, f2, ...)`` for each event of each execution: the tabular encoding."""
    out = pe
    for i, (name, parameters) in enumerate(features, 1):
        values = EVENT_FEATURES[name](log, pe, **parameters).withColumnRenamed("value", f"f{i}")
        out = out.join(values, ["pe_id", "event_id"], "left")
    return out


def sequences(log: Log, table: DataFrame, k: int | None = None) -> DataFrame:
    """Feature vectors of each execution in time order; with ``k``, every run of ``k`` of them."""
    names = [c for c in table.columns if c not in ("pe_id", "event_id")]
    rows = table.join(log.events.select("event_id", "ts"), "event_id").withColumn("v", F.array(*[F.col(c) for c in names]))
    if k is None:
        step = F.sort_array(F.collect_list(F.struct("ts", "event_id", "v")))
        return rows.groupBy("pe_id").agg(F.transform(step, lambda s: s["v"]).alias("sequence"))
    w = Window.partitionBy("pe_id").orderBy("ts", "event_id").rowsBetween(-(k - 1), 0)
    return rows.select("pe_id", "event_id", F.collect_list("v").over(w).alias("sequence")).where(F.size("sequence") == k)


def split(table: DataFrame, test_share: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a seeded hash of the execution."""
    test = F.pmod(F.xxhash64(F.lit(seed), "pe_id"), F.lit(1_000_000)) < int(test_share * 1_000_000)
    return table.where(~test), table.where(test)


def scaled(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Standardise every feature by the training rows' mean and population deviation."""
    names = [c for c in train.columns if c not in ("pe_id", "event_id")]
    fit = train.agg(*[f(c).alias(f"{c}_{n}") for c in names for n, f in (("mean", F.avg), ("std", F.stddev_pop))])  # one row

    def scale(df: DataFrame) -> DataFrame:
        z = lambda c: F.when(F.col(f"{c}_std") > 0, (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).otherwise(F.col(c) - F.col(f"{c}_mean"))
        return df.join(F.broadcast(fit)).select("pe_id", "event_id", *[z(c).alias(c) for c in names])

    return scale(train), scale(test)


def time_series(log: Log, pe: DataFrame, width: float, strategy: str = "start") -> DataFrame:
    """Executions per tumbling window of ``width`` seconds from the log's first event; empty windows count 0.

    Both bounds of a window count, as in the time filters: ``start``, ``end``, ``contained`` or ``spanning``.
    """
    step = int(width * 1e6)
    bounds = log.events.agg(F.min(micros("ts")).alias("low"), F.max(micros("ts")).alias("high"))
    windows = bounds.select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("high") - F.col("low")) / step))).alias("i"), "low")
    windows = windows.select("i", (F.col("low") + F.col("i") * step).alias("begin"), (F.col("low") + (F.col("i") + 1) * step).alias("end"))
    spans = pe.join(log.events.select("event_id", micros("ts").alias("us")), "event_id").groupBy("pe_id").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    placed = spans.join(F.broadcast(bounds))
    index = lambda c: F.floor((F.col(c) - F.col("low")) / step)
    edge = lambda c: (F.col(c) - F.col("low")) % step == 0  # noqa: E731  a bound belongs to both windows
    touched = lambda c: F.filter(F.array(index(c), F.when(edge(c), index(c) - 1)), lambda i: i.isNotNull() & (i >= 0))
    own = {"start": touched("first"), "end": touched("last"), "contained": F.array_intersect(touched("first"), touched("last")), "spanning": F.sequence(index("first"), index("last"))}[strategy]
    counts = placed.select("pe_id", F.explode(own).alias("i")).groupBy("i").agg(F.count_distinct("pe_id").alias("n"))
    return windows.join(counts, "i", "left").select("i", "begin", "end", F.coalesce("n", F.lit(0)).alias("n"))
