"""Traces, directly-follows relations and event graphs. Ties in time are broken by event id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlog.functions.runtime import written
from braidlog.model import Log
from braidlog.operators import later as paired

#: Events of an object that later events meet at once.
CHUNK = 256


def _trace_window() -> Window:
    return Window.partitionBy("object_type", "object_id").orderBy("ts", "event_id")


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column))


def seconds(micro: Column) -> Column:
    """Seconds of a microsecond difference, as a double."""
    return micro.cast("double") / 1e6


def activity_steps(log: Log) -> DataFrame:
    """``(object_type, before, activity, first, last, n)``: how often an activity follows another, begins or ends a trace, in one pass."""
    return steps_of(log.timed())


def steps_of(timed: DataFrame) -> DataFrame:
    """``activity_steps`` of relations with the activity and time of their event."""
    w = _trace_window()
    at = timed.select("object_type", "activity", F.lag("activity").over(w).alias("before"), F.lag(F.lit(True), 1, False).over(w).alias("has"), F.lead(F.lit(False), 1, True).over(w).alias("last"))
    return at.groupBy("object_type", "before", "activity", (~F.col("has")).alias("first"), "last").agg(F.count(F.lit(1)).alias("n"))


def traces(log: Log) -> DataFrame:
    """``(object_type, object_id, trace, n_events, start, end)``; the trace is an array of structs in time order."""
    step = F.struct("ts", "event_id", "activity")
    return log.timed().groupBy("object_type", "object_id").agg(
        F.sort_array(F.collect_list(step)).alias("trace"), F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("start"), F.max("ts").alias("end")
    )


def follows(log: Log, *keys: str) -> DataFrame:
    """Consecutive events of every object: the event graph's edges with both activities and times.

    ``keys`` are further columns to partition by, for relations repeated per execution.
    """
    w = Window.partitionBy(*keys, "object_type", "object_id").orderBy("ts", "event_id")
    prev = lambda c: F.lag(c).over(w)
    return log.timed().select("*", prev("event_id").alias("src"), prev("activity").alias("src_activity"), prev("ts").alias("src_ts")).where("src is not null").select(
        *keys, "object_type", "object_id", "src", F.col("event_id").alias("dst"), "src_activity", F.col("activity").alias("dst_activity"), "src_ts", F.col("ts").alias("dst_ts")
    )


def directly_follows(log: Log, object_type: str | None = None) -> DataFrame:
    """Counts and total gap (a decimal of microseconds: sums of years overflow a long) of consecutive activities, by object type."""
    edges = follows(log)
    if object_type is not None:
        edges = edges.where(F.col("object_type") == object_type)
    gap = micros("dst_ts") - micros("src_ts")
    return edges.groupBy("object_type", "src_activity", "dst_activity").agg(F.count(F.lit(1)).alias("n"), F.sum(gap.cast("decimal(38,0)")).alias("gap_us"))


def event_graph(log: Log) -> DataFrame:
    """Distinct edges between consecutive events of any object."""
    return follows(log).select("src", "dst").distinct()


def start_end(log: Log) -> DataFrame:
    """How often each activity begins and ends a trace, by object type."""
    w = _trace_window()
    n = F.count(F.lit(1)).over(Window.partitionBy("object_type", "object_id"))
    ranked = log.timed().select("object_type", "activity", F.row_number().over(w).alias("i"), n.alias("n"))
    return ranked.groupBy("object_type", "activity").agg(
        F.sum(F.when(F.col("i") == 1, 1).otherwise(0)).alias("n_start"), F.sum(F.when(F.col("i") == F.col("n"), 1).otherwise(0)).alias("n_end")
    )


def cooccurrence(log: Log) -> DataFrame:
    """Pairs of objects that share events, smaller id first, with the number of shared events."""
    a = log.e2o.select("event_id", F.col("object_id").alias("a"), F.col("object_type").alias("a_type"))
    b = log.e2o.select("event_id", F.col("object_id").alias("b"), F.col("object_type").alias("b_type"))
    return a.join(b, "event_id").where(F.col("a") < F.col("b")).groupBy("a", "a_type", "b", "b_type").agg(F.count(F.lit(1)).alias("n"))


def later_events(log: Log) -> DataFrame:
    """Every event with the later events that share an object, up to the one by which all its objects were seen again.

    The horizon is the latest first successor over the event's objects; an object without
    successor leaves the horizon open. An object's events are numbered, so an event's later
    ones are a range of numbers; ranges meet chunks of ``CHUNK`` numbers, and no two events meet
    that are no result. A pair is given by the smallest object that both share; only events
    listed several times need their pairs made distinct.
    """
    rows = log.paired()
    if rows is not None and paired.sound(rows):
        return paired.later_events(rows)
    w = _trace_window()
    nxt = log.timed().select("event_id", "object_id", F.col("ts").alias("t"), F.lead(F.struct("ts", "event_id")).over(w).alias("next"))
    horizon = nxt.groupBy("event_id").agg(
        F.when(F.count("next") == F.count(F.lit(1)), F.max("next")).alias("horizon"), F.first("t").alias("t"), F.collect_set("object_id").alias("objects"), (F.size(F.collect_set(F.struct("t"))) > 1).alias("again")
    )
    each = log.timed().where("object_id is not null").select("event_id", "object_id", "ts").join(horizon, "event_id")
    each = each.repartition("object_id").dropDuplicates(["object_id", "event_id", "ts"]).withColumn("at", F.struct("ts", "event_id"))
    placed = each.withColumn("pos", F.row_number().over(Window.partitionBy("object_id").orderBy("at")))
    # An event's own row, and for its horizon another one, after the rows up to it.
    starts = F.col("ts").eqNullSafe(F.col("t"))
    marks = F.array_compact(F.array(F.struct(F.col("at").alias("key"), F.lit(0).alias("kind")), F.when(starts & F.col("horizon").isNotNull(), F.struct(F.col("horizon").alias("key"), F.lit(1).alias("kind")))))
    rows = placed.withColumn("mark", F.explode(marks)).withColumns({"key": F.col("mark.key"), "kind": F.col("mark.kind")}).drop("mark")
    upto = Window.partitionBy("object_id").orderBy("key", "kind")
    own = F.when(F.col("kind") == 0, 1).otherwise(0)
    ends = F.when(F.col("kind") == 1, F.sum(own).over(upto.rowsBetween(Window.unboundedPreceding, 0))).when(starts & F.col("horizon").isNull(), F.sum(own).over(Window.partitionBy("object_id")))
    chunk = lambda pos: F.floor(pos / CHUNK)
    numbered = written(rows.select("object_id", "event_id", "objects", "again", "pos", "kind", ends.alias("end")), "later")
    left = numbered.where("end > pos").select("object_id", F.col("event_id").alias("src"), F.col("objects").alias("src_objects"), F.col("again").alias("src_again"), "pos", "end", F.explode(F.sequence(chunk(F.col("pos") + 1), chunk(F.col("end")))).alias("chunk"))
    right = numbered.where("kind = 0").groupBy("object_id", chunk(F.col("pos")).alias("chunk")).agg(F.collect_list(F.struct("pos", "event_id", "objects", "again")).alias("dsts"))
    met = left.join(right, ["object_id", "chunk"])
    again = lambda d: F.col("src_again") | d["again"]
    first = lambda d: F.array_min(F.array_intersect(F.col("src_objects"), d["objects"])) == F.col("object_id")
    later = F.filter("dsts", lambda d: (d["pos"] > F.col("pos")) & (d["pos"] <= F.col("end")) & (again(d) | first(d)))
    pairs = met.select("src", F.explode(F.transform(later, lambda d: F.struct(d["event_id"].alias("dst"), again(d).alias("again")))).alias("d")).select("src", "d.dst", "d.again")
    listed = pairs.where("again").select("src", "dst").distinct()
    found = pairs.where("not again").select("src", "dst")
    return found if numbered.where("again").isEmpty() else found.unionByName(listed)


def flatten(log: Log, object_type: str) -> DataFrame:
    """The log seen from one type: an event row for each of its objects, the object as case."""
    return log.timed().where(F.col("object_type") == object_type).select(F.col("object_id").alias("case_id"), "event_id", "activity", "ts")


def object_counts(log: Log, object_type: str) -> DataFrame:
    """For each activity the sorted numbers of objects of a type over its events."""
    n = log.e2o.where(F.col("object_type") == object_type).groupBy("event_id").agg(F.count_distinct("object_id").alias("n"))
    return log.events.join(n, "event_id").groupBy("activity").agg(F.sort_array(F.collect_list("n")).alias("counts"))


def o2o_adjacency(log: Log) -> DataFrame:
    """Distinct undirected object-to-object neighbours with their types."""
    both = log.o2o.select("source_id", "target_id").union(log.o2o.select("target_id", "source_id")).distinct()
    kind = lambda name: log.objects.select(F.col("object_id").alias(name), F.col("object_type").alias(f"{name.split('_')[0]}_type"))
    return both.join(kind("source_id"), "source_id").join(kind("target_id"), "target_id").select("source_id", "source_type", "target_id", "target_type")


def path_sequences(log: Log, k: int) -> DataFrame:
    """Runs of ``k`` consecutive events of every object, as arrays of activities."""
    w = _trace_window().rowsBetween(-(k - 1), 0)
    runs = log.timed().select("object_type", "object_id", "event_id", F.collect_list("activity").over(w).alias("run"))
    return runs.where(F.size("run") == k)


def subprocess_edges(log: Log, activities: list[str]) -> DataFrame:
    """The event graph's edges between events of the given activities."""
    own = log.events.where(F.col("activity").isin(activities)).select("event_id")
    edges = event_graph(log)
    edges = edges.join(own, edges["src"] == own["event_id"], "left_semi")
    return edges.join(own, edges["dst"] == own["event_id"], "left_semi")


def type_edges(log: Log, types: list[str]) -> DataFrame:
    """The event graph's edges between events that have an object of the given types."""
    own = log.e2o.where(F.col("object_type").isin(types)).select("event_id").distinct()
    edges = event_graph(log)
    edges = edges.join(own, edges["src"] == own["event_id"], "left_semi")
    return edges.join(own, edges["dst"] == own["event_id"], "left_semi")
