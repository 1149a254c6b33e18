"""Process executions: the cases of an object-centric log."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from braidlog.functions.components import connected_components
from braidlog.functions.runtime import written
from braidlog.model import Log
from braidlog.operators.traces import event_graph

#: Different shapes whose results a task remembers at most.
KNOWN_SHAPES = 100_000


def component_executions(log: Log) -> DataFrame:
    """``(pe_id, event_id)``: events connected through shared objects, named by the smallest event id.

    Relations without event or object do not count.
    """
    return _components(log.e2o.where("event_id is not null and object_id is not null").select("event_id", F.col("object_id").alias("key")))


def _components(pairs: DataFrame) -> DataFrame:
    """Components of events over shared keys; an event without a key stands alone.

    A key of one event links nothing and an event of one key adds no edge, so the search runs
    over keys that share an event only; each event then follows its smallest key.
    """
    times = F.count("key").over(Window.partitionBy(F.coalesce("key", F.concat(F.lit("\0"), "event_id"))))  # nulls do not meet
    shared = pairs.select("event_id", F.when(times > 1, F.col("key")).alias("key"))
    events = written(shared.groupBy("event_id").agg(F.array_sort(F.collect_set("key")).alias("keys")), "keys")
    lone = events.where(F.size("keys") == 0).select(F.col("event_id").alias("pe_id"), "event_id")
    placed = events.where(F.size("keys") > 0).select("event_id", F.col("keys")[0].alias("key"))
    edges = events.where(F.size("keys") > 1).select(F.col("keys")[0].alias("low"), F.explode("keys").alias("key")).where("low <> key").distinct()
    found = connected_components(edges, "key", "low")
    named = written(placed.join(found.withColumnRenamed("node", "key"), "key", "left").select("event_id", F.coalesce("component", "key").alias("component")), "named")
    first = named.groupBy("component").agg(F.min("event_id").alias("pe_id"))  # combines first: most events may be one component
    return lone.unionByName(named.join(first, "component").select("pe_id", "event_id"))


def graph_executions(log: Log) -> DataFrame:
    """Weakly connected components of the event graph, with lone events.

    The events of one object are a path, so they are connected exactly if they share it; a
    relation whose event is not in the log gives that event alone, and so does a missing object.
    """
    key = F.concat_ws("\x1f", F.when(F.col("object_id").isNotNull(), F.col("object_type")), "object_id")
    pairs = log.timed().select("event_id", F.when(F.col("object_id").isNotNull(), key).alias("key"))
    if log.packed_known():  # every relation has its event
        return _components(pairs)
    return _components(pairs.unionByName(log.e2o.where("event_id is not null").select("event_id", F.lit(None).cast("string").alias("key"))))


def selected_components(log: Log, types: list[str] | None = None, activities: list[str] | None = None) -> DataFrame:
    """``(component, object_id, size, size_rank)``: objects connected through events of the chosen activities and types.

    A component is named by its smallest object, its size is the number of its objects, and rank
    1 is the largest; components of one size share a rank. Ranks come from the histogram of
    sizes, so nothing is sorted as a whole. An object without a chosen event is not listed.
    """
    e2o = log.e2o if types is None else log.e2o.where(F.col("object_type").isin(types))
    if activities is not None:
        e2o = e2o.join(log.events.where(F.col("activity").isin(activities)).select("event_id"), "event_id", "left_semi")
    low = e2o.groupBy("event_id").agg(F.min("object_id").alias("low"))
    edges = e2o.join(low, "event_id").select(F.col("object_id").alias("a"), F.col("low").alias("b")).distinct()
    found = written(connected_components(edges, "a", "b").select("component", F.col("node").alias("object_id")), "components")
    sizes_ = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    larger = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = sizes_.groupBy("size").agg(F.count(F.lit(1)).alias("n"))  # a row for each different size: n objects have at most sqrt(2 n)
    ranks = ranks.select("size", (F.coalesce(F.sum("n").over(larger), F.lit(0)) + 1).alias("size_rank"))
    return found.join(sizes_.join(ranks, "size"), "component").select("component", "object_id", "size", "size_rank")


def leading_objects(log: Log, leading: str) -> DataFrame:
    """``(pe_id, object_id, object_type, level)``: objects reached from every object of the leading type.

    A breadth-first search over co-occurring objects in which a type is admitted only at
    the level where it was first reached; the leading type is level 0, so other leading
    objects never enter. There are fewer levels than types. A level goes from objects to their
    events and from there to objects, so an event of many objects makes no pairs, and only
    the new level is written.
    """
    n_types = log.objects.select("object_type").distinct().count()
    links = written(log.e2o.select("event_id", "object_id", "object_type"), "links")
    hop = links.select("event_id", F.col("object_id").alias("from_id"))
    lead = log.objects.where(F.col("object_type") == leading).select(F.col("object_id").alias("pe_id"), "object_id", "object_type", F.lit(0).alias("level"))
    state = frontier = written(lead.join(links.select("object_id").distinct(), "object_id", "left_semi").select("pe_id", "object_id", "object_type", "level"), "leading")
    for level in range(1, n_types):
        events = frontier.select("pe_id", F.col("object_id").alias("from_id")).join(hop, "from_id").select("pe_id", "event_id").distinct()
        new = events.join(links, "event_id").select("pe_id", "object_id", "object_type").distinct()
        seen = state.select("pe_id", "object_type").distinct()
        new = new.join(seen, ["pe_id", "object_type"], "left_anti").withColumn("level", F.lit(level))
        frontier = written(new, "leading")
        if frontier.isEmpty():
            break
        state = state.unionByName(frontier.select(*state.columns))
    return state


def leading_executions(log: Log, leading: str, objects: DataFrame | None = None) -> DataFrame:
    """``(pe_id, event_id)``: all events of any object of the execution."""
    objects = leading_objects(log, leading) if objects is None else objects
    return objects.join(log.e2o, "object_id").select("pe_id", "event_id").distinct()


def seen(log: Log, pe_events: DataFrame) -> DataFrame:
    """``(pe_id, event_id, activity, ts, objects)``: the events of executions, each with all its relations."""
    return pe_events.join(log.packed(), "event_id").select("pe_id", "event_id", "activity", "ts", "objects")


def seen_by(log: Log, object_type: str) -> DataFrame:
    """``seen`` for the executions that are one object of a type each, without a join."""
    own = F.transform(F.filter("objects", lambda o: o["object_type"] == object_type), lambda o: o["object_id"])
    return log.packed().where("event_id is not null").select(F.explode(own).alias("pe_id"), "event_id", "activity", "ts", "objects")


def cases_by(log: Log, object_type: str) -> DataFrame:
    """``(pe_id, events)``: the executions of ``seen_by``, packed."""
    known = log.cases_of(object_type)
    return packed(seen_by(log, object_type)) if known is None else known.withColumn("events", F.filter("events", lambda e: F.size(e["objects"]) > 0)).where(F.size("events") > 0)


def packed(rows: DataFrame) -> DataFrame:
    """``(pe_id, events)`` of executions' events (``seen``), each execution in one row."""
    if "events" in rows.columns:
        return rows
    return rows.groupBy("pe_id").agg(F.collect_list(F.struct("event_id", "activity", "ts", "objects")).alias("events"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, not once for each element of an array."""
    return F.transform(F.array(value), use)[0]


def in_order(events: str = "events") -> Column:
    """Events of a packed execution as structs (ts, event_id, activity, objects), in time order, ties by event id."""
    return F.sort_array(F.transform(events, lambda e: F.struct(e["ts"].alias("ts"), e["event_id"].alias("event_id"), e["activity"].alias("activity"), e["objects"].alias("objects"))))


def _alike(events: Column) -> Column:
    key = lambda o: F.concat(F.coalesce(o["t"], F.lit("\x1e")), F.lit("\x1f"), F.coalesce(o["i"], F.lit("\x1e")))
    own = F.transform(events, lambda e: F.struct(e["activity"].alias("a"), F.sort_array(F.transform(e["objects"], lambda o: F.struct(o["object_type"].alias("t"), o["object_id"].alias("i")))).alias("o")))
    place = lambda keys, o: F.struct(F.coalesce(o["t"], F.lit("")).alias("t"), F.array_position(keys, key(o)).alias("k"), o["i"].isNull().alias("z"))
    return let(own, lambda es: let(
        F.array_distinct(F.flatten(F.transform(es, lambda e: F.transform(e["o"], key)))),
        lambda keys: F.to_json(F.transform(es, lambda e: F.struct(F.coalesce(e["a"], F.lit("")).alias("a"), F.transform(e["o"], lambda o: place(keys, o)).alias("o")))),
    ))


def shapes(cases: DataFrame, *more: Column) -> DataFrame:
    """``(pe_id, shape)`` of packed executions: the events in time order as JSON, objects as numbers in the order of their first event.

    Executions of the same course have equal shapes, so what needs no ids is worked out once for each shape.
    An event is ``{a: activity, o: [{t: type, k: number, z: whether the id is missing}]}``.
    """
    return cases.select("pe_id", let(in_order(), _alike).alias("shape"), *more)


def by_shape(rows: DataFrame, work: Callable[[str], tuple], schema: str | T.StructType) -> DataFrame:
    """Columns of ``work(shape)`` in place of ``shape``, worked out once for each shape that a task remembers."""
    own = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    others = T.StructType([f for f in rows.schema.fields if f.name != "shape"])
    kinds = to_arrow_schema(own)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            found = batch.column(batch.schema.get_field_index("shape")).dictionary_encode()
            out = []
            for text in found.dictionary.to_pylist():
                if text not in known:
                    if len(known) >= KNOWN_SHAPES:
                        known.clear()
                    known[text] = work(text)
                out.append(known[text])
            kept = [batch.column(f.name) for f in others]
            for i, field in enumerate(kinds):
                kept.append(pa.array([row[i] for row in out], field.type).take(found.indices))
            yield pa.RecordBatch.from_arrays(kept, names=[*others.names, *kinds.names])

    return rows.mapInArrow(kernel, T.StructType([*others.fields, *own.fields]))


def execution_objects(log: Log, pe_events: DataFrame) -> DataFrame:
    """``(pe_id, object_id, object_type)``: all objects of the executions' events."""
    return pe_events.join(log.e2o, "event_id").select("pe_id", "object_id", "object_type").distinct()


def execution_edges(log: Log, pe_events: DataFrame) -> DataFrame:
    """``(pe_id, src, dst, object_id, object_type)``: consecutive events of an object within an execution."""
    w = Window.partitionBy("pe_id", "object_id", "object_type").orderBy("ts", "event_id")
    timed = pe_events.join(log.timed(), "event_id")
    src = timed.select("pe_id", "object_id", "object_type", F.lag("event_id").over(w).alias("src"), F.col("event_id").alias("dst"))
    return src.where("src is not null").select("pe_id", "src", "dst", "object_id", "object_type")


def sizes(log: Log, pe_events: DataFrame) -> DataFrame:
    """Events and objects of every execution."""
    events = pe_events.groupBy("pe_id").agg(F.count_distinct("event_id").alias("n_events"))
    objects = execution_objects(log, pe_events).groupBy("pe_id").agg(F.count_distinct("object_id").alias("n_objects"))
    return events.join(objects, "pe_id", "left").select("pe_id", "n_events", F.coalesce("n_objects", F.lit(0)).alias("n_objects"))


def alone(object_type: str) -> Column:
    """Whether a case is a component by itself over objects of the type: no event has a second one, and none is listed twice."""
    own = F.transform("events", lambda e: F.filter(e["objects"], lambda o: o["object_type"] == object_type))
    ids = F.transform("events", lambda e: e["event_id"])
    return F.col("pe_id").isNotNull() & F.forall(own, lambda o: F.size(F.array_distinct(F.transform(o, lambda x: x["object_id"]))) == 1) & (F.size(F.array_distinct(ids)) == F.size(ids))


def worked(log: Log, object_type: str, work: Column) -> tuple[DataFrame, Log | None]:
    """A written table of ``work`` over the cases that are components by themselves, and the log of the others' events, if there are any.

    Both come from one pass over the cases.
    """
    each = log.cases_of(object_type).withColumn("own", alone(object_type))
    table = written(each.select(F.when(F.col("own"), work).alias("w"), F.when(~F.col("own"), F.transform("events", lambda e: e["event_id"])).alias("rest")), "cases")
    rest = table.where("rest is not null")
    done = table.where("w is not null").select("w")
    if rest.isEmpty():
        return done, None
    ids = written(rest.select(F.explode("rest").alias("event_id")).distinct(), "rest")
    left = lambda df: df.join(ids, "event_id", "left_semi")
    other = replace(log, events=left(log.events), e2o=left(log.e2o), cases=None)
    return done, replace(other, known=(other.events, other.e2o, left(log.packed())))


def correlated_orders(log: Log, object_type: str) -> DataFrame:
    """``correlated_graphs`` of a log with one object type: a case that is a component by itself is a path, which is its own reduction."""
    if log.cases_of(object_type) is None:
        return correlated_graphs(log)
    path = let(F.transform(in_order(), lambda e: e["event_id"]), lambda ids: F.struct(F.array_min(ids).alias("pe_id"), F.arrays_zip(F.slice(ids, 1, F.size(ids) - 1).alias("src"), F.slice(ids, 2, F.size(ids)).alias("dst")).alias("edges")))
    done, other = worked(log, object_type, path)
    found = done.select("w.pe_id", F.explode("w.edges").alias("e")).select("pe_id", "e.src", "e.dst")
    return found if other is None else found.unionByName(correlated_graphs(other))


def representatives(classes: DataFrame) -> DataFrame:
    """The smallest execution of every class of ``(pe_id, class_id)``."""
    return classes.groupBy("class_id").agg(F.min("pe_id").alias("pe_id"), F.count(F.lit(1)).alias("n"))


def correlated_graphs(log: Log) -> DataFrame:
    """``(pe_id, src, dst)``: the transitive reduction of each weakly connected event graph.

    An edge goes if a longer path joins its ends. Each graph is reduced by itself.
    """
    own = graph_executions(log)
    placed = event_graph(log).join(own.withColumnRenamed("event_id", "src"), "src")
    packed = placed.groupBy("pe_id").agg(F.to_json(F.collect_list(F.struct("src", "dst"))).alias("edges"))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pe_id, text in zip(batch["pe_id"], batch["edges"], strict=True):
                follow: dict[str, set[str]] = {}
                for e in json.loads(text):
                    follow.setdefault(e["src"], set()).add(e["dst"])
                for src, ends in follow.items():
                    longer, queue = set(), [x for d in ends for x in follow.get(d, ())]
                    while queue:
                        x = queue.pop()
                        if x not in longer:
                            longer.add(x)
                            queue += follow.get(x, ())
                    out += [(pe_id, src, d) for d in sorted(ends - longer)]
            yield pd.DataFrame(out, columns=["pe_id", "src", "dst"])

    return packed.mapInPandas(kernel, "pe_id string, src string, dst string")
