"""Variants: executions whose projected graphs are isomorphic, and their chevron layout."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlog.functions.graphs import canonical
from braidlog.model import Log
from braidlog.operators.executions import by_shape, execution_edges, execution_objects, in_order, let, packed, shapes


def projected(log: Log, pe_events: DataFrame, pe_objects: DataFrame | None = None) -> DataFrame:
    """``(pe_id, nodes, edges)`` as JSON: activities with the types of the execution's objects, edges with the shared types.

    Only types enter, one entry for each object; events without an execution object go.
    """
    own = execution_objects(log, pe_events) if pe_objects is None else pe_objects
    rel = pe_events.join(log.e2o, "event_id").join(own.select("pe_id", "object_id"), ["pe_id", "object_id"], "left_semi")
    types = rel.groupBy("pe_id", "event_id").agg(F.array_join(F.sort_array(F.collect_list("object_type")), ": ").alias("types"))
    named = types.join(log.events.select("event_id", "activity"), "event_id").select("pe_id", "event_id", F.concat("activity", F.lit(": "), "types").alias("node"))
    nodes = named.groupBy("pe_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("event_id", "node")))).alias("nodes"))
    links = execution_edges(log, pe_events).join(own.select("pe_id", "object_id"), ["pe_id", "object_id"], "left_semi")
    links = links.groupBy("pe_id", "src", "dst").agg(F.array_join(F.sort_array(F.collect_list("object_type")), ": ").alias("label"))
    edges = links.groupBy("pe_id").agg(F.to_json(F.collect_list(F.struct("src", "dst", "label"))).alias("edges"))
    return nodes.join(edges, "pe_id", "left")


def _edges(events: list[dict]) -> dict[tuple[int, int], list[str]]:
    """Types of the objects by which events, given in time order, follow each other."""
    last: dict[tuple[str, str], int] = {}
    out: dict[tuple[int, int], list[str]] = {}
    for i, e in enumerate(events):
        for o in e["objects"]:
            key = o["object_type"], o["object_id"]
            if key in last:
                out.setdefault((last[key], i), []).append(o["object_type"])
            last[key] = i
    return out


def _events(shape: str) -> list[dict]:
    """Events of a shape (``executions.shapes``) that have objects with an id, as ``_edges`` takes them."""
    objects = lambda e: [{"object_type": o["t"], "object_id": o["k"]} for o in e["o"] if not o["z"]]
    return [{"activity": e["a"], "objects": own} for e in json.loads(shape) if (own := objects(e))]


def _variant(shape: str) -> tuple[str]:
    events = _events(shape)
    nodes = [e["activity"] + ": " + ": ".join(sorted(o["object_type"] for o in e["objects"])) for e in events]
    form = canonical(nodes, tuple((s, t, ": ".join(sorted(kinds))) for (s, t), kinds in sorted(_edges(events).items())))
    return (hashlib.sha256(form.encode()).hexdigest(),)


def seen_variants(rows: DataFrame) -> DataFrame:
    """``variants`` of executions' events with all their objects (``executions.seen``), or of packed executions: one canonical form for each shape."""
    named = F.exists("events", lambda e: F.exists(e["objects"], lambda o: o["object_id"].isNotNull()))
    return by_shape(shapes(packed(rows).where(named)), _variant, "variant string")


def variants(log: Log, pe_events: DataFrame, pe_objects: DataFrame | None = None) -> DataFrame:
    """``(pe_id, variant)``; the variant is a hash of the canonical form, so classes are exact."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            forms = []
            for nodes_json, edges_json in zip(batch["nodes"], batch["edges"], strict=True):
                nodes = json.loads(nodes_json)
                at = {r["event_id"]: i for i, r in enumerate(nodes)}
                forms.append(canonical([r["node"] for r in nodes], [(at[e["src"]], at[e["dst"]], e["label"]) for e in json.loads(edges_json or "[]")]))
            yield pd.DataFrame({"pe_id": batch["pe_id"], "form": forms})

    forms = projected(log, pe_events, pe_objects).mapInPandas(kernel, "pe_id string, form string")
    return forms.select("pe_id", F.sha2("form", 256).alias("variant"))


def frequencies(table: DataFrame) -> DataFrame:
    """Variants by share of executions, most frequent first, with an example."""
    n = table.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.min("pe_id").alias("example"))
    total = table.agg(F.count(F.lit(1)).alias("total"))
    return n.join(F.broadcast(total)).select("variant", "n", "example", (F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("n"), "example")  # one row


def events_of_variants(table: DataFrame, pe_events: DataFrame) -> DataFrame:
    """The variants each event belongs to."""
    return pe_events.join(table, "pe_id").groupBy("event_id").agg(F.sort_array(F.collect_set("variant")).alias("variants"))


def _columns(shape: str) -> tuple[list[int], list[int]]:
    """Column and end of each event of a shape."""
    events = json.loads(shape)
    follow: dict[int, list[int]] = {}
    for s, t in _edges([{"objects": [{"object_type": o["t"], "object_id": o["k"]} for o in e["o"]]} for e in events]):
        follow.setdefault(s, []).append(t)
    x = [0] * len(events)
    for s in range(len(events)):  # time order is a topological order
        for t in follow.get(s, ()):
            x[t] = max(x[t], x[s] + 1)
    last = max(x, default=0)
    return x, [max(min((x[t] - 1 for t in follow.get(i, ())), default=last), x[i]) for i in range(len(events))]


def seen_layout(rows: DataFrame) -> DataFrame:
    """``layout`` of executions' events with all their objects (``executions.seen``), or of packed executions: columns once for each shape.

    Objects without an id, and events without others, do not count. A lane is an object's place by type and id.
    """
    own = lambda e: F.filter(e["objects"], lambda o: o["object_id"].isNotNull())
    events = F.filter(F.transform("events", lambda e: e.withField("objects", own(e))), lambda e: F.size(e["objects"]) > 0)
    cases = packed(rows).withColumn("events", events).where(F.size("events") > 0)

    def placed(found: Column) -> Column:
        each = lambda e: F.sort_array(F.transform(e["objects"], lambda o: F.struct(o["object_type"].alias("t"), o["object_id"].alias("i"))))
        ids = F.transform(F.sort_array(F.array_distinct(F.flatten(F.transform(found, each)))), lambda o: o["i"])
        # An id of two types has the lane of the last: looked for from the end.
        at = lambda keys, o: (F.size(keys) - F.array_position(keys, o["i"])).cast("int")
        return let(F.reverse(ids), lambda keys: F.transform(found, lambda e: F.struct(e["event_id"].alias("event_id"), e["activity"].alias("activity"), F.transform(each(e), lambda o: at(keys, o)).alias("lanes"))))

    table = by_shape(shapes(cases, let(in_order(), placed).alias("placed")), _columns, "x array<int>, x_end array<int>")
    flat = table.select("pe_id", F.explode(F.arrays_zip("placed", "x", "x_end")).alias("e"))
    return flat.select("pe_id", "e.placed.event_id", "e.placed.activity", "e.x", "e.x_end", "e.placed.lanes")


def layout(log: Log, pe_events: DataFrame) -> DataFrame:
    """``(pe_id, event_id, activity, x, x_end, lanes)``: column by longest path, end before the next event, a lane for each object."""
    own = pe_events.join(log.e2o, "event_id").groupBy("pe_id", "event_id").agg(F.sort_array(F.collect_list(F.struct("object_type", "object_id"))).alias("objects"))
    nodes = own.join(log.events.select("event_id", "activity", "ts"), "event_id").groupBy("pe_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("ts", "event_id", "activity", "objects")))).alias("nodes"))
    edges = execution_edges(log, pe_events).select("pe_id", "src", "dst").distinct().groupBy("pe_id").agg(F.to_json(F.collect_list(F.struct("src", "dst"))).alias("edges"))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pe_id, nodes_json, edges_json in batch[["pe_id", "nodes", "edges"]].itertuples(index=False):
                rows = json.loads(nodes_json)
                follow: dict[str, list[str]] = {}
                for e in json.loads(edges_json or "[]"):
                    follow.setdefault(e["src"], []).append(e["dst"])
                x = {r["event_id"]: 0 for r in rows}
                for r in rows:  # time order is a topological order
                    for d in follow.get(r["event_id"], []):
                        x[d] = max(x[d], x[r["event_id"]] + 1)
                lanes: dict[str, int] = {}
                for o in sorted({(o["object_type"], o["object_id"]) for r in rows for o in r["objects"]}):
                    lanes[o[1]] = len(lanes)
                last = max(x.values(), default=0)
                for r in rows:
                    end = min((x[d] - 1 for d in follow.get(r["event_id"], [])), default=last)
                    out.append((pe_id, r["event_id"], r["activity"], x[r["event_id"]], max(end, x[r["event_id"]]), [lanes[o["object_id"]] for o in r["objects"]]))
            yield pd.DataFrame(out, columns=["pe_id", "event_id", "activity", "x", "x_end", "lanes"])

    return nodes.join(edges, "pe_id", "left").mapInPandas(kernel, "pe_id string, event_id string, activity string, x int, x_end int, lanes array<int>")
