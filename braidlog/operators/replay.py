"""Token replay of object traces on a net, and context-based precision and fitness."""

from __future__ import annotations

import json
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlog.model import Log
from braidlog.operators.executions import by_shape, seen, shapes
from braidlog.operators.petri import Arc, Net, Transition
from braidlog.operators.traces import traces

#: States a search over silent transitions visits at most.
MOST_STATES = 70_000
REPLAY = "object_type string, variant string, missing int, consumed int, remaining int, produced int, fit boolean"


def silent_path(net: Net, marking: Counter, target: str) -> list[str] | None:
    """Shortest run of silent transitions that enables a transition."""
    silent = [t for t, x in net.transitions.items() if x.label is None]
    queue, seen = deque([(marking, [])]), {frozenset(marking.items())}
    while queue and len(seen) < MOST_STATES:
        now, path = queue.popleft()
        if net.enabled(now, target):
            return path
        for t in silent:
            if net.enabled(now, t):
                nxt = net.fire(now, t)
                key = frozenset(nxt.items())
                if key not in seen:
                    seen.add(key)
                    queue.append((nxt, [*path, t]))
    return None


def replay_trace(net: Net, acts: list[str]) -> tuple[int, int, int, int, list[tuple[int, str]]]:
    """Missing, consumed, remaining, produced, and (step, place) of every token a visible transition consumed.

    Missing tokens are inserted and counted; activities without transition are skipped.
    """
    initial = [p for p, x in net.places.items() if x.initial]
    final = [p for p, x in net.places.items() if x.final]
    marking, missing, consumed, produced = Counter(initial), 0, 0, len(initial)
    visits = []

    def fire(t: str) -> None:
        nonlocal marking, consumed, produced
        consumed += len(net.pre(t))
        produced += len(net.post(t))
        marking = net.fire(marking, t)

    for i, act in enumerate(acts):
        if act not in net.transitions:
            continue
        if not net.enabled(marking, act):
            for t in silent_path(net, marking, act) or []:
                fire(t)
        for p in net.pre(act):
            if marking[p] < 1:
                marking[p] += 1
                missing += 1
        visits += [(i, p) for p in sorted(net.pre(act))]
        fire(act)
    goal = Net(net.places, net.transitions | {"__end": Transition("__end", "__end")}, net.arcs | {Arc(p, "__end") for p in final})
    if final and net.arcs and not all(marking[p] for p in final):
        for t in silent_path(goal, marking, "__end") or []:
            fire(t)
    for p in final:
        consumed += 1
        if marking[p] < 1:
            missing += 1
        else:
            marking[p] -= 1
    return missing, consumed, sum((+marking).values()), produced, visits


def fitness(log: Log, net: Net) -> DataFrame:
    """Replay of every different trace, with how many objects have it: each activity sequence is replayed once."""
    acts = F.array_join(F.transform("trace", lambda s: s["activity"]), "\x1f")
    variants = traces(log.on_types(net.object_types())).select("object_type", acts.alias("variant")).groupBy("object_type", "variant").agg(F.count(F.lit(1)).alias("n"))
    nets = {t: net.on_types([t]) for t in net.object_types()}

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for kind, variant in zip(batch["object_type"], batch["variant"], strict=True):
                if kind in nets:
                    m, c, r, p, _ = replay_trace(nets[kind], variant.split("\x1f"))
                    out.append((kind, variant, m, c, r, p, m == 0 and r == 0))
            yield pd.DataFrame(out, columns=["object_type", "variant", "missing", "consumed", "remaining", "produced", "fit"])

    replayed = variants.select("object_type", "variant").mapInPandas(kernel, REPLAY)
    value = 0.5 * (1 - F.col("missing") / F.col("consumed")) + 0.5 * (1 - F.col("remaining") / F.col("produced"))
    return variants.join(replayed, ["object_type", "variant"]).withColumn("fitness", value)


def token_visits(log: Log, net: Net) -> DataFrame:
    """``(event_id, object_id, object_type, place, arrived, left)``: a token's stay from the object's event before (or this one) to this one."""
    nets = {t: net.on_types([t]) for t in net.object_types()}
    rows = traces(log.on_types(net.object_types())).select("object_type", "object_id", F.transform("trace", lambda s: s["event_id"]).alias("ids"), F.transform("trace", lambda s: s["activity"]).alias("acts"), F.transform("trace", lambda s: F.unix_micros(s["ts"])).alias("times"))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            known: dict[tuple, list] = {}
            for kind, obj, ids, acts, times in batch.itertuples(index=False):
                if kind not in nets:
                    continue
                key = (kind, *acts)
                if key not in known:
                    known[key] = replay_trace(nets[kind], list(acts))[4]
                out += [(ids[i], obj, kind, place, times[max(0, i - 1)], times[i]) for i, place in known[key]]
            yield pd.DataFrame(out, columns=["event_id", "object_id", "object_type", "place", "a", "b"])

    visits = rows.mapInPandas(kernel, "event_id string, object_id string, object_type string, place string, a long, b long")
    return visits.select("event_id", "object_id", "object_type", "place", F.timestamp_micros("a").alias("arrived"), F.timestamp_micros("b").alias("left"))


CONTEXT = "array<struct<object_type:string,activities:array<string>>>"


def contexts(log: Log, pe_events: DataFrame) -> DataFrame:
    """``(pe_id, event_id, context)``: see ``found_contexts``."""
    return found_contexts(seen(log, pe_events)).select("pe_id", "event_id", F.from_json("context", CONTEXT).alias("context"))


def found_contexts(rows: DataFrame) -> DataFrame:
    """``(pe_id, event_id, activity, context)`` of executions' events with their objects (``executions.seen``).

    The context, as JSON, is a sorted multiset of the prefixes of all objects of an event and its ancestors.

    An object's prefix holds its activities among the event's ancestors in the execution's
    graph. Those are always the object's first events, so an event carries how many of each
    object's came before it: the largest numbers of its direct predecessors, and those
    themselves. Each execution is worked on by itself; ties in time are broken by event id.
    """
    own = F.sort_array(F.array_distinct(F.transform("objects", lambda o: F.struct(o["object_type"], o["object_id"])))).alias("objects")
    events = rows.where(F.size("objects") > 0).select("pe_id", "ts", "event_id", "activity", own)
    packed = events.groupBy("pe_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("ts", "event_id", "activity", "objects")))).alias("events"))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pe_id, text in zip(batch["pe_id"], batch["events"], strict=True):
                events = json.loads(text)
                found = contexts_of([(e["activity"], [(o["object_type"], o["object_id"]) for o in e["objects"]]) for e in events])
                out += [(pe_id, e["event_id"], e["activity"], context) for e, context in zip(events, found, strict=True)]
            yield pd.DataFrame(out, columns=["pe_id", "event_id", "activity", "context"])

    return packed.mapInPandas(kernel, f"pe_id {rows.schema['pe_id'].dataType.simpleString()}, event_id string, activity string, context string")


def contexts_of(events: list[tuple[str, list[tuple]]]) -> list[str]:
    """The context of each event, given in time order as activity and different objects."""
    out = []
    acts: dict[tuple, list[str]] = {}
    last: dict[tuple, dict] = {}  # what an object's next event has before it
    for activity, objects in events:
        before: dict[tuple, int] = {}
        for o in objects:
            for other, n in last.get(o, {}).items():
                before[other] = max(n, before.get(other, 0))
        context = sorted((key[0], acts[key][: before[key]]) if key in before else (key[0], []) for key in {*before, *objects})
        out.append(json.dumps([{"object_type": kind, "activities": prefix} for kind, prefix in context]))
        for o in objects:
            acts.setdefault(o, []).append(activity)
        after = before | {o: len(acts[o]) for o in objects}
        last |= dict.fromkeys(objects, after)
    return out


def _contexts(shape: str) -> tuple[list[dict]]:
    events = [(e["a"], sorted({(o["t"], o["k"]) for o in e["o"]})) for e in json.loads(shape) if e["o"]]
    return ([{"context": context, "activity": activity} for (activity, _), context in zip(events, contexts_of(events), strict=True)],)


def enabled_by_model(net: Net, prefixes: list[tuple[str, list[str]]]) -> set[str]:
    """Activities some silent run enables for all of their types, after the objects' prefixes were replayed."""
    per_type: dict[str, list[set[str]]] = {}
    for kind, acts in prefixes:
        own = net.on_types([kind])
        marking = Counter(p for p, x in own.places.items() if x.initial)
        for act in acts:
            if act in own.transitions:
                for t in silent_path(own, marking, act) or []:
                    marking = own.fire(marking, t)
                for p in own.pre(act):
                    marking[p] = max(1, marking[p])
                marking = own.fire(marking, act)
        able = {t for t, x in own.transitions.items() if x.label and silent_path(own, marking, t) is not None}
        per_type.setdefault(kind, []).append(able)
    out = set()
    for t, x in net.transitions.items():
        kinds = {net.places[p].object_type for p in net.pre(t)}
        if x.label and kinds and all(any(t in able for able in per_type.get(k, [])) for k in kinds if k in per_type) and kinds & set(per_type):
            out.add(x.label)
    return out


def precision_fitness(log: Log, net: Net, pe_events: DataFrame) -> DataFrame:
    """One row: precision, fitness and events skipped, by contexts; see ``found_fitness``."""
    return found_fitness(seen(log, pe_events), net)


def found_fitness(rows: DataFrame, net: Net) -> DataFrame:
    """One row: precision, fitness and events skipped, by contexts.

    The log enables in a context what follows it anywhere. An event is skipped if the model
    enables nothing there or nothing in common. Precision is the mean of common / model
    over the others, fitness the mean of common / log over all, skipped ones counting 0.
    """
    if "events" in rows.columns:  # packed executions: contexts once for each shape
        alike = shapes(rows).groupBy("shape").agg(F.count(F.lit(1)).alias("n"))
        each = by_shape(alike, _contexts, "found array<struct<context:string,activity:string>>").select("n", F.explode("found").alias("f"))
        steps = each.groupBy("f.context", "f.activity").agg(F.sum("n").alias("n"))
    else:
        steps = found_contexts(rows).groupBy("context", "activity").agg(F.count(F.lit(1)).alias("n"))  # few, before they meet
    per = steps.groupBy("context").agg(F.sort_array(F.collect_set("activity")).alias("in_log"), F.sum("n").alias("n"))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for context, in_log, n in batch.itertuples(index=False):
                model = enabled_by_model(net, [(c["object_type"], c["activities"]) for c in json.loads(context)])
                out.append((n, len(set(in_log)), len(model), len(model & set(in_log))))
            yield pd.DataFrame(out, columns=["n", "n_log", "n_model", "n_both"])

    rows = per.mapInPandas(kernel, "n long, n_log long, n_model long, n_both long")  # a row for each context
    used = F.when(F.col("n_both") > 0, F.col("n")).otherwise(0)
    zero = F.lit(0.0)
    return rows.agg(
        F.coalesce(F.sum(used * F.col("n_both") / F.greatest("n_model", F.lit(1))) / F.nullif(F.sum(used), F.lit(0)), zero).alias("precision"),
        F.coalesce(F.sum(used * F.col("n_both") / F.col("n_log")) / F.sum("n"), zero).alias("fitness"),
        F.coalesce(F.sum(F.col("n") - used), F.lit(0)).alias("n_skipped"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_events"),
    )


def enhanced(log: Log, net: Net, pe_events: DataFrame) -> tuple[Net, DataFrame, DataFrame]:
    """A net with its behaviour and diagnostics.

    Behaviour is ``(sequence, n)``: every different activity sequence of an execution in time
    order (ties by event id), and how many executions have it. Diagnostics are those of ``fitness``.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "activity"))), lambda e: e["activity"])
    runs = pe_events.join(log.events.select("event_id", "activity", "ts"), "event_id").groupBy("pe_id").agg(ordered.alias("sequence"))
    return net, runs.groupBy("sequence").agg(F.count(F.lit(1)).alias("n")), fitness(log, net)
