"""Constraint metrics on object traces, involvement of objects in events, and monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.model import Log
from braidlog.operators.petri import Net
from braidlog.operators.traces import follows

OPERATORS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b}


def activity_traces(log: Log, object_type: str) -> DataFrame:
    """``(object_id, acts)``: the activities of every object of a type in order; objects without events have none."""
    step = F.sort_array(F.collect_list(F.struct("ts", "event_id", "activity")))
    seen = log.timed().where(F.col("object_type") == object_type).groupBy("object_id").agg(F.transform(step, lambda s: s["activity"]).alias("acts"))
    objects = log.objects.where(F.col("object_type") == object_type).select("object_id").distinct()
    return objects.join(seen, "object_id", "left").select("object_id", F.coalesce("acts", F.array().cast("array<string>")).alias("acts"))


def trace_tests(a: str, b: str) -> dict[str, Column]:
    """Constraints between two activities by their first occurrences in ``acts``."""
    at_a, at_b = F.array_position("acts", a), F.array_position("acts", b)
    has_a, has_b = at_a > 0, at_b > 0
    first_next = F.get(F.col("acts"), at_a.cast("int"))
    return {
        "existence": has_a,
        "non_existence": ~has_a,
        "coexistence": has_a == has_b,
        "exclusiveness": ~(has_a & has_b),
        "choice": has_a | has_b,
        "xor_choice": has_a != has_b,
        "followed_by": ~has_a | (has_b & (at_a < at_b)),
        "directly_followed_by": ~has_a | F.coalesce(first_next == b, F.lit(False)),
        "precedence": ~has_b | (has_a & (at_a < at_b)),
        "block": ~(has_a & has_b) | (at_b < at_a),
    }


def trace_metrics(log: Log, object_type: str, a: str, b: str) -> DataFrame:
    """Number and share of the objects of a type that satisfy each constraint."""
    tests = trace_tests(a, b)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), t.alias("ok")) for k, t in tests.items()]))
    rows = activity_traces(log, object_type).select(each.alias("m")).select("m.metric", "m.ok")
    return rows.groupBy("metric").agg(F.sum(F.col("ok").cast("int")).alias("n_ok"), F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("share"))


def involvement(log: Log, object_type: str) -> DataFrame:
    """For each activity the shares of events without, with one, with several and with any objects of a type."""
    n = log.e2o.where(F.col("object_type") == object_type).groupBy("event_id").agg(F.count_distinct("object_id").alias("n"))
    counts = log.events.join(n, "event_id", "left").select("activity", F.coalesce("n", F.lit(0)).alias("n"))
    share = lambda test: F.avg(test.cast("double"))
    return counts.groupBy("activity").agg(
        F.count(F.lit(1)).alias("n_events"), share(F.col("n") == 0).alias("absence"), share(F.col("n") == 1).alias("singular"), share(F.col("n") > 1).alias("multiple"), share(F.col("n") > 0).alias("presence")
    )


def strengths(log: Log, object_type: str, a: str, b: str) -> DataFrame:
    """Causal, concurrency and choice strength of two activities on one type's traces.

    Causal: ``(ab - ba) / (ab + ba)``; concurrency: ``1 - |ab - ba| / (ab + ba)``, both 0
    without any succession; choice: ``1 - 2 both / (has a + has b)``.
    """
    edges = follows(log).where(F.col("object_type") == object_type)
    ab = F.sum(F.when((F.col("src_activity") == a) & (F.col("dst_activity") == b), 1).otherwise(0))
    ba = F.sum(F.when((F.col("src_activity") == b) & (F.col("dst_activity") == a), 1).otherwise(0))
    succession = edges.agg(F.coalesce(ab, F.lit(0)).alias("ab"), F.coalesce(ba, F.lit(0)).alias("ba"))
    has_a, has_b = F.array_contains("acts", a).cast("int"), F.array_contains("acts", b).cast("int")
    presence = activity_traces(log, object_type).agg(F.sum(has_a).alias("n_a"), F.sum(has_b).alias("n_b"), F.sum(has_a * has_b).alias("n_ab"))
    total = F.col("ab") + F.col("ba")
    return succession.join(F.broadcast(presence)).select(  # two one-row tables
        "ab", "ba", "n_a", "n_b", "n_ab",
        F.when(total > 0, (F.col("ab") - F.col("ba")) / total).otherwise(0.0).alias("causal"),
        F.when(total > 0, 1.0 - F.abs(F.col("ab") - F.col("ba")) / total).otherwise(0.0).alias("concurrency"),
        F.when(F.col("n_a") + F.col("n_b") > 0, 1.0 - 2.0 * F.col("n_ab") / (F.col("n_a") + F.col("n_b"))).otherwise(0.0).alias("choice"),
    )


def constraint_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """``(name, kind, object_type, source, target, operator, threshold)`` constraints."""
    return spark.createDataFrame(rows, "name string, kind string, object_type string, source string, target string, operator string, threshold double")


def monitor(metrics: DataFrame, constraints: DataFrame) -> DataFrame:
    """Evaluate constraints against a long table ``(kind, object_type, source, target, value)``.

    A constraint whose metric is unknown has a null value and is not violated.
    """
    keys = ["kind", "object_type", "source", "target"]
    joined = constraints.join(metrics, on=[constraints[k].eqNullSafe(metrics[k]) for k in keys], how="left").select(*[constraints[c] for c in constraints.columns], "value")
    held = F.lit(None).cast("boolean")
    for name, test in OPERATORS.items():
        held = F.when(F.col("operator") == name, test(F.col("value"), F.col("threshold"))).otherwise(held)
    return joined.withColumn("violated", F.coalesce(~held, F.lit(False)))


def metric_table(log: Log, object_type: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """All metrics of one type as ``(kind, object_type, source, target, value)``: what ``monitor`` compares.

    Trace constraints and strengths of every pair, and for every activity its involvement
    and mean times.
    """
    from braidlog.operators import performance

    row = lambda df, kind, source, target, value: df.select(kind.alias("kind"), F.lit(object_type).alias("object_type"), source.alias("source"), target.alias("target"), value.cast("double").alias("value"))
    none = F.lit(None).cast("string")
    parts = []
    for a, b in pairs:
        parts.append(row(trace_metrics(log, object_type, a, b), F.col("metric"), F.lit(a), F.lit(b), F.col("share")))
        own = strengths(log, object_type, a, b).select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in ("causal", "concurrency", "choice")])).alias("m"))
        parts.append(row(own, F.concat(F.lit("strength_"), F.col("m.k")), F.lit(a), F.lit(b), F.col("m.v")))
    kinds = ("absence", "singular", "multiple", "presence")
    own = involvement(log, object_type).select("activity", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in kinds])).alias("m"))
    parts.append(row(own, F.col("m.k"), F.col("activity"), none, F.col("m.v")))
    times = performance.event_times(log, object_type)
    kinds = ("flow", "sojourn", "synchronization", "pooling", "lagging", "readiness", "elapsed")
    own = times.groupBy("activity").agg(*[F.avg(k).alias(k) for k in kinds]).select("activity", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in kinds])).alias("m"))
    parts.append(row(own.where("m.v is not null"), F.col("m.k"), F.col("activity"), none, F.col("m.v")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def control_constraints(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """``(name, kind, source, target)`` constraints on sequences, for ``on_behaviour``."""
    return spark.createDataFrame(rows, "name string, kind string, source string, target string")


def on_behaviour(behaviour: DataFrame, constraints: DataFrame) -> DataFrame:
    """``(name, kind, source, target, detected)``: control-flow constraints against the ``(sequence, ...)`` of an enhanced net.

    Activities are compared by their first place in a sequence. ``causal``: every sequence has
    both, the source first; ``concur``: both orders occur; ``choice``: every sequence has
    exactly one of them; ``skip``: source and target are the same, and some sequences have it and some
    do not. Without any sequence, nothing is detected. Constraints are broadcast: they are
    written by hand. Each sequence is read once and only flags are aggregated.
    """
    at_a, at_b = F.array_position("sequence", F.col("source")), F.array_position("sequence", F.col("target"))
    both, first = (at_a > 0) & (at_b > 0), at_a < at_b
    tested = behaviour.select("sequence").join(F.broadcast(constraints))  # a list of constraints, not a table
    flags = tested.groupBy("name", "kind", "source", "target").agg(
        F.min(both & first).alias("always"),
        F.max(both & first).alias("before"),
        F.max(both & (at_a > at_b)).alias("after"),
        F.min((at_a > 0) != (at_b > 0)).alias("one"),
        F.max(at_a > 0).alias("some"),
        F.min(at_a > 0).alias("all"),
    )
    kind = lambda k: F.col("kind") == k
    held = (
        F.when(kind("causal"), F.col("always"))
        .when(kind("concur"), F.col("before") & F.col("after"))
        .when(kind("choice"), F.col("one"))
        .when(kind("skip"), (F.col("source") == F.col("target")) & F.col("some") & ~F.col("all"))
    )
    found = flags.select("name", held.alias("held"))
    return constraints.join(F.broadcast(found), "name", "left").select(*constraints.columns, F.coalesce("held", F.lit(False)).alias("detected"))


def on_net(net: Net, rows: list[tuple[str, str, str, str]]) -> list[tuple[str, bool]]:
    """``(name, detected)`` of ``(name, kind, object type, activity)`` constraints on a net's arcs.

    ``inc``: the activity takes objects of the type; ``exc``: it does not; ``var``: it takes any
    number of them. An activity without a transition takes none. Nets are small driver objects.
    """
    out = []
    for name, kind, object_type, activity in rows:
        labelled = {t.name for t in net.transitions.values() if t.label == activity}
        arcs = [a for a in net.arcs if a.target in labelled and net.places[a.source].object_type == object_type]
        if kind not in ("inc", "exc", "var"):
            raise ValueError(f"constraint kind {kind!r} is none of inc, exc, var")
        out.append((name, {"inc": bool(arcs), "exc": not arcs, "var": any(a.variable for a in arcs)}[kind]))
    return out
