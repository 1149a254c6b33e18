"""From a log to a result bundle: detect resources, restructure, extract, abstract, mine, score, explain."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.functions.runtime import written
from braidlog.model import Log
from braidlog.operators import abstraction, executions, hierarchy, kpi, mining, relations, restructure, tree
from braidlog.operators.explorer import Bundle
from braidlog.operators.hierarchy import relabel
from braidlog.operators.traces import seconds

STAGES = "stage string, seconds double"


def prepare(log: Log, leading: str, threshold: float = 0.9, removed: list[str] | None = None) -> Log:
    """Absorb the resource types (or the given ones) into attributes; the leading type always stays."""
    if removed is None:
        removed = [t for t in relations.resource_types(log, threshold)[1] if t != leading]
    return restructure.absorb(log, removed)


def courses(log: Log, leading: str) -> DataFrame | None:
    """A written table ``(pe_id, course, attrs, <key figures>)`` of ``leading_executions`` if each is one object and the source knows its events.

    ``course`` has the activities in time order as JSON, ``attrs`` the attributes of each row of the object.
    """
    if log.cases_of(leading) is None or not log.objects.where(F.col("object_type") != leading).isEmpty():
        return None
    cases = executions.cases_by(log, leading).where("pe_id is not null")
    each = lambda field: F.transform("events", lambda e: e[field])
    same = lambda o: o["object_id"].eqNullSafe(F.col("pe_id")) & o["object_type"].eqNullSafe(leading)
    own = F.forall("events", lambda e: F.forall(e["objects"], same))
    course = F.to_json(F.transform(executions.in_order(), lambda e: F.coalesce(e["activity"], F.lit(""))))
    count = lambda field: F.size(F.array_distinct(F.array_compact(each(field)))).cast("long")
    last, first = F.unix_micros(F.array_max(each("ts"))), F.unix_micros(F.array_min(each("ts")))
    rows = cases.select("pe_id", course.alias("course"), own.alias("own"), seconds(last - first).alias("duration"), count("event_id").alias("n_events"), count("activity").alias("n_activities"), F.lit(1).cast("long").alias("n_objects"))
    listed = log.objects.where(F.col("object_type") == leading).groupBy(F.col("object_id").alias("pe_id")).agg(F.collect_list("attrs").alias("attrs"))
    density = F.when(F.col("duration") > 0, F.col("n_events") / F.col("duration")).otherwise(0.0)
    found = written(rows.join(listed, "pe_id").withColumn("event_density", density), "courses")
    return found.drop("own") if found.where("not own").isEmpty() else None


def course_graphs(table: DataFrame, lattice: hierarchy.Lattice, config: hierarchy.Config) -> DataFrame:
    """Written graphs of ``courses`` under a configuration of their type."""
    h, level = lattice.hierarchies[0], config[0]
    if level == 0:
        labels = F.array("pe_id")
    elif level == h.top:
        labels = F.array(F.lit(h.object_type))
    else:
        name = h.names[level - 1]
        labels = F.array_distinct(F.transform("attrs", lambda a: F.coalesce(F.try_element_at(a, F.lit(name)), F.concat(F.lit(f"?{name}="), F.col("pe_id")))))
    return written(abstraction.of_courses(table.select("pe_id", "course", F.sort_array(labels).alias("labels"))), "graphs")


def distinct_executions(log: Log, pe_events: DataFrame, lattice: hierarchy.Lattice) -> DataFrame:
    """One execution of every class that is isomorphic at the finest level."""
    graphs = written(abstraction.behaviour(log, pe_events, relabel(log, lattice, lattice.bottom)), "bottom")
    keep = executions.representatives(abstraction.classes(graphs)).select("pe_id")
    return written(pe_events.join(keep, "pe_id", "left_semi"), "distinct")


def run(
    log: Log, leading: str, types: list[str], figures: list[str] = ("duration",), min_support: float = 0.05, max_support: float = 0.8, max_edges: int = 4, max_depth: int = 3, min_leaf: int = 20
) -> tuple[Bundle, DataFrame]:
    """The result bundle over the lattice of ``types`` and a table of stage times.

    Configurations are explored from the top down; the interesting ones are mined, their
    patterns scored, subsumed ones dropped and each figure explained by a tree. Executions of
    a class have the same patterns, so one graph of each class is mined, and its executions count by their number and sums.
    """
    spark: SparkSession = log.spark
    times: list[tuple[str, float]] = []
    clock = time.perf_counter()

    def lap(name: str) -> None:
        nonlocal clock
        now = time.perf_counter()
        times.append((name, now - clock))
        clock = now

    table = courses(log, leading) if types == [leading] else None
    pe = written(executions.leading_executions(log, leading), "executions") if table is None else table
    lap("extraction")
    lattice = hierarchy.Lattice(hierarchy.build(log, types))
    lap("hierarchies")
    graphs_of = None
    if table is None:
        pe = distinct_executions(log, pe, lattice)
        values = written(kpi.long(kpi.builtin(log, pe), list(figures)), "figures")
        n = pe.select("pe_id").distinct().count()
    else:
        finest = course_graphs(table, lattice, lattice.bottom)
        n, every = finest.agg(F.count_distinct("form"), F.count(F.lit(1))).first()
        if n < every:
            keep = written(executions.representatives(abstraction.class_of(finest).withColumnRenamed("form", "class_id")).select("pe_id"), "distinct")
            finest, pe = (written(df.join(keep, "pe_id", "left_semi"), "distinct") for df in (finest, table))
        graphs_of = lambda config: finest if config == lattice.bottom else course_graphs(pe, lattice, config)
        values = kpi.long(pe, list(figures))
    low, high = mining.support_window(n, min_support, max_support)
    lap("figures")
    found = abstraction.explore(log, pe, lattice, graphs_of)
    lap("abstraction")
    ids = {row["config"]: i for i, row in enumerate(found)}
    configs = spark.createDataFrame(
        [(i, r["text"], r["height"], r.get("n_classes"), r.get("n_executions"), r["reason"]) for i, r in enumerate(found)], "config_id int, text string, height int, n_classes long, n_executions long, reason string"
    )
    covers = spark.createDataFrame([(ids[c], ids[f]) for c in ids for f in lattice.below(c)], "config_id int, finer_id int")
    hits = patterns = contrast = classes = members = None
    add = lambda old, new: new if old is None else old.unionByName(new)
    for i, row in enumerate(found):
        if row["reason"] is not None:
            continue
        # Of kinds, pe_id is the digest of a class; of its executions, form is.
        kinds, form = written(abstraction.kinds(row["graphs"]), "kinds"), abstraction.class_of(row["graphs"])
        all_hits = written(mining.pattern_hits(kinds.withColumn("pe_id", F.hex("pe_id")), max_edges, low).withColumn("pe_id", F.unhex("pe_id")), "hits")
        window = mining.frequent_patterns(all_hits, low, high, kinds.select("pe_id", "n")).select("signature")
        kept = mining.subsumed(mining.hit_sets(all_hits.join(window, "signature", "left_semi").withColumn("pe_id", F.hex("pe_id")))).where("kept").select("signature")
        own = written(all_hits.join(kept, "signature", "left_semi"), "hits")
        tag = F.lit(i).alias("config_id")
        hits = add(hits, own.select(F.col("pe_id").alias("form"), "signature").join(form, "form").select(tag, F.col("signature").alias("pattern_id"), "pe_id"))
        patterns = add(patterns, own.select(tag, F.col("signature").alias("pattern_id"), "n_nodes", "n_edges").distinct())
        valued = form.join(values, "pe_id").groupBy("form", "kpi")
        sums = written(valued.agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.min("value").alias("low"), F.max("value").alias("high")).withColumnRenamed("form", "pe_id"), "sums")
        contrast = add(contrast, kpi.contrast_sums(sums.select("pe_id", "kpi", "n", "s"), own.select(F.col("signature").alias("pattern_id"), "pe_id")).select(tag, "*"))
        classes = add(classes, abstraction.classes(row["graphs"]).select(tag, "pe_id", "class_id"))
        features = own.groupBy("pe_id").agg(F.sort_array(F.collect_set("signature")).alias("features"))
        for figure in figures:
            rows = sums.where((F.col("kpi") == figure) & (F.col("n") > 0)).join(features, "pe_id", "left").withColumn("features", F.coalesce("features", F.array().cast("array<string>")))
            rows = written(rows, "tree")
            status, root = tree.grow(rows, max_depth, min_leaf)
            if root is not None:
                labels = F.create_map(*[x for k, leaf in enumerate(root.leaves()) for x in (F.lit(k), F.lit(leaf.label()))])
                placed = tree.leaf_of(rows, root).select(F.col("pe_id").alias("form"), "leaf").join(form, "form")
                placed = placed.join(values.where((F.col("kpi") == figure) & F.col("value").isNotNull()).select("pe_id"), "pe_id", "left_semi")
                members = add(members, placed.select(tag, F.lit(figure).alias("kpi"), "leaf", labels[F.col("leaf")].alias("label"), "pe_id"))
    lap("mining")
    none = lambda schema: spark.createDataFrame([], schema)
    bundle = Bundle(
        configs,
        hits if hits is not None else none("config_id int, pattern_id string, pe_id string"),
        patterns if patterns is not None else none("config_id int, pattern_id string, n_nodes int, n_edges int"),
        values,
        contrast if contrast is not None else none("config_id int, pattern_id string, kpi string, support long, mu_in double, mu_out double, delta double, abs_delta double"),
        classes if classes is not None else none("config_id int, pe_id string, class_id string"),
        covers,
        members if members is not None else none("config_id int, kpi string, leaf int, label string, pe_id string"),
    )
    return bundle, spark.createDataFrame(times, STAGES)
