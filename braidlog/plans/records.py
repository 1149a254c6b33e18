"""Queries over accessors, sinks and monitoring: what a log holds, what is written and read back, what a net's behaviour shows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.model import CHANGES
from braidlog.operators import attributes, constraints, explorer, filters, kpi, mining, petri, relations, replay, restructure, traces
from braidlog.plans.catalog import HITS_SQL, KPI_SQL, A, B, query, quick_pairs, user_executions
from braidlog.plans.formats import TYPES, folder_for, relations_folder
from braidlog.sources import documents, reports
from braidlog.sources.tables import commerce_log, stream_log
from braidlog.streaming import incremental

# --- what a log holds ----------------------------------------------------------------------


@query(
    "log_summary",
    f"""WITH {B} SELECT 'event' AS part, activity AS name, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM ev GROUP BY 2
    UNION ALL SELECT 'object', object_type, count(*), count(DISTINCT object_id) FROM obj GROUP BY 2
    UNION ALL SELECT 'e2o', object_type, count(*), count(DISTINCT object_id) FROM (SELECT DISTINCT * FROM e2o) GROUP BY 2
    UNION ALL SELECT 'o2o', 'contains', count(*), count(DISTINCT l_orderkey) FROM li HAVING count(*) > 0""",
)
def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.summary(commerce_log(spark, sf_dir))


@query("wide_table", f"WITH {B} SELECT ev.event_id, activity, us, " + ", ".join(f"coalesce(string_agg(DISTINCT object_id, '|' ORDER BY object_id) FILTER (object_type = '{t}'), '') AS {t}" for t in TYPES) + " FROM ev LEFT JOIN e2o ON e2o.event_id = ev.event_id GROUP BY 1, 2, 3")
def wide_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = commerce_log(spark, sf_dir).wide(TYPES)
    return wide.select("event_id", "activity", traces.micros("ts").alias("us"), *[F.array_join(t, "|").alias(t) for t in TYPES])


@query("safe_names", "SELECT DISTINCT p_type AS name, regexp_replace(trim(p_type), '[^0-9A-Za-z_]+', '_', 'g') AS safe FROM part")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = commerce_log(spark, sf_dir).objects.where("object_type = 'part'").select(F.element_at("attrs", "type").alias("name")).distinct()
    return kinds.select("name", filters.safe_name(F.col("name")).alias("safe"))


def _changing(spark: SparkSession, sf_dir: str):
    """The stream log with every event's value and activity as changes of its key."""
    log = stream_log(spark, sf_dir)
    each = F.explode(F.array(F.struct(F.lit("value").alias("field"), F.element_at("attrs", "value").alias("value")), F.struct(F.lit("activity").alias("field"), F.col("activity").alias("value"))))
    keys = log.e2o.where("object_type = 'key'").join(log.events, "event_id")
    return replace(log, object_changes=keys.select("object_id", "object_type", "ts", each.alias("c")).select("object_id", "object_type", "ts", "c.field", "c.value"))


@query(
    "attribute_over_time",
    f"""WITH {A}, c AS (SELECT object_id, us, ev.activity, value, max({{'us': us, 'a': ev.activity}}) OVER (PARTITION BY object_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM e2o JOIN ev USING (event_id) WHERE object_type = 'key')
    SELECT held.a AS kind, us, count(*) AS n, round(avg(CAST(value AS DOUBLE)), 6) AS mean FROM c WHERE value IS NOT NULL GROUP BY 1, 2""",
)
def attribute_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = attributes.over_time(_changing(spark, sf_dir), "key", "value", "activity")
    return found.select(F.col("group").alias("kind"), traces.micros("ts").alias("us"), "n", F.round("mean", 6).alias("mean"))


@query("change_table", f"WITH {A} SELECT object_id, 'value' AS field, us, CAST(value AS DOUBLE) AS value FROM e2o JOIN ev USING (event_id) WHERE object_type = 'key'")
def change_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that are written with the log and read back."""
    log, path = _changing(spark, sf_dir), folder_for(spark, "changes")
    log.object_changes.where("field = 'value'").write.parquet(path)
    return spark.read.schema(CHANGES).parquet(path).select("object_id", "field", traces.micros("ts").alias("us"), F.col("value").cast("double").alias("value"))


# --- sinks ---------------------------------------------------------------------------------


@query("graph_text", f"WITH {A} SELECT DISTINCT object_id AS pe_id, src_activity AS source, dst_activity AS target, 'user' AS label FROM fol WHERE object_type = 'user'")
def graph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' graphs of activities, written in the line format of graph miners and read back."""
    edges = traces.follows(stream_log(spark, sf_dir)).where("object_type = 'user'").select(F.col("object_id").alias("pe_id"), "src_activity", "dst_activity", F.lit("user").alias("label"))
    packed = edges.groupBy("pe_id").agg(F.sort_array(F.array_union(F.collect_set("src_activity"), F.collect_set("dst_activity"))).alias("nodes"), F.collect_set(F.struct("src_activity", "dst_activity", "label")).alias("pairs"))
    place = lambda c: (F.array_position("nodes", c) - 1).cast("int")
    graphs = packed.select("pe_id", "nodes", F.transform("pairs", lambda p: F.struct(place(p["src_activity"]).alias("s"), place(p["dst_activity"]).alias("t"), p["label"].alias("label"))).alias("edges"))
    path = folder_for(spark, "graphs")
    mining.write_graphs(graphs, path)
    return mining.triples(mining.read_graphs(spark, path))


@query("lattice_json", f"WITH {B} SELECT 'item:' || item AS source_id, 'customer:' || CAST(o_custkey AS VARCHAR) AS target_id FROM li JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2")
def lattice_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rooted lattice's mapping, written as JSON lines and read back."""
    graph, path = restructure.TypeGraph([("item", "order"), ("order", "customer")]), folder_for(spark, "lattice")
    documents.as_json_lines(restructure.rooted_lattice(commerce_log(spark, sf_dir), graph, "item")["customer"], path)
    return spark.read.schema("source_id string, target_id string").json(path)


@query(
    "situation_export",
    KPI_SQL + f""", {HITS_SQL}, c AS (SELECT * FROM (VALUES (0, 'click>view'), (1, 'view>click')) v(config_id, pattern_id))
    SELECT config_id, k.pe_id, round(duration, 6) AS duration, CAST(n_events AS DOUBLE) AS n_events, CASE WHEN hits.pe_id IS NULL THEN 'N' ELSE 'Y' END AS b1 FROM k CROSS JOIN c LEFT JOIN hits ON hits.pe_id = k.pe_id AND hits.pattern_id = c.pattern_id""",
)
def situation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Situation tables of two configurations, written as CSV by configuration and read back."""
    log, path = stream_log(spark, sf_dir), folder_for(spark, "situations")
    values = kpi.long(kpi.builtin(log, user_executions(log)), ["duration", "n_events"])
    hits = quick_pairs(log).withColumn("config_id", F.when(F.col("pattern_id") == "click>view", 0).otherwise(1))
    bundle = explorer.Bundle(hits, hits, hits, values, hits, hits, hits, hits)
    tables = [explorer.situation(bundle, i, [p], ["duration", "n_events"]).withColumn("config_id", F.lit(i)) for i, p in enumerate(("click>view", "view>click"))]
    reports.csv_by(tables[0].unionByName(tables[1]), path, "config_id")
    back = spark.read.schema("pe_id string, duration double, n_events double, b1 string, config_id int").option("header", True).csv(path)
    return back.withColumn("duration", F.round("duration", 6))


@query("constraint_instances", f"WITH {A} SELECT activity AS name, us AS start, us + 60000000 AS \"end\" FROM ev WHERE activity = 'error'")
def constraint_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of violated constraints, written as CSV and read back."""
    us, path = traces.micros("ts"), folder_for(spark, "instances")
    errors = stream_log(spark, sf_dir).events.where("activity = 'error'")
    reports.csv(errors.select(F.col("activity").alias("name"), us.alias("start"), (us + 60_000_000).alias("end")), path)
    return documents.constraint_instances(spark, path)


# --- monitoring ----------------------------------------------------------------------------

CONTROL = [
    ("view before click", "causal", "view", "click"),
    ("view and click", "concur", "view", "click"),
    ("signup or error", "choice", "signup", "error"),
    ("purchase skipped", "skip", "purchase", "purchase"),
    ("other skipped", "skip", "purchase", "view"),
    ("unknown", "concur", "view", "no such activity"),
]


@query(
    "model_constraints",
    f"""WITH {A}, s AS (SELECT object_id, list(activity ORDER BY ts, event_id) AS acts FROM timed WHERE object_type = 'user' GROUP BY 1),
    c AS (SELECT * FROM (VALUES {", ".join(str(c) for c in CONTROL)}) v(name, kind, source, target)),
    p AS (SELECT c.*, coalesce(list_position(acts, source), 0) AS a, coalesce(list_position(acts, target), 0) AS b FROM c CROSS JOIN s)
    SELECT name, kind, source, target, CASE kind WHEN 'causal' THEN bool_and(a > 0 AND b > 0 AND a < b) WHEN 'concur' THEN bool_or(a > 0 AND b > 0 AND a < b) AND bool_or(b > 0 AND a > b)
      WHEN 'choice' THEN bool_and((a > 0) <> (b > 0)) ELSE source = target AND bool_or(a > 0) AND NOT bool_and(a > 0) END AS detected FROM p GROUP BY 1, 2, 3, 4""",
)
def model_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control-flow constraints on the behaviour of the users' enhanced net."""
    log = stream_log(spark, sf_dir)
    users = log.with_relations(log.e2o.where("object_type = 'user'"))
    pe = users.e2o.select(F.col("object_id").alias("pe_id"), "event_id")
    _, behaviour, _ = replay.enhanced(users, petri.discover(users, ["user"]), pe)
    return constraints.on_behaviour(behaviour, constraints.control_constraints(spark, CONTROL))


@query(
    "net_constraints",
    f"""WITH {B}, c AS (SELECT * FROM (VALUES ('order shipped', 'inc', 'order', 'ship_item'), ('customer ships', 'inc', 'customer', 'ship_item'), ('no customer ships', 'exc', 'customer', 'ship_item'), ('many orders', 'var', 'order', 'ship_item')) v(name, kind, object_type, activity)),
    n AS (SELECT activity, object_type, max(n) AS most FROM (SELECT activity, object_type, event_id, count(DISTINCT object_id) AS n FROM timed GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT name, CASE kind WHEN 'inc' THEN most IS NOT NULL WHEN 'exc' THEN most IS NULL ELSE coalesce(most > 1, false) END AS detected FROM c LEFT JOIN n USING (activity, object_type)""",
)
def net_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints on which types the transitions of a discovered net take."""
    net = petri.discover(commerce_log(spark, sf_dir), ["order", "customer"])
    rows = [("order shipped", "inc", "order", "ship_item"), ("customer ships", "inc", "customer", "ship_item"), ("no customer ships", "exc", "customer", "ship_item"), ("many orders", "var", "order", "ship_item")]
    return spark.createDataFrame(constraints.on_net(net, rows), "name string, detected boolean")


@query("stream_monitoring", f"WITH {A} SELECT activity, count(*) AS value, count(*) > 500 AS violated FROM timed WHERE object_type = 'key' GROUP BY 1")
def stream_monitoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints on the number of events, evaluated on the stream's one micro-batch."""
    acts = stream_log(spark, sf_dir).events.select("activity").distinct()
    limits = acts.select(F.lit("at most 500").alias("name"), F.lit("count").alias("kind"), F.lit("key").alias("object_type"), F.col("activity").alias("source"), F.lit(None).cast("string").alias("target"), F.lit("<=").alias("operator"), F.lit(500.0).alias("threshold"))
    out = folder_for(spark, "monitored")

    def check(batch: DataFrame, _: int) -> None:
        counts = batch.where("object_type = 'key'").groupBy(F.lit("count").alias("kind"), "object_type", F.col("activity").alias("source"), F.lit(None).cast("string").alias("target")).agg(F.count(F.lit(1)).cast("double").alias("value"))
        constraints.monitor(counts, limits).write.mode("append").parquet(out)

    incremental.monitor(incremental.read_relations(spark, relations_folder(spark, sf_dir)), check, folder_for(spark, "stream-state"), None).awaitTermination()
    found = spark.read.schema("source string, value double, violated boolean").parquet(out)
    return found.select(F.col("source").alias("activity"), F.col("value").cast("long").alias("value"), "violated")
