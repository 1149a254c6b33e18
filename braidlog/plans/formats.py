"""Queries that write a log in each format and read it back, and streaming views of a log."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.functions.runtime import delete_at_exit, shared_dir
from braidlog.model import Log
from braidlog.operators import executions, filters, performance, replay, traces
from braidlog.plans.catalog import A, B, query
from braidlog.sources import documents
from braidlog.sources.tables import commerce_log, stream_log
from braidlog.streaming import incremental

TYPES = ["order", "customer", "item", "part", "supplier"]


def folder_for(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/braidlog-{label}-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    return path


def content(log: Log, o2o: bool = True, attributes: bool = True) -> DataFrame:
    """All rows of a log as ``(part, a, b, c, us, attr)``."""
    empty, none = F.lit("").alias("c"), F.lit(None).cast("long").alias("us")
    blank = F.lit("").alias("attr")
    parts = [
        log.events.select(F.lit("event").alias("part"), F.col("event_id").alias("a"), F.col("activity").alias("b"), empty, traces.micros("ts").alias("us"), F.coalesce(F.element_at("attrs", "quantity").cast("double").cast("long").cast("string"), F.lit("")).alias("attr")),
        log.objects.select(F.lit("object").alias("part"), F.col("object_id").alias("a"), F.col("object_type").alias("b"), empty, none, F.coalesce(F.element_at("attrs", "status"), F.element_at("attrs", "nation"), F.element_at("attrs", "type"), F.lit("")).alias("attr") if attributes else blank),
        log.e2o.select(F.lit("e2o").alias("part"), F.col("event_id").alias("a"), F.col("object_id").alias("b"), F.col("object_type").alias("c"), none, F.col("qualifier").alias("attr")),
    ]
    if o2o:
        parts.append(log.o2o.select(F.lit("o2o").alias("part"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), empty, none, F.col("qualifier").alias("attr")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


EVENT_SQL = "SELECT 'event' AS part, event_id AS a, activity AS b, '' AS c, us, coalesce(CAST(CAST(q.l_quantity AS BIGINT) AS VARCHAR), '') AS attr FROM ev LEFT JOIN (SELECT 'si-' || item AS event_id, l_quantity FROM li) q USING (event_id)"
E2O_SQL = " UNION ALL SELECT DISTINCT 'e2o', event_id, object_id, object_type, NULL, '' FROM e2o"
FULL_SQL = (
    f"WITH {B}, oa AS (SELECT 'order:' || CAST(o_orderkey AS VARCHAR) AS object_id, o_orderstatus AS attr FROM orders UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR), n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'part:' || CAST(p_partkey AS VARCHAR), p_type FROM part) "
    + EVENT_SQL
    + " UNION ALL SELECT 'object', object_id, object_type, '', NULL, coalesce(attr, '') FROM obj LEFT JOIN oa USING (object_id)"
    + E2O_SQL
    + " UNION ALL SELECT 'o2o', 'order:' || CAST(l_orderkey AS VARCHAR), 'item:' || item, '', NULL, 'contains' FROM li"
)
#: A wide table has the objects of its events only, and neither their attributes nor their relations.
WIDE_SQL = f"WITH {B} " + EVENT_SQL + " UNION ALL SELECT DISTINCT 'object', object_id, object_type, '', NULL, '' FROM e2o" + E2O_SQL


def _round_trip(name: str, ending: str, dialect: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    @query(name, FULL_SQL)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = folder_for(spark, "log") + ending
        delete_at_exit(spark, path)
        if ending == ".sqlite":  # SQLite opens files by their path, on a folder that every machine mounts
            path = path.removeprefix("file://")
        documents.write_ocel(commerce_log(spark, sf_dir), path, dialect)
        return content(documents.read_ocel(spark, path))

    return run


_round_trip("source_sqlite", ".sqlite")
_round_trip("source_ocel1_json", ".jsonocel", "ocel1")
_round_trip("source_ocel2_json", ".json")
_round_trip("source_xml", ".xml")
_round_trip("source_parquet", "")


@query("source_csv", WIDE_SQL)
def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder_for(spark, "csv")
    documents.write_csv(commerce_log(spark, sf_dir), path, TYPES)
    return content(documents.read_csv(spark, path, TYPES), False, False)


@query("merge_logs", FULL_SQL)
def merge_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of placed orders and that of shipped items, which share the orders, merge to the whole."""
    log = commerce_log(spark, sf_dir)

    def half(activity: str, kinds: list[str]) -> Log:
        part = log.with_events(log.events.where(F.col("activity") == activity))
        return replace(part, objects=log.objects.where(F.col("object_type").isin(kinds)))

    return content(documents.merge(half("place_order", ["order", "customer"]), half("ship_item", ["order", "item", "part", "supplier"])))


@query("drop_empty_events", f"WITH {B}, s AS (SELECT DISTINCT event_id FROM e2o WHERE object_type = 'customer') SELECT activity, count(*) AS n FROM ev JOIN s USING (event_id) GROUP BY 1")
def drop_empty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = filters.keep(commerce_log(spark, sf_dir), types=["customer"])
    return filters.drop_empty_events(log).events.groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


# --- executions ----------------------------------------------------------------------------


@query(
    "graph_executions",
    f"""WITH RECURSIVE {B}, x AS (SELECT DISTINCT event_id, object_type || ':' || object_id AS key FROM e2o WHERE event_id IS NOT NULL),
    r AS (
      SELECT DISTINCT event_id, event_id AS pe_id, true AS moved, 0 AS i FROM x
      UNION ALL SELECT event_id, least(pe_id, low), bool_or(low < pe_id) OVER (), i + 1 FROM (
        SELECT event_id, pe_id, i, min(low) AS low FROM (SELECT r.*, min(CASE WHEN key IS NOT NULL THEN pe_id END) OVER (PARTITION BY coalesce(key, event_id)) AS low FROM r JOIN x USING (event_id) WHERE moved) GROUP BY 1, 2, 3
      )
    )
    SELECT pe_id, event_id FROM r WHERE i = (SELECT max(i) FROM r)""",
)
def graph_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all events over objects of all types."""
    return executions.graph_executions(commerce_log(spark, sf_dir)).select("pe_id", "event_id")


@query(
    "selected_components",
    f"""WITH {B}, o AS (SELECT DISTINCT event_id, 'order:' || CAST(l_orderkey AS VARCHAR) AS ord FROM (SELECT 'si-' || item AS event_id, l_orderkey FROM li)),
    m AS (SELECT DISTINCT ord AS grp, object_id FROM e2o JOIN o USING (event_id) WHERE object_type IN ('order', 'item')),
    c AS (SELECT grp, min(object_id) AS component, count(*) AS size, rank() OVER (ORDER BY count(*) DESC) AS size_rank FROM m GROUP BY 1)
    SELECT component, object_id, size, size_rank FROM c JOIN m USING (grp)""",
)
def selected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executions.selected_components(commerce_log(spark, sf_dir), ["order", "item"], ["ship_item"])


PARTS_SQL = f"""WITH {B}, e AS (SELECT event_id, object_id AS ord FROM e2o WHERE object_type = 'order'),
p AS (SELECT event_id, min(event_id) OVER (PARTITION BY ord) AS pe_id FROM e)"""


@query(
    "correlated_metrics",
    PARTS_SQL
    + """, t AS (SELECT pe_id, event_id, activity, us FROM p JOIN ev USING (event_id)), i AS (SELECT * FROM t WHERE activity = 'ship_item'),
    x AS (SELECT pe_id, arg_min(event_id, (us, event_id)) AS dst, min(us) AS first, max(us) AS last, count(*) AS n_events FROM i GROUP BY 1),
    l AS (SELECT pe_id, event_id AS dst, lag(us) OVER (PARTITION BY pe_id ORDER BY us, event_id) AS context FROM t)
    SELECT x.pe_id, (first - context) / 1e6::DOUBLE AS waiting, (last - first) / 1e6::DOUBLE AS service, (last - coalesce(context, first)) / 1e6::DOUBLE AS sojourn, CASE WHEN context IS NULL THEN NULL ELSE 0.0::DOUBLE END AS sync,
    n_events, CAST(1 AS BIGINT) AS n_objects, CAST(1 AS BIGINT) AS n_types, CAST(0 AS BIGINT) AS n_interacting FROM x JOIN l ON l.pe_id = x.pe_id AND l.dst = x.dst""",
)
def correlated_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipping part of every order's graph."""
    log = commerce_log(spark, sf_dir)
    log = log.with_relations(log.e2o.where("object_type = 'order'"))
    return performance.correlated_metrics(log, executions.component_executions(log), ["ship_item"], ("order", "order"))


@query("correlated_objects", PARTS_SQL + " SELECT pe_id, object_type, count(DISTINCT object_id) AS n_objects FROM p JOIN e2o USING (event_id) GROUP BY 1, 2")
def correlated_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of all types in the graphs that orders connect."""
    return performance.connected_objects(commerce_log(spark, sf_dir), "order")


@query("enhanced_behaviour", f"WITH {A}, s AS (SELECT object_id, list(activity ORDER BY ts, event_id) AS acts FROM timed WHERE object_type = 'user' GROUP BY 1) SELECT array_to_string(acts, '>') AS sequence, count(*) AS n FROM s GROUP BY 1")
def enhanced_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different sequences of users' executions, beside the net that enhances them."""
    from braidlog.operators import petri

    log = stream_log(spark, sf_dir)
    users = log.with_relations(log.e2o.where("object_type = 'user'"))
    pe = users.e2o.select(F.col("object_id").alias("pe_id"), "event_id")
    _, behaviour, _ = replay.enhanced(users, petri.discover(users, ["user"]), pe)
    return behaviour.select(F.array_join("sequence", ">").alias("sequence"), "n")


# --- streaming -----------------------------------------------------------------------------


def relations_folder(spark: SparkSession, sf_dir: str) -> str:
    """The stream log's relations as files that a stream reads."""
    path = folder_for(spark, "stream-in")
    log = stream_log(spark, sf_dir)
    log.timed().select("event_id", "activity", "ts", "object_id", "object_type").write.parquet(path)
    return path


@query("stream_directly_follows", f"WITH {A} SELECT object_type, src_activity, dst_activity, count(*) AS n, sum(CAST(dst_us - src_us AS DECIMAL(38,0)))::VARCHAR AS gap_us FROM fol GROUP BY 1, 2, 3")
def stream_directly_follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs found by the stream, all of whose files are one micro-batch."""
    stream = incremental.read_relations(spark, relations_folder(spark, sf_dir))
    out = folder_for(spark, "stream-pairs")
    pairs = incremental.directly_follows(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", folder_for(spark, "stream-state"))
    pairs.trigger(availableNow=True).start(out).awaitTermination()
    us = F.round(F.col("gap") * 1_000_000).cast("decimal(38,0)")
    return spark.read.schema(incremental.PAIRS).parquet(out).groupBy("object_type", "src_activity", "dst_activity").agg(F.count(F.lit(1)).alias("n"), F.sum(us).cast("string").alias("gap_us"))


@query("stream_windows", f"WITH {A} SELECT us - us % 3600000000 AS start_us, activity, count(*) AS n FROM timed GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows after the last micro-batch, whose whole table every batch replaces."""
    windows = incremental.windowed_activity(incremental.read_relations(spark, relations_folder(spark, sf_dir)))
    out = folder_for(spark, "stream-windows")

    def store(batch: DataFrame, _: int) -> None:
        batch.select(traces.micros("window.start").alias("start_us"), "activity", "n").write.mode("overwrite").parquet(out)

    view = windows.writeStream.outputMode("complete").option("checkpointLocation", folder_for(spark, "stream-state")).foreachBatch(store)
    view.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("start_us long, activity string, n long").parquet(out)
