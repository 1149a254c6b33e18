"""Queries for features, attributes, lattices, mining, trees, variants, nets and sources."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.functions.runtime import written
from braidlog.model import Log
from braidlog.operators import abstraction, attributes, executions, features, hierarchy, impact, kpi, mining, performance, petri, replay, restructure, traces, tree, variants
from braidlog.plans.catalog import A, B, HITS_SQL, KPI_SQL, U, order_log, query, quick_pairs, r6, user_executions
from braidlog.sources.tables import commerce_log, stream_log

# --- features ------------------------------------------------------------------------------

#: Executions, their edges (distinct) and predecessors in SQL.
FEAT = f"""WITH {A}, {U}, b AS (SELECT pe.pe_id, ev.* FROM pe JOIN ev USING (event_id)),
t AS (SELECT pe.pe_id, timed.* FROM pe JOIN timed USING (event_id)),
f AS (SELECT pe_id, object_type, lag(event_id) OVER (PARTITION BY pe_id, object_type, object_id ORDER BY ts, event_id) AS src, event_id AS dst FROM t),
ed AS (SELECT DISTINCT pe_id, src, dst FROM f WHERE src IS NOT NULL),
pr AS (SELECT ed.pe_id, ed.dst AS event_id, s.event_id AS src, s.activity AS a, s.us AS sus, s.value AS v FROM ed JOIN ev s ON s.event_id = ed.src)
"""
_SO_FAR = "OVER (PARTITION BY pe_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_PRE = "SELECT b.pe_id, b.event_id, CAST({0} AS DOUBLE) AS value FROM b LEFT JOIN pr USING (pe_id, event_id) GROUP BY b.pe_id, b.event_id, b.us"
_HOUR = 3600.0 * 24
FEATURES: dict[str, tuple[str, dict, str]] = {
    "current_activities": ("current_activity", {"activity": "view"}, "SELECT b.pe_id, b.event_id, CASE WHEN EXISTS (SELECT 1 FROM b x WHERE x.pe_id = b.pe_id AND x.us <= b.us AND x.activity = 'view' AND NOT EXISTS (SELECT 1 FROM ed JOIN ev d ON d.event_id = ed.dst WHERE ed.pe_id = x.pe_id AND ed.src = x.event_id AND d.us <= b.us)) THEN 1.0::DOUBLE ELSE 0 END AS value FROM b"),
    "preceding_activities": ("preceding_activities", {"activity": "view"}, _PRE.format("count(*) FILTER (a = 'view')")),
    "previous_activity_count": ("previous_activity_count", {"activity": "view"}, f"SELECT pe_id, event_id, CAST(sum(CASE WHEN activity = 'view' THEN 1 ELSE 0 END) {_SO_FAR} AS DOUBLE) AS value FROM b"),
    "event_activity": ("event_activity", {"activity": "click"}, "SELECT pe_id, event_id, CASE WHEN activity = 'click' THEN 1.0::DOUBLE ELSE 0 END AS value FROM b"),
    "event_identity": ("event_identity", {}, "SELECT pe_id, event_id, 1.0::DOUBLE AS value FROM b"),
    "previous_char_max": ("previous_values", {"attribute": "value", "aggregate": "max"}, f"SELECT pe_id, event_id, max(value) {_SO_FAR} AS value FROM b"),
    "preceding_char_min": ("preceding_values", {"attribute": "value", "aggregate": "min"}, _PRE.format("min(v)")),
    "characteristic_value": ("attribute_value", {"attribute": "value"}, "SELECT pe_id, event_id, value FROM b"),
    "resource_workload": ("resource_workload", {"object_type": "key", "horizon": _HOUR}, "SELECT b.pe_id, b.event_id, CAST((SELECT count(*) FROM timed x JOIN e2o y ON y.event_id = b.event_id AND y.object_type = 'key' AND x.object_id = y.object_id WHERE x.us BETWEEN b.us - 86400000000 AND b.us) AS DOUBLE) AS value FROM b"),
    "total_workload": ("total_workload", {"horizon": _HOUR}, "SELECT pe_id, b.event_id, CAST(w.n AS DOUBLE) AS value FROM b JOIN (SELECT event_id, count(*) OVER (ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM ev) w USING (event_id)"),
    "event_resource": ("event_resource", {"object_type": "key", "object_id": "key:1"}, "SELECT pe_id, event_id, CASE WHEN EXISTS (SELECT 1 FROM e2o WHERE e2o.event_id = b.event_id AND object_id = 'key:1') THEN 1.0::DOUBLE ELSE 0 END AS value FROM b"),
    "execution_duration": ("execution_duration", {}, "SELECT pe_id, event_id, CAST(max(us) OVER (PARTITION BY pe_id) - min(us) OVER (PARTITION BY pe_id) AS DOUBLE) / 1e6 AS value FROM b"),
    "elapsed_time": ("elapsed_time", {}, "SELECT pe_id, event_id, CAST(us - min(us) OVER (PARTITION BY pe_id) AS DOUBLE) / 1e6 AS value FROM b"),
    "remaining_time": ("remaining_time", {}, "SELECT pe_id, event_id, CAST(max(us) OVER (PARTITION BY pe_id) - us AS DOUBLE) / 1e6 AS value FROM b"),
    "flow_time": ("flow_time", {}, _PRE.format("coalesce(CAST(b.us - min(sus) AS DOUBLE) / 1e6, 0)")),
    "synchronization_time": ("synchronization_time", {}, _PRE.format("coalesce(CAST(max(sus) - min(sus) AS DOUBLE) / 1e6, 0)")),
    "sojourn_time": ("sojourn_time", {}, _PRE.format("coalesce(CAST(b.us - max(sus) AS DOUBLE) / 1e6, 0)")),
    "waiting_time": ("waiting_time", {}, _PRE.format("coalesce(CAST(b.us - max(sus) AS DOUBLE) / 1e6, 0)")),
    "service_time": ("service_time", {}, _PRE.format("0")),
    "pooling_time": ("pooling_time", {"object_type": "key"}, _PRE.format("coalesce(CAST(max(sus) - min(sus) AS DOUBLE) / 1e6, 0)")),
    "lagging_time": ("lagging_time", {"object_type": "key"}, "SELECT b.pe_id, b.event_id, coalesce(CAST(l.own - l.low AS DOUBLE) / 1e6, 0) AS value FROM b LEFT JOIN (SELECT pe_id, event_id, max(m) FILTER (object_type = 'key') AS own, min(m) AS low FROM (SELECT pr.pe_id, pr.event_id, e2o.object_type, max(sus) AS m FROM pr JOIN e2o ON e2o.event_id = pr.src GROUP BY 1, 2, 3) GROUP BY 1, 2) l USING (pe_id, event_id)"),
    "total_object_count": ("total_object_count", {"horizon": _HOUR}, "SELECT b.pe_id, b.event_id, CAST(count(DISTINCT x.object_id) AS DOUBLE) AS value FROM b JOIN timed x ON x.us BETWEEN b.us - 86400000000 AND b.us GROUP BY 1, 2"),
    "previous_object_count": ("previous_object_count", {}, "SELECT b.pe_id, b.event_id, CAST(count(DISTINCT x.object_id) AS DOUBLE) AS value FROM b JOIN t x ON x.pe_id = b.pe_id AND x.us <= b.us GROUP BY 1, 2"),
    "previous_type_count": ("previous_type_count", {"object_type": "key"}, "SELECT b.pe_id, b.event_id, CAST(count(DISTINCT x.object_id) AS DOUBLE) AS value FROM b JOIN t x ON x.pe_id = b.pe_id AND x.us <= b.us AND x.object_type = 'key' GROUP BY 1, 2"),
    "event_objects": ("has_object", {"object_id": "user:1"}, "SELECT pe_id, event_id, CASE WHEN pe_id = 'user:1' THEN 1.0::DOUBLE ELSE 0 END AS value FROM b"),
    "number_of_objects": ("number_of_objects", {}, "SELECT pe_id, event_id, CAST((SELECT count(*) FROM e2o WHERE e2o.event_id = b.event_id) AS DOUBLE) AS value FROM b"),
    "event_type_count": ("event_type_count", {"object_type": "key"}, "SELECT pe_id, event_id, CAST((SELECT count(*) FROM e2o WHERE e2o.event_id = b.event_id AND object_type = 'key') AS DOUBLE) AS value FROM b"),
}


def _feature_query(name: str, parameters: dict):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = stream_log(spark, sf_dir)
        values = features.EVENT_FEATURES[name](log, user_executions(log), **parameters)
        return features.averaged(values).select("event_id", r6("value").alias("value"))

    return run


for _name, (_feature, _parameters, _sql) in FEATURES.items():
    query(f"feature_{_name}", f"{FEAT} SELECT event_id, round(avg(value), 6) AS value FROM ({_sql}) GROUP BY 1")(_feature_query(_feature, _parameters))


@query(
    "execution_features",
    FEAT
    + """, x AS (SELECT b.*, EXISTS (SELECT 1 FROM ed WHERE ed.pe_id = b.pe_id AND ed.dst = b.event_id) AS pre, EXISTS (SELECT 1 FROM ed WHERE ed.pe_id = b.pe_id AND ed.src = b.event_id) AS post FROM b),
    d AS (SELECT pe_id, us, row_number() OVER (PARTITION BY pe_id ORDER BY us DESC) AS i FROM (SELECT DISTINCT pe_id, us FROM b)),
    l AS (SELECT pe_id, coalesce(CAST(max(us) FILTER (i = 1) - max(us) FILTER (i = 2) AS DOUBLE) / 1e6, 0) AS delta_last_event FROM d GROUP BY 1)
    SELECT x.pe_id, count(DISTINCT x.event_id) AS n_events, count(*) FILTER (NOT pre) AS n_starting, count(*) FILTER (NOT post) AS n_ending, CAST(max(x.us) - min(x.us) AS DOUBLE) / 1e6 AS throughput, 1 AS identity,
    count(DISTINCT x.activity) AS n_activities, any_value(delta_last_event) AS delta_last_event, 0.0::DOUBLE AS service_time, 0.0::DOUBLE AS avg_service_time,
    max(CASE WHEN x.activity = 'signup' THEN 1 ELSE 0 END) AS activity_signup, (SELECT count(DISTINCT object_id) FROM t WHERE t.pe_id = x.pe_id) AS n_objects, (SELECT max(CASE WHEN object_id = 'key:1' THEN 1 ELSE 0 END) FROM t WHERE t.pe_id = x.pe_id) AS "object_key:1"
    FROM x JOIN l USING (pe_id) GROUP BY 1""",
)
def execution_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stream_log(spark, sf_dir)
    return features.execution_features(log, user_executions(log), ["key:1"], ["signup"])


@query("feature_table", f"{FEAT} SELECT pe_id, event_id, CASE WHEN activity = 'view' THEN 1.0::DOUBLE ELSE 0 END AS f1, CAST(us - min(us) OVER (PARTITION BY pe_id) AS DOUBLE) / 1e6 AS f2 FROM b")
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stream_log(spark, sf_dir)
    return features.extract(log, user_executions(log), [("event_activity", {"activity": "view"}), ("elapsed_time", {})])


@query(
    "feature_sequences",
    f"""{FEAT}, fv AS (SELECT pe_id, event_id, ts, CASE WHEN activity = 'view' THEN 1.0::DOUBLE ELSE 0 END AS v, CAST(us - min(us) OVER (PARTITION BY pe_id) AS DOUBLE) / 1e6 AS t FROM b)
    SELECT pe_id, event_id, lag(v, 2) OVER w AS v0, lag(t, 2) OVER w AS t0, lag(v, 1) OVER w AS v1, lag(t, 1) OVER w AS t1, v AS v2, t AS t2 FROM fv WINDOW w AS (PARTITION BY pe_id ORDER BY ts, event_id) QUALIFY lag(v, 2) OVER w IS NOT NULL""",
)
def feature_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stream_log(spark, sf_dir)
    out = features.sequences(log, features.extract(log, user_executions(log), [("event_activity", {"activity": "view"}), ("elapsed_time", {})]), 3)
    return out.select("pe_id", "event_id", *[F.get(F.get("sequence", F.lit(i)), F.lit(k)).alias(f"{name}{i}") for i in range(3) for k, name in enumerate("vt")])


@query("scaled_split")
def scaled_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stream_log(spark, sf_dir)
    table = features.extract(log, user_executions(log), [("elapsed_time", {}), ("number_of_objects", {})])
    train, test = features.scaled(*features.split(table, 0.3, 7))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "time_series",
    f"""WITH {A}, {U}, s AS (SELECT pe_id, min(us) AS lo FROM pe JOIN ev USING (event_id) GROUP BY 1), g AS (SELECT min(us) AS low, max(us) AS high FROM ev), step AS (SELECT 6 * 3600000000 AS st),
    w AS (SELECT i, low + i * st AS begin, low + (i + 1) * st AS "end" FROM g, step, unnest(range(0, (high - low) // st + 1)) AS r(i))
    SELECT i, begin, "end", (SELECT count(*) FROM s WHERE lo BETWEEN begin AND "end") AS n FROM w""",
)
def time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stream_log(spark, sf_dir)
    return features.time_series(log, user_executions(log), 6 * 3600.0)


# --- attributes ----------------------------------------------------------------------------

ATTR = """WITH cu AS (SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS object_id, c_mktsegment AS segment, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
pa AS (SELECT 'part:' || CAST(p_partkey AS VARCHAR) AS object_id, p_brand AS brand, p_type AS type, CAST(p_size AS VARCHAR) AS size FROM part),
od AS (SELECT 'order:' || CAST(o_orderkey AS VARCHAR) AS object_id, o_orderstatus AS status, o_orderpriority AS priority FROM orders),
att AS (
  SELECT object_id, 'customer' AS object_type, unnest(['segment', 'nation', 'region']) AS field, unnest([segment, nation, region]) AS value FROM cu
  UNION ALL SELECT object_id, 'part', unnest(['brand', 'type', 'size']), unnest([brand, type, size]) FROM pa
  UNION ALL SELECT object_id, 'order', unnest(['status', 'priority']), unnest([status, priority]) FROM od
)
"""


@query(
    "numeric_discovery",
    ATTR
    + """, x AS (SELECT object_type, field, value, TRY_CAST(value AS DOUBLE) AS v FROM att WHERE value IS NOT NULL)
    SELECT object_type, field, count(*) AS n, count(DISTINCT v) AS n_distinct, min(v) AS low, max(v) AS high FROM x GROUP BY 1, 2 HAVING count(*) >= 10 AND count(*) = count(v) AND count(DISTINCT v) >= 10""",
)
def numeric_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.numeric_fields(commerce_log(spark, sf_dir)).select("object_type", "field", "n", "n_distinct", "low", "high")


def changing_log(spark: SparkSession, sf_dir: str) -> Log:
    """The stream log with a change of each user's state at every event."""
    from dataclasses import replace

    log = stream_log(spark, sf_dir)
    rows = log.timed().where("object_type = 'user'").select("object_id", "object_type", "ts", F.lit("state").alias("field"), F.when(F.col("activity") == "error", F.lit("no_state")).otherwise(F.col("activity")).alias("value"))
    return replace(log, object_changes=rows)


@query("latest_value", f"WITH {A} SELECT object_id, 'state' AS field, arg_max(activity, (ts, activity)) AS value FROM timed WHERE object_type = 'user' AND activity <> 'error' GROUP BY 1")
def latest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.latest(changing_log(spark, sf_dir)).select("object_id", "field", "value")


@query("fill_missing", f"WITH {A} SELECT object_id, coalesce((SELECT arg_max(activity, (ts, activity)) FROM timed WHERE timed.object_id = obj.object_id AND activity <> 'error'), 'no_state') AS state FROM obj WHERE object_type = 'user'")
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    log = changing_log(spark, sf_dir)
    filled = attributes.fill_missing(replace(log, objects=attributes.with_latest(log)))
    return filled.where("object_type = 'user'").select("object_id", F.try_element_at("attrs", F.lit("state")).alias("state"))


@query("banding")
def banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.bands(commerce_log(spark, sf_dir), "part", "size")


PRINT_SQL = (
    f"{FEAT.rstrip()}, k AS (SELECT pe_id, 'state' AS field, activity AS value, count(*) AS n FROM b GROUP BY 1, 2, 3), fp AS (SELECT pe_id, value FROM (SELECT *, row_number() OVER (PARTITION BY pe_id ORDER BY n DESC, value) AS i FROM k) WHERE i = 1)"
)


def _prints(log: Log) -> DataFrame:
    """Each user's commonest activity, as an attribute of its own object."""
    pe = user_executions(log)
    n = pe.join(log.events, "event_id").groupBy("pe_id", "activity").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("pe_id").orderBy(F.desc("n"), "activity"))
    return n.withColumn("i", first).where("i = 1").select("pe_id", F.lit("user").alias("object_type"), F.lit("state").alias("field"), F.col("activity").alias("value"))


@query(
    "fingerprint_mode",
    ATTR + f", {B.strip()}, po AS (SELECT DISTINCT a.object_id AS pe_id, b.object_id FROM e2o a JOIN e2o b ON a.event_id = b.event_id WHERE a.object_type = 'order' AND b.object_type = 'part'), "
    "n AS (SELECT pe_id, field, value, count(*) AS n FROM po JOIN att USING (object_id) WHERE value IS NOT NULL GROUP BY 1, 2, 3) SELECT pe_id, 'part' AS object_type, field, value FROM (SELECT *, row_number() OVER (PARTITION BY pe_id, field ORDER BY n DESC, value) AS i FROM n) WHERE i = 1",
)
def fingerprint_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = commerce_log(spark, sf_dir)
    pe = traces.flatten(log, "order").select(F.col("case_id").alias("pe_id"), "event_id")
    own = executions.execution_objects(log, pe).where("object_type = 'part'")
    return attributes.fingerprint(log, own)


SHIFT_TAIL = """, gs AS (SELECT count(*) FILTER (inside) AS n_in, count(*) FILTER (NOT inside) AS n_out FROM g), c AS (SELECT value, count(*) FILTER (inside) AS c_in, count(*) FILTER (NOT inside) AS c_out FROM fp JOIN g USING (pe_id) GROUP BY 1),
r AS (SELECT value, c_in / n_in AS p_in, c_out / n_out AS p_out, round(c_in / n_in - c_out / n_out, 4) AS delta FROM c, gs)
SELECT 'user' AS object_type, 'state' AS field, value, round(p_in, 4) AS p_in, round(p_out, 4) AS p_out, delta, max(abs(delta)) OVER () AS score FROM r QUALIFY row_number() OVER (ORDER BY abs(delta) DESC, value) <= 6"""


@query("attribute_shift", PRINT_SQL + ", g AS (SELECT DISTINCT pe_id, pe_id LIKE '%1' AS inside FROM pe)" + SHIFT_TAIL)
def attribute_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stream_log(spark, sf_dir)
    groups = user_executions(log).select("pe_id", F.col("pe_id").endswith("1").alias("inside")).distinct()
    return attributes.shift(_prints(log), groups)


@query("attribute_shift_high_low", PRINT_SQL + ", d AS (SELECT pe_id, CAST(max(us) - min(us) AS DOUBLE) / 1e6 AS v FROM b GROUP BY 1), g AS (SELECT pe_id, v > m AS inside FROM d, (SELECT median(v) AS m FROM d) WHERE v <> m)" + SHIFT_TAIL)
def attribute_shift_high_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stream_log(spark, sf_dir)
    values = kpi.builtin(log, user_executions(log)).select("pe_id", F.col("duration").alias("value"))
    return attributes.shift(_prints(log), attributes.high_low(values))


@query(
    "qualifier_e2o",
    ATTR + f", {B.strip()} SELECT activity AS qualifier, priority AS value, count(*) AS n, activity = 'ship_item' AS permitted FROM timed JOIN od USING (object_id) WHERE object_type = 'order' GROUP BY 1, 2",
)
def qualifier_e2o(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    log = commerce_log(spark, sf_dir)
    named = replace(log, e2o=log.timed().select("event_id", "object_id", "object_type", F.col("activity").alias("qualifier")))
    allowed = log.objects.where("object_type = 'order'").select(F.lit("ship_item").alias("qualifier"), F.try_element_at("attrs", F.lit("priority")).alias("value")).distinct()
    return attributes.qualifier_conformance(named, "order", "priority", allowed)


@query(
    "qualifier_o2o",
    f"WITH {B}, p AS (SELECT a.event_id, a.object_id AS s, b.object_id AS t FROM e2o a JOIN e2o b ON a.event_id = b.event_id WHERE a.object_type = 'order' AND b.object_type IN ('item')) SELECT CASE WHEN t IS NULL THEN 'missing' ELSE 'contains' END AS qualifier, count(*) AS n, true AS permitted FROM p GROUP BY 1",
)
def qualifier_o2o(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.o2o_qualifier_conformance(commerce_log(spark, sf_dir), "order", "item", ["contains"])


# --- hierarchies and lattice ---------------------------------------------------------------


@query(
    "fd_pairs",
    ATTR
    + """, nm AS (SELECT object_type, field FROM att WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT value) >= 2), k AS (SELECT att.object_type, object_id, field, coalesce('V' || value, 'M' || object_id) AS blk FROM att JOIN nm USING (object_type, field)),
    p AS (SELECT x.object_type, x.field AS a, y.field AS b, x.blk, count(DISTINCT y.blk) AS n FROM k x JOIN k y ON x.object_type = y.object_type AND x.object_id = y.object_id AND x.field <> y.field GROUP BY 1, 2, 3, 4)
    SELECT object_type, a, b, bool_and(n = 1) AS holds FROM p GROUP BY 1, 2, 3""",
)
def fd_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.dependencies(commerce_log(spark, sf_dir))


@query("attribute_atoms", ATTR + "SELECT object_type, field, count(DISTINCT value) AS n_values FROM att WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT value) >= 2")
def attribute_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.atoms(commerce_log(spark, sf_dir))


def small_lattice(spark: SparkSession, sf_dir: str) -> tuple[Log, DataFrame, hierarchy.Lattice]:
    """Orders with their customers: executions and the lattice over both types' attributes."""
    log = commerce_log(spark, sf_dir)
    pe = traces.flatten(log, "order").select(F.col("case_id").alias("pe_id"), "event_id")
    return log, pe, hierarchy.Lattice(hierarchy.build(log, ["order", "customer", "item"]))


@query("cover_dag")
def cover_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t, i, h.label(i), j, h.label(j)) for t, h in hierarchy.build(commerce_log(spark, sf_dir)).items() for i in range(h.top + 1) for j in h.up[i]]
    return spark.createDataFrame(rows, "object_type string, level int, label string, up int, up_label string")


@query("lattice_configs")
def lattice_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, lattice = small_lattice(spark, sf_dir)
    return spark.createDataFrame([(i, lattice.text(c), lattice.height(c), len(lattice.below(c))) for i, c in enumerate(lattice.walk())], "config_id int, text string, height int, n_covers int")


@query(
    "level_labels",
    ATTR + "SELECT object_id, 'region' AS name, coalesce(region, '?region=' || object_id) AS label FROM cu",
)
def level_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = commerce_log(spark, sf_dir)
    h = hierarchy.build(log, ["customer"])["customer"]
    level = h.names.index("region") + 1
    return hierarchy.level_labels(log, h).where(F.col("level") == level).select("object_id", F.lit("region").alias("name"), "label")


def _type_labels(log: Log) -> DataFrame:
    return log.objects.select("object_id", "object_type", F.col("object_type").alias("label"))


@query(
    "node_labels",
    f"""WITH {B}, c AS (SELECT event_id, activity, object_type, count(DISTINCT object_id) AS n FROM timed GROUP BY 1, 2, 3),
    l AS (SELECT event_id, activity || '{{' || string_agg(object_type || CASE WHEN n = 1 THEN '^1' ELSE '^*' END, ',' ORDER BY object_type) || '}}' AS node FROM c GROUP BY event_id, activity)
    SELECT node, count(*) AS n FROM l JOIN e2o USING (event_id) WHERE object_type = 'order' GROUP BY 1""",
)
def node_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = commerce_log(spark, sf_dir)
    pe = traces.flatten(log, "order").select(F.col("case_id").alias("pe_id"), "event_id")
    return abstraction.node_labels(log, pe, _type_labels(log)).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


def order_graphs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return abstraction.typed_behaviour(executions.cases_by(commerce_log(spark, sf_dir), "order"), columns)


@query("quotient_size")
def quotient_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_graphs(spark, sf_dir, "n_nodes", "n_edges")


@query("iso_classes")
def iso_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = order_graphs(spark, sf_dir, "form")
    return abstraction.classes(written(graphs, "graphs"))


@query("class_metrics")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abstraction.reduction(abstraction.class_metrics(order_graphs(spark, sf_dir, "form", "n_nodes")), 100, 10.0)


# --- mining --------------------------------------------------------------------------------


def user_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity graphs of keys: a node for each activity, an edge for each directly-follows pair."""
    log = stream_log(spark, sf_dir)
    near = traces.micros("dst_ts") - traces.micros("src_ts") < 600_000_000
    edges = traces.follows(log).where((F.col("object_type") == "user") & near).select(F.col("object_id").alias("pe_id"), "src_activity", "dst_activity").distinct()
    names = edges.select("pe_id", F.explode(F.array("src_activity", "dst_activity")).alias("a")).groupBy("pe_id").agg(F.sort_array(F.collect_set("a")).alias("nodes"))
    at = lambda c: (F.array_position("nodes", F.col(c)) - 1).cast("int")
    placed = edges.join(names, "pe_id").groupBy("pe_id", "nodes").agg(F.collect_list(F.struct(at("src_activity").alias("s"), at("dst_activity").alias("t"), F.lit("df").alias("label"))).alias("edges"))
    return placed.select("pe_id", "nodes", "edges")


@query("frequent_edges", f"WITH {A}, {HITS_SQL} SELECT pattern_id, count(*) AS support FROM hits GROUP BY 1 HAVING count(*) >= 3")
def frequent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.frequent_edges(user_graphs(spark, sf_dir), 3).select(F.concat_ws(">", "source", "target").alias("pattern_id"), "support")


@query(
    "induced_support",
    f"""WITH {A}, {HITS_SQL}, h AS (SELECT pe_id, split_part(pattern_id, '>', 1) AS s, split_part(pattern_id, '>', 2) AS t FROM hits)
    SELECT s || '>' || t AS pattern, count(*) AS support FROM h WHERE s <> t AND NOT EXISTS (SELECT 1 FROM h x WHERE x.pe_id = h.pe_id AND ((x.s = h.t AND x.t = h.s) OR (x.s = x.t AND x.s IN (h.s, h.t)))) GROUP BY 1""",
)
def induced_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = mining.pattern_hits(user_graphs(spark, sf_dir), 1, 1).where("n_nodes = 2 and n_edges = 1")
    shape = "array<string>"
    nodes = F.from_json(F.get_json_object("signature", "$[0]"), shape)
    edge = F.from_json(F.get_json_object("signature", "$[1][0]"), shape)
    end = lambda k: F.get(nodes, F.get(edge, F.lit(k)).cast("int"))
    return hits.groupBy(F.concat_ws(">", end(0), end(1)).alias("pattern")).agg(F.count_distinct("pe_id").alias("support"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(mining.pattern_hits(user_graphs(spark, sf_dir), 3, 2), "hits")


#: Users' patterns of one to three pairs in SQL. A user's graph has one node for each activity, so a pattern is a set of pairs.
PATTERN_SQL = f"""{HITS_SQL}, h AS (SELECT pe_id, pattern_id AS p, split_part(pattern_id, '>', 1) AS s, split_part(pattern_id, '>', 2) AS t FROM hits),
u AS (SELECT h.* FROM h JOIN (SELECT p FROM h GROUP BY 1 HAVING count(*) >= 2) USING (p)),
m AS (SELECT a.pe_id, a.p AS p, b.p AS q, list_has_any([a.s, a.t], [b.s, b.t]) AS near, [a.s, a.t, b.s, b.t] AS ns FROM u a JOIN u b ON a.pe_id = b.pe_id AND a.p < b.p),
cand AS (
  SELECT pe_id, [p] AS es, list_distinct([s, t]) AS ns FROM u UNION ALL SELECT pe_id, [p, q], list_distinct(ns) FROM m WHERE near
  UNION ALL SELECT a.pe_id, [a.p, a.q, b.q], list_distinct(a.ns || b.ns) FROM m a JOIN m b ON a.pe_id = b.pe_id AND a.q = b.p JOIN m c ON c.pe_id = a.pe_id AND c.p = a.p AND c.q = b.q WHERE CAST(a.near AS INT) + CAST(b.near AS INT) + CAST(c.near AS INT) >= 2
),
ind AS (SELECT c.pe_id, es, ns FROM cand c JOIN h ON h.pe_id = c.pe_id AND list_contains(ns, h.s) AND list_contains(ns, h.t) WHERE len(ns) > 1 GROUP BY ALL HAVING count(*) = len(es)),
pat AS (SELECT es, any_value(ns) AS ns, array_to_string(es, ',') AS pattern, CAST(any_value(len(ns)) AS INT) AS n_nodes, CAST(len(es) AS INT) AS n_edges, count(*) AS support, list(pe_id ORDER BY pe_id) AS pes FROM ind GROUP BY es)
"""


def _pairs(signature: str) -> F.Column:
    """A signature's edges as sorted ``source>target`` names."""
    nodes = F.from_json(F.get_json_object(signature, "$[0]"), "array<string>")
    edges = F.from_json(F.get_json_object(signature, "$[1]"), "array<array<string>>")
    return F.array_join(F.sort_array(F.transform(edges, lambda e: F.concat_ws(">", F.get(nodes, e[0].cast("int")), F.get(nodes, e[1].cast("int"))))), ",")


@query("patterns_k", f"WITH {A}, {PATTERN_SQL} SELECT pattern, n_nodes, n_edges, support FROM pat WHERE support >= 2")
def patterns_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.frequent_patterns(_hits(spark, sf_dir), 2).select(_pairs("signature").alias("pattern"), "n_nodes", "n_edges", "support")


@query("merged_patterns", f"WITH {A}, {PATTERN_SQL} SELECT pattern, n_nodes, n_edges, support, CAST(1 AS INT) AS n_signatures FROM pat")
def merged_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' graphs have one edge label, so every merged pattern has one signature."""
    merged = mining.merge_labels(mining.hit_sets(_hits(spark, sf_dir)))
    return merged.select(_pairs(F.col("signatures")[0]).alias("pattern"), "n_nodes", "n_edges", "support", F.size("signatures").alias("n_signatures"))


@query(
    "subsumed_patterns",
    f"""WITH {A}, {PATTERN_SQL}, inner_edges AS (SELECT a.pattern, b.pattern AS larger, len([e for e in b.es if list_contains(a.ns, split_part(e, '>', 1)) AND list_contains(a.ns, split_part(e, '>', 2))]) AS n
      FROM pat a JOIN pat b ON a.pes = b.pes AND a.pattern <> b.pattern AND list_has_all(b.es, a.es))
    SELECT pattern, NOT EXISTS (SELECT 1 FROM inner_edges i WHERE i.pattern = pat.pattern AND i.n = pat.n_edges) AS kept FROM pat""",
)
def subsumed_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.subsumed(mining.hit_sets(_hits(spark, sf_dir))).select(_pairs("signature").alias("pattern"), "kept")


@query(
    "behaviour_matrix",
    f"""WITH {A}, {U}, {HITS_SQL} SELECT pe_id, CAST(max(CASE WHEN pattern_id = 'click>view' THEN 1 ELSE 0 END) AS INTEGER) AS b1, CAST(max(CASE WHEN pattern_id = 'view>view' THEN 1 ELSE 0 END) AS INTEGER) AS b2 FROM hits GROUP BY 1""",
)
def behaviour_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.behaviour_matrix(quick_pairs(stream_log(spark, sf_dir)).withColumnRenamed("pattern_id", "signature"), ["click>view", "view>view"])


@query(
    "pattern_scores",
    KPI_SQL + f""", {PATTERN_SQL}, kp AS (SELECT pe_id, 'duration' AS kpi, duration AS value FROM k UNION ALL SELECT pe_id, 'n_events', CAST(n_events AS DOUBLE) FROM k), tot AS (SELECT kpi, count(*) AS n, sum(value) AS s FROM kp GROUP BY 1),
    i AS (SELECT array_to_string(es, ',') AS pattern, kpi, count(*) AS support, sum(value) AS s_in FROM ind JOIN kp USING (pe_id) GROUP BY 1, 2)
    SELECT pattern, kpi, support, round(s_in / support, 3) AS mu_in, round((s - s_in) / (n - support), 3) AS mu_out FROM i JOIN tot USING (kpi) WHERE support BETWEEN 2 AND 10000 AND support < n""",
)
def pattern_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all patterns, whatever their rank."""
    log = stream_log(spark, sf_dir)
    values = kpi.long(kpi.builtin(log, user_executions(log)), ["duration", "n_events"])
    scored = mining.score(_hits(spark, sf_dir), values, 2, 10_000, 1 << 30)
    return scored.select(_pairs("pattern_id").alias("pattern"), "kpi", "support", F.round("mu_in", 3).alias("mu_in"), F.round("mu_out", 3).alias("mu_out"))


# --- trees and explorer --------------------------------------------------------------------


@query(
    "relation_pairs",
    f"""WITH {A}, {U}, {HITS_SQL}, n AS (SELECT pattern_id, count(*) AS n FROM hits GROUP BY 1), x AS (SELECT count(DISTINCT pe_id) AS tot FROM pe),
    p AS (SELECT a.pattern_id AS a, b.pattern_id AS b, a.n AS n_a, b.n AS n_b, (SELECT count(*) FROM hits h JOIN hits g ON h.pe_id = g.pe_id WHERE h.pattern_id = a.pattern_id AND g.pattern_id = b.pattern_id) AS n_both FROM n a JOIN n b ON a.pattern_id < b.pattern_id)
    SELECT a, b, n_a, n_b, n_both, CASE WHEN n_a = tot OR n_b = tot THEN 'trivial' WHEN n_both = 0 AND n_a + n_b = tot THEN 'complement' WHEN n_both = 0 THEN 'mutually_exclusive' WHEN n_both = n_a AND n_both = n_b THEN 'equivalent'
    WHEN n_both = n_a THEN 'implies_a_to_b' WHEN n_both = n_b THEN 'implies_b_to_a' ELSE 'overlap' END AS relation FROM p, x""",
)
def relation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stream_log(spark, sf_dir)
    n = user_executions(log).select("pe_id").distinct().count()
    return tree.relations(quick_pairs(log), n)


def _tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stream_log(spark, sf_dir)
    found = quick_pairs(log).groupBy("pe_id").agg(F.sort_array(F.collect_set("pattern_id")).alias("features"))
    return kpi.builtin(log, user_executions(log)).select("pe_id", F.col("n_events").cast("double").alias("y")).join(found, "pe_id", "left").select("pe_id", "y", F.coalesce("features", F.array().cast("array<string>")).alias("features"))


def _tree_level(i: int) -> str:
    """One level of the tree in SQL: a leaf is a path of 0 (absent) and 1, so paths in order are leaves in order."""
    return f"""t{i} AS (SELECT path, count(*) AS n, sum(y) AS s FROM v{i} GROUP BY 1),
    o{i} AS (SELECT path, f, count(*) AS n1, sum(y) AS s1 FROM v{i} JOIN hits USING (pe_id), unnest([pattern_id]) u(f) GROUP BY 1, 2),
    d{i} AS (SELECT path, f, round(s1 * s1 / n1 + (s - s1) * (s - s1) / (n - n1) - s * s / n, 9) AS gain FROM o{i} JOIN t{i} USING (path) WHERE n1 >= 5 AND n - n1 >= 5),
    w{i} AS (SELECT path, f FROM d{i} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY gain DESC, f) = 1),
    v{i + 1} AS MATERIALIZED (SELECT v.pe_id, y, v.path || CASE WHEN f IS NULL THEN '' WHEN h.pe_id IS NULL THEN '0' ELSE '1' END AS path FROM v{i} v LEFT JOIN w{i} w ON w.path = v.path LEFT JOIN hits h ON h.pe_id = v.pe_id AND h.pattern_id = f)"""


TREE_SQL = KPI_SQL + f", {HITS_SQL}, v0 AS (SELECT pe_id, CAST(n_events AS DOUBLE) AS y, '' AS path FROM k), {', '.join(map(_tree_level, range(3)))}, leaves AS (SELECT pe_id, y, CAST(dense_rank() OVER (ORDER BY path) - 1 AS INT) AS leaf, avg(y) OVER (PARTITION BY path) AS p FROM v3)"


@query("leaf_members", TREE_SQL + " SELECT pe_id, y, leaf, 'ok' AS status FROM leaves")
def leaf_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, root, rows = tree.fit(_tree_rows(spark, sf_dir), 3, 5)
    return rows.select("pe_id", "y", "leaf").withColumn("status", F.lit(status))


@query("tree_quality", TREE_SQL + " SELECT round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(y - p)), 6) AS mae, round(max(p) - min(p), 6) AS gap, count(*) AS n FROM leaves")
def tree_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that gives no tree has its status instead."""
    status, root, rows = tree.fit(_tree_rows(spark, sf_dir), 3, 5)
    if root is None:
        return spark.createDataFrame([(status,)], "status string")
    return tree.quality(root, rows).select(*[F.round(c, 6).alias(c) for c in ("r2", "mae", "gap")], "n")


CROSS_SQL = f"""WITH {A}, {U}, m AS (SELECT 'first' AS tree, arg_min(activity, (ts, event_id)) AS leaf, pe_id FROM pe JOIN ev USING (event_id) GROUP BY pe_id UNION SELECT DISTINCT 'user', right(pe_id, 1), pe_id FROM pe),
x AS (SELECT a.tree AS tree_a, a.leaf AS leaf_a, b.tree AS tree_b, b.leaf AS leaf_b, count(*) AS n_both FROM m a JOIN m b ON a.pe_id = b.pe_id AND a.tree <> b.tree GROUP BY 1, 2, 3, 4),
s AS (SELECT *, n_both / sum(n_both) OVER (PARTITION BY tree_a, leaf_a, tree_b) AS share FROM x)
"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways to split the users: by their first activity, and by the last digit."""
    log = stream_log(spark, sf_dir)
    pe = user_executions(log)
    first = F.min_by("activity", F.struct("ts", "event_id")).alias("leaf")
    acts = pe.join(log.events, "event_id").groupBy("pe_id").agg(first).select(F.lit("first").alias("tree"), "leaf", "pe_id")
    return acts.union(pe.select(F.lit("user"), F.substring("pe_id", -1, 1), "pe_id")).distinct()


@query("cross_leaf", CROSS_SQL + "SELECT tree_a, leaf_a, tree_b, leaf_b, n_both, round(share, 6) AS share, round(-sum(share * log2(share)) OVER (PARTITION BY tree_a, leaf_a, tree_b), 6) AS entropy FROM s")
def cross_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tree.overlaps(_members(spark, sf_dir))
    return out.withColumns({"share": r6("share"), "entropy": r6("entropy")})


@query("compact_cross", CROSS_SQL + "SELECT tree_a, leaf_a, tree_b, leaf_b, n_both, count(*) OVER w AS n_leaves FROM s WINDOW w AS (PARTITION BY tree_a, leaf_a, tree_b) QUALIFY row_number() OVER (PARTITION BY tree_a, leaf_a, tree_b ORDER BY n_both DESC, leaf_b) = 1")
def compact_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.compact_cross(tree.overlaps(_members(spark, sf_dir))).select("tree_a", "leaf_a", "tree_b", "leaf_b", "n_both", "n_leaves")


@query(
    "situation",
    KPI_SQL + f""", {HITS_SQL}, z AS (SELECT pe_id, max(CASE WHEN pattern_id = 'click>view' THEN 'Y' ELSE 'N' END) AS b1 FROM hits GROUP BY 1)
    SELECT k.pe_id, duration, CAST(n_events AS DOUBLE) AS n_events, coalesce(b1, 'N') AS b1 FROM k LEFT JOIN z USING (pe_id)""",
)
def situation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.operators import explorer

    log = stream_log(spark, sf_dir)
    values = kpi.long(kpi.builtin(log, user_executions(log)), ["duration", "n_events"])
    hits = quick_pairs(log).withColumn("config_id", F.lit(0))
    bundle = explorer.Bundle(hits, hits, hits, values, hits, hits, hits, hits)
    return explorer.situation(bundle, 0, ["click>view"], ["duration", "n_events"])


@query(
    "config_ranking",
    f"""WITH {A}, k AS (SELECT activity, object_id, count(*) AS n FROM timed WHERE object_type = 'user' GROUP BY 1, 2),
    c AS (SELECT activity AS config, CAST(max(n) - min(n) AS DOUBLE) AS gap, min(n) / max(n) AS r2, count(*) AS pairs FROM k GROUP BY 1)
    SELECT config, gap, r2, pairs, round(0.6 * coalesce(gap / nullif(max(gap) OVER (), 0), 0) + 0.3 * r2 + 0.1 * pairs / max(pairs) OVER (), 6) AS score FROM c""",
)
def config_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities as configurations: the spread of their counts over users, how even they are, and how many users have them."""
    n = stream_log(spark, sf_dir).timed().where("object_type = 'user'").groupBy(F.col("activity").alias("config"), "object_id").agg(F.count(F.lit(1)).alias("n"))
    low, high = F.min("n"), F.max("n")
    rows = n.groupBy("config").agg((high - low).cast("double").alias("gap"), (low / high).alias("r2"), F.count(F.lit(1)).alias("pairs"))
    return tree.rank_configs(rows).withColumn("score", r6("score"))


# --- variants, restructuring, nets ---------------------------------------------------------


#: An order's events are a path, in which each has one place; graphs are isomorphic if they are equal by places.
VARIANT_SQL = f"""WITH {B}, r AS (SELECT DISTINCT p.object_id AS pe_id, timed.event_id, timed.object_id, timed.object_type, timed.activity, timed.ts FROM e2o p JOIN timed ON timed.event_id = p.event_id WHERE p.object_type = 'order'),
n AS (SELECT pe_id, event_id, activity || ': ' || string_agg(object_type, ': ' ORDER BY object_type) AS node, row_number() OVER (PARTITION BY pe_id ORDER BY ts, event_id) AS place FROM r GROUP BY pe_id, event_id, activity, ts),
l AS (SELECT pe_id, object_type, lag(event_id) OVER w AS src, event_id AS dst FROM r WINDOW w AS (PARTITION BY pe_id, object_id ORDER BY ts, event_id)),
e AS (SELECT pe_id, src, dst, string_agg(object_type, ': ' ORDER BY object_type) AS label FROM l WHERE src IS NOT NULL GROUP BY 1, 2, 3),
g AS (SELECT e.pe_id, list({{'s': a.place, 't': b.place, 'label': label}} ORDER BY a.place, b.place) AS edges FROM e JOIN n a ON a.pe_id = e.pe_id AND a.event_id = src JOIN n b ON b.pe_id = e.pe_id AND b.event_id = dst GROUP BY 1),
v AS (SELECT pe_id, nodes, edges FROM (SELECT pe_id, list(node ORDER BY place) AS nodes FROM n GROUP BY 1) LEFT JOIN g USING (pe_id))
"""


@query("variants", VARIANT_SQL + "SELECT count(*) AS n, min(pe_id) AS example, count(*) / (SELECT count(*) FROM v)::DOUBLE AS share FROM v GROUP BY nodes, edges")
def variant_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = commerce_log(spark, sf_dir)
    return variants.frequencies(written(variants.seen_variants(executions.cases_by(log, "order")), "variants")).select("n", "example", "share")


@query(
    "variant_layout",
    VARIANT_SQL
    + """, o AS (SELECT pe_id, event_id, object_type, object_id, dense_rank() OVER (PARTITION BY pe_id ORDER BY object_type, object_id) - 1 AS lane FROM r)
    SELECT pe_id, event_id, activity, CAST(place - 1 AS INT) AS x, CAST(place - 1 AS INT) AS x_end, lanes FROM n JOIN (SELECT pe_id, event_id, string_agg(lane, ',' ORDER BY object_type, object_id) AS lanes FROM o GROUP BY 1, 2) USING (pe_id, event_id) JOIN ev USING (event_id)""",
)
def variant_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's events are a path, so every event ends where it starts."""
    log = commerce_log(spark, sf_dir)
    return variants.seen_layout(executions.cases_by(log, "order")).withColumn("lanes", F.array_join(F.col("lanes").cast("array<string>"), ","))


@query(
    "functional_mapping",
    f"""WITH {B}, n AS (SELECT a.object_id AS source_id, b.object_id AS target_id, count(DISTINCT a.event_id) AS n FROM e2o a JOIN e2o b ON a.event_id = b.event_id WHERE a.object_type = 'part' AND b.object_type = 'supplier' GROUP BY 1, 2),
    k AS (SELECT source_id, target_id FROM n QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY n DESC, target_id) = 1) SELECT o.object_id AS source_id, coalesce(target_id, 'no_supplier') AS target_id FROM obj o LEFT JOIN k ON k.source_id = o.object_id WHERE o.object_type = 'part'""",
)
def functional_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restructure.functional_mapping(commerce_log(spark, sf_dir), "part", "supplier", "most_frequent")


@query(
    "absorption",
    f"WITH {B}, k AS (SELECT 'order:' || CAST(l_orderkey AS VARCHAR) AS object_id, max('item:' || item) AS item FROM li GROUP BY 1) SELECT o.object_id, CASE WHEN k.item IS NULL THEN 'no_item' ELSE k.item END AS item FROM obj o LEFT JOIN k USING (object_id) WHERE o.object_type = 'order'",
)
def absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = restructure.absorb(commerce_log(spark, sf_dir), ["item"])
    return log.objects.where("object_type = 'order'").select("object_id", F.try_element_at("attrs", F.lit("item")).alias("item"))


@query("type_lattice", f"WITH {B}, m AS (SELECT DISTINCT 'item:' || item AS source_id, 'customer:' || CAST(o_custkey AS VARCHAR) AS target_id FROM li JOIN orders ON o_orderkey = l_orderkey) SELECT o.object_id AS source_id, m.target_id FROM obj o JOIN m ON m.source_id = o.object_id WHERE o.object_type = 'item'")
def type_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = restructure.TypeGraph([("item", "order"), ("order", "customer")])
    return restructure.rooted_lattice(commerce_log(spark, sf_dir), graph, "item")["customer"]


def small_net(log: Log) -> petri.Net:
    return petri.discover(log, ["order", "customer"])


@query("discovery")
def discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_net(commerce_log(spark, sf_dir)).tables(spark)[2]


@query("net_reduction")
def net_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return petri.reduce(small_net(commerce_log(spark, sf_dir)).on_types(["order"])).tables(spark)[2]


@query("token_replay")
def token_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = commerce_log(spark, sf_dir)
    return replay.fitness(log, small_net(log))


@query("replay_performance")
def replay_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = commerce_log(spark, sf_dir)
    times = performance.replay_times(replay.token_visits(log, small_net(log)), log)
    return performance.by_activity(times, "sojourn", ["avg", "max"])


@query(
    "contexts",
    f"""WITH {B}, t AS (SELECT p.object_id AS pe_id, timed.*, dense_rank() OVER (PARTITION BY p.object_id ORDER BY ts, timed.event_id) AS r FROM e2o p JOIN timed ON timed.event_id = p.event_id WHERE p.object_type = 'order'),
    e AS (SELECT DISTINCT pe_id, event_id, r FROM t),
    o AS (SELECT e.pe_id, e.event_id, t.object_type || ':' || coalesce(string_agg(t.activity, '>' ORDER BY t.r) FILTER (t.r < e.r), '') AS p FROM e JOIN t ON t.pe_id = e.pe_id AND t.r <= e.r GROUP BY e.pe_id, e.event_id, t.object_type, t.object_id),
    c AS (SELECT pe_id, event_id, string_agg(p, '|' ORDER BY p) AS context FROM o GROUP BY 1, 2) SELECT context, count(*) AS n FROM c GROUP BY 1""",
)
def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts in the executions of all orders, with all objects; an order's events all come before its next one."""
    log = commerce_log(spark, sf_dir)
    pe = traces.flatten(log, "order").select(F.col("case_id").alias("pe_id"), "event_id")
    text = F.transform("context", lambda c: F.concat(c["object_type"], F.lit(":"), F.array_join(c["activities"], ">")))
    return replay.contexts(log, pe).groupBy(F.array_join(F.sort_array(text), "|").alias("context")).agg(F.count(F.lit(1)).alias("n"))


@query("precision_fitness")
def precision_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = commerce_log(spark, sf_dir)
    own = log.on_types(["order"])
    return replay.found_fitness(executions.cases_by(own, "order"), petri.discover(own, ["order"]))


@query(
    "impact_performance",
    f"""WITH {B}, e AS (SELECT * FROM ev WHERE ts BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'), g AS (SELECT * FROM ev WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'),
    fe AS (SELECT DISTINCT src, dst FROM (SELECT lag(e.event_id) OVER w AS src, e.event_id AS dst FROM e JOIN e2o USING (event_id) WINDOW w AS (PARTITION BY object_type, object_id ORDER BY ts, e.event_id)) WHERE src IS NOT NULL),
    fg AS (SELECT DISTINCT src, dst FROM (SELECT lag(g.event_id) OVER w AS src, g.event_id AS dst FROM g JOIN e2o USING (event_id) WINDOW w AS (PARTITION BY object_type, object_id ORDER BY ts, g.event_id)) WHERE src IS NOT NULL),
    a AS (SELECT activity, avg(v) AS before FROM (SELECT d.activity, CAST(d.us - max(s.us) AS DOUBLE) / 1e6 AS v FROM fe JOIN ev s ON s.event_id = src JOIN ev d ON d.event_id = dst GROUP BY fe.dst, d.activity, d.us) GROUP BY 1),
    b AS (SELECT activity, avg(v) AS after FROM (SELECT d.activity, CAST(d.us - max(s.us) AS DOUBLE) / 1e6 AS v FROM fg JOIN ev s ON s.event_id = src JOIN ev d ON d.event_id = dst GROUP BY fg.dst, d.activity, d.us) GROUP BY 1)
    SELECT activity, round(before, 3) AS before, round(after, 3) AS after, round(after - before, 3) AS delta FROM a FULL JOIN b USING (activity)""",
)
def impact_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = commerce_log(spark, sf_dir)
    out = impact.performance_change(log, "sojourn", (datetime(1995, 1, 1), datetime(1995, 12, 31)), (datetime(1996, 1, 1), datetime(1996, 12, 31)))
    return out.select("activity", *[F.round(c, 3).alias(c) for c in ("before", "after", "delta")])


@query(
    "interval_patterns",
    f"""WITH {A}, i AS (SELECT activity AS name, us AS s, us + 60000000 AS e FROM ev WHERE activity IN ('signup', 'error')) SELECT count(*) AS n, min(a.s) AS first FROM i a JOIN i b ON a.name = 'signup' AND b.name = 'error' AND a.e < b.s""",
)
def interval_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stream_log(spark, sf_dir)
    us = traces.micros("ts")
    instances = log.events.select(F.col("activity").alias("name"), us.alias("start"), (us + 60_000_000).alias("end"))
    return impact.count_before(instances, "signup", "error")


@query("workflow")
def workflow_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations of a whole run over the orders' attributes, with their patterns and best differences."""
    from braidlog.operators import explorer
    from braidlog.plans import workflow

    log = order_log(spark, sf_dir).without_types(["customer", "item"])
    bundle, _ = workflow.run(log, "order", ["order"], ["duration"], 0.02, 0.9, 2)
    return explorer.lattice(bundle)


@query(
    "metric_table",
    f"""WITH {A}, t AS (SELECT object_id, list(activity ORDER BY ts, event_id) AS acts FROM timed WHERE object_type = 'key' GROUP BY 1),
    p AS (SELECT acts, coalesce(list_position(acts, 'view'), 0) AS a, coalesce(list_position(acts, 'click'), 0) AS b FROM t),
    q AS (SELECT unnest([
      {{'k': 'existence', 'ok': a > 0}}, {{'k': 'non_existence', 'ok': a = 0}}, {{'k': 'coexistence', 'ok': (a > 0) = (b > 0)}}, {{'k': 'exclusiveness', 'ok': NOT (a > 0 AND b > 0)}},
      {{'k': 'choice', 'ok': a > 0 OR b > 0}}, {{'k': 'xor_choice', 'ok': (a > 0) <> (b > 0)}}, {{'k': 'followed_by', 'ok': a = 0 OR (b > 0 AND a < b)}},
      {{'k': 'directly_followed_by', 'ok': a = 0 OR coalesce(acts[a + 1] = 'click', false)}}, {{'k': 'precedence', 'ok': b = 0 OR (a > 0 AND a < b)}}, {{'k': 'block', 'ok': NOT (a > 0 AND b > 0) OR b < a}}]) AS m FROM p),
    s AS (SELECT CAST(count(*) FILTER (src_activity = 'view' AND dst_activity = 'click') AS DOUBLE) AS ab, CAST(count(*) FILTER (src_activity = 'click' AND dst_activity = 'view') AS DOUBLE) AS ba FROM fol WHERE object_type = 'key'),
    h AS (SELECT CAST(count(*) FILTER (a > 0) AS DOUBLE) AS na, CAST(count(*) FILTER (b > 0) AS DOUBLE) AS nb, count(*) FILTER (a > 0 AND b > 0) AS nab FROM p),
    i AS (SELECT ev.event_id, activity, count(DISTINCT object_id) AS n FROM ev LEFT JOIN e2o ON e2o.event_id = ev.event_id AND object_type = 'key' GROUP BY 1, 2),
    x AS (SELECT activity, unnest([{{'k': 'absence', 'v': avg(CAST(n = 0 AS INT))}}, {{'k': 'singular', 'v': avg(CAST(n = 1 AS INT))}}, {{'k': 'multiple', 'v': avg(CAST(n > 1 AS INT))}}, {{'k': 'presence', 'v': avg(CAST(n > 0 AS INT))}}]) AS m FROM i GROUP BY 1),
    n AS (SELECT eog.dst, s.us AS u, EXISTS (SELECT 1 FROM e2o WHERE e2o.event_id = eog.src AND object_type = 'key') AS has FROM eog JOIN ev s ON s.event_id = eog.src),
    g AS (SELECT dst, min(u) AS f, max(u) AS l, min(CASE WHEN has THEN u END) AS tf, max(CASE WHEN has THEN u END) AS tl FROM n GROUP BY 1),
    z AS (SELECT activity, unnest([{{'k': 'flow', 'v': avg(us - f)}}, {{'k': 'sojourn', 'v': avg(us - l)}}, {{'k': 'synchronization', 'v': avg(l - f)}}, {{'k': 'pooling', 'v': avg(tl - tf)}},
      {{'k': 'lagging', 'v': avg(tl - f)}}, {{'k': 'readiness', 'v': avg(tf - f)}}, {{'k': 'elapsed', 'v': avg(us - l)}}]) AS m FROM g JOIN ev ON ev.event_id = g.dst GROUP BY 1)
    SELECT m.k AS kind, 'key' AS object_type, 'view' AS source, 'click' AS target, round(avg(CAST(m.ok AS INT)), 3) AS value FROM q GROUP BY 1
    UNION ALL SELECT 'strength_causal', 'key', 'view', 'click', round((ab - ba) / (ab + ba), 3) FROM s UNION ALL SELECT 'strength_concurrency', 'key', 'view', 'click', round(1 - abs(ab - ba) / (ab + ba), 3) FROM s
    UNION ALL SELECT 'strength_choice', 'key', 'view', 'click', round(1 - 2 * nab / (na + nb), 3) FROM h
    UNION ALL SELECT m.k, 'key', activity, NULL, round(m.v, 3) FROM x UNION ALL SELECT m.k, 'key', activity, NULL, round(m.v / 1e6, 3) FROM z WHERE m.v IS NOT NULL""",
)
def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.operators import constraints

    return constraints.metric_table(stream_log(spark, sf_dir), "key", [("view", "click")]).withColumn("value", F.round("value", 3))


@query("correlated_graphs", f"WITH {B} SELECT min(event_id) OVER (PARTITION BY object_id) AS pe_id, src, event_id AS dst FROM (SELECT object_id, event_id, lag(event_id) OVER (PARTITION BY object_id ORDER BY ts, event_id) AS src FROM timed WHERE object_type = 'order') QUALIFY src IS NOT NULL")
def correlated_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = commerce_log(spark, sf_dir)
    return executions.correlated_orders(log.on_types(["order"]), "order")


@query("subprocess_edges", f"WITH {B} SELECT src, dst FROM eog JOIN ev a ON a.event_id = src JOIN ev b ON b.event_id = dst WHERE a.activity = 'ship_item' AND b.activity = 'ship_item'")
def subprocess_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.subprocess_edges(commerce_log(spark, sf_dir), ["ship_item"])


@query("type_edges", f"WITH {B}, h AS (SELECT DISTINCT event_id FROM e2o WHERE object_type = 'customer') SELECT src, dst FROM eog WHERE src IN (SELECT event_id FROM h) AND dst IN (SELECT event_id FROM h)")
def type_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.type_edges(commerce_log(spark, sf_dir), ["customer"])
