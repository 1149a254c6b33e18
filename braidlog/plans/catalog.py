"""Queries over the derived logs, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.operators import constraints, executions, filters, kpi, performance, relations, traces
from braidlog.sources.tables import commerce_log, stream_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The stream log in SQL.
A = """
ev AS (SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS activity, ts, epoch_us(ts) AS us, value FROM events),
e2o AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, 'user:' || CAST(user_id AS VARCHAR) AS object_id, 'user' AS object_type FROM events
  UNION ALL SELECT CAST(event_id AS VARCHAR), 'key:' || json_extract_string(props, '$.k'), 'key' FROM events
),
obj AS (SELECT DISTINCT object_id, object_type FROM e2o),
timed AS (SELECT e2o.*, activity, ts, us FROM e2o JOIN ev USING (event_id)),
fol AS (
  SELECT * FROM (
    SELECT object_type, object_id, lag(event_id) OVER w AS src, event_id AS dst, lag(activity) OVER w AS src_activity, activity AS dst_activity, lag(us) OVER w AS src_us, us AS dst_us
    FROM timed WINDOW w AS (PARTITION BY object_type, object_id ORDER BY ts, event_id)
  ) WHERE src IS NOT NULL
),
eog AS (SELECT DISTINCT src, dst FROM fol)
"""
#: The commerce log in SQL.
B = """
li AS (
  SELECT *, CAST(l_orderkey AS VARCHAR) || '-' || CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS VARCHAR) AS item FROM lineitem
),
ev AS (
  SELECT 'po-' || CAST(o_orderkey AS VARCHAR) AS event_id, 'place_order' AS activity, o_orderdate AS ts, epoch_us(o_orderdate) AS us FROM orders
  UNION ALL SELECT 'si-' || item, 'ship_item', l_shipdate, epoch_us(l_shipdate) FROM li
),
e2o AS (
  SELECT 'po-' || CAST(o_orderkey AS VARCHAR) AS event_id, 'order:' || CAST(o_orderkey AS VARCHAR) AS object_id, 'order' AS object_type FROM orders
  UNION ALL SELECT 'po-' || CAST(o_orderkey AS VARCHAR), 'customer:' || CAST(o_custkey AS VARCHAR), 'customer' FROM orders
  UNION ALL SELECT 'si-' || item, 'order:' || CAST(l_orderkey AS VARCHAR), 'order' FROM li
  UNION ALL SELECT 'si-' || item, 'item:' || item, 'item' FROM li
  UNION ALL SELECT 'si-' || item, 'part:' || CAST(l_partkey AS VARCHAR), 'part' FROM li
  UNION ALL SELECT 'si-' || item, 'supplier:' || CAST(l_suppkey AS VARCHAR), 'supplier' FROM li
),
obj AS (
  SELECT 'order:' || CAST(o_orderkey AS VARCHAR) AS object_id, 'order' AS object_type FROM orders
  UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR), 'customer' FROM customer
  UNION ALL SELECT 'item:' || item, 'item' FROM li
  UNION ALL SELECT 'part:' || CAST(p_partkey AS VARCHAR), 'part' FROM part
  UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR), 'supplier' FROM supplier
),
timed AS (SELECT e2o.*, activity, ts, us FROM e2o JOIN ev USING (event_id)),
fol AS (
  SELECT * FROM (
    SELECT object_type, object_id, lag(event_id) OVER w AS src, event_id AS dst, lag(activity) OVER w AS src_activity, activity AS dst_activity, lag(us) OVER w AS src_us, us AS dst_us
    FROM timed WINDOW w AS (PARTITION BY object_type, object_id ORDER BY ts, event_id)
  ) WHERE src IS NOT NULL
),
eog AS (SELECT DISTINCT src, dst FROM fol),
adj AS (
  SELECT DISTINCT s.source_id, a.object_type AS source_type, s.target_id, b.object_type AS target_type
  FROM (SELECT 'order:' || CAST(l_orderkey AS VARCHAR) AS source_id, 'item:' || item AS target_id FROM li UNION ALL SELECT 'item:' || item, 'order:' || CAST(l_orderkey AS VARCHAR) FROM li) s
  JOIN obj a ON a.object_id = s.source_id JOIN obj b ON b.object_id = s.target_id
)
"""
#: Users' executions of the stream log: every user is one.
U = "pe AS (SELECT object_id AS pe_id, event_id FROM e2o WHERE object_type = 'user')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def r6(column) -> F.Column:
    return F.round(column, 6)


def user_executions(log) -> DataFrame:
    """One execution for each user of the stream log."""
    return log.e2o.where("object_type = 'user'").select(F.col("object_id").alias("pe_id"), "event_id")


# --- traces and graphs ---------------------------------------------------------------------


def _dfg(log, kind: str) -> DataFrame:
    return traces.directly_follows(log, kind).select("src_activity", "dst_activity", "n", r6(F.col("gap_us").cast("double") / F.col("n") / 1e6).alias("mean_gap"))


DFG_SQL = "SELECT src_activity, dst_activity, count(*) AS n, round(CAST(sum(dst_us - src_us) AS DOUBLE) / count(*) / 1e6, 6) AS mean_gap FROM fol WHERE object_type = '{0}' GROUP BY 1, 2"


@query("dfg_user", f"WITH {A} " + DFG_SQL.format("user"))
def dfg_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dfg(stream_log(spark, sf_dir), "user")


@query("dfg_key", f"WITH {A} " + DFG_SQL.format("key"))
def dfg_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dfg(stream_log(spark, sf_dir), "key")


@query("dfg_order", f"WITH {B} " + DFG_SQL.format("order"))
def dfg_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dfg(commerce_log(spark, sf_dir), "order")


@query("traces", f"WITH {A} SELECT object_type, object_id, string_agg(activity, '>' ORDER BY ts, event_id) AS trace, count(*) AS n_events FROM timed GROUP BY 1, 2")
def trace_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces.traces(stream_log(spark, sf_dir))
    return t.select("object_type", "object_id", F.array_join(F.transform("trace", lambda s: s["activity"]), ">").alias("trace"), "n_events")


@query("eog_edges", f"WITH {B} SELECT src, dst FROM eog")
def eog_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.event_graph(commerce_log(spark, sf_dir))


@query(
    "start_end_activities",
    f"""WITH {A}, r AS (SELECT object_type, activity, row_number() OVER (PARTITION BY object_type, object_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY object_type, object_id) AS n FROM timed)
    SELECT object_type, activity, CAST(sum(CASE WHEN i = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_start, CAST(sum(CASE WHEN i = n THEN 1 ELSE 0 END) AS BIGINT) AS n_end FROM r GROUP BY 1, 2""",
)
def start_end_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.start_end(stream_log(spark, sf_dir))


@query(
    "object_cooccurrence",
    f"WITH {A} SELECT a.object_id AS a, a.object_type AS a_type, b.object_id AS b, b.object_type AS b_type, count(*) AS n FROM e2o a JOIN e2o b ON a.event_id = b.event_id AND a.object_id < b.object_id GROUP BY 1, 2, 3, 4",
)
def object_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.cooccurrence(stream_log(spark, sf_dir))


@query(
    "later_event_graph",
    f"""WITH {A}, nx AS (SELECT event_id, object_id, ts, lead(struct_pack(ts := ts, event_id := event_id)) OVER (PARTITION BY object_type, object_id ORDER BY ts, event_id) AS nxt FROM timed),
    hz AS (SELECT event_id, CASE WHEN count(nxt) = count(*) THEN max(nxt) END AS horizon, min(ts) AS t FROM nx GROUP BY 1)
    SELECT DISTINCT l.event_id AS src, r.event_id AS dst FROM e2o l JOIN hz ON hz.event_id = l.event_id JOIN timed r ON r.object_id = l.object_id
    WHERE (r.ts, r.event_id) > (hz.t, l.event_id) AND (hz.horizon IS NULL OR (r.ts, r.event_id) <= (hz.horizon.ts, hz.horizon.event_id))""",
)
def later_event_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.later_events(stream_log(spark, sf_dir))


@query("flatten_type", f"WITH {B} SELECT object_id AS case_id, event_id, activity, us FROM timed WHERE object_type = 'customer'")
def flatten_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.flatten(commerce_log(spark, sf_dir), "customer").select("case_id", "event_id", "activity", traces.micros("ts").alias("us"))


@query("o2o_adjacency", f"WITH {B} SELECT * FROM adj")
def o2o_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.o2o_adjacency(commerce_log(spark, sf_dir))


@query(
    "k_sequences",
    f"""WITH {A}, s AS (SELECT object_id, event_id, activity, lag(activity) OVER w AS p1, lag(activity, 2) OVER w AS p2 FROM timed WHERE object_type = 'user' WINDOW w AS (PARTITION BY object_id ORDER BY ts, event_id))
    SELECT p2 || '>' || p1 || '>' || activity AS run, count(*) AS n FROM s WHERE p2 IS NOT NULL GROUP BY 1""",
)
def k_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = traces.path_sequences(stream_log(spark, sf_dir), 3).where("object_type = 'user'")
    return runs.groupBy(F.array_join("run", ">").alias("run")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "object_counts_per_activity",
    f"WITH {B}, n AS (SELECT event_id, activity, count(DISTINCT object_id) AS n FROM timed WHERE object_type = 'part' GROUP BY 1, 2) SELECT activity, count(*) AS n_events, CAST(sum(n) AS BIGINT) AS n_objects FROM n GROUP BY 1",
)
def object_counts_per_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = traces.object_counts(commerce_log(spark, sf_dir), "part")
    return counts.select("activity", F.size("counts").cast("long").alias("n_events"), F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_objects"))


# --- executions ----------------------------------------------------------------------------

LEAD_SQL = f"""WITH {B}, e AS (SELECT * FROM e2o WHERE object_type NOT IN ('part', 'supplier')),
l0 AS (SELECT DISTINCT object_id AS pe_id, object_id FROM e WHERE object_type = 'order'),
l1 AS (SELECT DISTINCT l0.pe_id, b.object_id, b.object_type FROM l0 JOIN e a ON a.object_id = l0.object_id JOIN e b ON b.event_id = a.event_id WHERE b.object_type <> 'order'),
l2 AS (
  SELECT DISTINCT l1.pe_id, b.object_id, b.object_type FROM l1 JOIN e a ON a.object_id = l1.object_id JOIN e b ON b.event_id = a.event_id
  WHERE b.object_type <> 'order' AND NOT EXISTS (SELECT 1 FROM l1 x WHERE x.pe_id = l1.pe_id AND x.object_type = b.object_type)
),
pobj AS (SELECT pe_id, object_id FROM l0 UNION SELECT pe_id, object_id FROM l1 UNION SELECT pe_id, object_id FROM l2),
pe AS (SELECT DISTINCT pe_id, event_id FROM pobj JOIN e USING (object_id))
"""


def order_log(spark: SparkSession, sf_dir: str):
    """The commerce log without its hub objects."""
    return commerce_log(spark, sf_dir).without_types(["part", "supplier"])


@query("leading_executions", LEAD_SQL + "SELECT pe_id, count(*) AS n_events, min(event_id) AS first_event, max(event_id) AS last_event FROM pe GROUP BY 1")
def leading_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pe = executions.leading_executions(order_log(spark, sf_dir), "order")
    return pe.groupBy("pe_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("leading_objects", LEAD_SQL + "SELECT pe_id, count(*) AS n_objects FROM pobj GROUP BY 1")
def leading_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executions.leading_objects(order_log(spark, sf_dir), "order").groupBy("pe_id").agg(F.count(F.lit(1)).alias("n_objects"))


@query(
    "cc_executions",
    f"""WITH {B}, e AS (SELECT * FROM e2o WHERE object_type IN ('order', 'customer', 'item')), c AS (SELECT o_orderkey, o_custkey FROM orders),
    k AS (SELECT event_id, coalesce(c.o_custkey, -1) AS cust, e.object_id FROM e LEFT JOIN c ON e.object_type = 'order' AND e.object_id = 'order:' || CAST(c.o_orderkey AS VARCHAR) WHERE e.object_type = 'order'),
    g AS (SELECT event_id, CASE WHEN cust >= 0 THEN 'c' || CAST(cust AS VARCHAR) ELSE object_id END AS grp FROM k)
    SELECT min(event_id) OVER (PARTITION BY grp) AS pe_id, event_id FROM g""",
)
def cc_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executions.component_executions(order_log(spark, sf_dir)).select("pe_id", "event_id")


@query(
    "execution_sizes",
    f"WITH {A}, {U} SELECT pe.pe_id, count(DISTINCT pe.event_id) AS n_events, count(DISTINCT e2o.object_id) AS n_objects FROM pe JOIN e2o ON e2o.event_id = pe.event_id GROUP BY 1",
)
def execution_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stream_log(spark, sf_dir)
    return executions.sizes(log, user_executions(log))


@query(
    "execution_edges",
    f"""WITH {A}, {U}, t AS (SELECT pe.pe_id, timed.* FROM pe JOIN timed ON timed.event_id = pe.event_id),
    f AS (SELECT pe_id, lag(event_id) OVER (PARTITION BY pe_id, object_type, object_id ORDER BY ts, event_id) AS src, event_id AS dst FROM t)
    SELECT pe_id, count(*) AS n_edges, count(DISTINCT src || '>' || dst) AS n_pairs FROM f WHERE src IS NOT NULL GROUP BY 1""",
)
def execution_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stream_log(spark, sf_dir)
    edges = executions.execution_edges(log, user_executions(log))
    return edges.groupBy("pe_id").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct(F.concat_ws(">", "src", "dst")).alias("n_pairs"))


# --- key figures ---------------------------------------------------------------------------

KPI_SQL = f"""WITH {A}, {U}, k AS (
  SELECT pe.pe_id, CAST(max(us) - min(us) AS DOUBLE) / 1e6 AS duration, count(DISTINCT pe.event_id) AS n_events, count(DISTINCT activity) AS n_activities, count(DISTINCT e2o.object_id) AS n_objects
  FROM pe JOIN ev ON ev.event_id = pe.event_id JOIN e2o ON e2o.event_id = pe.event_id GROUP BY 1
)
"""


@query("kpi_builtin", KPI_SQL + "SELECT pe_id, duration, n_events, n_activities, n_objects, round(CASE WHEN duration > 0 THEN n_events / duration ELSE 0 END, 9) AS event_density FROM k")
def kpi_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stream_log(spark, sf_dir)
    out = kpi.builtin(log, user_executions(log))
    return out.select("pe_id", "duration", "n_events", "n_activities", "n_objects", F.round("event_density", 9).alias("event_density"))


@query("kpi_custom_expr", KPI_SQL + "SELECT pe_id, round(duration / n_events, 6) AS pace, CAST(n_objects - 1 AS DOUBLE) AS kpi_2, 0.0::DOUBLE AS bad FROM k")
def kpi_custom_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stream_log(spark, sf_dir)
    out = kpi.custom(log, user_executions(log), ["pace:=duration / n_events", "n_objects - 1", "bad:='x'", "pace:=1"])
    return out.select("pe_id", r6("pace").alias("pace"), "kpi_2", "bad")


@query(
    "kpi_summary",
    KPI_SQL
    + """, l AS (SELECT 'duration' AS kpi, duration AS v FROM k UNION ALL SELECT 'n_events', CAST(n_events AS DOUBLE) FROM k UNION ALL SELECT 'n_objects', CAST(n_objects AS DOUBLE) FROM k)
    SELECT kpi, count(v) AS n, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, round(median(v), 4) AS median, round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.75), 4) AS q75, round(stddev_pop(v), 4) AS std FROM l GROUP BY 1""",
)
def kpi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stream_log(spark, sf_dir)
    out = kpi.summary(kpi.builtin(log, user_executions(log)), ["duration", "n_events", "n_objects"])
    return out.select("kpi", "n", "min", "max", *[F.round(c, 4).alias(c) for c in ("mean", "median", "q25", "q75", "std")])


HITS_SQL = "hits AS (SELECT DISTINCT f.src_activity || '>' || f.dst_activity AS pattern_id, f.object_id AS pe_id FROM fol f WHERE f.object_type = 'user' AND f.dst_us - f.src_us < 600000000)"


def quick_pairs(log) -> DataFrame:
    """Directly-follows pairs of users within ten minutes, as pattern hits."""
    near = traces.micros("dst_ts") - traces.micros("src_ts") < 600_000_000
    edges = traces.follows(log).where((F.col("object_type") == "user") & near)
    return edges.select(F.concat_ws(">", "src_activity", "dst_activity").alias("pattern_id"), F.col("object_id").alias("pe_id")).distinct()


@query(
    "kpi_contrast",
    KPI_SQL
    + f""", {HITS_SQL}, t AS (SELECT count(*) AS n, sum(duration) AS s FROM k), i AS (SELECT pattern_id, count(*) AS n_in, sum(duration) AS s_in FROM hits JOIN k USING (pe_id) GROUP BY 1)
    SELECT pattern_id, 'duration' AS kpi, n_in AS support, round(s_in / n_in, 4) AS mu_in, round((s - s_in) / (n - n_in), 4) AS mu_out, round(s_in / n_in - (s - s_in) / (n - n_in), 4) AS delta FROM i, t WHERE n_in < n""",
)
def kpi_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stream_log(spark, sf_dir)
    values = kpi.long(kpi.builtin(log, user_executions(log)), ["duration"])
    out = kpi.contrast(values, quick_pairs(log))
    return out.select("pattern_id", "kpi", "support", *[F.round(c, 4).alias(c) for c in ("mu_in", "mu_out", "delta")])


@query(
    "mining_support_stats",
    f"WITH {A}, {HITS_SQL}, s AS (SELECT pattern_id, count(*) AS support FROM hits GROUP BY 1) SELECT count(*) AS n_patterns, min(support) AS min_support, round(avg(support), 6) AS mean_support, median(support) AS median_support, max(support) AS max_support FROM s",
)
def mining_support_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    supports = quick_pairs(stream_log(spark, sf_dir)).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("support"))
    return kpi.mining_support(supports, 100).select("n_patterns", "min_support", r6("mean_support").alias("mean_support"), "median_support", "max_support")


# --- relations between types ---------------------------------------------------------------


@query(
    "o2o_cardinality",
    f"""WITH {B}, types AS (SELECT DISTINCT object_type AS target_type FROM obj), n AS (SELECT source_id, target_type, count(DISTINCT target_id) AS n FROM adj GROUP BY 1, 2),
    c AS (SELECT o.object_type AS source_type, t.target_type, coalesce(n.n, 0) AS n FROM obj o CROSS JOIN types t LEFT JOIN n ON n.source_id = o.object_id AND n.target_type = t.target_type)
    SELECT source_type, target_type, min(n) AS low, max(n) AS high,
      CASE WHEN max(n) = 0 THEN '0' WHEN min(n) = 1 AND max(n) = 1 THEN '1' WHEN min(n) = 0 AND max(n) = 1 THEN '0..1' WHEN min(n) >= 1 THEN '1..*' ELSE '0..*' END AS label FROM c GROUP BY 1, 2""",
)
def o2o_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.o2o_cardinality(commerce_log(spark, sf_dir))


BUCKET_SQL = "count(*) AS total, " + ", ".join(
    f'CAST(sum(CASE WHEN {test} THEN 1 ELSE 0 END) AS BIGINT) AS "n_{label}"' for label, test in {"0": "n = 0", "1": "n = 1", "0..1": "n <= 1", "1..*": "n >= 1", "0..*": "true"}.items()
)
EC_SQL = f"""WITH {B}, types AS (SELECT DISTINCT object_type AS target_type FROM e2o), k AS (SELECT event_id, object_type AS target_type, count(DISTINCT object_id) AS n FROM e2o GROUP BY 1, 2),
s AS (SELECT DISTINCT event_id, object_type AS source_type FROM e2o), h AS (SELECT s.source_type, t.target_type, coalesce(k.n, 0) AS n FROM s CROSS JOIN types t LEFT JOIN k ON k.event_id = s.event_id AND k.target_type = t.target_type),
ec AS (SELECT source_type, target_type, {BUCKET_SQL} FROM h GROUP BY 1, 2)
"""


@query("event_cardinality", EC_SQL + "SELECT * FROM ec")
def event_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.event_cardinality(commerce_log(spark, sf_dir))


@query(
    "most_precise_labels",
    EC_SQL
    + """SELECT source_type, target_type, CASE WHEN total = 0 THEN 'ERROR 0' WHEN "n_0" >= 0.9 * total THEN '0' WHEN "n_1" >= 0.9 * total THEN '1' WHEN "n_0..1" >= 0.9 * total THEN '0..1' WHEN "n_1..*" >= 0.9 * total THEN '1..*' WHEN "n_0..*" >= 0.9 * total THEN '0..*' ELSE 'None' END AS label FROM ec""",
)
def most_precise_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.most_precise(relations.event_cardinality(commerce_log(spark, sf_dir)), relations.CARDINALITIES, 0.9)


@query(
    "log_cardinality",
    f"""WITH {B}, rel AS (SELECT DISTINCT a.object_id AS source_id, b.object_id AS target_id, b.object_type AS target_type FROM e2o a JOIN e2o b ON a.event_id = b.event_id AND a.object_id <> b.object_id UNION SELECT source_id, target_id, target_type FROM adj),
    types AS (SELECT DISTINCT object_type AS target_type FROM obj), k AS (SELECT source_id, target_type, count(DISTINCT target_id) AS n FROM rel GROUP BY 1, 2),
    h AS (SELECT o.object_type AS source_type, t.target_type, coalesce(k.n, 0) AS n FROM obj o CROSS JOIN types t LEFT JOIN k ON k.source_id = o.object_id AND k.target_type = t.target_type)
    SELECT source_type, target_type, {BUCKET_SQL} FROM h GROUP BY 1, 2""",
)
def log_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.log_cardinality(commerce_log(spark, sf_dir))


TR_SQL = f"""WITH {B}, sp AS (SELECT object_id, object_type, min(us) AS s, max(us) AS e FROM timed GROUP BY 1, 2),
pr AS (SELECT DISTINCT a.object_id AS a, a.object_type AS source_type, b.object_id AS b, b.object_type AS target_type FROM e2o a JOIN e2o b ON a.event_id = b.event_id),
j AS (SELECT source_type, target_type, x.s AS s1, x.e AS e1, y.s AS s2, y.e AS e2 FROM pr JOIN sp x ON x.object_id = pr.a JOIN sp y ON y.object_id = pr.b)
"""


@query(
    "temporal_relation",
    TR_SQL
    + """SELECT source_type, target_type, count(*) AS total, count(*) FILTER (s2 <= s1 AND e1 <= e2) AS "n_D", count(*) FILTER (s1 <= s2 AND e2 <= e1) AS "n_Di",
    count(*) FILTER (e1 < s2 OR (s1 < s2 AND s2 <= e1 AND e1 < e2)) AS "n_I", count(*) FILTER (e2 < s1 OR (s2 < s1 AND s1 <= e2 AND e2 < e1)) AS "n_Ii", count(*) AS "n_P" FROM j GROUP BY 1, 2""",
)
def temporal_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.temporal_relations(commerce_log(spark, sf_dir))


@query(
    "execution_relations",
    f"""WITH {A}, {U}, sp AS (SELECT object_id, object_type, min(us) AS s, max(us) AS e FROM timed GROUP BY 1, 2), po AS (SELECT DISTINCT pe_id, object_id FROM pe JOIN e2o USING (event_id)),
    o AS (SELECT pe_id, sp.* FROM po JOIN sp USING (object_id)), j AS (SELECT a.object_type AS source_type, b.object_type AS target_type, a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2 FROM o a JOIN o b ON a.pe_id = b.pe_id AND a.object_id <> b.object_id),
    c AS (SELECT source_type, target_type, count(*) AS total, count(*) FILTER (s2 <= s1 AND e1 <= e2) AS "n_D", count(*) FILTER (s1 <= s2 AND e2 <= e1) AS "n_Di", count(*) FILTER (NOT (s1 <= s2 AND e2 <= e1) AND s1 < s2) AS "n_I",
    count(*) FILTER (NOT (s1 <= s2 AND e2 <= e1) AND s2 < s1) AS "n_Ii", count(*) FILTER (NOT (s1 <= s2 AND e2 <= e1) AND s1 = s2) AS "n_P" FROM j GROUP BY 1, 2)
    SELECT *, round(total / sum(total) OVER (), 6) AS support FROM c""",
)
def execution_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stream_log(spark, sf_dir)
    out = relations.execution_relations(log, executions.execution_objects(log, user_executions(log)).select("pe_id", "object_id"))
    return out.withColumn("support", r6("support"))


@query("type_event_types", f"WITH {B} SELECT object_type, string_agg(DISTINCT activity, ',' ORDER BY activity) AS activities FROM timed GROUP BY 1")
def type_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.type_activities(commerce_log(spark, sf_dir)).select("object_type", F.array_join("activities", ",").alias("activities"))


@query("layering")
def layering(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels, resources = relations.resource_types(commerce_log(spark, sf_dir))
    return spark.createDataFrame([(t, level, t in resources) for t, level in levels.items()], "object_type string, level int, is_resource boolean")


# --- filters -------------------------------------------------------------------------------

CUM_SQL = "c AS (SELECT {0} AS key, count(*) AS n FROM {1} GROUP BY 1), k AS (SELECT key, n, coalesce(sum(n) OVER (ORDER BY n DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER () AS before FROM c)"


@query("filter_activity_cum", f"WITH {A}, {CUM_SQL.format('activity', 'ev')} SELECT activity, count(*) AS n FROM ev WHERE activity IN (SELECT key FROM k WHERE before <= 0.5) GROUP BY 1")
def filter_activity_cum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_activity_share(stream_log(spark, sf_dir), 0.5).events.groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_variant_cum",
    f"WITH {B}, v AS (SELECT object_id AS pe_id, string_agg(activity, '>' ORDER BY ts, event_id) AS variant FROM timed WHERE object_type = 'order' GROUP BY 1), {CUM_SQL.format('variant', 'v')}"
    " SELECT v.pe_id, count(*) AS n_events FROM v JOIN timed ON timed.object_id = v.pe_id WHERE variant IN (SELECT key FROM k WHERE before <= 0.6) GROUP BY 1",
)
def filter_variant_cum(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = commerce_log(spark, sf_dir)
    own = traces.traces(log).where("object_type = 'order'")
    variants = own.select(F.col("object_id").alias("pe_id"), F.array_join(F.transform("trace", lambda s: s["activity"]), ">").alias("variant"))
    pe = traces.flatten(log, "order").select(F.col("case_id").alias("pe_id"), "event_id")
    return filters.by_variant_share(pe, variants, 0.6).groupBy("pe_id").agg(F.count(F.lit(1)).alias("n_events"))


LOW, HIGH = datetime(1995, 6, 1), datetime(1996, 6, 1)
SPAN_SQL = f"WITH {B}, s AS (SELECT object_id AS pe_id, min(ts) AS s, max(ts) AS e FROM timed WHERE object_type = 'order' GROUP BY 1) SELECT pe_id FROM s WHERE "
_BOUNDS = "TIMESTAMP '1995-06-01' AND TIMESTAMP '1996-06-01'"
SPAN_TESTS = {
    "start": f"s BETWEEN {_BOUNDS}",
    "end": f"e BETWEEN {_BOUNDS}",
    "contained": "s >= TIMESTAMP '1995-06-01' AND e <= TIMESTAMP '1996-06-01'",
    "spanning": "(TIMESTAMP '1995-06-01' BETWEEN s AND e) OR (TIMESTAMP '1996-06-01' BETWEEN s AND e)",
    "overlapping": "s <= TIMESTAMP '1996-06-01' AND e >= TIMESTAMP '1995-06-01'",
}


def _time_query(strategy: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = commerce_log(spark, sf_dir)
        pe = traces.flatten(log, "order").select(F.col("case_id").alias("pe_id"), "event_id")
        return filters.by_time(log, pe, LOW, HIGH, strategy).select("pe_id")

    return run


for _name, _test in SPAN_TESTS.items():
    query(f"filter_time_{_name}", SPAN_SQL + _test)(_time_query(_name))


@query("filter_time_events", f"WITH {B} SELECT activity, count(*) AS n FROM ev WHERE ts BETWEEN {_BOUNDS} GROUP BY 1")
def filter_time_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_event_time(commerce_log(spark, sf_dir), LOW, HIGH).events.groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


@query("filter_types", f"WITH {B} SELECT object_type, count(*) AS n FROM e2o JOIN ev USING (event_id) WHERE activity = 'ship_item' AND object_type IN ('order', 'item') GROUP BY 1")
def filter_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.keep(commerce_log(spark, sf_dir), ["ship_item"], ["order", "item"]).e2o.groupBy("object_type").agg(F.count(F.lit(1)).alias("n"))


@query("activity_type_rules", f"WITH {B} SELECT activity, object_type, count(*) AS n FROM timed WHERE activity <> 'ship_item' OR object_type IN ('item', 'part') GROUP BY 1, 2")
def activity_type_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("ship_item", ["item", "part"])], "activity string, allowed array<string>")
    return filters.by_rules(commerce_log(spark, sf_dir), rules).timed().groupBy("activity", "object_type").agg(F.count(F.lit(1)).alias("n"))


PATH_SQL = f"""WITH {A}, h AS (SELECT unnest([src, dst]) AS event_id FROM fol WHERE object_type = 'user' AND ((src_activity = 'view' AND dst_activity = 'click') OR (src_activity = 'click' AND dst_activity = 'purchase')))
SELECT activity, count(*) AS n FROM ev WHERE event_id {{0}} (SELECT event_id FROM h) GROUP BY 1"""
PATHS = [("view", "click"), ("click", "purchase")]


@query("path_filter", PATH_SQL.format("IN"))
def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.on_paths(stream_log(spark, sf_dir), "user", PATHS).groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


@query("path_filter_negative", PATH_SQL.format("NOT IN"))
def path_filter_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.on_paths(stream_log(spark, sf_dir), "user", PATHS, False).groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


#: Rounds of the SQL; a round that drops nothing repeats, so more rounds than the log needs change nothing.
ARC_ROUNDS = 8


def _arc_round(i: int) -> str:
    return f"""f{i} AS (SELECT src, dst, count(*) OVER (PARTITION BY sa, da) AS n FROM (SELECT lag(event_id) OVER w AS src, event_id AS dst, lag(activity) OVER w AS sa, activity AS da FROM k{i} WINDOW w AS (PARTITION BY object_id ORDER BY ts, event_id)) WHERE src IS NOT NULL),
    g{i} AS (SELECT src AS event_id FROM f{i}, least WHERE f{i}.n >= least.n UNION SELECT dst FROM f{i}, least WHERE f{i}.n >= least.n), k{i + 1} AS MATERIALIZED (SELECT k{i}.* FROM k{i} JOIN g{i} USING (event_id))"""


@query("arc_frequency_clean", f"WITH {B}, least AS (SELECT count(*) // 20 AS n FROM ev), k0 AS (SELECT * FROM timed WHERE object_type = 'order'), {', '.join(map(_arc_round, range(ARC_ROUNDS)))} SELECT DISTINCT event_id FROM k{ARC_ROUNDS}")
def arc_frequency_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = commerce_log(spark, sf_dir)
    n = log.events.count() // 20
    return filters.clean_rare_arcs(log, "order", n)


@query(
    "resources_to_attributes",
    f"""WITH {B} SELECT ev.event_id, activity, coalesce(string_agg(DISTINCT CASE WHEN object_type = 'part' THEN object_id END, ','), '') AS resource_part, coalesce(string_agg(DISTINCT CASE WHEN object_type = 'supplier' THEN object_id END, ','), '') AS resource_supplier
    FROM ev LEFT JOIN e2o ON e2o.event_id = ev.event_id AND object_type IN ('part', 'supplier') GROUP BY 1, 2""",
)
def resources_to_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filters.resources_to_attributes(commerce_log(spark, sf_dir), ["part", "supplier"])
    return out.select("event_id", "activity", *[F.array_join(c, ",").alias(c) for c in ("resource_part", "resource_supplier")])


@query("filter_activity_count", f"WITH {A} SELECT activity, count(*) AS n FROM ev GROUP BY 1 HAVING count(*) >= 1000")
def filter_activity_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_activity_count(stream_log(spark, sf_dir), 1000).events.groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


@query("filter_objects", f"WITH {B} SELECT object_type, count(*) AS n FROM e2o WHERE object_id IN (SELECT object_id FROM obj WHERE object_id LIKE '%7') GROUP BY 1")
def filter_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = commerce_log(spark, sf_dir)
    return filters.by_objects(log, log.objects.where(F.col("object_id").endswith("7"))).e2o.groupBy("object_type").agg(F.count(F.lit(1)).alias("n"))


@query("filter_executions", f"WITH {A}, {U} SELECT activity, count(*) AS n FROM ev WHERE event_id IN (SELECT event_id FROM pe WHERE pe_id LIKE '%1') GROUP BY 1")
def filter_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stream_log(spark, sf_dir)
    pe = user_executions(log)
    chosen = pe.where(F.col("pe_id").endswith("1")).select("pe_id").distinct()
    return filters.by_executions(log, pe, chosen).events.groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


# --- performance ---------------------------------------------------------------------------

PERF_SQL = f"""WITH {B}, n AS (SELECT eog.dst, s.us AS src_us, EXISTS (SELECT 1 FROM e2o WHERE e2o.event_id = eog.src AND object_type = 'item') AS has FROM eog JOIN ev s ON s.event_id = eog.src),
p AS (SELECT dst, min(src_us) AS f, max(src_us) AS l, min(CASE WHEN has THEN src_us END) AS tf, max(CASE WHEN has THEN src_us END) AS tl FROM n GROUP BY 1),
t AS (SELECT activity, CAST(us - f AS DOUBLE) / 1e6 AS flow, CAST(us - l AS DOUBLE) / 1e6 AS sojourn, CAST(l - f AS DOUBLE) / 1e6 AS synchronization, CAST(us - l AS DOUBLE) / 1e6 AS elapsed,
CAST(tl - tf AS DOUBLE) / 1e6 AS pooling, CAST(tl - f AS DOUBLE) / 1e6 AS lagging, CAST(tf - f AS DOUBLE) / 1e6 AS readiness FROM p JOIN ev ON ev.event_id = p.dst)
"""
STATS_SQL = 'count({0}) AS n, round(avg({0}), 3) AS avg, median({0}) AS med, sum({0}) AS sum, min({0}) AS min, max({0}) AS max'


def _perf_query(measure: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = commerce_log(spark, sf_dir)
        times = performance.remaining_times(log) if measure == "remaining" else performance.event_times(log, "item")
        out = performance.by_activity(times, measure, ["avg", "med", "sum", "min", "max"])
        return out.withColumn("avg", F.round("avg", 3))

    return run


for _name in ("flow", "sojourn", "synchronization", "elapsed", "pooling", "lagging", "readiness"):
    query(f"perf_{_name}", PERF_SQL + f"SELECT activity, {STATS_SQL.format(_name)} FROM t WHERE {_name} IS NOT NULL GROUP BY 1")(_perf_query(_name))
query(
    "perf_remaining",
    f"WITH {B}, p AS (SELECT src, max(d.us) AS l FROM eog JOIN ev d ON d.event_id = eog.dst GROUP BY 1), t AS (SELECT activity, CAST(l - us AS DOUBLE) / 1e6 AS remaining FROM p JOIN ev ON ev.event_id = p.src) SELECT activity, {STATS_SQL.format('remaining')} FROM t GROUP BY 1",
)(_perf_query("remaining"))


@query(
    "object_freq",
    f"WITH {B}, k AS (SELECT ev.event_id, activity, count(DISTINCT object_id) AS n FROM ev LEFT JOIN e2o ON e2o.event_id = ev.event_id AND object_type = 'item' GROUP BY 1, 2) SELECT activity, count(*) AS n_events, CAST(sum(n) AS BIGINT) AS n_objects, min(n) AS least, max(n) AS most FROM k GROUP BY 1",
)
def object_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.object_frequency(commerce_log(spark, sf_dir), "item")


@query(
    "act_freq",
    f"WITH {B}, k AS (SELECT activity, object_id, count(DISTINCT event_id) AS n FROM timed WHERE object_type = 'part' GROUP BY 1, 2) SELECT activity, (SELECT count(*) FROM part) AS n_objects, count(*) AS n_with, CAST(sum(n) AS BIGINT) AS n_events, max(n) AS most FROM k GROUP BY 1",
)
def act_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.activity_frequency(commerce_log(spark, sf_dir), "part")


# --- constraints ---------------------------------------------------------------------------

TRACE_SQL = f"""WITH {A}, t AS (SELECT object_id, list(activity ORDER BY ts, event_id) AS acts FROM timed WHERE object_type = 'key' GROUP BY 1),
p AS (SELECT acts, coalesce(list_position(acts, 'signup'), 0) AS a, coalesce(list_position(acts, 'purchase'), 0) AS b FROM t),
m AS (
  SELECT 'existence' AS metric, a > 0 AS ok FROM p UNION ALL SELECT 'non_existence', a = 0 FROM p UNION ALL SELECT 'coexistence', (a > 0) = (b > 0) FROM p
  UNION ALL SELECT 'exclusiveness', NOT (a > 0 AND b > 0) FROM p UNION ALL SELECT 'choice', a > 0 OR b > 0 FROM p UNION ALL SELECT 'xor_choice', (a > 0) <> (b > 0) FROM p
  UNION ALL SELECT 'followed_by', a = 0 OR (b > 0 AND a < b) FROM p UNION ALL SELECT 'directly_followed_by', a = 0 OR coalesce(acts[a + 1] = 'purchase', false) FROM p
  UNION ALL SELECT 'precedence', b = 0 OR (a > 0 AND a < b) FROM p UNION ALL SELECT 'block', NOT (a > 0 AND b > 0) OR b < a FROM p
)
SELECT metric, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS n_ok, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM m GROUP BY 1"""


@query("constraint_metrics", TRACE_SQL)
def constraint_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.trace_metrics(stream_log(spark, sf_dir), "key", "signup", "purchase").withColumn("share", r6("share"))


@query(
    "involvement",
    f"""WITH {B}, k AS (SELECT ev.event_id, activity, count(DISTINCT object_id) AS n FROM ev LEFT JOIN e2o ON e2o.event_id = ev.event_id AND object_type = 'customer' GROUP BY 1, 2)
    SELECT activity, count(*) AS n_events, avg(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE 0 END) AS absence, avg(CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0 END) AS singular, avg(CASE WHEN n > 1 THEN 1.0::DOUBLE ELSE 0 END) AS multiple, avg(CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0 END) AS presence FROM k GROUP BY 1""",
)
def involvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.involvement(commerce_log(spark, sf_dir), "customer")


@query(
    "strengths",
    f"""WITH {A}, s AS (SELECT count(*) FILTER (src_activity = 'view' AND dst_activity = 'click') AS ab, count(*) FILTER (src_activity = 'click' AND dst_activity = 'view') AS ba FROM fol WHERE object_type = 'key'),
    t AS (SELECT object_id, CAST(bool_or(activity = 'view') AS INT) AS a, CAST(bool_or(activity = 'click') AS INT) AS b FROM timed WHERE object_type = 'key' GROUP BY 1),
    p AS (SELECT CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b, CAST(sum(a * b) AS BIGINT) AS n_ab FROM t)
    SELECT ab, ba, n_a, n_b, n_ab, round((ab - ba) / (ab + ba), 6) AS causal, round(1.0::DOUBLE - abs(ab - ba) / (ab + ba), 6) AS concurrency, round(1.0::DOUBLE - 2.0::DOUBLE * n_ab / (n_a + n_b), 6) AS choice FROM s, p""",
)
def strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = constraints.strengths(stream_log(spark, sf_dir), "key", "view", "click")
    return out.select("ab", "ba", "n_a", "n_b", "n_ab", *[r6(c).alias(c) for c in ("causal", "concurrency", "choice")])


@query(
    "constraint_monitoring",
    TRACE_SQL.replace("SELECT metric, CAST(sum", ", w AS (SELECT metric, CAST(sum").rstrip()
    + ") SELECT metric AS name, round(share, 6) AS value, NOT (CASE metric WHEN 'existence' THEN share >= 0.5 WHEN 'precedence' THEN share <= 0.2 ELSE true END) AS violated FROM w WHERE metric IN ('existence', 'precedence')",
)
def constraint_monitoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = constraints.trace_metrics(stream_log(spark, sf_dir), "key", "signup", "purchase")
    metrics = metrics.select(F.col("metric").alias("kind"), F.lit("key").alias("object_type"), F.lit("signup").alias("source"), F.lit("purchase").alias("target"), F.col("share").alias("value"))
    rows = [("existence", "existence", "key", "signup", "purchase", ">=", 0.5), ("precedence", "precedence", "key", "signup", "purchase", "<=", 0.2)]
    return constraints.monitor(metrics, constraints.constraint_table(spark, rows)).select("name", r6("value").alias("value"), "violated")
