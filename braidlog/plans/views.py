"""Explorer views over a bundle that is written and loaded again, each with its SQL equivalent.

The bundle has two explored configurations of the stream log's users: 0 with quick
directly-follows pairs as behaviours, 1 with the first activity; configuration 2 was skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.operators import explorer, kpi
from braidlog.plans.catalog import HITS_SQL, KPI_SQL, query, quick_pairs, r6, user_executions
from braidlog.plans.formats import folder_for
from braidlog.sources.tables import stream_log

BUNDLE_SQL = (
    KPI_SQL
    + f""", {HITS_SQL}, fa AS (SELECT pe_id, arg_min(activity, (ts, event_id)) AS first FROM pe JOIN ev USING (event_id) GROUP BY 1),
ah AS (SELECT 0 AS config_id, pattern_id, pe_id FROM hits UNION ALL SELECT 1, first, pe_id FROM fa),
kp AS (SELECT pe_id, 'duration' AS kpi, duration AS value FROM k UNION ALL SELECT pe_id, 'n_events', CAST(n_events AS DOUBLE) FROM k),
tot AS (SELECT kpi, count(*) AS n, sum(value) AS s FROM kp GROUP BY 1),
ins AS (SELECT config_id, pattern_id, kpi, count(*) AS n_in, sum(value) AS s_in FROM ah JOIN kp USING (pe_id) GROUP BY 1, 2, 3),
con AS (SELECT config_id, pattern_id, kpi, n_in AS support, s_in / n_in AS mu_in, (s - s_in) / (n - n_in) AS mu_out FROM ins JOIN tot USING (kpi) WHERE n_in < n),
pat AS (SELECT DISTINCT config_id, pattern_id, CASE config_id WHEN 0 THEN 2 ELSE 1 END AS n_nodes, 1 - config_id AS n_edges FROM ah),
mem AS (SELECT 0 AS config_id, 'duration' AS kpi, ascii(first) % 3 AS leaf, pe_id FROM fa UNION ALL SELECT 1, 'duration', CAST(right(pe_id, 1) AS INT), pe_id FROM fa),
lat AS (
  SELECT config_id, text, height, reason, coalesce(n_patterns, 0) AS n_patterns, round(best, 4) AS best_delta
  FROM (VALUES (0, 'pairs', 1, NULL), (1, 'first', 0, NULL), (2, 'none', 2, 'n=0')) c(config_id, text, height, reason)
  LEFT JOIN (SELECT config_id, count(*) AS n_patterns FROM pat GROUP BY 1) USING (config_id) LEFT JOIN (SELECT config_id, max(abs(mu_in - mu_out)) AS best FROM con GROUP BY 1) USING (config_id)
)
"""
)


def bundle(spark: SparkSession, sf_dir: str) -> explorer.Bundle:
    """The bundle, saved to the shared folder and loaded from there."""
    log = stream_log(spark, sf_dir)
    pe = user_executions(log)
    values = kpi.long(kpi.builtin(log, pe), ["duration", "n_events"])
    first = pe.join(log.events, "event_id").groupBy("pe_id").agg(F.min_by("activity", F.struct("ts", "event_id")).alias("first"))
    zero, one = F.lit(0).alias("config_id"), F.lit(1).alias("config_id")
    pairs, starts = quick_pairs(log), first.select(F.col("first").alias("pattern_id"), "pe_id")
    hits = pairs.select(zero, "pattern_id", "pe_id").union(starts.select(one, "pattern_id", "pe_id"))
    patterns = hits.select("config_id", "pattern_id").distinct().select("*", F.when(F.col("config_id") == 0, 2).otherwise(1).alias("n_nodes"), (1 - F.col("config_id")).alias("n_edges"))
    contrast = kpi.contrast(values, pairs).select(zero, "*").union(kpi.contrast(values, starts).select(one, "*"))
    leaves = first.select(zero, (F.ascii("first") % 3).alias("leaf"), "pe_id").union(first.select(one, F.substring("pe_id", -1, 1).cast("int"), "pe_id"))
    made = explorer.Bundle(
        spark.createDataFrame([(0, "pairs", 1, None), (1, "first", 0, None), (2, "none", 2, "n=0")], "config_id int, text string, height int, reason string"),
        hits,
        patterns,
        values,
        contrast,
        first.select(one, "pe_id", F.col("first").alias("class_id")),
        spark.createDataFrame([(2, 0), (0, 1)], "config_id int, finer_id int"),
        leaves.select("config_id", F.lit("duration").alias("kpi"), "leaf", F.concat(F.lit("leaf "), F.col("leaf").cast("string")).alias("label"), "pe_id"),
    )
    path = folder_for(spark, "bundle")
    made.save(path)
    return explorer.Bundle.load(spark, path)


@query("explorer_summary", BUNDLE_SQL + "SELECT CAST(3 AS BIGINT) AS n_configs, CAST(2 AS BIGINT) AS n_mined, (SELECT count(*) FROM k) AS n_executions, (SELECT count(*) FROM pat) AS n_patterns, CAST(2 AS BIGINT) AS n_kpis")
def explorer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.summary(bundle(spark, sf_dir))


@query("explorer_lattice", BUNDLE_SQL + "SELECT * FROM lat")
def explorer_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.lattice(bundle(spark, sf_dir)).withColumn("best_delta", F.round("best_delta", 4))


@query("explorer_options", BUNDLE_SQL + "SELECT config_id, text, n_patterns FROM lat WHERE reason IS NULL AND n_patterns > 0")
def explorer_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.options(bundle(spark, sf_dir)).select("config_id", "text", "n_patterns")


@query("explorer_behaviours", BUNDLE_SQL + "SELECT pat.pattern_id, n_nodes, n_edges, support, round(mu_in - mu_out, 4) AS delta FROM pat LEFT JOIN con ON con.config_id = 1 AND con.pattern_id = pat.pattern_id AND kpi = 'n_events' WHERE pat.config_id = 1")
def explorer_behaviours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.behaviours(bundle(spark, sf_dir), 1, "n_events").select("pattern_id", "n_nodes", "n_edges", "support", F.round("delta", 4).alias("delta"))


@query("explorer_leaves", BUNDLE_SQL + "SELECT first AS class_id, string_agg(pe_id, ',' ORDER BY pe_id) AS executions FROM fa GROUP BY 1")
def explorer_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.leaves(bundle(spark, sf_dir), 1).select("class_id", F.array_join("executions", ",").alias("executions"))


@query("explorer_tree_leaves", BUNDLE_SQL + "SELECT leaf, 'leaf ' || CAST(leaf AS VARCHAR) AS label, count(*) AS n FROM mem WHERE config_id = 0 GROUP BY 1")
def explorer_tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.tree_leaves(bundle(spark, sf_dir), 0, "duration")


@query("explorer_leaf_members", BUNDLE_SQL + "SELECT pe_id, duration AS value FROM mem JOIN k USING (pe_id) WHERE config_id = 1 AND leaf = 1")
def explorer_leaf_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.leaf_members(bundle(spark, sf_dir), 1, "duration", 1)


@query("explorer_leaf_index", BUNDLE_SQL + "SELECT config_id, kpi, leaf, 'leaf ' || CAST(leaf AS VARCHAR) AS label, count(*) AS n FROM mem GROUP BY 1, 2, 3")
def explorer_leaf_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.leaf_index(bundle(spark, sf_dir))


@query(
    "explorer_cross",
    BUNDLE_SQL
    + ", x AS (SELECT a.config_id AS tree_a, a.leaf AS leaf_a, b.config_id AS tree_b, b.leaf AS leaf_b, count(*) AS n_both FROM mem a JOIN mem b ON a.pe_id = b.pe_id AND a.config_id <> b.config_id GROUP BY 1, 2, 3, 4) SELECT *, round(n_both / sum(n_both) OVER (PARTITION BY tree_a, leaf_a, tree_b), 6) AS share FROM x",
)
def explorer_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.cross(bundle(spark, sf_dir), "duration").select("tree_a", "leaf_a", "tree_b", "leaf_b", "n_both", r6("share").alias("share"))


@query("explorer_relations", BUNDLE_SQL + ", n AS (SELECT pattern_id, count(*) AS n FROM ah WHERE config_id = 1 GROUP BY 1) SELECT a.pattern_id AS a, b.pattern_id AS b, a.n AS n_a, b.n AS n_b, CAST(0 AS BIGINT) AS n_both FROM n a JOIN n b ON a.pattern_id < b.pattern_id")
def explorer_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bundle(spark, sf_dir)
    n = b.kpis.select("pe_id").distinct().count()
    return explorer.pattern_relations(b, 1, n).drop("relation")


@query("explorer_filtered", BUNDLE_SQL + "SELECT k.pe_id, duration, CAST(n_events AS DOUBLE) AS n_events, CASE WHEN first = 'click' THEN 'Y' ELSE 'N' END AS b1 FROM k JOIN fa USING (pe_id) WHERE n_events >= 100 AND duration <= 2500000")
def explorer_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = explorer.situation(bundle(spark, sf_dir), 1, ["click"], ["duration", "n_events"])
    return explorer.filtered(table, {"n_events": (100, None), "duration": (None, 2_500_000)}, "duration")
