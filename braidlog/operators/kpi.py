"""Key figures of executions: built-in ones, custom SQL expressions, summaries and contrast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlog.model import Log
from braidlog.operators.executions import execution_edges, execution_objects
from braidlog.operators.traces import micros, seconds

BUILT_IN = ("duration", "n_events", "n_objects", "n_activities", "event_density")


def builtin(log: Log, pe_events: DataFrame) -> DataFrame:
    """Duration in seconds, counts, and events per second (0 without duration) of every execution."""
    timed = pe_events.join(log.events.select("event_id", "activity", "ts"), "event_id")
    base = timed.groupBy("pe_id").agg(
        F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"), F.count_distinct("event_id").alias("n_events"), F.count_distinct("activity").alias("n_activities")
    )
    objects = execution_objects(log, pe_events).groupBy("pe_id").agg(F.count_distinct("object_id").alias("n_objects"))
    out = base.join(objects, "pe_id", "left").withColumns({"n_objects": F.coalesce("n_objects", F.lit(0)), "duration": seconds(micros("ts_max") - micros("ts_min"))})
    return out.withColumn("event_density", F.when(F.col("duration") > 0, F.col("n_events") / F.col("duration")).otherwise(0.0))


def parse_expressions(expressions: list[str]) -> dict[str, str]:
    """``name:=EXPR`` or ``EXPR`` (named ``kpi_1`` and so on); later duplicates of a name are dropped; none means duration."""
    out: dict[str, str] = {}
    for i, text in enumerate(expressions, 1):
        name, found, body = text.partition(":=")
        out.setdefault(name.strip() if found else f"kpi_{i}", (body if found else text).strip())
    return out or {"duration": "duration"}


def custom(log: Log, pe_events: DataFrame, expressions: list[str]) -> DataFrame:
    """SQL expressions over the built-in figures and ``n_edges``; what is not a number becomes 0."""
    n_edges = execution_edges(log, pe_events).groupBy("pe_id").agg(F.count(F.lit(1)).alias("n_edges"))
    scope = builtin(log, pe_events).join(n_edges, "pe_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    number = lambda text: F.coalesce(F.nanvl(F.expr(f"try_cast(({text}) as double)"), F.lit(0.0)), F.lit(0.0))
    return scope.select("pe_id", *[number(text).alias(name) for name, text in parse_expressions(expressions).items()])


def long(kpis: DataFrame, names: list[str]) -> DataFrame:
    """``(pe_id, kpi, value)`` rows."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("kpi"), F.col(n).cast("double").alias("value")) for n in names]))
    return kpis.select("pe_id", each.alias("k")).select("pe_id", "k.kpi", "k.value")


def summary(kpis: DataFrame, names: list[str]) -> DataFrame:
    """Count, extremes, mean, quartiles (interpolated) and population deviation of every figure."""
    return long(kpis, names).groupBy("kpi").agg(
        F.count("value").alias("n"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.median("value").alias("median"),
        F.percentile("value", 0.25).alias("q25"),
        F.percentile("value", 0.75).alias("q75"),
        F.stddev_pop("value").alias("std"),
    )


def contrast(kpi_values: DataFrame, hits: DataFrame) -> DataFrame:
    """Means of each figure over executions with and without each pattern, and their difference.

    ``kpi_values(pe_id, kpi, value)``, ``hits(pattern_id, pe_id)``. The outside sums are the
    totals less the inside sums, so no pattern meets an execution it does not occur in.
    Patterns of all or no executions are left out.
    """
    return contrast_sums(kpi_values.select("pe_id", "kpi", F.when(F.col("value").isNotNull(), 1).otherwise(0).alias("n"), F.col("value").alias("s")), hits)


def contrast_sums(sums: DataFrame, hits: DataFrame) -> DataFrame:
    """``contrast`` of ``(pe_id, kpi, n, s)``, where ``pe_id`` stands for executions with the same patterns: their number and sum."""
    total = sums.groupBy("kpi").agg(F.sum("n").alias("n_all"), F.sum("s").alias("sum_all"))
    inside = hits.distinct().join(sums, "pe_id").groupBy("pattern_id", "kpi").agg(F.sum("n").alias("n_in"), F.sum("s").alias("sum_in"))
    both = inside.join(F.broadcast(total), "kpi").where("n_in > 0 and n_in < n_all")  # one row for each figure
    mu_in, mu_out = F.col("sum_in") / F.col("n_in"), (F.col("sum_all") - F.col("sum_in")) / (F.col("n_all") - F.col("n_in"))
    return both.select("pattern_id", "kpi", F.col("n_in").alias("support"), mu_in.alias("mu_in"), mu_out.alias("mu_out"), (mu_in - mu_out).alias("delta"), F.abs(mu_in - mu_out).alias("abs_delta"))


def top_patterns(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` patterns of largest absolute difference, over all figures."""
    best = scored.groupBy("pattern_id").agg(F.max("abs_delta").alias("best"))
    return best.orderBy(F.desc("best"), "pattern_id").limit(k)


def mining_support(supports: DataFrame, n_executions: int) -> DataFrame:
    """Least, mean, median and greatest support, as counts and shares, and how many reach a quarter of the executions."""
    high = max(1, n_executions // 4)
    n = F.lit(float(max(1, n_executions)))
    return supports.agg(
        F.count(F.lit(1)).alias("n_patterns"),
        F.min("support").alias("min_support"),
        F.avg("support").alias("mean_support"),
        F.median("support").alias("median_support"),
        F.max("support").alias("max_support"),
        (F.avg("support") / n).alias("mean_ratio"),
        F.sum(F.when(F.col("support") >= high, 1).otherwise(0)).alias("n_high"),
    )
