"""Queries over the result bundle: one function for each view of an explorer, all DataFrames.

The bundle holds ``configs(config_id, text, height, n_classes, n_executions, reason)``,
``hits(config_id, pattern_id, pe_id)``, ``patterns(config_id, pattern_id, n_nodes, n_edges)``,
``kpis(pe_id, kpi, value)``, ``contrast(config_id, pattern_id, kpi, ...)``,
``classes(config_id, pe_id, class_id)``, ``covers(config_id, finer_id)`` and
``members(config_id, kpi, leaf, label, pe_id)``.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.operators import attributes, tree


@dataclass(frozen=True)
class Bundle:
    """Results of a run, each a table."""

    configs: DataFrame
    hits: DataFrame
    patterns: DataFrame
    kpis: DataFrame
    contrast: DataFrame
    classes: DataFrame
    covers: DataFrame
    members: DataFrame

    def save(self, path: str) -> None:
        """Write every table as Parquet below ``path``."""
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bundle:
        return cls(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)})


def summary(b: Bundle) -> DataFrame:
    """One row: configurations, those mined, executions, patterns and figures."""
    one = lambda df, value, name: df.agg(value.alias(name))
    out = one(b.configs, F.count(F.lit(1)), "n_configs").join(one(b.configs, F.sum(F.when(F.col("reason").isNull(), 1).otherwise(0)), "n_mined"))
    out = out.join(one(b.kpis, F.count_distinct("pe_id"), "n_executions")).join(one(b.patterns, F.count(F.lit(1)), "n_patterns"))
    return out.join(one(b.kpis, F.count_distinct("kpi"), "n_kpis"))


def lattice(b: Bundle) -> DataFrame:
    """Configurations with their number of behaviours and the largest absolute difference."""
    n = b.patterns.groupBy("config_id").agg(F.count(F.lit(1)).alias("n_patterns"))
    best = b.contrast.groupBy("config_id").agg(F.max("abs_delta").alias("best_delta"))
    return b.configs.join(n, "config_id", "left").join(best, "config_id", "left").withColumn("n_patterns", F.coalesce("n_patterns", F.lit(0)))


def options(b: Bundle) -> DataFrame:
    """Interesting configurations with at least one behaviour."""
    return lattice(b).where("reason is null and n_patterns > 0")


def behaviours(b: Bundle, config_id: int, kpi: str) -> DataFrame:
    """Behaviours of a configuration by absolute difference."""
    own = b.contrast.where((F.col("config_id") == config_id) & (F.col("kpi") == kpi))
    return b.patterns.where(F.col("config_id") == config_id).join(own.drop("config_id"), "pattern_id", "left").orderBy(F.desc("abs_delta"), "pattern_id")


def situation(b: Bundle, config_id: int, patterns: list[str], kpis: list[str]) -> DataFrame:
    """Executions with their figures and a Y or N for each behaviour."""
    figures = b.kpis.groupBy("pe_id").pivot("kpi", kpis).agg(F.first("value"))
    own = b.hits.where(F.col("config_id") == config_id)
    flags = own.groupBy("pe_id").agg(*[F.max(F.when(F.col("pattern_id") == p, "Y").otherwise("N")).alias(f"b{i}") for i, p in enumerate(patterns, 1)])
    names = [f"b{i}" for i in range(1, len(patterns) + 1)]
    return figures.join(flags, "pe_id", "left").select("pe_id", *kpis, *[F.coalesce(n, F.lit("N")).alias(n) for n in names])


def leaves(b: Bundle, config_id: int) -> DataFrame:
    """Executions of every isomorphism class."""
    return b.classes.where(F.col("config_id") == config_id).groupBy("class_id").agg(F.sort_array(F.collect_list("pe_id")).alias("executions"))


def tree_leaves(b: Bundle, config_id: int, kpi: str) -> DataFrame:
    own = b.members.where((F.col("config_id") == config_id) & (F.col("kpi") == kpi))
    return own.groupBy("leaf", "label").agg(F.count(F.lit(1)).alias("n"))


def leaf_members(b: Bundle, config_id: int, kpi: str, leaf: int) -> DataFrame:
    own = b.members.where((F.col("config_id") == config_id) & (F.col("kpi") == kpi) & (F.col("leaf") == leaf))
    return own.join(b.kpis.where(F.col("kpi") == kpi).select("pe_id", "value"), "pe_id", "left").select("pe_id", "value")


def leaf_index(b: Bundle) -> DataFrame:
    """Every leaf of every tree."""
    return b.members.groupBy("config_id", "kpi", "leaf", "label").agg(F.count(F.lit(1)).alias("n"))


def cross(b: Bundle, kpi: str) -> DataFrame:
    """Overlaps of leaves between the configurations' trees."""
    return tree.overlaps(b.members.where(F.col("kpi") == kpi).select(F.col("config_id").alias("tree"), "leaf", "pe_id"))


def compact_cross(b: Bundle, kpi: str, config_id: int, leaf: int) -> DataFrame:
    return tree.compact_cross(cross(b, kpi)).where((F.col("tree_a") == config_id) & (F.col("leaf_a") == leaf)).orderBy("rank")


def pattern_relations(b: Bundle, config_id: int, n_executions: int) -> DataFrame:
    return tree.relations(b.hits.where(F.col("config_id") == config_id).select("pattern_id", "pe_id"), n_executions)


def behaviour_attributes(b: Bundle, prints: DataFrame, config_id: int, pattern_id: str) -> DataFrame:
    """Attribute shifts between executions with and without a behaviour."""
    own = b.hits.where((F.col("config_id") == config_id) & (F.col("pattern_id") == pattern_id)).select("pe_id", F.lit(True).alias("hit")).distinct()
    groups = b.kpis.select("pe_id").distinct().join(own, "pe_id", "left").select("pe_id", F.coalesce("hit", F.lit(False)).alias("inside"))
    return attributes.shift(prints, groups)


def filtered(table: DataFrame, ranges: dict[str, tuple[float | None, float | None]], sort: str, descending: bool = True) -> DataFrame:
    """Range filters and sorting of a situation table."""
    for column, (low, high) in ranges.items():
        if low is not None:
            table = table.where(F.col(column) >= low)
        if high is not None:
            table = table.where(F.col(column) <= high)
    return table.orderBy(F.desc(sort) if descending else F.asc(sort), *table.columns[:1])
