"""Frequent connected patterns of labelled graphs, their support, merging and subsumption.

A pattern is a weakly connected set of 1 to ``max_edges`` label edges. It is supported by a
graph if it occurs as an induced subgraph: among the image's nodes there are no other
adjacent pairs. Each graph lists its own subsets once, so support is one aggregation by
canonical signature; labels and edges that are too rare are dropped before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidlog.functions.graphs import canonical, connected_subsets, induced_embeddings
from braidlog.operators import kpi

HITS = "signature string, pe_id string, n_nodes int, n_edges int"


def triples(graphs: DataFrame) -> DataFrame:
    """``(pe_id, source, target, label)`` with node labels, of ``behaviour`` graphs."""
    e = graphs.select("pe_id", "nodes", F.explode("edges").alias("e"))
    return e.select("pe_id", F.element_at("nodes", F.col("e.s") + 1).alias("source"), F.element_at("nodes", F.col("e.t") + 1).alias("target"), "e.label")


def frequent_edges(graphs: DataFrame, min_support: int) -> DataFrame:
    """One-edge patterns in at least ``min_support`` graphs, not necessarily induced. A graph with a column ``n`` counts so often."""
    found = triples(graphs).distinct()
    times = F.count(F.lit(1))
    if "n" in graphs.columns:
        found, times = found.join(graphs.select("pe_id", "n"), "pe_id"), F.sum("n")
    return found.groupBy("source", "target", "label").agg(times.alias("support")).where(F.col("support") >= min_support)


def pattern_hits(graphs: DataFrame, max_edges: int, min_support: int) -> DataFrame:
    """``(signature, pe_id, n_nodes, n_edges)``: the patterns that occur induced in each graph.

    ``graphs(pe_id, nodes, edges)``. Edges rarer than ``min_support`` cannot be part of a
    frequent pattern; they are marked so that enumeration skips them, but still count as
    adjacency when occurrences are tested.
    """
    common = frequent_edges(graphs, min_support).select("source", "target", "label", F.lit(True).alias("common"))
    e = graphs.select("pe_id", "nodes", F.explode("edges").alias("e"))
    e = e.select("pe_id", F.col("e.s").alias("s"), F.col("e.t").alias("t"), F.col("e.label").alias("label"), F.element_at("nodes", F.col("e.s") + 1).alias("source"), F.element_at("nodes", F.col("e.t") + 1).alias("target"))
    marked = e.join(common, ["source", "target", "label"], "left").groupBy("pe_id").agg(F.collect_list(F.struct("s", "t", "label", F.coalesce("common", F.lit(False)).alias("ok"))).alias("links"))
    rows = graphs.select("pe_id", "nodes").join(marked, "pe_id").select("pe_id", F.to_json("nodes").alias("nodes"), F.to_json("links").alias("links"))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pe_id, nodes_json, links_json in batch.itertuples(index=False):
                nodes, links = json.loads(nodes_json), json.loads(links_json)
                pairs = {(k["s"], k["t"]) for k in links}
                usable = sorted((k["s"], k["t"], k["label"]) for k in links if k["ok"])
                seen = set()
                for chosen in connected_subsets(len(usable), [(s, t) for s, t, _ in usable], max_edges):
                    own = [usable[i] for i in chosen]
                    image = sorted({v for s, t, _ in own for v in (s, t)})
                    if len(image) < 2 or any((a, b) in pairs for a in image for b in image if (a, b) not in {(s, t) for s, t, _ in own}):
                        continue
                    at = {v: i for i, v in enumerate(image)}
                    signature = canonical([nodes[v] for v in image], [(at[s], at[t], label) for s, t, label in own])
                    if signature not in seen:
                        seen.add(signature)
                        out.append((signature, pe_id, len(image), len(own)))
            yield pd.DataFrame(out, columns=["signature", "pe_id", "n_nodes", "n_edges"])

    return rows.mapInPandas(kernel, HITS)


def frequent_patterns(hits: DataFrame, min_support: int, max_support: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Patterns within the support window, ranked by support, edges and nodes. ``sizes(pe_id, n)`` are graphs that count so often."""
    times = F.count_distinct("pe_id")
    if sizes is not None:
        hits, times = hits.distinct().join(sizes, "pe_id"), F.sum("n")
    n = hits.groupBy("signature", "n_nodes", "n_edges").agg(times.alias("support")).where(F.col("support") >= min_support)
    if max_support is not None:
        n = n.where(F.col("support") <= max_support)
    return n.orderBy(F.desc("support"), F.desc("n_edges"), F.desc("n_nodes"), "signature")


def structure(signature: str) -> str:
    """A signature's canonical form without edge labels."""
    nodes, edges = json.loads(signature)
    return canonical(nodes, {(s, t, "") for s, t, _ in edges})


def hit_sets(hits: DataFrame) -> DataFrame:
    """Patterns with a hash of the executions they occur in."""
    return hits.groupBy("signature", "n_nodes", "n_edges").agg(
        F.count_distinct("pe_id").alias("support"), F.sha2(F.array_join(F.sort_array(F.collect_set("pe_id")), "\n"), 256).alias("hit_hash")
    )


def merge_labels(sets: DataFrame) -> DataFrame:
    """Unite patterns of the same structure and the same executions: their edge labels become sets."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(structure=[structure(s) for s in batch["signature"]])

    shaped = sets.mapInPandas(kernel, "signature string, n_nodes int, n_edges int, support long, hit_hash string, structure string")
    return shaped.groupBy("structure", "hit_hash").agg(F.sort_array(F.collect_set("signature")).alias("signatures"), F.first("support").alias("support"), F.max("n_nodes").alias("n_nodes"), F.max("n_edges").alias("n_edges"))


def subsumed(sets: DataFrame) -> DataFrame:
    """``(signature, kept)``: of patterns with equal executions, one contained in a larger kept one goes."""

    def kernel(group: pd.DataFrame) -> pd.DataFrame:
        order = sorted(group["signature"], key=lambda s: (-len(json.loads(s)[1]), -len(json.loads(s)[0]), s))
        kept: list[str] = []
        flags = {}
        for signature in order:
            nodes, edges = json.loads(signature)
            own: dict[tuple[int, int], set[str]] = {}
            for s, t, label in edges:
                own.setdefault((s, t), set()).add(label)
            pattern = (nodes, [(s, t, frozenset(v)) for (s, t), v in own.items()])
            flags[signature] = True
            for larger in kept:
                big_nodes, big_edges = json.loads(larger)
                if len(big_edges) <= len(edges) and len(big_nodes) <= len(nodes):
                    continue
                pairs: dict[tuple[int, int], set[str]] = {}
                for s, t, label in big_edges:
                    pairs.setdefault((s, t), set()).add(label)
                if induced_embeddings(pattern, (big_nodes, {k: frozenset(v) for k, v in pairs.items()})):
                    flags[signature] = False
                    break
            if flags[signature]:
                kept.append(signature)
        return pd.DataFrame({"signature": order, "kept": [flags[s] for s in order]})

    return sets.select("hit_hash", "signature").groupBy("hit_hash").applyInPandas(kernel, "signature string, kept boolean")


def score(hits: DataFrame, kpi_values: DataFrame, min_support: int, max_support: int, k: int = 10) -> DataFrame:
    """KPI contrast of the patterns within the support window, and their rank for each KPI."""
    window = frequent_patterns(hits, min_support, max_support).select("signature")
    own = hits.join(window, "signature", "left_semi").select(F.col("signature").alias("pattern_id"), "pe_id")
    w = Window.partitionBy("kpi").orderBy(F.desc("abs_delta"), "pattern_id")
    return kpi.contrast(kpi_values, own).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def support_window(n_executions: int, low: float, high: float) -> tuple[int, int]:
    """Absolute support bounds: numbers below 1 are shares, rounded half to even; at least 1."""
    bound = lambda x: max(1, round(x * n_executions) if x < 1 else int(x))
    return bound(low), bound(high)


def behaviour_matrix(hits: DataFrame, signatures: list[str]) -> DataFrame:
    """``(pe_id, b1, b2, ...)`` 1/0 columns for the given patterns."""
    return hits.groupBy("pe_id").agg(*[F.max(F.when(F.col("signature") == s, 1).otherwise(0)).alias(f"b{i}") for i, s in enumerate(signatures, 1)])


def write_graphs(graphs: DataFrame, path: str) -> None:
    """Graphs ``(pe_id, nodes, edges)`` as the line format of graph miners: ``t # id``, ``v i label``, ``e s t label``.

    One text record a graph, so files are written in parallel. Ids and labels may hold blanks
    but no line ends, which become blanks.
    """
    line = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    head = F.concat(F.lit("t # "), line(F.col("pe_id")))
    nodes = F.transform("nodes", lambda n, i: F.concat(F.lit("v "), i.cast("string"), F.lit(" "), line(n)))
    edges = F.transform("edges", lambda e: F.concat(F.lit("e "), e["s"].cast("string"), F.lit(" "), e["t"].cast("string"), F.lit(" "), line(e["label"])))
    graphs.select(F.array_join(F.concat(F.array(head), nodes, edges), "\n").alias("value")).write.mode("overwrite").text(path)


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """``(pe_id, nodes, edges)`` of files in the line format; a graph is one record, wherever files are split."""
    record = spark.read.option("lineSep", "\nt # ").text(path).select(F.split(F.regexp_replace("value", r"^t # |\n+$", ""), "\n").alias("lines")).where("lines[0] <> ''")
    v, e = r"^v [0-9]+ (.*)$", r"^e ([0-9]+) ([0-9]+) (.*)$"
    of = lambda tag: F.filter("lines", lambda x: x.startswith(tag))
    edge = lambda x: F.struct(F.regexp_extract(x, e, 1).cast("int").alias("s"), F.regexp_extract(x, e, 2).cast("int").alias("t"), F.regexp_extract(x, e, 3).alias("label"))
    body = F.slice("lines", F.lit(2), F.size("lines"))
    named = record.select(F.col("lines")[0].alias("pe_id"), body.alias("lines"))
    return named.select("pe_id", F.transform(of("v "), lambda x: F.regexp_extract(x, v, 1)).alias("nodes"), F.transform(of("e "), edge).alias("edges"))
