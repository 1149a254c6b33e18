"""Regression trees that explain a key figure by the presence of patterns.

Features are 1/0, so the best split of a node follows from sums per feature: the tree grows
level by level, one aggregation for all open nodes, and nothing but these sums is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlog.functions.runtime import written


class Node:
    """A tree node: its path of (feature, present), size, mean, and the split below it."""

    def __init__(self, path: tuple[tuple[str, bool], ...], n: int, mean: float) -> None:
        self.path, self.n, self.mean = path, n, mean
        self.feature: str | None = None
        self.children: tuple[Node, Node] | None = None

    def leaves(self) -> list[Node]:
        return [self] if self.children is None else [x for c in self.children for x in c.leaves()]

    def label(self) -> str:
        return " & ".join(("" if present else "¬") + f for f, present in self.path) or "all"

    def text(self, indent: int = 0) -> str:
        pad = "  " * indent
        if self.children is None:
            return f"{pad}leaf n={self.n} mean={self.mean:.4f}\n"
        absent, present = self.children
        return f"{pad}{self.feature} absent:\n{absent.text(indent + 1)}{pad}{self.feature} present:\n{present.text(indent + 1)}"


def _assign(root: Node) -> Column:
    out: Column = F.lit(None).cast("int")
    for i, leaf in enumerate(root.leaves()):
        test = F.lit(True)
        for feature, present in leaf.path:
            test = test & (F.array_contains("features", feature) == present)
        out = F.when(test, i).otherwise(out)
    return out


def fit(rows: DataFrame, max_depth: int = 3, min_leaf: int = 20) -> tuple[str, Node | None, DataFrame]:
    """Grow a tree on ``(pe_id, y, features array<string>)``.

    Gives a status (``ok``, ``no_patterns``, ``too_few_samples``, ``constant_y``), the root
    and the rows with their leaf number. Squared error decides; ties go to the smallest name.
    """
    rows = written(rows.where("y is not null"), "tree")
    status, root = grow(rows.select("features", F.lit(1).alias("n"), F.col("y").alias("s"), F.col("y").alias("low"), F.col("y").alias("high")), max_depth, min_leaf)
    return status, root, leaf_of(rows, root)


def leaf_of(rows: DataFrame, root: Node | None) -> DataFrame:
    """Rows with ``features`` and the number of their leaf, 0 without a tree."""
    return rows.withColumn("leaf", F.lit(0) if root is None else _assign(root))


def grow(kinds: DataFrame, max_depth: int = 3, min_leaf: int = 20) -> tuple[str, Node | None]:
    """The tree of ``(features, n, s, low, high)``: number, sum and extremes of y of rows with the same features."""
    whole = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"), F.max(F.size("features")).alias("most")).first()
    root = Node((), whole.n, whole.s / whole.n if whole.n else 0.0)
    status = "ok" if whole.n else "too_few_samples"
    if whole.n and not whole.most:
        status = "no_patterns"
    elif whole.n < 2 * min_leaf:
        status = "too_few_samples"
    elif whole.low == whole.high:
        status = "constant_y"
    if status != "ok":
        return status, None
    for _ in range(max_depth):
        current = kinds.withColumn("leaf", _assign(root))
        totals = {r.leaf: (r.n, r.s) for r in current.groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}  # one row for each leaf
        per = current.select("leaf", "n", "s", F.explode(F.array_distinct("features")).alias("f")).groupBy("leaf", "f").agg(F.sum("n").alias("n1"), F.sum("s").alias("s1"))
        whole_leaf = F.create_map(*[x for k, (n, s) in totals.items() for x in (F.lit(k), F.struct(F.lit(n).alias("n"), F.lit(float(s)).alias("s")))])
        t = whole_leaf[F.col("leaf")]
        n0, s0 = t["n"] - F.col("n1"), t["s"] - F.col("s1")
        gain = F.col("s1") * F.col("s1") / F.col("n1") + s0 * s0 / n0 - t["s"] * t["s"] / t["n"]
        ranked = per.where((F.col("n1") >= min_leaf) & (n0 >= min_leaf)).withColumn("gain", F.round(gain, 9))
        first = F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("gain"), "f"))
        best = ranked.withColumn("i", first).where("i = 1 and gain > 0").select("leaf", "f", "n1", "s1").collect()  # one row for each leaf
        if not best:
            break
        leaves = root.leaves()
        for r in best:
            node, (n, s) = leaves[r.leaf], totals[r.leaf]
            node.feature = r.f
            node.children = (Node((*node.path, (r.f, False)), n - r.n1, (s - r.s1) / (n - r.n1)), Node((*node.path, (r.f, True)), r.n1, r.s1 / r.n1))
    return "ok", root


def quality(root: Node, rows: DataFrame) -> DataFrame:
    """R squared, mean absolute error and the gap between the highest and the lowest leaf."""
    means = F.create_map(*[x for i, leaf in enumerate(root.leaves()) for x in (F.lit(i), F.lit(float(leaf.mean)))])
    e = rows.withColumn("p", means[F.col("leaf")])
    gap = max(x.mean for x in root.leaves()) - min(x.mean for x in root.leaves())
    sse = F.sum(F.pow(F.col("y") - F.col("p"), 2))
    return e.agg((1 - sse / (F.var_pop("y") * F.count("y"))).alias("r2"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"), F.lit(gap).alias("gap"), F.count("y").alias("n"))


def leaf_table(root: Node, rows: DataFrame) -> DataFrame:
    """``(leaf, label, n, mean)`` of the leaves."""
    labels = F.create_map(*[x for i, leaf in enumerate(root.leaves()) for x in (F.lit(i), F.lit(leaf.label()))])
    return rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean")).select("leaf", labels[F.col("leaf")].alias("label"), "n", "mean")


def relation(n_a: Column, n_b: Column, n_both: Column, n: Column) -> Column:
    """Set relation of two patterns' executions, the first that holds."""
    return (
        F.when((n_a == 0) | (n_b == 0) | (n_a == n) | (n_b == n), "trivial")
        .when((n_both == 0) & (n_a + n_b == n), "complement")
        .when(n_both == 0, "mutually_exclusive")
        .when((n_both == n_a) & (n_both == n_b), "equivalent")
        .when(n_both == n_a, "implies_a_to_b")
        .when(n_both == n_b, "implies_b_to_a")
        .otherwise("overlap")
    )


def relations(hits: DataFrame, n_executions: int) -> DataFrame:
    """Every pair of patterns with the number of common executions and their relation."""
    own = hits.select("pattern_id", "pe_id").distinct()
    n = own.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"))
    both = own.withColumnRenamed("pattern_id", "a").join(own.withColumnRenamed("pattern_id", "b"), "pe_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    a, b = n.select(F.col("pattern_id").alias("a"), F.col("n").alias("n_a")), n.select(F.col("pattern_id").alias("b"), F.col("n").alias("n_b"))
    pairs = a.join(b, F.col("a") < F.col("b")).join(both, ["a", "b"], "left").withColumn("n_both", F.coalesce("n_both", F.lit(0)))
    return pairs.select("a", "b", "n_a", "n_b", "n_both", relation(F.col("n_a"), F.col("n_b"), F.col("n_both"), F.lit(n_executions)).alias("relation"))


def overlaps(members: DataFrame) -> DataFrame:
    """For leaves of different trees the common executions, their share of the first leaf, and its entropy over the second tree.

    ``members(tree, leaf, pe_id)``.
    """
    a = members.select(F.col("tree").alias("tree_a"), F.col("leaf").alias("leaf_a"), "pe_id")
    b = members.select(F.col("tree").alias("tree_b"), F.col("leaf").alias("leaf_b"), "pe_id")
    both = a.join(b, "pe_id").where("tree_a != tree_b").groupBy("tree_a", "leaf_a", "tree_b", "leaf_b").agg(F.count(F.lit(1)).alias("n_both"))
    w = Window.partitionBy("tree_a", "leaf_a", "tree_b")
    p = F.col("n_both") / F.sum("n_both").over(w)
    return both.withColumn("share", p).withColumn("entropy", -F.sum(F.col("share") * F.log2("share")).over(w))


def compact_cross(crossed: DataFrame) -> DataFrame:
    """For each leaf and other tree the best leaf; trees that spread it over the fewest leaves, then overlap most, come first."""
    w = Window.partitionBy("tree_a", "leaf_a", "tree_b")
    best = crossed.withColumns({"n_leaves": F.count(F.lit(1)).over(w), "i": F.row_number().over(w.orderBy(F.desc("n_both"), "leaf_b"))}).where("i = 1")
    order = Window.partitionBy("tree_a", "leaf_a").orderBy("n_leaves", F.desc("n_both"), "entropy", F.desc("share"), "tree_b")
    return best.withColumn("rank", F.row_number().over(order)).drop("i")


def rank_configs(summaries: DataFrame) -> DataFrame:
    """Score ``0.6 gap / max gap + 0.3 r2 clipped to [0, 1] + 0.1 pairs / max pairs`` of ``(config, gap, r2, pairs)``."""
    top = summaries.agg(F.max("gap").alias("g"), F.max("pairs").alias("p"))
    part = lambda c, m: F.when(F.col(m) > 0, F.col(c) / F.col(m)).otherwise(0.0)
    score = 0.6 * part("gap", "g") + 0.3 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl("r2", F.lit(0.0)), F.lit(0.0)))) + 0.1 * part("pairs", "p")
    return summaries.join(F.broadcast(top)).select("config", "gap", "r2", "pairs", score.alias("score")).orderBy(F.desc("score"), "config")  # one row
