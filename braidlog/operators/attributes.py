"""Object attributes: discovery, filling, banding and shifts between groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlog.model import Log

#: Values that say an attribute is missing begin so.
MISSING = "no_"


def long(log: Log) -> DataFrame:
    """``(object_id, object_type, field, value)`` of all attributes that are not null."""
    return log.objects.select("object_id", "object_type", F.explode("attrs").alias("field", "value")).where("value is not null")


def latest(log: Log) -> DataFrame:
    """Latest real value of every changing attribute; values ``no_<field>`` are not real."""
    real = log.object_changes.where(F.col("value").isNotNull() & (F.col("value") != F.concat(F.lit(MISSING), F.col("field"))))
    return real.groupBy("object_id", "object_type", "field").agg(F.max_by("value", F.struct("ts", "value")).alias("value"))


def with_latest(log: Log) -> DataFrame:
    """Objects whose attribute maps hold the latest values."""
    new = latest(log).groupBy("object_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("new"))
    keep_old = F.map_filter("attrs", lambda k, v: ~F.array_contains(F.map_keys("new"), k))
    return log.objects.join(new, "object_id", "left").select("object_id", "object_type", F.when(F.col("new").isNull(), F.col("attrs")).otherwise(F.map_concat(keep_old, "new")).alias("attrs"))


def fields(log: Log) -> DataFrame:
    """Attribute names of each type."""
    return log.objects.select("object_type", F.explode(F.map_keys("attrs")).alias("field")).distinct()


def fill_missing(log: Log) -> DataFrame:
    """Objects in which every attribute of their type is present, ``no_<field>`` where it was not."""
    names = fields(log).groupBy("object_type").agg(F.sort_array(F.collect_set("field")).alias("names"))
    filled = F.map_from_arrays("names", F.transform("names", lambda n: F.coalesce(F.try_element_at("attrs", n), F.concat(F.lit(MISSING), n))))
    return log.objects.join(F.broadcast(names), "object_type", "left").select("object_id", "object_type", F.when(F.col("names").isNull(), F.col("attrs")).otherwise(filled).alias("attrs"))  # one row for each type


def numeric_fields(log: Log, least_distinct: int = 10) -> DataFrame:
    """Attributes whose values are all numbers, with enough different ones; most different first."""
    rows = long(log).withColumn("x", F.expr("try_cast(value as double)"))
    stats = rows.groupBy("object_type", "field").agg(
        F.count(F.lit(1)).alias("n"), F.count("x").alias("n_numeric"), F.count_distinct("x").alias("n_distinct"), F.min("x").alias("low"), F.max("x").alias("high"), F.slice(F.sort_array(F.collect_set("x")), 1, 5).alias("sample")
    )
    good = (F.col("n") >= least_distinct) & (F.col("n") == F.col("n_numeric")) & (F.col("n_distinct") >= least_distinct)
    return stats.where(good).orderBy(F.desc("n_distinct"), "object_type", "field")


def partition_1d(values: list[float], weights: list[int], k_max: int) -> list[tuple[float, list[int]]]:
    """For each k up to ``k_max`` the least within-cluster squares of sorted values, and the clusters' first positions."""
    n = len(values)
    w, s, q = [0.0], [0.0], [0.0]
    for v, m in zip(values, weights, strict=True):
        w.append(w[-1] + m)
        s.append(s[-1] + m * v)
        q.append(q[-1] + m * v * v)

    def cost(i: int, j: int) -> float:
        total = w[j] - w[i]
        return max(0.0, q[j] - q[i] - (s[j] - s[i]) ** 2 / total)

    best = [cost(0, j) if j else 0.0 for j in range(n + 1)]
    cuts: list[list[int]] = []
    out = [(best[n], [0])]
    for k in range(2, min(k_max, n) + 1):
        new, cut = [0.0] * (n + 1), [0] * (n + 1)

        def fill(lo: int, hi: int, a: int, b: int, best: list = best, new: list = new, cut: list = cut, k: int = k) -> None:
            """Divide and conquer: the best cut does not move left as the end moves right."""
            if lo > hi:
                return
            mid = (lo + hi) // 2
            found = min((best[i] + cost(i, mid), i) for i in range(max(a, k - 1), min(b, mid - 1) + 1))
            new[mid], cut[mid] = found
            fill(lo, mid - 1, a, found[1])
            fill(mid + 1, hi, found[1], b)

        fill(k, n, k - 1, n - 1)
        cuts.append(cut)
        best = new
        firsts, end = [], n
        for c in reversed(cuts):
            firsts.append(c[end])
            end = c[end]
        out.append((best[n], [0, *reversed(firsts)]))
    return out


def elbow(inertias: list[float], k_max: int) -> int:
    """Number of clusters at the sharpest bend of the normalised inertias."""
    if len(inertias) <= 2:
        return len(inertias)
    scaled = [x / inertias[0] if inertias[0] else 0.0 for x in inertias]
    bends = [scaled[i] - 2 * scaled[i + 1] + scaled[i + 2] for i in range(len(scaled) - 2)]
    return max(2, min(bends.index(max(bends)) + 3, k_max))


def bands(log: Log, object_type: str, field: str, k: int | None = None, k_max: int = 8, most_values: int = 2000) -> DataFrame:
    """Ordered value bands ``(band, low, high, n)`` of a numeric attribute by exact one-dimensional k-means.

    The weighted distinct values are first gathered into at most ``most_values`` quantile
    groups, so the solver's input is bounded; with fewer distinct values it is exact.
    """
    rows = long(log).where((F.col("object_type") == object_type) & (F.col("field") == field)).withColumn("x", F.expr("try_cast(value as double)")).where("x is not null")
    counts = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    if counts.count() > most_values:
        points = rows.agg(F.percentile_approx("x", [i / most_values for i in range(1, most_values)], 10 * most_values).alias("p")).first().p
        lows = sorted(set(points))
        slot = F.size(F.filter(F.lit(lows), lambda p: p <= F.col("x")))
        counts = rows.groupBy(slot.alias("slot")).agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n")).select("x", "n")
    data = sorted((r.x, r.n) for r in counts.collect())  # at most ``most_values`` rows
    values, weights = [x for x, _ in data], [n for _, n in data]
    if not values:
        return log.spark.createDataFrame([], "band string, low double, high double, n long")
    solved = partition_1d(values, weights, min(k_max, 10, len(values)))
    chosen = max(1, min(k or elbow([c for c, _ in solved], k_max), len(values)))
    firsts = solved[chosen - 1][1]
    out = []
    for b, (i, j) in enumerate(zip(firsts, [*firsts[1:], len(values)], strict=True), 1):
        out.append((f"band_{b}", float(values[i]), float(values[j - 1]), int(sum(weights[i:j]))))
    return log.spark.createDataFrame(out, "band string, low double, high double, n long")


def with_bands(log: Log, object_type: str, field: str, table: DataFrame) -> DataFrame:
    """Objects with an attribute ``<field>_band``; the band whose lower end is the nearest below the value."""
    lows = [(r.low, r.band) for r in table.orderBy("low").collect()]  # one row for each band
    x = F.expr(f"try_cast(attrs['{field}'] as double)")
    label: Column = F.lit(None).cast("string")
    for low, band in lows:
        label = F.when(x >= low, band).otherwise(label)
    if lows:
        label = F.when(x < lows[0][0], lows[0][1]).otherwise(label)
    added = F.map_concat("attrs", F.create_map(F.lit(f"{field}_band"), label))
    return log.objects.withColumn("attrs", F.when((F.col("object_type") == object_type) & x.isNotNull(), added).otherwise(F.col("attrs")))


def fingerprint(log: Log, pe_objects: DataFrame) -> DataFrame:
    """``(pe_id, object_type, field, value)``: the commonest value among an execution's objects; ties go to the smallest."""
    rows = pe_objects.select("pe_id", "object_id").distinct().join(long(log), "object_id")
    n = rows.groupBy("pe_id", "object_type", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("pe_id", "object_type", "field").orderBy(F.desc("n"), "value"))
    return n.withColumn("i", first).where("i = 1").select("pe_id", "object_type", "field", "value")


def shift(prints: DataFrame, groups: DataFrame, top: int = 6) -> DataFrame:
    """How attribute values differ between the executions in and out of a group.

    ``groups(pe_id, inside boolean)``. Shares are of the whole group, also where the
    attribute is missing. Gives the ``top`` values by absolute difference for each
    attribute, rounded to 4 digits, with the attribute's largest difference as score.
    """
    sizes = groups.agg(F.sum(F.when(F.col("inside"), 1).otherwise(0)).alias("n_in"), F.sum(F.when(F.col("inside"), 0).otherwise(1)).alias("n_out"))
    counts = prints.join(groups, "pe_id").groupBy("object_type", "field", "value").agg(
        F.sum(F.when(F.col("inside"), 1).otherwise(0)).alias("c_in"), F.sum(F.when(F.col("inside"), 0).otherwise(1)).alias("c_out")
    )
    share = lambda c, n: F.when(F.col(n) > 0, F.col(c) / F.col(n)).otherwise(0.0)
    rows = counts.join(F.broadcast(sizes)).select("object_type", "field", "value", share("c_in", "n_in").alias("p_in"), share("c_out", "n_out").alias("p_out"))  # one row
    rows = rows.withColumn("delta", F.round(F.col("p_in") - F.col("p_out"), 4))
    w = Window.partitionBy("object_type", "field")
    ranked = rows.withColumns({"score": F.max(F.abs("delta")).over(w), "i": F.row_number().over(w.orderBy(F.desc(F.abs("delta")), "value"))})
    return ranked.where(F.col("i") <= top).select("object_type", "field", "value", F.round("p_in", 4).alias("p_in"), F.round("p_out", 4).alias("p_out"), "delta", "score")


def high_low(kpi: DataFrame) -> DataFrame:
    """Executions strictly above (inside) and below the median of ``(pe_id, value)``; none with fewer than four."""
    cut = kpi.agg(F.median("value").alias("m"), F.count("value").alias("n"))
    return kpi.join(F.broadcast(cut)).where("n >= 4 and value != m").select("pe_id", (F.col("value") > F.col("m")).alias("inside"))  # one row


def qualifier_conformance(log: Log, object_type: str, field: str, allowed: DataFrame) -> DataFrame:
    """Relations by qualifier and the object's latest attribute value, and whether the pair is allowed.

    ``allowed(qualifier, value)`` lists the permitted pairs.
    """
    value = with_latest(log).where(F.col("object_type") == object_type).select("object_id", F.try_element_at("attrs", F.lit(field)).alias("value"))
    rows = log.e2o.join(value, "object_id").groupBy("qualifier", "value").agg(F.count(F.lit(1)).alias("n"))
    ok = allowed.select("qualifier", "value", F.lit(True).alias("ok"))
    return rows.join(F.broadcast(ok), ["qualifier", "value"], "left").select("qualifier", "value", "n", F.coalesce("ok", F.lit(False)).alias("permitted"))


def o2o_qualifier_conformance(log: Log, source_type: str, target_type: str, allowed: list[str]) -> DataFrame:
    """For every event, pairs of a source and a target object by the qualifier of their relation; ``missing`` without one."""
    a = log.e2o.where(F.col("object_type") == source_type).select("event_id", F.col("object_id").alias("source_id"))
    b = log.e2o.where(F.col("object_type") == target_type).select("event_id", F.col("object_id").alias("target_id"))
    pairs = a.join(b, "event_id").join(log.o2o, ["source_id", "target_id"], "left").select(F.coalesce("qualifier", F.lit("missing")).alias("qualifier"))
    return pairs.groupBy("qualifier").agg(F.count(F.lit(1)).alias("n")).withColumn("permitted", F.col("qualifier").isin(allowed))


def over_time(log: Log, object_type: str, target: str, group: str) -> DataFrame:
    """``(group, ts, n, mean)``: a numeric attribute's changes over time, by the value of another one.

    An object's ``group`` value holds from the change that sets it until the next; changes of
    the target before the first have a null group. Values that are not numbers are left out.
    """
    own = log.object_changes.where((F.col("object_type") == object_type) & F.col("field").isin(target, group))
    until_now = Window.partitionBy("object_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.max_by(F.when(F.col("field") == group, F.col("value")), F.when(F.col("field") == group, F.struct("ts", "value"))).over(until_now)
    changes = own.select("ts", "field", F.expr("try_cast(value AS double)").alias("number"), held.alias("group"))
    return changes.where((F.col("field") == target) & F.col("number").isNotNull()).groupBy("group", "ts").agg(F.count(F.lit(1)).alias("n"), F.avg("number").alias("mean"))
