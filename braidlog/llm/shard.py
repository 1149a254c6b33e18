"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At every level each child draws
``ln(u) / weight`` from a hash of the row's key and the child's name, and the largest
draw wins: a child is chosen in proportion to its weight, and raising one weight only
attracts rows to that child. Movement is therefore confined to the subtrees whose weights
change. Shards fill racks and racks fill regions in order; a shard that is added later
opens a region of its own, so it takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlog.functions.runtime import shuffle_partitions, written

SHARDS_PER_RACK, RACKS_PER_REGION = 4, 2
OVERHEAD = 16


def tree(weights: Sequence[float], shards_per_rack: int = SHARDS_PER_RACK, racks_per_region: int = RACKS_PER_REGION) -> tuple[list, list, list]:
    """Weights by level: of each region, of each region's racks, of each rack's shards."""
    if not weights or min(weights) <= 0:
        raise ValueError("a tree needs shards of positive weight")
    racks = [list(weights[i : i + shards_per_rack]) for i in range(0, len(weights), shards_per_rack)]
    regions = [[sum(r) for r in racks[i : i + racks_per_region]] for i in range(0, len(racks), racks_per_region)]
    return [sum(r) for r in regions], regions, racks


def _pick(key: Column, level: str, parent: Column, weights: Column) -> Column:
    """Index of the child with the largest weighted draw."""

    def draw(weight: Column, i: Column) -> Column:
        h = F.xxhash64(F.lit(level), parent, i, key).bitwiseAND(F.lit((1 << 53) - 1))
        u = (h.cast("double") + 1.0) / float(1 << 53)
        return F.struct((F.log(u) / weight).alias("score"), (-i).alias("i"))

    return -F.array_max(F.transform(weights, draw))["i"]


def place(key: Column, weights: Sequence[float], shards_per_rack: int = SHARDS_PER_RACK, racks_per_region: int = RACKS_PER_REGION, added: Sequence[float] = ()) -> Column:
    """Shard of a key, from 0; each weight of ``added`` is one more shard in a region of its own."""
    top, regions, racks = tree(weights, shards_per_rack, racks_per_region)
    real = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    nested = lambda xss: F.array(*[real(xs) for xs in xss])
    region = _pick(key, "region", F.lit(0), real([*top, *added]))
    rack = region * racks_per_region + _pick(key, "rack", region, F.get(nested(regions), region))
    own = rack * shards_per_rack + _pick(key, "shard", rack, F.get(nested(racks), rack))
    return F.when(region >= len(top), region - len(top) + len(weights)).otherwise(own).cast("int")


def shard(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] | None = None) -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard)`` of every row.

    The id and the tree decide the shard (law ``key``); ``grown_shard`` is the shard with
    one more of average weight. A null id is a key like any other, a null text is empty.
    Slots number the rows of a shard from 0 without gaps, in groups of rows that are dealt
    evenly whatever the ids are, so repeated ids and hot shards need no large task.
    An empty table gives an empty result; other columns are not read.
    """
    weights = list(weights or [1.0] * n_shards)
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    spread = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body")).select(
        "id",
        (F.octet_length("body") + OVERHEAD).cast("long").alias("size"),
        F.crc32("body").alias("text_crc32"),
        place(F.col("id"), weights).alias("shard"),
        place(F.col("id"), weights, added=[sum(weights) / len(weights)]).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(spread)).cast("int")), "shards")
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    starts = counts.select("shard", "part", before.alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "row")) - 1
    return (
        rows.withColumn("k", within)
        .join(starts, ["shard", "part"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("k")).cast("long").alias("slot"), "grown_shard")
    )
