"""Attribute hierarchies: functional dependencies, cover relations and level configurations."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlog.model import Log
from braidlog.operators.attributes import long


def atoms(log: Log, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Attributes of each type with at least two different values."""
    return long(log).where(~F.col("field").isin(list(exclude))).groupBy("object_type", "field").agg(F.count_distinct("value").alias("n_values")).where("n_values >= 2")


def block_keys(log: Log, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``(object_type, object_id, field, block)``: the value, or a block of its own where it is missing."""
    names = atoms(log, exclude).select("object_type", "field")
    every = log.objects.join(F.broadcast(names), "object_type")  # few rows
    value = F.try_element_at("attrs", F.col("field"))
    return every.select("object_type", "object_id", "field", F.coalesce(F.concat(F.lit("V"), value), F.concat(F.lit("M"), "object_id")).alias("block"))


def dependencies(log: Log, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``(object_type, a, b, holds)`` for all pairs of attributes: whether every block of a lies in one of b.

    One aggregation by (a, block, b): least and greatest block of b are equal.
    """
    keys = block_keys(log, exclude)
    a = keys.select("object_type", "object_id", F.col("field").alias("a"), F.col("block").alias("block_a"))
    b = keys.select("object_type", "object_id", F.col("field").alias("b"), F.col("block").alias("block_b"))
    pairs = a.join(b, ["object_type", "object_id"]).where("a != b").groupBy("object_type", "a", "b", "block_a").agg((F.min("block_b") == F.max("block_b")).alias("one"))
    return pairs.groupBy("object_type", "a", "b").agg(F.bool_and("one").alias("holds"))


class Hierarchy:
    """Levels of one type: 0 is the id, 1 to n are attributes, n + 1 the type itself.

    ``up[l]`` are the levels that cover l (the next coarser ones), ``down`` the reverse.
    """

    def __init__(self, object_type: str, names: list[str], holds: set[tuple[str, str]]) -> None:
        kept: list[str] = []
        for name in names:  # equivalent attributes: the first stays
            if not any((name, k) in holds and (k, name) in holds for k in kept):
                kept.append(name)
        self.object_type, self.names = object_type, kept
        self.top = len(kept) + 1
        finer = {(i, j) for i, a in enumerate(kept, 1) for j, b in enumerate(kept, 1) if (a, b) in holds}
        finer |= {(0, j) for j in range(1, self.top + 1)} | {(i, self.top) for i in range(self.top)}
        self.finer = finer
        covers = {(i, j) for i, j in finer if not any((i, k) in finer and (k, j) in finer for k in range(self.top + 1))}
        self.up = {i: sorted(j for a, j in covers if a == i) for i in range(self.top + 1)}
        self.down = {j: sorted(i for i, b in covers if b == j) for j in range(self.top + 1)}

    def label(self, level: int) -> str:
        return "id" if level == 0 else "type" if level == self.top else self.names[level - 1]

    def at_most(self, a: int, b: int) -> bool:
        return a == b or (a, b) in self.finer

    def height(self, level: int) -> int:
        """Longest way down to the id."""
        return max((1 + self.height(d) for d in self.down[level]), default=0)


def build(log: Log, types: list[str] | None = None, exclude: tuple[str, ...] = ()) -> dict[str, Hierarchy]:
    """Hierarchies of all types. Attribute pairs are few, so they are collected."""
    names: dict[str, list[str]] = {}
    for r in atoms(log, exclude).orderBy("object_type", "field").collect():
        names.setdefault(r.object_type, []).append(r.field)
    holds: dict[str, set[tuple[str, str]]] = {}
    for r in dependencies(log, exclude).where("holds").collect():
        holds.setdefault(r.object_type, set()).add((r.a, r.b))
    every = types or sorted(r.object_type for r in log.objects.select("object_type").distinct().collect())
    return {t: Hierarchy(t, names.get(t, []), holds.get(t, set())) for t in every}


Config = tuple[int, ...]


class Lattice:
    """Level configurations, one level for each type, ordered componentwise."""

    def __init__(self, hierarchies: dict[str, Hierarchy]) -> None:
        self.types = sorted(hierarchies)
        self.hierarchies = [hierarchies[t] for t in self.types]
        self.top: Config = tuple(h.top for h in self.hierarchies)
        self.bottom: Config = tuple(0 for _ in self.hierarchies)

    def below(self, config: Config) -> list[Config]:
        """Configurations one cover step finer."""
        return sorted(config[:i] + (d,) + config[i + 1 :] for i, h in enumerate(self.hierarchies) for d in h.down[config[i]])

    def above(self, config: Config) -> list[Config]:
        return sorted(config[:i] + (u,) + config[i + 1 :] for i, h in enumerate(self.hierarchies) for u in h.up[config[i]])

    def at_most(self, a: Config, b: Config) -> bool:
        return all(h.at_most(x, y) for h, x, y in zip(self.hierarchies, a, b, strict=True))

    def height(self, config: Config) -> int:
        return sum(h.height(x) for h, x in zip(self.hierarchies, config, strict=True))

    def walk(self) -> Iterator[Config]:
        """All configurations, breadth first from the top."""
        queue, seen = [self.top], {self.top}
        while queue:
            config = queue.pop(0)
            yield config
            for finer in self.below(config):
                if finer not in seen:
                    seen.add(finer)
                    queue.append(finer)

    def text(self, config: Config) -> str:
        return ", ".join(f"{t}={h.label(x)}" for t, h, x in zip(self.types, self.hierarchies, config, strict=True))


def level_labels(log: Log, hierarchy: Hierarchy) -> DataFrame:
    """``(object_id, level, label)``; a missing attribute is ``?<attr>=<id>``, so the object stays apart."""
    own = log.objects.where(F.col("object_type") == hierarchy.object_type)
    labels = [F.struct(F.lit(0).alias("level"), F.col("object_id").alias("label"))]
    for i, name in enumerate(hierarchy.names, 1):
        labels.append(F.struct(F.lit(i).alias("level"), F.coalesce(F.try_element_at("attrs", F.lit(name)), F.concat(F.lit(f"?{name}="), "object_id")).alias("label")))
    labels.append(F.struct(F.lit(hierarchy.top).alias("level"), F.lit(hierarchy.object_type).alias("label")))
    return own.select("object_id", F.explode(F.array(*labels)).alias("l")).select("object_id", "l.level", "l.label")


def relabel(log: Log, lattice: Lattice, config: Config) -> DataFrame:
    """``(object_id, object_type, label)`` of every object under a configuration."""
    out = None
    for h, level in zip(lattice.hierarchies, config, strict=True):
        part = level_labels(log, h).where(F.col("level") == level).select("object_id", F.lit(h.object_type).alias("object_type"), "label")
        out = part if out is None else out.union(part)
    return out


def allowed_levels(lattice: Lattice, configs: list[Config], object_type: str, others: dict[str, int]) -> list[int]:
    """Levels of a type that some configuration has together with the other choices."""
    at = {t: i for i, t in enumerate(lattice.types)}
    return sorted({c[at[object_type]] for c in configs if all(c[at[t]] == level for t, level in others.items() if t != object_type)})
