"""Object-centric Petri nets: model, discovery from directly-follows graphs, projections and reductions.

Nets are small driver objects; only the directly-follows counts and the variable-arc test
run in Spark.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from braidlog.model import Log
from braidlog.operators.executions import in_order, let
from braidlog.operators.traces import activity_steps, steps_of


@dataclass(frozen=True)
class Place:
    name: str
    object_type: str
    initial: bool = False
    final: bool = False


@dataclass(frozen=True)
class Transition:
    name: str
    label: str | None = None  # None: silent


@dataclass(frozen=True)
class Arc:
    source: str
    target: str
    variable: bool = False
    weight: int = 1


@dataclass
class Net:
    """Places, transitions and arcs by name."""

    places: dict[str, Place] = field(default_factory=dict)
    transitions: dict[str, Transition] = field(default_factory=dict)
    arcs: set[Arc] = field(default_factory=set)

    def pre(self, name: str) -> set[str]:
        return {a.source for a in self.arcs if a.target == name}

    def post(self, name: str) -> set[str]:
        return {a.target for a in self.arcs if a.source == name}

    def drop(self, names: set[str]) -> Net:
        """The net without some places and transitions, and their arcs."""
        return Net({k: v for k, v in self.places.items() if k not in names}, {k: v for k, v in self.transitions.items() if k not in names}, {a for a in self.arcs if a.source not in names and a.target not in names})

    def _closure(self, name: str, step) -> set[str]:
        seen, queue = set(), [name]
        while queue:
            for n in step(queue.pop()):
                if n not in seen:
                    seen.add(n)
                    queue.append(n)
        return seen

    def descendants(self, name: str) -> set[str]:
        return self._closure(name, self.post)

    def ancestors(self, name: str) -> set[str]:
        return self._closure(name, self.pre)

    def object_types(self) -> list[str]:
        return sorted({p.object_type for p in self.places.values()})

    def on_types(self, types: list[str]) -> Net:
        """The net of some object types; transitions without places go."""
        out = self.drop({n for n, p in self.places.items() if p.object_type not in types})
        return out.drop({t for t in out.transitions if not out.pre(t) and not out.post(t)})

    def between(self, sources: list[str], targets: list[str]) -> Net:
        """The part on paths from source to target labels."""
        names = {t.label: n for n, t in self.transitions.items() if t.label}
        down = set().union(*({names[s], *self.descendants(names[s])} for s in sources if s in names))
        up = set().union(*({names[t], *self.ancestors(names[t])} for t in targets if t in names))
        keep = down & up
        return self.drop({*self.places, *self.transitions} - keep)

    def hide(self, labels: list[str]) -> Net:
        """Make transitions silent."""
        return Net(dict(self.places), {n: Transition(n) if t.label in labels else t for n, t in self.transitions.items()}, set(self.arcs))

    def enabled(self, marking: Counter, transition: str) -> bool:
        """Enabled for one object: its type's input places hold tokens."""
        return all(marking[p] > 0 for p in self.pre(transition))

    def fire(self, marking: Counter, transition: str) -> Counter:
        out = Counter(marking)
        out.subtract(self.pre(transition))
        out.update(self.post(transition))
        return +out

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Places, transitions and arcs as DataFrames."""
        places = spark.createDataFrame([(p.name, p.object_type, p.initial, p.final) for p in self.places.values()], "name string, object_type string, initial boolean, final boolean")
        transitions = spark.createDataFrame([(t.name, t.label) for t in self.transitions.values()], "name string, label string")
        arcs = spark.createDataFrame([(a.source, a.target, a.variable, a.weight) for a in sorted(self.arcs, key=lambda a: (a.source, a.target))], "source string, target string, variable boolean, weight int")
        return places, transitions, arcs


def marking_after(deltas: DataFrame) -> DataFrame:
    """``(place, object_id, n)`` from signed token moves; places without tokens go."""
    return deltas.groupBy("place", "object_id").agg(F.sum("delta").alias("n")).where("n != 0")


# --- discovery -----------------------------------------------------------------------------

Tree = tuple  # ("act", label) | ("tau",) | (operator, child, ...)


def _components(nodes: set[str], edges: set[tuple[str, str]]) -> list[set[str]]:
    left, out = set(nodes), []
    while left:
        part, queue = set(), [min(left)]
        while queue:
            n = queue.pop()
            if n in part:
                continue
            part.add(n)
            queue += [b for a, b in edges if a == n] + [a for a, b in edges if b == n]
        out.append(part)
        left -= part
    return out


def _reach(nodes: set[str], edges: set[tuple[str, str]]) -> dict[str, set[str]]:
    out = {}
    for n in nodes:
        seen, queue = set(), [n]
        while queue:
            for a, b in edges:
                if a == queue[-1] and b not in seen:
                    seen.add(b)
                    queue.append(b)
                    break
            else:
                queue.pop()
        out[n] = seen
    return out


def process_tree(nodes: set[str], edges: set[tuple[str, str]], starts: set[str], ends: set[str]) -> Tree:
    """Inductive cuts of a directly-follows graph: exclusive, sequence, parallel, loop, else any order."""
    if not nodes:
        return ("tau",)
    if len(nodes) == 1:
        (n,) = nodes
        return ("loop", ("act", n), ("tau",)) if (n, n) in edges else ("act", n)

    def sub(part: set[str], own_starts: set[str], own_ends: set[str]) -> Tree:
        return process_tree(part, {(a, b) for a, b in edges if a in part and b in part}, own_starts & part or part & starts or part, own_ends & part or part & ends or part)

    parts = _components(nodes, edges)
    if len(parts) > 1:
        return ("xor", *[sub(p, starts, ends) for p in sorted(parts, key=min)])
    reach = _reach(nodes, edges)
    groups: list[set[str]] = []
    for n in sorted(nodes):  # nodes that reach each other, or neither way, belong together
        own = {n} | {m for m in nodes if (m in reach[n]) == (n in reach[m]) and m != n}
        merged = [g for g in groups if g & own]
        groups = [g for g in groups if not g & own] + [own.union(*merged)]
    if len(groups) > 1:
        groups = sorted(groups, key=lambda g: sum(any(m in reach[n] for n in o for m in g) for o in groups if o is not g))
        children = []
        for i, g in enumerate(groups):
            into = {b for a, b in edges if a not in g and b in g} | (starts & g)
            outof = {a for a, b in edges if a in g and b not in g} | (ends & g)
            child = sub(g, into, outof)
            before, after = set().union(*groups[:i]), set().union(*groups[i + 1 :])
            skips = any((a in before and b in after) for a, b in edges) or (not before and bool(starts & after)) or (not after and bool(ends & before))
            children.append(("xor", child, ("tau",)) if skips else child)
        return ("seq", *children)
    both = {(a, b) for a in nodes for b in nodes if a != b and not ((a, b) in edges and (b, a) in edges)}
    parts = _components(nodes, both)
    if len(parts) > 1 and all(p & starts and p & ends for p in parts):
        return ("and", *[sub(p, starts, ends) for p in sorted(parts, key=min)])
    body = starts | ends
    rest = _components(nodes - body, {(a, b) for a, b in edges if a not in body and b not in body})
    redo = [p for p in rest if all(a in ends for a, b in edges if b in p and a in body) and all(b in starts for a, b in edges if a in p and b in body)]
    if redo:
        own = nodes - set().union(*redo)
        return ("loop", sub(own, starts, ends), *[sub(p, {b for a, b in edges if b in p and a not in p}, {a for a, b in edges if a in p and b not in p}) for p in sorted(redo, key=min)])
    return ("loop", ("tau",), *[("act", n) for n in sorted(nodes)])


def tree_net(tree: Tree, object_type: str) -> Net:
    """Workflow net of a process tree; node names carry the type."""
    net, count = Net(), Counter()

    def place(**flags: bool) -> str:
        count["p"] += 1
        name = f"{object_type}/p{count['p']}"
        net.places[name] = Place(name, object_type, **flags)
        return name

    def transition(label: str | None) -> str:
        count["t"] += 1
        name = label or f"{object_type}/t{count['t']}"
        net.transitions[name] = Transition(name, label)
        return name

    def link(a: str, t: str, b: str) -> None:
        net.arcs.update({Arc(a, t), Arc(t, b)})

    def build(node: Tree, a: str, b: str) -> None:
        kind, *children = node
        if kind in ("act", "tau"):
            link(a, transition(children[0] if children else None), b)
        elif kind == "xor":
            for c in children:
                build(c, a, b)
        elif kind == "seq":
            at = a
            for c in children[:-1]:
                nxt = place()
                build(c, at, nxt)
                at = nxt
            build(children[-1], at, b)
        elif kind == "and":
            split, join = transition(None), transition(None)
            net.arcs.update({Arc(a, split), Arc(join, b)})
            for c in children:
                x, y = place(), place()
                net.arcs.update({Arc(split, x), Arc(y, join)})
                build(c, x, y)
        else:
            x, y = place(), place()
            link(a, transition(None), x)
            link(y, transition(None), b)
            build(children[0], x, y)
            for c in children[1:]:
                build(c, y, x)

    build(tree, place(initial=True), place(final=True))
    return net


def _sizes(objects: Column) -> Column:
    """Of an event's objects, each type with the number of its different ids."""
    ids = lambda t: F.filter(objects, lambda o: (o["object_type"] == t) & o["object_id"].isNotNull())
    kinds = F.array_distinct(F.transform(objects, lambda o: o["object_type"]))
    return F.transform(kinds, lambda t: F.struct(t.alias("object_type"), F.size(F.array_distinct(F.transform(ids(t), lambda o: o["object_id"]))).alias("n")))


def _with(events: DataFrame) -> list[Row]:
    """For each activity and type, how many events have it and how many objects at most."""
    per = events.select("activity", F.explode(_sizes(F.col("objects"))).alias("k"))
    return per.groupBy("activity", "k.object_type").agg(F.count(F.lit(1)).alias("with"), F.max("k.n").alias("most")).collect()  # a row for each pair


def _counted(log: Log, types: list[str] | None) -> tuple[list[Row], list[Row], dict[str, int]]:
    """Steps of traces, events with each type, and events, by activity."""
    steps = activity_steps(log if types is None else log.on_types(types)).collect()  # triples of activities by type
    total = {r.activity: r.n for r in log.events.groupBy("activity").agg(F.count(F.lit(1)).alias("n")).collect()}
    return steps, _with(log.packed().where("event_id is not null")), total


def _seen(log: Log, types: list[str]) -> tuple[list[Row], list[Row], dict[str, int]]:
    """``_counted`` where the cases of a type are known: its traces are the cases, and the others' come from their events."""
    own = log.cased()
    at = let(F.transform(in_order(), lambda e: e["activity"]), lambda acts: F.transform(acts, lambda a, i: F.struct(F.lit("step").alias("kind"), F.lit(own).alias("object_type"), F.get(acts, i - 1).alias("before"), a.alias("activity"), (i == 0).alias("first"), (i == F.size(acts) - 1).alias("last"), F.lit(0).alias("size"))))
    cases = log.cases_of(own).select("pe_id", "events", at.alias("steps"))
    ids = lambda e: F.transform(F.filter(e["objects"], lambda o: o["object_type"] == own), lambda o: o["object_id"])
    once = F.filter("events", lambda e: F.array_min(ids(e)).eqNullSafe(F.col("pe_id")))  # an event of several cases is left to the first
    none = lambda kind: F.lit(None).cast(kind)
    sizes = F.flatten(F.transform(once, lambda e: F.transform(_sizes(e["objects"]), lambda k: F.struct(F.lit("with").alias("kind"), k["object_type"].alias("object_type"), none("string").alias("before"), e["activity"].alias("activity"), none("boolean").alias("first"), none("boolean").alias("last"), k["n"].alias("size")))))
    rows = cases.select(F.explode(F.concat("steps", sizes)).alias("s")).select("s.*")
    found = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    if others := [t for t in types if t != own]:
        events = log.cases_of(own).withColumn("events", once).select(F.explode("events").alias("e"))
        timed = events.select("e.event_id", "e.activity", "e.ts", F.explode(F.filter("e.objects", lambda o: o["object_type"].isin(others))).alias("o"))
        steps = steps_of(timed.select("event_id", "activity", "ts", "o.object_type", "o.object_id"))
        found = found.unionByName(steps.select(F.lit("step").alias("kind"), "*", F.lit(0).alias("size")))
    tables = found.collect()  # triples of activities by type, and an activity's numbers of objects of a type
    steps = [r for r in tables if r.kind == "step"]
    counts: dict[tuple[str, str], tuple[int, int]] = {}
    for r in tables:
        if r.kind == "with":
            n, most = counts.get((r.activity, r.object_type), (0, 0))
            counts[r.activity, r.object_type] = n + r.n, max(most, r["size"])
    per = [Row(**{"activity": a, "object_type": t, "with": n, "most": most}) for (a, t), (n, most) in counts.items()]
    if log.whole:
        return steps, per, {r.activity: r.n for r in log.events.groupBy("activity").agg(F.count(F.lit(1)).alias("n")).collect()}
    total: dict[str, int] = {}
    for r in per:
        if r.object_type == own:  # which every event has
            total[r.activity] = r["with"]
    return steps, per, total


def discover(log: Log, types: list[str] | None = None) -> Net:
    """One net for each type, merged on activities; an arc is variable if some event has not exactly one object of the type."""
    steps, per, total = _seen(log, types) if types and log.cased() in types else _counted(log, types)
    types = types or sorted({r.object_type for r in steps})
    variable = {(r.activity, r.object_type) for r in per if r.most != 1 or r["with"] < total[r.activity]}
    out = Net()
    for t in types:
        own = [r for r in steps if r.object_type == t]
        edges = {(r.before, r.activity) for r in own if not r.first}
        net = tree_net(process_tree({r.activity for r in own}, edges, {r.activity for r in own if r.first}, {r.activity for r in own if r.last}), t)
        out.places |= net.places
        out.transitions |= net.transitions
        for a in net.arcs:
            label = a.source if a.source in net.transitions else a.target
            out.arcs.add(Arc(a.source, a.target, (label, t) in variable))
    return out


# --- reduction -----------------------------------------------------------------------------


def reduce(net: Net) -> Net:
    """Six structural reductions until none applies; visible transitions and initial or final places stay.

    Series and parallel fusion of places and of transitions, and elimination of self-loop
    places and transitions.
    """
    safe_t = lambda t: net.transitions[t].label is None
    safe_p = lambda p: not (net.places[p].initial or net.places[p].final)

    def rewire(a: str, b: str, gone: set[str]) -> Net:
        """Give node ``b`` the neighbours of ``a``, then drop."""
        arcs = {Arc(b, x.target, x.variable) if x.source == a else Arc(x.source, b, x.variable) if x.target == a else x for x in net.arcs}
        return Net(net.places, net.transitions, arcs).drop(gone)

    def step() -> Net | None:
        for t in sorted(net.transitions):  # series fusion of places: p -> silent t -> q
            if safe_t(t) and len(net.pre(t)) == len(net.post(t)) == 1:
                (p,), (q,) = net.pre(t), net.post(t)
                if p != q and safe_p(p) and net.post(p) == {t} and net.places[p].object_type == net.places[q].object_type:
                    return rewire(p, q, {t, p})
                if p != q and safe_p(q) and net.pre(q) == {t} and net.post(p) == {t} and net.places[p].object_type == net.places[q].object_type:
                    return rewire(q, p, {t, q})
        for p in sorted(net.places):  # series fusion of transitions: t -> p -> silent u
            if safe_p(p) and len(net.pre(p)) == len(net.post(p)) == 1:
                (t,), (u,) = net.pre(p), net.post(p)
                if t != u and safe_t(u) and net.pre(u) == {p}:
                    return rewire(u, t, {p, u})
        for kind, safe in ((net.places, safe_p), (net.transitions, safe_t)):  # parallel fusion
            seen: dict[tuple, str] = {}
            for n in sorted(kind, key=lambda n: (safe(n), n)):
                key = (frozenset(net.pre(n)), frozenset(net.post(n)), getattr(kind[n], "object_type", None))
                if key in seen and safe(n) and (net.pre(n) or net.post(n)):
                    return net.drop({n})
                seen.setdefault(key, n)
        for t in sorted(net.transitions):  # a silent transition that gives back what it takes
            if safe_t(t) and net.pre(t) == net.post(t):
                return net.drop({t})
        for p in sorted(net.places):  # a place whose only user gives back what it takes, or without any
            into, out = [x for x in net.arcs if x.target == p], [x for x in net.arcs if x.source == p]
            if safe_p(p) and [(x.source, x.weight) for x in into] == [(x.target, x.weight) for x in out] and len(into) <= 1:
                return net.drop({p})
        return None

    while (smaller := step()) is not None:
        net = smaller
    return net
