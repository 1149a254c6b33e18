"""Operators on logs small enough to work out by hand."""

import random
from datetime import datetime, timedelta
from itertools import permutations, product

import pytest
from pyspark.sql import functions as F

from braidlog import model
from braidlog.functions.components import connected_components
from braidlog.operators import abstraction, attributes, constraints, executions, features, filters, hierarchy, impact, kpi, mining, performance, petri, relations, replay, restructure, traces, tree, variants

START = datetime(2024, 1, 1)


def make(spark, rows, objects=None, o2o=(), seconds=10):
    """Rows ``(event, activity, step, {object: type})`` as a log."""
    events = [(e, a, START + timedelta(seconds=seconds * t), {}) for e, a, t, _ in rows]
    e2o = [(e, o, kind, "") for e, _, _, os in rows for o, kind in os.items()]
    every = objects or [(o, kind, {}) for o, kind in sorted({(o, kind) for *_, os in rows for o, kind in os.items()})]
    return model.from_tables(
        spark, spark.createDataFrame(events, model.EVENTS), spark.createDataFrame(every, model.OBJECTS), spark.createDataFrame(e2o, model.E2O), spark.createDataFrame([(a, b, "") for a, b in o2o], model.O2O)
    )


@pytest.fixture(scope="module")
def orders(spark):
    """Two orders of one customer: placed, then shipped with an item each."""
    return make(
        spark,
        [
            ("e1", "place", 1, {"o1": "order", "c1": "customer"}),
            ("e2", "place", 2, {"o2": "order", "c1": "customer"}),
            ("e3", "ship", 3, {"o1": "order", "i1": "item"}),
            ("e4", "ship", 4, {"o2": "order", "i2": "item"}),
        ],
    )


def test_leading_executions(orders):
    objects = executions.leading_objects(orders, "order")
    got = {}
    for r in objects.collect():
        got.setdefault(r.pe_id, set()).add(r.object_id)
    assert got == {"o1": {"o1", "c1", "i1"}, "o2": {"o2", "c1", "i2"}}
    events = {}
    for r in executions.leading_executions(orders, "order", objects).collect():
        events.setdefault(r.pe_id, set()).add(r.event_id)
    assert events == {"o1": {"e1", "e2", "e3"}, "o2": {"e1", "e2", "e4"}}
    assert {r.pe_id for r in executions.component_executions(orders).collect()} == {"e1"}
    assert {r.pe_id for r in executions.graph_executions(orders).collect()} == {"e1"}


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (500, 500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {got[i] for i in range(61)} == {0}
    assert {got[i] for i in range(100, 160)} == {100}
    assert got[500] == 500
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_constraints(spark):
    log = make(spark, [("1", "A", 1, {"o1": "order"}), ("2", "B", 2, {"o1": "order"}), ("3", "C", 3, {"o1": "order"}), ("4", "B", 1, {"o2": "order"}), ("5", "A", 2, {"o2": "order"}), ("6", "A", 1, {"o3": "order"}), ("7", "C", 1, {"o4": "order"})])
    got = {r.metric: (r.n_ok, r.n) for r in constraints.trace_metrics(log, "order", "A", "B").collect()}
    assert got["followed_by"] == (2, 4)
    assert got["precedence"] == (3, 4)
    assert got["directly_followed_by"] == (2, 4)
    assert got["coexistence"] == (3, 4)
    assert got["block"] == (3, 4)
    assert got["choice"] == (3, 4)
    assert got["exclusiveness"] == (2, 4)


def test_performance(spark):
    rows = [("p", "P", 10, {"a": "order"}), ("q", "Q", 40, {"b": "item"}), ("x", "X", 100, {"a": "order", "b": "item"})]
    log = make(spark, rows, seconds=1)
    item = performance.event_times(log, "item").first()
    assert (item.flow, item.sojourn, item.synchronization, item.pooling, item.lagging, item.readiness) == (90, 60, 30, 0, 30, 30)
    order = performance.event_times(log, "order").first()
    assert (order.lagging, order.readiness) == (0, 0)
    assert performance.event_times(log, "nothing").first().pooling is None


def test_cardinality_and_lifespans(spark):
    rows = [("1", "a", 0, {"o1": "order"}), ("2", "b", 2, {"i1": "item", "i2": "item"}), ("3", "c", 8, {"i1": "item", "i2": "item"}), ("4", "d", 10, {"o1": "order", "i3": "item"}), ("5", "e", 5, {"o1": "order", "i1": "item"})]
    log = make(spark, rows, [("o1", "order", {}), ("o2", "order", {}), ("i1", "item", {}), ("i2", "item", {}), ("i3", "item", {})], [("o1", "i1"), ("o1", "i2")])
    labels = {(r.source_type, r.target_type): r.label for r in relations.o2o_cardinality(log).collect()}
    assert labels["order", "item"] == "0..*"
    assert labels["item", "order"] == "0..1"
    row = {(r.source_type, r.target_type): r for r in relations.temporal_relations(log).collect()}["item", "order"]
    assert (row.total, row.n_D) == (2, 2)
    empty = relations.most_precise(spark.createDataFrame([("a", "b", 0, 0, 0)], "source_type string, target_type string, total long, n_D long, n_P long"), ("D", "P"), 0.9)
    assert empty.first().label == "ERROR 0"


def test_layering():
    assert relations.layering({("item", "order"): "D", ("order", "customer"): "D", ("item", "customer"): "D"}) == {"item": 0, "order": 1, "customer": 2}
    assert relations.layering({("a", "b"): "P", ("b", "a"): "P"}) == {"a": 0, "b": 0}


def test_layering_equals_all_levels():
    rng = random.Random(7)
    for _ in range(300):
        types = "abcde"[: rng.randint(2, 5)]
        labels = {(a, b): rng.choice(["D", "P", "I", "None", "None"]) for a, b in permutations(types, 2) if rng.random() < 0.7}
        names = sorted({t for pair in labels for t in pair})
        best = None
        for levels in product(range(len(names)), repeat=len(names)):
            at = dict(zip(names, levels, strict=True))
            must = [(a, b) for (a, b), k in labels.items() if k == "D" and labels.get((b, a)) != "D"]
            if all(at[b] > at[a] for a, b in must):
                cost = sum(at[b] - at[a] for a, b in must) + sum(abs(at[b] - at[a]) for (a, b), k in labels.items() if k in "PI")
                best = min(best, (cost, levels)) if best else (cost, levels)
        assert relations.layering(labels) == (dict(zip(names, best[1], strict=True)) if best else {})


def test_layering_of_many_types():
    chain = [f"t{i:02}" for i in range(30)]
    labels = {(a, b): "D" for a, b in zip(chain, chain[1:], strict=False)} | {("x", "t29"): "P"}
    assert relations.layering(labels) == {t: i for i, t in enumerate(chain)} | {"x": 29}


def test_hierarchy_and_lattice(spark):
    data = {"nation": ["N1", "N1", "N2", "N3", None], "region": ["R1", "R1", "R1", "R2", None], "segment": ["S1", "S2", "S1", "S1", "S2"]}
    objects = [(f"c{i}", "customer", {k: v[i] for k, v in data.items() if v[i]}) for i in range(5)]
    log = make(spark, [("e", "a", 1, {"c0": "customer"})], objects)
    h = hierarchy.build(log)["customer"]
    assert h.names == ["nation", "region", "segment"]
    assert h.up == {0: [1, 3], 1: [2], 2: [4], 3: [4], 4: []}
    assert h.down == {0: [], 1: [0], 2: [1], 3: [0], 4: [2, 3]}
    lattice = hierarchy.Lattice({"customer": h})
    assert [c for c in lattice.walk()][0] == (4,) and len(list(lattice.walk())) == 5
    labels = {r.object_id: r.label for r in hierarchy.level_labels(log, h).where("level = 1").collect()}
    assert labels["c4"] == "?nation=c4"


def test_quotient_levels(spark):
    log = make(
        spark,
        [("e1", "place", 1, {"o1": "order", "i1": "item", "i2": "item"}), ("e2", "pick", 2, {"i1": "item"}), ("e3", "pick", 3, {"i2": "item"}), ("e4", "ship", 4, {"o1": "order", "i1": "item", "i2": "item"})],
    )
    pe = spark.createDataFrame([("x", e) for e in ("e1", "e2", "e3", "e4")], "pe_id string, event_id string")
    by_type = log.objects.select("object_id", F.col("object_type").alias("label"))
    by_id = log.objects.select("object_id", F.col("object_id").alias("label"))
    assert abstraction.behaviour(log, pe, by_type).first().n_nodes == 3
    assert abstraction.behaviour(log, pe, by_id).first().n_nodes == 4
    lattice = hierarchy.Lattice(hierarchy.build(log))
    rows = abstraction.explore(log, pe, lattice)
    assert rows[0]["config"] == lattice.top and rows[-1]["config"] == lattice.bottom
    variant = variants.variants(log, pe)
    assert variant.count() == 1 and variants.frequencies(variant).first().share == 1.0
    spots = {r.event_id: (r.x, r.x_end) for r in variants.layout(log, pe).collect()}
    assert spots == {"e1": (0, 0), "e2": (1, 1), "e3": (1, 1), "e4": (2, 2)}


def graph(spark, rows):
    return spark.createDataFrame(rows, "pe_id string, nodes array<string>, edges array<struct<s:int,t:int,label:string>>")


def test_smoke_corpus(spark):
    e = lambda *edges: [{"s": s, "t": t, "label": label} for s, t, label in edges]
    graphs = graph(
        spark,
        [
            ("g1", ["A", "B", "C"], e((0, 1, "o1"), (1, 2, "o1"))),
            ("g2", ["A", "B", "C", "X"], e((0, 1, "o1"), (1, 2, "o1"), (1, 3, "o2"))),
            ("g3", ["A", "B", "C"], e((0, 1, "o1"), (0, 1, "o2"), (1, 2, "o1"))),
            ("g4", ["A", "B", "C"], e((0, 1, "o1"), (1, 2, "o1"), (1, 2, "o3"))),
            ("noise", ["P", "Q"], e((0, 1, "z"))),
        ],
    )
    hits = mining.pattern_hits(graphs, 3, 2)
    found = {r.signature: r.support for r in mining.frequent_patterns(hits, 2).collect()}
    from braidlog.functions.graphs import canonical

    assert found == {canonical(["A", "B"], [(0, 1, "o1")]): 4, canonical(["B", "C"], [(0, 1, "o1")]): 4, canonical(["A", "B", "C"], [(0, 1, "o1"), (1, 2, "o1")]): 4}
    kept = {r.signature for r in mining.subsumed(mining.hit_sets(hits)).where("kept").collect()}
    assert canonical(["A", "B", "C"], [(0, 1, "o1"), (1, 2, "o1")]) in kept
    assert canonical(["A", "B"], [(0, 1, "o1")]) not in kept
    assert mining.support_window(10, 0.25, 0.8) == (2, 8)


def test_tree(spark):
    rows = spark.createDataFrame([(str(i), float(10 * (i % 2) + (i % 4 == 3)), ["odd"] * (i % 2) + ["mod3"] * (i % 4 == 3)) for i in range(40)], "pe_id string, y double, features array<string>")
    status, root, members = tree.fit(rows, 2, 5)
    assert status == "ok" and root.feature == "odd"
    assert sorted((r.label, r.n) for r in tree.leaf_table(root, members).collect()) == [("odd & mod3", 10), ("odd & ¬mod3", 10), ("¬odd", 20)]
    assert tree.quality(root, members).first().r2 == pytest.approx(1.0)
    assert tree.fit(rows.limit(5), 2, 5)[0] == "too_few_samples"
    assert tree.fit(rows.withColumn("y", F.lit(1.0)), 2, 5)[0] == "constant_y"
    assert tree.fit(rows.withColumn("features", F.array().cast("array<string>")), 2, 5)[0] == "no_patterns"


def test_banding(spark):
    objects = [(f"p{i}", "part", {"size": str(v)}) for i, v in enumerate([1, 2, 2, 3, 50, 51, 52, 100, 101])]
    log = make(spark, [("e", "a", 1, {"p0": "part"})], objects)
    table = attributes.bands(log, "part", "size", 3)
    assert [(r.low, r.high, r.n) for r in table.orderBy("low").collect()] == [(1, 3, 4), (50, 52, 3), (100, 101, 2)]
    tagged = attributes.with_bands(log, "part", "size", table).where("object_id = 'p5'").first()
    assert tagged.attrs["size_band"] == "band_2"
    assert attributes.elbow([100, 10, 9, 8], 4) == 3
    assert attributes.bands(log, "part", "none").count() == 0


def test_absorption_and_mapping(spark):
    rows = [("1", "a", 1, {"o1": "order", "c1": "customer", "r1": "robot"}), ("2", "a", 2, {"o2": "order", "r1": "robot"})]
    objects = [("o1", "order", {}), ("o2", "order", {}), ("c1", "customer", {"name": "Ann"}), ("r1", "robot", {"site": "X"})]
    log = make(spark, rows, objects, [("c1", "o1")])
    out = restructure.absorb(log, ["customer", "robot"])
    attrs = {r.object_id: r.attrs for r in out.objects.collect()}
    assert attrs["o1"]["customer_name"] == "Ann" and attrs["o1"]["customer"] == "c1"
    assert attrs["o2"]["customer_name"] == "no_customer_name"
    assert out.events.where("event_id = '1'").first().attrs == {"robot_site": "X", "num_robot_id": "r1"}
    assert {r.object_type for r in out.e2o.collect()} == {"order"}
    with pytest.raises(ValueError):
        restructure.functional_mapping(log, "order", "customer")
    mapping = {r.source_id: r.target_id for r in restructure.functional_mapping(log, "order", "customer", "most_frequent").collect()}
    assert mapping == {"o1": "c1", "o2": "no_customer"}
    with pytest.raises(ValueError):
        restructure.TypeGraph([("a", "b"), ("b", "a")]).order()


def test_discovery_replay_and_reduction(spark, orders):
    net = petri.discover(orders)
    assert {t.label for t in net.transitions.values() if t.label} == {"place", "ship"}
    rows = replay.fitness(orders, net).collect()
    assert all(r.fit and r.fitness == 1.0 for r in rows)
    assert replay.replay_trace(net.on_types(["order"]), ["ship"])[0] == 1
    smaller = petri.reduce(net.on_types(["order"]))
    assert {t.label for t in smaller.transitions.values() if t.label} == {"place", "ship"}
    assert len(smaller.places) <= len(net.on_types(["order"]).places)
    own = orders.with_relations(orders.e2o.where("object_type = 'order'"))
    pe = traces.flatten(own, "order").select(F.col("case_id").alias("pe_id"), "event_id")
    result = replay.precision_fitness(own, petri.discover(own), pe).first()
    assert (result.precision, result.fitness, result.n_skipped) == (1.0, 1.0, 0)
    tree_ = petri.process_tree({"a", "b", "c", "d"}, {("a", "b"), ("a", "c"), ("b", "c"), ("c", "b"), ("b", "d"), ("c", "d")}, {"a"}, {"d"})
    assert tree_ == ("seq", ("act", "a"), ("and", ("act", "b"), ("act", "c")), ("act", "d"))
    assert petri.process_tree({"a", "z", "d"}, {("a", "z"), ("z", "d")}, {"a"}, {"d"}) == ("seq", ("act", "a"), ("act", "z"), ("act", "d"))


def small_log(spark, rows):
    """``rows(event, activity, time, objects as type:name)`` as a log."""
    from datetime import datetime

    from braidlog.model import Log

    events = spark.createDataFrame([(e, a, datetime(2020, 1, 1, 0, t)) for e, a, t, _ in rows], "event_id string, activity string, ts timestamp").withColumns({"start_ts": F.lit(None).cast("timestamp"), "attrs": F.lit(None).cast("map<string,string>")})
    e2o = spark.createDataFrame([(e, o, o.split(":")[0], None) for e, _, _, objects in rows for o in objects], "event_id string, object_id string, object_type string, qualifier string")
    objects = e2o.select("object_id", "object_type").distinct().withColumn("attrs", F.lit(None).cast("map<string,string>"))
    o2o = spark.createDataFrame([], "source_id string, target_id string, qualifier string")
    return Log(events, objects, e2o, o2o, spark.createDataFrame([], "object_id string, object_type string, ts timestamp, field string, value string"))


def test_contexts_hold_the_objects_of_ancestors(spark):
    rows = [("1", "a", 1, ["item:1"]), ("2", "b>x|y:z", 2, ["item:1", "order:1"]), ("3", "c", 3, ["order:1"]), ("4", "d", 4, ["order:2"])]
    log = small_log(spark, rows)
    pe = log.events.select(F.lit("x").alias("pe_id"), "event_id")
    got = {r.event_id: [(c.object_type, c.activities) for c in r.context] for r in replay.contexts(log, pe).collect()}
    odd = "b>x|y:z"
    assert got == {"1": [("item", [])], "2": [("item", ["a"]), ("order", [])], "3": [("item", ["a", odd]), ("order", [odd])], "4": [("order", [])]}


def test_contexts_equal_plain_closure(spark):
    import random

    rnd = random.Random(2)
    for seed in range(2):
        rows = [(f"{k:02d}", rnd.choice("abc"), k, sorted({f"{t}:{rnd.randrange(3)}" for t in rnd.sample(["p", "q", "r"], 2)})) for k in range(25)]
        log = small_log(spark, rows)
        edges: dict = {}
        for k, (e, _, _, objects) in enumerate(rows):
            for o in objects:
                earlier = [x[0] for x in rows[:k] if o in x[3]]
                if earlier:
                    edges.setdefault(e, set()).add(earlier[-1])

        def ancestors(e, edges=edges):
            return set().union(*[{p} | ancestors(p) for p in edges.get(e, ())])

        want = {}
        for e, _, _, own in rows:
            past = ancestors(e)
            objects = {o for x in rows if x[0] in past for o in x[3]} | set(own)
            want[e] = sorted((o[0], [x[1] for x in rows if x[0] in past and o in x[3]]) for o in objects)
        pe = log.events.select(F.lit("x").alias("pe_id"), "event_id")
        assert {r.event_id: [(c.object_type, list(c.activities)) for c in r.context] for r in replay.contexts(log, pe).collect()} == want


def test_names_with_marks_do_not_change_precision(spark):
    results = set()
    for name in ("b", "b>c", "b|c", "order:b"):
        log = small_log(spark, [(str(i), a, i, ["order:1"]) for i, a in enumerate(["a", name, "d"])])
        pe = log.events.select(F.lit("x").alias("pe_id"), "event_id")
        r = replay.precision_fitness(log, petri.discover(log), pe).first()
        results.add((r.precision, r.fitness, r.n_skipped))
    assert results == {(1.0, 1.0, 0)}


def test_before_is_counted_as_it_is_listed(spark):
    import random

    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), at := rnd.randrange(200), at + rnd.randrange(20)) for _ in range(300)]
    df = spark.createDataFrame(rows, "name string, start long, end long").repartition(4)
    listed = impact.matches(df, ("before", "a", "b")).agg(F.count(F.lit(1)), F.min("start")).first()
    for width in (7, 1000):
        assert impact.count_before(df, "a", "b", width).first()[:] == listed[:]
    assert impact.count_before(df.limit(0), "a", "b").first()[:] == (0, None)


def test_rare_arcs_go_until_none_is_left(spark):
    import random
    from collections import Counter

    rnd = random.Random(9)
    rows = [(f"{o}-{k:02d}", rnd.choice("aabbc"), k, [f"order:{o}"]) for o in range(6) for k in range(8)]
    left = {r[0] for r in rows}
    while True:
        pairs = [(x, y) for o in range(6) for t in [[r for r in rows if r[0] in left and r[3] == [f"order:{o}"]]] for x, y in zip(t, t[1:], strict=False)]
        n = Counter((x[1], y[1]) for x, y in pairs)
        kept = {e for x, y in pairs if n[x[1], y[1]] >= 6 for e in (x[0], y[0])}
        if kept == left:
            break
        left = kept
    log = small_log(spark, rows)
    assert {r.event_id for r in filters.clean_rare_arcs(log, "order", 6).collect()} == left


def test_filters(spark, orders):
    assert filters.by_activity_share(orders, 0.4).events.count() == 2
    with pytest.raises(ValueError):
        filters.by_event_time(orders)
    assert {r.object_type for r in filters.keep(orders, types=["order"]).objects.collect()} == {"order"}
    assert filters.by_objects(orders, spark.createDataFrame([("i1",)], "object_id string")).events.count() == 1


def test_kpis(spark, orders):
    pe = executions.leading_executions(orders, "order")
    got = {r.pe_id: r for r in kpi.custom(orders, pe, ["d:=duration", "n_events * 2", "x:='a'"]).collect()}
    assert (got["o1"].d, got["o1"].kpi_2, got["o1"].x) == (20.0, 6.0, 0.0)
    assert kpi.parse_expressions([]) == {"duration": "duration"}


def test_intervals_and_schedule(spark):
    instances = spark.createDataFrame([("a", 0, 2), ("b", 3, 5), ("c", 3, 9)], "name string, start long, end long")
    found = impact.matches(instances, ("before", "a", ("starts", "b", "c"))).first()
    assert (found.start, found.end, len(found.used)) == (0, 9, 3)
    assert impact.schedule([("x", 1.0), ("y", 2.0), ("x", 3.0)], [("x", "y")]) == [("x", 0.0, 3.0), ("y", 3.0, 5.0)]
    with pytest.raises(ValueError):
        impact.schedule([("x", 1.0)], [("x", "x")])


def test_constraints_on_behaviour_and_net(spark):
    rows = [("c1", "causal", "a", "b"), ("c2", "concur", "a", "b"), ("c3", "choice", "a", "c"), ("c4", "skip", "c", "c"), ("c5", "skip", "a", "b")]
    wanted = constraints.control_constraints(spark, rows)

    def found(sequences):
        behaviour = spark.createDataFrame([(s,) for s in sequences], "sequence array<string>")
        return {r.name: r.detected for r in constraints.on_behaviour(behaviour, wanted).collect()}

    assert found([["a", "b"], ["a", "c", "b"]]) == {"c1": True, "c2": False, "c3": False, "c4": True, "c5": False}
    assert found([["a", "b"], ["b", "a"]]) == {"c1": False, "c2": True, "c3": True, "c4": False, "c5": False}
    assert found([["a", "b", "c"], []])["c3"] is False
    assert set(found([]).values()) == {False}
    net = petri.Net({"p": petri.Place("p", "order", True), "q": petri.Place("q", "item")}, {"t": petri.Transition("t", "pack")}, {petri.Arc("p", "t"), petri.Arc("q", "t", True)})
    kinds = [("i", "inc", "order", "pack"), ("v", "var", "item", "pack"), ("w", "var", "order", "pack"), ("e", "exc", "item", "pack"), ("n", "exc", "item", "send")]
    assert constraints.on_net(net, kinds) == [("i", True), ("v", True), ("w", False), ("e", False), ("n", True)]
    with pytest.raises(ValueError):
        constraints.on_net(net, [("x", "other", "item", "pack")])


def test_graph_files_hold_any_label(spark, tmp_path):
    schema = "pe_id string, nodes array<string>, edges array<struct<s:int,t:int,label:string>>"
    graphs = [("t # 1", ["v 0", "a b"], [(0, 1, "e 0 1"), (1, 0, "")]), ("lone", ["x"], []), ("none", [], [])]
    mining.write_graphs(spark.createDataFrame(graphs, schema).repartition(2), str(tmp_path / "g"))
    back = mining.read_graphs(spark, str(tmp_path / "g")).collect()
    assert sorted((r.pe_id, r.nodes, [tuple(e) for e in r.edges]) for r in back) == sorted(graphs)


def test_a_place_that_its_only_user_refills_goes():
    net = petri.Net(
        {"i": petri.Place("i", "x", True), "o": petri.Place("o", "x", False, True), "loop": petri.Place("loop", "x")},
        {"a": petri.Transition("a", "a")},
        {petri.Arc("i", "a"), petri.Arc("a", "o"), petri.Arc("a", "loop"), petri.Arc("loop", "a")},
    )
    assert set(petri.reduce(net).places) == {"i", "o"}


def test_attributes_over_time(spark):
    at = lambda s: START + timedelta(seconds=s)
    rows = [("o1", "t", at(0), "size", "1"), ("o1", "t", at(1), "kind", "x"), ("o1", "t", at(2), "size", "3"), ("o2", "t", at(2), "kind", "x"), ("o2", "t", at(2), "size", "5"), ("o2", "t", at(3), "size", "many"), ("o3", "u", at(2), "size", "9")]
    none = make(spark, [("e", "a", 0, {"o1": "t"})])
    log = model.from_tables(spark, none.events, none.objects, none.e2o, None, spark.createDataFrame(rows, model.CHANGES))
    found = {(r.group, r.ts, r.n, r["mean"]) for r in attributes.over_time(log, "t", "size", "kind").collect()}
    assert found == {(None, at(0), 1, 1.0), ("x", at(2), 2, 4.0)}


def test_split_keeps_executions_whole_and_scales_by_training_rows(spark):
    rows = [(f"p{i // 3}", f"e{i}", float(i), 5.0) for i in range(300)]
    table = spark.createDataFrame(rows, "pe_id string, event_id string, a double, b double")
    train, test = features.split(table, 0.3, 7)
    held = {r.pe_id for r in test.collect()}
    assert not held & {r.pe_id for r in train.collect()} and 15 < len(held) < 45
    assert train.count() + test.count() == 300
    own = [a for p, _, a, _ in rows if p not in held]
    mean = sum(own) / len(own)
    deviation = (sum((a - mean) ** 2 for a in own) / len(own)) ** 0.5
    plain = {e: a for _, e, a, _ in rows}
    for part in features.scaled(train, test):
        for r in part.collect():
            assert r.a == pytest.approx((plain[r.event_id] - mean) / deviation) and r.b == pytest.approx(0.0)


def test_workflow_by_classes(spark, sf_dir, tmp_path, monkeypatch):
    """Courses of orders give the bundle of the log's relations, and one graph of each class is mined."""
    from dataclasses import replace

    from braidlog.operators import mining
    from braidlog.plans import workflow
    from braidlog.sources.tables import commerce_log

    for name in ("customer", "part", "supplier", "nation", "region", "orders", "lineitem"):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "orders":  # an order that is not listed, a missing attribute
            df = df.where("o_orderkey < 150 and o_orderkey <> 5").withColumn("o_orderstatus", F.expr("if(o_orderkey = 7, null, o_orderstatus)"))
        if name == "lineitem":
            df = df.where("l_orderkey < 150").withColumn("l_shipdate", F.expr("if(l_orderkey = 9, null, l_shipdate)"))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    log = commerce_log(spark, str(tmp_path)).without_types(["part", "supplier", "customer", "item"])
    mined, own = [], mining.pattern_hits
    monkeypatch.setattr(mining, "pattern_hits", lambda graphs, *more: mined.append(graphs.count()) or own(graphs, *more))
    found, _ = workflow.run(log, "order", ["order"], ["duration"], 0.02, 0.9, 2, 2, 5)
    wanted, _ = workflow.run(replace(log, cases=None, known=None), "order", ["order"], ["duration"], 0.02, 0.9, 2, 2, 5)
    configs = {r.config_id: r for r in wanted.configs.collect()}
    assert workflow.courses(log, "order").count() == configs[0].n_executions == 149
    assert sorted(mined) == sorted(2 * [r.n_classes for r in configs.values() if r.reason is None])
    norm = lambda df: sorted(str([f"{x:.9g}" if isinstance(x, float) else x for x in r]) for r in df.collect())
    for part in ("configs", "hits", "patterns", "kpis", "contrast", "classes", "covers", "members"):
        assert norm(getattr(found, part)) == norm(getattr(wanted, part)), part
    assert found.hits.count() and found.members.count()


def test_forms_of_courses(spark):
    """A label put into a form gives the canonical form of the labelled graph, also where names would compare by their labels."""
    import hashlib

    from braidlog.functions.graphs import canonical, quotient
    from braidlog.operators import abstraction

    rows = [(f"{i}", course, labels) for i, (course, labels) in enumerate((c, own) for c in ('["a","b","b","a"]', '["x","x{y","x"]', '["a","b"]', "[]", '[""]') for own in (["z"], ['"q\\'], ["é", "|"], [""], []))]
    df = spark.createDataFrame(rows, "pe_id string, course string, labels array<string>")
    for r in abstraction.of_courses(df).collect():
        names, edges, _ = quotient(*abstraction._course(r.course, r.labels))
        assert (bytes(r.form), r.n_nodes) == (hashlib.sha256(canonical(names, edges).encode()).digest(), len(names))


def test_graph_executions_over_all_types(spark, sf_dir, tmp_path):
    """Events are connected by objects of every type, parts and suppliers too; SQL finds the same."""
    import duckdb

    import __spark_entry__ as entry

    for name in ("customer", "part", "supplier", "nation", "region", "orders", "lineitem"):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        key = "o_orderkey" if name == "orders" else "l_orderkey"
        (df.where(f"{key} < 12") if name in ("orders", "lineitem") else df).write.parquet(f"{tmp_path}/{name}.parquet")
    found = {r.event_id: r.pe_id for r in entry.queries()["graph_executions"](spark, str(tmp_path)).collect()}
    from braidlog.sources.tables import commerce_log

    groups = {}
    for e, o in commerce_log(spark, str(tmp_path)).e2o.select("event_id", "object_id").collect():
        groups.setdefault(o, {e}).add(e)
    label = {e: e for own in groups.values() for e in own}
    for _ in label:
        for own in groups.values():
            low = min(label[e] for e in own)
            label |= {e: low for e in own}
    assert found == label
    parts = {e: {o for o, own in groups.items() if e in own and o.startswith(("order", "customer", "item"))} for e in label}
    assert any(found[a] == found[b] and not parts[a] & parts[b] for a in found if a.startswith("po-") for b in found if b.startswith("po-"))
    con = duckdb.connect()
    for name in ("customer", "part", "supplier", "nation", "region", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert sorted(con.execute(entry.oracle_sql()["graph_executions"]).fetchall()) == sorted((p, e) for e, p in found.items())
