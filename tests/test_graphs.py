"""Graph kernels: hand-made cases and invariance under renumbering."""

import random

from braidlog.functions.graphs import bisimulation, canonical, connected_subsets, induced_embeddings, quotient


def shuffled(labels, edges, seed):
    order = list(range(len(labels)))
    random.Random(seed).shuffle(order)
    new = [""] * len(labels)
    for old, at in enumerate(order):
        new[at] = labels[old]
    return new, [(order[s], order[t], label) for s, t, label in edges]


def random_graph(seed):
    rnd = random.Random(seed)
    n = rnd.randint(1, 7)
    labels = [rnd.choice("ab") for _ in range(n)]
    edges = [(rnd.randrange(n), rnd.randrange(n), rnd.choice("xy")) for _ in range(rnd.randint(0, 10))]
    return labels, sorted(set(edges))


def test_canonical_is_invariant_and_separates():
    for seed in range(150):
        labels, edges = random_graph(seed)
        form = canonical(labels, edges)
        assert all(canonical(*shuffled(labels, edges, k)) == form for k in range(4))
    assert canonical(["a", "a", "a"], [(0, 1, "x"), (1, 2, "x")]) != canonical(["a", "a", "a"], [(0, 1, "x"), (0, 2, "x")])
    ring6 = [(i, (i + 1) % 6, "x") for i in range(6)]
    two3 = [(0, 1, "x"), (1, 2, "x"), (2, 0, "x"), (3, 4, "x"), (4, 5, "x"), (5, 3, "x")]
    assert canonical(["a"] * 6, ring6) != canonical(["a"] * 6, two3)
    assert canonical([], []) == canonical([], [])


def test_bisimulation_is_stable():
    for seed in range(100):
        labels, edges = random_graph(seed)
        blocks = bisimulation(labels, edges)

        def near(i, blocks=blocks, edges=edges):
            return {(x, blocks[t]) for s, t, x in edges if s == i}, {(x, blocks[s]) for s, t, x in edges if t == i}

        for i in range(len(labels)):
            for j in range(len(labels)):
                if blocks[i] == blocks[j]:
                    assert labels[i] == labels[j]
                    assert near(i) == near(j)


def test_quotient_of_one_order_with_two_items():
    labels = ["place", "pick", "pick", "ship"]
    edges = [(0, 3, "order"), (0, 1, "item"), (1, 3, "item"), (0, 2, "item"), (2, 3, "item")]
    names, abstract, _ = quotient(labels, edges)
    at = {n: i for i, n in enumerate(names)}
    assert sorted(names) == ["pick", "place", "ship"]
    assert set(abstract) == {(at["place"], at["ship"], "order 1>1"), (at["place"], at["pick"], "item 1>*"), (at["pick"], at["ship"], "item *>1")}


def test_connected_subsets_of_a_path():
    found = list(connected_subsets(3, [(0, 1), (1, 2), (2, 3)], 3))
    assert sorted(found) == [(0,), (0, 1), (0, 1, 2), (1,), (1, 2), (2,)]


def test_induced_embedding_needs_no_further_edge():
    pattern = (["A", "B"], [(0, 1, frozenset({"o1"}))])
    assert induced_embeddings(pattern, (["A", "B", "C"], {(0, 1): frozenset({"o1", "o2"}), (1, 2): frozenset({"o1"})}))
    assert not induced_embeddings(pattern, (["A", "B"], {(0, 1): frozenset({"o1"}), (1, 0): frozenset({"o1"})}))
    assert not induced_embeddings(pattern, (["A", "B"], {(0, 1): frozenset({"o2"})}))
