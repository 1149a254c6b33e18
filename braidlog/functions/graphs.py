"""Small labelled graphs: partition refinement, canonical forms, connected edge subsets.

These run inside grouped pandas functions, on one execution's graph at a time.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Hashable, Iterable

Edge = tuple[int, int, str]


def _dense(keys: list[Hashable]) -> list[int]:
    order = {k: i for i, k in enumerate(sorted(set(keys)))}
    return [order[k] for k in keys]


def bisimulation(labels: list[str], edges: list[Edge]) -> list[int]:
    """Coarsest stable partition: equal labels, and equal sets of (edge label, block) over edges out and in."""
    blocks = _dense(labels)
    out: dict[int, list[tuple[str, int]]] = defaultdict(list)
    into: dict[int, list[tuple[str, int]]] = defaultdict(list)
    for s, t, label in edges:
        out[s].append((label, t))
        into[t].append((label, s))
    count = len(set(blocks))
    while True:
        side = lambda i, near: tuple(sorted({(label, blocks[j]) for label, j in near[i]}))
        refined = _dense([(blocks[i], side(i, out), side(i, into)) for i in range(len(labels))])
        if (n := len(set(refined))) == count:
            return blocks
        blocks, count = refined, n


def quotient(labels: list[str], edges: list[Edge]) -> tuple[list[str], list[Edge], list[int]]:
    """The graph of blocks. Edge labels become ``label source>target`` with multiplicities 1 or ``*``.

    A side is ``*`` if some node of the other side has two or more different neighbours in
    the block through edges of this label.
    """
    blocks = bisimulation(labels, edges)
    names = [""] * (max(blocks, default=-1) + 1)
    for b, label in zip(blocks, labels, strict=True):
        names[b] = label
    targets: dict[tuple[int, int, str], dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
    sources: dict[tuple[int, int, str], dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
    for s, t, label in edges:
        key = (blocks[s], blocks[t], label)
        targets[key][s].add(t)
        sources[key][t].add(s)
    out = []
    for (s, t, label), by_source in sorted(targets.items()):
        many_targets = any(len(x) > 1 for x in by_source.values())
        many_sources = any(len(x) > 1 for x in sources[s, t, label].values())
        out.append((s, t, f"{label} {'*' if many_sources else '1'}>{'*' if many_targets else '1'}"))
    return names, out, blocks


def canonical(labels: list[str], edges: Iterable[Edge]) -> str:
    """A string that two labelled multigraphs share exactly if they are isomorphic.

    Colours are refined by neighbourhoods; where a colour class stays larger than one, each
    member is tried first in turn and the smallest form wins.
    """
    n = len(labels)
    edges = sorted(set(edges))
    near_out: list[list[tuple[str, int]]] = [[] for _ in range(n)]
    near_in: list[list[tuple[str, int]]] = [[] for _ in range(n)]
    for s, t, label in edges:
        near_out[s].append((label, t))
        near_in[t].append((label, s))

    def refine(colours: list[int]) -> list[int]:
        while True:
            side = lambda i, near: tuple(sorted((label, colours[j]) for label, j in near[i]))
            new = _dense([(colours[i], side(i, near_out), side(i, near_in)) for i in range(n)])
            if len(set(new)) == len(set(colours)):
                return new
            colours = new

    best: list[str] = []

    def form(order: list[int]) -> str:
        at = {v: i for i, v in enumerate(order)}
        return json.dumps([[labels[v] for v in order], sorted((at[s], at[t], label) for s, t, label in edges)], ensure_ascii=False, separators=(",", ":"))

    def twins(members: list[int]) -> bool:
        """Members with the same neighbours can stand in any order."""
        free = [(sorted(near_out[v]), sorted(near_in[v])) for v in members]
        return all(x == free[0] for x in free)

    def search(colours: list[int]) -> None:
        colours = refine(colours)
        classes: dict[int, list[int]] = defaultdict(list)
        for v, c in enumerate(colours):
            classes[c].append(v)
        open_classes = [(len(m), c) for c, m in classes.items() if len(m) > 1]
        if not open_classes:
            text = form(sorted(range(n), key=colours.__getitem__))
            if not best or text < best[0]:
                best[:] = [text]
            return
        members = classes[min(open_classes)[1]]
        for v in members[:1] if twins(members) else members:
            search(_dense([(2 * c + (c == colours[v] and u != v)) for u, c in enumerate(colours)]))

    search(_dense(labels))
    return best[0] if best else "[[],[]]"


def connected_subsets(n_edges: int, ends: list[tuple[int, int]], most: int) -> Iterable[tuple[int, ...]]:
    """Every set of one to ``most`` edges whose underlying graph is connected, once."""
    touching: dict[int, set[int]] = defaultdict(set)
    for e, (s, t) in enumerate(ends):
        touching[s].add(e)
        touching[t].add(e)
    beside = [touching[s] | touching[t] for s, t in ends]
    layer = {(e,) for e in range(n_edges)}
    for size in range(1, most + 1):
        yield from sorted(layer)
        if size < most:
            layer = {tuple(sorted((*chosen, e))) for chosen in layer for c in chosen for e in beside[c] if e not in chosen}


def induced_embeddings(pattern: tuple[list[str], list[tuple[int, int, frozenset[str]]]], graph: tuple[list[str], dict[tuple[int, int], frozenset[str]]]) -> bool:
    """Whether the pattern occurs in the graph: equal node labels, edge labels included, no further edges among the image."""
    p_labels, p_edges = pattern
    g_labels, g_edges = graph
    wanted = {(s, t): labels for s, t, labels in p_edges}
    n = len(p_labels)

    def place(i: int, image: list[int]) -> bool:
        if i == n:
            return True
        for v, label in enumerate(g_labels):
            if label != p_labels[i] or v in image:
                continue
            image.append(v)
            ok = True
            for j in range(i + 1):
                for a, b in {(i, j), (j, i)}:
                    have, need = g_edges.get((image[a], image[b])), wanted.get((a, b))
                    if (have is None) != (need is None) or (need is not None and not need <= have):
                        ok = False
            if ok and place(i + 1, image):
                return True
            image.pop()
        return False

    return place(0, [])
