"""Exact canonical forms of small labelled multigraphs: refine, individualise, keep the smallest leaf, within a budget."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from prismgraph import wire

Labelled = tuple[Sequence[str], Sequence[tuple[int, int, str]]]  # labels; edges (from, to, role)
OUTCOME = "status string, labels array<string>, edges array<struct<from:int,to:int,role:string>>, mapping array<int>, states int, reason string"


def _ranks(keys: list) -> list[int]:
    at = {k: i for i, k in enumerate(sorted(set(keys)))}
    return [at[k] for k in keys]


def refine(n: int, edges: Sequence[tuple[int, int, str]], colours: list[int]) -> list[int]:
    """The coarsest equitable refinement, as ranks that don't depend on the numbering."""
    out: list[list[tuple[str, int]]] = [[] for _ in range(n)]
    into: list[list[tuple[str, int]]] = [[] for _ in range(n)]
    for a, b, role in edges:
        out[a].append((role, b))
        into[b].append((role, a))
    while True:
        see = lambda ends: tuple(sorted((role, colours[v]) for role, v in ends))
        finer = _ranks([(colours[v], see(out[v]), see(into[v])) for v in range(n)])
        if len(set(finer)) == len(set(colours)):
            return finer
        colours = finer


def relabel(graph: Labelled, mapping: Sequence[int]) -> Labelled:
    labels, edges = graph
    new = [""] * len(labels)
    for old, at in enumerate(mapping):
        new[at] = labels[old]
    return tuple(new), tuple(sorted((mapping[a], mapping[b], role) for a, b, role in edges))


def canonicalise(
    graph: Labelled, vertices: int = wire.EXACT_VERTICES, edges: int = wire.EXACT_EDGES, states: int = wire.EXACT_STATES, seconds: float = wire.EXACT_SECONDS
) -> dict:
    """status exact (labels, edges, mapping from old to new vertex, states), unsupported or budget-exceeded (reason)."""
    labels, links = list(graph[0]), [tuple(x) for x in graph[1]]
    n = len(labels)
    nothing = {"labels": None, "edges": None, "mapping": None}
    if any(not 0 <= v < n for a, b, _ in links for v in (a, b)):
        return nothing | {"status": "unsupported", "reason": "edge endpoint outside graph", "states": 0}
    if n > vertices or len(links) > edges:
        return nothing | {"status": "budget-exceeded", "reason": "graph size budget", "states": 0}
    if sum(len(x.encode()) for x in labels) + sum(len(r.encode()) for _, _, r in links) > wire.EXACT_LABEL_BYTES:
        return nothing | {"status": "budget-exceeded", "reason": "label byte budget", "states": 0}
    began, used = time.monotonic(), 0
    best: tuple[Labelled, list[int]] | None = None
    todo = [_ranks(labels)]
    while todo:
        if used >= states or time.monotonic() - began >= seconds:
            return nothing | {"status": "budget-exceeded", "reason": "exact search state/time budget; no partial canonical answer", "states": used}
        used += 1
        colours = refine(n, links, todo.pop())
        sizes = Counter(colours)
        cell = min((c for c, k in sizes.items() if k > 1), default=None)
        if cell is None:
            made = relabel((labels, links), colours)
            if best is None or made < best[0]:
                best = made, colours
        else:
            todo += [_ranks([(c, v == chosen) for v, c in enumerate(colours)]) for chosen in range(n - 1, -1, -1) if colours[chosen] == cell]
    (new_labels, new_edges), mapping = best
    return {"status": "exact", "labels": list(new_labels), "edges": list(new_edges), "mapping": mapping, "states": used, "reason": None}


def verify(left: Labelled, right: Labelled, mapping: Sequence[int]) -> bool:
    """Whether mapping is a bijection that carries all labels, directions, roles and multiplicities of left to right."""
    n = len(left[0])
    inside = all(0 <= v < len(g[0]) for g in (left, right) for a, b, _ in g[1] for v in (a, b))
    if not inside or n != len(right[0]) or sorted(mapping) != list(range(n)):
        return False
    return relabel(left, mapping) == (tuple(right[0]), tuple(sorted(tuple(x) for x in right[1])))


def exact_column(labels: Column | str, edges: Column | str) -> Column:
    """canonicalise() for columns labels array<string> and edges array<struct<from, to, role>>, with the default budget."""
    return F.pandas_udf(_exact, OUTCOME)(labels, edges)


def _exact(labels: pd.Series, edges: pd.Series) -> pd.DataFrame:
    out = [canonicalise((list(a), [(x["from"], x["to"], x["role"]) for x in b])) for a, b in zip(labels, edges)]
    for o in out:
        o["edges"] = None if o["edges"] is None else [{"from": a, "to": b, "role": r} for a, b, r in o["edges"]]
    return pd.DataFrame(out, columns=["status", "labels", "edges", "mapping", "states", "reason"])
