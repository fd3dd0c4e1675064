"""Digests of stars under free keys, as columns: graphs of one node and any number of children below it, no other edges,
whose children all have the same label and ordinal. Orders with their lines are such.

What the kernel does node by node is here a few matrices for all stars of a batch that have as many children: every
component is a single node, children differ from each other and from their parent from the first colours on, so each
refinement takes one round, and without keys a child's digests before that round depend on its own facts alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from prismgraph import wire
from prismgraph.functions import encode as e
from prismgraph.functions.blake3 import blake3_grids
from prismgraph.operators.kernel import Graph, Hasher, Indexed, run
from prismgraph.sources.units import struct_lists

#: Stars of a batch that are worth a call on matrices; fewer go through the kernel.
FEWEST = 64
NONE = e.u32(0)


@dataclass
class Group:
    """Stars of one recipe and end with equally many children: their rows, and the types of their nodes."""

    rows: np.ndarray
    end: bytes
    label: str
    ordinal: int
    top: np.ndarray
    below: np.ndarray  # stars x children

    def some(self, mask: np.ndarray) -> Group:
        return Group(self.rows[mask], self.end, self.label, self.ordinal, self.top[mask], self.below[mask])


def _codes(column: pa.Array | np.ndarray) -> np.ndarray:
    made = (pa.array(column) if isinstance(column, np.ndarray) else column).dictionary_encode("encode").indices
    return made.to_numpy(zero_copy_only=False).astype(np.int64)


def _joined(parts: Sequence[np.ndarray]) -> np.ndarray:
    """Codes of the rows of some columns of codes."""
    out = parts[0]
    for part in parts[1:]:
        width = int(part.max(initial=0)) + 1
        if (int(out.max(initial=0)) + 1) * width > 1 << 62:
            out = _codes(out)
        out = out * width + part
    return _codes(out)


def _first(codes: np.ndarray) -> np.ndarray:
    """The place at which each code occurs first."""
    out = np.zeros(int(codes.max(initial=-1)) + 1, np.int64)
    out[codes[::-1]] = np.arange(len(codes))[::-1]
    return out


def read_stars(rows: pa.RecordBatch) -> tuple[np.ndarray, dict[str, list[Group]], list[tuple[str, list[tuple]]]]:
    """Which rows are stars, their groups by recipe, and the types of nodes: kind and facts."""
    total = rows.num_rows
    nothing = np.zeros(total, bool), {}, []
    at, (keys, kinds, facts) = struct_lists(rows.column("nodes"))
    fact_at, fields = struct_lists(facts)
    child_at, (parents, labels, ordinals, kids) = struct_lists(rows.column("children"))
    edge_at, _ = struct_lists(rows.column("edges"))
    if any(c.null_count for c in (rows.column("recipe"), keys, kinds, *fields[:3], parents, labels, ordinals, kids)):
        return nothing  # what is wrong is told by the kernel
    n, d = np.diff(at), np.diff(child_at)
    owner, child_owner = np.repeat(np.arange(total), n), np.repeat(np.arange(total), d)
    code = _codes(pa.chunked_array([keys, parents, kids]).combine_chunks())
    key, parent, kid = np.split(code, [len(keys), len(keys) + len(parents)])
    number = ordinals.to_numpy(zero_copy_only=False)
    end = _joined([_codes(labels), _codes(ordinals)])
    star = (n == d + 1) & (np.diff(edge_at) == 0)
    top = np.zeros(total, np.int64)
    top[star & (d == 0)] = key[at[:-1][star & (d == 0)]]
    top[d > 0] = parent[child_at[:-1][d > 0]]
    ends = np.zeros(total, np.int64)
    ends[d > 0] = end[child_at[:-1][d > 0]] + 1
    off = (parent != top[child_owner]) | (end + 1 != ends[child_owner]) | (number < 0) | (number >= 1 << 32)
    star[child_owner[off]] = False
    # the keys of its nodes are those of its children and the parent's, each once
    width = int(code.max(initial=0)) + 1
    mine, theirs = star[owner], star[child_owner]
    at_nodes = np.flatnonzero(mine)
    ids = owner[mine] * width + key[mine]
    order = np.argsort(ids, kind="stable")
    ids, at_nodes = ids[order], at_nodes[order]
    ends_meet = np.sort(np.concatenate([child_owner[theirs] * width + kid[theirs], np.flatnonzero(star) * width + top[star]]))
    star[ids[ids != ends_meet] // width] = False
    star[ids[1:][ids[1:] == ids[:-1]] // width] = False
    if not star.any():
        return nothing
    stars = np.flatnonzero(star)
    root = at_nodes[np.searchsorted(ids, stars * width + top[stars])]
    leaf = star[owner]
    leaf[root] = False
    # types of nodes: alike in kind and in facts, as they are listed
    fact, held = _joined([_codes(c) for c in fields]) + 1, np.diff(fact_at)
    kind = _codes(kinds)
    for j in range(int(held.max(initial=0))):
        own = np.zeros(len(kind), np.int64)
        own[held > j] = fact[fact_at[:-1][held > j] + j]
        kind = _joined([kind, own])
    used = np.concatenate([root, np.flatnonzero(leaf)])
    kinds_used = _codes(kind[used])
    type_of = np.zeros(len(kind), np.int64)
    type_of[used] = kinds_used
    first = used[_first(kinds_used)]
    listed = np.concatenate([np.arange(fact_at[v], fact_at[v + 1]) for v in first] or [np.zeros(0)]).astype(np.int64)
    told = [(a, b, k, t if k == "text" else raw if k == "bytes" else int(x)) for a, b, k, t, x, raw in zip(*(c.take(pa.array(listed)).to_pylist() for c in fields))]
    cuts = np.concatenate([[0], np.cumsum(held[first])])
    types = [(k, told[a:z]) for k, a, z in zip(kinds.take(pa.array(first)).to_pylist(), cuts[:-1], cuts[1:])]
    below, below_at = type_of[np.flatnonzero(leaf)], np.concatenate([[0], np.cumsum(d[stars])])
    recipes = rows.column("recipe").take(pa.array(stars)).dictionary_encode()
    group = _joined([recipes.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends[stars], d[stars]])
    groups: dict[str, list[Group]] = {}
    for g, one in enumerate(_first(group)):
        of = np.flatnonzero(group == g)
        row, count = stars[one], d[stars[one]]
        label, ordinal = (labels[child_at[row]].as_py(), int(number[child_at[row]])) if count else ("", 0)
        places = below_at[of][:, None] + np.arange(count)
        made = Group(stars[of], e.text("child") + e.text(label) + e.u32(ordinal), label, ordinal, type_of[root[of]], below[places])
        groups.setdefault(recipes[one].as_py(), []).append(made)
    return star, groups, types


def _grid(n: int, *parts: bytes | np.ndarray) -> np.ndarray:
    """Rows of parts after each other: bytes are the same in each, matrices have a row for each."""
    return np.concatenate([np.broadcast_to(np.frombuffer(x, np.uint8), (n, len(x))) if isinstance(x, bytes) else x.reshape(n, -1 if n else x.shape[-1]) for x in parts], 1)


def _by_bytes(digests: np.ndarray) -> np.ndarray:
    """The digests of each row (rows x digests x 32) in the order of their bytes."""
    lead = np.ascontiguousarray(digests[:, :, :8]).view(">u8")[:, :, 0].astype(np.uint64)
    out = np.take_along_axis(digests, np.argsort(lead, 1, kind="stable")[:, :, None], 1)
    lead = np.sort(lead, 1)
    tied = ((lead[:, 1:] == lead[:, :-1]) & (out[:, 1:] != out[:, :-1]).any(2)).any(1)
    for row in np.flatnonzero(tied):
        out[row] = np.frombuffer(b"".join(sorted(x.tobytes() for x in digests[row])), np.uint8).reshape(-1, 32)
    return out


def _rank(rows: np.ndarray) -> np.ndarray:
    """The place of each row in the order of their bytes."""
    out = np.zeros(len(rows), np.int64)
    out[sorted(range(len(rows)), key=[x.tobytes() for x in rows].__getitem__)] = np.arange(len(rows))
    return out


def _distinct(group: Group, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the parents and the children of the distinct stars of a group, and which of them each star is."""
    rows = np.ascontiguousarray(np.concatenate([code[group.top][:, None], np.sort(code[group.below], 1)], 1).astype(np.int32))
    _, first, which = np.unique(rows.view(f"V{4 * rows.shape[1]}")[:, 0], return_index=True, return_inverse=True)
    return rows[first, 0], rows[first, 1:], which.reshape(-1)


def _local(types: list[tuple[str, list[tuple]]], recipe: str, bin_: str, joined: Sequence[str] | None) -> tuple[np.ndarray, list[bytes]]:
    """For each type of node the number of what it says of itself in a bin, and these messages."""
    bare = Hasher(Indexed([""] * len(types), [k for k, _ in types], [f for _, f in types], [], []), recipe, "free")
    said: dict[bytes, int] = {}
    code = np.array([said.setdefault(m, len(said)) for m in bare.local(bin_, joined)], np.int64)
    return code, list(said)


def hash_bin(groups: Sequence[Group], recipe: str, bin_: str, code: np.ndarray, said: Sequence[bytes]) -> list[np.ndarray]:
    """For each group the digests of its stars in a bin, from what their nodes say. Mirrors `kernel.Hasher.dimension`."""
    head = lambda tag: e.header(recipe, bin_, "free", tag)
    hashed = lambda n, *parts: blake3_grids([_grid(n, *parts)])[0]
    m, one = len(said), e.u32(1)
    sizes: dict[int, list[int]] = {}
    for i, message in enumerate(said):
        sizes.setdefault(len(message), []).append(i)
    local = np.zeros((m, 32), np.uint8)
    for found, made in zip(sizes.values(), blake3_grids([np.frombuffer(b"".join(said[i] for i in some), np.uint8).reshape(len(some), size) for size, some in sizes.items()])):
        local[found] = made
    # children, by what they say
    colour = hashed(m, head("signature"), hashed(m, head("init"), local, NONE), NONE, NONE)
    tree = hashed(m, head("tree"), hashed(m, head("component"), one, colour, NONE), NONE)
    context = hashed(m, head("context"), local, colour, tree)
    beyond, seen = np.concatenate([tree, colour], 1), context
    # parents, each distinct star once
    tops, belows, whiches = zip(*(_distinct(g, code) for g in groups))
    counts = [(len(t), b.shape[1]) for t, b in zip(tops, belows)]

    def sent(of: np.ndarray) -> list[np.ndarray]:
        """Records of what lies below, in the order of their bytes: end and what is told of a child."""
        place = _rank(of)
        back = np.argsort(place)
        return [np.concatenate([np.broadcast_to(np.frombuffer(g.end, np.uint8), (n, k, len(g.end))), of[back[np.sort(place[b], 1)]]], 2) for g, b, (n, k) in zip(groups, belows, counts)]

    def each(*parts) -> list[np.ndarray]:
        """Digests for each group: a part is bytes for all, or a function of the group's number."""
        return blake3_grids([_grid(n, *(p if isinstance(p, bytes) else p(i) for p in parts)) for i, (n, _) in enumerate(counts)])

    own = lambda i: local[tops[i]]
    many = lambda i: e.u32(counts[i][1])
    records = sent(beyond)
    start = each(head("init"), own, many, lambda i: records[i])
    colours = each(head("signature"), lambda i: start[i], NONE, NONE)
    made = each(head("component"), one, lambda i: colours[i], NONE)
    repeated = lambda x, k: np.broadcast_to(x[:, None], (len(x), k, 32))
    trees = each(head("tree"), lambda i: made[i], many, lambda i: np.concatenate([repeated(colours[i], counts[i][1]), records[i]], 2))
    contexts = each(head("context"), own, lambda i: colours[i], lambda i: trees[i])
    records = sent(seen)
    finals = each(head("colour"), lambda i: contexts[i], many, lambda i: records[i], NONE)
    leaves = blake3_grids([_grid(n * k, head("colour"), seen[b.reshape(-1)], NONE, one, g.end, repeated(c, k)) for g, b, c, (n, k) in zip(groups, belows, contexts, counts)])
    leaves = [_by_bytes(x.reshape(n, k, 32)) for x, (n, k) in zip(leaves, counts)]
    pairs = lambda i: np.concatenate([np.broadcast_to(np.frombuffer(groups[i].end, np.uint8), (*counts[i], len(groups[i].end))), repeated(finals[i], counts[i][1]), leaves[i]], 2)
    full = each(head("full"), lambda i: e.u32(counts[i][1] + 1), lambda i: _by_bytes(np.concatenate([finals[i][:, None], leaves[i]], 1)), many, pairs)
    return [x[which] for x, which in zip(full, whiches)]


@lru_cache(maxsize=4096)
def _shape(recipe: str, label: str, ordinal: int, children: int) -> bytes:
    star = Graph({i: ("", []) for i in range(children + 1)}, [(0, label, ordinal, i) for i in range(1, children + 1)])
    return run([Hasher(star.index(), recipe, "free").shape()])[0][0]


def _binary(digests: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(digests, np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(0, 32 * len(data) + 1, 32, dtype=np.int32)), pa.py_buffer(data)])


def _maps(kind: pa.MapType, total: int, entries: Sequence[tuple[str, np.ndarray, np.ndarray]]) -> pa.Array:
    """A map for each of some rows, from (key, rows, digests); entries of a row keep their order."""
    rows = np.concatenate([r for _, r, _ in entries] or [np.zeros(0, np.int64)])
    order = np.argsort(rows, kind="stable")
    names = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(entries)), [len(r) for _, r, _ in entries])[order], pa.int32()), pa.array([k for k, _, _ in entries], pa.string()))
    digests = np.concatenate([x for _, _, x in entries] or [np.zeros((0, 32), np.uint8)])[order]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows.astype(np.int64), minlength=total))]).astype(np.int32)
    return pa.MapArray.from_arrays(pa.array(offsets), names.cast(pa.string()), _binary(digests)).cast(kind)


def hash_stars(found: tuple, total: int, dimensions: Mapping[str, Sequence[str]], facets: Iterable[Sequence[str]] | None, kinds: Mapping[str, pa.DataType]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Rows of the stars of a batch (`read_stars`), and the columns of their digests. See `kernel.hash_graphs`."""
    star, by_recipe, types = found
    stars = np.flatnonzero(star)
    place = np.zeros(total, np.int64)
    place[stars] = np.arange(len(stars))
    wanted = None if facets is None else {e.sorted_dimensions(x) for x in facets}
    policy, shape, mask, nodes = [None] * len(stars), [None] * len(stars), np.zeros(len(stars), np.int32), np.zeros(len(stars), np.int64)
    digests, joint = [], []
    for recipe, groups in by_recipe.items():
        dims = e.sorted_dimensions(dimensions.get(recipe) or dimensions["*"])
        varies = {}
        for d in dims:
            code, said = _local(types, recipe, d, None)
            digests += [(d, place[g.rows], x) for g, x in zip(groups, hash_bin(groups, recipe, d, code, said))]
            varies[d] = [code[g.below].min(1) != code[g.below].max(1) if g.below.shape[1] else np.zeros(len(g.rows), bool) for g in groups]
        for i, g in enumerate(groups):
            for a, x in enumerate(dims):
                for y in dims[a + 1 :]:
                    mask[place[g.rows]] |= np.where(varies[x][i] & varies[y][i], e.pair_bit(x, y), 0).astype(np.int32)
            bare, id_ = _shape(recipe, g.label, g.ordinal, g.below.shape[1]), e.policy_id(recipe, "free")
            for at in place[g.rows].tolist():
                policy[at], shape[at] = id_, bare
            nodes[place[g.rows]] = g.below.shape[1] + 1
        for bits in range(1, 1 << len(dims)):
            some = tuple(d for j, d in enumerate(dims) if bits >> j & 1)
            if wanted is not None and some not in wanted:
                continue
            those = [h for g in groups if len((h := g.some((mask[place[g.rows]] & e.facet_mask(some)) != 0)).rows)]
            if those:
                made = hash_bin(those, recipe, "structure", *_local(types, recipe, "structure", some))
                joint += [(e.dimensions_key(some), place[g.rows], x) for g, x in zip(those, made)]
    columns = {
        "mode": pa.array(["shape"] * len(stars)), "policy_id": pa.array(policy, pa.binary()), "digests": _maps(kinds["digests"], len(stars), digests), "shape": pa.array(shape, pa.binary()),
        "mixed_pairs": pa.array(mask), "joint": _maps(kinds["joint"], len(stars), joint), "node_count": pa.array(nodes),
    }
    return stars, columns
