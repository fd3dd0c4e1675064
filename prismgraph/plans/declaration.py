"""Declarations: what graphs of a recipe may look like, as data that fits the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from prismgraph import wire
from prismgraph.errors import CatalogError
from prismgraph.sources.units import name

OCCURS = ("one", "optional", "many")
SHAPES = ("seq", "set", "one")
ACYCLIC = ("no", "children", "children_and_dependency")


@dataclass(frozen=True)
class FieldDecl:
    name: str
    dimensions: tuple[str, ...]
    value: str
    occurs: str


@dataclass(frozen=True)
class ChildDecl:
    parents: tuple[str, ...]
    label: str
    children: tuple[str, ...]
    shape: str
    optional: bool = False


@dataclass(frozen=True)
class EdgeDecl:
    sources: tuple[str, ...]
    label: str
    prefix: bool
    targets: tuple[str, ...]
    role: str

    def matches(self, label: str) -> bool:
        return label.startswith(self.label) if self.prefix else label == self.label


@dataclass(frozen=True)
class Declaration:
    recipe: str
    roots: tuple[str, ...] = ()
    single_root: bool = False
    kinds: tuple[tuple[str, tuple[FieldDecl, ...]], ...] = ()
    children: tuple[ChildDecl, ...] = ()
    edges: tuple[EdgeDecl, ...] = ()
    acyclic: str = "no"
    keys: str = ""

    def problems(self) -> list[str]:
        """Why the declaration is ambiguous or refers to nothing; empty if it is well formed."""
        out, known = [], set()
        for kind, fields in self.kinds:
            if kind in known:
                out.append(f"kind `{kind}` is declared twice")
            known.add(kind)
            names = [f.name for f in fields]
            out += [f"field `{kind}.{n}` is declared twice" for i, n in enumerate(names) if n in names[:i]]
            out += [f"field `{kind}.{f.name}` has no dimension" for f in fields if not f.dimensions]

        def mention(what: str, kinds: tuple[str, ...]) -> None:
            out.extend(f"{what} mentions undeclared kind `{k}`" for k in sorted(set(kinds)) if k not in known)

        mention("roots", self.roots)
        groups = set()
        for c in self.children:
            mention(f"child group `{c.label}`", c.parents)
            mention(f"child group `{c.label}`", c.children)
            for parent in sorted(set(c.parents)):
                if (parent, c.label) in groups:
                    out.append(f"children `{parent}` -{c.label}-> are declared twice")
                groups.add((parent, c.label))
        for x in self.edges:
            mention("an edge", x.sources)
            mention("an edge", x.targets)
        return out

    def fills(self) -> tuple[str, ...]:
        """The dimensions that hold facts; structure always does."""
        found = {"structure"} | {d for _, fields in self.kinds for f in fields for d in f.dimensions}
        return tuple(d for d in wire.DIMENSIONS if d in found)

    def field_dimensions(self, kind: str, field_name: str) -> tuple[str, ...] | None:
        return next((f.dimensions for k, fields in self.kinds if k == kind for f in fields if f.name == field_name), None)

    def declares_field(self, dimension: str, field_name: str) -> bool:
        return any(f.name == field_name and dimension in f.dimensions for _, fields in self.kinds for f in fields)

    def to_json(self) -> str:
        out = {
            "recipe": self.recipe,
            "roots": list(self.roots),
            "single_root": self.single_root,
            "kinds": [{"kind": k, "fields": [{"name": f.name, "dimensions": list(f.dimensions), "value": f.value, "occurs": f.occurs} for f in fields]} for k, fields in self.kinds],
            "children": [{"parents": list(c.parents), "label": c.label, "children": list(c.children), "shape": c.shape, "optional": c.optional} for c in self.children],
            "edges": [{"sources": list(x.sources), "label": {"prefix" if x.prefix else "exact": x.label}, "targets": list(x.targets), "role": x.role} for x in self.edges],
            "acyclic": self.acyclic,
            "keys": self.keys,
        }
        return json.dumps(out, ensure_ascii=False, indent=2)


def _one_of(x, allowed: tuple[str, ...], what: str) -> str:
    if x not in allowed:
        raise CatalogError(f"unknown {what} `{x}`")
    return x


def _names(x, what: str) -> tuple[str, ...]:
    return tuple(sorted({name(k, what) for k in x}))


def parse_declaration(source: str | dict) -> Declaration:
    """Reads a declaration from JSON; one that isn't well formed is an error."""
    try:
        x = json.loads(source) if isinstance(source, str) else source
        kinds = []
        for k in x["kinds"]:
            fields = []
            for f in k.get("fields", []):
                dims = {_one_of(d, wire.DIMENSIONS, "dimension") for d in f["dimensions"]}
                fields.append(FieldDecl(name(f["name"], "field name"), tuple(d for d in wire.DIMENSIONS if d in dims), _one_of(f["value"], wire.VALUE_KINDS, "value type"), _one_of(f["occurs"], OCCURS, "occurrence")))
            kinds.append((name(k["kind"], "kind"), tuple(fields)))
        children = [
            ChildDecl(_names(c["parents"], "kind"), name(c["label"], "child label"), _names(c["children"], "kind"), _one_of(c["shape"], SHAPES, "shape"), bool(c.get("optional", False)))
            for c in x.get("children", [])
        ]
        edges = []
        for v in x.get("edges", []):
            ((how, label),) = v["label"].items()
            edges.append(EdgeDecl(_names(v["sources"], "kind"), name(label, "edge label"), _one_of(how, ("exact", "prefix"), "label pattern") == "prefix", _names(v["targets"], "kind"), _one_of(v["role"], wire.ROLES, "edge role")))
        made = Declaration(
            name(x["recipe"], "recipe"), _names(x.get("roots", []), "kind"), bool(x.get("single_root", False)), tuple(kinds), tuple(children), tuple(edges), _one_of(x.get("acyclic", "no"), ACYCLIC, "acyclicity"), x.get("keys", "")
        )
    except CatalogError:
        raise
    except (KeyError, TypeError, ValueError, AttributeError) as error:
        raise CatalogError(f"not a declaration: {type(error).__name__} {error}") from None
    if problems := made.problems():
        raise CatalogError("; ".join(problems))
    return made


@dataclass
class Declarations:
    """The registry: a recipe's declaration doesn't change once units are stored under it."""

    known: dict[str, Declaration] = field(default_factory=dict)

    def declare(self, declaration: Declaration) -> None:
        if problems := declaration.problems():
            raise CatalogError("; ".join(problems))
        before = self.known.get(declaration.recipe)
        if before is not None and before != declaration:
            raise CatalogError(f"recipe {declaration.recipe} has a different declaration already")
        self.known[declaration.recipe] = declaration

    def require(self, recipe: str) -> Declaration:
        if recipe not in self.known:
            raise CatalogError(f"no declaration for recipe {recipe}")
        return self.known[recipe]

    def fills(self) -> dict[str, tuple[str, ...]]:
        return {r: d.fills() for r, d in self.known.items()}
