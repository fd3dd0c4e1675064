"""Labelled graphs that are the same once chosen aspects are ignored, on Spark. The names below are the library's surface;
each is imported when it is first asked for, so that a Python worker loads only what it runs."""

from importlib import import_module

_HOME = {
    "prismgraph.errors": ("CatalogError",),
    "prismgraph.operators.check": ("check_units", "infer_declaration"),
    "prismgraph.operators.hashing": ("hash_units", "with_address"),
    "prismgraph.operators.queries": ("bucket", "diff", "digest_index", "facet_index", "overlap", "root"),
    "prismgraph.plans.declaration": ("Declaration", "Declarations", "parse_declaration"),
    "prismgraph.plans.view": ("apply_view", "parse_view"),
    "prismgraph.sources.builder": ("GraphBuilder", "json_units"),
    "prismgraph.sources.corpus": ("Corpus",),
    "prismgraph.sources.records": ("fingerprint", "parse_fingerprint", "parse_uri", "uri"),
    "prismgraph.sources.units": ("read_units", "write_units"),
}
__all__ = sorted(n for names in _HOME.values() for n in names)


def __getattr__(name: str):
    for module, names in _HOME.items():
        if name in names:
            return getattr(import_module(module), name)
    raise AttributeError(f"module prismgraph has no attribute {name}")
