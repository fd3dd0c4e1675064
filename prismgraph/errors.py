"""What can go wrong. Problems of single rows are violation rows instead; these end a command."""


class CatalogError(ValueError):
    """A graph, key, digest, facet or declaration that can't be used."""


class EmptyName(CatalogError):
    """A name without a character."""


class InvalidName(CatalogError):
    """A name that holds the separator of canonical keys."""


class EmptyFacet(CatalogError):
    """A facet without a dimension."""


class InvalidDigest(CatalogError):
    """A digest that isn't 64 lowercase hexadecimal digits."""


class UnsupportedVersion(CatalogError):
    """A schema version that this one doesn't know."""


class DuplicateNode(CatalogError):
    """Two nodes under one key."""


class MissingNode(CatalogError):
    """A child or edge that ends at no node."""


class NodeKeyMismatch(CatalogError):
    """A node stored under another key than its own."""


class EdgeFields(CatalogError):
    """Facts on an edge that isn't an origin."""


class GraphKeyMismatch(CatalogError):
    """Digests of another graph than was asked for."""


class PolicyMismatch(CatalogError):
    """An index row of another policy."""


class FacetMismatch(CatalogError):
    """An address at another facet."""


class FacetNeedsJointPass(CatalogError):
    """Combining stored digests would match too much at this facet."""


class FacetDimensions(CatalogError):
    """An address whose dimensions aren't those of its facet."""


class MissingDimension(CatalogError):
    """A facet over a dimension without a digest."""


class CycleDetected(CatalogError):
    def __init__(self, key: str):
        super().__init__(f"cycle through `{key}`")
        self.key = key


class InvalidReference(CatalogError):
    """A text that isn't the URI of an artifact."""


class ClaimError(CatalogError):
    """A claim whose sides aren't addresses at its facet, or of a newer version."""


class LookupFacetMismatch(ClaimError):
    """A lookup in an index of another facet."""


class ViewError(CatalogError):
    """A view that can't be parsed or selects nothing."""


class RootMismatch(CatalogError):
    """The collection isn't the one whose root was published."""


class BrokenUnits(CatalogError):
    """Units that break their declaration; nothing of the batch was stored."""

    def __init__(self, message: str, violations: list[tuple[str, str | None, str]]):
        super().__init__(message)
        self.violations = violations
