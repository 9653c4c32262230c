"""Enumerations in the order that their values sort and worsen in, and the columns of the canonical tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names in their order; a later completeness or confidence is worse.
COMPLETENESS = ("complete", "partial", "unsupported")
CONFIDENCE = ("high", "medium", "low")
EDGE_KINDS = ("contains", "module_dependency", "import", "re_export", "dynamic_import", "glob_import", "require", "workspace_source_bypass", "lexical_reference", "assume_reachable")
ROLES = ("production", "test", "tooling")
SCOPES = ("runtime", "public_surface")
TARGET_KINDS = ("node", "external", "unexported_workspace", "unresolved_internal", "dynamic_unknown", "unsupported")
FINDING_KINDS = (
    "unreachable_file", "unused_private_symbol", "test_only", "tooling_only", "unreferenced_public", "unexported_workspace_import",
    "workspace_source_bypass", "unresolved_internal_edge", "dynamic_boundary", "malformed_fuzz_directive",
)
# Kinds that a gate fails on, if their confidence is high.
GATING = ("unreachable_file", "unused_private_symbol", "unexported_workspace_import", "workspace_source_bypass", "unresolved_internal_edge", "malformed_fuzz_directive")
# Languages that run together, so that what one does not show bears on the others.
TOGETHER = ("javascript", "typescript", "svelte")
#: Edges that runtime reachability does not follow.
NOT_RUNTIME = ("contains", "re_export")


def ordinal(column: str | Column, names: tuple[str, ...]) -> Column:
    """The place of an enumeration's value, for sorting and worst-of; null for an unknown value."""
    c = F.col(column) if isinstance(column, str) else column
    place = F.array_position(F.array(*[F.lit(n) for n in names]), c)
    return F.when(place > 0, (place - 1).cast("int"))


def named(place: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), place.cast("int") + 1)
