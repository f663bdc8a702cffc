"""The catalogue of error and issue codes."""

from __future__ import annotations

#: The codes that callers may meet, by what they are about.
CODES: dict[str, tuple[str, ...]] = {
    "configuration": ("missing_config", "invalid_config", "invalid_type_definition", "missing_parent_type", "circular_inheritance", "unknown_type"),
    "queries": ("invalid_query", "invalid_timezone", "context_not_found", "frontmatter_mode"),
    "expressions": (
        "invalid_expression", "expression_depth_exceeded", "type_error", "unknown_function", "wrong_argument_count", "circular_formula", "expression_evaluation_error",
    ),
    "files": ("file_not_found", "invalid_frontmatter", "non_mapping", "path_traversal", "path_conflict", "path_required", "write_failed", "concurrent_modification"),
    "validation": ("validation_failed", "duplicate_value", "duplicate_id", "filename_mismatch"),
    "batches": ("batch_failed", "unknown_operation"),
}
ALL = frozenset(c for codes in CODES.values() for c in codes)


def about(code: str) -> str | None:
    """What a code is about, or None for one that comes from a schema or rule of the user's."""
    return next((k for k, codes in CODES.items() if code in codes), None)
