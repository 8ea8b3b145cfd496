"""SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations


def llm_oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return {}
