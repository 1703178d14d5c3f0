"""Names of columns that an operator adds while it works."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def spare_names(taken: DataFrame | Iterable[str], *wanted: str) -> list[str]:
    """``wanted`` names, each with underscores before it until no column of ``taken`` has it, in whatever case."""
    columns = taken.columns if isinstance(taken, DataFrame) else taken
    used = {c.lower() for c in columns}
    found = []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        found.append(name)
    return found
