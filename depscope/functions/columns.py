"""Names for helper columns."""

from __future__ import annotations


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column is called so, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
