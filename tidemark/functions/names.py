"""Names for helper columns."""

from __future__ import annotations


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores put before it until no column has it (names ignore case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name
