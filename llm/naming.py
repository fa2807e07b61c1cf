"""Names for columns that a table doesn't have yet."""

from __future__ import annotations


def free_names(columns, *wanted: str) -> list[str]:
    """``wanted``, each with as many underscores as it takes to differ from ``columns`` and from the others."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
