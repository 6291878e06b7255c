"""Names for private columns beside those of a caller's table."""

from __future__ import annotations

from collections.abc import Iterable


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted``, each lengthened by underscores until no column of ``taken`` and none before it has the
    name; Spark tells names apart without regard to case."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
