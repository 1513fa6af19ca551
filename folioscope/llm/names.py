"""Column names of an operator's own beside those of a caller's table."""

from __future__ import annotations

from collections.abc import Iterable


def free(taken: Iterable[str], name: str) -> str:
    """``name``, lengthened until it is none of ``taken`` in any case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name
