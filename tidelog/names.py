"""Names of columns that clash with none that a caller has."""

from __future__ import annotations

from collections.abc import Iterable


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """Each of ``names`` with as many underscores before it as it takes to be new; Spark doesn't tell cases apart."""
    have, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out
