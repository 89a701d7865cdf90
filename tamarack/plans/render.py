"""Results as text."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any


def show_value(v: Any) -> str:
    """NULL, doubles with a decimal at least, vectors in brackets."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        if v != v or v in (float("inf"), float("-inf")):
            return "nan" if v != v else "inf" if v > 0 else "-inf"
        whole, _, part = f"{v:.6f}".partition(".")
        return f"{whole}.{part.rstrip('0') or '0'}"
    return "[" + ", ".join(map(show_value, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


def show_table(names: Sequence[str], rows: Sequence[Sequence[Any]]) -> str:
    cells = [list(map(show_value, r)) for r in rows]
    wide = [max([len(n), *(len(r[k]) for r in cells)]) for k, n in enumerate(names)]
    rule = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
    line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)) + " |"
    return "\n".join([rule, line(names), rule, *map(line, cells), rule, f"({len(rows)} rows)"])
