"""What callers may ask for, held to bounds."""

from __future__ import annotations

from sonoshelf.operators.findings import TRANSITIONS

# The bounds.
MOST_ROWS, MOST_OFFSET, MOST_CONTEXT, SNIPPET, DEFAULT_THRESHOLD, MOST_WHO = 1000, 1_000_000, 50, (80, 4000), 0.3, 200


def limit(n: int | None, default: int) -> int:
    return n if n is not None and 1 <= n <= MOST_ROWS else default


def threshold(x: float) -> float:
    return x if 0 <= x <= 1 else DEFAULT_THRESHOLD


def offset(n: int) -> int:
    return min(max(n, 0), MOST_OFFSET)


def context(n: int) -> int:
    return min(max(n, 0), MOST_CONTEXT)


def snippet(n: int) -> int:
    """Characters of a snippet; 0 is the whole text."""
    return 0 if n <= 0 else min(max(n, SNIPPET[0]), SNIPPET[1])


def states(raw: str) -> list[str] | None:
    """A list of a correction's states, separated by commas; None for all of them."""
    asked = raw.strip().lower()
    if asked in ("", "all", "any"):
        return None
    found = [s for s in map(str.strip, asked.split(",")) if s]
    if bad := [s for s in found if s not in TRANSITIONS]:
        raise ValueError(f"unknown states {bad}; there are {list(TRANSITIONS)}")
    return found


def decided_by(who: str) -> str:
    """Who decided, marked as a tool's caller."""
    who = who.strip() or "agent"
    return (who if who.startswith("mcp:") else f"mcp:{who}")[:MOST_WHO]
