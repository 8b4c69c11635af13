"""Putting partial measure values together in Python, by the rules of Spark's aggregates or by a function of one's own."""

from __future__ import annotations

from collections.abc import Callable


def rank(v):
    """Pairs compare as Spark compares structs, nulls first."""
    parts = v.values() if isinstance(v, dict) else v if isinstance(v, tuple) else (v,)
    return tuple((x is not None, x) for x in parts)


def merge(kind: str | Callable, a, b):
    if a is None or b is None:
        return b if a is None else a
    if callable(kind):
        return kind(a, b)
    return a + b if kind in ("count", "sum") else (min if kind == "min" else max)(a, b, key=rank)


def merge_all(kinds, a, b) -> list:
    return [merge(kind, x, y) for kind, x, y in zip(kinds, a, b)]
