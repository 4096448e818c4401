"""Caches of a Python worker. Workers are reused from stage to stage; a stage frees what other stages have left."""

from __future__ import annotations

from collections.abc import Callable

_CLEAR: dict[str, Callable[[], None]] = {}


def register(name: str, clear: Callable[[], None]) -> None:
    _CLEAR[name] = clear


def only(name: str) -> None:
    """Empty all caches but one."""
    for other, clear in _CLEAR.items():
        if other != name:
            clear()
