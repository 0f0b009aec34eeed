"""Registry of the exploratory analyses: name -> function of the warehouse."""

from __future__ import annotations

from collections.abc import Callable

ANALYSES: dict[str, Callable] = {}


def analysis(name: str):
    def register(fn):
        ANALYSES[name] = fn
        return fn

    return register
