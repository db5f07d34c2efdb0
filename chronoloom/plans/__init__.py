"""Registered queries: each a Spark function of (spark, sf_dir), most with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


FAMILIES: list[str] = ["transcripts", "claims", "scoring", "notes", "corrections", "checks", "files"]


def load() -> None:
    """Import every family of queries once."""
    import importlib

    for family in FAMILIES:
        importlib.import_module(f"chronoloom.plans.{family}")
