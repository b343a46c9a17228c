"""Analyzers that other packages add: entry points that take a vault and return a DataFrame or JSON value."""

from __future__ import annotations

import json
from collections import Counter
from importlib.metadata import EntryPoint, entry_points

from pyspark.sql import DataFrame

from inkmesh.operators import graph, links
from inkmesh.sources.sinks import rows_of
from inkmesh.sources.vault import Vault

GROUP = "inkmesh.analyzers"


class AnalyzerError(RuntimeError):
    pass


def link_stats(vault: Vault) -> DataFrame:
    """Notes, linked notes and edges."""
    return graph.link_stats(vault.notes.select("path"), links.edges(vault))


BUILT_IN = {"link-stats": link_stats}


def listed(points: list[EntryPoint] | None = None) -> list[tuple[str, str]]:
    """(name, value) of all analyzers in order, none imported; a name used twice fails."""
    points = list(entry_points(group=GROUP)) if points is None else points
    names = [p.name for p in points] + list(BUILT_IN)
    twice = sorted(n for n, k in Counter(names).items() if k > 1)
    if twice:
        raise AnalyzerError(f"analyzer names used twice: {', '.join(twice)}")
    return sorted([(p.name, p.value) for p in points] + [(n, f"{f.__module__}:{f.__name__}") for n, f in BUILT_IN.items()])


def run(name: str, vault: Vault, points: list[EntryPoint] | None = None) -> object:
    """Result of one analyzer as a JSON value; every way to fail says which analyzer failed."""
    points = list(entry_points(group=GROUP)) if points is None else points
    if name not in [n for n, _ in listed(points)]:
        raise AnalyzerError(f"unknown analyzer: {name}")
    try:
        f = BUILT_IN.get(name) or next(p for p in points if p.name == name).load()
    except Exception as e:
        raise AnalyzerError(f"analyzer {name} cannot be loaded: {e}") from e
    if not callable(f):
        raise AnalyzerError(f"analyzer {name} is not callable")
    try:
        result = f(vault)
        result = list(rows_of(result)) if isinstance(result, DataFrame) else result
    except Exception as e:
        raise AnalyzerError(f"analyzer {name} failed: {e}") from e
    try:
        return json.loads(json.dumps(result, allow_nan=False))
    except (TypeError, ValueError) as e:
        raise AnalyzerError(f"analyzer {name} returned no JSON value: {e}") from e
