"""Registered queries and their DuckDB SQL, by area."""

from . import bars, experiments, ranges, recursions, rolling, statistics, streams

_AREAS = (bars, rolling, recursions, statistics, experiments, streams, ranges)
QUERIES = {name: f for area in _AREAS for name, f in area.QUERIES.items()}
ORACLES = {name: sql for area in _AREAS for name, sql in area.ORACLES.items()}
