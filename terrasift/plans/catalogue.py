"""Every query of the engine by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import access, cells, labels, models, relations

_PARTS = (access, cells, labels, models, relations)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
