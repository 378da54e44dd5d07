"""All queries of this library but those of the training-data operators, and their oracles."""

from __future__ import annotations

from courtflow.plans import bodies, courts, movement, papers, pictures, points, review, signals, stateful, summary

_PARTS = (bodies, courts, movement, papers, pictures, points, review, signals, stateful, summary)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
