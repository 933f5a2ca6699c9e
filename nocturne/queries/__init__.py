"""Every registered query, with its SQL twin where SQL can say it."""

from nocturne.queries import behaviour, files, logs, models, relations, stats  # noqa: F401  (imports register)
from nocturne.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
