"""Queries over the given tables, one for each operator, registered by name."""

from . import accuracy, extras, granules, models, more, release, screening, spatial, temporal, trials
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "accuracy", "extras", "granules", "models", "more", "release", "screening", "spatial", "temporal", "trials"]
