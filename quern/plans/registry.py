"""Every registered query by name, and the DuckDB SQL that gives the same rows."""

from quern.plans import curation, evaluation, retrieval, scalars, state  # noqa: F401  they register
from quern.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
