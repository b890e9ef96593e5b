"""Queries over the driver's tables, each with SQL that gives the same rows."""

from strandline.plans import aggregates, clinical, encoding, joins, metrics, models, projections, series  # noqa: F401  they fill the catalogue
from strandline.plans.catalogue import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
