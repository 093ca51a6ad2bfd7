"""All queries of the library and their SQL."""

from __future__ import annotations

from vellum.plans import (
    invoice_queries,  # noqa: F401  (registers its queries beside the operators')
    operator_queries,
    scalar_queries,
)

QUERIES = scalar_queries.QUERIES | operator_queries.QUERIES
ORACLES = scalar_queries.ORACLES | operator_queries.ORACLES
