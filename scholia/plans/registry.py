"""All registered queries of the library, with their SQL."""

from __future__ import annotations

from scholia.plans import catalog, relational, tools

QUERIES = catalog.QUERIES | relational.QUERIES | tools.QUERIES
ORACLES = catalog.ORACLES | relational.ORACLES | tools.ORACLES
