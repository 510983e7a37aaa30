"""All queries over the product-intelligence operators, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from veracet.plans import aggregations, composites, details, joins, relational, scalars, scoring, streams  # noqa: F401  they register
from veracet.plans.catalog import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
