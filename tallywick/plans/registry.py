"""All registered queries of the library's own operators, with their SQL twins."""

from __future__ import annotations

from tallywick.plans import document_queries, event_queries, name_queries, resolve_queries, search_queries, source_queries, stats_queries, tournament_queries  # noqa: F401
from tallywick.plans.catalog import QUERIES, SQL, Query

flagship = stats_queries.flagship


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
