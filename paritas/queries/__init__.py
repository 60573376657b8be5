"""One query per operator over the test tables, with the SQL that must give the same rows."""

from . import match_queries, scalar_queries, source_queries, summary_queries

QUERIES = {
    **source_queries.QUERIES,
    **scalar_queries.QUERIES,
    **match_queries.QUERIES,
    **summary_queries.QUERIES,
}
