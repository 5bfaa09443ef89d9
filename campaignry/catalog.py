"""All queries of the campaign engine and their DuckDB SQL."""

from . import ingest_queries, ledger_queries, message_queries, queries

QUERIES = queries.QUERIES | message_queries.QUERIES | ledger_queries.QUERIES | ingest_queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | message_queries.ORACLE_SQL | ledger_queries.ORACLE_SQL | ingest_queries.ORACLE_SQL
