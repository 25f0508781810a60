"""Every query of the engine by name, and the SQL it is checked against."""

from __future__ import annotations

from quire.plans import oracle, queries, roundtrips

QUERIES = queries.QUERIES | roundtrips.QUERIES
ORACLE_SQL = oracle.ORACLE_SQL | roundtrips.oracle(
    oracle.SECTIONS, oracle.TURNS, oracle.PARENTS, oracle.MERGED, oracle.TOKENS, oracle._bm25(oracle.QUERY_TERMS, "true", 10), oracle.ORACLE_SQL["render_outline"]
)

__all__ = ["ORACLE_SQL", "QUERIES"]
