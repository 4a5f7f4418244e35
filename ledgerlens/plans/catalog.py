"""All registered queries and their oracle SQL."""

from __future__ import annotations

from . import (ledger_oracle, ledger_queries, log_oracle, log_queries, pipeline_oracle,
               pipeline_queries, screening_oracle, screening_queries)

ALL_QUERIES = {}
ALL_ORACLE = {}

for _q, _o in [(ledger_queries.QUERIES, ledger_oracle.ORACLE),
               (screening_queries.QUERIES, screening_oracle.ORACLE),
               (log_queries.QUERIES, {**log_oracle.ORACLE, **pipeline_oracle.ORACLE}),
               (pipeline_queries.QUERIES, pipeline_oracle.ORACLE)]:
    ALL_QUERIES.update(_q)
    ALL_ORACLE.update({k: v for k, v in _o.items() if k in _q})
