"""Every query of the history engine, with the SQL it is held against."""

from daybook.queries import engine_queries, history_queries, redact_queries, search_queries

MODULES = (search_queries, redact_queries, history_queries, engine_queries)


def queries() -> dict:
    return {f.__name__: f for m in MODULES for f in m.NAMES}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.sql().items()}
