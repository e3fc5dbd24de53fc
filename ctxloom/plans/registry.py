"""Queries by name, each beside the SQL that gives the same rows."""

_queries: dict = {}
_sql: dict = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict:
    return dict(_sql)
