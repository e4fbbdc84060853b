"""Registry of checked queries: a Spark callable and, where SQL can express it, the DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from checks import sql
from checks.views import Duck, Views, definitions, with_clause

Query = Callable[[Views], DataFrame]


@dataclass(frozen=True)
class Check:
    name: str
    query: Query
    oracle: str | None

    def oracle_sql(self) -> str | None:
        if self.oracle is None:
            return None
        views = {**definitions(Duck), **sql.VIEWS}
        body = self.oracle.strip()
        if body.upper().startswith("WITH "):
            return with_clause(body, views).rstrip() + ",\n" + body[5:] if with_clause(body, views) else body
        return with_clause(body, views) + body


CHECKS: dict[str, Check] = {}


def check(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        if name in CHECKS:
            raise ValueError(f"{name} is registered twice")
        CHECKS[name] = Check(name, query, oracle)
        return query

    return register
