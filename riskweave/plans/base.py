"""Registration of queries with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskweave.sources.projection import EXPLOITED_SQL, FAULTY_SQL, HISTORY_SQL, RECORDS_SQL, SCORES_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
REFERENCE = "2002-01-01"
VIEWS = {"records": RECORDS_SQL, "history": HISTORY_SQL, "exploited": EXPLOITED_SQL, "scores": SCORES_SQL, "faulty": FAULTY_SQL}


def _counted(sql: str) -> str:
    """``count_if(test)`` as a filtered count, whose type is that of count."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + len('count_if(') : end - 1]}){sql[end:]}"
    return sql


def query(sql: str | None = None, views: tuple[str, ...] = ("records",)):
    """Registers the function under its name. The SQL may use the views, of which records comes first."""

    def register(function: Query) -> Query:
        name = function.__name__
        QUERIES[name] = function
        if sql is not None:
            text = _counted(sql.strip())
            head = "WITH " + ", ".join(VIEWS[v].strip() for v in views) if views else ""
            if text.upper().startswith("WITH RECURSIVE ") and views:
                head, text = head.replace("WITH ", "WITH RECURSIVE ", 1), ", " + text[15:]
            elif text.upper().startswith("WITH ") and views:
                text = ", " + text[5:]
            SQL[name] = f"{head} {text}" if views else text
        return function

    return register
