"""The registry of queries: a name, a function of session and folder, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakewatch.sources import corpus as views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_CTE = {
    "corpus": views.CORPUS_SQL, "sources": views.SOURCES_SQL, "run_history": views.RUN_HISTORY_SQL, "source_events": views.SOURCE_EVENTS_SQL,
    "triggers": views.TRIGGERS_SQL, "notices": views.NOTICES_SQL,
}


def query(name: str, sql: str | None = None, *needs: str):
    """Registers a query, its SQL with the adapter views that it needs put before it."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = (f"WITH {', '.join(_CTE[n].strip() for n in needs)} " if needs else "") + sql
        return fn

    return add


def on_corpus(name: str, sql: str | None, fn, *needs: str) -> None:
    query(name, sql, "corpus", *needs)(lambda spark, d: fn(views.corpus(spark, d)))


def on_both(name: str, sql: str | None, fn) -> None:
    query(name, sql, "corpus", "sources")(lambda spark, d: fn(views.corpus(spark, d), views.sources(spark, d)))


def on_notices(name: str, sql: str | None, fn, *needs: str) -> None:
    query(name, sql, "notices", *needs)(lambda spark, d: fn(views.notices(spark, d)))


def same(pattern: str) -> str:
    """A pattern of ours as a quoted one for the SQL engine: its flags are named otherwise there."""
    for ours, theirs in (("(?isU)", "(?is)"), ("(?iU)", "(?i)"), ("(?U)", "")):
        pattern = pattern.replace(ours, theirs)
    return "'" + pattern.replace("'", "''") + "'"
