"""Named queries over the test tables and the SQL that states their results."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

import boardlens.plans.oracle.base  # noqa: F401
import boardlens.plans.oracle.rules  # noqa: F401
from boardlens.operators.inspections import keyed
from boardlens.plans.oracle import with_ctes
from boardlens.session import settled
from boardlens.sources.spi import spi_rows

T = TypeVar("T")

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
SHARED: list[dict] = []


def shared(make: Callable[[SparkSession, str], T]) -> Callable[[SparkSession, str], T]:
    """Tables that several queries of a session start from: made once for the folder in use, then read."""
    kept: dict[tuple[str, str], T] = {}

    @functools.wraps(make)
    def once(spark: SparkSession, folder: str) -> T:
        key = (spark.sparkContext.applicationId, folder)
        if key not in kept:
            kept.clear()
            kept[key] = make(spark, folder)
        return kept[key]

    SHARED.append(kept)
    return once


@shared
def rows(spark: SparkSession, folder: str) -> DataFrame:
    """The inspection table, written once: every query reads the columns it needs."""
    return settled(keyed(spi_rows(spark, folder)), "inspections")


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the shared oracle expressions."""

    def add(fn: QueryFn) -> QueryFn:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def oracle_sql() -> dict[str, str]:
    """Complete SQL per query, composed once every shared expression is known."""
    return {name: with_ctes(sql) for name, sql in ORACLES.items()}
