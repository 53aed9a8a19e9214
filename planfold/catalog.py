"""The registered queries of the floor-plan operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planfold.sources.fixtures import Views, twin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the derived views as a query, with the body of its SQL twin."""

    def add(build: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = twin(sql)
        return build

    return add


def load() -> None:
    """Imports the modules that register queries."""
    from planfold.plans import checks, elements, floors, layers, layout, mix, models, networks, projects, rasters, reports, rows, scores, shapes  # noqa: F401
