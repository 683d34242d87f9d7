"""All queries of the library proper, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import check_plans, coverage_plans, gazetteer_plans, incident_plans, join_plans, mention_plans, news_plans, raster_plans, rollup_plans, row_plans, sighting_plans, time_plans

MODULES = [time_plans, row_plans, join_plans, check_plans, news_plans, sighting_plans, mention_plans, coverage_plans, rollup_plans, gazetteer_plans, incident_plans, raster_plans]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
