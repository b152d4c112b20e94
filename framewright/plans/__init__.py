"""Queries over the driver's tables, and the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framewright.plans import actions, features, flows, joins, mixing, rebuilds, rotations, rules, sampling, scalars, scans, schemas, series, statistics

_ALL = mixing.QUERIES | statistics.QUERIES | joins.QUERIES | series.QUERIES | sampling.QUERIES | scalars.QUERIES | rules.QUERIES | rebuilds.QUERIES | rotations.QUERIES | scans.QUERIES | schemas.QUERIES | flows.QUERIES | features.QUERIES | actions.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
