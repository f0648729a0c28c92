"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import audits, checks, choices, clusters, contract, encoding, estimates, evidence, experiments, intervals, localization, matching, oriented, parity, ranking, rays, records, relations, sampling, sensing, series, slices, summaries, telemetry, trees, turned, verify
from .plans import commands, resolution
from .sources import readers, releases
from .streaming import captures, object_state, streams

MODULES = (relations, ranking, resolution, commands, intervals, telemetry, sampling, estimates, matching, choices, verify, checks, rays, series, encoding, clusters, summaries, audits, turned, oriented, evidence, experiments, records, sensing, localization, object_state, releases, slices, trees, contract, readers, parity, streams, captures)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest chair to each object of each scene."""
    return QUERIES["closest"](spark, sf_dir)
