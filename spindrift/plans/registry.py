"""The queries of the engine's own operators, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.operators import hierarchy
from spindrift.plans import documents, evaluation, events
from spindrift.runtime import table


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.known_links(hierarchy.current_rows(table(spark, d, "session_meta")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = hierarchy.hierarchies(_sessions(spark, d))
    return nodes.filter("parent is not null").selectExpr("id AS session_id", "root AS root_id", "depth")


def p3_families(spark: SparkSession, d: str) -> DataFrame:
    nodes = hierarchy.hierarchies(_sessions(spark, d))
    return nodes.selectExpr("id AS session_id", "root AS root_id", "depth", "subtree", "cyclic", "array_join(path, ' > ') AS path")


def p3_intervals(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.intervals(hierarchy.hierarchies(_sessions(spark, d))).withColumnRenamed("id", "session_id")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchies(_sessions(spark, d)))


QUERIES = {f.__name__: f for f in (p3_found, p3_families, p3_intervals, p3_descendants)} | documents.QUERIES | events.QUERIES | evaluation.QUERIES
