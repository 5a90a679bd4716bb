"""Entities, manifests, sidecars, dead letters and session logs as files. Writes can be repeated without harm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.ingestion import upserted
from spindrift.storage import Place


def write_entities(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces the partitions of the entities in rows, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def replace_table(rows: DataFrame, path: str) -> None:
    """Writes a table beside the old one and puts it in its place; a failure leaves the old one. One writer at a time; on stores without a rename the moves are copies."""
    spark = rows.sparkSession
    at, new, old = Place(spark, path), Place(spark, f"{path}.{uuid.uuid4().hex}"), Place(spark, f"{path}.old-{uuid.uuid4().hex}")
    try:
        rows.write.parquet(str(new))
        if at.exists():
            at.move(old)
        try:
            new.move(at)
        except Exception:
            if old.exists() and not at.exists():
                old.move(at)
            raise
    finally:
        new.delete()
        if at.exists():
            old.delete()


def upsert_table(spark: SparkSession, rows: DataFrame, path: str, key: str = "id") -> None:
    """Puts rows into a table by key: new ones are added, old ones with the same key replaced."""
    if Place(spark, path).exists():
        rows = upserted(spark.read.schema(rows.schema).parquet(path), rows, key)
    replace_table(rows, path)


def write_dead_letters(failures: DataFrame, path: str) -> None:
    """One JSON line per failure with its payload in base64, by type of error."""
    out = failures.withColumn("raw", F.base64("raw")) if "raw" in failures.columns else failures
    out.write.mode("append").partitionBy("error_type").json(path)


def append_events(events: DataFrame, path: str) -> None:
    """Adds events to JSONL logs by session; null fields are left out."""
    events.withColumn("session", F.col("session_id")).write.mode("append").partitionBy("session").json(path)


def fan_out(rows: DataFrame, *writers) -> None:
    """Every writer gets the same rows, computed once, in order; the first failure ends it."""
    rows = rows.persist()
    try:
        for w in writers:
            w(rows)
    finally:
        rows.unpersist()


def export_session(spark: SparkSession, path: str, session_id: str, to: str) -> None:
    """One session's log as a JSONL file of its own; an existing target is an error."""
    if Place(spark, to).exists():
        raise FileExistsError(to)
    spark.read.json(path).filter(F.col("session_id") == session_id).orderBy("seq").coalesce(1).write.json(to)
