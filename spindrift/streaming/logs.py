"""Event logs as streams: the same transformations as in batch, duplicate suppression, keyed state, windows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spindrift.functions.text import canonical_json
from spindrift.operators.evidence import citation_id
from spindrift.operators.ingestion import cache_key, not_yet_extracted
from spindrift.sources.readers import EVENT_SCHEMA
from spindrift.storage import Place


def event_stream(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """Events of a folder of JSONL files as they arrive."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).json(path)


def without_repeats(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Events delivered again within the delay are dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id", "seq", "type"])


def windowed_counts(events: DataFrame, length: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Events per window and type; windows close when the delay has passed. An extension: the batch side has no windows."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", length), "type").count()


_STATE = "rounds long, events long, errors long, streak long, last_seq int"
_OUT = "session_id string, rounds long, events long, errors long, streak long, last_seq int"


def _step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rounds, n, errors, streak, last = state.get if state.exists else (0, 0, 0, 0, -1)
    for frame in frames:
        for kind, seq in sorted(zip(frame["type"], frame["seq"]), key=lambda x: x[1]):
            rounds += kind == "user_query"
            n += 1
            errors += kind == "error"
            streak = streak + 1 if kind == "error" else 0 if kind == "tool_result" else streak
            last = max(last, int(seq))
    state.update((rounds, n, errors, streak, last))
    yield pd.DataFrame([(key[0], rounds, n, errors, streak, last)], columns=[c.split()[0] for c in _OUT.split(", ")])


def session_state(events: DataFrame) -> DataFrame:
    """What each session adds up to, updated with every batch: rounds, events, errors, errors in a row, last sequence number."""
    own = events.filter("session_id is not null and seq is not null").select("session_id", "type", "seq")
    return own.groupBy("session_id").applyInPandasWithState(_step, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


_MEMORY = "rounds long, last_seq int, roles string, notes string, citations string"
_MEMORY_OUT = "session_id string, rounds long, last_seq int, turns long, notes array<string>, citations long"
#: Notes a session keeps, and the milliseconds of silence after which its state is let go. Citations are remembered by 8-byte hashes.
NOTES, IDLE = 20, 7 * 24 * 3600 * 1000


def _remember(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rounds, last, roles, notes, cited = (*state.get[:2], *map(json.loads, state.get[2:])) if state.exists else (0, -1, {}, [], [])
    seen, newest = set(cited), state.getCurrentWatermarkMs()
    for frame in frames:
        newest = max([newest, *(int(t.timestamp() * 1000) for t in frame["ts"] if not pd.isna(t))])
        for row in sorted(frame[["seq", "type", "name", "args", "source", "locator", "value"]].itertuples(index=False), key=lambda r: r.seq):
            last = max(last, int(row.seq))
            rounds += row.type == "user_query"
            role = {"user_query": "user", "tool_result": "tool", "final_answer": "assistant", "clarification": "assistant", "tool_call": "assistant"}.get(row.type)
            if role:
                roles[role] = roles.get(role, 0) + 1
            if row.type == "tool_call" and row.name == "save_note" and row.args:
                notes = [*notes, json.loads(row.args).get("text")][-NOTES:]
            if row.type == "citation":
                seen.add(hashlib.blake2b(json.dumps([row.source, row.locator, row.value]).encode(), digest_size=8).hexdigest())
    state.update((rounds, last, json.dumps(roles), json.dumps(notes), json.dumps(sorted(seen))))
    state.setTimeoutTimestamp(newest + IDLE)
    yield pd.DataFrame([(key[0], rounds, last, sum(roles.values()), [n for n in notes if n is not None], len(seen))], columns=[c.split()[0] for c in _MEMORY_OUT.split(", ")])


def session_memory(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """What each session's agent has at hand, updated with every batch: rounds, turns of its history, its newest notes and how many different citations. The state of a session is let go when the times of the stream are a week past its last event."""
    own = events.filter("session_id is not null and seq is not null").select("session_id", "seq", "type", "name", "args", "source", "locator", "value", "ts")
    return own.withWatermark("ts", delay).groupBy("session_id").applyInPandasWithState(_remember, _MEMORY_OUT, _MEMORY, "update", GroupStateTimeout.EventTimeTimeout)


def citations_once(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Citations of a stream, of equal ones of a session (source, canonical locator, value) within the delay the first that arrives."""
    rows = events.filter("type = 'citation'").withColumn("cite", citation_id(F.col("source"), F.col("locator")))
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id", "cite", "value"])


def calls_once(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Tool calls of a stream, of ones with equal names and canonical arguments in a session within the delay the first: the others a result cache answers."""
    rows = events.filter("type = 'tool_call'").withColumn("args_key", canonical_json(F.col("args")))
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id", "name", "args_key"])


def merged(*streams: DataFrame) -> DataFrame:
    """Events and what steers them (messages of users, put in from elsewhere) as one stream."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def file_stream(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """Files of a folder as they arrive: source, size_bytes, raw."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
    rows = (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)
    return rows.select(F.col("path").alias("source"), F.col("length").alias("size_bytes"), F.col("content").alias("raw"))


def ingesting(files: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, version: str = "1", prompt: str = "") -> StreamingQuery:
    """Compiles files as they arrive into tables below `path`: manifest (source, cache_key) and events (source, seq, status, message), by batch.

    Files whose source and cache key the manifest has are skipped; `transform` gives (source, status, message) of the
    others. Events of a source are numbered on: started, then succeeded or failed; or skipped. A batch that is run again
    replaces itself, as it is held against the other batches only; batches of another checkpoint are others.
    """
    manifest, events = f"{path}/manifest", f"{path}/events"
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("cache_key", cache_key(F.col("raw"), version, prompt)).persist()
        try:
            at = Place(spark, manifest)
            mine = (F.col("run") == run) & (F.col("batch") == number)
            old = spark.read.schema("source string, cache_key string, run string, batch long").parquet(manifest).filter(~mine) if at.exists() else None
            todo = keyed if old is None else not_yet_extracted(keyed, old, ["source"])
            skipped = keyed.select("source", "cache_key").join(todo.select("source", "cache_key"), ["source", "cache_key"], "left_anti").select("source", F.lit(0).alias("step"), F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("message"))
            done = transform(todo.drop("cache_key")).select("source", "status", "message").persist()
            told = todo.select("source", F.lit(0).alias("step"), F.lit("started").alias("status"), F.lit(None).cast("string").alias("message")).unionByName(done.select("source", F.lit(1).alias("step"), "status", "message")).unionByName(skipped)
            seen = None
            if Place(spark, events).exists():
                seen = spark.read.schema("source string, seq long, status string, message string, run string, batch long").parquet(events).filter(~mine).groupBy("source").agg(F.max("seq").alias("last"))
            rows = told.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("step", "status")))  # two steps of a file
            rows = rows.withColumn("last", F.lit(-1)) if seen is None else rows.join(seen, "source", "left")
            rows = rows.select("source", (F.coalesce("last", F.lit(-1)) + F.col("k")).cast("long").alias("seq"), "status", "message")
            good = todo.join(done.filter("status = 'succeeded'").select("source"), "source", "left_semi").select("source", "cache_key")
            for out, table in ((rows, events), (good, manifest)):
                told = out.withColumn("run", F.lit(run)).withColumn("batch", F.lit(number).cast("long"))
                told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "batch").parquet(table)
            done.unpersist()
        finally:
            keyed.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_table(events: DataFrame, path: str, checkpoint: str, **options: Any) -> StreamingQuery:
    """Writes a stream to a table; each batch is written once, and rows are kept apart by batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(**options)
