"""A store of sessions: logs as JSON lines in a folder for each session, sidecars as a table; forks, titles, export and import."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import sessions
from spindrift.sources.readers import EVENT_SCHEMA
from spindrift.storage import Place

META_SCHEMA = "session_id string, parent_id string, title string, created string, last_updated string, event_count int, schema_version int"
VERSION = max(sessions.VERSIONS)


class SessionStore:
    """Sessions below a folder. One writer for a session at a time."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, Place(spark, root)
        self.logs, self.metas = self.root / "logs", self.root / "meta"

    def _log(self, session_id: str) -> Place:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", session_id or ""):
            raise ValueError(f"bad session id {session_id!r}")
        return self.logs / f"session={session_id}"

    def exists(self, session_id: str) -> bool:
        return self._log(session_id).exists()

    def append(self, events: DataFrame) -> None:
        """Adds events to the logs of their sessions; null fields are left out."""
        events.withColumn("session", F.col("session_id")).write.mode("append").partitionBy("session").json(str(self.logs))

    def rewrite(self, session_id: str, events: DataFrame) -> None:
        """Puts events in the place of a session's whole log."""
        new = self.root / f".new-{session_id}"
        at = self._log(session_id)
        new.delete()
        events.write.json(str(new))
        at.delete()
        new.move(at)

    def events(self, session_id: str) -> DataFrame:
        """A session's log in order."""
        if not self.exists(session_id):
            raise FileNotFoundError(f"no session {session_id}")
        return self.spark.read.schema(EVENT_SCHEMA).json(str(self._log(session_id))).orderBy("seq")

    def all_events(self) -> DataFrame:
        return self.spark.read.schema(EVENT_SCHEMA).json(str(self.logs))

    # -- sidecars

    def write_meta(self, session_id: str, meta: dict[str, Any]) -> None:
        """One session's sidecar, a file that is replaced whole."""
        if meta.get("session_id") != session_id:
            raise ValueError(f"the sidecar is of {meta.get('session_id')!r}, not of {session_id!r}")
        self._log(session_id)
        (self.metas / f"{session_id}.json").write(json.dumps(meta, ensure_ascii=False).encode())

    def read_meta(self, session_id: str) -> dict[str, Any]:
        """A session's sidecar; where there is none, one made from its log. Unknown versions are an error; version 1 is read as the present one."""
        at = self.metas / f"{session_id}.json"
        if at.exists():
            meta = json.loads(at.read())
            if meta.get("schema_version") not in sessions.VERSIONS:
                raise ValueError(f"sidecar of {session_id}: unknown schema_version {meta.get('schema_version')!r}")
            return meta | {"schema_version": VERSION}
        iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        r = self.events(session_id).agg(F.count("*").alias("n"), iso(F.min("ts")).alias("lo"), iso(F.max("ts")).alias("hi")).first()
        return {"session_id": session_id, "parent_id": None, "title": None, "created": r.lo, "last_updated": r.hi, "event_count": r.n, "schema_version": VERSION}

    def set_title(self, session_id: str, title: str | None, now: str) -> dict[str, Any]:
        """Changes the title and the time of the last change, and nothing else."""
        meta = self.read_meta(session_id) | {"title": title, "last_updated": now}
        self.write_meta(session_id, meta)
        return meta

    def listing(self) -> DataFrame:
        """All sidecars that can be read, as a table."""
        if not self.metas.exists():
            return self.spark.createDataFrame([], META_SCHEMA)
        rows = self.spark.read.text(str(self.metas), wholetext=True).select(F.from_json("value", META_SCHEMA).alias("m")).select("m.*")
        return rows.filter(F.col("session_id").isNotNull() & F.col("schema_version").isin(*sessions.VERSIONS))

    def resolve(self, prefix: str) -> str:
        """The session a prefix stands for: the one with just that id, else the only one that begins so."""
        return resolve_prefix(self.listing(), prefix)

    # -- forks, export, import

    def fork(self, session_id: str, at_round: int, new_id: str, now: str) -> int:
        """A new session with the rounds before `at_round`, or all for -1, and its sidecar; how many events it has. Rounds that are not there are an error."""
        if self.exists(new_id):
            raise FileExistsError(new_id)
        rows = sessions.forked(self.events(session_id), session_id, at_round, new_id)
        self.rewrite(new_id, rows)
        n = self.events(new_id).count()
        self.write_meta(new_id, {"session_id": new_id, "parent_id": session_id, "title": None, "created": now, "last_updated": now, "event_count": n, "schema_version": VERSION})
        return n

    def export(self, session_id: str, to: str) -> None:
        """A session's log as JSON lines in a folder, and its sidecar beside it as <folder>.meta.json. A target that is there is an error."""
        at = Place(self.spark, to)
        if at.exists():
            raise FileExistsError(to)
        meta = self.read_meta(session_id)
        self.events(session_id).write.json(str(at))
        Place(self.spark, f"{to}.meta.json").write(json.dumps(meta, ensure_ascii=False).encode())

    def import_(self, source: str) -> str:
        """Takes in an exported session under the id of its sidecar, else of its first event. A session that is there already is an error."""
        at, side = Place(self.spark, source), Place(self.spark, f"{source}.meta.json")
        if not at.exists():
            raise FileNotFoundError(source)
        rows = self.spark.read.schema(EVENT_SCHEMA).json(str(at))
        meta = json.loads(side.read()) if side.exists() else None
        first = None if meta else rows.filter("session_id is not null").orderBy("seq").select("session_id").first()
        if meta is None and first is None:
            raise ValueError(f"{source} has no event that names its session")
        session_id = meta["session_id"] if meta else first.session_id
        if self.exists(session_id):
            raise FileExistsError(session_id)
        self.rewrite(session_id, rows)
        self.write_meta(session_id, meta or self.read_meta(session_id))
        return session_id


def resolve_prefix(ids: DataFrame, prefix: str) -> str:
    """The session_id a prefix stands for among ids(session_id): an equal one wins, none or several are an error."""
    found = ids.filter(F.startswith(F.col("session_id"), F.lit(prefix))).select("session_id").distinct().orderBy("session_id").limit(11)
    names = [r.session_id for r in found.collect()]
    if prefix in names:
        return prefix
    if len(names) != 1:
        raise ValueError(f"{prefix!r} is " + (f"ambiguous: {', '.join(names[:10])}{' and more' if len(names) > 10 else ''}" if names else "no session's beginning"))
    return names[0]


def resolved_prefixes(ids: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, session_id or null, error or null) of many prefixes at once, by equality of beginnings."""
    own = ids.select("session_id").filter("session_id is not null").distinct()
    lengths = [r.n for r in prefixes.select(F.length("prefix").alias("n")).distinct().collect() if r.n is not None]  # as many as an id has letters, at most
    begun = own.select("session_id", F.explode(F.array(*(F.lit(n) for n in lengths))).alias("n")).filter(F.length("session_id") >= F.col("n")).select("session_id", F.expr("substring(session_id, 1, n)").alias("prefix")) if lengths else own.limit(0).select("session_id", F.col("session_id").alias("prefix"))
    sums = begun.groupBy("prefix").agg(F.count("*").alias("n"), F.min("session_id").alias("one"), F.bool_or(F.col("session_id") == F.col("prefix")).alias("exact"))
    hit = F.when(F.col("exact"), F.col("prefix")).when(F.col("n") == 1, F.col("one"))
    error = F.when(F.col("n").isNull(), "no match").when(hit.isNull(), "ambiguous")
    return prefixes.select("prefix").distinct().join(sums, "prefix", "left").select("prefix", hit.alias("session_id"), error.alias("error"))
