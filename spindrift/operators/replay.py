"""The state in which sessions ended, rebuilt from their logs: history, notes, citations, tallies, recorded results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import canonical_json
from spindrift.operators import evidence, sessions


@dataclass
class State:
    """Tables by session_id: history (position, round, role, content, name), notes, citations, results (call by call) and sessions (tallies, and what keeps a session from being rebuilt)."""

    history: DataFrame
    notes: DataFrame
    citations: DataFrame
    results: DataFrame
    sessions: DataFrame


def recorded_results(events: DataFrame) -> DataFrame:
    """(session_id, seq, name, args_key, ordinal, result_seq, result): what each call that is not intercepted takes when the log is played again.

    The n-th of a session's calls with equal name and arguments takes the n-th result recorded for them; more calls than
    results take none.
    """
    log = sessions.log(events, "type", "call_id", "name", "args", "result")
    pairs = sessions.paired_calls(log.withColumns({"truncated": F.lit(None).cast("boolean"), "cached": F.lit(None).cast("boolean")}))
    calls = log.filter("type = 'tool_call'").filter(~F.coalesce(F.col("name").isin(*sessions.INTERCEPTED), F.lit(False)))
    calls = calls.select("session_id", "seq", "name", canonical_json(F.col("args")).alias("args_key")).withColumn("_call", F.sha2(F.to_json(F.struct("session_id", "name", "args_key")), 256))
    asked = sessions.running(calls, "_call", "seq", {"ordinal": F.lit(1)})
    known = asked.join(pairs.filter("result_seq is not null").select("session_id", "seq", "result_seq"), ["session_id", "seq"])
    queue = sessions.running(known.select("_call", "result_seq"), "_call", "result_seq", {"ordinal": F.lit(1)})
    texts = log.filter("type = 'tool_result'").select("session_id", F.col("seq").alias("result_seq"), "result")
    return asked.join(queue, ["_call", "ordinal"], "left").join(texts, ["session_id", "result_seq"], "left").select("session_id", "seq", "name", "args_key", "ordinal", "result_seq", "result")


def replayed(events: DataFrame, keep_notes: int = 20) -> State:
    """The same log gives the same state, whatever order its rows arrive in. Sessions without a user query cannot be rebuilt and have `error`."""
    turns = sessions.turns(events)
    rounds = sessions.with_rounds(events, "type")
    placed = sessions.running(turns, "session_id", "seq", {"position": F.lit(1)})
    history = placed.join(rounds.select("session_id", "seq", "round"), ["session_id", "seq"])
    tallies = rounds.groupBy("session_id").agg(
        F.max("round").alias("rounds"), F.count("*").alias("events"), F.count_if(F.col("type") == "error").alias("errors"), F.max("seq").alias("last_seq"),
    )
    error = F.when(F.col("rounds") == 0, "no user query: the session cannot be rebuilt")
    return State(history, sessions.recent_notes(events, keep_notes), evidence.citations(events), recorded_results(events), tallies.withColumn("error", error))


def steered(events: DataFrame) -> DataFrame:
    """(session_id, round, seq, mode, message, position): steering messages of each round in the order in which the loop drains them, before its next turn."""
    rows = sessions.with_rounds(events, "type", "mode", "message").filter("type = 'steering'")
    key = F.concat_ws("|", F.col("round").cast("string"), "session_id")
    numbered = sessions.running(rows.withColumn("_round", key), "_round", "seq", {"position": F.lit(1)})
    return numbered.select("session_id", "round", "seq", "mode", "message", "position")


def messages(turns: DataFrame) -> DataFrame:
    """Turns(session_id, seq, role, content, name, call_id, args) as the messages a provider takes: role and blocks (kind, text, id, name, input). What a tool says goes to the model as the user's message with the call's id."""
    block = lambda kind, text, id_, name, input_: F.struct(F.lit(kind).alias("kind"), text.alias("text"), id_.alias("id"), name.alias("name"), input_.alias("input"))
    none = F.lit(None).cast("string")
    blocks = (
        F.when(F.col("role") == "tool", F.array(block("tool_result", F.col("content"), F.coalesce("call_id", F.lit("")), none, none)))
        .when(F.col("args").isNotNull(), F.array(block("tool_use", none, F.coalesce("call_id", F.lit("")), F.coalesce("name", F.lit("")), F.col("args"))))
        .otherwise(F.array(block("text", F.col("content"), none, none, none)))
    )
    return turns.select("session_id", "seq", F.when(F.col("role") == "tool", "user").otherwise(F.col("role")).alias("role"), blocks.alias("blocks"))
