"""Event logs of sessions: order, rounds, pairing, tails, streaks, pressure, forks.

Running values over a session are formed in two levels, so that a session holding a large share of all rows is spread
over many tasks: within blocks of sequence numbers, and over the blocks' sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import canonical_json
from spindrift.runtime import hub_join

#: Sequence numbers in a block.
BLOCK = 1024

# Fixed value: the types of events.
TYPES = "user_query status tool_call tool_result citation clarification final_answer error compaction oracle steering".split()
#: Tools that the loop takes for itself, which have no result of their own.
INTERCEPTED = "save_note register_citation request_clarification stop escalate_to_oracle".split()
#: Versions of sidecars that can be read.
VERSIONS = (1, 2)


def log(events: DataFrame, *columns: str) -> DataFrame:
    """The events of each session, one per sequence number: of rows delivered more than once the first. Rows without session or sequence number are left out.

    With `columns` only these are carried beside session_id and seq, and only these are shuffled. Events without a
    row_id, the order of arrival, are a log already and stay as they are.
    """
    rows = events.filter("session_id is not null and seq is not null")
    if "row_id" not in events.columns:
        return rows.select("session_id", "seq", *columns) if columns else rows
    held = [c for c in (columns or events.columns) if c not in ("session_id", "seq")]
    first = rows.groupBy("session_id", "seq").agg(F.min_by(F.struct(*held), "row_id").alias("e"))
    return first.select("session_id", "seq", "e.*")


def running(rows: DataFrame, key: str, order: str, values: dict[str, Column]) -> DataFrame:
    """rows with running sums (up to and with each row) of values within key by an integer order."""
    block = F.floor(F.col(order) / BLOCK).alias("_block")
    rows = rows.select("*", block, *(v.cast("long").alias(f"_v_{n}") for n, v in values.items()))
    w = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumns({f"_in_{n}": F.sum(f"_v_{n}").over(w) for n in values})
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy(key, "_block").agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values))
    heads = heads.select(key, "_block", *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values))
    full = inner.join(heads, [key, "_block"]).withColumns({n: F.coalesce(f"_in_{n}", F.lit(0)) + F.col(f"_b_{n}") for n in values})
    return full.drop("_block", *(f"{p}{n}" for n in values for p in ("_v_", "_in_", "_b_")))


def with_rounds(events: DataFrame, *columns: str) -> DataFrame:
    """The log, or these columns of it, with `round`: how many user queries there are up to the event; 0 before the first."""
    return running(log(events, *columns), "session_id", "seq", {"round": (F.col("type") == "user_query").cast("int")})


def session_summary(events: DataFrame) -> DataFrame:
    """Rounds, events, first and last time of each session, and how often it errs, compacts, escalates and truncates."""
    count = lambda t: F.count_if(F.coalesce(F.col("type") == t, F.lit(False)))
    return log(events, "type", "ts", "truncated", "cached").groupBy("session_id").agg(
        count("user_query").alias("rounds"), F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        count("error").alias("errors"), count("compaction").alias("compactions"), count("oracle").alias("escalations"),
        F.count_if(F.coalesce("truncated", F.lit(False))).alias("truncated_results"), F.count_if(F.coalesce("cached", F.lit(False))).alias("cached_results"),
    )


def rebuilt_meta(meta: DataFrame, events: DataFrame) -> DataFrame:
    """Every session of the log with its sidecar, or with one made from the log: count, first and last time, no parent or title.

    Of several saves of a sidecar the one with the latest last_updated instant holds, whole; of equal ones the one with
    the greatest version, count and parent. A listing skips sidecars of unknown versions, as it does ones of sessions
    without events; versions_checked() raises for them instead.
    """
    own = log(events, "ts").groupBy("session_id").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    at = F.coalesce(F.expr("try_cast(last_updated as timestamp)"), F.lit("0001-01-01").cast("timestamp"))
    rank = F.struct(at, "schema_version", F.coalesce("event_count", F.lit(-1)), F.coalesce("parent_id", F.lit("")))
    side = meta.filter(F.col("schema_version").isin(*VERSIONS)).groupBy("session_id").agg(F.max_by(F.struct("parent_id", "event_count", F.lit(True).alias("there")), rank).alias("m"))
    rows = own.join(side, "session_id", "left")
    return rows.select("session_id", F.col("m.parent_id").alias("parent_id"), F.coalesce(F.col("m.event_count").cast("long"), "n").alias("event_count"), F.col("m.there").isNull().alias("rebuilt"), F.col("lo").alias("created"), F.col("hi").alias("last_updated"))


def versions_checked(meta: DataFrame) -> DataFrame:
    """The sidecars; a row of an unknown version is an error when it is read."""
    known = F.coalesce(F.col("schema_version").isin(*VERSIONS), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("sidecar of "), F.coalesce("session_id", F.lit("no session")), F.lit(": unknown schema_version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("null"))))
    return meta.withColumn("schema_version", F.when(known, F.col("schema_version")).otherwise(wrong.cast("int")))


def paired_calls(events: DataFrame) -> DataFrame:
    """Every tool call that is not intercepted with its first later result of the same call id, or nulls."""
    rows = log(events, "type", "call_id", "name", "args", "truncated", "cached")
    calls = rows.filter(F.col("type") == "tool_call").filter(~F.coalesce(F.col("name").isin(*INTERCEPTED), F.lit(False))).select("session_id", "call_id", "seq", "name", "args")
    results = rows.filter("type = 'tool_result'").select("session_id", "call_id", F.col("seq").alias("rseq"), "truncated", "cached")
    both = calls.join(results, ["session_id", "call_id"], "left").filter("rseq is null or rseq > seq")
    found = both.groupBy("session_id", "seq").agg(F.min("rseq").alias("result_seq"), F.min_by("truncated", "rseq").alias("truncated"))
    return calls.join(found, ["session_id", "seq"], "left").select("session_id", "call_id", "seq", "name", "result_seq", "truncated")


def call_ordinals(events: DataFrame) -> DataFrame:
    """Which of the identical calls (name and canonical arguments, so that the order of keys is nothing) of its session each call is, from 1: the recorded result it takes."""
    key = F.sha2(F.to_json(F.struct("session_id", "name", canonical_json(F.col("args")).alias("args"))), 256)
    calls = log(events, "type", "name", "args").filter("type = 'tool_call'").select("session_id", "seq", "name", key.alias("_call"))
    return running(calls, "_call", "seq", {"ordinal": F.lit(1)}).select("session_id", "seq", "name", "ordinal")


def last_rows(rows: DataFrame, n: int, key: str = "session_id", order: str = "seq") -> DataFrame:
    """The last n rows of each key with `total`, its number of rows, and `truncated`, whether there are more. Tasks keep n rows of a key before anything is shuffled."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    total = rows.groupBy(key).agg(F.count("*").alias("total"))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank").join(total, key).withColumn("truncated", F.col("total") > n)


def recent_notes(events: DataFrame, n: int = 20) -> DataFrame:
    """The newest n notes of each session: the texts its agent gave to save_note, which is a call without a result."""
    calls = log(events, "type", "name", "args").filter("type = 'tool_call' and name = 'save_note'")
    return last_rows(calls.select("session_id", "seq", F.get_json_object("args", "$.text").alias("note")), n).select("session_id", "seq", "note")


def error_streaks(events: DataFrame, limit: int = 3) -> DataFrame:
    """Runs of tool errors without a success between: session, first event, length, and whether the limit (a nudge) and the step after it (an abort) were reached. Other events neither add to a run nor end it."""
    steps = log(events, "type").filter("type in ('error', 'tool_result')")
    marked = running(steps, "session_id", "seq", {"island": (F.col("type") == "tool_result").cast("int")})
    runs = marked.filter("type = 'error'").groupBy("session_id", "island").agg(F.min("seq").alias("first_seq"), F.count("*").alias("length"))
    return runs.select("session_id", "first_seq", "length", (F.col("length") >= limit).alias("nudged"), (F.col("length") > limit).alias("aborted"))


def iteration_nudges(events: DataFrame, every: int = 3) -> DataFrame:
    """The turns at which an iteration nudge is due: every k-th, not the first."""
    return log(events, "turn").filter((F.col("turn") > 0) & (F.col("turn") % every == 0)).select("session_id", "turn").distinct()


def turns(events: DataFrame) -> DataFrame:
    """The log as turns of a history: role and content of what users, assistants and tools said."""
    role = F.when(F.col("type") == "user_query", "user").when(F.col("type") == "tool_result", "tool").when(F.col("type").isin("final_answer", "clarification", "tool_call"), "assistant")
    content = F.coalesce("query", "text", "question", "result", "args", F.lit(""))
    return log(events, "type", "query", "text", "question", "result", "args", "name").select("session_id", "seq", role.alias("role"), content.alias("content"), "name").filter("role is not null")


def _less(rows: DataFrame, last: DataFrame, by: str) -> DataFrame:
    """(session_id, by, k): how many rows of each session have each value, without its last rows. Counts are taken off each other, so that no row meets its session in a join."""
    every = rows.filter(F.col(by).isNotNull()).groupBy("session_id", by).agg(F.count("*").alias("k"))
    off = last.filter(F.col(by).isNotNull()).groupBy("session_id", by).agg((-F.count("*")).alias("k"))
    return every.unionByName(off).groupBy("session_id", by).agg(F.sum("k").alias("k")).filter("k > 0")


def _named(counts: DataFrame, by: str, name: str) -> DataFrame:
    return counts.groupBy("session_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", by, "k"))), ",").alias(name))


def history_digest(events: DataFrame, keep: int = 3) -> DataFrame:
    """What compaction leaves of each history: a line on all but the last `keep` turns, with role and tool counts sorted by name."""
    t = turns(events)
    total = t.groupBy("session_id").agg(F.count("*").alias("n"))
    last = last_rows(t.select("session_id", "seq", "role", "name"), keep)
    roles, tools = _named(_less(t, last, "role"), "role", "roles"), _named(_less(t, last, "name"), "name", "tools")
    joined = total.filter(F.col("n") > keep).join(roles, "session_id").join(tools, "session_id", "left")
    line = F.concat_ws(" | ", F.format_string("compacted %d prior turn(s)", F.col("n") - keep), F.concat(F.lit("roles="), "roles"), F.concat(F.lit("tools="), "tools"))
    return joined.select("session_id", (F.col("n") - keep).alias("compacted"), line.alias("digest"))


def compacted(events: DataFrame, keep: int = 3, summariser: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(session_id, seq, role, content): the last `keep` turns of each history, and before them, as turn -1 by `digest`, what the summariser (turns to session_id, digest) leaves of the others; histories as short as that have none."""
    t = turns(events)
    recent = last_rows(t, keep).select("session_id", "seq", "role", "content")
    digest = (summariser(t) if summariser else history_digest(events, keep)).select("session_id", F.lit(-1).alias("seq"), F.lit("digest").alias("role"), F.col("digest").alias("content"))
    return recent.unionByName(digest)


def context_pressure(events: DataFrame, budget: int, tiers: tuple[float, float, float] = (0.8, 0.9, 0.95)) -> DataFrame:
    """Running size of each history (a token is taken for four characters), as a share of the budget, and the tier of compaction it calls for; what compaction would free is not fed back."""
    if not 0 < tiers[0] < tiers[1] < tiers[2] < 1:
        raise ValueError("thresholds must rise within (0, 1)")
    t = turns(events).withColumn("tokens", F.ceil(F.length("content") / 4))
    used = running(t, "session_id", "seq", {"used": F.col("tokens")})
    share = F.col("used") / budget
    tier = F.when(share >= tiers[2], 3).when(share >= tiers[1], 2).when(share >= tiers[0], 1).otherwise(0)
    return used.select("session_id", "seq", "used", F.round(share, 6).alias("pressure"), tier.alias("tier"))


def fork(events: DataFrame, at_round: int, suffix: str) -> DataFrame:
    """The events a fork of each session before its round takes over, under the new session's id; -1 takes all, and sessions without that round have none."""
    rows = with_rounds(events, "type")
    if at_round >= 0:
        have = rows.groupBy("session_id").agg(F.max("round").alias("rounds")).filter(F.col("rounds") >= at_round).select("session_id")
        rows = hub_join(rows.filter(F.col("round") < at_round), have, "session_id")
    return rows.select(F.concat("session_id", F.lit(suffix)).alias("session_id"), F.col("session_id").alias("parent_id"), "seq", "type", "round")


def forked(events: DataFrame, session_id: str, at_round: int, new_id: str) -> DataFrame:
    """The events that a fork of one session takes over, under its new id: those of the rounds before `at_round`, or all for -1. A round that the session has not is an error."""
    rows = with_rounds(events.filter(F.col("session_id") == session_id))
    have = rows.agg(F.max("round")).first()[0]
    if have is None:
        raise ValueError(f"no session {session_id}")
    if at_round != -1 and not 1 <= at_round <= have:
        raise ValueError(f"session {session_id} has rounds 1 to {have}, not {at_round}")
    kept = rows if at_round == -1 else rows.filter(F.col("round") < at_round)
    return kept.drop("round").withColumn("session_id", F.lit(new_id))


def action_batches(events: DataFrame) -> DataFrame:
    """What the model did at each turn of each round: a batch of calls (call_id, name, args) in order, which wins, else the text of a final answer."""
    rows = with_rounds(events, "type", "turn", "call_id", "name", "args", "text").filter("round > 0")
    call = F.when(F.col("type") == "tool_call", F.struct("seq", "call_id", "name", "args"))
    final = F.when(F.col("type") == "final_answer", F.struct("seq", "text"))
    groups = rows.groupBy("session_id", "round", "turn").agg(F.sort_array(F.collect_list(call)).alias("batch"), F.min(final)["text"].alias("text"), F.count(final).alias("finals"))  # of one turn
    acted = groups.filter((F.size("batch") > 0) | (F.col("finals") > 0))
    called = F.size("batch") > 0
    return acted.select("session_id", "round", "turn", F.when(called, "calls").otherwise("final").alias("action"), F.size("batch").cast("long").alias("calls"), "batch", F.when(~called, F.col("text")).alias("text"))


def shown_time(c: Column) -> Column:
    """An ISO time to the minute, with a space for its T; other texts as they are."""
    return F.when(F.contains(c, F.lit("T")), F.substring(F.replace(c, F.lit("T"), F.lit(" ")), 1, 16)).otherwise(c)


def final_answers(events: DataFrame) -> DataFrame:
    """The last final answer of each round."""
    rows = with_rounds(events, "type", "text").filter("type = 'final_answer' and round > 0")
    return rows.groupBy("session_id", "round").agg(F.max("seq").alias("seq"), F.max_by("text", "seq").alias("text"))


def valid_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_-]+\z"), F.lit(False))
