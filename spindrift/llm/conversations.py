"""Conversations from message rows: parent pointers, pointer jumping, ordered paths.

Each row's parent is the row before it in its session. Rows are first put into blocks of a fixed number of sequence
numbers, so that a session of any size is spread over many tasks; within a block the parent is the row before, and the
first row of a block points to the block before it. These pointers are resolved by jumping: each round joins every
unresolved block with the block it points to, takes over that block's pointer and adds up what lies between, so that a
session of n blocks needs about log n rounds. What is added up along the way (messages, the greatest turn so far, the
kind of the last message) decides whether a session is broken, empty or lacks a reply, and gives each message its place.
A pointer to a block that is not there ends in an orphan, one that never ends lies on a cycle; both break a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.runtime import Workspace

#: Sequence numbers in a block. As they are of 32 bits, no session has more than 2 ** 32 / BLOCK blocks, whatever the block's size no more than 2 ** 32.
BLOCK = 512
MAX_JUMPS = 33
ROLES = {"user_query": "user", "clarification": "assistant", "final_answer": "assistant"}
#: What a repeated row must agree in.
SAID = ("type", "turn", "query", "question", "text")


def _written(c: Column) -> Column:
    """Whether a text has a letter or digit."""
    return F.coalesce(c.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def _is(what: str, text: str) -> Column:
    return F.coalesce(F.col("type") == what, F.lit(False)) & _written(F.col(text))


def _block(seq: Column) -> Column:
    return F.floor(seq / BLOCK).cast("long").alias("block")


def steps(events: DataFrame) -> DataFrame:
    """One row per session and sequence number: session_id, seq, block, turn, torn (whether its rows differ), mark (ask, reply or null), user and answer (whether it is of one).

    Rows without session or sequence number are left out; rows delivered more than once count once. Rows are compared by
    128 bits of hashes, so that the sums that are shuffled are of fixed size and hold no text.
    """
    bits = [F.col(c).isNull() for c in SAID]
    rows = events.filter("session_id is not null and seq is not null").select(
        "session_id", "seq", "turn", F.xxhash64(F.lit(1), *SAID, *bits).alias("h"), F.xxhash64(F.lit(2), *bits, *SAID).alias("g"),
        _is("user_query", "query").alias("asks"), (_is("final_answer", "text") | _is("clarification", "question")).alias("replies"),
        F.coalesce(F.col("type") == "user_query", F.lit(False)).alias("user"), F.coalesce(F.col("type").isin("final_answer", "clarification"), F.lit(False)).alias("answer"),
    )
    one = rows.groupBy("session_id", "seq").agg(
        ((F.min("h") != F.max("h")) | (F.min("g") != F.max("g"))).alias("torn"), F.min("turn").alias("turn"),
        *(F.bool_or(c).alias(c) for c in ("asks", "replies", "user", "answer")),
    )
    mark = F.when(F.col("asks"), "ask").when(F.col("replies"), "reply")
    return one.select("session_id", "seq", _block(F.col("seq")), "turn", "torn", mark.alias("mark"), "user", "answer")


def _blocks(rows: DataFrame) -> DataFrame:
    """What each block adds up to; a block has BLOCK rows at most."""
    w = Window.partitionBy("session_id", "block").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("top", F.max("turn").over(before))
        .withColumn("last_mark", F.last("mark", True).over(before))
        .withColumn("user_before", F.coalesce(F.max("user").over(before), F.lit(False)))
    )
    falls = F.coalesce(F.col("turn") < F.col("top"), F.lit(False))
    first = F.struct("seq", "mark")
    return rows.groupBy("session_id", "block").agg(
        F.count("mark").alias("n"),
        F.bool_or(F.col("torn") | falls).alias("broken"),
        F.bool_or(F.col("answer") & ~F.col("user_before")).alias("answer_first"),  # unless a user spoke in a block before
        F.bool_or("user").alias("user"),
        F.max("turn").alias("turn_max"),
        F.min("turn").alias("turn_min"),
        F.bool_or(F.coalesce((F.col("mark") == "ask") & (F.col("last_mark") == "ask"), F.lit(False))).alias("unanswered"),
        F.min(F.when(F.col("mark").isNotNull(), first))["mark"].alias("first_mark"),
        F.max(F.when(F.col("mark").isNotNull(), first))["mark"].alias("last_mark"),
        F.count_if(F.col("mark") == "ask").alias("asks"),
    )


def _linked(blocks: DataFrame) -> DataFrame:
    """Blocks with the block before them in their session, or null."""
    w = Window.partitionBy("session_id").orderBy("block")
    return blocks.withColumn("up", F.lag("block").over(w)).withColumn("leaf", F.lead("block").over(w).isNull())


def jumped(blocks: DataFrame, ws: Workspace) -> DataFrame:
    """The blocks (session_id, block, up and their sums) with what all blocks before them add up to: messages before, greatest turn, whether a user spoke, last mark; and whether their pointers end at an `orphan`, whose parent is not there, or never (`cyclic`).

    Pointers double their reach every round, so that after MAX_JUMPS rounds, more than a session's blocks need, only those
    on or below a cycle are open.
    """
    state = blocks.select("session_id", "block", "up", F.lit(0).cast("long").alias("n_before"), F.lit(None).cast("int").alias("turn_before"), F.lit(False).alias("user_before"), F.lit(None).cast("string").alias("mark_before"))
    own = blocks.select("session_id", F.col("block").alias("up"), F.col("n").alias("n0"), F.col("turn_max").alias("t0"), F.col("user").alias("u0"), F.col("last_mark").alias("m0"))
    first = state.join(own, ["session_id", "up"], "left").select(
        "session_id", "block", F.when(F.col("n0").isNotNull(), F.col("up")).alias("up"), F.coalesce("n0", F.lit(0)).cast("long").alias("n_before"), F.col("t0").cast("int").alias("turn_before"), F.coalesce("u0", F.lit(False)).alias("user_before"),
        F.col("m0").alias("mark_before"), (F.col("up").isNotNull() & F.col("n0").isNull()).alias("orphan"),
    )
    state, at = ws.keep(first)
    for _ in range(MAX_JUMPS):
        if not state.filter("up is not null").take(1):
            break
        there = state.select("session_id", F.col("block").alias("up"), F.col("up").alias("up2"), F.col("n_before").alias("n2"), F.col("turn_before").alias("t2"), F.col("user_before").alias("u2"), F.col("mark_before").alias("m2"), F.col("orphan").alias("o2"))
        state = state.join(there, ["session_id", "up"], "left").select(
            "session_id", "block", F.col("up2").alias("up"), (F.col("n_before") + F.coalesce("n2", F.lit(0))).alias("n_before"), F.greatest("turn_before", "t2").alias("turn_before"),
            (F.col("user_before") | F.coalesce("u2", F.lit(False))).alias("user_before"), F.coalesce("mark_before", "m2").alias("mark_before"), (F.col("orphan") | F.coalesce("o2", F.lit(False))).alias("orphan"),
        )
        state, now = ws.keep(state)
        ws.drop(at)
        at = now
    return state.withColumn("cyclic", F.col("up").isNotNull()).drop("up")


def _resolved(events: DataFrame, ws: Workspace) -> DataFrame:
    """The blocks with their own sums and those of all before them."""
    blocks, _ = ws.keep(_linked(_blocks(steps(events))))
    return blocks.join(jumped(blocks, ws), ["session_id", "block"])


def _verdicts(rows: DataFrame) -> DataFrame:
    falls = F.coalesce(F.col("turn_min") < F.col("turn_before"), F.lit(False))
    open_end = F.col("leaf") & (F.coalesce("last_mark", "mark_before") == "ask")
    unanswered = F.col("unanswered") | F.coalesce((F.col("mark_before") == "ask") & (F.col("first_mark") == "ask"), F.lit(False)) | F.coalesce(open_end, F.lit(False))
    sums = rows.groupBy("session_id").agg(
        F.sum("asks").alias("asks"),
        F.bool_or(F.col("broken") | F.col("orphan") | F.col("cyclic") | falls | (F.col("answer_first") & ~F.col("user_before"))).alias("broken"),
        F.bool_or(unanswered).alias("unanswered"),
    )
    reason = F.when(F.col("asks") == 0, "empty").when(F.col("broken"), "broken").when(F.col("unanswered"), "missing_reply")
    return sums.select("session_id", reason.alias("reason"))


def verdicts(events: DataFrame) -> DataFrame:
    """One row per session: session_id, reason (empty, broken, missing_reply, or null for a whole conversation).

    A session is every id with a row that has a sequence number. The first reason that holds is given. An empty table
    has no session; types that are none of a message are steps of the session but neither ask nor reply.
    """
    return _verdicts(_resolved(events, Workspace(events.sparkSession, "conversations")))


def conversations(events: DataFrame) -> DataFrame:
    """The messages of whole conversations in order: session_id, position (from 1), seq, turn, role, text.

    Blank messages are left out of the conversation they belong to; sessions with a reason to drop them are left out
    whole. Verdicts are taken to the blocks of their session, and messages meet only their own block.
    """
    ws = Workspace(events.sparkSession, "messages")
    blocks, _ = ws.keep(_resolved(events, ws))
    good = blocks.select("session_id", "block", "n_before").join(_verdicts(blocks).filter("reason is null"), "session_id", "left_semi")
    content = F.when(F.col("type") == "user_query", F.col("query")).when(F.col("type") == "clarification", F.col("question")).otherwise(F.col("text"))
    role = F.when(F.col("type") == "user_query", "user").otherwise("assistant")
    said = events.filter(F.col("type").isin(*ROLES) & F.col("session_id").isNotNull() & F.col("seq").isNotNull())
    said = said.select("session_id", _block(F.col("seq")), "seq", "turn", role.alias("role"), content.alias("text")).filter(_written(F.col("text")))
    kept = said.join(good, ["session_id", "block"])
    one = kept.groupBy("session_id", "block", "n_before", "seq").agg(F.min(F.struct("turn", "role", "text")).alias("m"))  # repeats of a whole conversation are equal
    at = F.row_number().over(Window.partitionBy("session_id", "block").orderBy("seq"))
    return one.select("session_id", (F.col("n_before") + at).alias("position"), "seq", "m.turn", "m.role", "m.text")
