"""Queries over the event log of sessions, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import markup
from spindrift.operators import artifacts, hierarchy, replay, sessions, truncation
from spindrift.runtime import table
from spindrift.sinks import store
from spindrift.sources import readers

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with SQL if there is some."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = "WITH " + LOG + sql if sql.startswith("SELECT") else "WITH " + LOG + ", " + sql.removeprefix("WITH ")
        return f

    return add


LOG = """log AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY session_id, seq ORDER BY row_id) AS k FROM agent_events WHERE session_id IS NOT NULL AND seq IS NOT NULL) WHERE k = 1),
rounds AS (SELECT *, count(*) FILTER (type = 'user_query') OVER (PARTITION BY session_id ORDER BY seq) AS round FROM log),
turns AS (SELECT session_id, seq, name, CASE WHEN type = 'user_query' THEN 'user' WHEN type = 'tool_result' THEN 'tool' ELSE 'assistant' END AS role, coalesce(query, text, question, result, args, '') AS content
  FROM log WHERE type IN ('user_query', 'tool_result', 'final_answer', 'clarification', 'tool_call')) """


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "agent_events")


@query("SELECT session_id, seq, type, round FROM rounds")
def round_segmentation(spark: SparkSession, d: str) -> DataFrame:
    return sessions.with_rounds(_events(spark, d), "type").select("session_id", "seq", "type", "round")


@query("""SELECT session_id, count(*) FILTER (type = 'user_query') AS rounds, count(*) AS events, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) FILTER (type = 'error') AS errors, count(*) FILTER (type = 'compaction') AS compactions,
  count(*) FILTER (type = 'oracle') AS escalations, count(*) FILTER (truncated) AS truncated_results, count(*) FILTER (cached) AS cached_results FROM log GROUP BY session_id""")
def rounds_per_session(spark: SparkSession, d: str) -> DataFrame:
    rows = sessions.session_summary(_events(spark, d))
    return rows.withColumns({"first_us": F.unix_micros("first_ts"), "last_us": F.unix_micros("last_ts")}).drop("first_ts", "last_ts")


@query("SELECT session_id, round, max(seq) AS seq, arg_max(coalesce(text, chr(0)), seq) AS text FROM rounds WHERE type = 'final_answer' AND round > 0 GROUP BY 1, 2")
def final_answer_per_round(spark: SparkSession, d: str) -> DataFrame:
    return sessions.final_answers(_events(spark, d)).withColumn("text", F.coalesce("text", F.lit("\x00")))


@query("""WITH c AS (SELECT session_id, call_id, seq, name FROM log WHERE type = 'tool_call' AND coalesce(name NOT IN ('save_note', 'register_citation', 'request_clarification', 'stop', 'escalate_to_oracle'), true)),
r AS (SELECT session_id, call_id, seq AS rseq, truncated FROM log WHERE type = 'tool_result')
SELECT session_id, call_id, seq, name, (SELECT min(rseq) FROM r WHERE r.session_id = c.session_id AND r.call_id = c.call_id AND rseq > c.seq) AS result_seq FROM c""")
def call_result_pairing(spark: SparkSession, d: str) -> DataFrame:
    return sessions.paired_calls(_events(spark, d)).select("session_id", "call_id", "seq", "name", "result_seq")


@query("""SELECT session_id, seq, name, row_number() OVER (PARTITION BY session_id, name, list_sort(list_transform(json_keys(args), lambda k: k || '=' || json_extract(args, '$."' || k || '"'))) ORDER BY seq) AS ordinal FROM log WHERE type = 'tool_call'""")
def repeated_call_results(spark: SparkSession, d: str) -> DataFrame:
    return sessions.call_ordinals(_events(spark, d))


@query("SELECT session_id, seq, type, total, total > 10 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS k, count(*) OVER (PARTITION BY session_id) AS total FROM log) WHERE k <= 10")
def tail_events(spark: SparkSession, d: str) -> DataFrame:
    return sessions.last_rows(sessions.log(_events(spark, d), "type"), 10)


@query("""WITH s AS (SELECT session_id, seq, type, count(*) FILTER (type = 'tool_result') OVER (PARTITION BY session_id ORDER BY seq) AS island FROM log WHERE type IN ('error', 'tool_result'))
SELECT session_id, min(seq) AS first_seq, count(*) AS length, count(*) >= 3 AS nudged, count(*) > 3 AS aborted FROM s WHERE type = 'error' GROUP BY session_id, island""")
def error_streaks(spark: SparkSession, d: str) -> DataFrame:
    return sessions.error_streaks(_events(spark, d))


@query("SELECT DISTINCT session_id, turn FROM log WHERE turn > 0 AND turn % 3 = 0")
def iteration_nudges(spark: SparkSession, d: str) -> DataFrame:
    return sessions.iteration_nudges(_events(spark, d))


@query("SELECT session_id, seq, role, total, total > 3 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS k, count(*) OVER (PARTITION BY session_id) AS total FROM turns) WHERE k <= 3")
def keep_recent_turns(spark: SparkSession, d: str) -> DataFrame:
    return sessions.last_rows(sessions.turns(_events(spark, d)).select("session_id", "seq", "role"), 3)


@query("SELECT session_id, seq, json_extract_string(args, '$.text') AS note FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS k FROM log WHERE type = 'tool_call' AND name = 'save_note') WHERE k <= 20")
def recent_notes(spark: SparkSession, d: str) -> DataFrame:
    """The newest 20 notes that the agent of each session has saved."""
    return sessions.recent_notes(_events(spark, d))


@query("SELECT session_id, seq, message FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS k FROM log WHERE type = 'steering') WHERE k <= 20")
def recent_steering(spark: SparkSession, d: str) -> DataFrame:
    """The newest 20 messages of each session that the user left for the agent."""
    notes = sessions.log(_events(spark, d), "type", "message").filter("type = 'steering'").select("session_id", "seq", "message")
    return sessions.last_rows(notes, 20).select("session_id", "seq", "message")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS k FROM turns), o AS (SELECT * FROM r WHERE k > 3),
a AS (SELECT session_id, string_agg(role || ':' || n, ',' ORDER BY role || ':' || n) AS roles, sum(n)::BIGINT AS n FROM (SELECT session_id, role, count(*) AS n FROM o GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT session_id, string_agg(name || ':' || n, ',' ORDER BY name || ':' || n) AS tools FROM (SELECT session_id, name, count(*) AS n FROM o WHERE name IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT session_id, n AS compacted, 'compacted ' || n || ' prior turn(s) | roles=' || roles || CASE WHEN tools IS NULL THEN '' ELSE ' | tools=' || tools END AS digest FROM a LEFT JOIN b USING (session_id)""")
def history_digest(spark: SparkSession, d: str) -> DataFrame:
    return sessions.history_digest(_events(spark, d))


@query("SELECT session_id, seq, role FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS k FROM turns) WHERE k <= 3 UNION ALL SELECT session_id, -1, 'digest' FROM turns GROUP BY session_id HAVING count(*) > 3")
def compacted_histories(spark: SparkSession, d: str) -> DataFrame:
    """Histories with a digest in the place of all but their last turns."""
    return sessions.compacted(_events(spark, d)).select("session_id", "seq", "role")


@query("""WITH u AS (SELECT session_id, seq, sum(ceil(length(content) / 4))  OVER (PARTITION BY session_id ORDER BY seq) AS used FROM turns)
SELECT session_id, seq, used::BIGINT AS used, round(used / 4000, 6) AS pressure, (CASE WHEN used / 4000 >= 0.95 THEN 3 WHEN used / 4000 >= 0.9 THEN 2 WHEN used / 4000 >= 0.8 THEN 1 ELSE 0 END)::INT AS tier FROM u""")
def context_pressure_tiers(spark: SparkSession, d: str) -> DataFrame:
    return sessions.context_pressure(_events(spark, d), 4000)


@query("SELECT session_id || '-fork' AS session_id, session_id AS parent_id, seq, type, round FROM rounds WHERE round < 3 AND session_id IN (SELECT session_id FROM rounds WHERE round >= 3)")
def fork_prefix(spark: SparkSession, d: str) -> DataFrame:
    return sessions.fork(_events(spark, d), 3, "-fork")


@query("""SELECT session_id, round, turn, CASE WHEN count(*) FILTER (type = 'tool_call') > 0 THEN 'calls' ELSE 'final' END AS action, count(*) FILTER (type = 'tool_call') AS calls, coalesce(string_agg(coalesce(call_id, '') || ':' || coalesce(name, ''), ',' ORDER BY seq) FILTER (type = 'tool_call'), '') AS batch,
  CASE WHEN count(*) FILTER (type = 'tool_call') = 0 THEN arg_min(text, seq) FILTER (type = 'final_answer') END AS text FROM rounds WHERE round > 0 GROUP BY 1, 2, 3 HAVING count(*) FILTER (type IN ('tool_call', 'final_answer')) > 0""")
def action_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = sessions.action_batches(_events(spark, d))
    return rows.withColumn("batch", F.array_join(F.transform("batch", lambda c: F.concat(F.coalesce(c["call_id"], F.lit("")), F.lit(":"), F.coalesce(c["name"], F.lit("")))), ","))


_PAIRED = """calls AS (SELECT session_id, call_id, seq, name, '{' || array_to_string(list_transform(list_sort(json_keys(args)), lambda k: '"' || k || '":' || json_extract(args, '$."' || k || '"')), ',') || '}' AS args_key FROM log WHERE type = 'tool_call' AND coalesce(name NOT IN ('save_note', 'register_citation', 'request_clarification', 'stop', 'escalate_to_oracle'), true)),
asked AS (SELECT *, row_number() OVER (PARTITION BY session_id, name, args_key ORDER BY seq) AS ordinal, (SELECT min(r.seq) FROM log r WHERE r.type = 'tool_result' AND r.session_id = calls.session_id AND r.call_id = calls.call_id AND r.seq > calls.seq) AS own FROM calls),
queue AS (SELECT session_id, name, args_key, own AS result_seq, row_number() OVER (PARTITION BY session_id, name, args_key ORDER BY own) AS ordinal FROM asked WHERE own IS NOT NULL)"""


@query(f"""WITH {_PAIRED} SELECT a.session_id, a.seq, a.name, a.ordinal, q.result_seq, r.result FROM asked a LEFT JOIN queue q ON q.session_id = a.session_id AND q.name IS NOT DISTINCT FROM a.name AND q.args_key IS NOT DISTINCT FROM a.args_key AND q.ordinal = a.ordinal LEFT JOIN log r ON r.session_id = a.session_id AND r.seq = q.result_seq""")
def recorded_results(spark: SparkSession, d: str) -> DataFrame:
    """What each call takes when its session is played again."""
    return replay.recorded_results(_events(spark, d)).drop("args_key")


@query("SELECT session_id, seq, role, name, round, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS position FROM turns JOIN (SELECT session_id, seq, round FROM rounds) USING (session_id, seq)")
def replayed_history(spark: SparkSession, d: str) -> DataFrame:
    return replay.replayed(_events(spark, d)).history.select("session_id", "seq", "role", "name", "round", "position")


@query("SELECT session_id, max(round) AS rounds, count(*) AS events, count(*) FILTER (type = 'error') AS errors, max(seq) AS last_seq, CASE WHEN max(round) = 0 THEN 'no user query: the session cannot be rebuilt' END AS error FROM rounds GROUP BY 1")
def replayed_sessions(spark: SparkSession, d: str) -> DataFrame:
    return replay.replayed(_events(spark, d)).sessions


@query("SELECT session_id, round, seq, mode, message, row_number() OVER (PARTITION BY session_id, round ORDER BY seq) AS position FROM rounds WHERE type = 'steering'")
def steering_order(spark: SparkSession, d: str) -> DataFrame:
    return replay.steered(_events(spark, d))


@query("""SELECT session_id, seq, CASE WHEN role = 'tool' THEN 'user' ELSE role END AS role, CASE WHEN role = 'tool' THEN 'tool_result' WHEN args IS NOT NULL THEN 'tool_use' ELSE 'text' END AS kind, CASE WHEN role = 'tool' OR args IS NOT NULL THEN coalesce(call_id, '') END AS id, CASE WHEN role <> 'tool' AND args IS NOT NULL THEN args END AS input, CASE WHEN role = 'tool' OR args IS NULL THEN content END AS text
FROM turns JOIN (SELECT session_id, seq, call_id, CASE WHEN type = 'tool_call' THEN args END AS args FROM log) USING (session_id, seq)""")
def provider_messages(spark: SparkSession, d: str) -> DataFrame:
    calls = sessions.log(_events(spark, d), "type", "call_id", "args").select("session_id", "seq", "call_id", F.when(F.col("type") == "tool_call", F.col("args")).alias("args"))
    rows = replay.messages(sessions.turns(_events(spark, d)).join(calls, ["session_id", "seq"]))
    return rows.select("session_id", "seq", "role", F.inline("blocks")).select("session_id", "seq", "role", "kind", "id", "input", "text")


@query("""SELECT session_id, seq, concat_ws(' · ', CASE WHEN coalesce(trim(json_extract_string(args, '$.query')), '') <> '' THEN '"' || json_extract_string(args, '$.query') || '"' WHEN coalesce(trim(json_extract_string(args, '$.path')), '') <> '' THEN '"' || json_extract_string(args, '$.path') || '"' END, 'limit=' || json_extract_string(args, '$.limit')) AS line FROM log WHERE type = 'tool_call' AND len(list_filter(json_keys(args), lambda k: k NOT IN ('query', 'path', 'limit'))) = 0""")
def call_lines(spark: SparkSession, d: str) -> DataFrame:
    """Tool calls as users see them."""
    rows = sessions.log(_events(spark, d), "type", "args").filter("type = 'tool_call'").filter(F.size(F.array_except(F.json_object_keys("args"), F.array(F.lit("query"), F.lit("path"), F.lit("limit")))) == 0)
    return rows.select("session_id", "seq", markup.call_line(F.col("args")).alias("line"))


@query("SELECT DISTINCT session_id, regexp_full_match(session_id, '[A-Za-z0-9_-]+') AS valid FROM session_meta")
def session_id_validity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "session_meta").select("session_id", sessions.valid_id(F.col("session_id")).alias("valid")).distinct()


@query("""WITH ids AS (SELECT DISTINCT session_id FROM session_meta WHERE session_id IS NOT NULL), p AS (SELECT session_id AS prefix FROM ids UNION SELECT session_id[1:len(session_id) // 2 + 1] FROM ids UNION SELECT 'no such session'),
m AS (SELECT prefix, count(session_id) AS n, min(session_id) AS one, bool_or(session_id = prefix) AS exact FROM p LEFT JOIN ids ON starts_with(session_id, prefix) GROUP BY 1)
SELECT prefix, CASE WHEN exact THEN prefix WHEN n = 1 THEN one END AS session_id, CASE WHEN n = 0 THEN 'no match' WHEN n > 1 AND NOT exact THEN 'ambiguous' END AS error FROM m""")
def session_prefix(spark: SparkSession, d: str) -> DataFrame:
    """What whole ids, the first halves of ids and one id of nobody resolve to."""
    ids = table(spark, d, "session_meta").select("session_id").distinct().filter("session_id is not null")
    asked = ids.select(F.col("session_id").alias("prefix")).unionByName(ids.select(F.expr("substring(session_id, 1, int(length(session_id) / 2) + 1)").alias("prefix"))).unionByName(spark.createDataFrame([("no such session",)], "prefix string"))
    return store.resolved_prefixes(ids, asked)


@query("SELECT DISTINCT session_id, created, CASE WHEN contains(created, 'T') THEN replace(created, 'T', ' ')[1:16] ELSE created END AS shown FROM session_meta")
def session_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "session_meta").select("session_id", "created", sessions.shown_time(F.col("created")).alias("shown")).distinct()


@query()
def event_lines(spark: SparkSession, d: str) -> DataFrame:
    """The log as JSON lines."""
    return readers.event_lines(sessions.log(_events(spark, d)))


@query("""WITH o AS (SELECT session_id, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM log GROUP BY 1),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY try_cast(last_updated AS timestamptz) DESC NULLS LAST, schema_version DESC, coalesce(event_count, -1) DESC, coalesce(parent_id, '') DESC) AS k FROM session_meta WHERE schema_version IN (1, 2)) WHERE k = 1)
SELECT session_id, parent_id, coalesce(event_count, n)::BIGINT AS event_count, k IS NULL AS rebuilt, epoch_us(lo) AS created_us, epoch_us(hi) AS updated_us FROM o LEFT JOIN s USING (session_id)""")
def session_meta_rebuild(spark: SparkSession, d: str) -> DataFrame:
    rows = sessions.rebuilt_meta(table(spark, d, "session_meta"), _events(spark, d))
    return rows.select("session_id", "parent_id", "event_count", "rebuilt", F.unix_micros("created").alias("created_us"), F.unix_micros("last_updated").alias("updated_us"))


@query("SELECT session_id, round, source, count(*) AS citations FROM rounds WHERE type = 'citation' GROUP BY 1, 2, 3")
def round_citations(spark: SparkSession, d: str) -> DataFrame:
    return sessions.with_rounds(_events(spark, d), "type", "source").filter("type = 'citation'").groupBy("session_id", "round", "source").agg(F.count("*").alias("citations"))


@query("SELECT coalesce(type, 'none') AS type, coalesce(type IN ('user_query', 'status', 'tool_call', 'tool_result', 'citation', 'clarification', 'final_answer', 'error', 'compaction', 'oracle', 'steering'), false) AS known, count(*) AS n FROM agent_events GROUP BY 1, 2")
def event_types(spark: SparkSession, d: str) -> DataFrame:
    """Rows by type, and whether the type is one; readers put rows of unknown types aside."""
    known = F.coalesce(F.col("type").isin(sessions.TYPES), F.lit(False))
    return _events(spark, d).groupBy(F.coalesce("type", F.lit("none")).alias("type"), known.alias("known")).agg(F.count("*").alias("n"))


@query("""SELECT session_id, seq, 'event: ' || type || E'\\ndata: {"type":"' || type || '","seq":' || seq || ',"session_id":"' || session_id || '"' || CASE WHEN turn IS NULL THEN '' ELSE ',"turn":' || turn END || CASE WHEN name IS NULL THEN '' ELSE ',"name":"' || name || '"' END || CASE WHEN call_id IS NULL THEN '' ELSE ',"call_id":"' || call_id || '"' END
  || CASE WHEN truncated IS NULL THEN '' ELSE ',"truncated":' || truncated END || CASE WHEN level IS NULL THEN '' ELSE ',"level":' || level END || '}' AS frame FROM log WHERE type IS NOT NULL""")
def sse_frames(spark: SparkSession, d: str) -> DataFrame:
    """The log as a server sends it, here with the fields that need no escapes."""
    return readers.frames(sessions.log(_events(spark, d), "type", "turn", "name", "call_id", "truncated", "level"))


@query("SELECT session_id, seq, json_extract_string(args, '$.path') AS field_path, json_extract_string(args, '$.query') AS field_query, array_to_string(list_sort(json_keys(args)), ',') AS available_keys, array_to_string(list_filter(['path', 'query', 'limit'], lambda x: NOT list_contains(json_keys(args), x)), ',') AS missing_keys FROM log WHERE type = 'tool_call'")
def json_field_projection(spark: SparkSession, d: str) -> DataFrame:
    from spindrift.operators.files import json_fields

    rows = sessions.log(_events(spark, d)).filter("type = 'tool_call'").select("session_id", "seq", "args")
    return json_fields(rows, "args", ["path", "query", "limit"]).drop("args", "field_limit")


@query("SELECT k AS key, count(*) AS n FROM (SELECT unnest(json_keys(args)) AS k FROM log WHERE type = 'tool_call') GROUP BY 1")
def json_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = sessions.log(_events(spark, d)).filter("type = 'tool_call'").select(F.explode(F.json_object_keys("args")).alias("key"))
    return rows.groupBy("key").agg(F.count("*").alias("n"))


#: Characters of a text as an ASCII JSON string, in SQL.
_JSON_SIZE = r"""(length({0}) + 2 + length(regexp_replace({0}, '[^"\\\n\r\t\x08\x0c]', '', 'g')) + 5 * length(regexp_replace({0}, '[\x20-\x7f\n\r\t\x08\x0c]', '', 'g')) + 6 * length(regexp_replace({0}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"""


@query(f"SELECT row_id, CASE WHEN {_JSON_SIZE.format('text')} > 200 THEN text[1:185] || '... [truncated]' ELSE text END AS text FROM log WHERE type = 'final_answer' AND text IS NOT NULL")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return sessions.log(_events(spark, d), "type", "text", "row_id").filter("type = 'final_answer' and text is not null").select("row_id", truncation.truncated_text(F.col("text"), 200).alias("text"))


@query(f"""SELECT session_id, seq, CASE WHEN 24 + length(json_extract(result, '$.total')) + {_JSON_SIZE.format("json_extract_string(result, '$.content')")} > 120
  THEN '{{"_truncated": true, "_original_keys": ["content", "total"], "available_keys": ["content"], "total": ' || json_extract(result, '$.total') || '}}'
  ELSE '{{"content": ' || json_extract(result, '$.content') || ', "total": ' || json_extract(result, '$.total') || '}}' END AS result FROM log WHERE type = 'tool_result'""")
def truncate_json(spark: SparkSession, d: str) -> DataFrame:
    """Results of a text and a number; the budget leaves both or the number."""
    rows = sessions.log(_events(spark, d), "type", "result").filter("type = 'tool_result'")
    return rows.select("session_id", "seq", truncation.truncated_json(F.col("result"), 120).alias("result"))


@query("""WITH h AS (SELECT epoch_us(ts) // 3600000000 AS hour, type, count(*) AS n FROM agent_events WHERE ts IS NOT NULL GROUP BY 1, 2) SELECT hour, type, n FROM h""")
def events_per_hour(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).filter("ts is not null").groupBy(F.floor(F.unix_micros("ts") / 3_600_000_000).alias("hour"), "type").agg(F.count("*").alias("n"))


@query()  # its SQL needs the families' recursive part, see oracle.py
def fork_tree(spark: SparkSession, d: str) -> DataFrame:
    """The forest of forked sessions, with the order of siblings; sessions without a known parent and cycles' nodes are roots of their own."""
    meta = table(spark, d, "session_meta")
    nodes = hierarchy.hierarchies(hierarchy.known_links(hierarchy.current_rows(meta)))
    created = meta.groupBy(hierarchy.trimmed(F.col("session_id")).alias("id")).agg(F.min("created").alias("created"))
    return hierarchy.fork_forest(nodes.join(created, "id")).select("id", "parent", "root", "depth", "subtree", "sibling")


@query("""SELECT session_id, seq, CASE WHEN NOT json_valid(result) THEN 'compacted-result (opaque)' ELSE 'compacted-result ' || CASE json_type(result) WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'str' ELSE 'int' END END AS stub FROM log WHERE type = 'tool_result' AND result IS NOT NULL""")
def compacted_results(spark: SparkSession, d: str) -> DataFrame:
    rows = sessions.log(_events(spark, d)).filter("type = 'tool_result' and result is not null")
    return rows.select("session_id", "seq", artifacts.compacted_stub(F.col("result")).alias("stub"))


@query("""SELECT session_id, seq, CASE WHEN s IS NULL THEN CASE WHEN truncated THEN 'truncated' ELSE 'ok' END ELSE CASE WHEN s < 1024 THEN s || ' B' ELSE printf('%.1f KB', s / 1024) END || CASE WHEN truncated THEN ' · truncated' ELSE '' END END AS line
FROM (SELECT *, octet_length(encode(json_extract_string(result, '$.content'))) AS s FROM log WHERE type = 'tool_result')""")
def result_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = sessions.log(_events(spark, d)).filter("type = 'tool_result'")
    return rows.select("session_id", "seq", artifacts.result_line(F.col("result"), F.col("truncated")).alias("line"))


#: What a tool call's arguments may hold.
CALL_ARGS = artifacts.Payload("args.json", {"limit": "int", "path": "str", "query": "str"}, ("limit",))


@query("""SELECT session_id, seq, concat_ws('; ', CASE WHEN NOT list_contains(json_keys(args), 'limit') THEN 'args.json misses limit' END,
  CASE WHEN json_type(args, '$.limit') NOT IN ('UBIGINT', 'BIGINT', 'BOOLEAN', 'NULL') THEN 'args.json field limit: expected integer, got ' || lower(replace(replace(json_type(args, '$.limit'), 'VARCHAR', 'STRING'), 'DOUBLE', 'DECIMAL')) END,
  CASE WHEN json_type(args, '$.path') NOT IN ('VARCHAR', 'NULL') THEN 'args.json field path: expected string' END, CASE WHEN json_type(args, '$.query') NOT IN ('VARCHAR', 'NULL') THEN 'args.json field query: expected string' END) AS errors
FROM log WHERE type = 'tool_call' AND args IS NOT NULL""")
def validate_payloads(spark: SparkSession, d: str) -> DataFrame:
    rows = sessions.log(_events(spark, d)).filter("type = 'tool_call' and args is not null")
    return rows.select("session_id", "seq", F.array_join(artifacts.payload_errors(F.col("args"), CALL_ARGS), "; ").alias("errors"))
