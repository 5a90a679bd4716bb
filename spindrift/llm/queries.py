"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.decoding import decoded
from spindrift.llm import contamination, conversations, language, packing, pii, splitting, truncation
from spindrift.runtime import Workspace, table


def pii_records(spark: SparkSession, d: str) -> DataFrame:
    """(origin, rec_id, text) of all payloads and all questions of users."""
    raw = table(spark, d, "loaded_documents").select(F.lit("raw").alias("origin"), F.col("load_id").alias("rec_id"), decoded(F.col("raw"), F.col("content_type")).alias("text"))
    asked = table(spark, d, "agent_events").filter("type = 'user_query'").select(F.lit("query").alias("origin"), F.col("row_id").alias("rec_id"), F.col("query").alias("text"))
    return raw.unionByName(asked).filter("text is not null and text != ''")


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts, decoded once, with placeholders for what names persons and how to reach them."""
    records, _ = Workspace(spark, "texts").keep(pii_records(spark, d))
    return pii.redacted(records, pii.session_key(spark))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_redacted(spark, d).select("origin", "rec_id", F.explode("kinds").alias("kind"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "model_actions")).filter("cut").select("action_id", "source")


def p2_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.source_rates(table(spark, d, "model_actions"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_documents(table(spark, d, "loaded_documents"), table(spark, d, "section_specs"))
    return pieces.filter("pieces > 1 and piece = 0").select("load_id", "spec_name")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_documents(table(spark, d, "loaded_documents"), table(spark, d, "section_specs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.verdicts(table(spark, d, "agent_events")).filter("reason is not null")


def p5_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "agent_events"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), table(spark, d, "context_windows"))


def p6_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the packing, model by model: every text is whole or in all its pieces, no bin holds more than its size, only texts over the capacity are in pieces."""
    docs, windows = table(spark, d, "documents"), table(spark, d, "context_windows")
    return packing.checked(packing.packed(docs, windows), windows)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaks(table(spark, d, "documents"), table(spark, d, "eval_cases")).select("doc_id", "case_id").distinct()


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaks(table(spark, d, "documents"), table(spark, d, "eval_cases"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(language.languages(table(spark, d, "documents")))


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p2_found, p2_sources, p4_found, p4_pieces, p5_found, p5_conversations, p6_packed, p6_checked, p7_found, p7_leaks, p8_found, p8_languages)}

_STEPS = r"""
steps AS (
  SELECT session_id, seq, min(type) AS type, min(turn) AS turn, min(query) AS query, min(question) AS question, min(text) AS text,
         count(DISTINCT row(type, turn, query, question, text)) > 1 AS torn
  FROM agent_events WHERE session_id IS NOT NULL AND seq IS NOT NULL GROUP BY session_id, seq),
marked AS (
  SELECT *, coalesce(type = 'user_query', false) AS usr, coalesce(type IN ('final_answer', 'clarification'), false) AS ans,
         CASE WHEN type = 'user_query' AND regexp_matches(query, '[\p{L}\p{N}]') THEN 'ask'
              WHEN type = 'final_answer' AND regexp_matches(text, '[\p{L}\p{N}]') THEN 'reply'
              WHEN type = 'clarification' AND regexp_matches(question, '[\p{L}\p{N}]') THEN 'reply' END AS mark
  FROM steps),
runs AS (
  SELECT *, max(turn) OVER w AS top, count(*) FILTER (usr) OVER w AS users,
         last_value(mark IGNORE NULLS) OVER w AS before,
         first_value(mark IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
  FROM marked WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
verdict AS (
  SELECT session_id,
         CASE WHEN count(*) FILTER (mark = 'ask') = 0 THEN 'empty'
              WHEN bool_or(torn OR coalesce(turn < top, false) OR (ans AND coalesce(users, 0) = 0)) THEN 'broken'
              WHEN bool_or(mark = 'ask' AND coalesce(after, 'ask') = 'ask') THEN 'missing_reply' END AS reason
  FROM runs GROUP BY session_id)
"""

ORACLE = {
    "p5_found": f"WITH {_STEPS} SELECT session_id, reason FROM verdict WHERE reason IS NOT NULL",
    "p5_conversations": f"""WITH {_STEPS}
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS position, seq, turn,
       CASE WHEN type = 'user_query' THEN 'user' ELSE 'assistant' END AS role,
       CASE type WHEN 'user_query' THEN query WHEN 'clarification' THEN question ELSE text END AS text
FROM marked WHERE type IN ('user_query', 'clarification', 'final_answer')
  AND regexp_matches(CASE type WHEN 'user_query' THEN query WHEN 'clarification' THEN question ELSE text END, '[\\p{{L}}\\p{{N}}]')
  AND session_id IN (SELECT session_id FROM verdict WHERE reason IS NULL)""",
    "p7_found": r"""
WITH items AS (SELECT case_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM (SELECT case_id, unnest([passage, query]) AS t FROM eval_cases)),
runs AS (SELECT DISTINCT case_id, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT case_id, w, unnest(range(1, len(w) - 10)) AS i FROM items)),
texts AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
held AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM texts))
SELECT DISTINCT doc_id, case_id FROM held JOIN runs USING (run)""",
    "p6_checked": """
SELECT model, (SELECT count(*) FROM documents WHERE text <> '') AS texts, 0::BIGINT AS overfull, 0::BIGINT AS needless_pieces, 0::BIGINT AS incomplete FROM (SELECT DISTINCT model FROM context_windows WHERE capacity_tokens > 0)""",
    "p7_leaks": r"""
WITH items AS (SELECT case_id, unnest(['passage', 'query']) AS field, unnest([regexp_extract_all(lower(passage), '[\p{L}\p{N}]+'), regexp_extract_all(lower(query), '[\p{L}\p{N}]+')]) AS w FROM eval_cases),
runs AS (SELECT case_id, field, len(w) AS size, i AS place, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - 10)) AS i FROM items)),
texts AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
held AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM texts)),
hits AS (SELECT doc_id, case_id, field, size, place FROM held JOIN runs USING (run)),
places AS (SELECT doc_id, case_id, field, count(DISTINCT p) AS covered FROM (SELECT *, unnest(range(place, place + 12)) AS p FROM hits) GROUP BY 1, 2, 3)
SELECT doc_id, case_id, field, count(*)::INT AS items, any_value(covered)::INT AS covered, any_value(covered) / any_value(size) AS share FROM hits JOIN places USING (doc_id, case_id, field) GROUP BY 1, 2, 3""",
}
