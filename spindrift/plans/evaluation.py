"""Queries on citations, verdicts, token use and tools, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.operators import catalog, evidence, sessions
from spindrift.operators.checks import built_in
from spindrift.plans.events import LOG
from spindrift.runtime import Workspace, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# The canonical forms in SQL: of a locator by its keys, of arguments as JSON with sorted keys (the tables nest no values).
_CANON = "array_to_string(list_transform(list_sort(json_keys({0})), lambda k: k || '=' || coalesce(json_extract_string({0}, '$.\"' || k || '\"'), 'None')), '&')"
_SORTED = "'{{' || array_to_string(list_transform(list_sort(json_keys({0})), lambda k: '\"' || k || '\":' || json_extract({0}, '$.\"' || k || '\"')), ',') || '}}'"
RUNS = f"""{LOG},
runs AS (SELECT case_id, session_id FROM (SELECT DISTINCT session_id FROM log) JOIN (SELECT case_id, row_number() OVER (ORDER BY case_id) - 1 AS k FROM eval_cases) ON k = ('0x' || md5(session_id)[1:8])::BIGINT % (SELECT count(*) FROM eval_cases)),
calls AS (SELECT session_id, seq, name, {_SORTED.format('args')} AS args_key FROM log WHERE type = 'tool_call'),
answers AS (SELECT runs.case_id, runs.session_id, f.answer, f.session_id IS NOT NULL AS answered FROM runs LEFT JOIN (SELECT session_id, (list(text ORDER BY seq DESC))[1] AS answer FROM log WHERE type = 'final_answer' GROUP BY 1) f ON f.session_id = runs.session_id)
"""


def query(sql: str | None = None, raw: bool = False):
    """Registers a query under its name, with SQL if there is some."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql if raw else "WITH " + RUNS + (sql if sql.startswith("SELECT") else ", " + sql.removeprefix("WITH "))
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "agent_events")


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_cases")


def _runs(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    """(case_id, session_id): the tables hold no runs of the cases, so every session is taken for a run of the case that its hash picks."""
    cases = _cases(spark, d).select("case_id", (F.row_number().over(Window.orderBy("case_id")) - 1).cast("bigint").alias("k"))  # a suite is a file written by hand
    k = F.conv(F.substring(F.md5("session_id"), 1, 8), 16, 10).cast("bigint") % F.lit(cases.count())
    log = sessions.log(_events(spark, d) if events is None else events, "type")
    return log.select("session_id").distinct().withColumn("k", k).join(F.broadcast(cases), "k").select("case_id", "session_id")


@query(f"SELECT session_id, seq, CASE WHEN {_CANON.format('locator')} = '' THEN source ELSE source || '#' || {_CANON.format('locator')} END AS cite FROM log WHERE type = 'citation'")
def citation_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = sessions.log(_events(spark, d)).filter("type = 'citation'")
    return rows.select("session_id", "seq", evidence.citation_id(F.col("source"), F.col("locator")).alias("cite"))


@query(f"SELECT session_id, source || '#' || {_CANON.format('locator')} AS cite, value, min(seq) AS seq, count(*) AS times FROM log WHERE type = 'citation' GROUP BY 1, 2, 3")
def citation_dedup(spark: SparkSession, d: str) -> DataFrame:
    return evidence.citations(_events(spark, d))


@query("SELECT session_id, seq, array_to_string(list_filter(list_transform(list_sort(json_keys(locator)), lambda k: CASE WHEN coalesce(json_extract_string(locator, '$.\"' || k || '\"'), '') <> '' THEN k || '=' || json_extract_string(locator, '$.\"' || k || '\"') END), lambda x: x IS NOT NULL), ' · ') AS line FROM log WHERE type = 'citation'")
def locator_lines(spark: SparkSession, d: str) -> DataFrame:
    """Locators as users see them."""
    rows = sessions.log(_events(spark, d), "type", "locator").filter("type = 'citation'")
    return rows.select("session_id", "seq", evidence.locator_line(F.col("locator")).alias("line"))


@query("SELECT session_id, seq, name, args_key FROM calls")
def call_keys(spark: SparkSession, d: str) -> DataFrame:
    return evidence.call_keys(_events(spark, d))


@query("SELECT session_id, (sum(n) - count(*))::BIGINT AS hits, count(*) AS misses, count(*) AS size FROM (SELECT session_id, name, args_key, count(*) AS n FROM calls GROUP BY 1, 2, 3) GROUP BY 1")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return evidence.cache_stats(_events(spark, d))


_REPEATED = """(WITH g AS (SELECT session_id, name, args_key, count(*) AS n, min(seq) AS first FROM calls GROUP BY 1, 2, 3), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, first) AS k FROM g) WHERE k = 1)
SELECT case_id, session_id, 'repeated_calls' AS "check", CASE WHEN n IS NULL THEN 'na' WHEN n >= 2 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN n IS NULL THEN 'no tool calls' WHEN n >= 2 THEN '''' || name || ''' called ' || n || '× with identical args' ELSE '' END AS detail FROM runs LEFT JOIN w USING (session_id))"""
_COVERAGE = """(WITH want AS (SELECT DISTINCT case_id, split_part(c, '#', 1) AS source FROM (SELECT case_id, unnest(expected_citations) AS c FROM eval_cases)),
p AS (SELECT DISTINCT case_id, session_id, rtrim(path, '/') AS path FROM (SELECT session_id, unnest([json_extract_string(args, '$.path'), json_extract_string(args, '$.file_path'), json_extract_string(args, '$.entity')]) AS path FROM log WHERE type = 'tool_call' UNION ALL SELECT session_id, json_extract_string(result, '$.path') FROM log WHERE type = 'tool_result') JOIN runs USING (session_id) WHERE path IS NOT NULL AND path <> ''),
o AS (SELECT case_id, session_id, string_agg(source, ', ' ORDER BY source) AS missing FROM want JOIN runs USING (case_id) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.case_id = want.case_id AND p.session_id = runs.session_id AND (path = rtrim(source, '/') OR starts_with(rtrim(source, '/'), path || '/') OR starts_with(path, rtrim(source, '/') || '/'))) GROUP BY 1, 2)
SELECT case_id, session_id, 'coverage' AS "check", CASE WHEN case_id NOT IN (SELECT case_id FROM want) THEN 'na' WHEN missing IS NOT NULL THEN 'fail' ELSE 'pass' END AS status, CASE WHEN case_id NOT IN (SELECT case_id FROM want) THEN 'no expected citations' WHEN missing IS NOT NULL THEN 'uncovered: ' || missing ELSE '' END AS detail FROM runs LEFT JOIN o USING (case_id, session_id))"""
_NUM = r"""list_filter(list_transform(regexp_split_to_array(regexp_replace({0}, '(?:19|20)\d{{2}}\s*[-/‒-―]\s*\d{{2,4}}', ' ', 'g'), '[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+'), lambda x: trim(x, '()[]{{}}"''.,;:!?–—-*_`#~')), lambda w: regexp_full_match(w, '[$₹€£]?(-?\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|-?\d+(?:\.\d+)?)((?i)trillion|billion|million|thousand|bn|mn|[kmbt])?%?'))"""
_NUMBERS = r"""(SELECT {0}, pos, replace(num, ',', '')::DOUBLE * CASE WHEN scale IN ('k', 'thousand') THEN 1e3 WHEN scale IN ('m', 'mn', 'million') THEN 1e6 WHEN scale IN ('b', 'bn', 'billion') THEN 1e9 WHEN scale IN ('t', 'trillion') THEN 1e12 ELSE 1 END AS v
FROM (SELECT {0}, pos, regexp_extract(w, '^[$₹€£]?(-?\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|-?\d+(?:\.\d+)?)((?i)trillion|billion|million|thousand|bn|mn|[kmbt])?%?$', 1) AS num, lower(regexp_extract(w, '^[$₹€£]?(-?\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|-?\d+(?:\.\d+)?)((?i)trillion|billion|million|thousand|bn|mn|[kmbt])?%?$', 2)) AS scale
  FROM (SELECT {0}, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (SELECT {0}, {1} AS ws FROM {2})))
WHERE NOT (scale = '' AND NOT contains(num, '.') AND replace(num, ',', '')::DOUBLE BETWEEN 1900 AND 2099))"""
_FAITHFUL = f"""(WITH claim AS {_NUMBERS.format('case_id, session_id', _NUM.format("coalesce(answer, '')"), 'answers')},
num AS (SELECT DISTINCT session_id, v FROM {_NUMBERS.format('session_id', _NUM.format("trim(coalesce(value, ''), chr(34))"), "(SELECT * FROM log WHERE type = 'citation')")}),
j AS (SELECT case_id, session_id, pos, v, EXISTS (SELECT 1 FROM num, (SELECT unnest([1.0, 1e3, 1e6, 1e9, 1e12]) AS f) WHERE num.session_id = claim.session_id AND (abs(claim.v - num.v * f) <= 1e-6 * greatest(1.0, abs(claim.v), abs(num.v * f)) OR abs(claim.v * f - num.v) <= 1e-6 * greatest(1.0, abs(claim.v * f), abs(num.v)))) AS held FROM claim),
s AS (SELECT runs.case_id, runs.session_id, count(pos) AS claims, arg_min(v, pos) FILTER (NOT held) AS open FROM runs LEFT JOIN j ON j.case_id = runs.case_id AND j.session_id = runs.session_id GROUP BY 1, 2)
SELECT case_id, session_id, 'faithfulness' AS "check", CASE WHEN claims = 0 THEN 'na' WHEN open IS NOT NULL THEN 'fail' ELSE 'pass' END AS status, CASE WHEN claims = 0 THEN 'no numeric claims' WHEN open IS NOT NULL THEN 'claim ' || CASE WHEN open = floor(open) THEN printf('%.0f', open) ELSE printf('%g', open) END || ' not cited' ELSE '' END AS detail FROM s)"""
_ENTITY = """(SELECT case_id, session_id, 'entity_resolution' AS "check", CASE WHEN NOT coalesce(expected_clarification, false) THEN 'na' WHEN session_id IN (SELECT session_id FROM log WHERE type = 'clarification') THEN 'pass' ELSE 'fail' END AS status, '' AS detail FROM runs JOIN eval_cases USING (case_id))"""
_EXPECTED = """(SELECT case_id, session_id, 'expected_clarification' AS "check", CASE WHEN did = expected_clarification THEN 'pass' ELSE 'fail' END AS status, CASE WHEN did AND expected_clarification THEN 'clarified' WHEN expected_clarification THEN 'expected a clarification' WHEN did THEN 'a direct answer was expected' ELSE '' END AS detail
FROM (SELECT case_id, session_id, expected_clarification, session_id IN (SELECT session_id FROM log WHERE type = 'clarification') AS did FROM runs JOIN eval_cases USING (case_id) WHERE expected_clarification IS NOT NULL))"""
_FORBIDDEN = """(SELECT case_id, session_id, 'forbidden_phrases' AS "check", CASE WHEN NOT answered THEN 'na' WHEN len(hits) > 0 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN NOT answered THEN 'no final answer to scan' WHEN len(hits) > 0 THEN 'answer contains ' || array_to_string(hits, ', ') ELSE '' END AS detail
FROM (SELECT case_id, session_id, answered, list_filter(forbidden_phrases, lambda p: contains(lower(coalesce(answer, '')), lower(p))) AS hits FROM answers JOIN eval_cases USING (case_id) WHERE len(forbidden_phrases) > 0))"""
_MEASURED = "(SELECT case_id, session_id, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, sum(total)::BIGINT AS total, round(count(*) * 1.5::DOUBLE, 1) AS seconds FROM (SELECT runs.case_id, runs.session_id, coalesce(usage.prompt, 0) AS prompt, coalesce(usage.completion, 0) AS completion, coalesce(usage.total, 0) AS total FROM runs JOIN model_actions a ON a.session_id = runs.session_id) GROUP BY 1, 2)"
_LATENCY = f"""(SELECT case_id, session_id, 'latency_cost' AS "check", CASE WHEN coalesce(t > max_tokens, false) OR coalesce(seconds > max_seconds, false) THEN 'fail' ELSE 'pass' END AS status,
CASE WHEN t > max_tokens THEN t || ' tok exceeds max_tokens ' || max_tokens WHEN seconds > max_seconds THEN printf('%.1fs exceeds max_seconds %.1f', seconds, max_seconds) ELSE CASE WHEN t >= 1000 THEN ((t * 10 + 500) // 1000) // 10 || '.' || ((t * 10 + 500) // 1000) % 10 || 'k tok' ELSE t || ' tok' END || ' · ' || printf('%.1fs', seconds) END AS detail
FROM (SELECT case_id, session_id, max_tokens, max_seconds, seconds, CASE WHEN total > 0 THEN total ELSE prompt + completion END AS t FROM eval_cases JOIN {_MEASURED} USING (case_id)))"""
_ALL = " UNION ALL ".join(f"SELECT * FROM {x}" for x in (_FORBIDDEN, _EXPECTED, _FAITHFUL, _COVERAGE, _REPEATED, _ENTITY, _LATENCY))
CHECKS = ["forbidden_phrases", "expected_clarification", "faithfulness", "coverage", "repeated_calls", "entity_resolution", "latency_cost"]


@query(f"SELECT * FROM {_REPEATED}")
def repeated_calls(spark: SparkSession, d: str) -> DataFrame:
    return evidence.repeated_calls(_runs(spark, d), _events(spark, d), evidence.RUN)


@query(f"SELECT * FROM {_COVERAGE}")
def coverage_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return evidence.coverage(_cases(spark, d), _runs(spark, d), _events(spark, d), evidence.RUN)


@query(f"SELECT * FROM {_FAITHFUL}")
def faithfulness_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return evidence.faithfulness(_runs(spark, d), _events(spark, d), evidence.RUN)


@query(f"SELECT * FROM {_ENTITY}")
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    return evidence.entity_resolution(_cases(spark, d), _runs(spark, d), _events(spark, d), evidence.RUN)


@query(f"SELECT * FROM {_EXPECTED}")
def expected_clarification(spark: SparkSession, d: str) -> DataFrame:
    return evidence.expected_clarification(_cases(spark, d), _runs(spark, d), _events(spark, d), evidence.RUN)


@query(f"SELECT * FROM {_FORBIDDEN}")
def forbidden_phrases(spark: SparkSession, d: str) -> DataFrame:
    return evidence.forbidden_phrases(_cases(spark, d), _runs(spark, d), _events(spark, d), evidence.RUN)


def _measured(spark: SparkSession, d: str, runs: DataFrame | None = None, by: tuple[str, ...] = evidence.CASE) -> DataFrame:
    """Token use of each run, and a second and a half for each action of the model. Actions are summed by session before they meet the runs."""
    sums = (F.sum(F.coalesce(F.col(f"usage.{c}"), F.lit(0))).alias(c) for c in ("prompt", "completion", "total"))
    used = table(spark, d, "model_actions").groupBy("session_id").agg(*sums, F.count("*").alias("n"))
    rows = (_runs(spark, d) if runs is None else runs).join(used, "session_id")
    return rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("prompt", "completion", "total")), F.round(F.sum("n") * 1.5, 1).alias("seconds"))


@query(f"SELECT * FROM {_LATENCY}")
def latency_cost_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return evidence.latency_cost(_cases(spark, d), _measured(spark, d, by=evidence.RUN), evidence.RUN)


@query(f"SELECT * FROM ({_ALL})")
def session_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The seven checks over every session of the log, a row per case, session and check. The log is put in order once, with what the checks need of it."""
    ws = Workspace(spark, "verdicts")
    needed = ("type", "name", "args", "source", "locator", "value", "text", F.get_json_object("result", "$.path").alias("path"))
    held, _ = ws.keep(sessions.log(_events(spark, d).select("row_id", "session_id", "seq", *needed)).withColumn("result", F.when(F.col("path").isNotNull(), F.to_json(F.struct("path")))).drop("path"))
    runs, _ = ws.keep(_runs(spark, d, held))
    return built_in().run(_cases(spark, d), runs, held, _measured(spark, d, runs, evidence.RUN))


_CELLS = ", ".join(f"""coalesce(max(cell) FILTER ("check" = '{c}'), '—') AS {c}""" for c in CHECKS)


@query(f"""WITH results AS ({_ALL}), cells AS (SELECT *, CASE status WHEN 'pass' THEN '✓' || CASE WHEN detail <> '' THEN ' (' || detail || ')' ELSE '' END WHEN 'na' THEN 'n/a' ELSE '✗' || CASE WHEN detail <> '' THEN ' — ' || detail ELSE '' END END AS cell FROM results)
SELECT case_id, session_id, {_CELLS}, bool_and(status <> 'fail') AS passed FROM cells GROUP BY case_id, session_id""")
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    return evidence.scorecard(session_verdicts(spark, d), CHECKS, evidence.RUN)


@query(f"WITH results AS ({_ALL}) SELECT count(*) AS runs, count(*) FILTER (passed) AS n_passed, count(*) FILTER (NOT passed) AS n_failed FROM (SELECT case_id, session_id, bool_and(status <> 'fail') AS passed FROM results GROUP BY 1, 2)")
def suite_counts(spark: SparkSession, d: str) -> DataFrame:
    return evidence.suite_counts(session_verdicts(spark, d), evidence.RUN)


@query("SELECT case_id FROM eval_cases WHERE case_id IN (SELECT min(case_id) FROM eval_cases UNION SELECT max(case_id) FROM eval_cases)", raw=True)
def case_filter(spark: SparkSession, d: str) -> DataFrame:
    """The chosen cases of a suite, here its first and last."""
    cases = _cases(spark, d)
    ends = cases.agg(F.min("case_id").alias("a"), F.max("case_id").alias("b")).first()
    return evidence.chosen_cases(cases, [x for x in ends if x is not None]).select("case_id")


_SUM = ", ".join(f"sum(coalesce(usage.{f}, 0))::BIGINT AS {f}" for f in ("prompt", "completion", "cached", "cache_read", "cache_write", "total"))


@query(f"SELECT model, {_SUM} FROM model_actions GROUP BY model", raw=True)
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    return evidence.usage_totals(table(spark, d, "model_actions"), "model")


#: Example rates; a caller gives a table of their own.
RATES = (("harbor", 1.0, 4.0, 0.1, 1.25), ("harbor-base", 2.0, 8.0, 0.2, 2.5), ("quay", 3.0, 12.0, 0.3, 3.75))


@query(f"""WITH u AS (SELECT model, {_SUM} FROM model_actions GROUP BY model), r(price_model, i, o, rd, wr) AS (VALUES {', '.join(map(str, RATES))}),
b AS (SELECT * FROM (SELECT model, r.*, row_number() OVER (PARTITION BY model ORDER BY length(price_model) DESC) AS k FROM u JOIN r ON starts_with(model, price_model)) WHERE k = 1)
SELECT u.*, price_model, round((prompt * i::DOUBLE + completion * o::DOUBLE + cache_read * rd::DOUBLE + cache_write * wr::DOUBLE) / 1e6, 6) AS cost FROM u LEFT JOIN b USING (model)""", raw=True)
def cost_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    rates = spark.createDataFrame(list(RATES), "price_model string, input double, output double, read double, write double")
    return evidence.priced(usage_totals(spark, d), rates)


_TOOLS = ", ".join(str((t.name, t.readonly, t.pseudo)) for t in catalog.TOOLS)


@query(f"""WITH t(name, readonly, pseudo) AS (VALUES {_TOOLS}) SELECT 'full' AS profile, name FROM t UNION ALL SELECT 'read_only', name FROM t WHERE readonly OR pseudo
UNION ALL SELECT 'eval', name FROM t WHERE (readonly OR pseudo) AND name NOT IN ('escalate_to_oracle', 'request_clarification')""", raw=True)
def tool_profiles(spark: SparkSession, d: str) -> DataFrame:
    return catalog.profiles(spark)


@query(f"""WITH t(name, readonly, pseudo) AS (VALUES {_TOOLS}), s AS (SELECT 'seen in the log' AS skill, name FROM agent_events WHERE type = 'tool_call' AND name IS NOT NULL GROUP BY name)
SELECT skill, name AS tool FROM s WHERE name NOT IN (SELECT name FROM t)""", raw=True)
def skills_missing_tools(spark: SparkSession, d: str) -> DataFrame:
    """Tools that are needed (here: called in the log) and that the catalog lacks."""
    need = _events(spark, d).filter("type = 'tool_call' and name is not null").select(F.lit("seen in the log").alias("skill"), F.col("name").alias("tool")).distinct()
    return catalog.missing_tools(need, catalog.tools(spark))


@query("SELECT name, count(*) AS calls, count(DISTINCT session_id) AS sessions, count(DISTINCT args_key) AS argument_sets FROM calls GROUP BY name")
def tool_usage(spark: SparkSession, d: str) -> DataFrame:
    return evidence.call_keys(_events(spark, d)).groupBy("name").agg(F.count("*").alias("calls"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("args_key").alias("argument_sets"))
