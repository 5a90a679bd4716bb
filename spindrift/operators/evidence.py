"""Citations, calls, verdicts of evaluation cases, token use and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import canonical_json, numeric_claims, tenths
from spindrift.operators.sessions import log

#: Factors under which a stated figure may differ from a cited one.
FACTORS = (1.0, 1e3, 1e6, 1e9, 1e12)


def canonical(payload: Column) -> Column:
    """A JSON object as `k=v` joined by `&`, keys sorted; true, false and null as True, False and None, nested values as canonical JSON. Null, empty objects and what is no object give an empty text."""
    return F.coalesce(F.array_join(F.transform(_pairs(payload), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&"), F.lit(""))


def _shown(v: Column) -> Column:
    """A JSON value as a text: true, false and null as True, False and None, texts bare, all else as canonical JSON."""
    kind = F.schema_of_variant(v)
    plain = F.when(kind == "BOOLEAN", F.initcap(F.to_json(v))).when(kind == "STRING", F.variant_get(v, "$", "string"))
    return F.when(v.isNull() | (kind == "VOID"), "None").otherwise(plain.otherwise(F.to_json(v)))


def _pairs(payload: Column) -> Column:
    """The entries of a JSON object as texts (k, v), by key."""
    held = F.map_entries(F.from_json(canonical_json(payload), "map<string,variant>"))
    return F.array_sort(F.transform(held, lambda e: F.struct(e["key"].alias("k"), _shown(e["value"]).alias("v"))))


def locator_line(locator: Column) -> Column:
    """`k=v` by sorted key, joined by points, without nulls and empty texts."""
    kept = F.filter(_pairs(locator), lambda p: ~p["v"].isin("", "None"))
    return F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), " · ")


def citation_id(source: Column, locator: Column) -> Column:
    where = canonical(locator)
    return F.when(where == "", source).otherwise(F.concat(source, F.lit("#"), where))


def citations(events: DataFrame) -> DataFrame:
    """Each session's citations, of equal ones (source, locator, value) the first."""
    rows = log(events, "type", "source", "locator", "value").filter("type = 'citation'").withColumn("cite", citation_id(F.col("source"), F.col("locator")))
    return rows.groupBy("session_id", "cite", "value").agg(F.min("seq").alias("seq"), F.count("*").alias("times"))


def registered(events: DataFrame) -> DataFrame:
    """(session_id, seq, source, locator, value, cite) of the citations that agents registered by a call, of equal ones of a session the first."""
    calls = log(events, "type", "name", "args").filter("type = 'tool_call' and name = 'register_citation'")
    rows = calls.select("session_id", "seq", *(F.get_json_object("args", f"$.{c}").alias(c) for c in ("source", "locator", "value"))).withColumn("cite", citation_id(F.col("source"), F.col("locator")))
    first = rows.groupBy("session_id", "cite", "value").agg(F.min(F.struct("seq", "source", "locator")).alias("f"))
    return first.select("session_id", "f.seq", "f.source", "f.locator", "value", "cite")


def call_keys(events: DataFrame) -> DataFrame:
    """Each tool call with the canonical JSON of its arguments: calls with equal name and arguments have equal keys."""
    return log(events, "type", "name", "args").filter("type = 'tool_call'").select("session_id", "seq", "name", canonical_json(F.col("args")).alias("args_key"))


def cache_stats(events: DataFrame) -> DataFrame:
    """Hits, misses and size of a cache keyed by (tool, arguments) per session, as if every tool were cacheable."""
    keys = call_keys(events).groupBy("session_id", "name", "args_key").agg(F.count("*").alias("n"))
    return keys.groupBy("session_id").agg((F.sum("n") - F.count("*")).alias("hits"), F.count("*").alias("misses"), F.count("*").alias("size"))


def six_digits(x: Column) -> Column:
    """A number with six significant digits and no trailing zeros, with an exponent below 1e-4 and from 1e6."""
    size = F.floor(F.log10(F.abs(x)))
    size = F.when(F.round(F.abs(x) / F.pow(F.lit(10.0), size), 5) >= 10, size + 1).otherwise(size)
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = F.coalesce(*(F.when(size == k, bare(F.format_string(f"%.{5 - k}f", x))) for k in range(-4, 6)))
    scaled = F.concat(bare(F.format_string("%.5f", x / F.pow(F.lit(10.0), size))), F.lit("e"), F.when(size < 0, "-").otherwise("+"), F.lpad(F.abs(size).cast("string"), 2, "0"))
    return F.when(x == 0, "0").otherwise(F.coalesce(plain, scaled))


#: What a verdict is of: a case with one run, or each of a case's runs.
CASE, RUN = ("case_id",), ("case_id", "session_id")


def _verdict(by: tuple[str, ...], check: str, status: Column, detail: Column) -> list[Column]:
    return [*by, F.lit(check).alias("check"), status.alias("status"), F.coalesce(detail, F.lit("")).alias("detail")]


def repeated_calls(run_of: DataFrame, events: DataFrame, by: tuple[str, ...] = CASE) -> DataFrame:
    """Fails a case with an identical call made twice; names the most frequent, of equal ones the first seen."""
    calls = call_keys(events).groupBy("session_id", "name", "args_key").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    worst = calls.groupBy("session_id").agg(F.max_by(F.struct("name", "n"), F.struct("n", -F.col("first"))).alias("w")).select("session_id", "w.*")
    rows = run_of.join(worst, "session_id", "left")
    status = F.when(F.col("n").isNull(), "na").when(F.col("n") >= 2, "fail").otherwise("pass")
    detail = F.when(F.col("n").isNull(), "no tool calls").when(F.col("n") >= 2, F.format_string("'%s' called %d× with identical args", "name", "n"))
    return rows.select(_verdict(by, "repeated_calls", status, detail))


def coverage(cases: DataFrame, run_of: DataFrame, events: DataFrame, by: tuple[str, ...] = CASE) -> DataFrame:
    """Fails a case with an expected source that no call or result names, where a path covers what lies below it and what it lies below."""
    want = cases.select("case_id", F.explode("expected_citations").alias("c")).select("case_id", F.substring_index("c", "#", 1).alias("source")).distinct()
    rows = log(events, "type", "args", "result")
    asked = rows.filter("type = 'tool_call'").select("session_id", F.explode(F.array(*(F.get_json_object("args", f"$.{k}") for k in ("path", "file_path", "entity")))).alias("path"))
    got = rows.filter("type = 'tool_result'").select("session_id", F.get_json_object("result", "$.path").alias("path"))
    seen = asked.unionByName(got).filter("path is not null and path != ''").distinct().join(run_of, "session_id").select(*by, F.rtrim(F.col("path"), F.lit("/")).alias("path"))
    p, s = F.col("path"), F.rtrim(F.col("source"), F.lit("/"))
    held = (p == s) | s.startswith(F.concat(p, F.lit("/"))) | p.startswith(F.concat(s, F.lit("/")))
    due = want.join(run_of.select(*by), "case_id")
    covered = due.join(seen, [*by]).filter(held).select(*by, "source").distinct()
    open_ = due.join(covered, [*by, "source"], "left_anti").groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list("source")), ", ").alias("missing"))
    rows = run_of.join(want.select("case_id", F.lit(True).alias("wanted")).distinct(), "case_id", "left").join(open_, [*by], "left")
    status = F.when(F.col("wanted").isNull(), "na").when(F.col("missing").isNotNull(), "fail").otherwise("pass")
    detail = F.when(F.col("wanted").isNull(), "no expected citations").when(F.col("missing").isNotNull(), F.concat(F.lit("uncovered: "), "missing"))
    return rows.select(_verdict(by, "coverage", status, detail))


def answers(run_of: DataFrame, events: DataFrame) -> DataFrame:
    """(case_id, session_id, answer): the last final answer of each run, or null."""
    last = log(events, "type", "text").filter("type = 'final_answer'").groupBy("session_id").agg(F.max_by("text", "seq").alias("answer"), F.lit(True).alias("answered"))
    return run_of.join(last, "session_id", "left")


def faithfulness(run_of: DataFrame, events: DataFrame, by: tuple[str, ...] = CASE) -> DataFrame:
    """Fails a case whose answer states a figure that no citation of the run holds, under any of the FACTORS either way, with a relative tolerance of 1e-6. The detail names the first figure not held."""
    said = answers(run_of, events).select("case_id", "session_id", F.posexplode_outer(numeric_claims(F.coalesce("answer", F.lit("")))).alias("at", "claim"))
    cited = log(events, "type", "value").filter("type = 'citation'").select("session_id", F.explode(numeric_claims(F.btrim(F.coalesce("value", F.lit("")), F.lit('"')))).alias("number")).distinct()
    factor = F.explode(F.array(*(F.lit(f) for f in FACTORS)))
    scaled = cited.withColumn("f", factor)
    a, c, f = F.col("claim"), F.col("number"), F.col("f")
    close = lambda x, y: F.abs(x - y) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(x), F.abs(y))
    claims = said.filter("claim is not null")
    held = claims.join(scaled, "session_id").filter(close(a, c * f) | close(a * f, c)).select(*by, "at").distinct().withColumn("ok", F.lit(True))
    open_ = F.col("claim").isNotNull() & F.col("ok").isNull()
    sums = said.join(held, [*by, "at"], "left").groupBy(*by).agg(F.count("claim").alias("claims"), F.min_by("claim", F.when(open_, F.col("at"))).alias("open"))
    status = F.when(F.col("claims") == 0, "na").when(F.col("open").isNotNull(), "fail").otherwise("pass")
    shown = F.when(F.col("open") == F.floor("open"), F.format_string("%.0f", "open")).otherwise(six_digits(F.col("open")))
    detail = F.when(F.col("claims") == 0, "no numeric claims").when(F.col("open").isNotNull(), F.format_string("claim %s not cited", shown))
    return sums.select(_verdict(by, "faithfulness", status, detail))


def entity_resolution(cases: DataFrame, run_of: DataFrame, events: DataFrame, by: tuple[str, ...] = CASE) -> DataFrame:
    """Of cases that expect a clarification, whether there was one."""
    asked = log(events, "type").filter("type = 'clarification'").select("session_id", F.lit(True).alias("asked")).distinct()
    rows = run_of.join(cases.select("case_id", "expected_clarification"), "case_id").join(asked, "session_id", "left")
    due = F.coalesce("expected_clarification", F.lit(False))
    return rows.select(_verdict(by, "entity_resolution", F.when(~due, "na").when(F.col("asked"), "pass").otherwise("fail"), F.lit("")))


def expected_clarification(cases: DataFrame, run_of: DataFrame, events: DataFrame, by: tuple[str, ...] = CASE) -> DataFrame:
    """Of cases that say whether a clarification is due, whether the run agrees."""
    asked = log(events, "type").filter("type = 'clarification'").select("session_id", F.lit(True).alias("asked")).distinct()
    rows = run_of.join(cases.filter("expected_clarification is not null").select("case_id", "expected_clarification"), "case_id").join(asked, "session_id", "left")
    did = F.coalesce("asked", F.lit(False))
    detail = F.when(did & F.col("expected_clarification"), "clarified").when(F.col("expected_clarification") & ~did, "expected a clarification").when(did, "a direct answer was expected")
    return rows.select(_verdict(by, "expected_clarification", F.when(did == F.col("expected_clarification"), "pass").otherwise("fail"), detail))


def forbidden_phrases(cases: DataFrame, run_of: DataFrame, events: DataFrame, by: tuple[str, ...] = CASE) -> DataFrame:
    """Of cases with forbidden phrases, whether the answer holds one, without case."""
    rows = answers(run_of, events).join(cases.filter("size(forbidden_phrases) > 0").select("case_id", "forbidden_phrases"), "case_id")
    hits = F.filter("forbidden_phrases", lambda p: F.contains(F.lower(F.coalesce("answer", F.lit(""))), F.lower(p)))
    status = F.when(F.col("answered").isNull(), "na").when(F.size(hits) > 0, "fail").otherwise("pass")
    detail = F.when(F.col("answered").isNull(), "no final answer to scan").when(F.size(hits) > 0, F.concat(F.lit("answer contains "), F.array_join(hits, ", ")))
    return rows.select(_verdict(by, "forbidden_phrases", status, detail))


def latency_cost(cases: DataFrame, measured: DataFrame, by: tuple[str, ...] = CASE) -> DataFrame:
    """measured(`by`, prompt, completion, total, seconds): fails a case over its budget of tokens, then of seconds."""
    rows = cases.select("case_id", "max_tokens", "max_seconds").join(measured, "case_id")
    tokens = F.when(F.coalesce("total", F.lit(0)) > 0, F.col("total")).otherwise(F.coalesce("prompt", F.lit(0)) + F.coalesce("completion", F.lit(0)))
    over, late = tokens > F.col("max_tokens"), F.col("seconds") > F.col("max_seconds")
    label = F.when(tokens >= 1000, F.concat(tenths(tokens, 1000), F.lit("k tok"))).otherwise(F.format_string("%d tok", tokens))
    detail = F.when(over, F.format_string("%d tok exceeds max_tokens %d", tokens, F.col("max_tokens"))).when(late, F.format_string("%.1fs exceeds max_seconds %.1f", "seconds", "max_seconds")).otherwise(F.concat(label, F.lit(" · "), F.format_string("%.1fs", "seconds")))
    return rows.select(_verdict(by, "latency_cost", F.when(F.coalesce(over, F.lit(False)) | F.coalesce(late, F.lit(False)), "fail").otherwise("pass"), detail))


def columns_of(results: DataFrame, order: str | None = None) -> list[str]:
    """The names of the checks as columns of a scorecard, in the order first seen by a numbered column, else by name."""
    first = F.min(order) if order else F.min("check")
    return [r.check for r in results.groupBy("check").agg(first.alias("first")).orderBy("first", "check").collect()]


def scorecard(results: DataFrame, checks: list[str] | None = None, by: tuple[str, ...] = CASE) -> DataFrame:
    """A row per case (or run) with a cell for each check, and whether it passes: no check fails. Without `checks`, the ones there are."""
    checks = columns_of(results) if checks is None else list(dict.fromkeys(checks))
    cell = F.when(F.col("status") == "pass", F.concat(F.lit("✓"), F.when(F.col("detail") != "", F.concat(F.lit(" ("), "detail", F.lit(")"))).otherwise("")))
    cell = cell.when(F.col("status") == "na", "n/a").otherwise(F.concat(F.lit("✗"), F.when(F.col("detail") != "", F.concat(F.lit(" — "), "detail")).otherwise("")))
    cells = (F.coalesce(F.max(F.when(F.col("check") == c, cell)), F.lit("—")).alias(c) for c in checks)
    return results.groupBy(*by).agg(*cells, F.bool_and(F.col("status") != "fail").alias("passed"))


def suite_counts(results: DataFrame, by: tuple[str, ...] = CASE) -> DataFrame:
    own = results.groupBy(*by).agg(F.bool_and(F.col("status") != "fail").alias("passed"))
    return own.agg(F.count("*").alias("runs"), F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"))


def chosen_cases(cases: DataFrame, only: list[str] | None) -> DataFrame:
    """The cases with these ids; none chosen gives all, an id that no case has is an error."""
    if not only:
        return cases
    rows = cases.filter(F.col("case_id").isin(only))
    unknown = set(only) - {r.case_id for r in rows.select("case_id").distinct().collect()}  # at most as many as were asked for
    if unknown:
        raise ValueError(f"unknown cases: {', '.join(sorted(unknown))}")
    return rows


def usage_totals(actions: DataFrame, *by: str) -> DataFrame:
    """All six counts of token use, summed."""
    return actions.groupBy(*by).agg(*(F.sum(F.coalesce(F.col(f"usage.{f}"), F.lit(0))).alias(f) for f in ("prompt", "completion", "cached", "cache_read", "cache_write", "total")))


def priced(usage: DataFrame, prices: DataFrame, unknown: float | None = None) -> DataFrame:
    """usage(model, counts) with the cost in dollars by prices(price_model, input, output, read, write) per million tokens.

    A model is priced by its own row, else by the longest price_model it begins with; `unknown` is the cost of others.
    """
    models = usage.select("model").filter("model is not null").distinct()
    prefix = models.select("model", F.explode(F.transform(F.sequence(F.lit(1), F.length("model")), lambda i: F.substring("model", F.lit(1), i))).alias("price_model"))
    best = prefix.join(prices, "price_model").groupBy("model").agg(F.max_by(F.struct("price_model", "input", "output", "read", "write"), F.length("price_model")).alias("p"))
    cost = (F.col("prompt") * F.col("p.input") + F.col("completion") * F.col("p.output") + F.col("cache_read") * F.col("p.read") + F.col("cache_write") * F.col("p.write")) / 1e6
    return usage.join(best, "model", "left").select(*usage.columns, F.col("p.price_model").alias("price_model"), F.round(F.coalesce(cost, F.lit(unknown)), 6).alias("cost"))
