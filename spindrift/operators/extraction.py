"""Extraction through a model: prompts, retries, answers as JSON, token use and cost, chunks, caches, reduction, afterwork."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import packed_pages, stripped, token_count
from spindrift.operators.ingestion import chunk_key, resolved_sections


class ModelError(Exception):
    """A call of a model failed for good."""


class TransientError(ModelError):
    """A failure that may not happen again: a limit of rates, a server's error, a time-out."""


class RateLimitError(TransientError):
    """Too many calls."""


class AuthError(ModelError):
    """The caller is not allowed."""


def error_of(status: Column) -> Column:
    """(error_type, recoverable) of an HTTP status; null for a success."""
    kind = F.when(status == 429, "RateLimitError").when(status.isin(401, 403), "AuthError").when((status >= 500) | (status == 408), "TransientError").when(status >= 400, "ModelError")
    return F.when(kind.isNotNull(), F.struct(kind.alias("error_type"), kind.isin("RateLimitError", "TransientError").alias("recoverable")))


class Model(Protocol):
    """The model boundary: a prompt and an input, an answer and its token counts (prompt, completion). Must be serialisable and give the same answer to the same input, as tasks can be repeated."""

    def __call__(self, prompt: str, text: str) -> tuple[str, int, int]: ...


class TokenCounter(Protocol):
    """Tokens of a text column."""

    def __call__(self, text: Column) -> Column: ...


class Summariser(Protocol):
    """What is left of the turns of a history that compaction takes away: turns(session_id, seq, role, content, name) to (session_id, digest)."""

    def __call__(self, turns: DataFrame) -> DataFrame: ...


def words_as_tokens(text: Column) -> Column:
    """The default TokenCounter: words, as ranked retrieval counts them."""
    return token_count(text)


def quarters_as_tokens(text: Column) -> Column:
    """A token for four characters."""
    return F.ceil(F.length(text) / 4).cast("long")


def backoff(attempt: int, base: float = 1.0) -> float:
    """Seconds to wait after the attempt with this number, from 0."""
    return base * 2**attempt


_FENCE = re.compile(r"\s*```(?:json|JSON)?\s*\n(?P<body>.*?)\n```\s*\Z", re.S)


def json_object(answer: str) -> dict[str, Any]:
    """The JSON object of an answer, which may stand in a fence; anything else is an error."""
    m = _FENCE.match(answer.strip())
    body = m["body"] if m else answer.strip()
    try:
        value = json.loads(body)
    except ValueError as e:
        raise ModelError(f"the answer is no JSON: {e} (it begins {body[:200]!r})") from e
    if not isinstance(value, dict):
        raise ModelError(f"the answer must be a JSON object, not {type(value).__name__}")
    return value


@dataclass(frozen=True)
class Extractor:
    """How texts are given to a model: the prompt, how often a transient failure is tried again, and what a million tokens cost."""

    model: Model
    prompt: str = ""
    retries: int = 3
    base_seconds: float = 1.0
    price_in: float = 0.0
    price_out: float = 0.0
    sleep: Callable[[float], None] = field(default=time.sleep, compare=False)

    def answer(self, text: str) -> tuple[dict[str, Any], int, int]:
        for attempt in range(self.retries + 1):
            try:
                said, n, m = self.model(self.prompt, text)
                return json_object(said), n, m
            except TransientError as e:
                if attempt == self.retries:
                    raise TransientError(f"given up after {attempt + 1} attempts: {e}") from e
                self.sleep(backoff(attempt, self.base_seconds))
        raise AssertionError

    def cost(self, prompt: Column, completion: Column) -> Column:
        return (prompt * self.price_in + completion * self.price_out) / 1e6


def answered(rows: DataFrame, extractor: Extractor, key: str, text: str) -> DataFrame:
    """(key, answer as JSON, prompt_tokens, completion_tokens, error_type, error): the model's answer to each text. Failures are rows."""
    kind = rows.schema[key].dataType.simpleString()
    names = [key, "answer", "prompt_tokens", "completion_tokens", "error_type", "error"]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, t in zip(frame[key], frame[text]):
                try:
                    value, n, m = extractor.answer(t)
                    out.append((k, json.dumps(value, ensure_ascii=False), n, m, None, None))
                except Exception as e:  # noqa: BLE001
                    out.append((k, None, 0, 0, type(e).__name__, str(e)))
            yield pd.DataFrame(out, columns=names)

    return rows.select(key, text).filter(F.col(text).isNotNull()).mapInPandas(run, f"{key} {kind}, answer string, prompt_tokens long, completion_tokens long, error_type string, error string")


def extract(docs: DataFrame, extractor: Extractor, key: str = "doc_id", text: str = "text") -> DataFrame:
    """answered() with the `cost` of each call."""
    return answered(docs, extractor, key, text).withColumn("cost", extractor.cost(F.col("prompt_tokens"), F.col("completion_tokens")))


def fragments(answers: DataFrame, specs: DataFrame, key: str, order: str = "chunk") -> DataFrame:
    """(key, order, section, fragment) of answers(key, order, answer), JSON objects of texts by section: stripped, without blank ones and without sections that no spec knows."""
    each = answers.select(key, order, F.explode(F.from_json("answer", "map<string,string>")).alias("section", "fragment")).withColumn("fragment", stripped(F.col("fragment"))).filter("fragment != ''")
    known = resolved_sections(each, specs).filter("spec is not null").select("section")
    return each.join(known, "section", "left_semi")


def map_reduce(
    docs: DataFrame, specs: DataFrame, mapper: Extractor, reducer: Callable[[DataFrame], DataFrame] | None = None, cache: DataFrame | None = None, version: str = "1",
    post_process: Callable[[DataFrame], DataFrame] | None = None, chunk_chars: int = 8000, reduce_chars: int = 80_000, key: str = "doc_id", text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Sections of documents too large for one call, and the answers to put into the cache.

    Pages are packed into chunks; each distinct chunk that the cache(key, answer) lacks is put to the mapper; the
    fragments of each section are joined in order, cut for the reduction, reduced by `reducer` (key, section, joined) to
    (key, section, content), and held to the spec's max_chars; `post_process` has the last word. The second table holds
    (key, answer) of the chunks that were answered anew.
    """
    chunks = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.posexplode(packed_pages(F.col(text), chunk_chars)).alias("chunk", "body"))
    chunks = chunks.withColumn("key", chunk_key(F.col("body"), mapper.prompt, version))
    wanted = chunks.groupBy("key").agg(F.min("body").alias("body"))
    new = wanted if cache is None else wanted.join(cache.select("key"), "key", "left_anti")
    fresh = answered(new, mapper, "key", "body").filter("answer is not null").select("key", "answer")
    answers = fresh if cache is None else fresh.unionByName(cache.select("key", "answer"))
    parts = fragments(chunks.join(answers, "key").select("doc", "chunk", "answer"), specs, "doc")
    joined = parts.groupBy("doc", "section").agg(F.sort_array(F.collect_list(F.struct("chunk", "fragment"))).alias("p"))  # of one document's section
    rows = joined.select("doc", "section", F.substring(F.array_join(F.transform("p", lambda x: x["fragment"]), "\n\n---\n\n"), 1, reduce_chars).alias("joined"))
    out = reducer(rows) if reducer else rows.withColumnRenamed("joined", "content")
    limits = resolved_sections(out, specs).join(specs.select(F.col("name").alias("spec"), "max_chars"), "spec").select("section", "max_chars")
    out = out.join(limits, "section", "left").select(F.col("doc").alias(key), "section", F.expr("CASE WHEN length(content) > max_chars THEN substring(content, 1, max_chars) ELSE content END").alias("content"))
    return (post_process(out) if post_process else out), fresh
