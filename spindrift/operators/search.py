"""Ranked and filtered retrieval over entries (id, text, attributes).

A query scans the texts once and keeps, of the entries with one of its words, length and counts; what BM25 needs of the
corpus is counted over all entries in passing, before any filter. Many queries at once share the scan, and tasks hand on
their best entries only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from spindrift.functions.text import snippet, term_count, token_count, tokens
from spindrift.runtime import Workspace, spread

K1, B = 1.5, 0.75
TOP_K, TOP_K_MAX = 5, 20


def clamp_k(k: int) -> int:
    return TOP_K if k <= 0 else min(k, TOP_K_MAX)


def query_terms(query: str) -> list[str]:
    """Lower-case words of the query, repeats kept; a query without a word is an error."""
    words = re.findall(r"\w+", query.lower())
    if not words:
        raise ValueError("blank query")
    return words


def matches(filters: dict[str, str | list[str]] | None) -> Column:
    """All keys must match; a list matches any of its values; a null attribute matches nothing. Empty lists and other types are errors."""
    cond = F.lit(True)
    for key, want in (filters or {}).items():
        values = want if isinstance(want, list) else [want]
        if not values or not all(isinstance(v, str) for v in values):
            raise ValueError(f"filter {key!r} must be a string or a list of strings")
        cond = cond & F.coalesce(F.col(key).isin(values), F.lit(False))
    return cond


def _scored(entries: DataFrame, query: str) -> DataFrame:
    words = query_terms(query)
    distinct = list(dict.fromkeys(words))
    low = F.lower("text")
    own = spread(entries.withColumn("text", F.coalesce("text", F.lit("")))).withColumn("_len", token_count(F.col("text")))
    own = own.select("*", *(term_count(low, w).alias(f"_tf{i}") for i, w in enumerate(distinct))).drop("text")
    tf = [F.col(f"_tf{i}") for i in range(len(distinct))]
    seen = Observation()
    counted = own.observe(seen, F.count(F.lit(1)).alias("n"), F.avg("_len").alias("avg"), *(F.count_if(c > 0).alias(f"df{i}") for i, c in enumerate(tf)))
    kept, _ = Workspace(entries.sparkSession, "bm25").keep(counted.filter(F.greatest(*tf, F.lit(0)) > 0))  # hits only; the others are counted in passing
    stats = seen.get
    score = F.lit(0.0)
    for w in words:
        i = distinct.index(w)
        n, df = stats["n"], stats[f"df{i}"]
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        score = score + F.when(tf[i] > 0, F.lit(idf) * tf[i] * (K1 + 1) / (tf[i] + K1 * (1 - B + B * F.col("_len") / F.lit(stats["avg"] or 1.0)))).otherwise(0.0)
    return kept.withColumn("score", F.round(score, 6)).drop("_len", *(f"_tf{i}" for i in range(len(distinct))))


def bm25(entries: DataFrame, query: str, filters: dict | None = None, k: int = TOP_K, attributes: tuple[str, ...] = ()) -> DataFrame:
    """entries(id, text, attributes): the k best (id, score, attributes), by score and then id.

    Scores have six decimals; ties are ordered by id. Counts, lengths and frequencies are of all entries, the filter
    only chooses among the scored. Null texts are empty. Only entries with a positive score are hits.
    """
    rows = _scored(entries.select("id", "text", *attributes), query).filter(matches(filters) & (F.col("score") > 0))
    return rows.select("id", "score", *attributes).orderBy(F.desc("score"), "id").limit(clamp_k(k))


def with_snippets(hits: DataFrame, entries: DataFrame, query: str) -> DataFrame:
    """Hits with the text around the earliest query word."""
    return hits.join(entries.select("id", "text"), "id").withColumn("snippet", snippet(F.col("text"), query_terms(query))).drop("text")


def filtered_search(entries: DataFrame, filters: dict, k: int = TOP_K) -> DataFrame:
    """The first k entries by id that match, each with score 0; no filter lists all."""
    return entries.filter(matches(filters)).withColumn("score", F.lit(0.0)).orderBy("id").limit(clamp_k(k))


@dataclass
class Index:
    """postings(id, term, tf), lengths(id, len), terms(term, df), corpus(n, avg_len)."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    corpus: DataFrame


def build_index(entries: DataFrame) -> Index:
    """The inverted index of entries(id, text). Word counts are summed within each entry before they are shuffled."""
    words = spread(entries.select("id", "text")).select("id", tokens(F.col("text")).alias("words"))
    lengths = words.select("id", F.size("words").cast("long").alias("len"))
    postings = words.select("id", F.explode("words").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    return Index(postings, lengths, terms, lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")))


#: Queries answered in one block.
BLOCK_QUERIES = 2_000


def bm25_batch(entries: DataFrame, queries: DataFrame, k: int = TOP_K, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """queries(query_id, query) against entries(id, text): the k best entries of each, (query_id, id, score, rank). Repeated words of a query count as often as they occur; a query without words has no hit.

    Each block of queries takes the texts apart once, keeps of each entry its length and the counts of the block's
    words, and counts entries and lengths in passing. Tasks score what is kept and hand on k entries for a query at most.
    """
    each = queries.select("query_id", tokens(F.col("query")).alias("words"))
    k, parts, block = clamp_k(k), [], []
    for row in each.toLocalIterator():
        block.append((row.query_id, row.words))
        if len(block) == block_queries:
            parts.append(_answered(entries, block, k, queries))
            block = []
    if block or not parts:
        parts.append(_answered(entries, block, k, queries))
    best = reduce(lambda a, b: a.unionByName(b), parts)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))  # of k rows a task
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def _answered(entries: DataFrame, block: list[tuple], k: int, queries: DataFrame) -> DataFrame:
    """The k best of every task for each query of a block."""
    spark = entries.sparkSession
    kinds = entries.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kinds[1]}, id {kinds[0]}, score double"
    vocabulary = sorted({w for _, ws in block for w in ws})
    if not vocabulary:
        return spark.createDataFrame([], schema)
    words = spread(entries.select("id", "text")).select("id", tokens(F.col("text")).alias("words"))
    own = words.select("id", F.size("words").cast("long").alias("len"), F.filter("words", lambda w: w.isin(vocabulary)).alias("held"))
    seen = Observation()
    counted = own.observe(seen, F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    kept, _ = Workspace(spark, "bm25").keep(counted.filter(F.size("held") > 0))
    df = {r.term: r.df for r in kept.select(F.explode(F.array_distinct("held")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}  # at most the vocabulary
    n, avg = seen.get["n"], seen.get["avg"] or 1.0
    asked: dict[str, tuple[list[int], list[float]]] = {}
    for q, (_, ws) in enumerate(block):
        for w, times in Counter(ws).items():
            if w in df:
                at, weight = asked.setdefault(w, ([], []))
                at.append(q)
                weight.append(times * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)))
    held = spark.sparkContext.broadcast(({w: (np.array(at), np.array(weight)) for w, (at, weight) in asked.items()}, [q for q, _ in block]))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, names = held.value
        best: dict[int, list[tuple]] = {}
        for frame in frames:
            scores = np.zeros((len(frame), len(names)))
            for row, (size, ws) in enumerate(zip(frame["len"], frame["held"])):
                norm = K1 * (1 - B + B * size / avg)
                for w, tf in Counter(ws).items():
                    at, weight = table[w]
                    scores[row, at] += weight * (tf * (K1 + 1) / (tf + norm))
            scores = np.round(scores, 6)
            ids = list(frame["id"])
            for q in np.flatnonzero(scores.any(axis=0)):
                column = scores[:, q]
                rows = np.flatnonzero(column > 0)
                if len(rows) > k:  # all that are as good as the k-th
                    rows = rows[column[rows] >= -np.partition(-column[rows], k - 1)[k - 1]]
                best[q] = sorted(best.get(q, []) + [(-column[r], ids[r]) for r in rows])[:k]
        out = [(names[q], i, -s) for q, found in best.items() for s, i in found]
        yield pd.DataFrame(out, columns=["query_id", "id", "score"])

    return kept.mapInPandas(run, schema)


def index_stats(entries: DataFrame, section: str) -> DataFrame:
    """One row: entries, vocabulary, average length (2 decimals), names of sections, first five ids, bytes of text."""
    words = spread(entries).select("id", "text", section, tokens(F.col("text")).alias("words"))
    size = words.agg(
        F.count("*").alias("docs"), F.round(F.avg(F.size("words")), 2).alias("avg_len"),
        F.array_join(F.sort_array(F.collect_set(section)), ",").alias("sections"),
        F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"),
    )
    vocabulary = words.select(F.explode("words").alias("w")).distinct().agg(F.count("*").alias("vocabulary"))
    first = entries.select("id").orderBy("id").limit(5).agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("first_ids"))
    return size.join(F.broadcast(vocabulary)).join(F.broadcast(first))
