"""Held-out passages in training text, by a prefix-filtered set join.

Items are the runs of `words` words of each case. The words of an item are ordered by how many documents hold them, and
the rarest is the item's prefix: a document that contains the item has that word, so only the places of such words are
looked at. The item's offset from the word gives the place where it would begin, which must lie within the document,
and the whole window is compared word by word. Document frequencies are counted over the whole corpus; they decide the
order in which words are tried and never whether an item is.

Cases are a table throughout: their items are numbered and written, and frequencies, prefixes and the cases an item
belongs to come from joins. What is broadcast are the distinct items, in blocks of a bounded number, each met by every
document; documents leave a block's scan as (document, item) pairs that are hits already.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.runtime import Workspace, spread

WORDS = re.compile(r"[^\W_]+")
#: Distinct items in one broadcast block, and rows of (item, case) up to which that side of the last join is broadcast.
BLOCK_ITEMS, BROADCAST_ROWS = 400_000, 1_000_000
#: Parts that the hits of one item are dealt to where the cases are not broadcast, as one passage may be in very many documents.
SALTS = 16


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, without case; the one normalisation of documents and cases alike."""
    return WORDS.findall(text.casefold()) if text else []


def document_frequencies(docs: DataFrame, vocabulary: Iterable[str], text: str = "text") -> DataFrame:
    """(word, df) for the words of the vocabulary, over all documents; words in none are left out. Words are those of words_of()."""
    held = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = Counter()
        for frame in frames:
            for t in frame[text]:
                n.update(held.value.intersection(words_of(t)))
        yield pd.DataFrame(list(n.items()), columns=["word", "df"])

    each = spread(docs.select(text).filter(F.col(text).isNotNull())).mapInPandas(run, "word string, df long")
    return each.groupBy("word").agg(F.sum("df").alias("df"))


def case_items(cases: DataFrame, words: int, fields: tuple[str, ...]) -> DataFrame:
    """(case_id, field, version, size, at, item): the runs of `words` words of each case's fields, as words joined by spaces, with their place and the field's number of words. `version` tells different texts of one case apart."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for case, *texts in frame[["case_id", *fields]].itertuples(index=False, name=None):
                for f, t in zip(fields, texts):
                    ws = words_of(t)
                    body = " ".join(ws)
                    out += [(case, f, body, len(ws), at, " ".join(ws[at : at + words])) for at in range(len(ws) - words + 1)]
            yield pd.DataFrame(out, columns=["case_id", "field", "version", "size", "at", "item"])

    rows = cases.select(F.col("case_id").cast("string"), *fields).mapInPandas(run, "case_id string, field string, version string, size int, at int, item string")
    return rows.withColumn("version", F.xxhash64("version")).distinct()


def _prefixes(items: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """items(no, item) with `word` and `off`: each item's rarest word and its offset; of equally rare ones the first."""
    each = items.select("no", "item", F.posexplode(F.split("item", " ")).alias("off", "word"))
    vocabulary = [r.word for r in each.select("word").distinct().collect()]  # of one block
    seen = document_frequencies(docs, vocabulary, text)
    ranked = each.join(F.broadcast(seen), "word", "left")  # at most the vocabulary
    rank = F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "off")
    return ranked.groupBy("no", "item").agg(F.min(rank).alias("r")).select("no", "item", "r.word", "r.off")


def _hits(docs: DataFrame, prefixes: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, no) of the items of one block that a document holds, each once."""
    index: dict[str, dict[int, dict[str, int]]] = defaultdict(lambda: defaultdict(dict))
    for no, item, word, off in prefixes.toPandas().itertuples(index=False, name=None):  # of one block
        index[word][off][item] = no
    held = docs.sparkSession.sparkContext.broadcast({w: dict(t) for w, t in index.items()})
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = held.value
        for frame in frames:
            out = []
            for d, t in zip(frame[doc_id], frame[text]):
                ws = words_of(t)
                last = len(ws) - words
                if last < 0:
                    continue
                found: set[int] = set()
                for p, w in enumerate(ws):
                    if w in table:
                        for off, items in table[w].items():
                            if 0 <= (s := p - off) <= last and (no := items.get(" ".join(ws[s : s + words]))) is not None:
                                found.add(no)
                out += [(d, no) for no in found]
            yield pd.DataFrame(out, columns=[doc_id, "no"])

    return spread(docs.select(doc_id, text).filter(F.col(text).isNotNull())).mapInPandas(run, f"{doc_id} {kind}, no long")


def _covered(places: Column, words: int) -> Column:
    """How many words lie within runs that begin at these places."""
    steps = F.zip_with(F.slice(places, 1, F.size(places) - 1), F.slice(places, 2, F.size(places)), lambda a, b: F.least(b - a, F.lit(words)))
    return (F.aggregate(steps, F.lit(0), lambda x, y: x + y) + words).cast("int")


def leaks(docs: DataFrame, cases: DataFrame, words: int = 12, fields: tuple[str, ...] = ("passage", "query"), block_items: int = BLOCK_ITEMS, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document, case and field with a shared run of `words` words: doc_id, case_id, field, items (shared runs of that length), covered (words of the field within them) and share (of the field's words).

    Null and short texts share nothing. Cases that repeat a text are all reported; equal rows of the same case count
    once, and of different texts of one case the one with most shared runs. Without any case the result is empty.
    """
    ws = Workspace(docs.sparkSession, "leaks")
    own, _ = ws.keep(case_items(cases, words, fields))
    numbered, _ = ws.keep(own.select("item").distinct().withColumn("no", F.monotonically_increasing_id()))  # written, so that the numbers stay
    blocks = max(1, -(-numbered.count() // block_items))
    hits = None
    for k in range(blocks):
        block = numbered.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        found = _hits(docs, _prefixes(block, docs, text), words, doc_id, text)
        hits = found if hits is None else hits.unionByName(found)
    told = own.join(numbered, "item").drop("item")
    if own.count() <= broadcast_rows:
        rows = hits.join(F.broadcast(told), "no")
    else:
        salted = told.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = hits.withColumn("_salt", F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int")).join(salted, ["no", "_salt"])
    # a group has no more rows than the case's text has runs
    one = rows.groupBy(doc_id, "case_id", "field", "version").agg(F.sort_array(F.collect_set("at")).alias("places"), F.max("size").alias("size"))
    one = one.select(doc_id, "case_id", "field", F.size("places").alias("items"), _covered(F.col("places"), words).alias("covered"), "size")
    best = one.groupBy(doc_id, "case_id", "field").agg(F.max(F.struct("items", "covered", (F.col("covered") / F.col("size")).alias("share"))).alias("b"))
    return best.select(doc_id, "case_id", "field", "b.items", "b.covered", "b.share")
