"""Filling fixed-capacity containers with texts: variable-capacity best fit.

Texts are measured in tokens of a public tokenizer. For each model the permitted sequence lengths are all capacities up
to its own; texts over its capacity, and only these, are cut into pieces of the capacity. Items are dealt to groups of a
bounded number of tokens by a hash, each group is packed by best fit with decreasing sizes, opening the bin size that
leaves the least room to be expected, and in the end every bin is given the least permitted size that holds its
contents. What lies in badly filled bins of all groups is dealt out and packed once more.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.runtime import Workspace, spread

#: A folder that is there on every worker, or a file shipped to them (see shipped()).
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Tokens dealt to one group.
GROUP_TOKENS = 4_000_000
#: Bins filled below this share of their size are packed once more.
WELL_FILLED = 0.97
#: Context windows are a short list; every text is packed for each.
MAX_WINDOWS = 1000

# Fixed value: the pattern the vocabulary's own texts are split by.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The tokenizer, without special tokens."""
    import base64

    import tiktoken

    at = os.path.join(folder, vocabulary)
    if not os.path.exists(at):  # sent along by shipped()
        from pyspark import SparkFiles

        at = SparkFiles.get(vocabulary)
    with open(at, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def shipped(spark: SparkSession, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> None:
    """Sends the vocabulary to all workers, which need no folder of their own then."""
    spark.sparkContext.addFile(os.path.join(folder, vocabulary))


def token_counts(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens) of the texts that have any; null and empty ones have none."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shipped(docs.sparkSession, folder, vocabulary)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, vocabulary)
        for frame in frames:
            sizes = [len(x) for x in enc.encode_ordinary_batch(list(frame[text]), num_threads=1)]
            yield pd.DataFrame({doc_id: frame[doc_id], "tokens": sizes})

    return spread(docs.select(doc_id, text).filter(F.col(text).isNotNull() & (F.col(text) != ""))).mapInPandas(run, f"{doc_id} {kind}, tokens long")


class _Left:
    """Tokens of the items not yet packed, by size, for the expectation of what a bin can still take."""

    def __init__(self, sizes: list[int]) -> None:
        self.top = max(sizes, default=1)
        self.tree = [0] * (self.top + 1)
        for s in sizes:
            self.add(s, s)

    def add(self, size: int, tokens: int) -> None:
        while size <= self.top:
            self.tree[size] += tokens
            size += size & -size

    def upto(self, size: int) -> int:
        size, total = min(size, self.top), 0
        while size > 0:
            total += self.tree[size]
            size &= size - 1
        return total


def best_fit(sizes: list[int], permitted: list[int]) -> tuple[list[int], list[int]]:
    """Bin number of each item and the final size of each bin.

    Items come in decreasing size, each into the open bin whose remaining space is least, else into a new bin of the
    permitted size with the least expected cost: its size less what the items still to come can be expected to fill of
    it, per token of content. Bins are downsized to their contents in the end.
    """
    permitted = sorted(permitted)
    left = _Left(sizes)
    bins: list[list[int]] = []  # size, content
    room: list[tuple[int, int]] = []  # remaining space and bin, ascending
    where = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        s = sizes[i]
        left.add(s, -s)
        at = bisect_left(room, (s, -1))
        if at < len(room):
            gap, b = room.pop(at)
            gap -= s
        else:
            def cost(c: int) -> tuple[float, int]:
                content = s + min(c - s, left.upto(c - s))
                return (c / content, -c)

            size = min((c for c in permitted if c >= s), key=cost)
            b, gap = len(bins), size - s
            bins.append([size, 0])
        bins[b][1] += s
        where[i] = b
        if gap:
            insort(room, (gap, b))
    return where, [next(c for c in permitted if c >= content) for _, content in bins]


def items(counts: DataFrame, windows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(model, capacity, permitted, doc_id, piece, pieces, start, tokens): every text for every model, in pieces only where it exceeds the model's capacity.

    Windows with a null or non-positive capacity are left out; models that share a name and capacity count once.
    """
    own = sorted({(r.model, r.capacity_tokens) for r in windows.filter("capacity_tokens > 0").limit(MAX_WINDOWS + 1).collect()}, key=str)
    if len(own) > MAX_WINDOWS:
        raise ValueError(f"more than {MAX_WINDOWS} context windows")
    each = [
        F.struct(F.lit(m).alias("model"), F.lit(c).cast("int").alias("capacity"), F.array(*(F.lit(x).cast("int") for x in sorted({y for _, y in own if y <= c}))).alias("permitted"))
        for m, c in own
    ]
    none = F.array().cast("array<struct<model:string,capacity:int,permitted:array<int>>>")
    rows = counts.filter("tokens > 0").withColumn("w", F.explode(F.array(*each) if each else none)).select(doc_id, "tokens", "w.*")
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / F.col("capacity")).cast("int")))
    rows = rows.withColumn("pieces", F.ceil(F.col("tokens") / F.col("capacity")).cast("int")).withColumn("piece", piece)
    start = F.col("piece").cast("long") * F.col("capacity")
    return rows.select("model", "capacity", "permitted", doc_id, "piece", "pieces", start.alias("start"), F.least(F.col("capacity").cast("long"), F.col("tokens") - start).alias("size"))


def _packed(rows: DataFrame, groups: DataFrame, stage: str, doc_id: str) -> DataFrame:
    salt = F.pmod(F.xxhash64(doc_id, "piece", F.lit(stage)), F.col("groups"))
    dealt = rows.join(groups, "model").withColumn("grp", salt).drop("groups")
    kind = rows.schema[doc_id].dataType.simpleString()

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([doc_id, "piece", "start"], kind="stable").reset_index(drop=True)
        where, sizes = best_fit([int(x) for x in frame["size"]], [int(x) for x in frame["permitted"].iloc[0]])
        content = [0] * len(sizes)
        for b, s in zip(where, frame["size"]):
            content[b] += int(s)
        out = frame.drop(columns=["grp"])
        out["bin_id"] = [f"{key[0]}/{stage}{key[1]}/{b}" for b in where]
        out["bin_size"] = [sizes[b] for b in where]
        out["content"] = [content[b] for b in where]
        return out

    schema = f"model string, capacity int, permitted array<int>, {doc_id} {kind}, piece int, pieces int, start long, size long, bin_id string, bin_size int, content long"
    return dealt.groupBy("model", "grp").applyInPandas(run, schema)


def packed(docs: DataFrame, windows: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, group_tokens: int = GROUP_TOKENS, doc_id: str = "doc_id") -> DataFrame:
    """Every non-empty text in the bins of every model: model, bin_id, bin_size, doc_id, piece, pieces, start (token), tokens.

    The tokens of a bin's rows add up to bin_size or less; bin_size is a permitted length of the model.
    """
    ws = Workspace(docs.sparkSession, "packing")
    rows, _ = ws.keep(items(token_counts(docs, folder, vocabulary, doc_id), windows, doc_id))
    per = rows.groupBy("model").agg(F.ceil(F.sum("size") / group_tokens).cast("long").alias("groups"))
    first, _ = ws.keep(_packed(rows, per, "a", doc_id))
    good = F.col("content") >= WELL_FILLED * F.col("bin_size")
    rest = first.filter(~good).select(rows.columns)
    again = _packed(rest, rest.groupBy("model").agg(F.ceil(F.sum("size") / group_tokens).cast("long").alias("groups")), "b", doc_id)
    cols = ["model", "bin_id", "bin_size", doc_id, "piece", "pieces", "start", F.col("size").alias("tokens")]
    return first.filter(good).select(cols).unionByName(again.select(cols))


def checked(bins: DataFrame, windows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """packed() held against its promises, a row for each model: texts, bins with more tokens than their size or of a size that is no window, texts in pieces that fit whole, texts whose pieces are not all there once."""
    sizes = windows.filter("capacity_tokens > 0").select(F.col("capacity_tokens").alias("bin_size")).distinct().withColumn("known", F.lit(True))
    most = windows.filter("capacity_tokens > 0").groupBy("model").agg(F.max("capacity_tokens").alias("capacity"))
    full = bins.groupBy("model", "bin_id", "bin_size").agg(F.sum("tokens").alias("content")).join(F.broadcast(sizes), "bin_size", "left")
    over = full.groupBy("model").agg(F.count_if((F.col("content") > F.col("bin_size")) | F.col("known").isNull()).alias("overfull"))
    each = bins.groupBy("model", doc_id).agg(F.count("*").alias("n"), F.max("pieces").alias("pieces"), F.count_distinct("piece").alias("different"), F.sum("tokens").alias("tokens"), F.max(F.col("start") + F.col("tokens")).alias("end")).join(F.broadcast(most), "model")
    texts = each.groupBy("model").agg(
        F.count("*").alias("texts"), F.count_if((F.col("n") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("needless_pieces"),
        F.count_if((F.col("n") != F.col("pieces")) | (F.col("n") != F.col("different")) | (F.col("tokens") != F.col("end"))).alias("incomplete"),
    )
    return texts.join(over, "model").select("model", "texts", "overfull", "needless_pieces", "incomplete")
