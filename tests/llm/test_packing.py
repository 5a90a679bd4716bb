import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import packing as P

needs_files = pytest.mark.skipif(not os.path.exists(os.path.join(P.TOKENIZERS, P.VOCABULARY)), reason="no tokenizer files")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.sets(st.sampled_from([8, 16, 32, 64]), min_size=1).map(lambda s: sorted(s | {64})))
def test_bins_hold_their_items(sizes, permitted):
    where, bins = P.best_fit(sizes, permitted)
    content = [0] * len(bins)
    for b, s in zip(where, sizes):
        content[b] += s
    assert all(0 < c <= size and size in permitted for c, size in zip(content, bins))
    for c, size in zip(content, bins):  # the least size that holds it
        assert not any(c <= p < size for p in permitted)


def test_little_space_is_left():
    rnd = random.Random(3)
    sizes = [min(8192, int(rnd.lognormvariate(5, 1)) + 1) for _ in range(5000)]
    _, bins = P.best_fit(sizes, [512, 2048, 4096, 8192])
    assert sum(sizes) / sum(bins) > 0.995
    _, bins = P.best_fit([min(s, 512) for s in sizes], [512])
    assert sum(min(s, 512) for s in sizes) / sum(bins) > 0.98


def test_items(spark, as_rows):
    counts = spark.createDataFrame([(1, 5), (2, 25), (3, 0)], "doc_id long, tokens long")
    windows = spark.createDataFrame([("s", 10), ("l", 30), ("l", 30), ("bad", None), ("zero", 0)], "model string, capacity_tokens int")
    got = as_rows(P.items(counts, windows), "model", "doc_id", "piece", "pieces", "start", "size")
    assert got == sorted([("l", 1, 0, 1, 0, 5), ("l", 2, 0, 1, 0, 25), ("s", 1, 0, 1, 0, 5), ("s", 2, 0, 3, 0, 10), ("s", 2, 1, 3, 10, 10), ("s", 2, 2, 3, 20, 5)], key=repr)
    assert P.items(counts, windows.limit(0)).count() == 0


@needs_files
def test_operator(spark):
    rows = [(i, f"Some words number {i}. " * (i % 40 + 1), "x") for i in range(300)] + [(300, None, "x"), (301, "", "x"), (302, "long words " * 5000, "x"), (5, "Again the same id.", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, model string")
    windows = spark.createDataFrame([("small", 128), ("large", 512)], "model string, capacity_tokens int")
    out = P.packed(docs, windows, group_tokens=20_000).collect()
    enc = P.encoder()
    want = sum(len(enc.encode_ordinary(t)) for _, t, _ in rows if t)
    for model, size in (("small", 128), ("large", 512)):
        mine = [r for r in out if r.model == model]
        assert sum(r.tokens for r in mine) == want
        bins = {}
        for r in mine:
            bins.setdefault((r.bin_id, r.bin_size), []).append(r.tokens)
            assert r.pieces == 1 or r.doc_id == 302 or want and r.tokens <= size
        assert all(sum(v) <= k[1] <= size for k, v in bins.items())
        assert want / sum(k[1] for k in bins) > 0.93
    assert P.packed(docs.limit(0), windows).count() == 0


def test_promises_are_checked(spark):
    windows = spark.createDataFrame([("m", 10)], "model string, capacity_tokens int")
    row = lambda bin_id, doc, piece, pieces, start, n: ("m", bin_id, 10, doc, piece, pieces, start, n)
    schema = "model string, bin_id string, bin_size int, doc_id long, piece int, pieces int, start long, tokens long"
    good = [row("a", 1, 0, 1, 0, 4), row("a", 2, 0, 1, 0, 6), row("b", 3, 0, 2, 0, 10), row("c", 3, 1, 2, 10, 3)]
    told = lambda rows: tuple(P.checked(spark.createDataFrame(rows, schema), windows).first())
    assert told(good) == ("m", 3, 0, 0, 0)
    assert told([*good, row("a", 4, 0, 1, 0, 1)]) == ("m", 4, 1, 0, 0)
    assert told([*good[:3], row("c", 5, 0, 2, 0, 3), row("c", 5, 1, 2, 3, 3)]) == ("m", 4, 0, 1, 1)
