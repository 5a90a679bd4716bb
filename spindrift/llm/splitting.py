"""Splitting oversized texts at natural boundaries, by agglomerative merging.

A text is taken apart into atomic segments, each small enough by itself, at page breaks, blank lines, headings, line
ends, sentence ends, clause ends and spaces, and only where there is none of these between characters. A heap holds the
pairs of adjacent pieces; the weakest boundary is merged first, as long as the merged piece with the overlap it repeats
from the piece before stays within the limit. What remains are cuts at the strongest boundaries that the limit allows.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.decoding import decode_bytes
from spindrift.runtime import Workspace, spread

# Boundaries from strong to weak; a match ends where the cut may be made.
BOUNDARIES = (
    (7, re.compile(r"\x0c+\s*")),
    (6, re.compile(r"(?:\r\n|[\n\r])[ \t]*(?:\r\n|[\n\r])\s*(?=#{1,6} )|(?:\r\n|[\n\r])(?=#{1,6} )|</(?:section|article|table|body)>\s*")),
    (5, re.compile(r"(?:\r\n|[\n\r])[ \t]*(?:(?:\r\n|[\n\r])[ \t]*)+|</(?:p|div|li|h[1-6]|ul|ol|tr)>\s*")),
    (4, re.compile(r"\r\n|[\n\r\x0b\x85  ]|<br ?/?>\s*")),
    (3, re.compile(r"[.!?。！？…][\"”»’')\]]*(?:\s+|(?<=[。！？]))")),
    (2, re.compile(r"[;:,–—、，][ \t]+")),
    (1, re.compile(r"\s+")),
)
#: The first level that is used to form segments in any case; weaker ones only inside segments that are too large.
SENTENCE = 3
#: Distinct sections up to which their specs are broadcast, and the parts a section's rows are dealt to beyond.
BROADCAST_SECTIONS, SALTS = 100_000, 64


def _inside(text: str, start: int, end: int, room: int, levels: tuple) -> list[tuple[int, int]]:
    """Cut points (place, strength) that leave no segment of text[start:end] larger than room, the weaker levels only where needed."""
    if end - start <= room:
        return []
    if not levels:  # no natural place
        out, at = [], start
        while end - at > room:
            to = at + room
            while to > at + 1 and (unicodedata.combining(text[to]) or text[to] in "‍️" or text[to - 1] == "‍" or text[to - 1 : to + 1] == "\r\n"):
                to -= 1
            if to == at + 1:
                to = at + room
            out.append((to, 0))
            at = to
        return out
    strength, pattern = levels[0]
    cuts = [m.end() for m in pattern.finditer(text, start, end) if start < m.end() < end]
    out, at = [(c, strength) for c in cuts], start
    for c in (*cuts, end):
        out += _inside(text, at, c, room, levels[1:])
        at = c
    return sorted(out)


def segment(text: str, room: int) -> list[tuple[int, int]]:
    """Sorted cut points (place, strength): all boundaries down to sentences, and weaker ones inside segments larger than room."""
    strong: dict[int, int] = {}
    for strength, pattern in BOUNDARIES:
        if strength >= SENTENCE:
            for m in pattern.finditer(text):
                if 0 < m.end() < len(text):
                    strong.setdefault(m.end(), strength)
    places = sorted(strong)
    weak = tuple(b for b in BOUNDARIES if b[0] < SENTENCE)
    out, at = [(p, strong[p]) for p in places], 0
    for p in (*places, len(text)):
        out += _inside(text, at, p, room, weak)
        at = p
    return sorted(out)


def split_text(text: str, max_chars: int | None, overlap: int = 0) -> list[tuple[int, int, int]]:
    """Pieces (from, start, end): text[from:end] is the piece, text[from:start] what it repeats of the piece before.

    Pieces have max_chars characters (code points) or fewer and together, without what they repeat, are the text. Each
    but the first repeats `overlap` characters, or all there are before it if fewer. An overlap that leaves no room for
    new text is an error. No limit, or an empty text, gives one piece.
    """
    n = len(text)
    if not max_chars or max_chars < 1:
        return [(0, 0, n)]
    overlap = max(0, overlap or 0)
    if overlap >= max_chars:
        raise ValueError(f"an overlap of {overlap} characters does not fit into pieces of {max_chars}")
    if n <= max_chars:
        return [(0, 0, n)]
    cuts = segment(text, max_chars - overlap)
    edges = [0, *(c for c, _ in cuts), n]
    strength = [9, *(s for _, s in cuts), 9]  # of the edge with this number
    left, right, alive = list(range(-1, len(edges) - 1)), list(range(1, len(edges) + 1)), [True] * len(edges)
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(k: int) -> None:
        """The edge k between two pieces, unless what they form is too large."""
        a, b = left[k], right[k]
        size = edges[b] - edges[a] + min(overlap, edges[a])
        if size <= max_chars:
            heapq.heappush(heap, (strength[k], size, k, a, b))

    for k in range(1, len(edges) - 1):
        offer(k)
    while heap:
        _, _, k, a, b = heapq.heappop(heap)
        if not alive[k] or left[k] != a or right[k] != b:
            continue  # a neighbour has changed since; it was offered anew then
        alive[k] = False
        right[a], left[b] = b, a
        if a > 0:
            offer(a)
        if b < len(edges) - 1:
            offer(b)
    kept = [e for e, live in zip(edges, alive) if live]
    return [(max(0, s - overlap) if s else 0, s, e) for s, e in zip(kept, kept[1:])]


def specs_of(sections: DataFrame, specs: DataFrame) -> DataFrame:
    """(section, spec_name, max_chars, overlap_chars): for each distinct section the spec with its name, else the one with the longest prefix before its `*`. Specs are found by equality of prefixes."""
    glob = F.col("name").endswith("*")
    keyed = specs.select(F.when(glob, F.expr("substring(name, 1, length(name) - 1)")).otherwise(F.col("name")).alias("_key"), (~glob).alias("_exact"), F.col("name").alias("spec_name"), "max_chars", "overlap_chars")
    names = sections.select("section").filter("section is not null").distinct()
    prefixes = names.select("section", F.explode(F.transform(F.sequence(F.lit(0), F.length("section")), lambda i: F.substring("section", F.lit(1), i))).alias("_key"))
    hits = prefixes.join(keyed, "_key").filter("not _exact or _key = section")
    best = hits.groupBy("section").agg(F.max(F.struct("_exact", F.length("_key").alias("n"), "spec_name", "max_chars", "overlap_chars")).alias("b"))
    return best.select("section", "b.spec_name", "b.max_chars", "b.overlap_chars")


def with_spec(rows: DataFrame, specs: DataFrame, key: str, section: str = "section", broadcast_sections: int = BROADCAST_SECTIONS) -> DataFrame:
    """rows with spec_name, max_chars and overlap_chars of the spec for their section; rows without a spec have nulls.

    The rows, which may hold large payloads, are not moved: only their distinct sections meet the specs, and what comes
    of it is broadcast. Where there are more sections than that allows, each section's rows are dealt to SALTS parts by
    their key. Columns of rows with these names are replaced. A spec whose overlap fills its limit is an error.
    """
    bad = specs.filter("max_chars > 0 and overlap_chars >= max_chars").select("name").limit(5).collect()
    if bad:
        raise ValueError(f"specs whose overlap leaves no room for new text: {', '.join(str(r.name) for r in bad)}")
    rows = rows.drop("spec_name", "max_chars", "overlap_chars")
    best, _ = Workspace(rows.sparkSession, "specs").keep(specs_of(rows.select(F.col(section).alias("section")), specs).withColumnRenamed("section", "_section"))
    if best.count() <= broadcast_sections:
        return rows.join(F.broadcast(best), rows[section] == best["_section"], "left").drop("_section")
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    many = best.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(many, (dealt[section] == many["_section"]) & (dealt["_salt"] == many["_s"]), "left").drop("_section", "_s", "_salt")


def split_documents(loads: DataFrame, specs: DataFrame, broadcast_sections: int = BROADCAST_SECTIONS) -> DataFrame:
    """loads(load_id, section, raw, content_type): the pieces of each payload under the spec of its section.

    One row per piece: load_id, spec_name, piece (from 0), pieces, start, end, repeated, n_chars and text. Null payloads
    have none, empty ones one empty piece; a section without spec or limit stays whole.
    """
    held = loads.select("load_id", "section", "raw", "content_type").filter("raw is not null")
    rows = with_spec(spread(held), specs, "load_id", broadcast_sections=broadcast_sections)
    rows = rows.select("load_id", "spec_name", "max_chars", "overlap_chars", "raw", "content_type")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for load_id, spec, limit, overlap, raw, kind in frame.itertuples(index=False, name=None):
                text = decode_bytes(raw, kind)
                parts = split_text(text, None if pd.isna(limit) else int(limit), 0 if pd.isna(overlap) else int(overlap))
                for k, (f, s, e) in enumerate(parts):
                    out.append((load_id, spec if isinstance(spec, str) else None, k, len(parts), s, e, s - f, e - f, text[f:e]))
            yield pd.DataFrame(out, columns=names)

    names = ["load_id", "spec_name", "piece", "pieces", "start", "end", "repeated", "n_chars", "text"]
    kind = loads.schema["load_id"].dataType.simpleString()
    schema = f"load_id {kind}, spec_name string, piece int, pieces int, start int, end int, repeated int, n_chars int, text string"
    return rows.mapInPandas(run, schema)
