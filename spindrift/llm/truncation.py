"""Texts cut off by field limits.

Each text is measured under several encodings; the lengths are grouped by source and measure, and a source whose
lengths pile up at their maximum under some measure has a hidden limit there: a hard one, if the pile is that length
itself, a soft one, if texts were cut at a word somewhat before it. A text just at a hard limit of its source is cut
unless its ending is that of a whole text. Everywhere the endings are looked at: open blocks, tables, list entries,
sentences. What whole list entries end with is learned from the entries that another line follows, over all rows.
Everything is built from column expressions; groups are summed before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.runtime import SPACE_CLASS, Workspace, spread

# What cutting programs leave behind, and abbreviations whose point ends no sentence.
MARKER = r"(?:…|\.\.\.|[\[(<](?:truncated|cut|cut off|continued|more|clipped|…|\.\.\.)[\])>])$"
ABBREVIATION = r"(?:(?:^|[\s(])(?:Mio|Mrd|Nr|No|no|Dr|Mr|Mrs|Ms|Prof|St|ca|bzw|vgl|Art|Abs|Sr|Sra|Srta|Sig|art|num|núm|pág|z\.B|e\.g|i\.e|approx|vs|Abb|Kap|vol|fig|Fig)\.|[$€£]\s?\d{1,3}\.|(?<![\d,.'])\b\d{1,3}\.)$"
SENTENCE_END = r"[.!?。！？](?:\s?[”\"»’'›)\]])*(?:\s*(?:\[\d+\]|\(\d+\)|[\p{So}️]))*$"
CLOSED_END = r"(?:\[\d+\]|\([^()\n]*\)|[\p{So}])[”\"»]?$"
LIST_ENTRY = r"^\s*(?:[-*•–—+]|\d{1,3}[.)])\s"
NUMBER = r"(?<![\d.,])(?:\d{1,3}(?:[,.   ]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)"
FIGURE_LINE = rf"^[^:\n]{{1,60}}: (?:[\p{{Sc}}A-Z]{{0,4}} ?){NUMBER}(?: ?%)?$"
#: A pile at the maximum: so many times the density of lengths a little below it, and so many texts at least.
PILE, PILE_ROWS = 4.0, 3
#: The share of a pile's texts at the maximum itself that makes a limit a hard one.
HARD = 0.5
#: A list entry's last word is a whole ending if it ends inner entries at least this share as often as final ones; a line with a figure is usual if so large a share of the lines with its label look alike.
SHARE = 0.05


def _count(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)


def measures(text: Column) -> dict[str, Column]:
    """The text's length as different stores would count it; line ends count once as they are (LF) or twice (CRLF)."""
    html = text
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        html = F.replace(html, F.lit(raw), F.lit(entity))
    lines = F.length(text) - F.length(F.translate(text, "\n", ""))
    escaped = F.length(text) - F.length(F.translate(text, '\n\r\t"\\', ""))
    wide = F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))
    outside = F.length(F.regexp_replace(text, r"[\x00-\x7f]", ""))
    return {
        "characters": F.length(text).cast("long"),
        "utf8_bytes": F.octet_length(text).cast("long"),
        "utf16_units": (F.length(text) + wide).cast("long"),
        "html_escaped": F.length(html).cast("long"),
        "html_escaped_bytes": F.octet_length(html).cast("long"),
        "json_escaped": (F.length(text) + escaped).cast("long"),
        "json_escaped_bytes": (F.octet_length(text) + escaped).cast("long"),
        "json_ascii": (F.length(text) + escaped + 5 * outside + 6 * wide).cast("long"),
        "crlf_characters": (F.length(text) + lines).cast("long"),
        "crlf_bytes": (F.octet_length(text) + lines).cast("long"),
    }


def _limits(sizes: DataFrame) -> DataFrame:
    """sizes(source, sizes MAP): (source, measure, limit_at, texts, at_limit, near, below, is_limit)."""
    each = sizes.select("source", F.explode("sizes").alias("measure", "len")).groupBy("source", "measure", "len").agg(F.count("*").alias("n"))
    top = each.groupBy("source", "measure").agg(F.max("len").alias("limit_at"), F.sum("n").alias("texts"))  # a row for each source and measure
    top = top.withColumnsRenamed({"source": "s", "measure": "m"})
    w = F.ceil(F.col("limit_at") * 0.04)
    strips = (
        each.join(top, F.col("s").eqNullSafe(F.col("source")) & (F.col("m") == F.col("measure")))
        .groupBy("source", "measure", "limit_at", "texts")
        .agg(
            F.sum(F.when(F.col("len") == F.col("limit_at"), F.col("n")).otherwise(0)).alias("at_limit"),
            F.sum(F.when(F.col("len") > F.col("limit_at") - w, F.col("n")).otherwise(0)).alias("near"),
            (F.sum(F.when((F.col("len") <= F.col("limit_at") - w) & (F.col("len") > F.col("limit_at") - 3 * w), F.col("n")).otherwise(0)) / 2).alias("below"),
        )
    )
    is_limit = (F.col("at_limit") >= PILE_ROWS) & (F.col("near") >= PILE * F.greatest("below", F.lit(0.5)))
    return strips.withColumn("is_limit", is_limit).withColumn("is_hard", is_limit & (F.col("at_limit") >= HARD * F.col("near")))


def _sizes(text: Column) -> Column:
    """The measures of a text, by name; what is left of a character cut in half, U+FFFD at the end, is not measured, as it takes more room than the bytes it stands for."""
    own = F.rtrim(text, F.lit("\ufffd"))
    return F.create_map(*(x for m, c in measures(own).items() for x in (F.lit(m), c)))


def hidden_limits(actions: DataFrame) -> DataFrame:
    """For each source and measure, whether the lengths pile up at their maximum.

    `at_limit` texts have just that length, `near` are within 4 % of it, `below` is the mean number in each of the two
    strips of that width below. `is_limit` holds if PILE_ROWS or more are at the maximum and PILE times as many near it
    as below, `is_hard` if HARD of these are at the maximum itself. A null source is a source of its own; null and empty
    texts are left out.
    """
    return _limits(actions.filter("text is not null and text != ''").select("source", _sizes(F.col("text")).alias("sizes")))


def _figures(c: Column) -> Column:
    """The text with its figures as classes: #G grouped by thousands, #D with a decimal point, #C with a decimal comma, #I whole."""
    for pattern, name in ((r"(?<![\d.,])\d{1,3}(?:[,.\x{a0}\x{202f}]\d{3})+(?![.,]?\d)", "#G"), (r"\d+\.\d+", "#D"), (r"\d+,\d+", "#C"), (r"\d+", "#I")):
        c = F.regexp_replace(c, pattern, name)
    return c


def _last_token(line: Column) -> Column:
    """The last word of a list entry, with figures as classes."""
    return _figures(F.substring_index(F.rtrim(F.translate(line, "\t\x0b\x0c\r", "    ")), " ", -1))


def _endings(actions: DataFrame) -> DataFrame:
    t = F.regexp_replace(F.col("text"), f"{SPACE_CLASS}+$", "")
    lines = F.split("t", r"\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]")
    rows = spread(actions.select("action_id", "source", "text").filter("text is not null and text != ''")).withColumn("t", t).withColumn("lines", lines)
    rows = rows.withColumn("line", F.element_at("lines", -1)).withColumn("before", F.coalesce(F.try_element_at("lines", F.lit(-2)), F.lit(""))).drop("lines")
    end = F.col("line")
    pipes, own = _count(F.col("before"), "|"), _count(F.col("line"), "|")
    fenced = _count(F.col("t"), "```") % 2 == 1
    opened = (
        fenced
        | ((_count(F.col("line"), "“") > _count(F.col("line"), "”")) | (_count(F.col("line"), "«") > _count(F.col("line"), "»")))
        | (_count(F.col("line"), "(") > _count(F.col("line"), ")"))
        | (_count(F.col("line"), "[") > _count(F.col("line"), "]"))
        | (F.col("t").rlike(r"^\s*[{\[]") & F.expr("try_parse_json(t) is null"))
    )
    sentence = end.rlike(SENTENCE_END) & ~end.rlike(ABBREVIATION)
    kind = (
        F.when(F.col("t") == "", "blank")
        .when(end.rlike(MARKER), "marker")
        .when(F.endswith(F.col("t"), F.lit("�")), "half_character")
        .when(opened, "open_block")
        .when(F.col("t").rlike(r"^\s*[{\[]") | F.col("line").rlike(r"^\s*```\s*$"), "whole")
        .when(F.col("line").rlike(r"^\s*\|"), F.when(F.col("line").rlike(r"\|\s*$") & ((own >= pipes) | ~F.col("before").rlike(r"^\s*\|")), "whole").otherwise("table_row"))
        .when(sentence | end.rlike(CLOSED_END), "whole")
        .when(F.col("line").rlike(LIST_ENTRY), "list_entry")
        .when(F.col("line").rlike(FIGURE_LINE), "figure")
        .otherwise("sentence")
    )
    return rows.withColumn("ending", kind)


def _examined(actions: DataFrame) -> DataFrame:
    """(action_id, source, ending, token, inner, sizes), written once: how each text ends, the class of its last list entry or figure, the last words of list entries that another line follows, and its lengths."""
    ends = _endings(actions)
    lines = F.split("text", r"\r\n|[\n\r\x0b\x0c]")
    before = F.when(F.size(lines) > 1, F.slice(lines, F.lit(1), F.size(lines) - 1))
    inner = F.when(F.col("text").rlike("(?m)" + LIST_ENTRY), F.transform(F.filter(before, lambda x: x.rlike(LIST_ENTRY)), _last_token))
    own = _sizes(F.col("text"))
    token = F.when(F.col("ending") == "list_entry", _last_token(F.col("line"))).when(F.col("ending") == "figure", _figures(F.col("line")))
    kept, _ = Workspace(actions.sparkSession, "truncation").keep(ends.select("action_id", "source", "ending", token.alias("token"), inner.alias("inner"), own.alias("sizes")))
    return kept


def _judged(seen: DataFrame, limits: DataFrame) -> DataFrame:
    """The verdicts; `limits` may be empty, which leaves the endings alone to decide."""
    maybe = seen.filter("ending in ('list_entry', 'figure')")
    counts = maybe.groupBy("ending", "token").agg(F.count("*").alias("final"))
    known = seen.select(F.explode("inner").alias("token")).groupBy("token").agg(F.count("*").alias("inner"))
    entries = counts.filter("ending = 'list_entry'").join(known, "token").filter(f"inner >= {SHARE} * final").select("ending", "token")
    label = F.substring_index("token", ":", 1)
    totals = counts.filter("ending = 'figure'").groupBy(label.alias("label")).agg(F.sum("final").alias("all"))
    figures = counts.filter("ending = 'figure'").withColumn("label", label).join(totals, "label").filter(f"final >= {SHARE} * all").select("ending", "token")
    good = entries.unionByName(figures).withColumn("usual", F.lit(True))
    at = limits.filter("is_limit").groupBy(F.col("source").alias("s")).agg(F.collect_list(F.struct("measure", "limit_at", "is_hard")).alias("limits"))  # measures are few
    ws = Workspace(seen.sparkSession, "endings")
    rows = seen.join(_sized(good, ws), ["ending", "token"], "left")
    rows = rows.join(_sized(at, ws), F.col("s").eqNullSafe(F.col("source")), "left")
    hard = F.coalesce(F.expr("exists(limits, x -> x.is_hard and sizes[x.measure] = x.limit_at)"), F.lit(False))
    soft = F.coalesce(F.expr("exists(limits, x -> sizes[x.measure] <= x.limit_at and sizes[x.measure] > x.limit_at - ceil(x.limit_at * 0.04))"), F.lit(False))
    whole, doubtful = F.col("ending").isin("whole", "blank"), F.col("ending").isin("list_entry", "figure")
    cut = ~whole & (F.col("at_limit") | ~doubtful | F.col("usual").isNull())
    by = F.when(F.col("at_limit"), "limit").when(soft, "near limit").otherwise("ending")
    return rows.withColumn("at_limit", hard).withColumn("cut", cut).select("action_id", "source", "ending", "at_limit", "cut", F.when(F.col("cut"), by).alias("by"))


def _sized(sums: DataFrame, ws: Workspace, rows: int = 100_000) -> DataFrame:
    """A table of sums, written once, and marked for a broadcast if it has few rows."""
    kept, _ = ws.keep(sums)
    return F.broadcast(kept) if kept.count() <= rows else kept


def truncated(actions: DataFrame) -> DataFrame:
    """actions(action_id, source, text): every row with a text, with `ending` (how it ends), `at_limit` (its length is a hard limit of its source), `cut`, and what shows that: `by` limit, near limit or ending.

    Null and empty texts are left out; a text of white space alone is no case. Repeated rows are judged one by one, and
    other columns of the input play no part. An ending that may be whole or not (a list entry, a line with a figure) is a
    cut one at a hard limit, and elsewhere if the lists and figures of the corpus do not end so.
    """
    seen = _examined(actions)
    return _judged(seen, _limits(seen))


def source_rates(actions: DataFrame) -> DataFrame:
    """For each source its texts, how many are cut and their share, how many of these are at or near a hidden limit, and the measures under which it shows one."""
    seen = _examined(actions)
    limits = _limits(seen)
    named = limits.filter("is_limit").groupBy(F.col("source").alias("s")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "measure", "limit_at"))), ", ").alias("limits"))
    rates = _judged(seen, limits).groupBy("source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut_texts"), F.count_if(F.col("by") == "limit").alias("at_limit"), F.count_if(F.col("by") == "near limit").alias("near_limit"))
    rates = rates.withColumn("share", F.round(F.col("cut_texts") / F.col("texts"), 6))
    return rates.join(named, F.col("s").eqNullSafe(F.col("source")), "left").drop("s")
