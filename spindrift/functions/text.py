"""Text functions as columns: tokens, lines, claims, markup, packing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.runtime import SPACE_CLASS

#: Words as Python's \w sees them; Java's \w is ASCII only.
TOKEN = r"[\p{L}\p{N}_]+"
#: Line ends of str.splitlines().
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def tokens(text: Column) -> Column:
    """Lower-case words of a text, in order; null gives none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1), F.array().cast("array<string>"))


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def term_count(lowered: Column, term: str) -> Column:
    """How often a lower-case word occurs in a lower-cased text, as a word."""
    word = f"(?<![\\p{{L}}\\p{{N}}_])\\Q{term}\\E(?![\\p{{L}}\\p{{N}}_])"
    return F.when(F.contains(lowered, F.lit(term)), F.regexp_count(lowered, F.lit(word))).otherwise(0).cast("long")


def folded(text: Column) -> Column:
    """Case folded for comparison: lower case with ß as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def lines(text: Column) -> Column:
    """Lines as str.splitlines() gives them: no empty item after a final line end, none for an empty text."""
    parts = F.split(text, LINE_END)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(text.rlike(f"(?s)(?:{LINE_END})\\z"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def snippet(text: Column, terms: list[str], radius: int = 120) -> Column:
    """The text around the earliest of the words, widened to whole words, with … where something is left out; without a match its first 2 * radius characters."""
    lowered = F.lower(text)
    places = F.filter(F.array(*(F.locate(t, lowered) for t in terms)), lambda p: p > 0)
    hit = F.array_min(places)
    start, end = F.greatest(hit - 1 - radius, F.lit(0)), F.least(hit - 1 + radius, F.length(text))
    left = F.length(F.regexp_extract(F.substring(text, F.lit(1), start), r"([\p{L}\p{N}]*)\z", 1))
    right = F.length(F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"^([\p{L}\p{N}]*)", 1))
    a, b = start - left, end + right
    body = stripped(F.substring(text, a + 1, b - a))
    around = F.concat(F.when(a > 0, "…").otherwise(""), body, F.when(b < F.length(text), "…").otherwise(""))
    head = F.concat(stripped(F.substring(text, 1, 2 * radius)), F.when(F.length(text) > 2 * radius, "…").otherwise(""))
    return F.when(F.length(text) == 0, "").when(hit.isNull(), head).otherwise(around)


# The form of a numeric claim, the factor of its scale word and what may stand around it.
CLAIM = r"(?i)^[$₹€£]?(-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?)(trillion|billion|million|thousand|bn|mn|[kmbt])?%?$"
CLAIM_EDGES = "()[]{}\"'.,;:!?–—-*_`#~"
YEAR_RANGE = r"(?:19|20)\d{2}\s*[-/‒-―]\s*\d{2,4}"
SCALES = {"": 1.0, "k": 1e3, "thousand": 1e3, "m": 1e6, "mn": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9, "t": 1e12, "trillion": 1e12}


def numeric_claims(text: Column) -> Column:
    """The figures a text states, scale words applied; calendar years and year ranges are none."""
    words = F.split(F.regexp_replace(text, YEAR_RANGE, " "), f"{SPACE_CLASS}+")
    bare = F.transform(words, lambda w: F.btrim(w, F.lit(CLAIM_EDGES)))
    scale = F.create_map(*(F.lit(x) for kv in SCALES.items() for x in kv))
    parts = F.transform(
        F.filter(bare, lambda w: w.rlike(CLAIM)),
        lambda w: F.struct(F.replace(F.regexp_extract(w, CLAIM, 1), F.lit(","), F.lit("")).alias("num"), F.lower(F.regexp_extract(w, CLAIM, 2)).alias("scale")),
    )
    real = F.filter(parts, lambda p: ~((p["scale"] == "") & ~F.contains(p["num"], F.lit(".")) & p["num"].cast("double").between(1900, 2099)))
    return F.coalesce(F.transform(real, lambda p: p["num"].cast("double") * F.element_at(scale, p["scale"])), F.array().cast("array<double>"))


def packed_pages(text: Column, size: int) -> Column:
    """Pages (separated by form feeds, stripped, blank ones dropped) joined by blank lines into chunks of up to `size` characters of pages; a page is never split."""
    pages = F.filter(F.transform(F.split(text, "\f"), stripped), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, page: Column) -> Column:
        n = F.length(page)
        fits = (acc["n"] > 0) & (acc["n"] + n <= size)
        return F.struct(
            F.when(fits | (acc["n"] == 0), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"),
            F.when(fits, F.concat(acc["open"], F.lit("\n\n"), page)).otherwise(page).alias("open"),
            F.when(fits, acc["n"] + n).otherwise(n).alias("n"),
        )

    return F.aggregate(pages, start, step, lambda a: F.when(a["n"] > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))


def html_text(html: Column) -> Column:
    """Markup to text: scripts, styles and head dropped, block tags as line ends, entities resolved, white space tidied."""
    t = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|br|tr|li|h[1-6]|table|section|ul|ol|body|html)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def densest_window(text: Column, pattern: str, size: int, step: int) -> Column:
    """Start (from 0) of the window with most matches of a pattern; the first wins."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - size, F.lit(0)), F.lit(step))
    seen = F.transform(starts, lambda s: F.struct(F.regexp_count(F.substring(text, s + 1, F.lit(size)), F.lit(pattern)).alias("n"), (-s).alias("at")))
    return -F.array_max(seen)["at"]


def fenced_json(text: Column) -> Column:
    """The body of a ```-fenced block around a response, else the response, stripped."""
    inner = F.regexp_extract(text, r"(?s)^\s*```(?:json)?\s*\n(.*?)\n?```\s*$", 1)
    return stripped(F.when(inner != "", inner).otherwise(text))


def scrubbed(text: Column, patterns: list[str], token: str = "[REDACTED]") -> Column:
    """Every match of every pattern, one pattern after the other, replaced by the token."""
    for p in patterns:
        text = F.regexp_replace(text, p, token)
    return text


def canonical_json(payload: Column) -> Column:
    """JSON text in one form for equal values: no spaces, the keys of all objects sorted at every depth, numbers without trailing zeros. Text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(payload)), payload)


def tenths(n: Column, unit: int) -> Column:
    """A whole number in units with one decimal, half a tenth rounded up; in whole numbers throughout, so that no binary fraction decides."""
    t = F.floor((n.cast("long") * 10 + unit // 2) / unit)
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def size_label(n: Column) -> Column:
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit("B"))).when(n < 1_000_000, F.concat(tenths(n, 1000), F.lit("k"))).otherwise(F.concat(tenths(n, 1_000_000), F.lit("M")))
