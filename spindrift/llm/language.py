"""Languages of documents and of their passages, by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed greedily into the
longest phrases that occur in the language's sample; the language that needs the fewest phrases per letter wins. Texts
are parsed sentence by sentence and the sentences joined to passages by a shortest path on which changing the language
has a price. The sample is cleaned by itself beforehand: halves of it are parsed with automata of the other half, and
texts whose label loses are left out.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.runtime import spread

LANGUAGES = ("en", "de", "fr", "es", "it", "pt")
# Usual spellings of the languages besides code and region code.
SPELLINGS = {
    "en": "en eng english", "de": "de deu ger german", "fr": "fr fra fre french",
    "es": "es spa spanish castilian", "it": "it ita italian", "pt": "pt por portuguese",
}
_SPELLED = {s: code for code, all_ in SPELLINGS.items() for s in all_.split()}
#: Bounds of the training sample: labelled rows of each language, and letters of them in an automaton.
SAMPLE_ROWS, SAMPLE_LETTERS = 200, 40_000
#: Prose a language needs in one passage to count; documents shorter than MIN_DOCUMENT get no label.
MIN_PASSAGE, MIN_DOCUMENT = 100, 60
#: Price in phrases of a change of language between two sentences.
CHANGE = 3.0
#: A passage whose best language needs hardly fewer phrases than the next, by this share, is in none of the languages.
UNSURE = 0.07

_A = 27  # letters and the space


def label_of(label: str | None) -> str | None:
    """The language a label names in any usual spelling, else None."""
    key = (label or "").strip().casefold().replace("_", "-")
    return _SPELLED.get(key) or _SPELLED.get(key.split("-")[0] if re.fullmatch(r"[a-z]{2,3}-[a-z0-9]{2,4}(-[a-z0-9]+)*", key) else "")


_SPECIAL = {"æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "'": "", "’": ""}


class _Plain(dict):
    """Code point to what stands for it: letters without accents, a space for the rest. Filled as characters turn up."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = "".join(x if "a" <= x <= "z" else "" if unicodedata.combining(x) else " " for x in unicodedata.normalize("NFKD", _SPECIAL.get(c, c))) if c not in "'’" else ""
        self[code] = out
        return out


_PLAIN = _Plain()
_CODES = bytes(k - 96 if 97 <= k <= 122 else 0 for k in range(256))
_GAPS = re.compile(rb"\x00+")


def symbols(text: str) -> bytes:
    """Letters a to z without case and accents as 1 to 26, runs of anything else as one 0."""
    raw = text.casefold().translate(_PLAIN).encode("ascii").translate(_CODES)
    return _GAPS.sub(b"\x00", raw).strip(b"\x00")


def suffix_automaton(data: bytes) -> array:
    """Transitions of the suffix automaton: entry [state + symbol] is the next state (states are multiples of the alphabet's size) or 0."""
    step, link, length = array("i", [0] * _A), [-1], [0]
    last = 0
    for c in data:
        cur = len(length)
        step.extend([0] * _A)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and not step[p * _A + c]:
            step[p * _A + c] = cur * _A
            p = link[p]
        if p >= 0:
            q = step[p * _A + c] // _A
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.extend(step[q * _A : q * _A + _A])
                while p >= 0 and step[p * _A + c] == q * _A:
                    step[p * _A + c] = twin * _A
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return step


def phrases(step: array, data: bytes) -> int:
    """The number of phrases of a greedy parse of data into longest matches; a symbol the automaton lacks is a phrase."""
    n, state = 0, 0
    for c in data:
        to = step[state + c]
        if to:
            state = to
        else:
            if state:
                n += 1
            state = step[c]
            if not state:
                n += 1
    return n + (state != 0)


#: Cells of a block of texts that are parsed together, and the least number of texts worth a block.
_CELLS, _FEW = 4_000_000, 32


def phrase_counts(model: dict[str, array], data: list[bytes]) -> np.ndarray:
    """phrases() of every text in every language, as rows and columns; texts of similar length are parsed in step with each other."""
    out = np.zeros((len(data), len(model)), dtype=np.int64)
    order = sorted(range(len(data)), key=lambda i: -len(data[i]))
    at = 0
    while at < len(order):
        longest = len(data[order[at]])
        if not longest:
            break
        rows = order[at : at + max(1, _CELLS // longest)]
        at += len(rows)
        if len(rows) < _FEW:
            for i in rows:
                out[i] = [phrases(step, data[i]) for step in model.values()]
            continue
        sizes = np.array([len(data[i]) for i in rows])
        cells = np.zeros((len(rows), longest), dtype=np.uint8)
        for k, i in enumerate(rows):
            cells[k, : sizes[k]] = np.frombuffer(data[i], dtype=np.uint8)
        cells = np.ascontiguousarray(cells.T).astype(np.int32)
        live = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts longer than each place
        for col, step in enumerate(model.values()):
            table = np.frombuffer(step, dtype=np.int32)
            state, n = np.zeros(len(rows), dtype=np.int32), np.zeros(len(rows), dtype=np.int64)
            for place in range(longest):
                k = live[place]
                now, c = state[:k], cells[place, :k]
                to = table[now + c]
                miss = np.flatnonzero(to == 0)
                if miss.size:
                    root = table[c[miss]]
                    n[miss] += (now[miss] != 0).astype(np.int64) + (root == 0)
                    to[miss] = root
                state[:k] = to
            out[rows, col] = n + (state != 0)
    return out


_RULE = re.compile(r"[-+=|:\s]{3,}\Z")
_CODE = re.compile(r"(?:[{}\[\]]|<[?%!=<-]|<\w[^<>]*=\{|\"[\w .-]+\":|[\w.]+\s?[=:(]\s?[\"{\[(\d]|\w+\(|import |def |select |[$>#]!?\s?/|[\w.-]+=)")
_ASSIGNED = re.compile(r"=\S+;?\Z")
#: Tags and declarations, and elements whose content is no prose.
_TAG = re.compile(r"<[!?][^<>]*>|</?[a-zA-Z][\w:-]*(?:\s+[\w:.@-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>")
_EMBEDDED = re.compile(r"<(script|style|pre|table)\b[^<>]*>.*?</\1\s*>", re.I | re.S)
_ASCII_LETTERS = dict.fromkeys([*range(65, 91), *range(97, 123)])


def _no_prose(body: str) -> bool:
    """Whether a stripped line is of a table, JSON or code, or has few letters."""
    if body[-1] == "|" or (body[0] == "|" and "|" in body[1:]):
        return True
    if body[0] == "|":  # a mark of a quotation, as > is
        body = body[1:].lstrip()
        if not body:
            return True
    if _RULE.match(body) or _CODE.match(body) or ("=" in body and _ASSIGNED.search(body)):
        return True
    return len(body.translate(_ASCII_LETTERS)) > 0.5 * len(body) and sum(map(str.isalpha, body)) < 0.5 * len(body)


def untagged(text: str) -> str:
    """The text with spaces for tags, so that places in it stay."""
    return _TAG.sub(lambda m: re.sub(r"\S", " ", m.group(0)), text) if "<" in text else text


def _lines(text: str) -> Iterator[tuple[str, bool]]:
    """The lines of a text without tags; (element, True) for the elements whose content is no prose."""
    at = 0
    for m in _EMBEDDED.finditer(text) if "<" in text else ():
        yield from ((line, False) for line in untagged(text[at : m.start()]).splitlines(keepends=True))
        yield m.group(0), True
        at = m.end()
    yield from ((line, False) for line in untagged(text[at:]).splitlines(keepends=True))


_STAMP = re.compile(r"\s*[\[(]?\d{2,4}[-/.]\d\d?[-/.]\d{2,4}[T ]?[\d:.,]*\s?(?:Z|UTC|[+-]\d\d:?\d\d)?[\])]?\s*")
_SENTENCE = re.compile(r"[^.!?]*(?:[.!?]+(?!\s|$)[^.!?]*)*(?:[.!?]+[\"”»’')\]]*\s*|$)")


#: Marks of a fence at the start of a line, with nothing but a language's name behind them or before the line's text.
_MARK = re.compile(r"\s*`{3,}(?:\s*[\w.+#-]+\s*\Z|\s*)")


#: JSON objects and rows of a table within a line, which may stand between sentences where line ends got lost.
_INLINE = re.compile(r"\{\s*\"(?:[^{}]|\{[^{}]*\})*\}|\|(?:[^|\n]*\|){2,}")


def _parts(text: str) -> Iterator[tuple[int, str, str]]:
    """(start, piece, kind) in order; kinds are text (a line or what is left of it), mark (of a fence, at either end of a line) and other."""
    at, marked = 0, "```" in text
    for line, embedded in _lines(text):
        if embedded:
            yield at, line, "other"
            at += len(line)
            continue
        stamp = _STAMP.match(line)  # of a log line
        if stamp:
            at, line = at + stamp.end(), line[stamp.end() :]
        a, b = 0, len(line)
        if marked and "```" in line:
            lead, body = _MARK.match(line), line.rstrip()
            a = lead.end() if lead else 0
            b = max(a, len(body.rstrip("`"))) if body.endswith("```") else b
        if a:
            yield at, line[:a], "mark"
        done = a
        for m in _INLINE.finditer(line, a, b) if "|" in line or "{" in line else ():
            if done < m.start():
                yield at + done, line[done : m.start()], "text"
            yield at + m.start(), m.group(0), "other"
            done = m.end()
        if done < b:
            yield at + done, line[done:b], "text"
        if b < len(line):
            yield at + b, line[b:], "mark"
        at += len(line)


def units(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, prose) of sentences and other lines, in order. Tables, JSON, code and lines with few letters are no prose; tags are nothing.

    Marks of fences open and close in turn, also when glued to a line of text. Where one is missing, which is open cannot
    be told: then they mean nothing, and all lines are judged by themselves.
    """
    parts = list(_parts(text))
    paired, out, fenced = sum(kind == "mark" for _, _, kind in parts) % 2 == 0, [], False
    for at, piece, kind in parts:
        body = piece.strip()
        if kind == "mark":
            if paired:
                fenced = not fenced
                out.append((at, at + len(piece), False))
        elif kind == "other":
            out.append((at, at + len(piece), False))
        elif body:
            if fenced or _no_prose(body):
                out.append((at, at + len(piece), False))
            else:
                for m in _SENTENCE.finditer(piece):
                    if m.group(0).strip():
                        out.append((at + m.start(), at + m.end(), True))
    return out


def _cheapest(costs: list[list[int] | None]) -> list[int | None]:
    """For each unit its language on the cheapest path; null costs are passed over."""
    priced = [c for c in costs if c is not None]
    if not priced:
        return [None] * len(costs)
    first = priced[0].index(min(priced[0]))
    if all(c[first] == min(c) for c in priced):  # the same language is best everywhere
        return [None if c is None else first for c in costs]
    best, back = [0.0] * len(priced[0]), []
    for c in costs:
        if c is None:
            back.append(None)
            continue
        low = min(best)
        src = best.index(low)
        came = [src if low + CHANGE < b else k for k, b in enumerate(best)]
        best = [min(low + CHANGE, b) + x for b, x in zip(best, c)]
        back.append(came)
    state = best.index(min(best))
    out: list[int | None] = [None] * len(costs)
    for i in range(len(costs) - 1, -1, -1):
        if back[i] is not None:
            out[i] = state
            state = back[i][state]
    return out


def _runs(parts: list[tuple[int, int, bool]], costs: list[list[int] | None], langs: list[str]) -> list[tuple[str, int, int, float]]:
    chosen = _cheapest(costs)
    out: list[tuple[str, int, int, float]] = []
    i = 0
    while i < len(parts):
        k = chosen[i]
        if k is None:
            i += 1
            continue
        j, sums = i, [0] * len(langs)
        while j < len(parts) and chosen[j] == k:
            sums = [a + b for a, b in zip(sums, costs[j])]
            j += 1
        rival = min((s for g, s in enumerate(sums) if g != k), default=0)
        out.append((langs[k], parts[i][0], parts[j - 1][1], max(0.0, 1 - sums[k] / rival) if rival else 0.0))
        i = j
    return out


def passages_of(texts: list[str], model: dict[str, array]) -> list[list[tuple[str, int, int, float]]]:
    """For each text (language, start, end, confidence) of the runs of prose in one language."""
    parts = [units(t) for t in texts]
    data = [symbols(t[s:e]) for t, us in zip(map(untagged, texts), parts) for s, e, prose in us if prose]
    counts = iter(phrase_counts(model, data).tolist())
    sized = iter(map(len, data))
    langs, out = list(model), []
    for us in parts:
        costs = [None if not prose or (c := (next(sized), next(counts)))[0] == 0 else c[1] for _, _, prose in us]
        out.append(_runs(us, costs, langs))
    return out


def judge_all(texts: list[str | None], model: dict[str, array]) -> list[list[tuple[str | None, int, int, float, int, bool]]]:
    """The passages of each text in order: (language, or None if it is in none of them; start; end; confidence; characters; whether its language counts by it).

    Languages with a passage of MIN_PASSAGE characters count, by those passages; if none has one, the language with the
    most prose, by all of its. Texts under MIN_DOCUMENT characters and texts without prose have no passage.
    """
    own = [t if t and len(t) >= MIN_DOCUMENT else "" for t in texts]
    out = []
    for t, found in zip(own, passages_of(own, model)):
        sized = [(g if c >= UNSURE else None, s, e, c, len(_TAG.sub("", t[s:e]).strip())) for g, s, e, c in found]
        size = Counter()
        for g, _, _, _, n in sized:
            if g:
                size[g] += n
        long = any(g and n >= MIN_PASSAGE for g, _, _, _, n in sized)
        main = size.most_common(1)[0][0] if size else None
        out.append([(g, s, e, c, n, g is not None and (n >= MIN_PASSAGE if long else g == main)) for g, s, e, c, n in sized])
    return out


def judge(text: str | None, model: dict[str, array]) -> list[tuple[str | None, int, int, float, int, bool]]:
    return judge_all([text], model)[0]


# -- training ----------------------------------------------------------------------------------------------------------


def _automata(texts: dict[str, list[str]], letters: int) -> dict[str, array]:
    out = {}
    for g, all_ in texts.items():
        data, left = [], letters
        for t in all_:
            s = symbols(t)[:left]
            data.append(s)
            left -= len(s) + 1
            if left <= 0:
                break
        out[g] = suffix_automaton(b"\x00".join(data))
    return out


def _prose(text: str) -> str:
    plain = untagged(text)
    return "".join(plain[s:e] for s, e, prose in units(text) if prose)


def train(labelled: Iterable[tuple[str, str]], letters: int = SAMPLE_LETTERS) -> dict[str, array]:
    """Automata per language from (language, text) pairs, some of which may be labelled wrongly."""
    texts: dict[str, list[str]] = defaultdict(list)
    for g, t in labelled:
        p = _prose(t)
        if len(p) >= MIN_PASSAGE:
            texts[g].append(p)
    texts = {g: texts[g] for g in LANGUAGES if texts.get(g)}
    if len(texts) < 2:
        return _automata(texts, letters)
    for _ in range(2):
        halves = [{g: all_[k::2] for g, all_ in texts.items()} for k in (0, 1)]
        models = [_automata({g: x for g, x in h.items() if x}, letters // 4) for h in halves]
        kept = {}
        for g, all_ in texts.items():
            good = {}
            for k in (0, 1):
                for i, found in zip(range(k, len(all_), 2), passages_of(all_[k::2], models[1 - k])):
                    mine = "".join(all_[i][a:b] for h, a, b, _ in found if h == g)
                    if len(mine) >= MIN_PASSAGE:
                        good[i] = mine
            kept[g] = [good[i] for i in sorted(good)] or all_
        texts = kept
    return _automata(texts, letters)


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """Up to `rows` labelled texts of each language, the ones with the smallest hash, of 200 to 6000 characters; the bound holds for any input.

    The hashes are chosen first, without the texts, of which each task hands on `rows` for a language at most; a second
    scan fetches the texts of those chosen.
    """
    label = F.regexp_replace(F.lower(F.trim(F.col(lang))), "_", "-")
    spelled = F.create_map(*(F.lit(x) for name, code in _SPELLED.items() for x in (name, code)))
    code = F.coalesce(F.try_element_at(spelled, label), F.try_element_at(spelled, F.substring_index(label, "-", 1)))
    own = docs.filter(F.length(text).between(200, 6000)).select(code.alias("g"), F.xxhash64(doc_id, text).alias("h"), F.col(text).alias("t")).filter("g is not null")
    place = F.row_number().over(Window.partitionBy("g").orderBy("h"))
    last = {r.g: r.h for r in own.select("g", "h").withColumn("k", place).filter(F.col("k") <= rows).groupBy("g").agg(F.max("h").alias("h")).collect()}
    if not last:
        return []
    bound = F.try_element_at(F.create_map(*(F.lit(x) for g, h in last.items() for x in (g, h))), F.col("g"))
    chosen = own.filter(F.col("h") <= bound).groupBy("g", "h").agg(F.min("t").alias("t"))  # rows that repeat count once
    return [(r.g, r.t) for r in chosen.orderBy("g", "h").collect()]


def languages(docs: DataFrame, model: dict[str, array] | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per passage of prose in one language: doc_id, label (as named by `lang`, or null), passage (from 0), lang (null if it is none of LANGUAGES), start, end, n_chars (without tags), confidence (by how large a share the language needs fewer phrases than the next), counts (whether the document holds the language by it) and languages (how many it holds).

    Documents with null, blank or short texts, or without prose, have no row.
    """
    model = train(training_sample(docs, doc_id=doc_id, text=text, lang=lang)) if model is None else model
    held = docs.sparkSession.sparkContext.broadcast({g: a.tobytes() for g, a in model.items()})  # at most 6 x 2 x SAMPLE_LETTERS x 27 x 4 bytes
    kind = docs.schema[doc_id].dataType.simpleString()
    names = [doc_id, "label", "passage", "lang", "start", "end", "n_chars", "confidence", "counts", "languages"]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = {}
        for g, b in held.value.items():
            own[g] = array("i")
            own[g].frombytes(b)
        for frame in frames:
            out = []
            for d, l, found in zip(frame[doc_id], frame[lang], judge_all(list(frame[text]), own)):
                many = len({g for g, *_, counts in found if counts})
                out += [(d, label_of(l), k, g, s, e, n, round(c, 6), counts, many) for k, (g, s, e, c, n, counts) in enumerate(found)]
            yield pd.DataFrame(out, columns=names)

    schema = f"{doc_id} {kind}, label string, passage int, lang string, start int, end int, n_chars int, confidence double, counts boolean, languages int"
    return spread(docs.select(doc_id, text, lang)).mapInPandas(run, schema)


def mislabelled(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang) of the languages that documents hold which have no label, a wrong one, or several languages. A document's passages come from one task, so that what is told apart here was summed there."""
    wrong = found.filter("counts and (label is null or languages > 1 or label != lang)")
    return wrong.select(doc_id, "lang").distinct()
