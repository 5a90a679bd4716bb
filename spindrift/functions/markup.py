"""Markup, JSON leaves and one-line summaries: what columns cannot say, over Arrow batches."""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that are not shown, and elements that begin a line.
UNSEEN = "script style head".split()
LINES = "p div tr br li h1 h2 h3 table td".split()

_PART = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
_RAW = re.compile(r"<(script|style)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)", re.S | re.I)


def shown_text(markup: str) -> str:
    """The text a page shows: without scripts, styles and its head, a new line at block elements, references resolved (also ones written twice), white space tidied."""
    body, out, at, depth = _RAW.sub("", markup), [], 0, 0
    for m in _PART.finditer(body):
        if not depth:
            out.append(html.unescape(body[at : m.start()]))
        at = m.end()
        tag, end = (m["tag"] or "").lower(), m["end"]
        if tag in UNSEEN:
            depth = max(0, depth - 1) if end else depth + 1
        elif tag in LINES and not end:
            out.append("\n")
    if not depth:
        out.append(html.unescape(body[at:]))
    text = re.sub(r"[ \t\xa0]+", " ", html.unescape("".join(out)))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n[ \t]*", "\n", text))


def densest_slice(text: str, pattern: str, length: int, window: int = 1500) -> str:
    """`length` characters from the match with most letters in the `window` behind its start; of equal ones the first. No match gives an empty text."""
    starts = [m.start() for m in re.finditer(pattern, text)]
    if not starts:
        return ""
    letters = np.concatenate([[0], np.cumsum(np.fromiter(map(str.isalpha, text), dtype=np.int64, count=len(text)))])
    ends = np.minimum(np.array(starts) + window, len(text))
    best = starts[int(np.argmax(letters[ends] - letters[starts]))]
    return text[best : best + length]


def scrubbed_leaves(value: Any, patterns: list[re.Pattern], token: str) -> Any:
    """A JSON value with every match of the patterns in its texts replaced; keys, numbers, flags and nulls stay."""
    if isinstance(value, str):
        for p in patterns:
            value = p.sub(token, value)
        return value
    if isinstance(value, list):
        return [scrubbed_leaves(x, patterns, token) for x in value]
    return {k: scrubbed_leaves(x, patterns, token) for k, x in value.items()} if isinstance(value, dict) else value


# Arguments that say what a call is about, and defaults that say nothing.
SUBJECTS = "query pattern path file_path section entity name".split()
SILENT = {"offset": 0}


def args_line(args: dict[str, Any], limit: int = 64) -> str:
    """A call's arguments in a line: its subject in quotes, the others as key=value, without empty and default ones."""

    def short(text: str, n: int) -> str:
        flat = text.replace("\n", " ").strip()
        return flat if len(flat) <= n else flat[: n - 1].rstrip() + "…"

    subject = next((k for k in SUBJECTS if isinstance(args.get(k), str) and args[k].strip()), None)
    lead = [] if subject is None else [f'"{short(args[subject], 40)}"']
    rest = [(k, v) for k, v in args.items() if k != subject and v not in (None, "", [], {}) and not (k in SILENT and v == SILENT[k])]
    line = " · ".join(lead + [f"{k}={short(v, 24) if isinstance(v, str) else repr(v)}" for k, v in rest])
    return line if len(line) <= limit else line[: limit - 1].rstrip() + "…"


_STREAM = re.compile(rb"<<(?P<head>(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(?P<body>.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]+>|\bT[*dDm]\b|\bET\b|'|\"", re.S)
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(.))", re.S)


def pdf_text(raw: bytes) -> str:
    """The text that the pages of a PDF show, in the order of its streams, for fonts with a plain encoding; compressed streams are inflated, unreadable ones skipped. A page ends with a form feed."""
    pages = []
    for m in _STREAM.finditer(raw):
        body = m["body"]
        if b"FlateDecode" in m["head"]:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body:
            continue
        line: list[str] = []
        for s in _SHOWN.finditer(body):
            token = s.group(0)
            if token[:1] == b"(":
                plain = _ESCAPE.sub(lambda e: bytes([int(e[1], 8) & 255]) if e[1] else {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(e[2], e[2]), token[1:-1])
                line.append(plain.decode("cp1252", "replace"))
            elif token[:1] == b"<":
                data = bytes.fromhex(token[1:-1].decode().replace(" ", "").replace("\n", "").ljust(2, "0"))
                line.append(data.decode("utf-16-be" if len(data) > 1 and data[0] == 0 else "cp1252", "replace"))
            elif line and line[-1] != "\n":
                line.append("\n")
        pages.append("".join(line).strip())
    return "\f".join(pages)


def _column(f: Callable[[Any], Any], kind: str = "string") -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for frame in frames:
            yield pd.Series([None if v is None else f(v) for v in frame], dtype=object)

    return run


def _parsed(f: Callable[[Any], str]) -> Callable[[str], str | None]:
    def run(text: str) -> str | None:
        try:
            return f(json.loads(text))
        except ValueError:
            return None

    return run


def shown(markup: Column) -> Column:
    return _column(shown_text)(markup)


def densest(text: Column, pattern: str, length: int) -> Column:
    return _column(lambda t: densest_slice(t, pattern, length))(text)


def scrubbed_json(payload: Column, patterns: list[str], token: str = "[REDACTED]") -> Column:
    """JSON text with its texts scrubbed; what is no JSON is scrubbed as a text."""
    compiled = [re.compile(p) for p in patterns]
    whole = _column(_parsed(lambda v: json.dumps(scrubbed_leaves(v, compiled, token), ensure_ascii=False)))(payload)
    return F.coalesce(whole, _column(lambda t: scrubbed_leaves(t, compiled, token))(payload))


def call_line(args: Column) -> Column:
    """args_line() of JSON objects; null for anything else."""
    return _column(_parsed(lambda v: args_line(v) if isinstance(v, dict) else None))(args)


def pdf_shown(raw: Column) -> Column:
    return _column(lambda b: pdf_text(bytes(b)))(raw)
