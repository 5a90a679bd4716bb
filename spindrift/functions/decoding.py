"""Bytes to text, the way the loaders name encodings."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
#: Byte order marks, longest first.
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def decode_bytes(raw: bytes | None, content_type: str | None) -> str | None:
    """The text of a payload: a byte order mark decides, else the charset of the content type, else UTF-8.

    Marks are taken off; bytes that do not decode become U+FFFD. Null gives null, no bytes give an empty text.
    """
    if raw is None:
        return None
    raw = bytes(raw)
    for mark, name in _MARKS:
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    found = _CHARSET.search(content_type or "")
    try:
        name = codecs.lookup(found.group(1)).name if found else "utf-8"
    except LookupError:
        name = "utf-8"
    return raw.decode(name, "replace").removeprefix("﻿")


@F.pandas_udf(T.StringType())
def _decoded(raw: pd.Series, content_type: pd.Series) -> pd.Series:
    return pd.Series([decode_bytes(r, c) for r, c in zip(raw, content_type)], dtype=object)


def decoded(raw: Column, content_type: Column) -> Column:
    """Column form of decode_bytes."""
    return _decoded(raw, content_type)
