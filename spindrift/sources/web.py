"""Pages by address, as rows."""

from __future__ import annotations

import datetime as dt
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "source string, raw binary, status_code int, content_type string, fetched_at timestamp, error string"


def get(url: str, timeout: float = 30.0) -> tuple[bytes, int, str | None]:
    """Body, status and content type of an http(s) address; other schemes and statuses from 400 are errors."""
    if not url.lower().startswith(("http://", "https://")):
        raise ValueError(f"no http address: {url}")
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
        return r.read(), r.status, r.headers.get("Content-Type")


def fetched(addresses: DataFrame, fetch: Callable[[str], tuple[bytes, int, str | None]] = get, column: str = "url") -> DataFrame:
    """A row for each address, fetched in the tasks: the page, or what went wrong. A task that is run again fetches again."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for url in frame[column]:
                now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
                try:
                    body, status, kind = fetch(url)
                    out.append((url, body, status, kind, now, None))
                except urllib.error.HTTPError as e:
                    out.append((url, None, e.code, None, now, f"HTTPError: {e.code}"))
                except Exception as e:  # noqa: BLE001
                    out.append((url, None, None, None, now, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"status_code": "Int32"})

    return addresses.select(column).mapInPandas(run, SCHEMA)
