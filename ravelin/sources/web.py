"""Fetching pages: from a table of recorded responses or over the network, by the same rules."""

from __future__ import annotations

import time
from collections.abc import Iterator
from http.client import HTTPException
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BYTES_PER_PAGE = 512 * 1024
TIMEOUT_SECONDS = 12
USER_AGENT = "ravelin/0.1"


def fetched(requests: DataFrame, web: DataFrame, max_bytes: int = MAX_BYTES_PER_PAGE, few: bool = False) -> DataFrame:
    """``requests`` (with ``url``) plus ``status``, ``bytes``, ``html``, ``err``, looked up in ``web``.

    A url that ``web`` doesn't have, a status outside 200-299, a missing content type and one that is neither
    ``text/html`` nor ``application/xhtml+xml`` are errors. The body is cut at ``max_bytes`` without notice; a character
    cut in the middle becomes U+FFFD. With several responses for one url any one with the largest status counts.
    Only responses that are asked for are grouped. ``few``: the requests are known to be few, as in a crawl, and are
    broadcast to the responses.
    """
    asked = requests.select("url").distinct()
    web = web.join(F.broadcast(asked) if few else asked, "url", "left_semi")
    last = web.groupBy("url").agg(F.max_by(F.struct("status", "content_type", "html"), F.struct("status", "html")).alias("r"))
    rows = requests.join(last, "url", "left")
    status, kind, html = F.col("r.status"), F.lower(F.col("r.content_type")), F.coalesce(F.col("r.html"), F.lit(""))
    err = (
        F.when(F.col("r").isNull(), "not found")
        .when(status.isNull() | ~status.between(200, 299), F.concat(F.lit("status "), F.coalesce(status.cast("string"), F.lit("unknown"))))
        .when(F.coalesce(kind, F.lit("")) == "", "no content type")
        .when(~kind.contains("text/html") & ~kind.contains("application/xhtml+xml"), F.concat(F.lit("content type "), kind))
    )
    size = F.least(F.octet_length(html), F.lit(max_bytes)).cast("long")
    short = F.make_valid_utf8(F.substring(F.encode(html, "UTF-8"), 1, max_bytes).cast("string"))
    rows = rows.withColumn("err", err).withColumn("status", status)
    fine = F.col("err").isNull()
    return rows.select(
        *requests.columns,
        "status",
        F.when(fine, size).alias("bytes"),
        F.when(fine, F.when(F.octet_length(html) <= max_bytes, html).otherwise(short)).alias("html"),
        "err",
    )


def live_web(urls: DataFrame, max_bytes: int = MAX_BYTES_PER_PAGE, timeout: float = TIMEOUT_SECONDS, user_agent: str = USER_AGENT, until: float | None = None) -> DataFrame:
    """Responses (``url``, ``status``, ``content_type``, ``html``) to GET requests for ``url``, one by one in each partition.

    A request that fails without a status has none. No more than ``max_bytes`` of a body are read; bytes that are no UTF-8
    become U+FFFD. The number of partitions of ``urls`` is the number of workers. No request begins after ``until`` (seconds
    since the epoch); urls that are left then have no row.
    """

    def get(url: str) -> tuple[str, int | None, str | None, str | None]:
        try:
            with urlopen(Request(url, headers={"User-Agent": user_agent}), timeout=timeout) as r:  # noqa: S310
                return url, r.status, r.headers.get("Content-Type"), r.read(max_bytes).decode("utf-8", "replace")
        except HTTPError as e:
            return url, e.code, e.headers.get("Content-Type"), None
        except (OSError, ValueError, HTTPException):
            return url, None, None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pd.DataFrame([get(u) for u in batch["url"] if until is None or time.time() < until], columns=["url", "status", "content_type", "html"])
            yield rows.astype({"status": "Int32"})

    return urls.select("url").mapInPandas(run, "url string, status int, content_type string, html string")
