"""Turning a free-text query into the address of the page to start from."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import Column
from pyspark.sql import functions as F

API = "https://en.wikipedia.org/w/api.php"
TIMEOUT_SECONDS = 5
USER_AGENT = "ravelin/0.1"


class SeedError(RuntimeError):
    """The query has no page to start from."""


def request_url(query: str, api: str = API) -> str:
    return f"{api}?" + urlencode({"action": "opensearch", "format": "json", "limit": "1", "namespace": "0", "origin": "*", "search": query})


def _get(url: str) -> tuple[int, str]:
    with urlopen(Request(url, headers={"User-Agent": USER_AGENT}), timeout=TIMEOUT_SECONDS) as response:  # noqa: S310
        return response.status, response.read().decode("utf-8", "replace")


def resolve_seed(query: str, get: Callable[[str], tuple[int, str]] = _get) -> str:
    """The first address that the search API gives for ``query``; ``get`` maps a url to a status and a body."""
    if not query:
        raise SeedError("the query is empty")
    try:
        status, body = get(request_url(query))
    except OSError as e:
        raise SeedError(f"the request failed: {e}") from e
    if status != 200:
        raise SeedError(f"status {status}: {body.strip()[:200]}")
    try:
        answer = json.loads(body)
    except ValueError as e:
        raise SeedError("the answer isn't JSON") from e
    if not isinstance(answer, list) or len(answer) < 4:
        raise SeedError("the answer has an unexpected form")
    if not isinstance(answer[3], list) or not answer[3]:
        raise SeedError("no results")
    if not isinstance(answer[3][0], str) or not answer[3][0]:
        raise SeedError("no valid address")
    return answer[3][0]


def seed_of_response(body: Column) -> Column:
    """The same for recorded answers in a column; null where there is none."""
    urls = F.from_json(F.get(F.from_json(body, "array<string>"), F.lit(3)), "array<string>")
    first = F.get(urls, F.lit(0))
    return F.when(first != "", first)
