"""Links of a wiki: which are articles, and what address a reference on a page stands for."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import quote, unquote_to_bytes, urljoin, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinkPolicy:
    """The host and path below which articles live."""

    host: str = "en.wikipedia.org"
    prefix: str = "/wiki/"

    @property
    def root(self) -> str:
        return f"https://{self.host}{self.prefix}"


#: Parts of a reference: scheme, host, path, query, fragment.
_REFERENCE = re.compile(r"(?s)(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?")
_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")
_AS_IT_STANDS = re.compile(r"[A-Za-z0-9\-._~!$&'()*+,;=:@\[\]/%]*")


def encoded_path(path: str) -> str:
    """A path as an address writes it: as it stands if all its characters may, else decoded and encoded anew."""
    if _AS_IT_STANDS.fullmatch(path):
        return path
    return quote(unquote_to_bytes(path), safe="$&+,/:;=@")


def resolve_link(href: str | None, base: str, policy: LinkPolicy) -> str:
    """The absolute address of ``href`` on page ``base`` without fragment and query; empty if it can't be an article.

    Characters that can't stand in a path are encoded, so one article has one address. References with control characters,
    with broken escapes in path or fragment, or with a scheme but no host are refused.
    """
    if not href or any(c < " " or c == "\x7f" for c in href):
        return ""
    scheme, host, path, _, fragment = _REFERENCE.fullmatch(href).groups()
    if _BAD_ESCAPE.search(path) or _BAD_ESCAPE.search(fragment or "") or (scheme is not None and host is None):
        return ""
    reference = (f"{scheme}:" if scheme else "") + (f"//{host}" if host is not None else "") + encoded_path(path)
    try:
        parts = urlsplit(urljoin(base, reference))
    except ValueError:
        return ""
    if parts.scheme not in ("http", "https") or parts.netloc != policy.host or not parts.path.startswith(policy.prefix):
        return ""
    return urlunsplit((parts.scheme, parts.netloc, parts.path, "", ""))


def canonical_link(url: Column, policy: LinkPolicy) -> Column:
    """The same for absolute addresses, as an expression: trimmed, without fragment and query; null if it can't be an article."""
    bare = F.regexp_replace(F.trim(url), r"[?#].*$", "")
    fits = bare.rlike(f"^https?://{policy.host.replace('.', '[.]')}{policy.prefix}")
    return F.when(fits, bare)


def is_article(url: Column, policy: LinkPolicy) -> Column:
    """Whether an address names an article: https, no fragment or query, a title that isn't the main page, has no namespace and isn't a disambiguation page."""
    title = F.substring(url, len(policy.root) + 1, 2**31 - 1)
    return F.coalesce(
        url.startswith(policy.root)
        & ~url.contains("#")
        & ~url.contains("?")
        & (title != "")
        & (title != "Main_Page")
        & ~title.contains(":")
        & ~F.lower(title).contains("(disambiguation)"),
        F.lit(False),
    )
