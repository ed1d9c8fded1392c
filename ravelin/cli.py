"""python -m ravelin.cli -q QUERY --index DIR [--web PARQUET | --live]: search an index, building it first where that is needed."""

from __future__ import annotations

import argparse
import logging
import sys
import time
from collections.abc import Sequence
from functools import partial

from ravelin.app import SearchApp, search_with_fallback
from ravelin.operators.crawl import CrawlConfig, DeadlineExceeded, crawl, pages_to_index
from ravelin.operators.indexer import IndexTables, build_index, index_counts, outcomes
from ravelin.operators.parsing import QueryError
from ravelin.schemas import WEB
from ravelin.session import build_session
from ravelin.sources.seed import SeedError, resolve_seed
from ravelin.sources.store import load, save
from ravelin.sources.web import live_web

# Fixed value: the page to start from where no other is known.
DEFAULT_SEED = "https://en.wikipedia.org/wiki/Cristiano_Ronaldo"
DEADLINE_SECONDS = 120

log = logging.getLogger("ravelin")


def wrap(text: str, width: int) -> str:
    """Fill lines of ``width`` bytes with whole words; 0 or less: unchanged."""
    if width <= 0:
        return text
    lines: list[str] = []
    for word in text.split():
        if lines and len(lines[-1].encode()) + 1 + len(word.encode()) <= width:
            lines[-1] += f" {word}"
        else:
            lines.append(word)
    return "\n".join(lines)


def truncate(text: str, most: int) -> str:
    """The first ``most`` lines, the last one marked if any were dropped; 0 or less: empty."""
    if most <= 0:
        return ""
    lines = text.split("\n")
    if len(lines) <= most:
        return text
    return "\n".join([*lines[: most - 1], lines[most - 1].strip() + "..."])


def render(rows: Sequence, query: str, width: int, lines: int) -> str:
    """The answer as text."""
    if not rows:
        return "No results found"
    out = [f'\nTop {len(rows)} results for query: "{query}"\n']
    for r in rows:
        body = truncate(wrap(r["snippet"], width), lines)
        out.append(f"{r['rank']}) {r['title']}\n   URL: {r['url']}\n   Score: {r['score']:.6f}\n   {body}\n")
    return "\n".join(out)


def main(argv: Sequence[str] | None = None, get=None) -> int:
    parser = argparse.ArgumentParser(prog="ravelin")
    parser.add_argument("-q", default="", help="query")
    parser.add_argument("-k", type=int, default=10, help="results")
    parser.add_argument("-reindex", "--reindex", action="store_true", help="crawl and build even if there is an index")
    parser.add_argument("-body-lines", "--body-lines", type=int, default=8)
    parser.add_argument("-wrap", "--wrap", type=int, default=110)
    parser.add_argument("--index", default="index", help="folder of the saved index")
    parser.add_argument("--web", help="Parquet table of recorded pages: url, status, content_type, html")
    parser.add_argument("--live", action="store_true", help="crawl over the network instead of --web")
    parser.add_argument("--seed", help="page to start from, instead of asking for one")
    args = parser.parse_args(argv)
    logging.basicConfig(stream=sys.stderr, format="%(asctime)s %(message)s")
    log.setLevel(logging.INFO)
    spark = build_session()
    until = time.time() + DEADLINE_SECONDS

    def seed(strict: bool) -> str:
        if args.seed:
            return args.seed
        if not args.q:
            return DEFAULT_SEED
        try:
            return resolve_seed(args.q, get) if get else resolve_seed(args.q)
        except SeedError as e:
            if strict:
                raise
            log.warning("no seed for the query (%s), starting from the default", e)
            return DEFAULT_SEED

    def rebuild(strict: bool) -> IndexTables:
        if not args.web and not args.live:
            raise SeedError("there are no pages to crawl: give --web or --live")
        config = CrawlConfig(seed(strict), deadline_seconds=max(0.0, until - time.time()))
        web = partial(live_web, until=until) if args.live else spark.read.schema(WEB).parquet(args.web)
        try:
            result = crawl(spark, web, config)
        except DeadlineExceeded as e:
            log.error("crawl failed: %s", e.result.stats.first().asDict())
            raise
        pages = pages_to_index(result)
        log.info("crawl: %s", result.stats.first().asDict())
        log.info("index: %s", {r["status"]: r["pages"] for r in index_counts(outcomes(pages)).collect()})
        save(build_index(pages), args.index)
        return load(spark, args.index) or build_index(pages)

    try:
        index = load(spark, args.index)
        if args.reindex or index is None:
            index = rebuild(strict=False)
        if not args.q:
            print("The index is ready; ask it with -q")
            return 0
        if args.web or args.live:
            rows, _ = search_with_fallback(index, args.q, args.k, lambda _: rebuild(strict=True))
        else:
            rows = SearchApp(index).run(args.q, args.k).collect()
    except (QueryError, SeedError, TimeoutError, RuntimeError, ValueError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    print(render(rows, args.q, args.wrap, args.body_lines))
    return 0


if __name__ == "__main__":
    sys.exit(main())
