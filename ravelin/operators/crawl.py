"""Bounded breadth-first crawl over a table of pages, level by level, in the order a single worker would take."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions.urls import LinkPolicy
from ravelin.schemas import WEB
from ravelin.session import cut_lineage
from ravelin.sources.html import extract
from ravelin.sources.web import MAX_BYTES_PER_PAGE, fetched

# Limits of a crawl.
MAX_PAGES = 50
MAX_TOTAL_BYTES = 5 * 1024 * 1024
MAX_DEPTH = 3
WORKERS = 4


@dataclass(frozen=True)
class CrawlConfig:
    """Limits that aren't positive are replaced by the defaults; a crawl needs a seed on the policy's host."""

    seed: str
    max_pages: int = MAX_PAGES
    max_total_bytes: int = MAX_TOTAL_BYTES
    max_bytes_per_page: int = MAX_BYTES_PER_PAGE
    max_depth: int = MAX_DEPTH
    workers: int = WORKERS
    deadline_seconds: float | None = None
    policy: LinkPolicy = field(default_factory=LinkPolicy)

    def __post_init__(self):
        if not self.seed:
            raise ValueError("a seed is required")
        if urlsplit(self.seed).netloc != self.policy.host:
            raise ValueError(f"the seed must be on {self.policy.host}")
        for name, default in (("max_pages", MAX_PAGES), ("max_total_bytes", MAX_TOTAL_BYTES), ("max_bytes_per_page", MAX_BYTES_PER_PAGE), ("max_depth", MAX_DEPTH), ("workers", WORKERS)):
            if getattr(self, name) <= 0:
                object.__setattr__(self, name, default)


class DeadlineExceeded(TimeoutError):
    """The crawl ran out of time; ``result`` has what it got by then."""

    def __init__(self, result: CrawlResult):
        super().__init__("the crawl's deadline has passed")
        self.result = result


@dataclass(frozen=True)
class CrawlResult:
    """``pages``: ``ord``, ``url``, ``depth``, ``status``, ``bytes``, ``links``, ``title``, ``body``, ``err`` of every scheduled page.

    ``stats`` is one row of counters; only pages without ``err`` are successes and count bytes.
    """

    pages: DataFrame
    stats: DataFrame

    def successes(self) -> DataFrame:
        return self.pages.filter(F.col("err").isNull())


def first_seen(found: DataFrame) -> DataFrame:
    """Of rows (``url``, ``depth``, ``ord``) the first of each url by ``ord``; null urls are left out."""
    first = found.filter(F.col("url").isNotNull()).groupBy("url").agg(F.min_by(F.struct("depth", "ord"), "ord").alias("_f"))
    return first.select("url", F.col("_f.depth").alias("depth"), F.col("_f.ord").alias("ord"))


def unseen(found: DataFrame, visited: DataFrame) -> DataFrame:
    """``first_seen`` rows whose url ``visited`` doesn't have."""
    return first_seen(found).join(visited.select("url"), "url", "left_anti")


def admitted(queue: DataFrame, max_pages: int, max_depth: int) -> DataFrame:
    """The first ``max_pages`` entries of a queue by ``ord`` whose depth is allowed, with their place ``slot`` from 1."""
    best = queue.filter(F.col("depth") <= max_depth).orderBy("ord").limit(max_pages)
    return best.withColumn("slot", F.row_number().over(Window.orderBy("ord")))


def within_bytes(fetched_pages: DataFrame, budget: int) -> DataFrame:
    """Pages in order of ``ord`` as long as those before them took fewer than ``budget`` bytes; failures take none.

    The window runs over the pages of one level, of which ``admitted`` has left ``max_pages`` at most.
    """
    before = F.sum(F.coalesce("bytes", F.lit(0))).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return fetched_pages.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < budget).drop("_before")


def crawl_stats(pages: DataFrame, started: float, finished: float) -> DataFrame:
    ok = F.col("err").isNull()
    return pages.agg(
        F.count(F.lit(1)).alias("scheduled"),
        F.count(F.when(ok, 1)).alias("successful"),
        F.count(F.when(~ok, 1)).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).alias("total_bytes"),
        F.timestamp_seconds(F.lit(started)).alias("started_at"),
        F.timestamp_seconds(F.lit(finished)).alias("finished_at"),
    )


def crawl(spark: SparkSession, web: DataFrame | Callable[[DataFrame], DataFrame], config: CrawlConfig) -> CrawlResult:
    """Crawl ``web`` from the seed: a table of responses, or a function that gets the responses to a table of urls, as ``live_web``.

    Each level is one plan: fetch, extract, explode links, keep the first unseen of each.

    The deadline is looked at before each level and, where pages come from a function that stops asking at it, within one.
    ``max_depth`` + 1 levels at most, each of at most ``max_pages`` pages; what a level found is written to the checkpoint
    folder before the next begins. The seed enters the seen set as it is given. Links of failed pages aren't followed.
    """
    started = time.time()
    queue = spark.createDataFrame([(config.seed, 0, 0)], "url string, depth int, ord long")
    visited, pages = queue.select("url"), None
    pages_left, bytes_left, next_ord = config.max_pages, config.max_total_bytes, 1
    late = False
    for depth in range(config.max_depth + 1):
        if config.deadline_seconds is not None and time.time() - started > config.deadline_seconds:
            late = True
            break
        batch = admitted(queue, pages_left, config.max_depth).repartition(config.workers)
        responses = cut_lineage(web(batch.select("url"))) if callable(web) else web  # each page is asked for once
        got = fetched(batch, responses, config.max_bytes_per_page, few=True)
        late = config.deadline_seconds is not None and time.time() - started > config.deadline_seconds
        if late and callable(web):  # what wasn't asked for any more wasn't scheduled
            got = got.join(F.broadcast(responses.select("url").distinct()), "url", "left_semi")
        level = cut_lineage(extract(within_bytes(got, bytes_left), config.policy).drop("html", "slot"))
        pages = level if pages is None else pages.unionByName(level)
        taken = level.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("err").isNull(), F.col("bytes"))), F.lit(0)).alias("b")).first()
        pages_left, bytes_left = pages_left - taken["n"], bytes_left - taken["b"]
        if late or depth == config.max_depth or pages_left <= 0 or bytes_left <= 0:
            break
        links = level.filter(F.col("err").isNull()).select(F.col("ord").alias("_parent"), F.posexplode("links").alias("_place", "url"))
        found = links.groupBy("url").agg(F.min(F.struct("_parent", "_place")).alias("_at")).join(visited, "url", "left_anti")
        # no more than the pages that may still be scheduled can ever be taken from this level
        order = Window.orderBy("_at")
        best = found.orderBy("_at").limit(pages_left).withColumn("ord", F.row_number().over(order).cast("long") + next_ord - 1)
        queue = cut_lineage(best.select("url", F.lit(depth + 1).alias("depth"), "ord"))
        visited = visited.unionByName(found.select("url"))
        n = queue.count()
        if n == 0:
            break
        next_ord += n
    if pages is None:
        nothing = spark.createDataFrame([], WEB)
        pages = extract(fetched(queue.limit(0), nothing, config.max_bytes_per_page), config.policy).drop("html")
    result = CrawlResult(pages.select("ord", "url", "depth", "status", "bytes", "links", "title", "body", "err"), crawl_stats(pages, started, time.time()))
    if late:
        raise DeadlineExceeded(result)
    return result


def pages_to_index(result: CrawlResult) -> DataFrame:
    """Successful pages as the indexer takes them."""
    return result.successes().select("ord", "url", "title", "body")
