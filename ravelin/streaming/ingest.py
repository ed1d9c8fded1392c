"""A saved index that grows with a stream of pages: every micro-batch becomes a part of it, and many parts are put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ravelin.operators.indexer import build_index, new_part
from ravelin.schemas import PAGES_IN
from ravelin.sources.store import MANY_PARTS, add, load, parts, save


def landing_stream(spark: SparkSession, folder: str, max_files: int = 64) -> DataFrame:
    """Pages (``ord``, ``url``, ``title``, ``body``) from Parquet files as they land in ``folder``."""
    return spark.readStream.schema(PAGES_IN).option("maxFilesPerTrigger", max_files).parquet(folder)


def append_batch(path: str):
    """A sink function: pages whose url the index has already, from an earlier batch or a repeated delivery, are left out.

    A batch that is delivered again therefore changes nothing, which makes the sink idempotent. ``ord`` gives the order
    within a batch.
    """

    def run(pages: DataFrame, batch_id: int) -> None:
        spark = pages.sparkSession
        index = load(spark, path)
        fresh = build_index(pages) if index is None else new_part(index, pages)
        if fresh.stats.first()["next_doc_id"] == (1 if index is None else index.stats.first()["next_doc_id"]):
            return  # nothing new
        add(fresh, path)
        if len(parts(spark, path)) >= MANY_PARTS:
            save(load(spark, path), path)

    return run


def start_ingest(pages: DataFrame, index_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream of pages to the index at ``index_path``."""
    writer = pages.writeStream.foreachBatch(append_batch(index_path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def live_outcomes(pages: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Counts per arrival window and kind of page for a stream with ``arrived_at``: how many are blank, how many have a body."""
    kind = F.when(F.trim(F.coalesce("url", F.lit(""))) == "", "err_url").when(F.trim(F.coalesce("body", F.lit(""))) == "", "err_body").otherwise("indexable")
    return (
        pages.withColumn("kind", kind)
        .withWatermark("arrived_at", watermark)
        .groupBy(F.window("arrived_at", "5 minutes"), "kind")
        .agg(F.count(F.lit(1)).alias("pages"))
    )
