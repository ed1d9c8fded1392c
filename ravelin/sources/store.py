"""Saved indexes: a folder of numbered versions and a pointer to the current one.

A version holds Parquet tables ``documents``, ``terms`` (with ``dl``) and ``stats``. The pointer names the parts that make up the
index: one version that was saved whole, and those that were added since, each with its own documents and terms; the
totals of all are the ``stats`` of the last. A version is written whole before the pointer moves, so a reader never sees half
an index and a failed save changes nothing. Versions that neither the pointer nor the one before it names are deleted.
``terms`` is range-partitioned and sorted by term and ``documents`` by id, so a query reads only the row groups of its
terms and of its best documents.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ravelin.operators.indexer import IndexTables, documents_of, stats_of
from ravelin.schemas import DOCUMENTS, POSTINGS, STATS
from ravelin.session import shuffles_removed

_POINTER = "_CURRENT"
#: An index of so many parts should be saved whole again.
MANY_PARTS = 16


class EmptyIndex(RuntimeError):
    """An empty index isn't saved over one that has documents."""


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _pointer(spark: SparkSession, path: str) -> dict | None:
    """``version`` and ``parts``, or None if nothing has been saved."""
    jvm, where, files = _files(spark, path)
    pointer = jvm.org.apache.hadoop.fs.Path(where, _POINTER)
    if not path or not files.exists(pointer):
        return None
    stream = files.open(pointer)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current_version(spark: SparkSession, path: str) -> int | None:
    """Number of the last version; None if nothing has been saved."""
    pointer = _pointer(spark, path)
    return pointer and pointer["version"]


def parts(spark: SparkSession, path: str) -> list[int]:
    """Versions that make up the index."""
    pointer = _pointer(spark, path)
    return pointer["parts"] if pointer else []


def _point(spark: SparkSession, path: str, pointer_to: dict) -> None:
    jvm, where, files = _files(spark, path)
    fresh, pointer = jvm.org.apache.hadoop.fs.Path(where, f"{_POINTER}.new"), jvm.org.apache.hadoop.fs.Path(where, _POINTER)
    stream = files.create(fresh, True)
    stream.write(bytearray(json.dumps(pointer_to).encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fresh, pointer, options)


def _write(index: IndexTables, folder: str) -> None:
    """Ranges are found by running their input once before; of an index that isn't saved yet that is no counting of words.

    Lengths are counted after texts are placed, postings are written once before they are, and the totals are those of the
    documents written.
    """
    spark = index.documents.sparkSession
    postings, stats, unsorted = index.postings(), index.stats, f"{folder}/unsorted"
    with shuffles_removed(spark):
        if index.numbered is None:
            index.documents.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{folder}/documents")
        else:
            documents_of(index.numbered.repartitionByRange("doc_id").sortWithinPartitions("doc_id")).write.mode("overwrite").parquet(f"{folder}/documents")
            postings.write.mode("overwrite").parquet(unsorted)
            postings = spark.read.schema(POSTINGS).parquet(unsorted)
            stats = stats_of(spark.read.schema(DOCUMENTS).parquet(f"{folder}/documents"), index.before)
        postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{folder}/terms")
        stats.write.mode("overwrite").parquet(f"{folder}/stats")
    _, where, files = _files(spark, unsorted)
    files.delete(where, True)


def _move(spark: SparkSession, path: str, version: int, of: list[int]) -> None:
    """Point to the new version; what only older pointers named goes."""
    before = _pointer(spark, path)
    _point(spark, path, {"version": version, "parts": of})
    needed = {*of, version, *((before or {}).get("parts", []))}
    jvm, where, files = _files(spark, path)
    for status in files.listStatus(where):
        name = status.getPath().getName()
        if name.startswith("v=") and int(name[2:]) <= version and int(name[2:]) not in needed:
            files.delete(status.getPath(), True)


def save(index: IndexTables, path: str, replace_with_empty: bool = False) -> int:
    """Write ``index`` whole as the current version in folder ``path`` and return its number.

    An empty index doesn't replace one that has documents unless ``replace_with_empty`` is set.
    """
    if not path:
        raise ValueError("the index needs a folder")
    spark = index.documents.sparkSession
    before = current_version(spark, path)
    version = (before or 0) + 1
    folder = f"{path}/v={version}"
    _write(index, folder)
    if before is not None and not replace_with_empty and _documents(spark, folder) == 0 and _documents(spark, f"{path}/v={before}") > 0:
        raise EmptyIndex("the new index has no documents")
    _move(spark, path, version, [version])
    return version


def add(part: IndexTables, path: str) -> int:
    """Write a part (see ``new_part``) beside those that the index at ``path`` has; nothing else is written again."""
    spark = part.documents.sparkSession
    pointer = _pointer(spark, path)
    if pointer is None:
        return save(part, path)
    version = pointer["version"] + 1
    _write(part, f"{path}/v={version}")
    _move(spark, path, version, [*pointer["parts"], version])
    return version


def _documents(spark: SparkSession, folder: str) -> int:
    row = spark.read.schema(STATS).parquet(f"{folder}/stats").filter("id = 1").first()
    return row["total_docs"] if row else 0


def load(spark: SparkSession, path: str) -> IndexTables | None:
    """The current index, or None if there is none or it has no documents; nothing is tokenised again."""
    pointer = _pointer(spark, path)
    if pointer is None or _documents(spark, f"{path}/v={pointer['version']}") == 0:
        return None

    def table(name: str, schema, of: list[int]) -> DataFrame:
        return spark.read.schema(schema).parquet(*[f"{path}/v={v}/{name}" for v in of])

    weighted = table("terms", POSTINGS, pointer["parts"])
    return IndexTables(table("documents", DOCUMENTS, pointer["parts"]), weighted.drop("dl"), table("stats", STATS, [pointer["version"]]), weighted)
