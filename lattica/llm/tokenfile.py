"""Token ids as Parquet list columns.

Documents are ranged by doc_id, encoded, and written in ascending order: ``doc_id``,
``n_tokens``, ``first`` (ids before the document in its file), ``part`` and the list column
``ids``.  Page version 2 without dictionaries gives delta (DELTA_BINARY_PACKED) pages; with
``encoding="dictionary"`` ids are dictionary-coded.  Row groups and pages have set sizes, and
the writer leaves column and offset indexes, so that a reader of some doc_ids or of the
metadata skips the other pages.  Spark's own writer commits whole tasks: a lost executor
costs a repeated task, never a torn file.

Null and empty texts are documents of the end id alone; repeated rows are written as often as
given (in order of their text's hash); rows without doc_id come first; an empty table gives an
empty file set; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, id_of, released
from .tokens import encoder

ROW_GROUP = 16 << 20
PAGE = 64 << 10
#: Texts that are encoded at once.
TEXTS = 1024
FIELDS = "doc_id long, n_tokens long, first long, part int, ids array<int>"


def write(documents: DataFrame, to: str, path: str, end_id: int, key: str = "doc_id", text: str = "text", encoding: str = "delta") -> None:
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc, end, first = encoder(path), np.array([end_id], dtype="<u4").tobytes(), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                b = batch.slice(i, TEXTS)
                ids = [x + end for x in enc.encode(b.column("text").to_pylist())]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(first + ends - n), pa.array(np.full(len(n), part, np.int32)), lists], names=["doc_id", "n_tokens", "first", "part", "ids"])
                first += int(n.sum())

    ranged = documents.select(*[c.alias(n) for n, c in id_of(key).items()], F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).withColumn("nth", F.monotonically_increasing_id())
    # The last tells copies of one row apart, so that they can be dealt to several files.
    ranged = ranged.repartitionByRange("doc_id", "h", "nth").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    out = ranged.mapInArrow(released(run), FIELDS).write.option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE).option("compression", "zstd")
    out = out.option("parquet.enable.dictionary", "true") if encoding == "dictionary" else out.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "PARQUET_2_0")
    out.parquet(to)


def metadata(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, n_tokens, start: reads no token page."""
    m = spark.read.schema(FIELDS).parquet(at).select("doc_id", "n_tokens", "first", "part")
    sums = m.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return m.join(before, "part").select("doc_id", "n_tokens", (F.col("first") + F.col("before")).alias("start"))


def read(spark: SparkSession, at: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, ids; some documents only, by the pages' minima and maxima, if asked for."""
    df = spark.read.schema(FIELDS).parquet(at)
    return (df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))).select("doc_id", "ids")


def checked(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from the files' lists."""

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            lists = b.column("ids")
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("first"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "first", "n_tokens", "ids_crc32"])

    docs = spark.read.schema(FIELDS).parquet(at).select("doc_id", "part", "first", "ids").mapInArrow(run, "doc_id long, part int, first long, n_tokens long, ids_crc32 long")
    sums = spark.read.schema(FIELDS).parquet(at).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return docs.join(before, "part").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def store(documents: DataFrame, path: str, end_id: int, **more) -> DataFrame:
    """Write to a new folder among the shared ones, then read back."""
    spark = documents.sparkSession
    at = fresh_path(spark, "tokens")
    write(documents, at, path, end_id, **more)
    return checked(spark, at)
