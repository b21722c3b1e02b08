"""What the operators share: reading, shared folders, and numpy batches."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..shared import keep as cut
from ..shared import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key of over one in so many rows is hot; there are at most so many of those.
HOT_SHARE = 1000


def lookup(rows: DataFrame, table: DataFrame, on: list[str], n: str, how: str = "left") -> DataFrame:
    """``rows`` joined with ``table``, which has a row for each key and how often the key stands among ``rows``
    (column ``n``, left out).  Hot keys, of which there are ``HOT_SHARE`` at most, are broadcast, so that their rows
    stay where they are; only the others are shuffled.  ``how``: left or inner.  Reads ``rows`` and ``table`` twice."""
    total = table.agg(F.sum(n)).first()[0] or 0
    hot, more = F.col(n) * HOT_SHARE > total, [c for c in table.columns if c not in (*on, n)]
    few = table.where(hot).select(*on, *more, F.lit(True).alias("_hot"))
    told = rows.join(F.broadcast(few), on, "left")
    rest = told.where("_hot is null").drop("_hot", *more).join(table.where(~hot).select(*on, *more), on, how)
    return told.where("_hot").drop("_hot").unionByName(rest)


def fresh_path(spark: SparkSession, name: str) -> str:
    return new_path(spark, name)


def released(run):
    """``run`` over a task's batches; at its end what the worker does not use any more goes back to the system.  Workers live on
    from stage to stage, and allocators keep what texts once took."""

    def whole(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim is not None:
            trim(0)

    return whole


#: Texts that an operator's function sees at once.  Spark bounds the bytes of a batch, not the work on it.
SLICE = 512


def per_text(df: DataFrame, text: str, fn, kinds: str, carried: dict | None = None) -> DataFrame:
    """One row for each row of ``df``: the ``carried`` columns (name -> column; they may be null and have any
    type), and what ``fn`` makes of the texts: from a list of texts (null as the empty string) a list of
    columns, of the types in ``kinds``."""
    kept = df.select(*[c.alias(n) for n, c in (carried or {}).items()], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    own = StructType.fromDDL(kinds)
    whole = StructType([*kept.schema.fields[:-1], *own.fields])
    types = [f.type for f in to_arrow_schema(own)]
    names = whole.names

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                made = fn(b.column(b.num_columns - 1).to_pylist())
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], names=names)

    return kept.mapInArrow(released(run), whole)


def id_of(key: str):
    """A key as a whole number under a fixed name, so that no other column can clash."""
    return {"doc_id": F.col(key).cast("long")}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def rows_where(df: DataFrame, text: str, accept) -> DataFrame:
    """The rows, with all their columns, whose text ``accept`` says yes to; it takes a list of texts (null as
    the empty string).  Each row is judged by itself, so ids may be null or repeat."""
    at = df.columns.index(text)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                b = batch.slice(i, SLICE)
                yield b.filter(pa.array([bool(x) for x in accept([t or "" for t in b.column(at).to_pylist()])], pa.bool_()))

    return df.mapInArrow(released(run), df.schema)


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` written to the shared folder with a number for each row: every later read has the same numbers.  ``name`` must
    not be one of its columns."""
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    at = fresh_path(df.sparkSession, "rows")
    df.withColumn(name, F.monotonically_increasing_id()).write.parquet(at)
    return df.sparkSession.read.parquet(at)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or it with as many underscores more as it takes for a name that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
