"""Row numbers within groups of any size: a group may hold most of the rows, or all of them.

Rows are dealt by ranges of (group, order) and sorted in place, so that a large group spreads over many tasks.  Only
windows over one group within one range are opened; what a group has in earlier ranges is added from a table of one
row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import keep

#: Bits that ``monotonically_increasing_id`` has for rows within one partition.
_IN_RANGE = 33


def in_ranges(df: DataFrame, by: list[str], order: list[Column], sort: list[Column] | None = None) -> DataFrame:
    """``df`` sorted by (group, order), with ``_part`` (the range, in order) and ``_at`` (the place, in order), kept.
    ``sort`` orders rows within a range where that takes more than the order by which ranges are cut."""
    cols = [*[F.col(c).asc_nulls_first() for c in by], *order]
    dealt = df.repartitionByRange(*cols).sortWithinPartitions(*cols, *(sort or []))
    return keep(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))


def carried(counts: DataFrame, by: list[str]) -> dict[int, int]:
    """range -> rows that its first group has in earlier ranges, where there are any; ``counts`` has ``_part``, the
    group, ``_first`` (its first place) and ``_n``.  One row a range reaches the driver."""
    group = F.struct(*by) if by else F.lit(0)
    told = counts.groupBy("_part").agg(F.min_by(group, "_first").alias("first"), F.max_by(group, "_first").alias("last"), F.max_by("_n", "_first").alias("tail"), F.count("*").alias("groups"))
    out, before, last, any_yet = {}, 0, None, False
    for r in sorted(told.collect(), key=lambda r: r["_part"]):
        own = before if any_yet and r["first"] == last else 0
        if own:
            out[r["_part"]] = own
        before = r["tail"] + (own if r["groups"] == 1 else 0)
        last, any_yet = r["last"], True
    return out


def per_range(spark, values: dict[int, int], name: str) -> DataFrame:
    """(_part, name), small enough to be sent along: ranges are as many as partitions."""
    return spark.createDataFrame(sorted(values.items()), f"_part int, {name} long")


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with a number from 1 on for each row of a group, in the given order.  Null groups are a group; rows that
    tie are numbered in any order.  Columns whose names begin with ``_`` must not be ``_part``, ``_at``, ``_base``."""
    s = in_ranges(df, by, order)
    counts = s.groupBy("_part", *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    base = per_range(df.sparkSession, carried(counts, by), "_base")
    own = F.row_number().over(Window.partitionBy("_part", *by).orderBy("_at"))
    out = s.withColumn(name, own.cast("long")).join(F.broadcast(base), "_part", "left")
    # A range's first group is the one whose first row is the range's first.
    first = F.col("_at") - F.col(name) + 1 == F.shiftleft(F.col("_part").cast("long"), _IN_RANGE)
    return out.withColumn(name, F.col(name) + F.when(first, F.coalesce("_base", F.lit(0))).otherwise(0)).select(*df.columns, name)


def running(df: DataFrame, by: list[str], order: list[Column], column: str, name: str, how: str = "last") -> DataFrame:
    """``df`` with the last value of ``column`` that is not null, or the greatest (``how``: last, max), at or before each row
    of its group.  Each range scans its own rows; what earlier ranges leave to its first group is one value a range."""
    s = in_ranges(df, by, order)
    own = Window.partitionBy("_part", *by).orderBy("_at")
    best = F.max_by(column, F.when(F.col(column).isNotNull(), F.col("_at"))) if how == "last" else F.max(column)
    told = s.groupBy("_part", *by).agg(F.min("_at").alias("_first"), best.alias("_v"))
    group = F.struct(*by) if by else F.lit(0)
    ends = told.groupBy("_part").agg(F.min_by(group, "_first").alias("first"), F.max_by(group, "_first").alias("last"), F.max_by(F.struct("_v"), "_first").alias("tail"), F.count("*").alias("groups")).collect()
    carry, before, last, any_yet = [], None, None, False
    for r in sorted(ends, key=lambda r: r["_part"]):
        passed = before if any_yet and r["first"] == last else None
        if passed is not None:
            carry.append((r["_part"], passed))
        tail = r["tail"]["_v"]
        if r["groups"] == 1 and passed is not None:
            tail = passed if tail is None else tail if how == "last" else max(passed, tail)
        before, last, any_yet = tail, r["last"], True
    kind = df.schema[column].dataType.simpleString()
    given = df.sparkSession.createDataFrame(carry, f"_part int, _carry {kind}")
    here = F.last(column, ignorenulls=True).over(own) if how == "last" else F.max(column).over(own)
    out = s.withColumn("_here", here).withColumn("_head", F.min("_at").over(Window.partitionBy("_part", *by))).join(F.broadcast(given), "_part", "left")
    passed = F.when(F.col("_head") == F.shiftleft(F.col("_part").cast("long"), _IN_RANGE), F.col("_carry"))
    value = F.coalesce("_here", passed) if how == "last" else F.greatest("_here", passed)
    return out.withColumn(name, value).select(*df.columns, name)
