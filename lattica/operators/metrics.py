"""Coupling and size metrics of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Snapshots
from ..shared import written as keep
from . import filters as flt
from . import graph as gr


def fan(s: Snapshots, pairs: DataFrame | None = None) -> DataFrame:
    """(snapshot_id, path, fan_in, fan_out) of internal packages: one pass over the dependency pairs."""
    ends = (flt.dep_pairs(s) if pairs is None else pairs).select("snapshot_id", F.explode(F.array(F.struct(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("snapshot_id", "e.*")
    deg = ends.groupBy("snapshot_id", "path").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return flt.internal_paths(s).join(deg, ["snapshot_id", "path"], "left").fillna(0, ["fan_in", "fan_out"])


def surface_size(s: Snapshots) -> DataFrame:
    """(snapshot_id, path, surface): rows, repeated ones too."""
    n = s.symbol.where("axis = 'surface'").groupBy("snapshot_id", "path").agg(F.count("*").alias("surface"))
    return flt.internal_paths(s).join(n, ["snapshot_id", "path"], "left").fillna(0, ["surface"])


def instability(fan_in, fan_out):
    total = fan_in + fan_out
    return F.when(total > 0, fan_out.cast("double") / total).otherwise(F.lit(0.0))


def percentile_floor(column, p: float):
    """Aggregate: the value at index floor(p (n - 1)) of the sorted values; gathers them, so for small groups only."""
    return F.get(F.sort_array(F.collect_list(column)), F.floor(F.lit(p) * (F.count(column) - 1)).cast("int"))


def cutoffs(df: DataFrame, column: str, p: float) -> DataFrame:
    """(snapshot_id, cut): the same for groups of any size, from how often each value stands: what is ordered are
    the distinct values of a snapshot, not its packages."""
    by = df.groupBy("snapshot_id", F.col(column).alias("cut")).agg(F.count("*").alias("m"))
    w = Window.partitionBy("snapshot_id")
    upto = F.sum("m").over(w.orderBy("cut"))
    k = F.floor(F.lit(p) * (F.sum("m").over(w) - 1))
    return by.select("snapshot_id", "cut", upto.alias("upto"), k.alias("k")).where("upto > k").groupBy("snapshot_id").agg(F.min("cut").alias("cut"))


def health(s: Snapshots, p: float = 0.75) -> DataFrame:
    """(snapshot_id, path, fan_in, fan_out, instability, surface, blast_radius, god, cycle)."""
    pairs = keep(flt.dep_pairs(s))
    base = keep(fan(s, pairs).join(surface_size(s), ["snapshot_id", "path"]))
    cut = cutoffs(base, "fan_in", p).withColumnRenamed("cut", "cf").join(cutoffs(base, "surface", p).withColumnRenamed("cut", "cs"), "snapshot_id")
    parts = gr.pieces(pairs)
    cycle = gr.cycles(pairs, parts)
    cycle = cycle if parts[1] is None else keep(cycle)
    base = base.join(gr.blast_radius(pairs, cycle, parts), ["snapshot_id", "path"], "left").fillna(0, ["blast_radius"])
    god = (F.col("fan_in") >= F.col("cf")) & (F.col("surface") >= F.col("cs")) & (F.col("cf") > 0)
    out = base.join(cut, "snapshot_id").join(cycle, ["snapshot_id", "path"], "left")
    return out.select("snapshot_id", "path", "fan_in", "fan_out", instability(F.col("fan_in"), F.col("fan_out")).alias("instability"), "surface", "blast_radius", god.alias("god"), "cycle")


def health_order(report: DataFrame) -> DataFrame:
    return report.orderBy("snapshot_id", F.desc("blast_radius"), F.desc("fan_in"), "path")


def median_int(column):
    return F.median(column).cast("int")
