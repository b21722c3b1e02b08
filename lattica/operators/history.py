"""A repository's history: consecutive snapshots, compared in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..schema import Snapshots
from . import delta as dl


def consecutive(order: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """order(snapshot_id, seq) -> pairs (pair_id, a, b): each snapshot after its predecessor, of one repository (all
    snapshots) or of each of many (``by`` names its columns).  A row is a commit: the histories are ordered, not the graphs."""
    w = Window.partitionBy(*by).orderBy("seq") if by else Window.orderBy("seq")
    return order.select(F.lag("snapshot_id").over(w).alias("a"), F.col("snapshot_id").alias("b")).where("a is not null").select(F.concat_ws("..", "a", "b").alias("pair_id"), "a", "b")


def sizes(s: Snapshots, pairs: DataFrame) -> DataFrame:
    """(pair_id, d_boxes, d_arrows, d_surface, d_items, empty), all from one pass over the axes."""
    n = dl.tallies(s, pairs, arrows=False)
    out = n.select("pair_id", (F.col("packages_added") + F.col("packages_removed")).alias("d_boxes"), (F.col("edges_added") + F.col("edges_removed")).alias("d_arrows"), F.col("surface_items").alias("d_surface"), "internal_moved")
    out = out.withColumn("d_items", F.col("d_boxes") + F.col("d_arrows") + F.col("d_surface"))
    return out.select("pair_id", "d_boxes", "d_arrows", "d_surface", "d_items", (F.col("internal_moved") + F.col("d_arrows") + F.col("d_surface") == 0).alias("empty"))


def summary(rows: DataFrame) -> DataFrame:
    """rows(text_lines, d_items, empty, err_a, err_b) -> one row: how many changes, empty ones and unclean ones; of the
    empty ones the median and the greatest number of text lines; of the others the median numbers of text lines and of
    items, and the median of their ratio; medians cut down to whole numbers."""
    whole = lambda when, x: F.median(F.when(when, x)).cast("bigint")
    empty, lines = F.col("empty"), F.col("text_lines")
    unclean = (F.col("err_a") > 0) | (F.col("err_b") > 0)
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(empty).alias("n_empty"),
        F.count_if(unclean).alias("n_unclean"),
        whole(empty, lines).alias("empty_median_text"),
        F.max(F.when(empty, lines)).cast("bigint").alias("empty_max_text"),
        whole(~empty, lines).alias("median_text"),
        whole(~empty, F.col("d_items")).alias("median_items"),
        whole(~empty & (F.col("d_items") > 0), lines / F.col("d_items")).alias("median_compression"),
    )


def report(pairs: DataFrame, size: DataFrame, text: DataFrame, commits: DataFrame, errors: DataFrame) -> DataFrame:
    """The history's table, a row for each change: pairs(pair_id, a, b), ``sizes``, ``numstat``, commits(snapshot_id, date,
    subject) and errors(snapshot_id, n_errors).  Pairs without errors rows at either end were not extracted and are left out."""
    err = lambda end: errors.select(F.col("snapshot_id").alias(end), F.col("n_errors").alias(f"err_{end}"))
    rows = pairs.join(err("a"), "a").join(err("b"), "b").join(size, "pair_id").join(text, "pair_id", "left").join(commits.withColumnRenamed("snapshot_id", "b"), "b")
    rows = rows.fillna(0, ["files", "insertions", "deletions", "go_files", "go_insertions", "go_deletions"])
    return rows.select(
        F.substring("b", 1, 8).alias("sha"), "date", P.stratum(F.col("subject")).alias("stratum"), "subject", "files", "insertions", "deletions", "go_files", "go_insertions", "go_deletions",
        (F.col("insertions") + F.col("deletions")).alias("text_lines"), (F.col("go_insertions") + F.col("go_deletions")).alias("go_lines"), "err_a", "err_b", "d_boxes", "d_arrows", "d_surface", "d_items", F.col("empty"),
    )


def strata(rows: DataFrame) -> DataFrame:
    """rows(subject, empty) -> (stratum, n, empty_share), in the fixed order of strata."""
    order = rows.sparkSession.createDataFrame([(x, i) for i, x in enumerate(P.STRATA)], "stratum string, ord int")
    by = rows.groupBy(P.stratum(F.col("subject")).alias("stratum")).agg(F.count("*").alias("n"), F.avg(F.col("empty").cast("int")).alias("empty_share"))
    return by.join(order, "stratum").orderBy("ord").select("stratum", "n", "empty_share")


def numstat(lines: DataFrame) -> DataFrame:
    """lines(pair_id, text) of ``git diff --numstat`` -> files, insertions, deletions, in all and of Go sources but tests."""
    p = F.split("text", "\t")
    n = lambda i: F.when(p[i].rlike("^[0-9]+$"), F.expr(f"try_cast(split(text, '\\t')[{i}] as bigint)")).otherwise(F.lit(0))
    x = lines.where(F.size(p) == 3).select("pair_id", n(0).alias("i"), n(1).alias("d"), p[2].alias("path"))
    go = F.endswith("path", F.lit(".go")) & ~F.contains("path", F.lit("_test.go"))
    own = lambda c: F.sum(F.when(go, F.col(c)).otherwise(0))
    return x.groupBy("pair_id").agg(F.count("*").alias("files"), F.sum("i").alias("insertions"), F.sum("d").alias("deletions"), F.count_if(go).alias("go_files"), own("i").alias("go_insertions"), own("d").alias("go_deletions"))


def write_csv(rows: DataFrame, to: str) -> None:
    """The report as CSV with a header, by Spark's writer."""
    rows.write.mode("overwrite").option("header", True).csv(to)
