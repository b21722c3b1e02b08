"""Filters and projections over one or many snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..schema import DEP_KINDS, Snapshots
from ..shared import written
from .ranks import ranked, running


def internal_paths(s: Snapshots) -> DataFrame:
    return s.package.where("internal").select("snapshot_id", "path").distinct()


def outside_ends(s: Snapshots) -> DataFrame:
    """(snapshot_id, path): ends of arrows that are no internal boxes, found and written once for all that asks.  Each end moves once,
    not each arrow twice; as a written table's size is known, few such ends are sent along, and many are dealt with the arrows."""
    edge, package = s.edge, s.package
    held = getattr(s, "_outside", None)
    if held is None or held[0] is not edge or held[1] is not package:
        ends = edge.where("scope = 'cross'").select("snapshot_id", F.explode(F.array("src", "dst")).alias("path"), F.lit(False).alias("own"))
        every = ends.unionByName(package.where("internal").select("snapshot_id", "path", F.lit(True).alias("own")))
        held = s._outside = edge, package, written(every.groupBy("snapshot_id", "path").agg(F.max("own").alias("own")).where("not own").drop("own"))
    return held[2]


def _both_internal(s: Snapshots, edges: DataFrame) -> DataFrame:
    edges = edges.where("snapshot_id is not null and src is not null and dst is not null")
    for end in ("src", "dst"):
        edges = edges.join(outside_ends(s).withColumnRenamed("path", end), ["snapshot_id", end], "left_anti")
    return edges


def told_internal(s: Snapshots) -> DataFrame:
    """(snapshot_id, src, kind, dst, internal) of all arrows."""
    edges, internal = s.edge.where("scope = 'cross'"), F.col("src").isNotNull() & F.col("dst").isNotNull()
    for end in ("src", "dst"):
        edges = edges.join(outside_ends(s).select("snapshot_id", F.col("path").alias(end), F.lit(True).alias(f"_{end}")), ["snapshot_id", end], "left")
        internal = internal & F.col(f"_{end}").isNull()
    return edges.select("snapshot_id", "src", "kind", "dst", internal.alias("internal"))


def internal_edges(s: Snapshots) -> DataFrame:
    """Any kind, both ends internal, loops kept."""
    return _both_internal(s, s.edge.where("scope = 'cross'")).select("snapshot_id", "src", "kind", "dst")


def dep_edges(s: Snapshots) -> DataFrame:
    """Imports and calls between two different internal packages."""
    return internal_edges(s).where(F.col("kind").isin(*DEP_KINDS) & (F.col("src") != F.col("dst")))


def dep_pairs(s: Snapshots) -> DataFrame:
    """Import and call between one pair count once."""
    return dep_edges(s).select("snapshot_id", "src", "dst").distinct()


def collapse_imports(edges: DataFrame) -> DataFrame:
    """Without the imports whose ordered pair also has a call."""
    calls = edges.where("kind = 'call'").select("snapshot_id", "src", "dst").distinct()
    return edges.where("kind = 'import'").join(calls, ["snapshot_id", "src", "dst"], "left_anti").unionByName(edges.where("kind <> 'import'"), allowMissingColumns=True)


def drawn_nodes(s: Snapshots, external: bool = False) -> DataFrame:
    config = F.startswith("path", F.lit("env:")) | F.startswith("path", F.lit("flag:"))
    return s.package.where(F.col("internal") | config | F.lit(external)).select("snapshot_id", "path", "internal")


def focus(nodes: DataFrame, arrows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(pair_id, path, change), arrows(pair_id, src, kind, dst, change) -> the changed nodes and the ends of
    changed arrows, and the arrows between them; all where nothing changed in a pair."""
    seeds = nodes.where("change <> ''").select("pair_id", "path").unionByName(arrows.where("change <> ''").select("pair_id", F.explode(F.array("src", "dst")).alias("path"))).distinct()
    live = seeds.select("pair_id").distinct()
    keep = seeds.unionByName(nodes.join(live, "pair_id", "left_anti").select("pair_id", "path")).distinct()
    kept = arrows
    for end in ("src", "dst"):
        kept = kept.join(keep.withColumnRenamed("path", end), ["pair_id", end], "left_semi")
    return nodes.join(keep, ["pair_id", "path"], "left_semi"), kept


def resolve_target(s: Snapshots, target: str) -> DataFrame:
    """Internal paths that are the target, else those that end with it after a slash; the caller refuses 0 and over 1."""
    own = internal_paths(s)
    exact = own.where(F.col("path") == target)
    near = own.where(F.endswith("path", F.lit("/" + target))).join(exact.select("snapshot_id"), "snapshot_id", "left_anti")
    return exact.unionByName(near)


def short_labels(s: Snapshots) -> DataFrame:
    """The last segment, or the whole path where two nodes share it.  Labels are counted, and only those of one path are joined
    back, by path: a label that most nodes share gathers nothing."""
    paths = s.package.select("snapshot_id", "path").distinct()
    single = paths.groupBy("snapshot_id", P.short("path").alias("label")).agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").drop("n")
    return paths.join(single, ["snapshot_id", "path"], "left").select("snapshot_id", "path", F.coalesce("label", "path").alias("label"))


def node_ids(s: Snapshots) -> DataFrame:
    """n0, n1, ... in order of paths, numbered within ranges."""
    own = ranked(s.package.select("snapshot_id", "path").distinct(), ["snapshot_id"], [F.col("path")], "n")
    return own.select("snapshot_id", "path", F.concat(F.lit("n"), (F.col("n") - 1).cast("string")).alias("node"))


def last_wins(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Of rows with equal keys the last: one aggregation, after rows are dealt by key."""
    rest = [c for c in df.columns if c not in keys]
    return df.repartition(*keys).groupBy(*keys).agg(F.max_by(F.struct(*rest), pos).alias("r")).select(*keys, "r.*")


def changed_files(lines: DataFrame) -> DataFrame:
    """lines(diff_id, line_no, text) of unified-0 diffs -> (diff_id, file, lo, hi); an empty hunk is widened to a line.

    A diff of any size runs over all tasks: the file that a hunk belongs to is carried forward across ranges of lines."""
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    head = F.startswith("text", F.lit("+++ "))
    own = lines.where(head | F.col("text").rlike(hunk)).select("diff_id", "line_no", F.when(head, F.regexp_replace(F.substr("text", F.lit(5)), "^b/", "")).alias("name"), F.when(~head, F.col("text")).alias("text"))
    at = running(own, ["diff_id"], [F.col("line_no")], "name", "file").where("text is not null")
    lo, n = F.regexp_extract("text", hunk, 1).cast("int"), F.regexp_extract("text", hunk, 2)
    count = F.when(n == "", 1).otherwise(F.greatest(F.try_to_number(n, F.lit("999999999")).cast("int"), F.lit(1)))
    return at.select("diff_id", "file", lo.alias("lo"), (lo + count - 1).alias("hi"))


def touched_spans(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """Distinct spans(key, lo, hi) that overlap one of ranges(key, lo, hi); they share ``key`` columns' names.

    No pairs are made.  Ranges by their begin and spans by their end stand in one order; a span is touched if the greatest end of
    all ranges that begin at or before its end is not before its begin: one scan, a row out for a row in."""
    keys = [c for c in spans.columns if c in ranges.columns and c not in ("lo", "hi")]
    begin = F.struct(*[F.col(c) for c in spans.columns])
    own = spans.distinct().select(*keys, F.col("hi").cast("long").alias("_at_line"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_end"), begin.alias("_span"))
    theirs = ranges.where("lo <= hi").groupBy(*keys, "lo").agg(F.max("hi").alias("hi")).select(*keys, F.col("lo").cast("long").alias("_at_line"), F.lit(0).alias("_kind"), F.col("hi").cast("long").alias("_end"), F.lit(None).cast(own.schema["_span"].dataType).alias("_span"))
    met = running(own.unionByName(theirs), keys, [F.col("_at_line"), F.col("_kind"), F.col("_span")], "_end", "_reach", "max")
    return met.where("_kind = 1 and _reach >= _span.lo").select("_span.*")


def by_suffix(files: DataFrame, names: DataFrame, column: str = "file") -> DataFrame:
    """Pairs of rows whose ``column`` in ``files`` ends with that of names (there called ``name``), by characters: ``b/a.go`` fits
    ``/x/bb/a.go``.  An equi-join without anything left to filter: a file is looked up by its last so many characters, for each
    length that a name has (as many as lengths of paths, at most)."""
    keyed = names.select(*[F.col(c).alias("name" if c == column else c) for c in names.columns])
    lengths = sorted(r.n for r in keyed.select(F.length("name").alias("n")).where("n is not null").distinct().collect())
    ends = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(column)), lambda n: F.substr(column, F.length(column) - n + 1, n))
    return files.withColumn("name", F.explode(ends)).join(keyed, "name").select(*files.columns, *keyed.columns)


def touched_functions(functions: DataFrame, changed: DataFrame) -> DataFrame:
    """functions(..., file, lo, hi) that overlap a changed range (file, lo, hi); files are absolute there, relative here."""
    ranges = changed.select(F.col("file").alias("name"), "lo", "hi").distinct()
    known = by_suffix(functions, changed.select("file").distinct())
    return touched_spans(known, ranges).select(*functions.columns).distinct()
