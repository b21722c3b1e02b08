"""Conformance: allow-lists, fixed surfaces, layers, and recorded test evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..schema import Snapshots
from . import delta as dl
from . import filters as flt


def allow_snapshot(s: Snapshots) -> DataFrame:
    """(snapshot_id, path, targets): the allow-list that the code meets now; an array for every internal box."""
    t = flt.dep_pairs(s).groupBy("snapshot_id", F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("targets"))
    return flt.internal_paths(s).join(t, ["snapshot_id", "path"], "left").select("snapshot_id", "path", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))


def surface_widenings(s: Snapshots, pairs: DataFrame, fixed: DataFrame, widen: DataFrame | None = None) -> DataFrame:
    """(pair_id, path, kind, name): symbols that fixed(path) packages gained, but for widen(path, name)."""
    new = dl.symbols(s, pairs, "surface").where("change = 'added'").join(fixed.select("path").distinct(), "path", "left_semi")
    if widen is not None:
        new = new.join(widen.select("path", "name").distinct(), ["path", "name"], "left_anti")
    return new.select("pair_id", "path", "kind", "name")


def fixed_from_plan(plan: Snapshots, filled_holes: bool = False) -> DataFrame:
    """(path): plan packages with a surface that are no holes; with ``filled_holes``, holes too."""
    own = plan.package if filled_holes else plan.package.where("not coalesce(hole, false)")
    return own.join(plan.symbol.where("axis = 'surface'"), ["snapshot_id", "path"], "left_semi").select("path").distinct()


def layered(s: Snapshots, layers: DataFrame, directory_layer: DataFrame) -> DataFrame:
    """(snapshot_id, src, dst, fseg, tseg, flayer, tlayer, direction) of dependency pairs, with layers(layer, ord) and
    directory_layer(seg, layer).  A layer that is not listed has ordinal 0."""
    module = s.snapshot.select("snapshot_id", "module")
    where = directory_layer.join(layers, "layer", "left").select("seg", "layer", F.coalesce("ord", F.lit(0)).alias("ord"))
    d = flt.dep_pairs(s).join(module, "snapshot_id")
    for end, p in (("src", "f"), ("dst", "t")):
        seg = F.split(P.rel(F.col(end), F.col("module")), "/")[0]
        d = d.withColumn(f"{p}seg", F.when(seg == "", "(root)").otherwise(seg)).join(where.select(F.col("seg").alias(f"{p}seg"), F.col("layer").alias(f"{p}layer"), F.col("ord").alias(f"{p}ord")), f"{p}seg", "left")
    way = F.when(F.col("flayer").isNull() | F.col("tlayer").isNull(), "unmapped").when(F.col("flayer") == F.col("tlayer"), "same").when(F.col("ford") <= F.col("tord"), "down").otherwise("up")
    return d.select("snapshot_id", "src", "dst", "fseg", "tseg", "flayer", "tlayer", way.alias("direction"))


def layer_counts(rows: DataFrame) -> DataFrame:
    """(snapshot_id, from, to, direction, count) of layer pairs."""
    return rows.where("direction in ('down', 'up')").groupBy("snapshot_id", F.col("flayer").alias("from"), F.col("tlayer").alias("to"), "direction").agg(F.count("*").alias("count"))


def reflexion(s: Snapshots, layers: DataFrame, directory_layer: DataFrame) -> DataFrame:
    """Upward dependencies: from, to, count, with the layer fields both as the report has them (a layer's name looked
    up as a directory, so mostly blank) and as they should be (``*_layer_name``)."""
    up = layer_counts(layered(s, layers, directory_layer)).where("direction = 'up'")
    for end in ("from", "to"):
        up = up.join(directory_layer.select(F.col("seg").alias(end), F.col("layer").alias(f"{end}_layer")), end, "left").fillna("", [f"{end}_layer"])
    return up.select("snapshot_id", "from", "to", "count", "from_layer", "to_layer", F.col("from").alias("from_layer_name"), F.col("to").alias("to_layer_name"))


def unmapped(rows: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("fseg").alias("seg"), F.col("flayer").alias("layer")), F.struct(F.col("tseg").alias("seg"), F.col("tlayer").alias("layer")))
    return rows.select("snapshot_id", F.explode(ends).alias("e")).where("e.layer is null").select("snapshot_id", "e.seg").distinct()


def bound_tests(s: Snapshots) -> DataFrame:
    """(snapshot_id, path, tests): tests that guard a contract."""
    return s.guard.groupBy("snapshot_id", "path").agg(F.array_sort(F.collect_set("name")).alias("tests"))


def outcomes(s: Snapshots, events: DataFrame) -> DataFrame:
    """(snapshot_id, test, outcome) from recorded events(seq, Action, Test): by name only, the last one counts."""
    last = events.where(F.col("Action").isin("pass", "fail")).groupBy(F.col("Test").alias("test")).agg(F.max_by("Action", "seq").alias("outcome"))
    return s.guard.select("snapshot_id", F.col("name").alias("test")).distinct().join(last, "test", "left").select("snapshot_id", "test", F.coalesce("outcome", F.lit("not run")).alias("outcome"))


def smells(facts: DataFrame) -> DataFrame:
    """facts(snapshot_id, iface, pkg, methods, implementers, consumer_pkgs, n_consumers) with the smell added."""
    impl_pkgs = F.transform("implementers", lambda x: F.regexp_replace(x, r"\.[^.]*$", ""))
    alone = (F.size("implementers") == 1) & (F.size(F.array_except(impl_pkgs, F.array("pkg"))) > 0)
    used = F.size(F.array_except("consumer_pkgs", F.array("pkg"))) > 0
    idle = (F.size("implementers") <= 1) & (F.col("n_consumers") == 0)
    label = F.when(alone & ~used, "STRANDED").when(alone & used, "single-impl cross-boundary").when(idle, "unconsumed").otherwise("")
    return facts.withColumn("smell", label)


def interesting(facts: DataFrame) -> DataFrame:
    """Contracts that cross a package boundary or have a smell."""
    impl_pkgs = F.transform("implementers", lambda x: F.regexp_replace(x, r"\.[^.]*$", ""))
    return smells(facts).where((F.size(F.array_except(F.array_union(impl_pkgs, F.col("consumer_pkgs")), F.array("pkg"))) > 0) | (F.col("smell") != ""))


def select_contracts(facts: DataFrame, part: str = "", every: bool = False) -> DataFrame:
    """Contracts, with their smells: by a part of the id; else all, or the interesting ones."""
    if part:
        return smells(facts).where(F.contains("iface", F.lit(part)))
    return smells(facts) if every else interesting(facts)


def interface_delta(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, iface, status, impl_added, impl_removed, cons_added, cons_removed, smell_a, smell_b, newly_stranded,
    unstranded) of interfaces whose facts or smell moved."""
    f = smells(facts).select("snapshot_id", "iface", "methods", "implementers", "consumer_pkgs", "smell")
    got = lambda c, b: F.max(F.when(F.col("_b") == b, F.col(c)))
    extra = [got(c, b).alias(f"{c}_{n}") for c in ("methods", "implementers", "consumer_pkgs", "smell") for b, n in ((False, "a"), (True, "b"))]
    j = dl.both(f, pairs, ["iface"], *extra)
    none = F.array().cast("array<string>")
    for c in ("methods", "implementers", "consumer_pkgs"):
        for n in "ab":
            j = j.withColumn(f"{c}_{n}", F.coalesce(f"{c}_{n}", none))
    j = j.fillna("", ["smell_a", "smell_b"])
    diff = lambda c, x, y: F.array_sort(F.array_except(f"{c}_{x}", f"{c}_{y}"))
    j = j.select("pair_id", "iface", "in_a", "in_b", "smell_a", "smell_b", diff("implementers", "b", "a").alias("impl_added"), diff("implementers", "a", "b").alias("impl_removed"), diff("consumer_pkgs", "b", "a").alias("cons_added"), diff("consumer_pkgs", "a", "b").alias("cons_removed"), (F.size(F.array_except("methods_a", "methods_b")) + F.size(F.array_except("methods_b", "methods_a"))).alias("_m"))
    moved = F.size("impl_added") + F.size("impl_removed") + F.size("cons_added") + F.size("cons_removed") + F.col("_m") > 0
    status = F.when(~F.col("in_a"), "ADDED").when(~F.col("in_b"), "REMOVED").when(moved, "MODIFIED").otherwise("unchanged")
    out = j.withColumn("status", status).where((F.col("status") != "unchanged") | (F.col("smell_a") != F.col("smell_b")))
    stranded = lambda n: F.col(f"smell_{n}") == "STRANDED"
    return out.select("pair_id", "iface", "status", "impl_added", "impl_removed", "cons_added", "cons_removed", "smell_a", "smell_b", (stranded("b") & ~stranded("a")).alias("newly_stranded"), (stranded("a") & ~stranded("b")).alias("unstranded"))
