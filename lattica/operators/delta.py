"""What changed between pairs of snapshots.

``pairs`` has (pair_id, a, b) with two snapshot ids, so that one job compares a whole history.  A table is
read once for both ends and grouped once by key, which needs one shuffle where two anti-joins need four.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..schema import Snapshots
from ..shared import written as keep
from . import filters as flt
from .ranks import ranked


def pair(spark, a: str = "A", b: str = "B") -> DataFrame:
    return named_pairs(spark, [(a, b)])


def named_pairs(spark, ends: list[tuple[str, str]]) -> DataFrame:
    """Pairs that the caller names.  Made of literals, so that a plan knows how few they are: of rows from Python it knows no size, and
    deals all that is joined with them by snapshot, to no purpose."""
    return few(spark, [(f"{a}..{b}", a, b) for a, b in ends], ["pair_id", "a", "b"])


def few(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    """A table of a few rows that the caller names, of literals."""
    row = lambda r: F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)])
    return spark.range(1).select(F.inline(F.array(*map(row, rows))))


def of(df: DataFrame, pairs: DataFrame, end: str) -> DataFrame:
    """A table as seen from one end (``a`` or ``b``) of each pair."""
    return df.join(pairs.select("pair_id", F.col(end).alias("snapshot_id")), "snapshot_id").drop("snapshot_id")


def narrowed(s: Snapshots, pairs: DataFrame, end: str, *tables: str) -> Snapshots:
    """Of the named tables only the snapshots at one end of pairs, before anything is made of them; other tables are left out."""
    ids = pairs.select(F.col(end).alias("snapshot_id"))
    return Snapshots(**{f.name: getattr(s, f.name).join(ids, "snapshot_id", "left_semi") if f.name in tables else None for f in fields(Snapshots)})


def both(df: DataFrame, pairs: DataFrame, keys: list[str], *extra, dealt: list[str] | None = None) -> DataFrame:
    """(pair_id, keys, in_a, in_b, further aggregates over the column ``in_b`` of united rows).  Rows are dealt by the keys
    ``dealt``, if given, where those that share them come together later on."""
    ends = pairs.select("pair_id", F.inline(F.array(F.struct(F.col("a").alias("snapshot_id"), F.lit(False).alias("_b")), F.struct(F.col("b").alias("snapshot_id"), F.lit(True).alias("_b")))))
    # Dealt by key before grouping: rows of one snapshot differ, so that grouping them where they are read gathers all and merges none.
    # Pairs come after, so that a row moves once, in however many pairs its snapshot is.
    own = df.join(ends.select("snapshot_id"), "snapshot_id", "left_semi").repartition(*(dealt or keys))
    u = own.join(ends, "snapshot_id").drop("snapshot_id")
    return u.groupBy("pair_id", *keys).agg(F.max(~F.col("_b")).alias("in_a"), F.max("_b").alias("in_b"), *extra)


def change():
    return F.when(~F.col("in_a"), "added").otherwise("removed")


def packages(s: Snapshots, pairs: DataFrame) -> DataFrame:
    """(pair_id, path, change, internal)."""
    one = flt.last_wins(s.package.select("snapshot_id", "path", "internal", "pos"), ["snapshot_id", "path"])
    return both(one, pairs, ["path"], F.max("internal").alias("internal")).where("in_a <> in_b").select("pair_id", "path", change().alias("change"), "internal")


def edges(s: Snapshots, pairs: DataFrame) -> DataFrame:
    """(pair_id, src, kind, dst, change); witnesses do not count."""
    return both(s.edge.where("scope = 'cross'").select("snapshot_id", "src", "kind", "dst"), pairs, ["src", "kind", "dst"]).where("in_a <> in_b").select("pair_id", "src", "kind", "dst", change().alias("change"))


def common_packages(s: Snapshots, pairs: DataFrame) -> DataFrame:
    return both(s.package.select("snapshot_id", "path"), pairs, ["path"]).where("in_a and in_b").select("pair_id", "path")


def symbols(s: Snapshots, pairs: DataFrame, axis: str) -> DataFrame:
    """(pair_id, path, kind, name, change) of packages on both sides; signatures do not count."""
    own = s.symbol.where(F.col("axis") == axis).select("snapshot_id", "path", "kind", "name")
    return both(own, pairs, ["path", "kind", "name"]).where("in_a <> in_b").join(common_packages(s, pairs), ["pair_id", "path"], "left_semi").select("pair_id", "path", "kind", "name", change().alias("change"))


def invariants(s: Snapshots, pairs: DataFrame) -> DataFrame:
    """(pair_id, path, name, change) with added, removed and modified."""
    one = flt.last_wins(s.invariant.select("snapshot_id", "path", "name", "hash", "pos"), ["snapshot_id", "path", "name"]).select("snapshot_id", "path", "name", "hash")
    ha, hb = F.max(F.when(~F.col("_b"), F.col("hash"))), F.max(F.when(F.col("_b"), F.col("hash")))
    all_ = both(one, pairs, ["path", "name"], ha.alias("ha"), hb.alias("hb")).join(common_packages(s, pairs), ["pair_id", "path"], "left_semi")
    kind = F.when(~F.col("in_a"), "added").when(~F.col("in_b"), "removed").when(~F.col("ha").eqNullSafe(F.col("hb")), "modified")
    return all_.select("pair_id", "path", "name", kind.alias("change")).where("change is not null")


def touched_promises(s: Snapshots, pairs: DataFrame) -> DataFrame:
    """(pair_id, path, iface): contracts guarded, in either version, by tests that were modified or removed."""
    hit = invariants(s, pairs).where("change <> 'added'").select("pair_id", "path", "name")
    return both(s.guard, pairs, ["path", "name", "iface"]).join(hit, ["pair_id", "path", "name"], "left_semi").select("pair_id", "path", "iface").distinct()


def implementers(s: Snapshots) -> DataFrame:
    """(snapshot_id, iface, impl) from witnesses ``T |= I`` of implements edges, cross-package and local."""
    parts = F.split("witness", r" \|= ", 2)
    w = s.witness.where("kind = 'implements'").select("snapshot_id", "src", "dst", parts.alias("p")).where(F.size("p") == 2)
    return w.select("snapshot_id", F.concat_ws(".", "dst", F.col("p")[1]).alias("iface"), F.concat_ws(".", "src", F.col("p")[0]).alias("impl")).distinct()


def coverage_rows(s: Snapshots) -> DataFrame:
    """(snapshot_id, iface, impl, covered): each concrete that a test exercises counts for each interface it guards."""
    seen = s.guard.join(s.exercise, ["snapshot_id", "path", "name"]).select("snapshot_id", "iface", F.col("concrete").alias("impl")).distinct().withColumn("hit", F.lit(True))
    return implementers(s).join(seen, ["snapshot_id", "iface", "impl"], "left").select("snapshot_id", "iface", "impl", F.coalesce("hit", F.lit(False)).alias("covered"))


def coverage(s: Snapshots) -> DataFrame:
    """(snapshot_id, iface, covered, uncovered, tests, names_concretes): arrays, of interfaces with implementers."""
    rows = coverage_rows(s).groupBy("snapshot_id", "iface").agg(F.array_sort(F.collect_set(F.when(F.col("covered"), F.col("impl")))).alias("covered"), F.array_sort(F.collect_set(F.when(~F.col("covered"), F.col("impl")))).alias("uncovered"))
    tests = s.guard.groupBy("snapshot_id", "iface").agg(F.array_sort(F.collect_set("name")).alias("tests"))
    return rows.join(tests, ["snapshot_id", "iface"], "left").select("snapshot_id", "iface", "covered", "uncovered", F.coalesce("tests", F.array().cast("array<string>")).alias("tests"), (F.size("covered") > 0).alias("names_concretes"))


def gap_kinds(s: Snapshots) -> DataFrame:
    """(snapshot_id, iface, gap): none, no-test, proven or unconfirmed."""
    gap = F.when(F.size("uncovered") == 0, "none").when(F.size("tests") == 0, "no-test").when(F.col("names_concretes"), "proven").otherwise("unconfirmed")
    return coverage(s).select("snapshot_id", "iface", gap.alias("gap"))


def contracts(s: Snapshots, pairs: DataFrame) -> DataFrame:
    """(pair_id, iface, added, removed, covered, uncovered, tests, names_concretes), coverage as of b."""
    moved = both(implementers(s), pairs, ["iface", "impl"]).where("in_a <> in_b")
    pick = lambda side: F.array_sort(F.collect_set(F.when(F.col(side), F.col("impl"))))
    by = moved.groupBy("pair_id", "iface").agg(pick("in_b").alias("added"), pick("in_a").alias("removed"))
    none = F.array().cast("array<string>")
    out = by.join(of(coverage(narrowed(s, pairs, "b", "witness", "guard", "exercise")), pairs, "b"), ["pair_id", "iface"], "left")
    return out.select("pair_id", "iface", "added", "removed", *[F.coalesce(c, none).alias(c) for c in ("covered", "uncovered", "tests")], F.coalesce("names_concretes", F.lit(False)).alias("names_concretes"))


def violations(s: Snapshots, pairs: DataFrame, declared: DataFrame, permitted: DataFrame) -> DataFrame:
    """(pair_id, src, kind, dst, introduced): dependencies of b from declared(path) to what permitted(path, target)
    lacks.  A declared box without targets permits nothing."""
    deps = of(flt.dep_edges(s), pairs, "b").distinct()
    off = deps.join(declared.select(F.col("path").alias("src")).distinct(), "src", "left_semi").join(permitted.select(F.col("path").alias("src"), F.col("target").alias("dst")), ["src", "dst"], "left_anti")
    new = edges(s, pairs).where("change = 'added'").select("pair_id", "src", "kind", "dst", F.lit(True).alias("new"))
    return off.join(new, ["pair_id", "src", "kind", "dst"], "left").select("pair_id", "src", "kind", "dst", F.coalesce("new", F.lit(False)).alias("introduced"))


def verdict(s: Snapshots, pairs: DataFrame) -> DataFrame:
    """(pair_id, empty, verdict): empty where no internal box, no arrow and no surface symbol changed; nothing else
    counts, breaches of an allow-list neither."""
    moved = packages(s, pairs).where("internal").select("pair_id").unionByName(edges(s, pairs).select("pair_id")).unionByName(symbols(s, pairs, "surface").select("pair_id")).distinct().withColumn("moved", F.lit(True))
    out = pairs.select("pair_id").join(moved, "pair_id", "left").withColumn("empty", F.col("moved").isNull())
    return out.select("pair_id", "empty", F.when(F.col("empty"), "NO_CHANGE").otherwise("ARCHITECTURAL_CHANGE").alias("verdict"))


def witnesses(s: Snapshots, pairs: DataFrame) -> DataFrame:
    """(pair_id, src, kind, dst, status, removed, added, remaining) of internal edges whose witnesses moved; arrays."""
    own = flt.internal_edges(s).distinct()
    w = own.join(s.witness.where("scope = 'cross'").select("snapshot_id", "src", "kind", "dst", "witness"), ["snapshot_id", "src", "kind", "dst"], "left")
    # Witnesses are compared one by one; only those of one arrow come together, in its row.
    each = both(w, pairs, ["src", "kind", "dst", "witness"], dealt=["src", "kind", "dst"])
    pick = lambda a, b: F.array_sort(F.collect_list(F.when((F.col("in_a") == a) & (F.col("in_b") == b), F.col("witness"))))
    j = each.groupBy("pair_id", "src", "kind", "dst").agg(pick(True, False).alias("removed"), pick(False, True).alias("added"), pick(True, True).alias("remaining"), F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b"))
    less, more = F.size("removed") > 0, F.size("added") > 0
    status = F.when(~F.col("in_b"), "REMOVED").when(~F.col("in_a"), "ADDED").when(less & more, "CHURNED").when(less, "WEAKENED").when(more, "STRENGTHENED")
    return j.withColumn("status", status).where("status is not null").select("pair_id", "src", "kind", "dst", "status", "removed", "added", "remaining")


STATUS_RANK = {"REMOVED": 0, "WEAKENED": 1, "CHURNED": 2, "STRENGTHENED": 3, "ADDED": 4}


def witness_verdict(rows: DataFrame) -> DataFrame:
    """(pair_id, full, partial): arrows gone, arrows weakened."""
    return rows.groupBy("pair_id").agg(F.count_if(F.col("status") == "REMOVED").alias("full"), F.count_if(F.col("status") == "WEAKENED").alias("partial"))


def tallies(s: Snapshots, pairs: DataFrame, arrows: bool = True) -> DataFrame:
    """One row a pair with the sizes of all axes, from one pass: the keys of all axes are united, grouped once by key, then by
    what they belong to (a package, an interface, an arrow), then by pair.  Without ``arrows`` only boxes, arrows and surface are
    counted, for which no value but a box's ``internal`` is carried: of fixed width, so that rows are hashed, not sorted."""
    none, zero = F.lit(None).cast("string"), F.lit(0)
    value = "string" if arrows else "boolean"

    def tagged(df, tag, axis, g, k=(), v=F.lit(None).cast(value), pos=zero):
        own = [*[F.col(c) for c in g], *[none] * (3 - len(g))], [*[F.col(c) for c in k], *[none] * (2 - len(k))]
        return df.select("snapshot_id", F.lit(tag).alias("tag"), *[c.alias(f"g{i}") for i, c in enumerate(own[0])], axis.alias("axis"), *[c.alias(f"k{i}") for i, c in enumerate(own[1])], v.alias("v"), pos.alias("pos"))

    rows = [
        tagged(s.package, "path", F.lit("package"), ["path"], v=F.col("internal").cast(value), pos=F.col("pos")),
        tagged(s.symbol if arrows else s.symbol.where("axis = 'surface'"), "path", F.col("axis"), ["path"], ["kind", "name"]),
    ]
    key = ["src", "kind", "dst"]
    if arrows:
        # Witnesses count where their arrow is internal in both versions, which their group tells.
        seen = s.witness.where("scope = 'cross'").select("snapshot_id", *key, "witness")
        rows += [tagged(s.invariant, "path", F.lit("invariant"), ["path"], ["name"], F.col("hash"), F.col("pos"))]
        rows += [tagged(flt.told_internal(s), "arrow", F.lit("edge"), key, v=F.col("internal").cast("string")), tagged(implementers(s), "iface", F.lit("impl"), ["iface"], ["impl"]), tagged(seen, "arrow", F.lit("witness"), key, ["witness"])]
    else:
        rows.append(tagged(s.edge.where("scope = 'cross'"), "arrow", F.lit("edge"), key))
    every = rows[0]
    for x in rows[1:]:
        every = every.unionByName(x)
    last = lambda end: F.max_by("v", F.when(end, F.col("pos")))  # noqa: E731  of rows with equal keys the last
    # A snapshot against itself moves nothing: its rows need not be matched with themselves.
    apart = pairs.where(~F.col("a").eqNullSafe(F.col("b")))
    # Dealt by what keys belong to (a package, an arrow's source, an interface), so that rows move once for both groupings.
    each = both(every, apart, ["tag", "g0", "g1", "g2", "axis", "k0", "k1"], last(~F.col("_b")).alias("va"), last(F.col("_b")).alias("vb"), dealt=["g0"])
    on, moved = (lambda a: F.col("axis") == a), F.col("in_a") != F.col("in_b")
    of_axis = lambda a, c: F.max(F.when(on(a), F.col(c)))
    g = each.groupBy("pair_id", "tag", "g0", "g1", "g2").agg(
        *[of_axis("package", f"in_{e}").alias(f"package_{e}") for e in "ab"],
        *[F.max(on("edge") & F.col(f"in_{e}") & F.coalesce(F.col(f"v{e}").cast("string") == "true", F.lit(False))).alias(f"arrow_{e}") for e in "ab"],
        F.max(F.when(on("package"), F.greatest("va", "vb"))).alias("internal"),
        F.count_if(on("edge") & ~F.col("in_a")).alias("edges_added"), F.count_if(on("edge") & ~F.col("in_b")).alias("edges_removed"),
        *[F.count_if(on(a) & moved).alias(a) for a in ("surface", "schema", "impl")],
        F.count_if(on("invariant") & (moved | ~F.col("va").eqNullSafe(F.col("vb")))).alias("invariant"),
        F.count_if(on("witness") & F.col("in_a") & ~F.col("in_b")).alias("less"), F.count_if(on("witness") & ~F.col("in_a") & F.col("in_b")).alias("more"),
    )
    common, only = F.col("package_a") & F.col("package_b"), lambda x, y: F.col(x) & ~F.col(y)
    whole = F.col("arrow_a") & F.col("arrow_b")
    n = g.groupBy("pair_id").agg(
        F.count_if(only("package_b", "package_a")).alias("packages_added"), F.count_if(only("package_a", "package_b")).alias("packages_removed"),
        F.sum("edges_added").alias("edges_added"), F.sum("edges_removed").alias("edges_removed"),
        *[F.count_if(common & (F.col(a) > 0)).alias(name) for a, name in (("surface", "surface"), ("schema", "schema"), ("invariant", "invariants"))],
        F.count_if((F.col("tag") == "iface") & (F.col("impl") > 0)).alias("contracts"),
        F.count_if(only("arrow_a", "arrow_b")).alias("decoupled"), F.count_if(whole & (F.col("less") > 0) & (F.col("more") == 0)).alias("weakened"),
        F.sum(F.when(common, F.col("surface")).otherwise(0)).alias("surface_items"),
        F.count_if((F.col("package_a") != F.col("package_b")) & (F.col("internal").cast("string") == "true")).alias("internal_moved"),
    )
    return pairs.select("pair_id").join(n, "pair_id", "left").fillna(0)


def counts(s: Snapshots, pairs: DataFrame, off_list: DataFrame | None = None, widenings: DataFrame | None = None) -> DataFrame:
    """One row a pair: sizes of all axes; surface, schema and invariants count packages.  ``violations`` counts the rows
    of off_list(pair_id, ...), ``surface_widenings`` those of widenings(pair_id, ...), as far as they are given."""
    out = tallies(s, pairs).drop("surface_items", "internal_moved")
    for df, name in ((off_list, "violations"), (widenings, "surface_widenings")):
        out = out.withColumn(name, F.lit(0).cast("long")) if df is None else out.join(df.groupBy("pair_id").agg(F.count("*").alias(name)), "pair_id", "left").fillna(0)
    return out


def mentioned(s: Snapshots, pairs: DataFrame) -> DataFrame:
    """(pair_id, section, k0, k1, k2, nth, path): the paths that a delta's report names, in its order: boxes added and removed,
    both ends of arrows added and removed, packages with changed surface."""
    p, e = packages(s, pairs), edges(s, pairs)
    none = F.lit("")
    boxes = p.select("pair_id", F.when(F.col("change") == "added", 0).otherwise(1).alias("section"), F.col("path").alias("k0"), none.alias("k1"), none.alias("k2"), F.lit(0).alias("nth"), "path")
    ends = F.posexplode(F.array("src", "dst")).alias("nth", "path")
    arrows = e.select("pair_id", F.when(F.col("change") == "added", 2).otherwise(3).alias("section"), F.col("src").alias("k0"), F.col("kind").alias("k1"), F.col("dst").alias("k2"), ends)
    surface = symbols(s, pairs, "surface").select("pair_id", "path").distinct().select("pair_id", F.lit(4).alias("section"), F.col("path").alias("k0"), none.alias("k1"), none.alias("k2"), F.lit(0).alias("nth"), "path")
    return boxes.unionByName(arrows).unionByName(surface)


def shared_prefix(paths: DataFrame, order: list[str]) -> DataFrame:
    """(pair_id, prefix) of paths(pair_id, path, *order): what a fold over the paths in order leaves, which keeps the leading
    segments that the path has in common with what is left so far, and begins anew at the path after one that had none.

    The fold depends on order, but only through first segments.  Stretches of paths with one first segment either go on, or end
    what was left: their first path does, and the next begins anew, if there is one.  So the last stretch and the number of
    single paths before it say where the last beginning is; from there on the prefix is that of the least and the
    greatest path.  No pass over a pair's paths in one task is needed."""
    at = keep(ranked(paths.select("pair_id", "path", *order), ["pair_id"], [F.col(c) for c in order], "i").select("pair_id", "i", "path", F.split("path", "/").alias("own")))
    before = at.select("pair_id", (F.col("i") + 1).alias("i"), F.col("own")[0].alias("last"))
    begins = at.join(before, ["pair_id", "i"], "left").where("last is null or last <> own[0]").select("pair_id", "i")
    n = at.groupBy("pair_id").agg(F.max("i").alias("n"))
    starts = keep(ranked(begins, ["pair_id"], [F.col("i")], "r"))
    onward = starts.select("pair_id", (F.col("r") - 1).alias("r"), F.col("i").alias("next"))
    sized = starts.join(onward, ["pair_id", "r"], "left").join(n, "pair_id").select("pair_id", "r", "i", (F.coalesce("next", F.col("n") + 1) - F.col("i")).alias("m"), F.col("next").isNull().alias("last"))
    # Before the last stretch something is left after a stretch of several paths, and after every second single one.
    told = sized.groupBy("pair_id").agg(F.max(F.when(F.col("last"), F.struct("i", "m", "r"))).alias("z"), F.max(F.when(~F.col("last") & (F.col("m") > 1), F.col("r"))).alias("b"))
    singles = F.col("z.r") - 1 - F.coalesce("b", F.lit(0))
    left = F.when(F.col("b").isNull(), singles % 2 == 1).otherwise(singles % 2 == 0)
    begin = F.when(left & (F.col("z.m") == 1), None).otherwise(F.col("z.i") + left.cast("long"))
    where = told.select("pair_id", begin.alias("begin"))
    ends = at.join(where, "pair_id").where("i >= begin").groupBy("pair_id").agg(F.min("own").alias("x"), F.max("own").alias("y"))
    differs = F.array_position(F.zip_with("x", "y", lambda a, b: a.eqNullSafe(b)), False)
    common = F.when(differs == 0, F.size("x")).otherwise(differs - 1).cast("int")
    return where.select("pair_id").join(ends.select("pair_id", F.array_join(F.slice("x", F.lit(1), common), "/").alias("prefix")), "pair_id", "left").select("pair_id", F.coalesce("prefix", F.lit("")).alias("prefix"))


def shortened(path, prefix):
    """A path without the prefix that a report leaves out."""
    return F.when((prefix != "") & F.startswith(path, F.concat(prefix, F.lit("/"))), F.substr(path, F.length(prefix) + 2)).otherwise(path)


REPORT_ORDER = ["section", "k0", "k1", "k2", "nth"]


def report_prefix(s: Snapshots, pairs: DataFrame) -> DataFrame:
    """(pair_id, prefix) that a delta's report leaves out."""
    found = shared_prefix(mentioned(s, pairs), REPORT_ORDER)
    return pairs.select("pair_id").join(found, "pair_id", "left").select("pair_id", F.coalesce("prefix", F.lit("")).alias("prefix"))


def synthetic_added(s: Snapshots, pairs: DataFrame, prefix: str) -> DataFrame:
    return edges(s, pairs).where((F.col("change") == "added") & F.startswith("dst", F.lit(prefix))).select("pair_id", "dst").distinct()


def external_boundaries(s: Snapshots, pairs: DataFrame) -> DataFrame:
    """(pair_id, src, targets): newly reached notable external targets of each package."""
    own = of(flt.internal_paths(s), pairs, "b")
    new = edges(s, pairs).where((F.col("change") == "added") & P.notable(F.col("dst"), F.col("kind")))
    out = new.join(own.withColumnRenamed("path", "dst"), ["pair_id", "dst"], "left_anti")
    return out.groupBy("pair_id", "src").agg(F.array_sort(F.collect_set("dst")).alias("targets"))


def triage(s: Snapshots, pairs: DataFrame) -> DataFrame:
    """(pair_id, label, item): what a reviewer should look at first, one row an item; labels in ``TRIAGE`` order."""
    e = edges(s, pairs).where("change = 'added'")
    tags = {"service:": "services", "api:": "endpoints", "env:": "config keys", "flag:": "config keys", "cap:": "capabilities"}
    label = None
    for prefix, name in tags.items():
        hit = F.startswith("dst", F.lit(prefix))
        label = F.when(hit, name) if label is None else label.when(hit, name)
    out = packages(s, pairs).where("internal and change = 'added'").select("pair_id", F.lit("new packages").alias("label"), P.short("path").alias("item"))
    out = out.unionByName(e.select("pair_id", label.alias("label"), F.col("dst").alias("item")).where("label is not null").distinct())
    new = contracts(s, pairs).select("pair_id", "iface", "covered", F.explode("added").alias("impl"))
    bare = ~F.array_contains("covered", F.col("impl"))
    out = out.unionByName(new.select("pair_id", F.lit("contracts").alias("label"), F.concat(P.short("impl"), F.lit(" ⊨ "), P.short("iface"), F.when(bare, " [UNCOVERED]").otherwise("")).alias("item")))
    for axis, name in (("surface", "surface +"), ("schema", "schema +")):
        out = out.unionByName(symbols(s, pairs, axis).where("change = 'added'").select("pair_id", F.lit(name).alias("label"), F.concat_ws(".", P.short("path"), "name").alias("item")))
    return out.unionByName(touched_promises(s, pairs).select("pair_id", F.lit("invariant").alias("label"), F.col("iface").alias("item")).distinct())


TRIAGE = ("new packages", "services", "endpoints", "config keys", "capabilities", "contracts", "surface +", "schema +", "invariant")


def triage_summary(s: Snapshots, pairs: DataFrame, off_list: DataFrame | None = None) -> DataFrame:
    """(pair_id, verdict, breaches, gaps, touched): FAST-TRACK where the delta is empty, else NEEDS ARCHITECTURE REVIEW; rows of
    off_list(pair_id, ...); new implementers without a contract test; contracts whose guarding tests changed, short and joined."""
    new = contracts(s, pairs).select("pair_id", F.size(F.array_except("added", "covered")).alias("n")).groupBy("pair_id").agg(F.sum("n").alias("gaps"))
    touched = touched_promises(s, pairs).groupBy("pair_id").agg(P.joined(P.short("iface"), ", ").alias("touched"))
    off = (off_list.select("pair_id") if off_list is not None else pairs.select("pair_id").limit(0)).groupBy("pair_id").agg(F.count("*").alias("breaches"))
    out = verdict(s, pairs).join(off, "pair_id", "left").join(new, "pair_id", "left").join(touched, "pair_id", "left")
    return out.select("pair_id", F.when(F.col("empty"), "FAST-TRACK").otherwise("NEEDS ARCHITECTURE REVIEW").alias("verdict"), F.coalesce("breaches", F.lit(0)).alias("breaches"), F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("touched", F.lit("")).alias("touched"))


def surface_summary(s: Snapshots, pairs: DataFrame) -> DataFrame:
    """(pair_id, added, removed, modified, breaking, shape): symbols of all axes; any removal or modification needs review."""
    all_ = packages(s, pairs).select("pair_id", "change").unionByName(edges(s, pairs).select("pair_id", "change")).unionByName(invariants(s, pairs).select("pair_id", "change"))
    for axis in ("surface", "schema"):
        all_ = all_.unionByName(symbols(s, pairs, axis).select("pair_id", "change"))
    n = all_.groupBy("pair_id").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified")])
    breaking = F.col("removed") + F.col("modified") > 0
    out = pairs.select("pair_id").join(n, "pair_id", "left").fillna(0)
    return out.withColumn("breaking", breaking).withColumn("shape", F.when(breaking, "changed").when(F.col("added") > 0, "widened").otherwise("none"))


def painted_packages(s: Snapshots, pairs: DataFrame) -> DataFrame:
    """(pair_id, path, change) by the stricter rule of the component report: uncovered implementers count as boundary,
    tests that were only modified do not count."""
    own = both(s.package.where("internal").select("snapshot_id", "path"), pairs, ["path"]).select("pair_id", "path")
    c = contracts(s, pairs).select("pair_id", F.explode(F.transform(F.concat("added", "removed", "uncovered"), lambda x: F.regexp_replace(x, r"\.[^.]*$", ""))).alias("path"))
    strong = edges(s, pairs).select("pair_id", F.explode(F.array("src", "dst")).alias("path")).unionByName(c)
    weak = invariants(s, pairs).where("change <> 'modified'").select("pair_id", "path")
    for axis in ("surface", "schema"):
        weak = weak.unionByName(symbols(s, pairs, axis).select("pair_id", "path"))
    marks = strong.withColumn("m", F.lit(2)).unionByName(weak.withColumn("m", F.lit(1))).groupBy("pair_id", "path").agg(F.max("m").alias("m"))
    return own.join(marks, ["pair_id", "path"]).select("pair_id", "path", F.when(F.col("m") == 2, "boundary").otherwise("minor").alias("change"))


def context_edges(s: Snapshots, pairs: DataFrame) -> DataFrame:
    """(pair_id, src, kind, dst): internal arrows of b with a painted end, but for pairs whose arrow was removed."""
    b = of(flt.internal_edges(s), pairs, "b").where(F.col("kind").isin("call", "import", "implements") & (F.col("src") != F.col("dst"))).distinct()
    drawn = edges(s, pairs).where("change = 'removed'").select("pair_id", "src", "dst").distinct()
    hot = painted_packages(s, pairs).select("pair_id", "path")
    ends = b.withColumn("path", F.explode(F.array("src", "dst"))).join(hot, ["pair_id", "path"], "left_semi")
    return ends.join(drawn, ["pair_id", "src", "dst"], "left_anti").select("pair_id", "src", "kind", "dst").distinct()


def select_witnesses(rows: DataFrame, src: str = "", dst: str = "", kind: str = "") -> DataFrame:
    """Rows of ``witnesses`` by parts of the short names of both ends, and by kind."""
    want = F.contains(P.short_package(F.col("src")), F.lit(src)) & F.contains(P.short_package(F.col("dst")), F.lit(dst))
    return rows.where(want & (F.col("kind") == kind if kind else F.lit(True)))
