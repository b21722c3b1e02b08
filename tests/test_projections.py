"""What the projection writes: only what is asked for, and lines without paths."""

from lattica import projections as pj

SF = "/root/testdata/sf0.001"


def test_only_what_is_asked_for_is_written(spark):
    for key in [k for k in pj._WRITTEN if k[0] == spark.sparkContext.applicationId]:
        del pj._WRITTEN[key]
    names = lambda by_year: {k[3] for k in pj._WRITTEN if k[0] == spark.sparkContext.applicationId and k[2] == by_year}
    assert {r.snapshot_id for r in pj.trade(spark, SF, True).snapshot.collect()} >= {"1995", "1996"}
    assert names(True) == {"base", "snapshot"}
    s = pj.trade(spark, SF)
    assert s.edge.count() == s.edge.distinct().count() > 0
    assert names(False) == {"base", "edge", "reached"}
    assert s.file.isEmpty() and s.allow.isEmpty()


def test_paths_are_not_kept(spark):
    kept = pj._kept(pj.base(spark, SF))
    assert all(c not in k.columns for k in kept.values() for c in ("src", "dst", "path"))
    assert all("/" not in str(v) for r in kept["edge"].limit(500).collect() for v in r)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_dealt_before_they_are_grouped(spark):
    from lattica.operators import delta as dl

    rows = spark.createDataFrame([("A", "p", "x"), ("B", "p", "x"), ("B", "q", "y")], "snapshot_id string, path string, name string")
    both = dl.both(rows, dl.pair(spark), ["path", "name"])
    plan = _plan(both)
    below = plan[plan.index("Exchange hashpartitioning(path") :]
    assert "HashAggregate" not in below, plan
    assert {tuple(r)[1:] for r in both.collect()} == {("p", "x", True, True), ("q", "y", False, True)}


def test_sources_are_lexed_once(spark):
    from lattica.queries import QUERIES

    assert "MapInPandas" not in _plan(QUERIES["ext_packages"](spark, SF))


def test_named_pairs_are_sent_along(spark):
    """of pairs made of rows from Python no size is known, and tables were dealt by snapshot to be joined with them."""
    from lattica.operators import delta as dl

    plan = _plan(dl.edges(pj.trade(spark, SF), dl.pair(spark)))
    assert "hashpartitioning(snapshot_id" not in plan and "BroadcastHashJoin" in plan, plan


def test_tallies_move_rows_once(spark):
    """all axes were dealt by key and then again by what keys belong to."""
    from lattica.operators import delta as dl

    plan = _plan(dl.tallies(pj.trade(spark, SF), dl.pair(spark), arrows=False))
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and ("g0#" in line or "tag#" in line)]
    assert len(dealt) == 1, plan


def test_lines_are_grouped_where_they_lie(spark):
    """what is kept of lines was dealt anew for each table."""
    s = pj.trade(spark, SF)
    s.snapshot.count()
    name = next(v for k, v in pj._WRITTEN.items() if k[0] == spark.sparkContext.applicationId and k[1:] == (SF, False, "base"))
    for table in ("edge", "witness", "invariant"):
        assert "Exchange" not in _plan(pj._kept(spark.table(name))[table])


def test_ends_outside_are_found_once(spark):
    """arrows were dealt by either end to be matched with boxes."""
    from lattica.operators import filters as flt
    from lattica.schema import TABLES, Snapshots

    rows = lambda name, *rows: spark.createDataFrame(list(rows), TABLES[name])
    box = lambda sid, path, own=True: (sid, path, path, own, False, 0)
    arrow = lambda sid, src, dst: (sid, src, "call", dst, "cross", 0)
    s = Snapshots.of(spark, package=rows("package", box("A", "x"), box("A", "y"), box("A", "fmt", False), box("B", "x")), edge=rows("edge", arrow("A", "x", "y"), arrow("A", "x", "fmt"), arrow("A", "x", "gone"), arrow("B", "x", "y"), arrow("A", "x", None), arrow("A", None, "x"), arrow("B", "x", "x")))
    inside = flt.internal_edges(s)
    assert sorted(tuple(r) for r in inside.collect()) == [("A", "x", "call", "y"), ("B", "x", "call", "x")]
    assert {tuple(r) for r in flt.told_internal(s).where("internal").drop("internal").collect()} == {("A", "x", "call", "y"), ("B", "x", "call", "x")}
    t = pj.trade(spark, SF)
    plan = _plan(flt.internal_edges(t))
    assert "hashpartitioning(" not in plan, plan
    assert flt.outside_ends(t) is flt.outside_ends(t)


def test_dependents_deal_arrows_once(spark):
    """arrows were derived three times, and dealt to be joined with seeds."""
    from lattica.operators import graph as gr

    rows = [("A", "a", "b"), ("A", "b", "c"), ("A", "d", "c"), ("A", "c", "d"), ("A", "x", "y"), ("B", "a", "c"), ("A", "b", "c")]
    pairs, reads = spark.createDataFrame(rows, "snapshot_id string, src string, dst string"), []

    class Counted:
        def select(self, *cols):
            reads.append(cols)
            return pairs.select(*cols)

    got = {tuple(r) for r in gr.dependents(Counted(), "c").collect()}
    assert got == {("A", "a", False), ("A", "b", True), ("A", "d", True), ("B", "a", True)}
    assert len(reads) == 1


def test_repeated_names_are_not_sent_along(spark):
    """Small files whose names repeat were broadcast, and filled the driver."""
    from pyspark.sql import functions as F

    from lattica.shared import written

    name = F.concat(F.lit("tpch/p"), (F.col("id") % 1000).cast("string"), F.lit("/a/long/name/that/repeats"))
    t = written(spark.range(400000).select("id", *[name.alias(c) for c in "abc"]))
    plan = _plan(t.join(t.select("id", F.col("a").alias("d")), "id"))
    assert "BroadcastHashJoin" not in plan, plan


def test_rows_are_not_crossed_with_modules(spark):
    """rows of sources were multiplied with a table of one module, and read again for each of its partitions."""
    from lattica.sources import golang

    rows = spark.createDataFrame([("a.go", "p", False, "func", "Run", "", "()")], golang.FACT)
    s = golang.snapshot(rows, "m", "A")
    plan = _plan(s.symbol)
    assert "CartesianProduct" not in plan, plan
    assert [tuple(r)[:5] for r in s.symbol.collect()] == [("A", "m/p", "surface", "func", "Run")]


def test_snapshots_against_themselves_are_not_matched(spark, monkeypatch):
    """half of the rows that agg_median grouped were those of years against themselves."""
    from lattica.operators import delta as dl
    from lattica.operators import history as hs

    given, both = [], dl.both
    monkeypatch.setattr(dl, "both", lambda df, pairs, *a, **k: given.append(pairs) or both(df, pairs, *a, **k))
    t = pj.trade(spark, SF)
    got = {r.pair_id: r for r in hs.sizes(t, dl.named_pairs(spark, ["AB", "AA"])).collect()}
    assert [r.pair_id for r in given[0].collect()] == ["A..B"]
    assert got["A..A"].empty and got["A..A"].d_items == 0 and not got["A..B"].empty and got["A..B"].d_items > 0
    plan = _plan(hs.sizes(t, dl.pair(spark)))
    assert "SortAggregate" not in plan, plan


def test_arrows_of_components_are_not_dealt_by_box(spark):
    """arrows were dealt by either end to be matched with the components of boxes."""
    from lattica.operators import components as cp

    plan = _plan(cp.rolled(pj.trade(spark, SF), 2))
    assert plan.count("Exchange hashpartitioning(") == 1, plan


def test_coverage_is_made_of_later_versions_only(spark):
    """what covers contracts was found for all versions, and then left out but for the later ones."""
    from lattica.operators import delta as dl
    from lattica.schema import TABLES, Snapshots

    rows = lambda name, *rows: spark.createDataFrame(list(rows), TABLES[name])
    s = Snapshots.of(spark, witness=rows("witness", *[(v, "p", "implements", "q", "cross", "T |= I") for v in "AB"]), guard=rows("guard", ("A", "p", "t", "q.I")), exercise=rows("exercise", ("A", "p", "t", "p.T")))
    for ends, left in (("AB", {"B"}), ("BA", {"A"})):
        later = dl.narrowed(s, dl.pair(spark, *ends), "b", "witness")
        assert {r.snapshot_id for r in later.witness.collect()} == left and later.guard is None
    assert dl.contracts(s, dl.pair(spark)).isEmpty()
