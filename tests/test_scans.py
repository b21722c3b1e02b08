"""Scans over ranges, components and blast radius against brute force; sizes of plans that must not gather."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lattica.operators import delta as dl
from lattica.operators import filters as flt
from lattica.operators import graph as gr
from lattica.operators import ranks


def test_ranks_and_running_values(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "a", "b", "c", None]), i, r.choice([None, None, None, f"v{i}"]), r.choice([None, r.randrange(99)])) for i in range(300)] + [("one", i, None, None) for i in range(40)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, v string, n int").repartition(7)
    last, most, count = {}, {}, Counter()
    want = {}
    for g, i, v, n in sorted(rows, key=lambda x: x[1]):
        count[g] += 1
        last[g] = v if v is not None else last.get(g)
        most[g] = max((x for x in (n, most.get(g)) if x is not None), default=None)
        want[g, i] = (count[g], last[g], most[g])
    got = ranks.ranked(df, ["g"], [F.col("i")])
    assert {(x.g, x.i): x["rank"] for x in got.collect()} == {k: v[0] for k, v in want.items()}
    assert {(x.g, x.i): x.u for x in ranks.running(df, ["g"], [F.col("i")], "v", "u").collect()} == {k: v[1] for k, v in want.items()}
    assert {(x.g, x.i): x.u for x in ranks.running(df, ["g"], [F.col("i")], "n", "u", "max").collect()} == {k: v[2] for k, v in want.items()}
    assert ranks.ranked(df, [], [F.col("g").asc_nulls_first(), F.col("i")]).agg(F.max("rank")).first()[0] == len(rows)
    # No window is opened over a whole group.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and all("_part" in x for x in plan.splitlines() if x.strip().startswith("Window") or " Window " in x)
    assert ranks.ranked(df.where("false"), ["g"], [F.col("i")]).count() == ranks.running(df.where("false"), ["g"], [F.col("i")], "v", "u").count() == 0


def test_touched_spans_and_suffixes(spark):
    r = random.Random(6)
    spans = [(f"f{i}", r.choice("xyz"), lo := r.randrange(200), lo + r.randrange(9)) for i in range(120)]
    ranges = [(r.choice("xyw"), lo := r.randrange(200), lo + r.randrange(5)) for _ in range(25)] + [("z", 9, 3), ("x", 0, 0)]
    got = flt.touched_spans(spark.createDataFrame(spans + spans[:5], "fn string, file string, lo int, hi int"), spark.createDataFrame(ranges + ranges, "file string, lo int, hi int"))
    assert sorted(map(tuple, got.collect())) == sorted({s for s in spans if any(s[1] == f and s[2] <= b and a <= s[3] and a <= b for f, a, b in ranges)})
    files, names = ["/x/a/b.go", "/x/bb.go", "b.go", "", "/é.go"], ["b.go", "a/b.go", "bb.go", ".go", "c.go", "é.go", "/x/a/b.go/longer"]
    found = flt.by_suffix(spark.createDataFrame([(f,) for f in files], "file string"), spark.createDataFrame([(n,) for n in names], "file string"))
    assert sorted(map(tuple, found.collect())) == sorted((f, n) for f in files for n in names if f.endswith(n))


def fold(paths):
    out = ""
    for p in paths:
        if not out:
            out = p
            continue
        a, b = out.split("/"), p.split("/")
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        out = "/".join(a[:k])
    return out


def test_shared_prefix_is_the_fold_in_order(spark):
    r = random.Random(2)
    lists = {f"p{i}": ["/".join([r.choice("xxxy"), *[r.choice("ab") for _ in range(r.randrange(4))]]) for _ in range(r.randrange(1, 12))] for i in range(250)}
    rows = [(k, i, p) for k, ps in lists.items() for i, p in enumerate(ps)]
    r.shuffle(rows)
    got = {x.pair_id: x.prefix for x in dl.shared_prefix(spark.createDataFrame(rows, "pair_id string, i int, path string"), ["i"]).collect()}
    assert got == {k: fold(ps) for k, ps in lists.items()}
    cut = spark.createDataFrame([("a/b/c", "a/b"), ("a/b", "a/b"), ("a/bc", "a/b"), ("x", "")], "path string, prefix string").select(dl.shortened(F.col("path"), F.col("prefix")).alias("s"))
    assert [x.s for x in cut.collect()] == ["c", "a/b", "a/bc", "x"]


def reach_of(edges):
    out, reach = defaultdict(set), defaultdict(set)
    for a, b in edges:
        if a != b:
            out[a].add(b)
    nodes = {n for e in edges for n in e}
    for n in nodes:
        todo = [n]
        while todo:
            for y in out[todo.pop()] - reach[n]:
                reach[n].add(y)
                todo.append(y)
    blast = {n: sum(m != n and n in reach[m] for m in nodes) for n in nodes}
    return {n: k for n, k in blast.items() if k}, {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if n in reach[n]}


def test_components_and_blast_radius(spark):
    rows, blast, cycle = [], {}, {}
    for g in range(10):
        r = random.Random(g)
        n = r.choice([3, 6, 12, 20])
        e = {(r.randrange(n), r.randrange(n)) for _ in range(r.choice([n, 2 * n]))}
        if g % 3 == 0:  # a path with a few arrows back and across
            e = {(i, i + 1) for i in range(n - 1)} | {(r.randrange(n), r.randrange(n)) for _ in range(2)}
        elif g % 3 == 1:  # a ring with a way in and a way out
            e = {(i, (i + 1) % n) for i in range(n)} | {(n + 1, r.randrange(n)), (r.randrange(n), n + 2)}
        edges = [(f"n{a:02d}", f"n{b:02d}") for a, b in e]
        b, c = reach_of(edges)
        rows += [(f"g{g}", *x) for x in edges]
        blast |= {(f"g{g}", k): v for k, v in b.items()}
        cycle |= {(f"g{g}", k): v for k, v in c.items()}
    ring = [("ring", f"r{i:04d}", f"r{(i + 1) % 300:04d}") for i in range(300)]
    df = spark.createDataFrame(rows + ring, "snapshot_id string, src string, dst string")
    found = gr.cycles(df).cache()
    got = {(x.snapshot_id, x.path): x.cycle for x in found.collect()}
    assert got == cycle | {("ring", f"r{i:04d}"): "r0000" for i in range(300)}
    # A ring's boxes share one set: no row for each pair of them.
    assert {(x.snapshot_id, x.path): x.blast_radius for x in gr.blast_radius(df, found).collect()} == blast | {("ring", f"r{i:04d}"): 299 for i in range(300)}


def test_closure_kept_up_over_versions(spark):
    """Random histories, side by side: each version's closure from the last one's equals the closure made anew."""
    r, n = random.Random(11), 9
    now = {h: {(r.randrange(n), r.randrange(n)) for _ in range(r.choice([6, 10, 16]))} for h in range(8)}
    frame = lambda of: spark.createDataFrame([(f"h{h}", f"n{a}", f"n{b}") for h, e in of.items() for a, b in e], "snapshot_id string, src string, dst string")
    whole = lambda of: {(f"h{h}", f"n{a}", f"n{b}") for h, e in of.items() for a, b in brute_closure(e)}
    reach = gr.closure(frame(now))
    assert set(map(tuple, reach.select("snapshot_id", "src", "dst").collect())) == whole(now)
    for _ in range(2):
        after = {h: {x for x in e if r.random() < 0.7} | {(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(4))} for h, e in now.items()}
        reach = gr.closure_after(reach, frame(now), frame(after))
        rows = [tuple(x) for x in reach.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == whole(after)
        now = after
    # Nothing moved: nothing is derived.
    assert set(map(tuple, gr.closure_after(reach, frame(now), frame(now)).collect())) == whole(now)


def brute_closure(edges):
    out = set(edges)
    while more := {(a, d) for a, b in out for c, d in out if b == c} - out:
        out |= more
    return out


def test_cleaning_up(spark, tmp_path):
    from lattica import shared

    t = shared.written(spark.range(3).toDF("i"))
    at = t._lattica_at.removeprefix("file://")
    import os

    assert os.path.exists(at) and t.count() == 3
    shared.forget(t)
    assert not os.path.exists(at)
    other = shared.written(spark.range(3).toDF("i"))._lattica_at.removeprefix("file://")
    spark.sparkContext._lattica_made = [f"file://{other}"]  # only this one: other tests' tables stay
    shared.clean(spark)
    assert not os.path.exists(other) and spark.sparkContext._lattica_made == []


def test_small_pieces_are_solved_where_they_lie(spark, monkeypatch):
    """a graph of many small pieces went through all rounds of the kernels."""

    def rounds(*_):
        raise AssertionError("rounds")

    rows = [(f"s{g % 2}", f"g{g}n{a}", f"g{g}n{b}") for g in range(40) for a, b in ((0, 1), (1, 2), (2, 0), (2, 3), (4, 3), (5, 5))]
    df = spark.createDataFrame(rows, "snapshot_id string, src string, dst string")
    want = {(s, a, b) for s in ("s0", "s1") for a, b in brute_closure({(a, b) for t, a, b in rows if t == s})}
    with monkeypatch.context() as m:
        for name in ("_components", "_doubled", "_blast_radius", "_closure_after"):
            m.setattr(gr, name, rounds)
        parts = gr.pieces(df)
        assert parts[1] is None and set(map(tuple, gr.closure(df).collect())) == want
        assert {tuple(r)[1:] for r in gr.cycles(df, parts).collect()} == {(f"g{g}n{i}", f"g{g}n0") for g in range(40) for i in range(3)}
        assert {r.path: r.blast_radius for r in gr.blast_radius(df, parts=parts).where("path like 'g7n%'").collect()} == {"g7n0": 2, "g7n1": 2, "g7n2": 2, "g7n3": 4}
    # Where hashes bring pieces together that are too large then, they go through the rounds.
    monkeypatch.setattr(gr.F, "xxhash64", lambda *_: gr.F.lit(1).cast("long"))
    small, rest = gr.pieces(df)
    assert small.isEmpty() and {tuple(r) for r in rest.select("snapshot_id", "src", "dst").collect()} == set(rows)
