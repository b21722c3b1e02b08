"""Graph operators: plan scenarios, traps, and properties on random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.cli import united
from lattica.operators import components as cp
from lattica.operators import conform as cf
from lattica.operators import delta as dl
from lattica.operators import filters as flt
from lattica.operators import graph as gr
from lattica.operators import history as hs
from lattica.operators import metrics as me
from lattica.plans import distance as pd
from lattica.plans import dsl
from lattica.render import pictures
from lattica.schema import Snapshots
from lattica.sources import documents, git, golang, usage

PLAN = """
invariant steady {
  statement: same input, same output
}
box ex.com/m/core
box ex.com/m/hash
hole ex.com/m/chain {
  surface:
    Find(Key) Result
    Count() int
  allow:
    import ex.com/m/core
    import ex.com/m/hash
  contract:
    C1 only once   [evidenced: test]
    C2 never lost  [checked: types]
    C3 prose
  cites:
    invariant steady
}
arrow ex.com/m/core -> ex.com/m/chain : import
arrow ex.com/m/chain -> ex.com/m/core : import
"""


def graph(packages, edges=(), module="m", local=()):
    pk = [{"path": p, "name": p.rsplit("/", 1)[-1], "internal": True, **(packages[p] if isinstance(packages, dict) else {})} for p in packages]
    arrow = lambda e: {"from": e[0], "to": e[1], "kind": e[2] if len(e) > 2 else "import", "witnesses": list(e[3]) if len(e) > 3 else []}
    return {"module": module, "packages": pk, "edges": [arrow(e) for e in edges], "localImplements": [arrow(e) for e in local]}


def snaps(spark, **docs):
    return documents.normalise(documents.from_dicts(spark, docs))


def both(spark, a, b):
    return snaps(spark, A=a, B=b), dl.pair(spark)


def test_compile_and_diagnostics():
    plan = dsl.compile_plan(PLAN)
    assert not plan.problems and len(plan.packages) == 3 and len(plan.edges) == 2
    assert dsl.stats(plan.document()) == "3 clauses: 1 checked, 1 evidenced, 0 attested:external, 0 attested:design, 1 unclassified"
    assert "Find(Key) Result" in dsl.slice_of(plan.document(), "ex.com/m/chain")
    for path in ("ex.com/m/none", "ex.com/m/core"):
        with pytest.raises(ValueError):
            dsl.slice_of(plan.document(), path)
    bad = lambda s: dsl.compile_plan(s).problems
    assert bad("arrow a b\n") == [(1, 'malformed arrow: "arrow a b"')]
    assert bad("hole x {\nsurface:\n F()") == [(3, 'unterminated hole block "x" (missing closing \'}\')')]
    assert bad("invariant x {\n") == [(2, 'unterminated invariant block "x" (missing closing \'}\')')]
    assert bad("hole x {\ncites:\ninvariant no\n}") == [(3, 'undeclared invariant "no" cited by x')]
    assert bad("hole x {\nF()\n}") == [(2, 'content outside a section: "F()"')]
    assert bad("hole x {\nallow:\nfoo bar\nimport\n}") == [(3, 'unknown allow kind: "foo"'), (4, 'malformed allow entry: "import"')]
    assert bad("nonsense") == [(1, 'unexpected: "nonsense"')] and bad("hole x") == [(1, "malformed hole declaration")]
    assert dsl.compile_plan("hole x {\nallow:\nmetric a\nservice b\n}").edges == [{"from": "x", "to": "a", "kind": "config"}, {"from": "x", "to": "b", "kind": "service"}]
    assert "stroke-dasharray" in pictures.plan(plan.document()) and dsl.compile_plan("").document()["packages"] == []


def test_distance_ratchet_and_classes(spark):
    plan = snaps(spark, plan=dsl.compile_plan(PLAN).document())
    full = {"ex.com/m/core": {"files": ["a.go"]}, "ex.com/m/hash": {"files": ["a.go"]}, "ex.com/m/chain": {"files": ["c.go"], "surface": [{"kind": "type", "name": "Find"}, {"kind": "func", "name": "Count"}]}}
    arrows = [("ex.com/m/core", "ex.com/m/chain"), ("ex.com/m/chain", "ex.com/m/core")]
    part = {**full, "ex.com/m/chain": {"files": ["c.go"], "surface": [{"kind": "func", "name": "Find"}]}}
    hollow = {**full, "ex.com/m/chain": {}}
    s = snaps(spark, empty=graph({}), full=graph(full, arrows), part=graph(part, arrows[:1]), hollow=graph(hollow, arrows), off=graph({**full, "ex.com/m/z": {}}, [*arrows, ("ex.com/m/chain", "ex.com/m/z"), ("ex.com/m/core", "ex.com/m/hash")]), bad=graph({**full, "ex.com/m/chain": {**full["ex.com/m/chain"]}}, [*arrows, ("ex.com/m/chain", "ex.com/m/chain")]))
    got = {r.snapshot_id: (r.total, r.c1, r.c2, r.c3, r.c4) for r in pd.distance(plan, s).collect()}
    assert got == {"empty": (5, 1, 2, 2, 0), "full": (0, 0, 0, 0, 0), "part": (2, 1, 0, 1, 0), "hollow": (1, 1, 0, 0, 0), "off": (0, 0, 0, 0, 0), "bad": (1, 0, 0, 0, 1)}
    said = {r.snapshot_id: r.detail for r in pd.unmet(plan, s).where("class = 'C1'").collect()}
    assert said == {"empty": "hole declared, package absent in actual", "part": "hole filled but surface mismatch: declared 2, actual 1", "hollow": "hole declared, package exists but has no interior"}
    pairs = spark.createDataFrame([(x + y, x, y) for x, y in (("empty", "full"), ("full", "full"), ("full", "part"), ("full", "bad"), ("full", "off"))], "pair_id string, a string, b string")
    assert {r.pair_id: r["class"] for r in pd.classify(plan, s, pairs).collect()} == {"emptyfull": "REALIZES", "fullfull": "UNRELATED", "fullpart": "CONFLICTS", "fullbad": "CONFLICTS", "fulloff": "EXCEEDS"}
    assert {r.pair_id: r.ok for r in pd.ratchet(plan, s, pairs).collect()}["fullpart"] is False
    assert pd.distance(plan, snaps(spark, p=dsl.compile_plan(PLAN).document())).first().total == 0
    text = pictures.distance(pd.distance(plan, s).where("snapshot_id = 'empty'").first(), pd.unmet_order(pd.unmet(plan, s).where("snapshot_id = 'empty'")).collect())
    assert text.startswith("dist(P,G) = 5\n  unfilled holes (C1): 1\n") and text.count("[C2]") == 2


def test_delta_axes_and_traps(spark):
    sym = lambda n, sig="": {"kind": "func", "name": n, "sig": sig}
    inv = lambda n, h, g=(), e=(): {"name": n, "file": "t", "hash": h, "guards": list(g), "exercises": list(e)}
    a = graph({"m/a": {"surface": [sym("F", "1"), sym("G")], "invariants": [inv("T1", "x", ["m/b.I"], ["m/a.A"]), inv("T2", "x")]}, "m/b": {"schema": [sym("S.x")]}, "m/gone": {"surface": [sym("Z")]}}, [("m/a", "m/b", "call", ["P", "Q"]), ("m/a", "m/b", "implements", ["A |= I"]), ("m/gone", "m/a")])
    b = graph({"m/a": {"surface": [sym("F", "2"), sym("H")], "invariants": [inv("T1", "y", ["m/b.J"]), inv("T3", "x")]}, "m/b": {"schema": [sym("S.x"), sym("S.y")]}, "fmt": {"internal": False}}, [("m/a", "m/b", "call", ["P"]), ("m/a", "fmt")])
    s, pairs = both(spark, a, b)
    rows = lambda df: sorted(tuple(r)[1:] for r in df.collect())
    assert rows(dl.packages(s, pairs)) == [("fmt", "added", False), ("m/gone", "removed", True)]
    assert rows(dl.edges(s, pairs)) == [("m/a", "implements", "m/b", "removed"), ("m/a", "import", "fmt", "added"), ("m/gone", "import", "m/a", "removed")]
    assert rows(dl.symbols(s, pairs, "surface")) == [("m/a", "func", "G", "removed"), ("m/a", "func", "H", "added")]
    assert rows(dl.symbols(s, pairs, "schema")) == [("m/b", "func", "S.y", "added")]
    assert rows(dl.invariants(s, pairs)) == [("m/a", "T1", "modified"), ("m/a", "T2", "removed"), ("m/a", "T3", "added")]
    assert rows(dl.touched_promises(s, pairs)) == [("m/a", "m/b.I"), ("m/a", "m/b.J")]
    w = {(r.kind, r.status): list(r.remaining) for r in dl.witnesses(s, pairs).where("dst = 'm/b'").collect()}
    assert w == {("call", "WEAKENED"): ["P"], ("implements", "REMOVED"): []}
    assert dl.witness_verdict(dl.witnesses(s, pairs)).first()[1:] == (2, 1)  # m/gone took an arrow with it
    c = dl.contracts(s, pairs).first()
    assert (c.iface, c.removed, c.added, c.covered) == ("m/b.I", ["m/a.A"], [], [])
    assert [tuple(r)[1:] for r in dl.gap_kinds(s).collect()] == [("m/b.I", "none")]
    assert dl.verdict(s, pairs).first().verdict == "ARCHITECTURAL_CHANGE"
    same, p2 = both(spark, a, a)
    assert dl.verdict(same, p2).first().verdict == "NO_CHANGE" and dl.edges(same, p2).isEmpty()
    quiet = graph({**{p["path"]: {k: v for k, v in p.items() if k not in ("path", "name")} for p in a["packages"]}, "m/b": {"schema": []}}, [(e["from"], e["to"], e["kind"], []) for e in a["edges"]])
    assert dl.verdict(*both(spark, a, quiet)).first().verdict == "NO_CHANGE"
    text = pictures.review(s, pairs) + pictures.delta_text(s, pairs) + pictures.change(s, pairs) + pictures.change(s, pairs, "dot", True) + pictures.contract_picture(dl.contracts(s, pairs)) + pictures.witness_picture(dl.witnesses(s, pairs), "dot")
    assert "ARCHITECTURAL_CHANGE" in text and "WEAKENED" in text


def test_allow_list_layers_and_gate(spark):
    a = graph(["m/a", "m/b", "m/c"], [("m/a", "m/b")])
    b = graph(["m/a", "m/b", "m/c"], [("m/a", "m/b"), ("m/a", "m/c"), ("m/b", "m/c")])
    s, pairs = both(spark, a, b)
    declared = spark.createDataFrame([("m/a",), ("m/c",)], "path string")
    allowed = spark.createDataFrame([("m/a", "m/b")], "path string, target string")
    assert [tuple(r)[1:] for r in dl.violations(s, pairs, declared, allowed).collect()] == [("m/a", "import", "m/c", True)]
    snap = {r.path: r.targets for r in cf.allow_snapshot(s).where("snapshot_id = 'B'").collect()}
    assert snap == {"m/a": ["m/b", "m/c"], "m/b": ["m/c"], "m/c": []}
    layers = spark.createDataFrame([("low", 1), ("high", 0)], "layer string, ord int")
    where = spark.createDataFrame([("a", "low"), ("b", "high")], "seg string, layer string")
    rows = cf.layered(s, layers, where).where("snapshot_id = 'B'")
    assert sorted(r.direction for r in rows.collect()) == ["unmapped", "unmapped", "up"] and [r.seg for r in cf.unmapped(rows).collect()] == ["c"]
    up = cf.reflexion(s, layers, where).where("snapshot_id = 'B'").first()
    assert (up["from"], up["to"], up["count"], up.from_layer, up.from_layer_name) == ("low", "high", 1, "", "low")
    x = graph({"m/b": {"surface": [{"kind": "func", "name": "F"}]}})
    y = graph({"m/b": {"surface": [{"kind": "func", "name": n} for n in "FGH"]}})
    t, p = both(spark, x, y)
    fixed, widen = spark.createDataFrame([("m/b",)], "path string"), spark.createDataFrame([("m/b", "G")], "path string, name string")
    assert [r.name for r in cf.surface_widenings(t, p, fixed, widen).collect()] == ["H"] and cf.surface_widenings(t, p, fixed.limit(0)).isEmpty()


def test_percentile_floor_is_its_own(spark):
    df = spark.createDataFrame([("x", v) for v in (0, 1, 2, 3, 9, 10)], "snapshot_id string, v int")
    assert df.groupBy().agg(me.percentile_floor("v", 0.75)).first()[0] == 3 and me.cutoffs(df, "v", 0.75).first().cut == 3


def test_kernels_against_plain_python(spark):
    r = random.Random(4)
    for _ in range(3):
        n = r.randint(3, 9)
        edges = {(f"m/{r.randrange(n)}", f"m/{r.randrange(n)}") for _ in range(2 * n)}
        nodes = [f"m/{i}" for i in range(n)]
        s = snaps(spark, A=graph(nodes, sorted(edges)))
        step = {(a, b) for a, b in edges if a != b}
        reach = set(step)
        while more := {(a, d) for a, b in reach for c, d in step if b == c} - reach:
            reach |= more
        got = gr.closure(flt.dep_pairs(s))
        assert {(x.src, x.dst) for x in got.collect()} == reach
        assert {x.path: x.blast_radius for x in gr.blast(got).collect()} == {v: k for v in nodes if (k := len({a for a, b in reach if b == v and a != v}))}
        scc = {v: min({v} | {u for u in nodes if (u, v) in reach and (v, u) in reach}) for v in nodes if any((u, v) in reach and (v, u) in reach and u != v for u in nodes)}
        assert {x.path: x.cycle for x in gr.cycles(got).collect()} == scc
        assert {x.path for x in gr.dependents(flt.dep_pairs(s), "m/0").collect()} == {a for a, b in reach if b == "m/0"} - {"m/0"}
        assert {x.path: x.in_cycle for x in me.health(s).select("path", F.col("cycle").isNotNull().alias("in_cycle")).collect()} == {v: v in scc for v in nodes}
        assert "package" in pictures.health(me.health(s))


def test_delta_is_symmetric_on_random_graphs(spark):
    r = random.Random(8)
    make = lambda: graph([f"m/{i}" for i in range(6) if r.random() < 0.8], [(f"m/{r.randrange(6)}", f"m/{r.randrange(6)}", r.choice(("import", "call"))) for _ in range(9)])
    s = snaps(spark, A=make(), B=make())
    there, back = dl.pair(spark, "A", "B"), dl.pair(spark, "B", "A")
    flip = {"added": "removed", "removed": "added"}
    assert {(x.src, x.kind, x.dst, flip[x.change]) for x in dl.edges(s, there).collect()} == {(x.src, x.kind, x.dst, x.change) for x in dl.edges(s, back).collect()}


def test_components_cycles_and_paint(spark):
    s, pairs = both(spark, graph(["m/a/x", "m/b/y"], [("m/a/x", "m/b/y"), ("m/b/y", "m/a/x")]), graph(["m/a/x", "m/b/y"], [("m/a/x", "m/b/y")]))
    got = {r.comp: (r.in_cycle, r.change) for r in cp.painted(s, pairs, 1).collect()}
    assert got == {"a": (True, "boundary"), "b": (True, "boundary")}
    assert "linkStyle" in pictures.components(cp.painted(s, pairs, 1), cp.edge_changes(s, pairs, 1))


def test_diff_lines_and_intervals(spark):
    lines = ["+++ b/x.go", "@@ -1,2 +3,4 @@", "+a", "@@ -9 +20 @@", "+++ b/y.go", "@@ -1 +5,0 @@"]
    d = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "diff_id string, line_no int, text string")
    ranges = flt.changed_files(d)
    assert sorted(tuple(r)[1:] for r in ranges.collect()) == [("x.go", 3, 6), ("x.go", 20, 20), ("y.go", 5, 5)]
    spans = spark.createDataFrame([("f", "x.go", 1, 3), ("g", "x.go", 7, 19), ("h", "y.go", 1, 500)], "fn string, file string, lo int, hi int")
    assert {r.fn for r in flt.touched_spans(spans, ranges.drop("diff_id")).collect()} == {"f", "h"}


def test_history(spark):
    order = spark.createDataFrame([("c", 3), ("a", 1), ("b", 2)], "snapshot_id string, seq int")
    assert [(r.a, r.b) for r in hs.consecutive(order).orderBy("a").collect()] == [("a", "b"), ("b", "c")]
    lines = spark.createDataFrame([("p", "3\t1\ta.go"), ("p", "-\t-\tb.png"), ("p", "5\t0\ta_test.go")], "pair_id string, text string")
    assert tuple(hs.numstat(lines).first())[1:] == (3, 8, 1, 1, 3, 1)
    rows = spark.createDataFrame([("feat(x): y", True), ("Fix: z", False), ("what", True)], "subject string, empty boolean")
    assert [tuple(r) for r in hs.strata(rows).collect()] == [("feat", 1, 1.0), ("fix", 1, 0.0), ("other", 1, 1.0)]


def test_smells_and_interface_delta(spark):
    schema = "snapshot_id string, iface string, pkg string, methods array<string>, implementers array<string>, consumer_pkgs array<string>, n_consumers int"
    facts = spark.createDataFrame([("A", "p.I", "p", [], ["q.T"], ["p"], 1), ("B", "p.I", "p", [], ["q.T"], ["p", "r"], 2), ("B", "p.J", "p", [], [], [], 0)], schema)
    assert [r.smell for r in cf.smells(facts).collect()] == ["STRANDED", "single-impl cross-boundary", "unconsumed"]
    got = {r.iface: (r.status, r.unstranded) for r in cf.interface_delta(facts, dl.pair(spark)).collect()}
    assert got == {"p.I": ("MODIFIED", True), "p.J": ("ADDED", False)} and cf.interesting(facts).count() == 3


GO = {
    "go.mod": "module ex.com/m\n",
    "store/store.go": 'package store\n\nimport (\n\t"os"\n\tpg "github.com/lib/pq"\n\t"net/http"\n)\n\ntype Store interface {\n\tGet(k string) (int, error)\n}\n\ntype Row struct {\n\tName, Alias string `json:"name"`\n\thidden int `json:"h"`\n\tPlain int\n}\n\nvar Default = 1\n\nfunc Open() { _ = os.Getenv("DB_" + "URL"); pg.Open() }\n\nfunc Routes(r Router) { r.Get("/items", nil); http.HandleFunc("POST /x", nil) }\n',
    "mem/mem.go": 'package mem\n\nimport "ex.com/m/store"\n\ntype Mem struct{}\n\n// Get is it.\nfunc (m *Mem) Get(k string) (int, error) {\n\tstore.Open()\n\treturn 0, nil\n}\n\nfunc small() {}\n',
    "mem/mem_test.go": 'package mem\n\nimport (\n\t"testing"\n\t"ex.com/m/store"\n\t"ex.com/m/mem"\n)\n\nfunc TestGet(t *testing.T) {\n\tvar s store.Store = &mem.Mem{}\n\t_ = s\n}\n\nfunc Testing() {}\n',
}


def test_go_sources(spark, tmp_path):
    for name, text in GO.items():
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_text(text)
    s = golang.extract(spark, f"file://{tmp_path}")
    edges = {(r.src.rsplit("/", 1)[-1], r.kind, r.dst, r.scope) for r in s.edge.collect()}
    assert {("mem", "import", "ex.com/m/store", "cross"), ("mem", "call", "ex.com/m/store", "cross"), ("mem", "implements", "ex.com/m/store", "cross"), ("store", "config", "env:DB_URL", "cross"), ("store", "service", "service:Postgres", "cross"), ("store", "capability", "cap:net", "cross"), ("store", "protocol", "api:GET /items", "cross"), ("store", "protocol", "api:POST /x", "cross")} <= edges
    syms = {(r.axis, r.kind, r.name) for r in s.symbol.collect()}
    assert {("surface", "type", "Store"), ("surface", "func", "Open"), ("surface", "method", "Mem.Get"), ("surface", "var", "Default"), ("schema", "field", "Row.Name"), ("schema", "field", "Row.Alias")} <= syms
    assert not any(n in ("Row.hidden", "Row.Plain", "small") for _, _, n in syms)
    assert [(r.name, r.iface) for r in s.guard.collect()] == [("TestGet", "ex.com/m/store.Store")] and [r.concrete for r in s.exercise.collect()] == ["ex.com/m/mem.Mem"]
    c = dl.coverage(s).first()
    assert (c.iface, c.covered, c.tests) == ("ex.com/m/store.Store", ["ex.com/m/mem.Mem"], ["TestGet"])
    at = f"file://{tmp_path}"
    functions, calls = usage.call_graph(usage.scan(spark, at), golang.scan(spark, at), "ex.com/m", "A")
    assert [(r.src, r.dst) for r in calls.collect()] == [("ex.com/m/mem.Mem.Get", "ex.com/m/store.Open")]
    assert "subgraph cluster_" in pictures.call_picture(functions, calls)
    doc = documents.document(s, "HEAD")
    again = documents.normalise(documents.from_dicts(spark, {"HEAD": doc}))
    assert {tuple(r) for r in again.edge.select("src", "kind", "dst").collect()} == {tuple(r) for r in s.edge.select("src", "kind", "dst").collect()}
    assert "graph LR" in pictures.graph(s) and "digraph" in pictures.graph(s, "dot", True)


def test_streamed_snapshots(spark, tmp_path):
    from lattica.streaming import landing

    snaps(spark, a=graph(["m/a", "m/b"]), b=graph(["m/a", "m/b"], [("m/a", "m/b")])).write(f"{tmp_path}/store")
    spark.createDataFrame([("a", 1), ("b", 2)], "snapshot_id string, seq long").coalesce(1).write.json(f"{tmp_path}/landed")
    landing.watch(spark, f"{tmp_path}/store", f"{tmp_path}/landed", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert [(r.src, r.dst, r.change) for r in spark.read.parquet(f"{tmp_path}/out/batch=0").collect()] == [("m/a", "m/b", "added")]


def test_united_keeps_both(spark):
    s = united(snaps(spark, A=graph(["m/a"])), snaps(spark, B=graph(["m/b"])))
    assert s.package.count() == 2


USAGE = {
    "go.mod": "module ex.com/m\n",
    "store/store.go": """package store

import "fmt"

type Store interface {
	Get(k string) (int, error)
	Base
}

type Base interface{ Close() }

type Idle interface{ Never() }

type Alias = Store

var _ Store = (*Mem)(nil)
var cur Store

type Server struct {
	Store Store
	extra map[string]Base
}

type Mem struct{ n int }

func (m *Mem) Get(k string) (int, error) { m.touch(); return helper(k), nil }
func (m *Mem) Close()                    {}
func (m *Mem) touch()                    {}
func helper(k string) int                { return 1 }

func Use(s Store, f func(Base) Store) (Store, error) {
	if x, ok := s.(Store); ok {
		_ = x
	}
	switch v := s.(type) {
	case Store:
		fmt.Println(v)
	}
	m := NewMem()
	m.touch()
	_ = Server{Store: s}
	return Store(s), nil
}

func NewMem() *Mem { return &Mem{} }
""",
    "flow/flow.go": """package flow

import st "ex.com/m/store"

type Engine struct{}

func (e *Engine) Add(x any) {}

type Tick struct{}

func (t *Tick) Execute(e *Engine) {
	e.Add(&Tock{})
	later(e)
}

type Tock struct{}

func (t *Tock) Execute(e *Engine) {}

type End struct{}

func (x *End) Execute(e *Engine) {}

type Other struct{}

func (o *Other) Execute(a, b *Engine) {}

func later(e *Engine) {
	e.Add(End{})
	var s st.Base
	m := st.NewMem()
	m.Close()
	_ = s
}
""",
}


def test_usage_of_interfaces_functions_and_events(spark, tmp_path):
    for name, text in USAGE.items():
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_text(text)
    where, module = f"file://{tmp_path}", "ex.com/m"
    facts, use = golang.scan(spark, where), usage.scan(spark, where)
    got = {r.fq: r for r in usage.interface_usage(use, facts, dl.implementers(golang.snapshot(facts, module, "A")), module).collect()}
    assert set(got) == {"store.Store", "store.Base", "store.Idle"}
    s = got["store.Store"]
    assert sorted(c.kind for c in s.consumers) == ["alias", "assertion", "field", "param", "result", "result", "type-ref", "type-switch", "var"]
    assert s.conformance_assertions == 1 and s.consumer_pkgs == ["store"] and not s.consumed_cross_package and s.methods == ["Get(k string)(int, error)"]
    b = got["store.Base"]
    assert sorted((c.pkg, c.kind) for c in b.consumers) == [("flow", "var"), ("store", "field"), ("store", "param")] and b.consumed_cross_package
    assert b.implementers == ["store.Mem"] and got["store.Idle"].candidate_unconsumed and got["store.Idle"].consumers == []
    assert "[CANDIDATE: unconsumed abstraction]" in pictures.consumption(module, usage.interface_usage(use, facts, dl.implementers(golang.snapshot(facts, module, "A")), module))
    functions, calls = usage.call_graph(use, facts, module)
    short = {(r.src.rsplit("/", 1)[1], r.dst.rsplit("/", 1)[1]) for r in calls.collect()}
    assert short == {("store.Mem.Get", "store.Mem.touch"), ("store.Mem.Get", "store.helper"), ("store.Use", "store.NewMem"), ("store.Use", "store.Mem.touch"), ("flow.Tick.Execute", "flow.Engine.Add"), ("flow.Tick.Execute", "flow.later"), ("flow.later", "flow.Engine.Add"), ("flow.later", "store.NewMem"), ("flow.later", "store.Mem.Close")}
    executes, made, engines = usage.events(use, facts, module)
    assert {r.event.rsplit(".", 1)[1] for r in executes.collect()} == {"Tick", "Tock", "End"} and {r.engine for r in engines.collect()} == {"Engine"}
    flow = gr.eventflow(executes, calls, made)
    assert {(r.src.rsplit(".", 1)[1], r.dst.rsplit(".", 1)[1], r["mode"]) for r in flow.collect()} == {("Tick", "Tock", "direct"), ("Tick", "End", "indirect")}
    assert "style=dashed" in pictures.event_picture(flow, gr.event_roles(flow, executes))


def test_commits_as_sources(spark, tmp_path):
    import subprocess

    repo, at = tmp_path / "repo", str(tmp_path / "store")
    git_ = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    (repo / "a").mkdir(parents=True)
    git_("init", "-q", "-b", "main")
    (repo / "go.mod").write_text("module ex.com/m\n")
    for i, (subject, text) in enumerate([("feat(a): one", "package a\n\nfunc One() {}\n"), ("fix: inside", "package a\n\nfunc One() { _ = 1 }\n"), ("feat: two", "package a\n\nfunc One() { _ = 1 }\nfunc Two() {}\n")]):
        (repo / "a" / "a.go").write_text(text)
        git_("add", ".")
        git_("commit", "-q", "-m", subject)
    got = git.history(spark, str(repo), 5, at).orderBy("subject").collect()
    assert [(r.subject, r.stratum, r.empty, r.d_surface, r.files, r.text_lines, r.go_lines) for r in got] == [("feat: two", "feat", False, 1, 1, 1, 1), ("fix: inside", "fix", True, 0, 1, 2, 2)]
    assert got[0].sha != got[1].sha and len(got[0].sha) == 8
    rows = spark.createDataFrame(got)
    # A second run extracts nothing, and a store never doubles a snapshot.
    before = Snapshots.read(spark, at)
    n = before.symbol.count()
    before.write(at)
    git.extract_at(spark, str(repo), "HEAD").write(at, again=True)
    assert git.history(spark, str(repo), 5, at).count() == 2 and Snapshots.read(spark, at).symbol.count() == n
    with pytest.raises(ValueError):
        git.extract_at(spark, str(repo), "nothing")
    one = hs.summary(rows).first()
    assert (one.n, one.n_empty, one.n_unclean, one.empty_median_text, one.empty_max_text, one.median_text, one.median_items, one.median_compression) == (2, 1, 0, 2, 2, 1, 1, 1)
    hs.write_csv(rows, f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == 2


def test_summary_splits_empty_and_boundary_changes(spark):
    rows = spark.createDataFrame([(10, 0, True, 0, 0), (40, 0, True, 1, 0), (7, 2, False, 0, 0), (100, 9, False, 0, 2), (9, 2, False, 0, 0)], "text_lines int, d_items int, empty boolean, err_a int, err_b int")
    assert tuple(hs.summary(rows).first()) == (5, 2, 2, 25, 40, 9, 2, 4)


def test_stats_count_every_package():
    document = {"packages": [{"path": "a", "invariants": [{"name": "x", "hash": "checked: y"}]}, {"path": "b", "hole": True, "invariants": [{"name": "z"}]}], "edges": []}
    assert dsl.stats(document) == "2 clauses: 1 checked, 0 evidenced, 0 attested:external, 0 attested:design, 1 unclassified"


def test_breaches_do_not_turn_the_verdict_and_counts_have_all_fields(spark):
    g = graph({"m/a": {"surface": [{"kind": "func", "name": "F"}]}, "m/b": {}}, [("m/a", "m/b")])
    s, pairs = both(spark, g, g)
    declared, permitted = spark.createDataFrame([("m/a",)], "path string"), spark.createDataFrame([], "path string, target string")
    off = dl.violations(s, pairs, declared, permitted)
    assert dl.verdict(s, pairs).first().verdict == "NO_CHANGE" and dl.triage_summary(s, pairs, off).first()[1:] == ("FAST-TRACK", 1, 0, "")
    n = dl.counts(s, pairs, off).first().asDict()
    assert n["violations"] == 1 and n["surface_widenings"] == 0 and len(n) == 13
    assert pictures.triage(s, pairs, off).startswith("verdict: FAST-TRACK")
    h = graph({"m/a": {"surface": [{"kind": k, "name": n} for k, n in (("func", "F"), ("var", "V"), ("type", "T"), ("func", "G"))]}, "m/b": {}, "m/c": {}}, [("m/a", "m/b"), ("m/a", "service:x", "service")])
    t, pairs = both(spark, g, h)
    text = pictures.triage(t, pairs, dl.violations(t, pairs, declared, permitted))
    assert "new packages:  c" in text and "violations:    1 allow-list breach(es)" in text and "surface +:     a.G, a.T, a.V" in text
    assert pictures.surface_changes(t, pairs) == "m/a\n  + type T\n  + func G\n  + var V\n"


def test_long_chains_and_rings(spark):
    """More rounds than any bound would allow, and rings among chains."""
    n = 300
    chain = [("S", f"a{i:04}", f"a{i + 1:04}") for i in range(n)]
    ring = [("S", f"r{i}", f"r{(i + 1) % 6}") for i in range(6)] + [("S", "a0005", "r3"), ("S", "r5", "z")]
    frame = lambda rows: spark.createDataFrame(rows, "snapshot_id string, src string, dst string")
    assert gr.closure(frame(chain)).count() == n * (n + 1) // 2
    got = {(r.snapshot_id, r.path): r.cycle for r in gr.cycles(frame(chain[:6] + ring + [("T", "x", "y"), ("T", "y", "x"), ("T", "x", "x")])).collect()}
    assert got == {("S", f"r{i}"): "r0" for i in range(6)} | {("T", "x"): "x", ("T", "y"): "x"}


def test_report_texts(spark):
    s = snaps(spark, A=graph({f"m/{x}": {"surface": [{"kind": "func", "name": f"F{i}"} for i in range(k)]} for x, k in (("sim", 5), ("kv", 1), ("cmd", 0))}, [("m/cmd", "m/kv"), ("m/kv", "m/sim"), ("m/cmd", "m/sim")]))
    assert pictures.impact("m/sim", gr.dependents(flt.dep_pairs(s), "m/sim")) == "BLAST RADIUS of m/sim\n  2 direct dependent(s), 2 total (transitive)\n  direct:   cmd\n  direct:   kv\n"
    lines = pictures.health(me.health(s)).splitlines()
    assert lines[:4] == ["ARCHITECTURE HEALTH", "  cycles: none — internal dependency graph is an acyclic DAG (healthy)", "  god-modules (high fan-in + large surface): kv, sim", "  coupling (top by blast radius):"]
    assert lines[5] == "    sim                               2       0      5     0.00      2  <god>"
    layers = spark.createDataFrame([("high", 0), ("low", 1)], "layer string, ord int")
    where = spark.createDataFrame([("sim", "high"), ("kv", "low")], "seg string, layer string")
    rows = cf.layered(s, layers, where)
    text = pictures.reflexion(["high", "low"], cf.layer_counts(rows), cf.reflexion(s, layers, where), cf.unmapped(rows))
    assert "  DIVERGENT (upward, layering violations): 1  (100% of cross-layer deps)" in text and "unmapped components (no layer assigned): cmd" in text
    assert pictures.evidence("x", dl.coverage(s)) == "CONTRACT EVIDENCE — x\n  (no interface contracts with implementers found)\n"
    loop = cp.single_cycles(snaps(spark, A=graph(["m/a/x", "m/b/y", "m/c/z"], [("m/a/x", "m/b/y"), ("m/b/y", "m/a/x"), ("m/b/y", "m/c/z")])), 1)
    assert {(r.src, r.dst): r.in_cycle for r in loop.collect()} == {("a", "b"): True, ("b", "a"): True, ("b", "c"): False}


def test_suffixes_and_documents_of_changes(spark, tmp_path):
    fns = spark.createDataFrame([("f", "/x/bb/a.go", 1, 9), ("g", "/x/c/a.go", 1, 9), ("h", "/x/ba.go", 5, 6)], "path string, file string, lo int, hi int")
    hit = lambda *rows: {r.path for r in flt.touched_functions(fns, spark.createDataFrame(rows, "file string, lo int, hi int")).collect()}
    assert hit(("b/a.go", 9, 12)) == {"f"} and hit(("a.go", 1, 1)) == {"f", "g"} and hit(("a.go", 6, 6), ("z.go", 1, 1)) == {"f", "g", "h"} and hit(("b/a.go", 10, 12)) == set()
    (tmp_path / "d.json").write_text('{"commitA": "1", "packagesAdded": [{"path": "m/a", "internal": true}], "edgesRemoved": [{"from": "m/a", "to": "m/b", "kind": "call"}], "surface": [{"package": "m/a", "added": [{"kind": "func", "name": "F"}]}], "invariants": [{"package": "m/a", "modified": ["T"]}]}')
    got = {k: [tuple(r) for r in df.collect()] for k, df in documents.delta_axes(spark, f"file://{tmp_path}/d.json").items()}
    assert got == {"packages": [("m/a", True, "added")], "edges": [("m/a", "call", "m/b", "removed")], "symbols": [("surface", "m/a", "func", "F", "added")], "invariants": [("m/a", "T", "modified")]}
    (tmp_path / "c.json").write_text('{"module": "m", "depth": 1, "components": [{"name": "a", "members": ["a/x"], "inCycle": true}], "edges": [{"from": "a", "to": "b", "kind": "dep", "change": "added"}]}')
    boxes, edges = documents.component_spec(spark, f"file://{tmp_path}/c.json")
    assert [tuple(r) for r in boxes.collect()] == [("a", ["a/x"], True, "")] and [tuple(r) for r in edges.collect()] == [("a", "b", "dep", "added")]


def test_ways_are_followed_by_stops(spark, monkeypatch):
    """all rows of a path were moved in each round of pointer jumping; now stops take up what lies between them."""
    n = 600
    way = [("R", f"w{i}", f"w{i + 1}", 1, f"w{i}") for i in range(n)]  # ends at w600, which is no row
    leaves = [("R", f"l{i}", f"w{i}", 1, f"l{i}") for i in range(0, n, 50)]
    ring = [("R", f"r{i:03}", f"r{(i + 1) % 200:03}", 1, f"r{i:03}") for i in range(200)]
    small = [("R", f"s{i}{a}", f"s{i}{b}", 1, f"s{i}{a}") for i in range(20) for a, b in ("01", "10")]
    rows = spark.createDataFrame(way + leaves + ring + small, "snapshot_id string, path string, to string, sum long, m string")
    moved, keep = [], gr.keep

    def watched(df, **told):
        out = keep(df, **told)
        moved.append(out.count())
        return out

    plus = lambda a, b: a + b
    for few in (10_000, 50):
        monkeypatch.setattr(gr, "_FEW", few)
        got = {r.path: r for r in gr.followed(rows, rows.count(), {"sum": plus, "m": F.least}).collect()}
        assert len(got) == rows.count()
        assert all(not got[f"w{i}"].ring and got[f"w{i}"].to == f"w{n}" and got[f"w{i}"]["sum"] == n - i for i in range(n))
        assert all(got[f"l{i}"].to == f"w{n}" and got[f"l{i}"]["sum"] == n - i + 1 for i in range(0, n, 50))
        assert all(got[f"r{i:03}"].ring and got[f"r{i:03}"].m == "r000" for i in range(200))
        assert all(got[f"s{i}{a}"].ring and got[f"s{i}{a}"].m == f"s{i}0" for i in range(20) for a in "01")
    monkeypatch.setattr(gr, "keep", watched)
    gr.followed(rows, rows.count(), {"sum": plus}).count()
    assert sum(moved) < 8 * rows.count(), moved


def test_rounds_move_numbers(spark, monkeypatch):
    """rounds over large pieces moved names of boxes and snapshots."""
    seen, contracted = [], gr._contracted
    monkeypatch.setattr(gr, "_contracted", lambda e: (seen.append(dict(e.dtypes)), contracted(e))[1])
    pairs = spark.createDataFrame([(s, f"b{i}", f"b{i + 1}") for s in "AB" for i in range(70)] + [("A", "b70", "b65")], "snapshot_id string, src string, dst string")
    assert sorted(map(tuple, gr.cycles(pairs).collect())) == [("A", f"b{i}", "b65") for i in range(65, 71)]
    assert seen and all(d["src"] == d["dst"] == "bigint" for d in seen)
    got = {(r.snapshot_id, r.path): r.blast_radius for r in gr.blast_radius(pairs).collect()}
    assert got == {("A", f"b{i}"): 70 if i >= 65 else i for i in range(1, 71)} | {("B", f"b{i}"): i for i in range(1, 71)}
