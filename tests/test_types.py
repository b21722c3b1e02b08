"""Types of expressions, method sets through embedding, and histories by content."""

import random
import subprocess

import pytest

from lattica.schema import Snapshots
from lattica.sources import expressions, git, golang, types, usage

TOP = """package top

import (
	"flag"
	"fmt"
	store "ex.com/m/store"
)

type Base struct{ name string }

func (b *Base) Hello(x string, n int) (store.Row, error) { return store.Row{}, nil }

type Mid struct {
	*Base
	Items []store.Row
	by    map[string]*Base
}

type Saver interface {
	store.Reader
	fmt.Stringer
	Save(x, y string) error
}

type Names []store.Row

var global = NewMid()

func NewMid() *Mid { return &Mid{Base: &Base{}, Items: nil} }

func Use(s Saver, names Names, store2 func(a, b int) *Mid) {
	m := NewMid()
	r, err := m.Hello("a", 1)
	if err != nil {
		return
	}
	r.Touch()
	for _, it := range m.Items {
		it.Move()
	}
	m.by["x"].Hello("y", 2)
	fs := flag.NewFlagSet("x", flag.ExitOnError)
	fs.String("depth", "", "help")
	go func(q *Mid) { q.Hello("", 0) }(m)
	x := []Saver{s}
	x[0].Save("p", "q")
	if v, ok := s.(*store.Cached); ok {
		v.Find("", 1)
	}
	switch y := names[0]; y.ID {
	case 1:
		y.Turn()
	}
	(&store.Disk{}).Read("k")
	store.Row.Spin(r)
	_ = store.Make(m.Items...).Disk.Close
	missing.Other()
}
"""
STORE = """package store

type Row struct{ ID int }

func (r Row) Touch() error { return nil }
func (r Row) Move()        {}
func (r *Row) Turn()       {}
func (r Row) Spin()        {}

type Reader interface {
	Read(k string) (Row, error)
}

type Disk struct{}

func (d *Disk) Read(key string) (Row, error) { return Row{}, nil }
func (d *Disk) Close() error                 { return nil }
func (d *Disk) String() string               { return "" }

type Cached struct {
	*Disk
	n int
}

func Make(rows ...Row) *Cached { return nil }

func (c *Cached) Save(a string, b string) error { return nil }
func (c *Cached) Find(x string, n int) Row      { return Row{} }

type Clash struct {
	Cached
	Disk
}
"""
TOP_TEST = """package top

import "testing"

func TestUse(t *testing.T) {
	m := NewMid()
	m.Hello("a", 1)
}
"""
STORE_TEST = """package store_test

import (
	"testing"

	"ex.com/m/store"
)

func open() store.Reader { return &store.Cached{} }

func TestRead(t *testing.T) {
	r := open()
	r.Read("x")
}
"""


@pytest.fixture(scope="module")
def sources(spark):
    files = [("top/top.go", TOP), ("store/s.go", STORE), ("top/top_test.go", TOP_TEST), ("store/s_test.go", STORE_TEST), ("top/testdata/no.go", "package no")]
    df = spark.createDataFrame([(p, bytearray(c.encode())) for p, c in files], "path string, content binary")
    return df.where(golang.built("path"))


def test_types_of_expressions(spark, sources):
    shapes = expressions.of_files(sources, "ex.com/m")
    s = golang.snapshot(golang.rows_of_files(sources), "ex.com/m", "A", shapes)
    got = {(r.src.rsplit("/", 1)[1], r.kind, r.dst.rsplit("/", 1)[-1], r.witness) for r in s.witness.where("kind in ('call', 'implements', 'config')").collect()}
    assert got == {
        *[("top", "call", "store", w) for w in ("Row.Touch", "Row.Move", "Row.Turn", "Row.Spin", "Cached.Find", "Disk.Read", "Disk.Close", "Make")],
        ("top", "config", "flag:depth", "define@top.go"),
        ("store", "implements", "top", "Cached |= Saver"), ("store", "implements", "store", "Disk |= Reader"), ("store", "implements", "store", "Cached |= Reader"),
        # Clash has its Disk's methods at depth one and its Cached's Disk's at depth two: the former win.
        ("store", "implements", "store", "Clash |= Reader"), ("store", "implements", "top", "Clash |= Saver"),
    }
    assert {(r.path, r.name, r.iface) for r in s.guard.collect()} == {("ex.com/m/store", "TestRead", "ex.com/m/store.Reader")}
    assert {(r.name, r.concrete.rsplit("/", 1)[1]) for r in s.exercise.collect()} >= {("TestUse", "top.Mid"), ("TestUse", "store.Row"), ("TestRead", "store.Row")}
    calls = usage.call_graph(usage.rows_of_files(sources), golang.rows_of_files(sources), "ex.com/m", "A", shapes)[1]
    assert {r.dst.split("/", 2)[2] for r in calls.where("src = 'ex.com/m/top.Use'").collect()} == {"top.NewMid", "top.Base.Hello", "store.Row.Touch", "store.Row.Move", "store.Row.Turn", "store.Row.Spin", "store.Cached.Find", "store.Disk.Read", "store.Make"}


def test_reading_never_fails():
    """Cut and shuffled sources give rows or none, and an end."""
    r, tokens = random.Random(3), golang.lex(TOP + STORE)
    for _ in range(150):
        part = r.sample(tokens, r.randrange(1, 60)) if r.random() < 0.5 else tokens[: r.randrange(len(tokens))]
        assert all(len(x) == 5 for x in expressions.expression_rows(" ".join(part)))


def test_history_by_content(spark, tmp_path):
    repo, at = tmp_path / "repo", str(tmp_path / "store")
    git_ = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    for d in ("app/a", "app/b", "app/sub/c", "other"):
        (repo / d).mkdir(parents=True)
    git_("init", "-q", "-b", "main")
    # The module is not at the root, and another is nested in it.
    (repo / "app/go.mod").write_text("module ex.com/m\n")
    (repo / "app/sub/go.mod").write_text("module ex.com/sub\n")
    (repo / "app/sub/c/c.go").write_text("package c\n")
    (repo / "app/b/b.go").write_text("package b\n\ntype T struct{}\n\nfunc (t *T) Go() {}\n")
    (repo / "app/b/copy.go").write_text("package b\n")
    (repo / "other/copy.go").write_text("package b\n")
    for i, body in enumerate(["func One() {}", "func One() { b.T{} }", 'import "ex.com/m/gone"\n\nfunc One() { x := &b.T{}; x.Go() }']):
        (repo / "app/a/a.go").write_text('package a\n\nimport "ex.com/m/b"\n\n' + body + "\n")
        git_("add", ".")
        git_("commit", "-q", "-m", f"feat: {i}")
    order = git.commits(spark, str(repo), 5)
    s = git.store(spark, str(repo), order.where("seq < 2"), at)
    seen = [r.blob for r in git.Contents(spark, at).blobs().collect()]
    # Two versions of a.go, b.go, two files of one content, c.go and two module files: each content once.
    assert len(seen) == len(set(seen)) == 7
    s = git.store(spark, str(repo), order, at)
    more = git.Contents(spark, at).blobs().collect()
    assert len(more) == len({r.blob for r in more}) == 8 and len({r.batch for r in more}) == 2
    assert {r.module for r in s.snapshot.collect()} == {"ex.com/m"} and s.snapshot.count() == 3
    assert {(r.path, r.n) for r in s.package.where("internal").groupBy("path").agg({"*": "count"}).toDF("path", "n").collect()} == {("ex.com/m/a", 3), ("ex.com/m/b", 3)}
    last = order.orderBy("seq", ascending=False).first().snapshot_id
    assert [r.witness for r in s.witness.where(f"snapshot_id = '{last}' and kind = 'call'").collect()] == ["T.Go"]
    errors = {r.snapshot_id: r.n_errors for r in spark.read.parquet(f"{at}/errors").collect()}
    assert errors[last] == 1 and sum(errors.values()) == 1
    with pytest.raises(Exception, match="git"):
        git.trees(str(repo), spark.createDataFrame([("nothing",)], "snapshot_id string")).collect()


def test_rules_that_no_step_asks_for(spark, tmp_path, monkeypatch):
    """every member of every type was looked up in each round, though few are ever selected."""
    kept, keep = [], types.keep

    def watched(df, **told):
        out = keep(df, **told)
        kept.append(out)
        return out

    monkeypatch.setattr(types, "keep", watched)
    shapes = expressions.of_files(spark.createDataFrame([("/p/a.go", bytearray(b"package p\n\ntype T struct{ n int }\n\nfunc (t *T) Used() {}\n\nfunc (t *T) Idle() {}\n\nfunc Run(t *T) {\n\tt.Used()\n}\n"))], "path string, content binary"), "m").selectExpr("'A' as snapshot_id", "*")
    flat, _ = types.interface_methods(shapes)
    typed = types.propagate(shapes, types.members(shapes, flat))
    rules = next(t for t in kept if set(t.columns) == {"snapshot_id", "type", "op", "arg", "out"})
    assert {r.arg for r in rules.where("op = 'sel'").collect()} == {"Used"}
    assert [(r.fn, r["name"]) for r in types.references(shapes, typed).where("called").collect()] == [("Run", "Used")]


def _shapes(spark, text):
    return expressions.of_files(spark.createDataFrame([("/p/a.go", bytearray(text.encode()))], "path string, content binary"), "m").selectExpr("'A' as snapshot_id", "*")


MEMBERS = """package p

type A struct { *B; own int }

type B struct { *A; C }

type C struct { *D; E }

type D struct { F }

type E struct { F }

type F struct { deep int }

func (f *F) Far() {}

func (d *D) Near() {}

type G struct { D }

func (g *G) Far() {}
"""


def test_members_of_circles_and_diamonds(spark):
    """members come from the bottom up; types that embed one another, and names that meet twice, are told as by rounds."""
    shapes = _shapes(spark, MEMBERS)
    flat, _ = types.interface_methods(shapes)
    got = {(r.type[4:], r["name"]): (r.kind, r.value, r.owner[4:], r.depth) for r in types.members(shapes, flat).where("kind = 'method' or name in ('own', 'deep')").collect()}
    assert ("C", "Far") not in got and ("C", "deep") not in got and ("A", "Far") not in got and ("B", "deep") not in got
    assert got["A", "own"] == ("field", "int", "A", 0) and got["B", "own"] == ("field", "int", "A", 1)
    assert {(t, d) for (t, n), (_, v, o, d) in got.items() if n == "Near"} == {("A", 3), ("B", 2), ("C", 1), ("D", 0), ("G", 1)} and {v for (_, n), (_, v, _, _) in got.items() if n == "Near"} == {"func:m/p.D.Near"}
    assert got["G", "Far"] == ("method", "func:m/p.G.Far", "G", 0) and got["D", "Far"] == ("method", "func:m/p.F.Far", "F", 1) and got["G", "deep"][2:] == ("F", 2)
    few = types.members(shapes, flat, spark.createDataFrame([("A", "Near")], "snapshot_id string, name string"))
    assert {(r.type[4:], r["name"]) for r in few.collect()} == {(t, "Near") for t in "ABCDG"}


def test_roots_are_not_followed_one_by_one(spark, monkeypatch):
    """each root was followed through all that it embeds, with all found so far read in each round."""
    went = []
    monkeypatch.setattr(types, "embedded", lambda *a: went.append(a))
    shapes = _shapes(spark, MEMBERS.replace("*A; C", "C"))
    flat, _ = types.interface_methods(shapes)
    assert types.members(shapes, flat).where("name = 'Near'").count() == 5 and not went


def test_files_are_read_once(spark):
    """each file was read twice, and all its rows were joined with its name."""
    plan = _shapes(spark, MEMBERS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan, plan
