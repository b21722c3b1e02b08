"""The delta report, line by line."""

from lattica.operators import delta as dl
from lattica.render import pictures

from .test_engine import both, graph

WANT = """ARCHITECTURAL DELTA: boundary changed — review required
  + box   fmt (external)
  + box   service:Redis (service)
  - box   gone
  + arrow a -> fmt [import] (0 witness file(s))
  + arrow b -> a [implements] (2 witness file(s))
  + arrow b -> service:Redis [service] (1 witness file(s))
  - arrow a -> b [implements]
  - arrow gone -> a [import]
  + surface a.H (func)
  - surface a.G (func)
SCHEMA CHANGED — a serialized data contract (wire/DB payload) changed shape
  + field b.S.y int
INVARIANTS TOUCHED — review required (a system promise changed)
  - invariant a.T2 (guard removed)
  ~ invariant a.T1 (guard changed)
  + invariant a.T3 (new guard)
    → promise on b.I, b.J changed
CONTRACT VIOLATIONS — review required (a box depends on something it is not allowed to)
  ! a -> b [call] not in allow-list
CONTRACT COVERAGE — every implementer of a changed contract must be covered by that contract's test
  ! b.B now implements a.K — no contract test guards this interface (evidence gap)
  ! b.C now implements a.K — no contract test guards this interface (evidence gap)
  - a.A no longer implements b.I
"""


def test_delta_text(spark):
    """The shared prefix is ``m``: the fold collapses at ``fmt`` and ``service:Redis`` and begins anew behind them."""
    sym = lambda n, sig="": {"kind": "func", "name": n, "sig": sig}
    inv = lambda n, h, g=(), e=(): {"name": n, "file": "t", "hash": h, "guards": list(g), "exercises": list(e)}
    a = graph({"m/a": {"surface": [sym("F", "1"), sym("G")], "invariants": [inv("T1", "x", ["m/b.I"], ["m/a.A"]), inv("T2", "x")]}, "m/b": {"schema": [sym("S.x")]}, "m/gone": {"surface": [sym("Z")]}}, [("m/a", "m/b", "call", ["P", "Q"]), ("m/a", "m/b", "implements", ["A |= I"]), ("m/gone", "m/a")])
    b = graph({"m/a": {"surface": [sym("F", "2"), sym("H")], "invariants": [inv("T1", "y", ["m/b.J"]), inv("T3", "x")]}, "m/b": {"schema": [sym("S.x"), sym("S.y","int")]}, "fmt": {"internal": False}, "service:Redis": {"internal": False}}, [("m/a", "m/b", "call", ["P"]), ("m/a", "fmt"), ("m/b","service:Redis","service",["import@a.go"]),("m/b","m/a","implements",["B |= K","C |= K"])])
    s, pairs = both(spark, a, b)
    off = dl.violations(s, pairs, spark.createDataFrame([("m/a",)], "path string"), spark.createDataFrame([("m/a", "m/x")], "path string, target string"))
    assert pictures.delta_text(s, pairs, off) == WANT
    assert pictures.delta_text(*both(spark, a, a)) == "ARCHITECTURAL DELTA: empty at package altitude\n  -> internal change; no package boundary moved; no architecture review required.\n"
