"""Graph documents, policies and recorded streams, read with explicit schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EDGE, GRAPH, PACKAGE, Snapshots


def graphs(spark: SparkSession, at: str | list[str]) -> DataFrame:
    """Nested documents with their file as snapshot_id."""
    return spark.read.schema(GRAPH).option("multiLine", True).json(at).withColumn("snapshot_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1))


def from_dicts(spark: SparkSession, documents: dict[str, dict]) -> DataFrame:
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in documents.items()], "snapshot_id string, doc string")
    return rows.select("snapshot_id", F.from_json("doc", GRAPH).alias("g")).select("snapshot_id", "g.*")


def normalise(g: DataFrame) -> Snapshots:
    """The snapshot tables of nested documents; omitted arrays are empty."""
    pk = g.select("snapshot_id", F.posexplode(F.coalesce("packages", F.array().cast(f"array<{PACKAGE}>"))).alias("pos", "p")).select("snapshot_id", "pos", "p.*")
    inv = pk.select("snapshot_id", "path", F.posexplode("invariants").alias("pos", "i")).select("snapshot_id", "path", "pos", "i.*")

    def symbols(axis: str, column: str) -> DataFrame:
        return pk.select("snapshot_id", "path", F.posexplode(column).alias("pos", "x")).select("snapshot_id", "path", F.lit(axis).alias("axis"), "x.kind", "x.name", "x.sig", "pos")

    def arrows(column: str, scope: str) -> DataFrame:
        return g.select("snapshot_id", F.posexplode(F.coalesce(column, F.array().cast(f"array<{EDGE}>"))).alias("pos", "e")).select("snapshot_id", F.col("e.from").alias("src"), "e.kind", F.col("e.to").alias("dst"), F.lit(scope).alias("scope"), "pos", "e.witnesses")

    edges = arrows("edges", "cross").unionByName(arrows("localImplements", "local"))
    return Snapshots(
        snapshot=g.select("snapshot_id", F.coalesce("module", F.lit("")).alias("module"), "commit"),
        package=pk.select("snapshot_id", "path", "name", "internal", F.coalesce("hole", F.lit(False)).alias("hole"), "pos"),
        file=pk.select("snapshot_id", "path", F.explode("files").alias("file")),
        symbol=symbols("surface", "surface").unionByName(symbols("schema", "schema")),
        invariant=inv.select("snapshot_id", "path", "name", "file", "hash", "pos"),
        guard=inv.select("snapshot_id", "path", "name", F.explode("guards").alias("iface")),
        exercise=inv.select("snapshot_id", "path", "name", F.explode("exercises").alias("concrete")),
        allow=pk.select("snapshot_id", "path", F.explode("allow").alias("target")),
        edge=edges.drop("witnesses"),
        witness=edges.select("snapshot_id", "src", "kind", "dst", "scope", F.explode("witnesses").alias("witness")),
    )


def allow_list(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    """declared(path), permitted(path, target): a key with an empty list permits nothing."""
    text = spark.read.text(at, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("path", "targets"))
    return text.select("path").distinct(), text.select("path", F.explode("targets").alias("target"))


def surface_policy(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    """fixed(path), widen(path, name)."""
    p = spark.read.schema("fixed array<string>, widen map<string, array<string>>").option("multiLine", True).json(at)
    return p.select(F.explode("fixed").alias("path")), p.select(F.explode("widen").alias("path", "names")).select("path", F.explode("names").alias("name"))


def layer_spec(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    """layers(layer, ord), directory_layer(seg, layer)."""
    p = spark.read.schema("layers array<string>, map map<string, string>").option("multiLine", True).json(at)
    return p.select(F.posexplode("layers").alias("ord", "layer")), p.select(F.explode("map").alias("seg", "layer"))


def test_events(spark: SparkSession, at: str) -> DataFrame:
    """Recorded test events, line by line; bad lines are skipped."""
    lines = spark.read.text(at).withColumn("seq", F.monotonically_increasing_id())
    return lines.select("seq", F.from_json("value", "Action string, Test string").alias("e")).where("e.Action is not null").select("seq", "e.*")


def interface_facts(spark: SparkSession, at: str, snapshot_id: str) -> DataFrame:
    one = "struct<interface: string, pkg: string, name: string, methods: array<string>, implementers: array<string>, consumers: array<struct<pkg: string, kind: string, pos: string>>, consumerPkgs: array<string>>"
    p = spark.read.schema(f"module string, interfaces array<{one}>").option("multiLine", True).json(at).select(F.explode("interfaces").alias("i")).select("i.*")
    none = F.array().cast("array<string>")
    return p.select(F.lit(snapshot_id).alias("snapshot_id"), F.col("interface").alias("iface"), "pkg", *[F.coalesce(a, none).alias(b) for a, b in (("methods", "methods"), ("implementers", "implementers"), ("consumerPkgs", "consumer_pkgs"))], F.coalesce(F.size("consumers"), F.lit(0)).alias("n_consumers"))


_CHANGED = "array<struct<package: string, added: array<struct<kind: string, name: string, sig: string>>, removed: array<struct<kind: string, name: string, sig: string>>>>"
_ARROWS = "array<struct<`from`: string, `to`: string, kind: string, witnesses: array<string>>>"
DELTA = (
    "commitA string, commitB string, packagesAdded array<struct<path: string, internal: boolean>>, packagesRemoved array<struct<path: string, internal: boolean>>, "
    f"edgesAdded {_ARROWS}, edgesRemoved {_ARROWS}, surface {_CHANGED}, `schema` {_CHANGED}, emptyAtPackageAltitude boolean, "
    "invariants array<struct<package: string, added: array<string>, removed: array<string>, modified: array<string>>>"
)


def delta_axes(spark: SparkSession, at: str) -> dict[str, DataFrame]:
    """A delta document as the tables that ``operators.delta`` gives: packages, edges, symbols, invariants."""
    d = spark.read.schema(DELTA).option("multiLine", True).json(at)
    either = lambda field, *columns: d.select(F.explode(f"{field}Added").alias("x")).select(*columns, F.lit("added").alias("change")).unionByName(d.select(F.explode(f"{field}Removed").alias("x")).select(*columns, F.lit("removed").alias("change")))
    symbols, tests = None, None
    for axis in ("surface", "schema"):
        for change in ("added", "removed"):
            rows = d.select(F.explode(axis).alias("x")).select(F.lit(axis).alias("axis"), F.col("x.package").alias("path"), F.explode(f"x.{change}").alias("s")).select("axis", "path", "s.kind", "s.name", F.lit(change).alias("change"))
            symbols = rows if symbols is None else symbols.unionByName(rows)
    for change in ("added", "removed", "modified"):
        rows = d.select(F.explode("invariants").alias("x")).select(F.col("x.package").alias("path"), F.explode(f"x.{change}").alias("name"), F.lit(change).alias("change"))
        tests = rows if tests is None else tests.unionByName(rows)
    return {"packages": either("packages", "x.path", "x.internal"), "edges": either("edges", F.col("x.from").alias("src"), "x.kind", F.col("x.to").alias("dst")), "symbols": symbols, "invariants": tests}


def component_spec(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    """components(comp, members, in_cycle, change), edges(src, dst, kind, change) of a component document."""
    kinds = "module string, depth int, components array<struct<name: string, members: array<string>, inCycle: boolean, change: string>>, edges array<struct<`from`: string, `to`: string, kind: string, change: string>>"
    d = spark.read.schema(kinds).option("multiLine", True).json(at)
    boxes = d.select(F.explode("components").alias("c")).select(F.col("c.name").alias("comp"), "c.members", F.col("c.inCycle").alias("in_cycle"), F.coalesce("c.change", F.lit("")).alias("change"))
    return boxes, d.select(F.explode("edges").alias("e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.kind", F.coalesce("e.change", F.lit("")).alias("change"))


def document(s: Snapshots, snapshot_id: str) -> dict:
    """One snapshot back as a canonical nested document (driver side; a document is some MB)."""
    q = lambda df, *order: [r.asDict() for r in df.where(F.col("snapshot_id") == snapshot_id).orderBy(*order).collect()]
    head = q(s.snapshot, "snapshot_id")
    out = {"module": head[0]["module"] if head else "", "packages": [], "edges": []}
    by: dict = {}
    for name, rows in (("files", [(r["path"], r["file"]) for r in q(s.file, "path", "file")]), ("allow", [(r["path"], r["target"]) for r in q(s.allow, "path", "target")])):
        for path, x in rows:
            by.setdefault((path, name), []).append(x)
    for r in q(s.symbol, "path", "axis", "kind", "name"):
        by.setdefault((r["path"], r["axis"]), []).append({k: r[k] for k in ("kind", "name", "sig") if r[k]})
    for r in q(s.invariant, "path", "name"):
        by.setdefault((r["path"], "invariants"), []).append({k: r[k] for k in ("name", "file", "hash")})
    for p in q(s.package, "path"):
        out["packages"].append({"path": p["path"], "name": p["name"], "internal": p["internal"], **({"hole": True} if p["hole"] else {}), **{k: by[(p["path"], k)] for k in ("files", "surface", "schema", "invariants", "allow") if (p["path"], k) in by}})
    w: dict = {}
    for r in q(s.witness, "src", "kind", "dst", "witness"):
        w.setdefault((r["scope"], r["src"], r["kind"], r["dst"]), []).append(r["witness"])
    for e in q(s.edge, "src", "kind", "dst"):
        row = {"from": e["src"], "to": e["dst"], "kind": e["kind"]}
        if ws := w.get((e["scope"], e["src"], e["kind"], e["dst"])):
            row["witnesses"] = ws
        out["edges" if e["scope"] == "cross" else "localImplements"] = [*out.get("edges" if e["scope"] == "cross" else "localImplements", []), row]
    return out
