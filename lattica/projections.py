"""Graphs made of the star-schema tables, so that every operator runs over whole tables at any scale.

Each part is a cluster of six boxes (``tpch/<region>/p<part>/<box>``): every line of the part is an arrow from the box of its
line number to the box of its supplier, its kind told by the return flag, its witness by the buyer's segment, and
an arrow from the former box to something outside (configuration, services, endpoints, capabilities, libraries), told by the tax.
Graphs thus stay sparse however many rows there are: arrows, boxes and clusters grow with the tables, degrees do not.
Orders before the cut are snapshot A, the others B; or each year is a snapshot.

What a line says is kept as it stands, in numbers and short words, dealt by parts; of the graph's tables only those that a query
asks for are derived, once for each session and folder, and kept without their names: paths are put together where they are read.
"""

from __future__ import annotations

import uuid
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import Snapshots
from .shared import shared_dir, true_sizes

MODULE = "tpch"
#: What the tax of a line (in hundredths) makes it reach outside: kind and target.
OUTSIDE = [("config", "env:HOME"), ("service", "service:Postgres"), ("protocol", "api:GET /items"), ("capability", "cap:net"), ("import", "github.com/lib/pq"), ("import", "fmt"), ("import", "net/http"), ("config", "flag:verbose"), ("service", "service:Redis")]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def base(spark: SparkSession, d: str, by_year: bool = False) -> DataFrame:
    """One row for each line: snapshot_id, its part p, box numbers i and j with the names of their regions r and q, kind, tax, and
    what witnesses, symbols and tests are made of.  Lines move twice, by order and by part."""
    t = lambda n: _table(spark, d, n)
    regions = t("region").select(F.col("r_regionkey").alias("key"), "r_name")
    snap = F.year("o_orderdate").cast("string") if by_year else F.when(F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ'1998-04-01'"), "A").otherwise("B")
    orders = t("orders").select("o_orderkey", "o_custkey", snap.alias("snapshot_id"), "o_orderstatus", F.substring("o_orderpriority", 3, 40).alias("priority"))
    orders = orders.join(t("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    kind = F.when(F.col("l_returnflag") == "R", "import").when(F.col("l_returnflag") == "A", "call").otherwise("implements")
    box = lambda c: F.pmod(c, F.lit(6)).cast("byte")
    lines = t("lineitem").select("l_orderkey", F.col("l_partkey").alias("p"), "l_linenumber", box("l_linenumber").alias("i"), box("l_suppkey").alias("j"), kind.alias("kind"), (F.round(F.col("l_tax") * 100).cast("int") % len(OUTSIDE)).alias("tax"))
    j = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey").repartition(_buckets(spark), "p")
    j = j.join(t("part").select("p_partkey", "p_type"), F.col("p") == F.col("p_partkey")).drop("p_partkey")
    for k, name in (("i", "r"), ("j", "q")):
        j = j.join(F.broadcast(regions), F.pmod(F.col("p") + F.col(k), F.lit(5)) == F.col("key")).withColumnRenamed("r_name", name).drop("key")
    return j


def _leaf(k: str):
    return F.when(F.col("p") % 2 == 0, F.concat(F.lit("u"), k)).otherwise(F.concat(F.lit("x"), "p", F.lit("k"), k))


def _path(region: str, k: str):
    return F.concat_ws("/", F.lit(MODULE), region, F.concat(F.lit("p"), "p"), _leaf(k))


_SRC, _DST = ("r", "i"), ("q", "j")
_END = ["snapshot_id", "p"]
_ARROW = [*_END, *_SRC, *_DST, "kind"]


def _kept(b: DataFrame) -> dict[str, DataFrame]:
    """What is kept of each table of lines: distinct rows of numbers and short words."""
    tests = b.where("kind = 'implements'")
    witness = F.when(F.col("kind") == "implements", F.concat_ws(" |= ", "priority", "p_type")).otherwise(F.concat_ws("#", "c_mktsegment", F.col("l_linenumber") % 2))
    return {
        "snapshot": b.select("snapshot_id").distinct(),
        "ends": b.select(*_END, F.inline(F.array(F.struct(F.col("r"), F.col("i")), F.struct(F.col("q").alias("r"), F.col("j").alias("i"))))).distinct(),
        "outside": b.select("snapshot_id", "tax").distinct(),
        "surface": b.select(*_END, *_DST, "c_mktsegment", "l_linenumber").distinct(),
        "schema": b.select(*_END, *_SRC, "p_type", "o_orderstatus").distinct(),
        "invariant": b.groupBy(*_END, *_SRC, "c_mktsegment").agg((F.count("*") % 3).cast("byte").alias("hash")),
        "guard": tests.select(*_END, *_SRC, "c_mktsegment", *_DST, "p_type").distinct(),
        "exercise": tests.where("o_orderstatus <> 'F'").select(*_END, *_SRC, "c_mktsegment", "priority").distinct(),
        "edge": b.select(*_ARROW).distinct(),
        "reached": b.select(*_END, *_SRC, "tax").distinct(),
        "witness": b.select(*_ARROW, witness.alias("witness")).distinct(),
    }


def _tables(kept) -> dict:
    """The graph's tables, each a view of what is kept; ``kept(name)`` is made where it is asked for."""
    # A kind of change that pairs of versions have in common: the names after the cut of a line number.
    outside = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(x).alias("dst")) for k, x in OUTSIDE])[F.col("tax")]
    S, zero, scope = F.col("snapshot_id"), F.lit(0).alias("pos"), F.lit("cross").alias("scope")
    src, dst = _path(*_SRC), _path(*_DST)
    own = [S, src.alias("path"), F.col("c_mktsegment").alias("name")]
    box = lambda df, path, name, own: df.select(S, path.alias("path"), name.alias("name"), F.lit(own).alias("internal"), F.lit(False).alias("hole"), zero)
    sym = lambda name, path, axis, kind, text: kept(name).select(S, path.alias("path"), F.lit(axis).alias("axis"), F.lit(kind).alias("kind"), text.alias("name"), F.lit(None).cast("string").alias("sig"), zero)
    return {
        "snapshot": lambda: kept("snapshot").select(S, F.lit(MODULE).alias("module"), F.lit("").alias("commit")),
        "package": lambda: box(kept("ends"), src, _leaf("i"), True).unionByName(box(kept("outside").select(S, outside["dst"].alias("dst")).distinct(), F.col("dst"), F.col("dst"), False)),
        "symbol": lambda: sym("surface", dst, "surface", "func", F.concat("c_mktsegment", "l_linenumber")).unionByName(sym("schema", src, "schema", "field", F.concat_ws(".", "p_type", "o_orderstatus"))),
        "invariant": lambda: kept("invariant").select(*own, F.lit("t").alias("file"), F.col("hash").cast("string").alias("hash"), zero),
        "guard": lambda: kept("guard").select(*own, F.concat_ws(".", dst, "p_type").alias("iface")),
        "exercise": lambda: kept("exercise").select(*own, F.concat_ws(".", src, "priority").alias("concrete")),
        "edge": lambda: kept("edge").select(S, src.alias("src"), "kind", dst.alias("dst"), scope, zero).unionByName(kept("reached").select(S, src.alias("src"), outside["kind"].alias("kind"), outside["dst"].alias("dst"), scope, zero)),
        "witness": lambda: kept("witness").select(S, src.alias("src"), "kind", dst.alias("dst"), scope, "witness"),
    }


class _Trade(Snapshots):
    """Tables that are made when they are asked for."""

    def __init__(self, tables: dict):
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        made = self.__dict__[name] = self._tables[name]()
        return made


_WRITTEN: dict[tuple, str] = {}


def trade(spark: SparkSession, d: str, by_year: bool = False) -> Snapshots:
    session = spark.sparkContext.applicationId
    true_sizes(spark)

    def stored(name: str, make) -> DataFrame:
        key = (session, d, by_year, name)
        if key not in _WRITTEN:
            at = f"{shared_dir(spark)}/lattica-trade-{uuid.uuid4().hex}"
            make().write.option("compression", "zstd").parquet(at)
            _WRITTEN[key] = at
        return spark.read.parquet(_WRITTEN[key])

    def lines() -> DataFrame:
        """Lines in buckets by part, as they are dealt: what is kept of them is grouped where they lie, without moving again."""
        key = (session, d, by_year, "base")
        if key not in _WRITTEN:
            name = f"lattica_trade_{uuid.uuid4().hex}"
            out = base(spark, d, by_year).write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}")
            out.bucketBy(_buckets(spark), "p").format("parquet").saveAsTable(name)
            _WRITTEN[key] = name
        return spark.table(_WRITTEN[key])

    def kept(name: str) -> DataFrame:
        return stored(name, lambda: _kept(lines())[name])

    empty = Snapshots.of(spark)
    return _Trade({**{f.name: lambda n=f.name: getattr(empty, n) for f in fields(Snapshots)}, **_tables(kept)})


#: The same projection as SQL common table expressions; ``edge`` and ``pkg`` are internal, ``aedge`` and ``apkg`` have all.
def trade_sql(by_year: bool = False) -> str:
    snap = "CAST(year(o_orderdate) AS VARCHAR)" if by_year else "CASE WHEN o_orderdate < TIMESTAMP '1998-04-01' THEN 'A' ELSE 'B' END"
    leaf = lambda k: f"CASE WHEN l_partkey % 2 = 0 THEN 'u' || {k} ELSE 'x' || l_partkey || 'k' || {k} END"
    outside = ", ".join(f"({n}, '{k}', '{x}')" for n, (k, x) in enumerate(OUTSIDE))
    return f"""
WITH RECURSIVE outside AS (SELECT * FROM (VALUES {outside}) o(tax, okind, target)),
lines AS (SELECT *, l_linenumber % 6 AS i, l_suppkey % 6 AS j, CAST(round(l_tax * 100) AS INT) % {len(OUTSIDE)} AS tax FROM lineitem),
base AS (SELECT {snap} AS sid, 'tpch/' || x.r_name || '/p' || l_partkey || '/' || {leaf("i")} AS src, 'tpch/' || y.r_name || '/p' || l_partkey || '/' || {leaf("j")} AS dst,
  CASE l_returnflag WHEN 'R' THEN 'import' WHEN 'A' THEN 'call' ELSE 'implements' END AS kind,
  CASE WHEN l_returnflag IN ('R', 'A') THEN c_mktsegment || '#' || (l_linenumber % 2) ELSE substr(o_orderpriority, 3) || ' |= ' || p_type END AS witness, okind, target, p_type, c_mktsegment, l_linenumber, substr(o_orderpriority, 3) AS priority, o_orderstatus
  FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
  JOIN region x ON (l_partkey + i) % 5 = x.r_regionkey JOIN region y ON (l_partkey + j) % 5 = y.r_regionkey JOIN outside USING (tax)),
edge AS (SELECT DISTINCT sid, src, kind, dst FROM base),
xedge AS (SELECT DISTINCT sid, src, okind AS kind, target AS dst FROM base),
aedge AS (FROM edge UNION ALL FROM xedge),
wit AS (SELECT DISTINCT sid, src, kind, dst, witness FROM base),
pkg AS (SELECT DISTINCT sid, src AS path FROM base UNION SELECT DISTINCT sid, dst FROM base),
xpkg AS (SELECT DISTINCT sid, dst AS path FROM xedge),
apkg AS (SELECT sid, path, true AS internal FROM pkg UNION ALL SELECT sid, path, false FROM xpkg),
sym AS (SELECT DISTINCT sid, dst AS path, 'surface' AS axis, 'func' AS kind, c_mktsegment || l_linenumber AS name FROM base UNION SELECT DISTINCT sid, src, 'schema', 'field', p_type || '.' || o_orderstatus FROM base),
inv AS (SELECT sid, src AS path, c_mktsegment AS name, count(*) % 3 AS hash FROM base GROUP BY ALL),
guard AS (SELECT DISTINCT sid, src AS path, c_mktsegment AS name, dst || '.' || p_type AS iface FROM base WHERE kind = 'implements'),
exer AS (SELECT DISTINCT sid, src AS path, c_mktsegment AS name, src || '.' || priority AS concrete FROM base WHERE kind = 'implements' AND o_orderstatus <> 'F'),
dep AS (SELECT DISTINCT sid, src, dst FROM edge WHERE kind IN ('import', 'call') AND src <> dst),
reach AS (SELECT sid, src, dst FROM dep UNION SELECT r.sid, r.src, d.dst FROM reach r JOIN dep d ON r.sid = d.sid AND r.dst = d.src),
impl AS (SELECT DISTINCT sid, dst || '.' || split_part(witness, ' |= ', 2) AS iface, src || '.' || split_part(witness, ' |= ', 1) AS impl FROM wit WHERE kind = 'implements'),
cov AS (SELECT i.sid, i.iface, i.impl, h.iface IS NOT NULL AS covered FROM impl i LEFT JOIN (SELECT DISTINCT g.sid, g.iface, e.concrete FROM guard g JOIN exer e USING (sid, path, name)) h ON i.sid = h.sid AND i.iface = h.iface AND i.impl = h.concrete),
d_edge AS (SELECT src, kind, dst, CASE WHEN bool_or(sid = 'A') THEN 'removed' ELSE 'added' END AS change FROM aedge GROUP BY ALL HAVING count(*) = 1),
d_apkg AS (SELECT path, internal, CASE WHEN bool_or(sid = 'A') THEN 'removed' ELSE 'added' END AS change FROM apkg GROUP BY ALL HAVING count(*) = 1),
d_pkg AS (SELECT path, change FROM d_apkg WHERE internal),
common AS (SELECT path FROM pkg GROUP BY path HAVING count(*) = 2),
d_sym AS (SELECT path, axis, kind, name, CASE WHEN bool_or(sid = 'A') THEN 'removed' ELSE 'added' END AS change FROM sym WHERE path IN (FROM common) GROUP BY ALL HAVING count(*) = 1),
d_inv AS (SELECT path, name, CASE WHEN count(*) = 2 THEN 'modified' WHEN bool_or(sid = 'A') THEN 'removed' ELSE 'added' END AS change FROM inv WHERE path IN (FROM common) GROUP BY path, name HAVING count(*) = 1 OR count(DISTINCT hash) = 2)
"""
