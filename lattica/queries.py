"""One query for each operator over the projections, and the SQL that it equals."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import paths as P
from .operators import components as cp
from .operators import conform as cf
from .operators import delta as dl
from .operators import filters as flt
from .operators import graph as gr
from .operators import history as hs
from .operators import metrics as me
from .operators.ranks import ranked
from .plans import distance as pd
from .projections import trade, trade_sql
from .schema import Snapshots
from .shared import written
from .sources import expressions, golang, types, usage

QUERIES, ORACLE = {}, {}


def _strings(df):
    """Arrays as joined strings, so that results compare alike everywhere."""
    return df.select(*[F.array_join(c, ",").alias(c) if k.startswith("array") else F.col(c) for c, k in df.dtypes])


def query(sql: str | None = None, by_year: bool = False):
    """Register ``f(snapshots, pairs)`` over the trade graph with its SQL."""

    def add(f):
        def run(spark, sf_dir):
            s = trade(spark, sf_dir, by_year)
            out = f(s, dl.pair(spark))
            return _strings(out.drop("pair_id")).withColumnsRenamed({"snapshot_id": "sid"})

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = trade_sql(by_year) + sql
        return f

    return add


def _yearly(sql):
    return query(sql, by_year=True)


def _comp(path: str) -> str:
    return f"split_part({path}, '/', 2) || '/' || split_part({path}, '/', 3)"


# Filters and projections


@query("SELECT sid, path FROM pkg")
def flt_internal_paths(s, _):
    return flt.internal_paths(s)


@query("SELECT sid, src, kind, dst FROM edge WHERE kind IN ('import', 'call') AND src <> dst")
def flt_dep_edges(s, _):
    return flt.dep_edges(s)


@query("SELECT sid, src, dst FROM dep")
def flt_dedupe_pair(s, _):
    return flt.dep_pairs(s)


@query("SELECT sid, src, kind, dst FROM edge")
def flt_internal_edges(s, _):
    return flt.internal_edges(s)


@query("SELECT sid, src, kind, dst FROM edge e WHERE kind <> 'import' OR NOT EXISTS (FROM edge c WHERE c.sid = e.sid AND c.src = e.src AND c.dst = e.dst AND c.kind = 'call')")
def flt_import_collapse(s, _):
    return flt.collapse_imports(flt.internal_edges(s))


@query("SELECT sid, path, internal FROM apkg WHERE internal OR path LIKE 'env:%' OR path LIKE 'flag:%'")
def flt_select_nodes(s, _):
    return flt.drawn_nodes(s)


@query("""SELECT src, kind, dst, change FROM (SELECT e.src, e.kind, e.dst, coalesce(d.change, '') AS change FROM (SELECT DISTINCT src, kind, dst FROM aedge) e LEFT JOIN d_edge d USING (src, kind, dst))
WHERE src IN (SELECT src FROM d_edge UNION SELECT dst FROM d_edge UNION SELECT path FROM d_apkg) AND dst IN (SELECT src FROM d_edge UNION SELECT dst FROM d_edge UNION SELECT path FROM d_apkg)""")
def flt_focus_changed(s, pairs):
    change = F.when(~F.col("in_a"), "added").when(~F.col("in_b"), "removed").otherwise("")
    nodes = dl.both(s.package.select("snapshot_id", "path"), pairs, ["path"]).select("pair_id", "path", change.alias("change"))
    arrows = dl.both(s.edge.select("snapshot_id", "src", "kind", "dst"), pairs, ["src", "kind", "dst"]).select("pair_id", "src", "kind", "dst", change.alias("change"))
    return flt.focus(nodes, arrows)[1]


@query("SELECT sid, path FROM pkg WHERE path LIKE '%/p7/x7k2'")
def flt_resolve_target(s, _):
    return flt.resolve_target(s, "p7/x7k2")


@query("""SELECT sid, path, CASE WHEN path LIKE 'tpch/%' THEN substr(path, 6) ELSE path END AS rel, split_part(CASE WHEN path LIKE 'tpch/%' THEN substr(path, 6) ELSE path END, '/', 1) AS comp, split_part(path, '/', -1) AS short,
CASE WHEN path LIKE 'api:%' THEN 'endpoint' WHEN path LIKE 'service:%' THEN 'service' WHEN path LIKE 'cap:%' THEN 'capability' WHEN path LIKE 'env:%' OR path LIKE 'flag:%' THEN 'config' WHEN NOT internal THEN 'external' ELSE '' END AS tag, substr(sha256(path), 1, 12) AS digest FROM apkg""")
def prj_paths(s, _):
    rel = P.rel(F.col("path"), F.lit("tpch"))
    return s.package.select("snapshot_id", "path", rel.alias("rel"), P.component(rel, 1).alias("comp"), P.short("path").alias("short"), P.node_tag(F.col("path"), F.col("internal")).alias("tag"), P.digest12("path").alias("digest"))


@query("SELECT sid, path, CASE WHEN count(*) OVER (PARTITION BY sid, split_part(path, '/', -1)) > 1 THEN path ELSE split_part(path, '/', -1) END AS label FROM apkg")
def win_label_collision(s, _):
    return flt.short_labels(s)


@query("SELECT sid, path, 'n' || CAST(row_number() OVER (PARTITION BY sid ORDER BY path) - 1 AS VARCHAR) AS node FROM apkg")
def win_node_ids(s, _):
    return flt.node_ids(s)


# Deltas


@query("SELECT path, change, internal FROM d_apkg")
def dl_packages(s, pairs):
    return dl.packages(s, pairs)


@query("SELECT src, kind, dst, change FROM d_edge")
def dl_edges(s, pairs):
    return dl.edges(s, pairs)


@query("SELECT path, kind, name, change FROM d_sym WHERE axis = 'surface'")
def dl_surface(s, pairs):
    return dl.symbols(s, pairs, "surface")


@query("SELECT path, kind, name, change FROM d_sym WHERE axis = 'schema'")
def dl_schema(s, pairs):
    return dl.symbols(s, pairs, "schema")


@query("SELECT path, name, change FROM d_inv")
def dl_invariants(s, pairs):
    return dl.invariants(s, pairs)


@query("SELECT DISTINCT path, iface FROM guard JOIN d_inv USING (path, name) WHERE change <> 'added'")
def dl_touched_promises(s, pairs):
    return dl.touched_promises(s, pairs)


@query("SELECT sid, iface, impl FROM impl")
def dl_implementers(s, _):
    return dl.implementers(s)


@query("""SELECT c.sid, c.iface, coalesce(string_agg(impl, ',' ORDER BY impl) FILTER (covered), '') AS covered, coalesce(string_agg(impl, ',' ORDER BY impl) FILTER (NOT covered), '') AS uncovered,
coalesce(any_value(t.tests), '') AS tests, bool_or(covered) AS names_concretes FROM cov c LEFT JOIN (SELECT sid, iface, string_agg(DISTINCT name, ',' ORDER BY name) AS tests FROM guard GROUP BY ALL) t ON c.sid = t.sid AND c.iface = t.iface GROUP BY c.sid, c.iface""")
def dl_coverage(s, _):
    return dl.coverage(s)


@query("SELECT c.sid, c.iface, CASE WHEN bool_and(covered) THEN 'none' WHEN NOT bool_or(g.iface IS NOT NULL) THEN 'no-test' WHEN bool_or(covered) THEN 'proven' ELSE 'unconfirmed' END AS gap FROM cov c LEFT JOIN (SELECT DISTINCT sid, iface FROM guard) g ON c.sid = g.sid AND c.iface = g.iface GROUP BY c.sid, c.iface")
def ev_gapkind(s, _):
    return dl.gap_kinds(s)


@query("""SELECT iface, coalesce(string_agg(impl, ',' ORDER BY impl) FILTER (sid = 'B'), '') AS added, coalesce(string_agg(impl, ',' ORDER BY impl) FILTER (sid = 'A'), '') AS removed,
coalesce(any_value(b.cov), '') AS covered, coalesce(any_value(b.unc), '') AS uncovered, coalesce(any_value(b.tests), '') AS tests, coalesce(any_value(b.nc), false) AS names_concretes
FROM (SELECT iface, impl, min(sid) AS sid FROM impl GROUP BY ALL HAVING count(*) = 1) LEFT JOIN (SELECT iface, string_agg(impl, ',' ORDER BY impl) FILTER (covered) AS cov, string_agg(impl, ',' ORDER BY impl) FILTER (NOT covered) AS unc, bool_or(covered) AS nc,
any_value(t.tests) AS tests FROM cov LEFT JOIN (SELECT iface AS i, string_agg(DISTINCT name, ',' ORDER BY name) AS tests FROM guard WHERE sid = 'B' GROUP BY ALL) t ON t.i = iface WHERE sid = 'B' GROUP BY iface) b USING (iface) GROUP BY iface""")
def dl_contracts(s, pairs):
    return dl.contracts(s, pairs)


_OFF = """SELECT b.src, b.kind, b.dst, coalesce(d.change = 'added', false) AS introduced FROM edge b LEFT JOIN d_edge d ON d.src = b.src AND d.kind = b.kind AND d.dst = b.dst
WHERE sid = 'B' AND b.kind IN ('import', 'call') AND b.src <> b.dst AND b.src IN (SELECT src FROM dep WHERE sid = 'A') AND NOT EXISTS (FROM dep a WHERE a.sid = 'A' AND a.src = b.src AND a.dst = b.dst)"""


def _allowed(s):
    a = flt.dep_pairs(s).where("snapshot_id = 'A'")
    return a.select(F.col("src").alias("path")).distinct(), a.select(F.col("src").alias("path"), F.col("dst").alias("target"))


@query(_OFF)
def dl_violations(s, pairs):
    return dl.violations(s, pairs, *_allowed(s))


@query("SELECT (SELECT count(*) FROM d_edge) + (SELECT count(*) FROM d_pkg) + (SELECT count(*) FROM d_sym WHERE axis = 'surface') = 0 AS empty, CASE WHEN (SELECT count(*) FROM d_edge) + (SELECT count(*) FROM d_pkg) + (SELECT count(*) FROM d_sym WHERE axis = 'surface') = 0 THEN 'NO_CHANGE' ELSE 'ARCHITECTURAL_CHANGE' END AS verdict")
def dl_verdict(s, pairs):
    return dl.verdict(s, pairs)


_WIT = """SELECT src, kind, dst, CASE WHEN NOT inb THEN 'REMOVED' WHEN NOT ina THEN 'ADDED' WHEN r <> '' AND a <> '' THEN 'CHURNED' WHEN r <> '' THEN 'WEAKENED' ELSE 'STRENGTHENED' END AS status, r AS removed, a AS added, m AS remaining FROM (
SELECT src, kind, dst, bool_or(ina) AS ina, bool_or(inb) AS inb, coalesce(string_agg(witness, ',' ORDER BY witness) FILTER (NOT inb), '') AS r, coalesce(string_agg(witness, ',' ORDER BY witness) FILTER (NOT ina), '') AS a, coalesce(string_agg(witness, ',' ORDER BY witness) FILTER (ina AND inb), '') AS m
FROM (SELECT src, kind, dst, witness, bool_or(sid = 'A') AS ina, bool_or(sid = 'B') AS inb FROM wit GROUP BY ALL) GROUP BY src, kind, dst) WHERE r <> '' OR a <> ''"""


_WIDER = "SELECT path, kind, name FROM d_sym WHERE axis = 'surface' AND change = 'added' AND path LIKE 'tpch/ASIA/%' AND name < 'G'"


def _widenings(s, pairs):
    fixed = s.package.where("path like 'tpch/ASIA/%'").select("path").distinct()
    return cf.surface_widenings(s, pairs, fixed, s.symbol.where("axis = 'surface' and name >= 'G'").select("path", "name"))


@query(_WIT)
def dl_witness(s, pairs):
    return dl.witnesses(s, pairs)


@query("SELECT src, kind, dst, string_agg(DISTINCT witness, ',' ORDER BY witness) AS witnesses FROM wit GROUP BY ALL")
def agg_collect_witness(s, _):
    return s.witness.groupBy("src", "kind", "dst").agg(P.joined("witness").alias("witnesses"))


@query(f"SELECT count(*) FILTER (status = 'REMOVED') AS full, count(*) FILTER (status = 'WEAKENED') AS partial FROM ({_WIT})")
def dl_witness_verdict(s, pairs):
    return dl.witness_verdict(dl.witnesses(s, pairs))


@query(f"""SELECT (SELECT count(*) FROM d_apkg WHERE change = 'added') AS packages_added, (SELECT count(*) FROM d_apkg WHERE change = 'removed') AS packages_removed, (SELECT count(*) FROM d_edge WHERE change = 'added') AS edges_added, (SELECT count(*) FROM d_edge WHERE change = 'removed') AS edges_removed,
(SELECT count(DISTINCT path) FROM d_sym WHERE axis = 'surface') AS surface, (SELECT count(DISTINCT path) FROM d_sym WHERE axis = 'schema') AS schema, (SELECT count(DISTINCT path) FROM d_inv) AS invariants, (SELECT count(DISTINCT iface) FROM (SELECT iface FROM impl GROUP BY iface, impl HAVING count(*) = 1)) AS contracts,
(SELECT count(*) FROM ({_WIT}) WHERE status = 'REMOVED') AS decoupled, (SELECT count(*) FROM ({_WIT}) WHERE status = 'WEAKENED') AS weakened,
(SELECT count(*) FROM ({_OFF})) AS violations, (SELECT count(*) FROM ({_WIDER})) AS surface_widenings""")
def agg_counts(s, pairs):
    return dl.counts(s, pairs, dl.violations(s, pairs, *_allowed(s)), _widenings(s, pairs))


_ALL = "SELECT change FROM d_apkg UNION ALL SELECT change FROM d_edge UNION ALL SELECT change FROM d_inv UNION ALL SELECT change FROM d_sym"


@query(f"SELECT *, removed + modified > 0 AS breaking, CASE WHEN removed + modified > 0 THEN 'changed' WHEN added > 0 THEN 'widened' ELSE 'none' END AS shape FROM (SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified FROM ({_ALL}))")
def dl_surface_verdict_py(s, pairs):
    return dl.surface_summary(s, pairs)


_PAINT = """, dcon AS (SELECT iface, impl FROM impl GROUP BY ALL HAVING count(*) = 1),
strong AS (SELECT src AS path FROM d_edge UNION SELECT dst FROM d_edge UNION SELECT regexp_replace(impl, '\\.[^.]*$', '') FROM dcon UNION SELECT regexp_replace(impl, '\\.[^.]*$', '') FROM cov WHERE sid = 'B' AND NOT covered AND iface IN (SELECT iface FROM dcon)),
paint AS (SELECT path, CASE WHEN path IN (FROM strong) THEN 'boundary' ELSE 'minor' END AS change FROM (SELECT DISTINCT path FROM pkg) WHERE path IN (FROM strong) OR path IN (SELECT path FROM d_sym UNION SELECT path FROM d_inv WHERE change <> 'modified'))"""


@query(_PAINT + " SELECT path, change FROM paint")
def dl_component_paint_py(s, pairs):
    return dl.painted_packages(s, pairs)


@query(_PAINT + " SELECT src, kind, dst FROM edge WHERE sid = 'B' AND src <> dst AND (src IN (SELECT path FROM paint) OR dst IN (SELECT path FROM paint)) AND (src, dst) NOT IN (SELECT (src, dst) FROM d_edge WHERE change = 'removed')")
def dl_context_edges(s, pairs):
    return dl.context_edges(s, pairs)


@query("""SELECT 'new packages' AS label, split_part(path, '/', -1) AS item FROM d_pkg WHERE change = 'added' UNION ALL SELECT CASE axis WHEN 'surface' THEN 'surface +' ELSE 'schema +' END, split_part(path, '/', -1) || '.' || name FROM d_sym WHERE change = 'added'
UNION ALL SELECT DISTINCT CASE WHEN dst LIKE 'service:%' THEN 'services' WHEN dst LIKE 'api:%' THEN 'endpoints' WHEN dst LIKE 'cap:%' THEN 'capabilities' ELSE 'config keys' END, dst FROM d_edge WHERE change = 'added' AND (dst LIKE 'service:%' OR dst LIKE 'api:%' OR dst LIKE 'cap:%' OR dst LIKE 'env:%' OR dst LIKE 'flag:%')
UNION ALL SELECT DISTINCT 'invariant', iface FROM guard JOIN d_inv USING (path, name) WHERE change <> 'added'
UNION ALL SELECT 'contracts', split_part(i.impl, '/', -1) || ' ⊨ ' || split_part(i.iface, '/', -1) || CASE WHEN c.covered THEN '' ELSE ' [UNCOVERED]' END FROM (SELECT iface, impl FROM impl GROUP BY ALL HAVING count(*) = 1 AND min(sid) = 'B') i JOIN cov c ON c.sid = 'B' AND c.iface = i.iface AND c.impl = i.impl""")
def dl_triage(s, pairs):
    return dl.triage(s, pairs)


@query(f"""SELECT CASE WHEN (SELECT count(*) FROM d_edge) + (SELECT count(*) FROM d_pkg) + (SELECT count(*) FROM d_sym WHERE axis = 'surface') = 0 THEN 'FAST-TRACK' ELSE 'NEEDS ARCHITECTURE REVIEW' END AS verdict, (SELECT count(*) FROM ({_OFF})) AS breaches,
(SELECT count(*) FROM (SELECT iface, impl FROM impl GROUP BY ALL HAVING count(*) = 1 AND min(sid) = 'B') i JOIN cov c ON c.sid = 'B' AND c.iface = i.iface AND c.impl = i.impl WHERE NOT covered) AS gaps,
(SELECT coalesce(string_agg(DISTINCT x, ', ' ORDER BY x), '') FROM (SELECT split_part(iface, '/', -1) AS x FROM guard JOIN d_inv USING (path, name) WHERE change <> 'added')) AS touched""")
def dl_fast_track(s, pairs):
    return dl.triage_summary(s, pairs, dl.violations(s, pairs, *_allowed(s)))


_NOTABLE = "(kind IN ('config', 'service', 'capability', 'protocol') OR contains(split_part(dst, '/', 1), '.') OR dst IN ('net', 'net/http', 'database/sql', 'os/exec', 'syscall', 'unsafe', 'plugin', 'crypto/tls', 'net/rpc', 'os', 'reflect'))"


@query(f"SELECT sid, src, kind, dst FROM aedge WHERE {_NOTABLE}")
def flt_notable_external(s, _):
    return s.edge.where(P.notable(F.col("dst"), F.col("kind"))).select("snapshot_id", "src", "kind", "dst")


@query(f"SELECT src, string_agg(DISTINCT dst, ',' ORDER BY dst) AS targets FROM d_edge WHERE change = 'added' AND {_NOTABLE} AND dst NOT IN (SELECT path FROM pkg WHERE sid = 'B') GROUP BY src")
def dl_ext_boundaries(s, pairs):
    return dl.external_boundaries(s, pairs)


@query("SELECT DISTINCT dst FROM d_edge WHERE change = 'added' AND dst LIKE 'service:%'")
def dl_synthetic_added(s, pairs):
    return dl.synthetic_added(s, pairs, "service:")


@query(f"SELECT src, kind, dst, status FROM ({_WIT}) WHERE src LIKE '%/p2%' AND kind = 'call'")
def flt_witness_select(s, pairs):
    return dl.select_witnesses(dl.witnesses(s, pairs), "/p2", "", "call").select("pair_id", "src", "kind", "dst", "status")


# Conformance


@query("SELECT sid, p.path, coalesce(string_agg(DISTINCT dst, ',' ORDER BY dst), '') AS targets FROM pkg p LEFT JOIN dep d USING (sid) WHERE d.src = p.path OR d.src IS NULL GROUP BY ALL UNION ALL SELECT sid, path, '' FROM pkg WHERE (sid, path) NOT IN (SELECT (sid, src) FROM dep)")
def agg_contract_snapshot(s, _):
    return cf.allow_snapshot(s)


@query(_WIDER)
def gt_surface(s, pairs):
    return _widenings(s, pairs)


@query("""SELECT path, false AS filled FROM (SELECT DISTINCT path FROM sym WHERE sid = 'A' AND axis = 'surface') WHERE path NOT LIKE '%/ASIA/%'
UNION ALL SELECT path, true FROM (SELECT DISTINCT path FROM sym WHERE sid = 'A' AND axis = 'surface')""")
def gt_policy_from_plan(s, _):
    a = {k: getattr(s, k).where("snapshot_id = 'A'") for k in ("package", "symbol")}
    plan = Snapshots.of(s.edge.sparkSession, package=a["package"].withColumn("hole", F.col("path").contains("/ASIA/")), symbol=a["symbol"])
    return cf.fixed_from_plan(plan).withColumn("filled", F.lit(False)).unionByName(cf.fixed_from_plan(plan, True).withColumn("filled", F.lit(True)))


_LAYERS = [("AFRICA", 0), ("AMERICA", 1), ("ASIA", 2), ("EUROPE", 3)]
_ROWS = """lay AS (SELECT * FROM (VALUES ('AFRICA', 0), ('AMERICA', 1), ('ASIA', 2), ('EUROPE', 3)) v(l, o)),
ldep AS (SELECT sid, split_part(src, '/', 2) AS f, split_part(dst, '/', 2) AS t, x.o AS fo, y.o AS t_o FROM dep LEFT JOIN lay x ON split_part(src, '/', 2) = x.l LEFT JOIN lay y ON split_part(dst, '/', 2) = y.l)"""


def _layered(s):
    spark = s.edge.sparkSession
    layers = dl.few(spark, _LAYERS, ["layer", "ord"])
    return layers, layers.select(F.col("layer").alias("seg"), "layer")


@query(f", {_ROWS} SELECT sid, f AS \"from\", t AS \"to\", CASE WHEN fo <= t_o THEN 'down' ELSE 'up' END AS direction, count(*) AS count FROM ldep WHERE fo IS NOT NULL AND t_o IS NOT NULL AND f <> t GROUP BY ALL")
def agg_layer_counts(s, _):
    return cf.layer_counts(cf.layered(s, *_layered(s)))


@query(f", {_ROWS} SELECT sid, f AS \"from\", t AS \"to\", count(*) AS count, f AS from_layer, t AS to_layer, f AS from_layer_name, t AS to_layer_name FROM ldep WHERE fo > t_o GROUP BY ALL")
def rf_report(s, _):
    return cf.reflexion(s, *_layered(s))


@query(f", {_ROWS} SELECT DISTINCT sid, seg FROM (SELECT sid, f AS seg FROM ldep WHERE fo IS NULL UNION SELECT sid, t FROM ldep WHERE t_o IS NULL)")
def rf_unmapped(s, _):
    return cf.unmapped(cf.layered(s, *_layered(s)))


@query("SELECT sid, path, string_agg(DISTINCT name, ',' ORDER BY name) AS tests FROM guard GROUP BY ALL")
def ev_bound_tests(s, _):
    return cf.bound_tests(s)


def _facts(s):
    i = dl.implementers(s).groupBy("snapshot_id", "iface").agg(F.array_sort(F.collect_set("impl")).alias("implementers"))
    c = s.guard.where("name <> 'BUILDING'").groupBy("snapshot_id", "iface").agg(F.array_sort(F.collect_set("path")).alias("consumer_pkgs"))
    none = F.array().cast("array<string>")
    f = i.join(c, ["snapshot_id", "iface"], "left").withColumn("consumer_pkgs", F.coalesce("consumer_pkgs", none))
    return f.select("snapshot_id", "iface", P.owner("iface").alias("pkg"), none.alias("methods"), "implementers", "consumer_pkgs", F.size("consumer_pkgs").alias("n_consumers"))


_SMELL = """f AS (SELECT i.sid, i.iface, regexp_replace(i.iface, '\\.[^.]*$', '') AS pkg, string_agg(DISTINCT i.impl, ',' ORDER BY i.impl) AS impls, count(DISTINCT i.impl) AS n, bool_or(regexp_replace(i.impl, '\\.[^.]*$', '') <> regexp_replace(i.iface, '\\.[^.]*$', '')) AS away,
  string_agg(DISTINCT g.path, ',' ORDER BY g.path) AS cons, coalesce(bool_or(g.path <> regexp_replace(i.iface, '\\.[^.]*$', '')), false) AS used FROM impl i LEFT JOIN (FROM guard WHERE name <> 'BUILDING') g ON g.sid = i.sid AND g.iface = i.iface GROUP BY ALL),
sm AS (SELECT sid, iface, CASE WHEN n = 1 AND away AND NOT used THEN 'STRANDED' WHEN n = 1 AND away THEN 'single-impl cross-boundary' WHEN n <= 1 AND cons IS NULL THEN 'unconsumed' ELSE '' END AS smell, impls, cons FROM f)"""


@query(f", {_SMELL} SELECT sid, iface, smell FROM sm")
def cs_smell(s, _):
    return cf.smells(_facts(s)).select("snapshot_id", "iface", "smell")


@query(f""", {_SMELL} SELECT sid, iface, smell FROM sm WHERE smell <> '' OR (sid, iface) IN (SELECT (i.sid, i.iface) FROM impl i WHERE regexp_replace(impl, '\\.[^.]*$', '') <> regexp_replace(iface, '\\.[^.]*$', ''))
OR (sid, iface) IN (SELECT (sid, iface) FROM guard WHERE name <> 'BUILDING' AND path <> regexp_replace(iface, '\\.[^.]*$', ''))""")
def flt_interesting_contract(s, _):
    return cf.interesting(_facts(s)).select("snapshot_id", "iface", "smell")


@query(f""", {_SMELL}, j AS (SELECT coalesce(a.iface, b.iface) AS iface, a.iface IS NULL AS na, b.iface IS NULL AS nb, coalesce(a.impls, '') AS ia, coalesce(b.impls, '') AS ib, coalesce(a.cons, '') AS ca, coalesce(b.cons, '') AS cb, coalesce(a.smell, '') AS sa, coalesce(b.smell, '') AS sb,
  array_to_string(list_sort(list_filter(string_split(coalesce(b.impls, ''), ','), lambda x: NOT list_contains(string_split(coalesce(a.impls, ''), ','), x))), ',') AS ip, array_to_string(list_sort(list_filter(string_split(coalesce(a.impls, ''), ','), lambda x: NOT list_contains(string_split(coalesce(b.impls, ''), ','), x))), ',') AS im,
  array_to_string(list_sort(list_filter(string_split(coalesce(b.cons, ''), ','), lambda x: NOT list_contains(string_split(coalesce(a.cons, ''), ','), x))), ',') AS cp, array_to_string(list_sort(list_filter(string_split(coalesce(a.cons, ''), ','), lambda x: NOT list_contains(string_split(coalesce(b.cons, ''), ','), x))), ',') AS cm
  FROM (FROM sm WHERE sid = 'A') a FULL JOIN (FROM sm WHERE sid = 'B') b USING (iface))
SELECT iface, CASE WHEN na THEN 'ADDED' WHEN nb THEN 'REMOVED' WHEN ia <> ib OR ca <> cb THEN 'MODIFIED' ELSE 'unchanged' END AS status, sa AS smell_a, sb AS smell_b, ip AS impl_added, im AS impl_removed, cp AS cons_added, cm AS cons_removed, sb = 'STRANDED' AND sa <> 'STRANDED' AS newly_stranded, sa = 'STRANDED' AND sb <> 'STRANDED' AS unstranded FROM j WHERE na OR nb OR ia <> ib OR ca <> cb OR sa <> sb""")
def cs_delta(s, pairs):
    return cf.interface_delta(_facts(s), pairs)


# Metrics and kernels


@query("SELECT sid, path, (SELECT count(*) FROM dep WHERE dep.sid = p.sid AND dst = path) AS fan_in, (SELECT count(*) FROM dep WHERE dep.sid = p.sid AND src = path) AS fan_out FROM pkg p")
def agg_fan(s, _):
    return me.fan(s)


@query("SELECT sid, path, (SELECT count(*) FROM sym WHERE sym.sid = p.sid AND sym.path = p.path AND axis = 'surface') AS surface FROM pkg p")
def agg_surface_size(s, _):
    return me.surface_size(s)


@query("SELECT sid, list_sort(list(n))[CAST(floor(0.75 * (count(*) - 1)) AS INT) + 1] AS cut FROM (SELECT p.sid, p.path, count(d.src) AS n FROM pkg p LEFT JOIN dep d ON d.sid = p.sid AND d.dst = p.path GROUP BY ALL) GROUP BY sid")
def agg_percentile_floor(s, _):
    return me.cutoffs(me.fan(s), "fan_in", 0.75)


@query("SELECT sid, src, dst FROM reach")
def gr_closure(s, _):
    return gr.closure(flt.dep_pairs(s))


@query("SELECT src, dst FROM reach WHERE sid = 'B'")
def gr_closure_after(s, _):
    """The closure of the later snapshot, from that of the earlier one and what moved."""
    deps = flt.dep_pairs(s)
    of = lambda sid: written(deps.where(F.col("snapshot_id") == sid).withColumn("snapshot_id", F.lit("history")))
    before, after = of("A"), of("B")
    return gr.closure_after(gr.closure(before), before, after).drop("snapshot_id")


@query("SELECT sid, src AS path, (sid, src, dst) IN (SELECT (sid, src, dst) FROM dep) AS direct FROM reach WHERE dst = 'tpch/ASIA/p2/u0' AND src <> dst")
def gr_dependents(s, _):
    return gr.dependents(flt.dep_pairs(s), "tpch/ASIA/p2/u0")


@query("SELECT sid, dst AS path, count(*) AS blast_radius FROM reach WHERE src <> dst GROUP BY ALL")
def gr_all_blast(s, _):
    return gr.blast_radius(flt.dep_pairs(s))


@query("SELECT a.sid, a.src AS path, least(a.src, min(a.dst)) AS cycle FROM reach a JOIN reach b ON a.sid = b.sid AND a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.sid, a.src")
def gr_scc(s, _):
    return gr.cycles(flt.dep_pairs(s))


@query("""SELECT sid, path, min(hop)::INT AS hop FROM (SELECT sid, 'tpch/ASIA/p2/u0' AS path, 0 AS hop FROM dep UNION ALL SELECT sid, n, 1 FROM und WHERE m = 'tpch/ASIA/p2/u0' UNION ALL SELECT x.sid, y.n, 2 FROM und x JOIN und y ON x.sid = y.sid AND x.n = y.m WHERE x.m = 'tpch/ASIA/p2/u0') GROUP BY ALL""".replace("SELECT sid, path, min", ", und AS (SELECT sid, src AS m, dst AS n FROM dep UNION SELECT sid, dst, src FROM dep) SELECT sid, path, min", 1))
def gr_khop(s, _):
    d = flt.dep_pairs(s)
    return gr.hops(d, d.select("snapshot_id").distinct().withColumn("path", F.lit("tpch/ASIA/p2/u0")), 2)


@query("SELECT sid, src, kind, dst FROM aedge WHERE dst LIKE 'tpch/%' OR dst LIKE 'env:%' OR dst LIKE 'flag:%'")
def gr_visible_subgraph(s, _):
    return gr.induced(s.edge.select("snapshot_id", "src", "kind", "dst"), flt.drawn_nodes(s))


@query(f"SELECT DISTINCT sid, {_comp('src')} AS src, kind, {_comp('dst')} AS dst FROM edge WHERE {_comp('src')} <> {_comp('dst')}")
def gr_rollup(s, _):
    return cp.rolled(s, 2)


@query("""SELECT h.sid, h.path, fan_in, fan_out, round(CASE WHEN fan_in + fan_out > 0 THEN fan_out / (fan_in + fan_out) ELSE 0 END, 6) AS instability, surface, blast AS blast_radius, fan_in >= cf AND surface >= cs AND cf > 0 AS god, cyc IS NOT NULL AS in_cycle FROM h JOIN cut USING (sid)""".replace("SELECT h.sid", """, h AS (SELECT sid, path, (SELECT count(*) FROM dep WHERE dep.sid = p.sid AND dst = path) AS fan_in, (SELECT count(*) FROM dep WHERE dep.sid = p.sid AND src = path) AS fan_out, (SELECT count(*) FROM sym WHERE sym.sid = p.sid AND sym.path = p.path AND axis = 'surface') AS surface,
 (SELECT count(*) FROM reach r WHERE r.sid = p.sid AND r.dst = p.path AND r.src <> r.dst) AS blast, (SELECT min(a.dst) FROM reach a JOIN reach b ON a.sid = b.sid AND a.src = b.dst AND a.dst = b.src WHERE a.sid = p.sid AND a.src = p.path AND a.src <> a.dst) AS cyc FROM pkg p),
cut AS (SELECT sid, list_sort(list(fan_in))[CAST(floor(0.75 * (count(*) - 1)) AS INT) + 1] AS cf, list_sort(list(surface))[CAST(floor(0.75 * (count(*) - 1)) AS INT) + 1] AS cs FROM h GROUP BY sid) SELECT h.sid""", 1))
def he_report(s, _):
    return me.health(s).withColumn("in_cycle", F.col("cycle").isNotNull()).drop("cycle").withColumn("instability", F.round("instability", 6))


# Components


@query(f"SELECT sid, {_comp('path')} AS comp, string_agg(substr(path, 6), ',' ORDER BY path) AS members FROM pkg GROUP BY ALL")
def agg_component_members(s, _):
    return cp.members(s, 2)


@query(f"SELECT sid, comp, array_to_string(m[:2], ', ') || CASE WHEN len(m) > 2 THEN ', …(+' || (len(m) - 2) || ' more)' ELSE '' END AS members FROM (SELECT sid, {_comp('path')} AS comp, list(substr(path, 6) ORDER BY path) AS m FROM pkg GROUP BY ALL)")
def lim_cap(s, _):
    return cp.members(s, 2).select("snapshot_id", "comp", P.capped(F.col("members"), 2).alias("members"))


_CE = f"""ce AS (SELECT DISTINCT sid, {_comp('src')} AS src, kind, {_comp('dst')} AS dst FROM edge WHERE {_comp('src')} <> {_comp('dst')}),
cc AS (SELECT src, kind, dst, CASE WHEN count(*) = 2 THEN '' WHEN min(sid) = 'A' THEN 'removed' ELSE 'added' END AS change FROM ce GROUP BY ALL)"""


@query(f", {_CE} SELECT src, dst, change, string_agg(kind, ', ' ORDER BY kind) AS kinds FROM cc GROUP BY ALL")
def agg_component_edges(s, pairs):
    return cp.edge_changes(s, pairs, 2)


@query(f""", {_CE}, cr AS (SELECT DISTINCT src, dst FROM cc UNION SELECT r.src, c.dst FROM cr r JOIN (SELECT DISTINCT src, dst FROM cc) c ON r.dst = c.src),
dc AS (SELECT iface, impl FROM impl GROUP BY ALL HAVING count(*) = 1), touched AS (SELECT src AS path FROM d_edge UNION SELECT dst FROM d_edge UNION SELECT regexp_replace(iface, '\\.[^.]*$', '') FROM dc UNION SELECT regexp_replace(impl, '\\.[^.]*$', '') FROM dc UNION SELECT path FROM d_pkg WHERE change = 'added'),
small AS (SELECT path FROM d_sym UNION SELECT path FROM d_inv)
SELECT {_comp('path')} AS comp, string_agg(DISTINCT substr(path, 6), ',' ORDER BY substr(path, 6)) AS members, {_comp('path')} IN (SELECT a.src FROM cr a JOIN cr b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst) AS in_cycle,
CASE WHEN bool_or(path IN (FROM touched)) THEN 'boundary' WHEN bool_or(path IN (FROM small)) THEN 'minor' ELSE '' END AS change FROM pkg GROUP BY 1""")
def dl_components(s, pairs):
    return cp.painted(s, pairs, 2)


@query(f""", {_CE}, sr AS (SELECT DISTINCT sid, src, dst FROM ce UNION SELECT r.sid, r.src, c.dst FROM sr r JOIN (SELECT DISTINCT sid, src, dst FROM ce) c ON r.sid = c.sid AND r.dst = c.src)
SELECT sid, src, kind, dst, EXISTS (FROM sr WHERE sr.sid = ce.sid AND sr.src = ce.dst AND sr.dst = ce.src) AS in_cycle FROM ce""")
def gr_component_cycle_py(s, _):
    return cp.single_cycles(s, 2)


@query(f", {_SMELL} SELECT sid, iface, smell FROM sm WHERE contains(iface, '/p3')")
def flt_contract_select(s, _):
    return cf.select_contracts(_facts(s), "/p3").select("snapshot_id", "iface", "smell")


# Plans: snapshot A, with its imports allowed and the surface of its Asian boxes promised, is the plan for the others


def _plan(s: Snapshots) -> Snapshots:
    spark = s.edge.sparkSession
    a = {k: getattr(s, k).where("snapshot_id = 'A'") for k in ("snapshot", "package", "symbol", "edge")}
    hole = F.col("path").contains("/ASIA/")
    a["package"] = a["package"].withColumn("hole", hole)
    a["symbol"] = a["symbol"].where(hole)
    allow = a["edge"].where("kind = 'import'").select("snapshot_id", F.col("src").alias("path"), F.col("dst").alias("target"))
    return Snapshots.of(spark, **a, allow=allow)


_UNMET = """ids AS (SELECT DISTINCT sid FROM PKG),
want AS (SELECT path, name FROM SYM WHERE sid = 'A' AND axis = 'surface' AND path LIKE '%/ASIA/%'),
miss AS (SELECT DISTINCT i.sid, path FROM ids i, want w WHERE NOT EXISTS (FROM SYM h WHERE h.sid = i.sid AND h.path = w.path AND h.name = w.name AND h.axis = 'surface')),
nh AS (SELECT sid, path, count(*) AS n FROM SYM WHERE axis = 'surface' GROUP BY ALL), nw AS (SELECT path, count(*) AS n FROM want GROUP BY ALL),
b1 AS (SELECT i.sid, p.path, q.path IS NOT NULL AS here, m.path IS NOT NULL AS mis, coalesce(nh.n, 0) AS have, coalesce(nw.n, 0) AS wnt FROM ids i CROSS JOIN (SELECT path FROM PKG WHERE sid = 'A') p
  LEFT JOIN PKG q ON q.sid = i.sid AND q.path = p.path LEFT JOIN miss m ON m.sid = i.sid AND m.path = p.path LEFT JOIN nh ON nh.sid = i.sid AND nh.path = p.path LEFT JOIN nw ON nw.path = p.path),
unmet AS (SELECT sid, 'C1' AS class, path AS package, CASE WHEN NOT here THEN 'hole declared, package absent in actual' WHEN have = 0 THEN 'hole declared, package exists but has no interior' ELSE format('hole filled but surface mismatch: declared {}, actual {}', wnt, have) END AS detail FROM b1 WHERE path LIKE '%/ASIA/%' AND (NOT here OR have = 0 OR mis)
UNION ALL SELECT sid, 'C2', path, 'declared box absent from actual' FROM b1 WHERE path NOT LIKE '%/ASIA/%' AND NOT here
UNION ALL SELECT i.sid, 'C3', e.src, 'declared arrow ' || e.src || ' -> ' || e.dst || ' (' || e.kind || ') absent' FROM ids i, (FROM EDGE WHERE sid = 'A') e WHERE NOT EXISTS (FROM EDGE x WHERE x.sid = i.sid AND x.src = e.src AND x.kind = e.kind AND x.dst = e.dst)
UNION ALL SELECT sid, 'C4', src, 'arrow ' || src || ' -> ' || dst || ' (import) not in Allow' FROM EDGE e WHERE kind = 'import' AND src IN (SELECT path FROM PKG WHERE sid = 'A') AND dst IN (SELECT path FROM PKG WHERE sid = 'A') AND src IN (SELECT src FROM EDGE WHERE sid = 'A' AND kind = 'import') AND NOT EXISTS (FROM EDGE x WHERE x.sid = 'A' AND x.kind = 'import' AND x.src = e.src AND x.dst = e.dst))"""
_UNMET, _UNMET3 = (_UNMET.replace("PKG", p).replace("EDGE", e).replace("SYM", y) for p, e, y in (("apkg", "aedge", "sym"), ("p3", "e3", "s3")))


@query(f", {_UNMET} SELECT sid, class, package, detail FROM unmet")
def pl_dist(s, _):
    return pd.unmet(_plan(s), s)


@query(f", {_UNMET} SELECT (SELECT count(*) FROM unmet WHERE sid = 'A') AS before, (SELECT count(*) FROM unmet WHERE sid = 'B') AS after, (SELECT count(*) FROM unmet WHERE sid = 'B') <= (SELECT count(*) FROM unmet WHERE sid = 'A') AS ok, (SELECT count(*) FROM unmet WHERE sid = 'B' AND class = 'C4') > (SELECT count(*) FROM unmet WHERE sid = 'A' AND class = 'C4') AS more_disallowed")
def pl_ratchet(s, pairs):
    return pd.ratchet(_plan(s), s, pairs)


def _three(s: Snapshots) -> Snapshots:
    """A, B, and C: A with the calls that B has between A's boxes."""
    as_c = lambda df: df.withColumn("snapshot_id", F.lit("C"))
    a = {k: getattr(s, k).where("snapshot_id = 'A'") for k in ("snapshot", "package", "symbol", "edge")}
    boxes, calls = a["package"].where("internal").select("path"), s.edge.where("snapshot_id = 'B' and kind = 'call'")
    for end in ("src", "dst"):
        calls = calls.join(boxes.withColumnRenamed("path", end), end, "left_semi")
    more = {k: as_c(df) for k, df in a.items()}
    more["edge"] = as_c(a["edge"].unionByName(calls)).distinct()
    return Snapshots.of(s.edge.sparkSession, **{k: getattr(s, k).unionByName(more[k]) for k in more})


_THREE = """more AS (SELECT DISTINCT src, kind, dst FROM edge WHERE sid = 'B' AND kind = 'call' AND src IN (SELECT path FROM pkg WHERE sid = 'A') AND dst IN (SELECT path FROM pkg WHERE sid = 'A')),
e3 AS (FROM aedge UNION ALL SELECT 'C', src, kind, dst FROM (SELECT src, kind, dst FROM aedge WHERE sid = 'A' UNION FROM more)),
p3 AS (SELECT sid, path FROM apkg UNION ALL SELECT 'C', path FROM apkg WHERE sid = 'A'),
s3 AS (FROM sym UNION ALL SELECT 'C', path, axis, kind, name FROM sym WHERE sid = 'A')"""


@query(f""", {_THREE}, {_UNMET3}, pr AS (SELECT * FROM (VALUES ('A', 'B'), ('A', 'A'), ('B', 'A'), ('A', 'C')) v(a, b)),
n AS (SELECT sid, (SELECT count(*) FROM unmet u WHERE u.sid = i.sid) AS t, (SELECT count(*) FROM unmet u WHERE u.sid = i.sid AND class = 'C4') AS d FROM ids i),
fresh AS (SELECT a, b, e.src, e.dst, x.src IS NOT NULL AS planned FROM pr JOIN e3 e ON e.sid = b LEFT JOIN e3 x ON x.sid = 'A' AND x.src = e.src AND x.kind = e.kind AND x.dst = e.dst WHERE NOT EXISTS (FROM e3 y WHERE y.sid = a AND y.src = e.src AND y.kind = e.kind AND y.dst = e.dst)),
arrows AS (SELECT a, b, bool_or(planned) AS planned, bool_or(NOT planned AND (src IN (SELECT path FROM p3 WHERE sid = 'A') OR dst IN (SELECT path FROM p3 WHERE sid = 'A'))) AS beyond FROM fresh GROUP BY ALL),
boxes AS (SELECT DISTINCT a, b FROM pr JOIN p3 q ON q.sid = b WHERE NOT EXISTS (FROM p3 y WHERE y.sid = a AND y.path = q.path) AND EXISTS (FROM p3 y WHERE y.sid = 'A' AND y.path = q.path))
SELECT pr.a || '..' || pr.b AS pair, CASE WHEN nb.d > na.d OR nb.t > na.t THEN 'CONFLICTS' WHEN beyond THEN 'EXCEEDS' WHEN planned OR boxes.a IS NOT NULL OR nb.t < na.t THEN 'REALIZES' ELSE 'UNRELATED' END AS class
FROM pr JOIN n na ON na.sid = pr.a JOIN n nb ON nb.sid = pr.b LEFT JOIN arrows ON arrows.a = pr.a AND arrows.b = pr.b LEFT JOIN boxes ON boxes.a = pr.a AND boxes.b = pr.b""")
def pl_classify(s, _):
    pairs = dl.named_pairs(s.edge.sparkSession, ["AB", "AA", "BA", "AC"])
    return pd.classify(_plan(s), _three(s), pairs).withColumnRenamed("pair_id", "pair")


@query(f", {_UNMET} SELECT sid, path FROM miss")
def pl_surface_match(s, _):
    return pd.unmatched_surface(_plan(s), s)


# History


def _years(s):
    return hs.consecutive(s.snapshot.select("snapshot_id", F.col("snapshot_id").alias("seq")))


_YEARS = """p AS (SELECT a.sid AS a, b.sid AS b, a.sid || '..' || b.sid AS pair FROM (SELECT DISTINCT sid FROM pkg) a JOIN (SELECT DISTINCT sid FROM pkg) b ON CAST(b.sid AS INT) = CAST(a.sid AS INT) + 1),
ye AS (SELECT pair, count(*) AS n FROM (SELECT pair, src, kind, dst FROM p JOIN aedge ON sid IN (a, b) GROUP BY ALL HAVING count(*) = 1) GROUP BY pair),
yp AS (SELECT pair, count(*) AS n FROM (SELECT pair, path FROM p JOIN apkg ON sid IN (a, b) GROUP BY ALL HAVING count(*) = 1) GROUP BY pair),
ys AS (SELECT pair, count(*) AS n FROM (SELECT pair, path, kind, name FROM p JOIN sym ON sid IN (a, b) WHERE axis = 'surface' AND (pair, path) IN (SELECT (pair, path) FROM p JOIN pkg ON sid IN (a, b) GROUP BY pair, path HAVING count(*) = 2) GROUP BY ALL HAVING count(*) = 1) GROUP BY pair),
hist AS (SELECT p.pair, p.a, p.b, coalesce(yp.n, 0) AS d_boxes, coalesce(ye.n, 0) AS d_arrows, coalesce(ys.n, 0) AS d_surface FROM p LEFT JOIN ye USING (pair) LEFT JOIN yp USING (pair) LEFT JOIN ys USING (pair))"""


@_yearly(f", {_YEARS} SELECT pair, a, b FROM p")
def win_consecutive_pairs(s, _):
    return _years(s).withColumnRenamed("pair_id", "pair")


@_yearly(f", {_YEARS} SELECT pair, d_boxes, d_arrows, d_surface, d_boxes + d_arrows + d_surface AS d_items, d_boxes + d_arrows + d_surface = 0 AS empty FROM hist")
def hs_history(s, _):
    return hs.sizes(s, _years(s)).withColumnRenamed("pair_id", "pair")


# Each year against itself is a change that moves nothing; text lines and errors are made of the years.
@_yearly(f""", {_YEARS}, every AS (SELECT a, b, d_boxes + d_arrows + d_surface AS items, d_boxes + d_arrows + d_surface = 0 AS empty FROM hist UNION ALL SELECT DISTINCT sid, sid, 0, true FROM pkg),
r AS (SELECT *, items // 3 + CAST(b AS INT) % 100 AS lines, CAST(a AS INT) % 4 = 3 OR CAST(b AS INT) % 5 = 0 AS unclean FROM every)
SELECT count(*) AS n, count(*) FILTER (empty) AS n_empty, count(*) FILTER (unclean) AS n_unclean, CAST(trunc(median(lines) FILTER (empty)) AS BIGINT) AS empty_median_text, CAST(max(lines) FILTER (empty) AS BIGINT) AS empty_max_text,
CAST(trunc(median(lines) FILTER (NOT empty)) AS BIGINT) AS median_text, CAST(trunc(median(items) FILTER (NOT empty)) AS BIGINT) AS median_items, CAST(trunc(median(lines / items) FILTER (NOT empty AND items > 0)) AS BIGINT) AS median_compression FROM r""")
def agg_median(s, _):
    same = s.snapshot.select(F.concat_ws("..", "snapshot_id", "snapshot_id").alias("pair_id"), F.col("snapshot_id").alias("a"), F.col("snapshot_id").alias("b"))
    pairs = _years(s).unionByName(same)
    a, b = F.col("a").cast("int"), F.col("b").cast("int")
    rows = hs.sizes(s, pairs).join(pairs, "pair_id")
    return hs.summary(rows.select("empty", "d_items", (F.floor(F.col("d_items") / 3) + b % 100).alias("text_lines"), (a % 4 == 3).cast("int").alias("err_a"), (b % 5 == 0).cast("int").alias("err_b")))


_STAT = "SELECT (year(o_orderdate) - 1) || '..' || year(o_orderdate) AS pair, sum(o_orderkey % 100)::BIGINT AS ins, sum(o_custkey % 10)::BIGINT AS dels, count(*) AS files FROM orders GROUP BY 1"


# Go sources made of the parts, a package each; ten parts share a head package and the name of a method


_GO = """package pKEY

import (
	"os"
HTTP	PQ
	HEADIMPORT
)

type Store interface {
	GetHEAD(x string) error
}

type Row struct {
	Name string `json:"name"`
	hidden int `json:"hidden"`
}

type Mem struct{}

var _ Store = (*Mem)(nil)
CURRENT

func (m *Mem) GetHEAD(x string) error { return step(x) }

func step(x string) error { return nil }

func New() *Mem { return &Mem{} }

func Open(s Store) Store {
	_ = os.Getenv("KSIZE")
	m := New()
	m.GetHEAD("a")
	HEADCALL
	return s
}

type Engine struct{}

func (e *Engine) post(x any) {}

type Tick struct{}

func (t *Tick) Execute(e *Engine) {
	e.post(&Tock{})
	later(e)
}

type Tock struct{}

func (t *Tock) Execute(e *Engine) {}

type Done struct{}

func (t *Done) Execute(e *Engine) {}

func later(e *Engine) {
	e.post(Done{})
}
"""
_PARTS = "WITH g AS (SELECT p_partkey AS k, p_partkey - p_partkey % 10 AS t, p_size AS z, p_brand AS b FROM part), "


def _sources_of(spark, d):
    """Parts, dealt to all cores: reading and lexing their sources outweighs a small file by far."""
    return spark.read.parquet(f"{d}/part.parquet").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")


def _go_files(spark, d):
    k = F.col("p_partkey")
    head = (k - k % 10).cast("string")
    own = k % 10 == 0
    text = F.lit(_GO)
    for word, value in (
        ("HTTP", F.when(F.col("p_size") % 2 == 0, '\t"net/http"\n').otherwise("")),
        ("PQ", F.when(F.col("p_brand") == "Brand#1", '"github.com/lib/pq"').otherwise("")),
        ("HEADIMPORT", F.when(own, "").otherwise(F.concat(F.lit('top "tpch/p'), head, F.lit('"')))),
        ("CURRENT", F.when(own, "").otherwise("var cur top.Store")),
        ("HEADCALL", F.when(own, "").otherwise("top.Open(nil)")),
        ("GetHEAD", F.concat(F.lit("Get"), head)),
        ("KSIZE", F.concat(F.lit("K"), F.col("p_size").cast("string"))),
        ("KEY", k.cast("string")),
    ):
        text = F.replace(text, F.lit(word), value)
    return _sources_of(spark, d).select(F.concat(F.lit("/p"), k, F.lit("/a.go")).alias("path"), text.cast("binary").alias("content"))


def _go_query(name, f, sql, used=True):
    """``f(facts, use)``: sources are read and lexed once, however often their rows are asked for."""

    def run(spark, d):
        files = _go_files(spark, d)
        return _strings(f(written(golang.rows_of_files(files)), written(usage.rows_of_files(files)) if used else None).drop("snapshot_id"))

    QUERIES[name], ORACLE[name] = run, _PARTS + sql


_go_query("ext_edges", lambda facts, _: golang.snapshot(facts, "tpch", "A").edge.where("scope = 'cross'").select("src", "kind", "dst"), """e AS (SELECT k, 'import' AS kind, 'os' AS dst FROM g UNION ALL SELECT k, 'import', 'net/http' FROM g WHERE z % 2 = 0 UNION ALL SELECT k, 'capability', 'cap:net' FROM g WHERE z % 2 = 0
UNION ALL SELECT k, 'import', 'github.com/lib/pq' FROM g WHERE b = 'Brand#1' UNION ALL SELECT k, 'service', 'service:Postgres' FROM g WHERE b = 'Brand#1' UNION ALL SELECT k, 'import', 'tpch/p' || t FROM g WHERE k <> t UNION ALL SELECT k, 'call', 'tpch/p' || t FROM g WHERE k <> t
UNION ALL SELECT k, 'config', 'env:K' || z FROM g UNION ALL SELECT x.k, 'implements', 'tpch/p' || y.k FROM g x JOIN g y ON x.t = y.t AND x.k <> y.k) SELECT 'tpch/p' || k AS src, kind, dst FROM e""", used=False)
_go_query("ext_packages", lambda facts, _: golang.snapshot(facts, "tpch", "A").package.select("path", "name", "internal"), """e AS (SELECT 'os' AS dst FROM g UNION SELECT 'net/http' FROM g WHERE z % 2 = 0 UNION SELECT 'cap:net' FROM g WHERE z % 2 = 0 UNION SELECT unnest(['github.com/lib/pq', 'service:Postgres']) FROM g WHERE b = 'Brand#1' UNION SELECT 'env:K' || z FROM g)
SELECT 'tpch/p' || k AS path, 'p' || k AS name, true AS internal FROM g UNION ALL SELECT dst, split_part(dst, '/', -1), false FROM e""", used=False)
_go_query("ext_symbols", lambda facts, _: golang.snapshot(facts, "tpch", "A").symbol.select("path", "axis", "kind", "name"), """s AS (SELECT * FROM (VALUES ('surface', 'type', 'Store'), ('surface', 'type', 'Row'), ('surface', 'type', 'Mem'), ('surface', 'type', 'Engine'), ('surface', 'type', 'Tick'), ('surface', 'type', 'Tock'), ('surface', 'type', 'Done'), ('surface', 'func', 'New'), ('surface', 'func', 'Open'), ('surface', 'method', 'Mem.Get'),
('surface', 'method', 'Tick.Execute'), ('surface', 'method', 'Tock.Execute'), ('surface', 'method', 'Done.Execute'), ('schema', 'field', 'Row.Name')) v(axis, kind, name)) SELECT 'tpch/p' || k AS path, axis, kind, CASE WHEN name = 'Mem.Get' THEN name || t ELSE name END AS name FROM g, s""", used=False)
_go_query("ext_callgraph", lambda facts, use: usage.call_graph(use, facts, "tpch")[1], """c AS (SELECT k, 'Mem.Get' || t AS f, 'tpch/p' || k || '.step' AS dst FROM g UNION ALL SELECT k, 'Open', 'tpch/p' || k || '.New' FROM g UNION ALL SELECT k, 'Open', 'tpch/p' || k || '.Mem.Get' || t FROM g UNION ALL SELECT k, 'Open', 'tpch/p' || t || '.Open' FROM g WHERE k <> t
UNION ALL SELECT k, 'Tick.Execute', 'tpch/p' || k || '.Engine.post' FROM g UNION ALL SELECT k, 'Tick.Execute', 'tpch/p' || k || '.later' FROM g UNION ALL SELECT k, 'later', 'tpch/p' || k || '.Engine.post' FROM g) SELECT 'tpch/p' || k || '.' || f AS src, dst FROM c""")


def _consumed(facts, use):
    got = usage.interface_usage(use, facts, dl.implementers(golang.snapshot(facts, "tpch", "A")), "tpch")
    kinds = F.array_sort(F.transform("consumers", lambda c: F.concat_ws(" ", c["pkg"], c["kind"])))
    return got.select("fq", "methods", "implementers", kinds.alias("consumers"), "consumer_pkgs", "conformance_assertions", "consumed_cross_package", "candidate_unconsumed")


_go_query("ext_consumes", _consumed, """i AS (SELECT t, string_agg('p' || k || '.Mem', ',' ORDER BY 'p' || k || '.Mem') AS impls FROM g GROUP BY t),
c AS (SELECT k, 'p' || k AS pkg, unnest(['param', 'result']) AS kind FROM g UNION ALL SELECT t, 'p' || k, 'var' FROM g WHERE k <> t),
u AS (SELECT k, string_agg(pkg || ' ' || kind, ',' ORDER BY pkg || ' ' || kind) AS consumers, string_agg(DISTINCT pkg, ',' ORDER BY pkg) AS pkgs, bool_or(pkg <> 'p' || k) AS crossing FROM c GROUP BY k)
SELECT 'p' || k || '.Store' AS fq, 'Get' || t || '(x string)error' AS methods, impls AS implementers, consumers, pkgs AS consumer_pkgs, 1 AS conformance_assertions, crossing AS consumed_cross_package, false AS candidate_unconsumed FROM g JOIN i USING (t) JOIN u USING (k)""")


def _go_flow(facts, use):
    executes, made, _ = usage.events(use, facts, "tpch")
    return gr.eventflow(executes, usage.call_graph(use, facts, "tpch")[1], made)


_go_query("ext_events", _go_flow, "f AS (SELECT * FROM (VALUES ('Tock', 'direct'), ('Done', 'indirect')) v(x, mode)) SELECT 'tpch/p' || k || '.Tick' AS src, 'tpch/p' || k || '.' || x AS dst, mode FROM g, f")


# Sources in which types embed one another across packages: T of package k embeds T of k / 3, U embeds that and U of k / 2, so that
# the same names come from several depths, and some twice from one.
_CHAIN = """package pKEY

import (
	"flag"
	THIRDIMPORT
	HALFIMPORT
)

type T struct {
	THIRDEMBED
}

func (t *T) MKIND() {}

func (t *T) PKEY() {}

type U struct {
	THIRDVALUE
	HALFEMBED
}

func (u *U) NSIZE() {}

ABOVE

type Box struct {
	u *U
	many []*U
}

func New() (*Box, error) { return &Box{u: &U{}}, nil }

func (x *Box) Up() *U { return x.u }

func Run() {
	b, err := New()
	b.u.N0()
	b.Up().M1()
	b.many[0].N2()
	for _, y := range b.many {
		y.M3()
	}
	set := flag.NewFlagSet("all", flag.ExitOnError)
	set.Int("kSIZE", 1, "")
}
"""


def _chain_files(spark, d):
    k = F.col("p_partkey")
    third, half = F.floor(k / 3).cast("string"), F.floor(k / 2).cast("string")
    text = F.lit(_CHAIN)
    for word, value in (
        ("THIRDIMPORT", F.when(k >= 3, F.concat(F.lit('a "tpch/p'), third, F.lit('"'))).otherwise("")),
        ("HALFIMPORT", F.when(k >= 2, F.concat(F.lit('b "tpch/p'), half, F.lit('"'))).otherwise("")),
        ("THIRDEMBED", F.when(k >= 3, "*a.T").otherwise("")),
        ("THIRDVALUE", F.when(k >= 3, "a.T").otherwise("")),
        ("HALFEMBED", F.when(k >= 2, "b.U").otherwise("")),
        ("ABOVE", F.when((k >= 3) & (k % 10 == 0), F.concat(F.lit("type Above interface {\n\tP"), third, F.lit("()\n}"))).otherwise("")),
        ("MKIND", F.concat(F.lit("M"), (k % 5).cast("string"))),
        ("SIZE", (F.col("p_size") % 4).cast("string")),
        ("KEY", k.cast("string")),
    ):
        text = F.replace(text, F.lit(word), value)
    return _sources_of(spark, d).select(F.concat(F.lit("/p"), k, F.lit("/a.go")).alias("path"), text.cast("binary").alias("content"))


_MEMBERS = """WITH RECURSIVE g AS (SELECT p_partkey AS k, p_size % 4 AS z FROM part),
e AS (SELECT 'T' AS t, k, 'T' AS u, k // 3 AS o FROM g WHERE k >= 3 UNION ALL SELECT 'U', k, 'T', k // 3 FROM g WHERE k >= 3 UNION ALL SELECT 'U', k, 'U', k // 2 FROM g WHERE k >= 2),
paths AS (SELECT unnest(['T', 'U']) AS rt, k AS r, unnest(['T', 'U']) AS t, k, 0 AS depth FROM g UNION ALL SELECT p.rt, p.r, e.u, e.o, p.depth + 1 FROM paths p JOIN e ON e.t = p.t AND e.k = p.k),
reach AS (SELECT rt, r, t, k, depth, count(*) AS n FROM paths GROUP BY rt, r, t, k, depth QUALIFY depth = min(depth) OVER (PARTITION BY rt, r, t, k)),
own AS (SELECT 'T' AS t, k, unnest(['M' || k % 5, 'P' || k]) AS name FROM g UNION ALL SELECT 'U', k, 'N' || z FROM g),
met AS (SELECT rt, r, name, depth, sum(n) AS n, any_value(t) AS t, any_value(k) AS k FROM reach JOIN own USING (t, k) GROUP BY rt, r, name, depth QUALIFY depth = min(depth) OVER (PARTITION BY rt, r, name)),
members AS (SELECT rt, r, name, t, k, depth FROM met WHERE n = 1) """


def ext_members(spark, d):
    """Methods of all types through embedding, their declaring type and depth."""
    told = "fact in ('struct', 'iface', 'named', 'alias', 'embed', 'iembed', 'field', 'method', 'imethod')"
    shapes = written(expressions.of_files(_chain_files(spark, d), "tpch").where(told).withColumn("snapshot_id", F.lit("A")))
    flat, _ = types.interface_methods(shapes)
    own = types.members(shapes, flat).where("kind = 'method'").where(types.short("type").isin("T", "U"))
    return own.select("type", "name", "owner", "depth")


QUERIES["ext_members"], ORACLE["ext_members"] = ext_members, _MEMBERS + "SELECT 'tpch/p' || r || '.' || rt AS type, name, 'tpch/p' || k || '.' || t AS owner, depth FROM members"


def ext_typed_calls(spark, d):
    """Calls on fields, results, elements and embedded types."""
    files = _chain_files(spark, d)
    return usage.call_graph(written(usage.rows_of_files(files)), written(golang.rows_of_files(files)), "tpch", "A", written(expressions.of_files(files, "tpch")))[1].select("src", "dst")


_RUN = "SELECT 'tpch/p' || r || '.Run' AS src, 'tpch/p' || k || '.' || t || '.' || name AS dst FROM members WHERE rt = 'U' AND name IN ('N0', 'M1', 'N2', 'M3')"
QUERIES["ext_typed_calls"], ORACLE["ext_typed_calls"] = ext_typed_calls, _MEMBERS + _RUN + " UNION ALL SELECT 'tpch/p' || k || '.Run', 'tpch/p' || k || '.' || unnest(['New', 'Box.Up']) FROM g"


def ext_typed_edges(spark, d):
    """Witnesses of calls, flags and implemented interfaces that take types to find."""
    files = _chain_files(spark, d)
    s = golang.snapshot(written(golang.rows_of_files(files)), "tpch", "A", written(expressions.of_files(files, "tpch")))
    return s.witness.where("kind in ('call', 'implements', 'config')").select("src", "kind", "dst", "witness")


QUERIES["ext_typed_edges"] = ext_typed_edges
ORACLE["ext_typed_edges"] = _MEMBERS + """SELECT 'tpch/p' || r AS src, 'call' AS kind, 'tpch/p' || k AS dst, t || '.' || name AS witness FROM members WHERE rt = 'U' AND name IN ('N0', 'M1', 'N2', 'M3') AND r <> k
UNION ALL SELECT 'tpch/p' || r, 'implements', 'tpch/p' || w.k, rt || ' |= Above' FROM members m JOIN g w ON w.k >= 3 AND w.k % 10 = 0 AND name = 'P' || w.k // 3
UNION ALL SELECT 'tpch/p' || k, 'config', 'flag:k' || z, 'define@a.go' FROM g"""


# A graph with a long path, a large ring and hubs: orders one after the other, suppliers in a ring behind them, customers below
# their nations, and all below one box.


def _routes(spark, d):
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    orders = ranked(t("orders").select("o_orderkey"), [], [F.col("o_orderkey")], "i").select("i")
    rings = ranked(t("supplier").select("s_suppkey"), [], [F.col("s_suppkey")], "i").select("i")
    last, around = orders.agg(F.max("i").alias("n")), rings.agg(F.max("i").alias("n"))
    box = lambda c, i: F.concat(F.lit(c), i.cast("string"))
    path = orders.join(F.broadcast(last)).select(box("o", F.col("i")).alias("src"), F.when(F.col("i") == F.col("n"), "s1").otherwise(box("o", F.col("i") + 1)).alias("dst"))  # one row, one number
    ring = rings.join(F.broadcast(around)).select(box("s", F.col("i")).alias("src"), box("s", F.col("i") % F.col("n") + 1).alias("dst"))
    below = t("customer").select(box("c", F.col("c_custkey")).alias("src"), box("n", F.col("c_nationkey")).alias("dst"))
    top = t("nation").select(box("n", F.col("n_nationkey")).alias("src"), F.lit("world").alias("dst")).unionByName(spark.createDataFrame([("s1", "world")], "src string, dst string"))
    return written(path.unionByName(ring).unionByName(below).unionByName(top).withColumn("snapshot_id", F.lit("R")))


QUERIES["gr_route_blast"] = lambda spark, d: gr.blast_radius(_routes(spark, d)).select("path", "blast_radius")
ORACLE["gr_route_blast"] = """WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS n FROM orders), s AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS i, count(*) OVER () AS n FROM supplier)
SELECT 'o' || i AS path, i - 1 AS blast_radius FROM o WHERE i > 1 UNION ALL SELECT 's' || i, (SELECT count(*) FROM orders) + n - 1 FROM s
UNION ALL SELECT 'n' || c_nationkey, count(*) FROM customer GROUP BY c_nationkey UNION ALL SELECT 'world', (SELECT count(*) FROM orders) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer)"""
QUERIES["gr_route_cycles"] = lambda spark, d: gr.cycles(_routes(spark, d)).select("path", "cycle")
ORACLE["gr_route_cycles"] = "SELECT 's' || row_number() OVER (ORDER BY s_suppkey) AS path, 's1' AS cycle FROM supplier"

_COMMON = "array_to_string(string_split({a}, '/')[1:len(list_filter(range(1, least(len(string_split({a}, '/')), len(string_split({b}, '/'))) + 1), lambda i: string_split({a}, '/')[1:i] = string_split({b}, '/')[1:i]))], '/')"
_FOLD = f"list_reduce({{}}, lambda a, b: CASE WHEN a = '' THEN b ELSE {_COMMON.format(a='a', b='b')} END)"


_MENTIONED = """(SELECT list(path ORDER BY section, k0, k1, k2, nth) FROM (SELECT CASE change WHEN 'added' THEN 0 ELSE 1 END AS section, path AS k0, '' AS k1, '' AS k2, 0 AS nth, path FROM d_apkg
UNION ALL SELECT CASE change WHEN 'added' THEN 2 ELSE 3 END, src, kind, dst, x.n, x.p FROM d_edge, LATERAL (SELECT 0 AS n, src AS p UNION ALL SELECT 1, dst) x UNION ALL SELECT DISTINCT 4, path, '', '', 0, path FROM d_sym WHERE axis = 'surface'))"""


@query(f"SELECT {_FOLD.format(_MENTIONED)} AS prefix")
def dl_report_prefix(s, pairs):
    """What the report of a delta leaves out of its paths."""
    return dl.report_prefix(s, pairs)


def prj_common_prefix(spark, d):
    """The fold over many lists of paths: a customer's orders, in order, whose first segments now and then differ."""
    o, k = spark.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey")
    first = F.when(F.floor(k / 3) % 5 == 0, "y").otherwise("x")
    return dl.shared_prefix(o.select(F.col("o_custkey").alias("pair_id"), "o_orderkey", F.concat_ws("/", first, F.concat(F.lit("q"), F.floor(k / 32) % 2), (k % 4).cast("string")).alias("path")), ["o_orderkey"])


QUERIES["prj_common_prefix"] = prj_common_prefix
ORACLE["prj_common_prefix"] = f"SELECT pair_id, {_FOLD.format('ps')} AS prefix FROM (SELECT o_custkey AS pair_id, list(CASE WHEN o_orderkey // 3 % 5 = 0 THEN 'y' ELSE 'x' END || '/q' || (o_orderkey // 32 % 2) || '/' || (o_orderkey % 4) ORDER BY o_orderkey) AS ps FROM orders GROUP BY o_custkey)"


# Queries over the other tables


def _add(name, f, sql=None):
    QUERIES[name] = f
    if sql:
        ORACLE[name] = sql


def hs_report(spark, d):
    """Rows of the history's report; the first year was not extracted."""
    s = trade(spark, d, True)
    years = s.snapshot.select("snapshot_id", F.col("snapshot_id").cast("int").alias("y"))
    subject = F.when(F.col("y") % 3 == 0, "feat(x): a").when(F.col("y") % 3 == 1, "Fix: b").otherwise("merge c")
    commits = years.select("snapshot_id", F.concat("snapshot_id", F.lit("-12-31")).alias("date"), subject.alias("subject"))
    errors = years.where("y <> 1995").select("snapshot_id", (F.col("y") % 4 == 3).cast("int").alias("n_errors"))
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("y", F.year("o_orderdate"))
    text = F.concat_ws("\t", (F.col("o_orderkey") % 100).cast("string"), (F.col("o_custkey") % 10).cast("string"), F.lit("a.go"))
    text = hs.numstat(o.select(F.concat_ws("..", (F.col("y") - 1).cast("string"), F.col("y").cast("string")).alias("pair_id"), text.alias("text")))
    return hs.report(_years(s), hs.sizes(s, _years(s)), text, commits, errors).drop("subject", "go_files", "go_insertions", "go_deletions", "go_lines")


_STAT = "SELECT (year(o_orderdate) - 1) || '..' || year(o_orderdate) AS pair, sum(o_orderkey % 100)::BIGINT AS ins, sum(o_custkey % 10)::BIGINT AS dels, count(*) AS files FROM orders GROUP BY 1"
_add("hs_report", hs_report, trade_sql(True) + f""", {_YEARS} SELECT b AS sha, b || '-12-31' AS date, CASE CAST(b AS INT) % 3 WHEN 0 THEN 'feat' WHEN 1 THEN 'fix' ELSE 'other' END AS stratum, files, ins AS insertions, dels AS deletions, ins + dels AS text_lines, CAST(CAST(a AS INT) % 4 = 3 AS INT) AS err_a, CAST(CAST(b AS INT) % 4 = 3 AS INT) AS err_b, d_boxes, d_arrows, d_surface, d_boxes + d_arrows + d_surface AS d_items, d_boxes + d_arrows + d_surface = 0 AS empty
FROM hist JOIN ({_STAT}) t USING (pair) WHERE a <> '1995'""")


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


# An event is a user's type in one of six slots; what a user does next is constructed, or called, by what the user did before.
_EV = """WITH named AS (SELECT user_id, ts, event_id, event_type || ':' || user_id || ':' || (event_id % 6) AS event FROM events),
pairs AS (SELECT event AS src, lead(event) OVER w AS dst, event_id % 2 = 0 AS made FROM named WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
con AS (SELECT DISTINCT src, dst FROM pairs WHERE dst IS NOT NULL AND made), call AS (SELECT DISTINCT src, dst FROM pairs WHERE dst IS NOT NULL AND NOT made), """


def _flow(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    named = _events(spark, d).select(F.lit("E").alias("snapshot_id"), "user_id", "ts", "event_id", F.concat_ws(":", "event_type", "user_id", F.col("event_id") % 6).alias("event"))
    p = named.select("snapshot_id", F.col("event").alias("src"), F.lead("event").over(w).alias("dst"), (F.col("event_id") % 2 == 0).alias("made")).where("dst is not null")
    made = p.where("made").select("snapshot_id", F.concat(F.lit("fn:"), "src").alias("fn"), F.col("dst").alias("event")).distinct()
    calls = p.where("not made").select("snapshot_id", F.concat(F.lit("fn:"), "src").alias("src"), F.concat(F.lit("fn:"), "dst").alias("dst")).distinct()
    events = named.select("snapshot_id", "event").distinct()
    return gr.eventflow(events.withColumn("fn", F.concat(F.lit("fn:"), "event")), calls, made), events


_FLOW = _EV.replace("WITH named", "WITH RECURSIVE named", 1) + "cr AS (SELECT src, dst FROM call UNION SELECT r.src, c.dst FROM cr r JOIN call c ON r.dst = c.src), flow AS (SELECT src, dst, 'direct' AS mode FROM con UNION ALL SELECT DISTINCT r.src, c.dst, 'indirect' FROM cr r JOIN con c ON r.dst = c.src WHERE (r.src, c.dst) NOT IN (SELECT (src, dst) FROM con))"
_add("gr_eventflow", lambda spark, d: _flow(spark, d)[0].drop("snapshot_id"), _FLOW + " SELECT src, dst, mode FROM flow")
_add("gr_event_role", lambda spark, d: gr.event_roles(*_flow(spark, d)).drop("snapshot_id"), _FLOW + """, r AS (SELECT event, (SELECT count(*) FROM flow WHERE dst = event) AS in_degree, (SELECT count(*) FROM flow WHERE src = event) AS out_degree, (SELECT count(*) FROM flow WHERE dst = event AND mode = 'direct') AS n FROM (SELECT DISTINCT event FROM named))
SELECT event, in_degree, out_degree, CASE WHEN in_degree = 0 THEN 'entry' WHEN out_degree = 0 THEN 'terminal' WHEN n = 0 THEN 'indirect-only' ELSE '' END AS role FROM r""")


def jn_interval(spark, d):
    """Function spans (an order's line numbers) that overlap changed ranges (by part size) of the same file (a remainder of the key)."""
    spans = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("fn")).agg((F.min("l_linenumber") * 10).alias("lo"), (F.max("l_linenumber") * 10).alias("hi")).withColumn("file", F.col("fn") % 997)
    ranges = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") % 997).alias("file"), F.col("p_size").alias("lo"), (F.col("p_size") + 3).alias("hi"))
    return flt.touched_spans(spans, ranges).select("fn", "file", "lo", "hi")


_add("jn_interval", jn_interval, "WITH s AS (SELECT l_orderkey AS fn, min(l_linenumber) * 10 AS lo, max(l_linenumber) * 10 AS hi, l_orderkey % 997 AS file FROM lineitem GROUP BY l_orderkey) SELECT DISTINCT fn, file, s.lo, s.hi FROM s JOIN (SELECT p_partkey % 997 AS f, p_size AS lo, p_size + 3 AS hi FROM part) r ON f = file AND s.lo <= r.hi AND r.lo <= s.hi")
def jn_suffix(spark, d):
    """Changed files (by part) against the absolute names of files (by order): a bare suffix test."""
    files = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("/x/q"), "o_custkey", F.lit("/f"), F.col("o_orderkey") % 50, F.lit(".go")).alias("file")).distinct()
    k = F.col("p_partkey")
    names = spark.read.parquet(f"{d}/part.parquet").select(F.when(k % 40 == 0, F.concat((k % 10).cast("string"), F.lit(".go"))).otherwise(F.concat(k, F.lit("/f"), k % 50, F.lit(".go"))).alias("file")).distinct()
    return flt.by_suffix(files, names)


_add("jn_suffix", jn_suffix, "SELECT file, name FROM (SELECT DISTINCT '/x/q' || o_custkey || '/f' || (o_orderkey % 50) || '.go' AS file FROM orders) JOIN (SELECT DISTINCT CASE WHEN p_partkey % 40 = 0 THEN (p_partkey % 10) || '.go' ELSE p_partkey || '/f' || (p_partkey % 50) || '.go' END AS name FROM part) ON suffix(file, name)")
_add("win_last_wins", lambda spark, d: flt.last_wins(spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey"), "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")


def prj_stratum(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.get(F.array(*[F.lit(x) for x in P.STRATA]), (F.col("o_orderkey") % 10).cast("int")), F.lit("(x): y")).alias("subject"), (F.col("o_custkey") % 2 == 0).alias("empty"))
    return hs.strata(o).withColumn("empty_share", F.round("empty_share", 6))


_add("agg_strata", prj_stratum, "SELECT ['feat','fix','refactor','test','hardening','perf','docs','chore','build','other'][o_orderkey % 10 + 1] AS stratum, count(*) AS n, round(avg((o_custkey % 2 = 0)::INT), 6) AS empty_share FROM orders GROUP BY 1")
def ev_outcomes(spark, d):
    """Recorded outcomes by test name: the last event of a name counts."""
    ev = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "fail").otherwise("pass").alias("Action"), (F.col("user_id") % 50).cast("string").alias("Test"))
    tests = spark.range(60).select(F.lit("A").alias("snapshot_id"), F.lit("p").alias("path"), F.col("id").cast("string").alias("name"), F.lit("i").alias("iface"))
    return cf.outcomes(Snapshots.of(spark, guard=tests), ev).drop("snapshot_id")


_add("ev_outcomes", ev_outcomes, "WITH e AS (SELECT CAST(user_id % 50 AS VARCHAR) AS test, arg_max(CASE event_type WHEN 'purchase' THEN 'fail' ELSE 'pass' END, event_id) AS outcome FROM events GROUP BY 1) SELECT CAST(t AS VARCHAR) AS test, coalesce(outcome, 'not run') AS outcome FROM range(60) r(t) LEFT JOIN e ON e.test = CAST(t AS VARCHAR)")


def agg_numstat(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    path = F.get(F.array(*[F.lit(x) for x in ("a.go", "a_test.go", "b.png", "c.md")]), (F.col("o_orderkey") % 4).cast("int"))
    n = F.when(F.col("o_orderkey") % 4 == 2, "-").otherwise((F.col("o_orderkey") % 100).cast("string"))
    return hs.numstat(o.select(F.year("o_orderdate").cast("string").alias("pair_id"), F.concat_ws("\t", n, (F.col("o_custkey") % 10).cast("string"), path).alias("text")))


_add("agg_numstat", agg_numstat, "SELECT CAST(year(o_orderdate) AS VARCHAR) AS pair_id, count(*) AS files, sum(i)::BIGINT AS insertions, sum(x)::BIGINT AS deletions, count(*) FILTER (k = 0) AS go_files, sum(CASE WHEN k = 0 THEN i ELSE 0 END)::BIGINT AS go_insertions, sum(CASE WHEN k = 0 THEN x ELSE 0 END)::BIGINT AS go_deletions FROM (SELECT o_orderdate, o_orderkey % 4 AS k, CASE WHEN o_orderkey % 4 = 2 THEN 0 ELSE o_orderkey % 100 END AS i, o_custkey % 10 AS x FROM orders) GROUP BY 1")


def win_diff_file(spark, d):
    """Hunks of saved diffs, with the file that each line stands under."""
    o = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") % 20).cast("string").alias("diff_id"), F.col("o_orderkey").alias("line_no"), F.col("o_custkey").alias("c"))
    c = F.col("c").cast("string")
    text = F.when(F.col("c") % 3 == 0, F.concat(F.lit("+++ b/f"), c, F.lit(".go"))).otherwise(F.concat(F.lit("@@ -1 +"), c, F.lit(","), (F.col("c") % 7).cast("string"), F.lit(" @@")))
    return flt.changed_files(o.select("diff_id", "line_no", text.alias("text")))


_add("win_diff_file", win_diff_file, "SELECT diff_id, file, c::INT AS lo, (c + greatest(c % 7, 1) - 1)::INT AS hi FROM (SELECT CAST(o_orderkey % 20 AS VARCHAR) AS diff_id, o_custkey AS c, last_value(CASE WHEN o_custkey % 3 = 0 THEN 'f' || o_custkey || '.go' END IGNORE NULLS) OVER (PARTITION BY o_orderkey % 20 ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS file FROM orders) WHERE c % 3 <> 0")
