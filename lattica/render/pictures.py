"""Mermaid, DOT, Markdown and text of operator results.  Rows are ordered by Spark and formatted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import delta as dl
from ..operators import filters as flt
from ..operators import metrics as me
from ..schema import Snapshots

#: Mermaid arrows and DOT attributes by edge kind (fixed values).
ARROWS = {"implements": "-. implements .->", "call": "-->", "import": "-.->", "config": "-. config .->"}
DOT_EDGE = {"implements": 'style=dashed, arrowhead=onormal, color="#8a5cf6", label="implements"', "call": 'color="#333333"', "import": 'color="#bbbbbb"', "config": 'style=dotted, arrowhead=vee, color="#c9820a", label="config"'}
CHANGE_COLOUR = {"added": "#1a7f37", "removed": "#cf222e", "boundary": "#1a7f37", "minor": "#0969da", "": "#8c959f", "REMOVED": "#cf222e", "WEAKENED": "#cf222e", "CHURNED": "#c9820a", "STRENGTHENED": "#0969da", "ADDED": "#1a7f37"}

#: Texts of the reports (fixed values).
SAYS = {
    "acyclic": "  cycles: none — internal dependency graph is an acyclic DAG (healthy)",
    "cycles": "  cycles: {} dependency cycle(s) found:",
    "gods": "  god-modules (high fan-in + large surface): {}",
    "coupling": "  coupling (top by blast radius):",
    "health": "ARCHITECTURE HEALTH",
    "blast": "BLAST RADIUS of {}",
    "dependents": "  {} direct dependent(s), {} total (transitive)",
    "alone": "  → nothing depends on it; safe to change in isolation.",
    "reflexion": "REFLEXION MODEL — declared layering vs actual code",
    "layers": "  layers (top→bottom): {}",
    "convergent": "  convergent (downward) deps: {}",
    "divergent": "  DIVERGENT (upward, layering violations): {}{}",
    "share": "  ({}% of cross-layer deps)",
    "upward": "    ! {} depends on higher layer {}  ×{} edge(s)",
    "unmapped": "  unmapped components (no layer assigned): {}",
    "conforms": "  → code conforms to the declared layering.",
    "evidence": "CONTRACT EVIDENCE — {}",
    "no contracts": "  (no interface contracts with implementers found)",
    "covered": "  implementer {} — covered by a contract test",
    "no test": "NOT covered (evidence gap: no contract test binds this interface)",
    "others": "NOT covered (evidence gap: the contract test names other implementers, not this one)",
    "factory": "unconfirmed (a contract test exists but drives implementers via a factory, so this one cannot be attributed)",
    "no evidence": "  evidence: no contract test binds this interface",
    "fast": "verdict: FAST-TRACK — empty boundary delta; no architecture review required.",
    "review": "verdict: NEEDS ARCHITECTURE REVIEW — a boundary moved.",
    "promise": "  ⚠ a guarding test changed — promise on {} touched; confirm it's intended.",
    "breaches": "{} allow-list breach(es)",
    "gaps": "{} new implementer(s) with no contract test",
    "consumption": "# Interface consumption (usage altitude)",
    "interfaces": "{} interface(s), {} candidate unconsumed (<=1 implementer, 0 consumers)",
    "candidate": "   [CANDIDATE: unconsumed abstraction]",
    "conformance": "    ({} conformance assertion(s), not counted as consumers)",
}


def quoted(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def mermaid_text(s: str) -> str:
    return s.replace('"', "'")


def _rows(df: DataFrame, *order):
    return df.orderBy(*order).collect()


def graph(s: Snapshots, form: str = "mermaid", external: bool = False) -> str:
    """One snapshot.  Service, capability and protocol arrows are not drawn."""
    nodes = flt.drawn_nodes(s, external).distinct()
    labels = {r.path: r.label for r in flt.short_labels(Snapshots(**{**vars(s), "package": nodes.join(s.package.drop("internal"), ["snapshot_id", "path"])})).collect()}
    edges = flt.collapse_imports(s.edge.where("scope = 'cross'").select("snapshot_id", "src", "kind", "dst").distinct())
    rows = [r for r in _rows(edges, "src", "kind", "dst") if r.src in labels and r.dst in labels and r.kind in ARROWS]
    inner = {r.path: r.internal for r in nodes.collect()}
    if form == "mermaid":
        ids = {p: f"n{i}" for i, p in enumerate(sorted(labels))}
        return "\n".join(["graph LR", *[f"  {ids[p]}[{quoted(labels[p])}]" for p in sorted(labels)], *[f"  {ids[r.src]} {ARROWS[r.kind]} {ids[r.dst]}" for r in rows]]) + "\n"
    look = lambda p: ' [shape=note, fillcolor="#fdf0d5", color="#c9820a"]' if p.startswith(("env:", "flag:")) else "" if inner[p] else ' [fillcolor="#f3f3f3", color="#999999", style="rounded,filled,dashed"]'
    head = ["digraph packages {", "  rankdir=LR;", '  node [shape=box, style="rounded,filled", fontname="Helvetica", fillcolor="#eef3fb", color="#4a6fa5"];', '  edge [fontname="Helvetica", fontsize=10];']
    return "\n".join([*head, *[f"  {quoted(labels[p])}{look(p)};" for p in sorted(labels)], *[f"  {quoted(labels[r.src])} -> {quoted(labels[r.dst])} [{DOT_EDGE[r.kind]}];" for r in rows], "}"]) + "\n"


def coloured(nodes: list[tuple[str, str]], arrows: list[tuple[str, str, str, str]], form: str = "mermaid") -> str:
    """nodes (name, change), arrows (from, to, label, change): a picture of a change."""
    names = sorted(dict(nodes))
    ids, change = {p: f"n{i}" for i, p in enumerate(names)}, dict(nodes)
    arrows = [a for a in arrows if a[0] in ids and a[1] in ids]
    if form == "dot":
        return "\n".join(["digraph change {", "  rankdir=LR;", *[f"  {quoted(n)} [color={quoted(CHANGE_COLOUR[change[n]])}];" for n in names], *[f"  {quoted(a)} -> {quoted(b)} [label={quoted(t)}, color={quoted(CHANGE_COLOUR[c])}];" for a, b, t, c in arrows], "}"]) + "\n"
    out = ["graph LR", *[f"  {ids[n]}[\"{mermaid_text(n)}\"]" for n in names], *[f"  {ids[a]} {'-.->' if c == 'removed' else '-->'}|{mermaid_text(t)}| {ids[b]}" for a, b, t, c in arrows]]
    out += [f"  style {ids[n]} stroke:{CHANGE_COLOUR[change[n]]}" for n in names if change[n]]
    out += [f"  linkStyle {i} stroke:{CHANGE_COLOUR[c]}" for i, (_, _, _, c) in enumerate(arrows) if c]
    return "\n".join(out) + "\n"


def change(s: Snapshots, pairs: DataFrame, form: str = "mermaid", full: bool = False) -> str:
    """The united graph of one pair; only what changed and its ends, unless full."""
    kind = F.when(~F.col("in_a"), "added").when(~F.col("in_b"), "removed").otherwise("")
    nodes = dl.both(flt.drawn_nodes(s).select("snapshot_id", "path"), pairs, ["path"]).select("pair_id", "path", kind.alias("change"))
    arrows = dl.both(s.edge.where("scope = 'cross'").select("snapshot_id", "src", "kind", "dst"), pairs, ["src", "kind", "dst"]).select("pair_id", "src", "kind", "dst", kind.alias("change"))
    if not full:
        nodes, arrows = flt.focus(nodes, arrows)
    return coloured([(r.path, r.change) for r in nodes.collect()], [(r.src, r.dst, r.kind, r.change) for r in _rows(arrows, "src", "dst", "kind")], form)


def components(painted: DataFrame, edges: DataFrame, form: str = "mermaid") -> str:
    return coloured([(r.comp, r.change) for r in painted.collect()], [(r.src, r.dst, r.kinds, r.change) for r in _rows(edges, "src", "change", "dst")], form)


def witness_table(rows: DataFrame, n: int = 4) -> str:
    """Markdown: one line for each arrow whose witnesses moved, four witnesses a cell at most."""
    rank = F.create_map(*[F.lit(x) for kv in dl.STATUS_RANK.items() for x in kv])
    cell = lambda xs: ", ".join(xs[:n]).replace("|", "\\|") + (f", …(+{len(xs) - n} more)" if len(xs) > n else "")
    body = [f"| {r.status} | {r.src} → {r.dst} | {r.kind} | {cell(r.removed)} | {cell(r.added)} | {cell(r.remaining)} |" for r in _rows(rows.withColumn("_r", F.element_at(rank, F.col("status"))), "_r", "src", "dst", "kind")]
    return "\n".join(["| status | arrow | kind | removed | added | remaining |", "|---|---|---|---|---|---|", *body]) + "\n"


def witness_picture(rows: DataFrame, form: str = "mermaid") -> str:
    got = _rows(rows, "src", "dst", "kind")
    return coloured([(x, "") for r in got for x in (r.src, r.dst)], [(r.src, r.dst, f"{r.kind} {r.status}", r.status) for r in got], form)


def contract_table(rows: DataFrame) -> str:
    body = [f"| {r.iface} | {', '.join(r.added)} | {', '.join(r.removed)} | {', '.join(r.covered)} | {', '.join(r.uncovered)} | {', '.join(r.tests)} |" for r in _rows(rows, "iface")]
    return "\n".join(["| contract | implementers + | implementers − | covered | uncovered | tests |", "|---|---|---|---|---|---|", *body]) + "\n"


def contract_picture(rows: DataFrame, form: str = "mermaid") -> str:
    got = _rows(rows, "iface")
    nodes = [(r.iface, "") for r in got] + [(x, "added") for r in got for x in r.added] + [(x, "removed") for r in got for x in r.removed]
    return coloured(nodes, [(x, r.iface, "implements", c) for r in got for c, xs in (("added", r.added), ("removed", r.removed)) for x in xs], form)


#: Classes of a plan's picture (fixed values).
PLAN_CLASSES = {"hole": "fill:#ffeccc,stroke:#b45309,stroke-width:3px,stroke-dasharray:6 3,color:#3b2200", "box": "fill:#dbe7f8,stroke:#3b5f8f,color:#0d1b2e"}


def plan(document: dict) -> str:
    """A plan as Mermaid: holes are stadiums; arrows to what is no box of the plan are not drawn."""
    own = document["packages"]
    ids, kind = {p["path"]: f"n{i}" for i, p in enumerate(own)}, {p["path"]: "hole" if p.get("hole") else "box" for p in own}
    label = lambda p: p["path"].rsplit("/", 1)[-1]
    boxes = [f'  {ids[p["path"]]}' + (f'(["{label(p)}"])' if p.get("hole") else f'["{label(p)}"]') for p in own]
    arrows = [f"  {ids[e['from']]} --> {ids[e['to']]}" for e in document["edges"] if e["from"] in ids and e["to"] in ids]
    classes = [x for c, look in PLAN_CLASSES.items() if c in kind.values() for x in (f"  classDef {c} {look}", f"  class {','.join(i for p, i in ids.items() if kind[p] == c)} {c}")]
    return "\n".join(["graph LR", *boxes, "", *arrows, "", *classes]) + "\n"


def _last(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def health(report: DataFrame, top: int = 12) -> str:
    """Cycles, god modules in order of their paths, and the ``top`` packages by blast radius."""
    cycles: dict[str, list[str]] = {}
    for r in _rows(report.where("cycle is not null").select("path", "cycle"), "path"):
        cycles.setdefault(r.cycle, []).append(_last(r.path))
    out = [SAYS["health"], SAYS["cycles"].format(len(cycles)) if cycles else SAYS["acyclic"]]
    out += [f"    ! {' <-> '.join(cycles[c])}" for c in sorted(cycles)]
    if gods := [_last(r.path) for r in _rows(report.where("god").select("path"), "path")]:
        out.append(SAYS["gods"].format(", ".join(gods)))
    out += [SAYS["coupling"], "    " + " ".join((f"{'package':<28}", f"{'fanIn':>6}", f"{'fanOut':>7}", f"{'surf':>6}", f"{'instab':>8}", f"{'blast':>6}"))]
    for r in me.health_order(report).limit(top).collect():
        out.append(f"    {_last(r.path):<28} {r.fan_in:6} {r.fan_out:7} {r.surface:6} {r.instability:8.2f} {r.blast_radius:6}{'  <god>' if r.god else ''}")
    return "\n".join(out) + "\n"


def impact(target: str, dependents: DataFrame) -> str:
    """dependents(path, direct) of one target: direct ones first, then the others, each in order."""
    rows = _rows(dependents, "path")
    direct, further = [r for r in rows if r.direct], [r for r in rows if not r.direct]
    out = [SAYS["blast"].format(target), SAYS["dependents"].format(len(direct), len(rows))]
    out += [f"  direct:   {_last(r.path)}" for r in direct] + [f"  indirect: {_last(r.path)}" for r in further]
    return "\n".join(out + ([] if rows else [SAYS["alone"]])) + "\n"


def reflexion(layers: list[str], counts: DataFrame, report: DataFrame, unmapped: DataFrame) -> str:
    """layer_counts, upward rows and unmapped segments of one snapshot."""
    n = {r.direction: r.n for r in counts.groupBy("direction").agg(F.sum("count").alias("n")).collect()}
    down, up = n.get("down", 0), n.get("up", 0)
    share = SAYS["share"].format(up * 100 // (up + down)) if up + down else ""
    out = [SAYS["reflexion"], SAYS["layers"].format(" → ".join(layers)), SAYS["convergent"].format(down), SAYS["divergent"].format(up, share)]
    out += [SAYS["upward"].format(r["from"], r["to"], r["count"]) for r in report.orderBy(F.desc("count"), "from", "to").collect()]
    loose = [r.seg for r in _rows(unmapped.select("seg").distinct(), "seg")]
    out += [SAYS["unmapped"].format(", ".join(loose))] if loose else []
    return "\n".join(out + ([] if up else [SAYS["conforms"]])) + "\n"


def evidence(where: str, coverage: DataFrame, outcomes: dict[str, str] | None = None) -> str:
    """coverage of one snapshot, with recorded outcomes of tests by name (pass or fail)."""
    rows = _rows(coverage, "iface")
    out = [SAYS["evidence"].format(where)] + ([] if rows else [SAYS["no contracts"]])
    for r in rows:
        out += ["", f"Contract: {_last(r.iface)}", *[SAYS["covered"].format(_last(x)) for x in r.covered]]
        why = SAYS["no test" if not r.tests else "others" if r.names_concretes else "factory"]
        out += [f"  implementer {_last(x)} — {why}" for x in r.uncovered]
        said = {"pass": "PASS", "fail": "FAIL"}
        out += [f"  evidence: {t} — CI: {said.get((outcomes or {}).get(t, ''), 'not run')}" for t in r.tests] or [SAYS["no evidence"]]
    return "\n".join(out) + "\n"


def triage(s: Snapshots, pairs: DataFrame, off_list: DataFrame | None = None) -> str:
    """What a reviewer of one pair should look at first."""
    v = dl.triage_summary(s, pairs, off_list).first()
    if v.verdict == "FAST-TRACK":
        return SAYS["fast"] + "\n" + (SAYS["promise"].format(v.touched) + "\n" if v.touched else "")
    out, items = [SAYS["review"]], {}
    for r in _rows(dl.triage(s, pairs), "label", "item"):
        items.setdefault(r.label, []).append(r.item)
    say = lambda label, what: out.append(f"  {label + ':':<14} {what}")
    for label in dl.TRIAGE[:-1]:
        own = items.get(label, [])
        if own:
            say(label, ", ".join(own[:8] + [f"…(+{len(own) - 8} more)"] * (len(own) > 8)) if label.endswith("+") else ", ".join(own))
    if v.breaches:
        say("violations", SAYS["breaches"].format(v.breaches))
    if v.gaps:
        say("evidence gaps", SAYS["gaps"].format(v.gaps))
    if v.touched:
        say("invariant", f"promise on {v.touched} changed")
    return "\n".join(out) + "\n"


def call_picture(functions: DataFrame, calls: DataFrame, seeds: DataFrame | None = None) -> str:
    """Functions as DOT clusters of their packages; seeds(path) stand out."""
    marked = {r.path for r in seeds.collect()} if seeds is not None else set()
    groups: dict[str, list[str]] = {}
    own = {r.path for r in functions.select("path").distinct().collect()}
    for p in sorted(own):
        folder, name = p.rsplit("/", 1) if "/" in p else ("", p)
        groups.setdefault(f"{folder}/{name.split('.')[0]}".lstrip("/"), []).append(p)
    out = ["digraph calls {", "  rankdir=LR;", '  node [shape=box, style="rounded,filled", fontname="Helvetica", fillcolor="#eef3fb", color="#4a6fa5"];']
    for i, (pkg, members) in enumerate(sorted(groups.items())):
        out += [f"  subgraph cluster_{i} {{", f"    label={quoted(_last(pkg))};", *[f"    {quoted(_last(p))}{' [fillcolor=' + quoted('#fdf0d5') + ']' if p in marked else ''};" for p in members], "  }"]
    return "\n".join([*out, *[f"  {quoted(_last(r.src))} -> {quoted(_last(r.dst))};" for r in _rows(calls, "src", "dst")], "}"]) + "\n"


def event_picture(flow: DataFrame, roles: DataFrame) -> str:
    """Events as DOT: indirect construction is dashed; what begins and what ends a flow stands out."""
    look = {"entry": "#dafbe1", "terminal": "#ffebe9", "indirect-only": "#fdf0d5", "": "#eef3fb"}
    nodes = [f"  {quoted(_last(r.event))} [style=filled, fillcolor={quoted(look[r.role])}];" for r in _rows(roles, "event")]
    arrows = [f"  {quoted(_last(r.src))} -> {quoted(_last(r.dst))}{' [style=dashed]' if r.mode == 'indirect' else ''};" for r in _rows(flow, "src", "dst")]
    return "\n".join(["digraph events {", "  rankdir=LR;", *nodes, *arrows, "}"]) + "\n"


def consumption(module: str, usage: DataFrame) -> str:
    """Interfaces, who implements and who consumes them."""
    rows = _rows(usage, "fq")
    n = sum(r.candidate_unconsumed for r in rows)
    out = [SAYS["consumption"], f"module: {module}", SAYS["interfaces"].format(len(rows), n), ""]
    listed = lambda xs: f"[{' '.join(xs)}]"
    for r in rows:
        out += [r.fq + (SAYS["candidate"] if r.candidate_unconsumed else ""), f"  implementers: {len(r.implementers)} {listed(r.implementers)}"]
        out.append(f"  consumers:    {len(r.consumers)}{'  in ' + listed(r.consumer_pkgs) if r.consumer_pkgs else ''}{'  (cross-package)' if r.consumed_cross_package else ''}")
        out += [f"    - {c.kind:<11} {c.pkg}  ({c.pos})" for c in r.consumers]
        out += [SAYS["conformance"].format(r.conformance_assertions)] if r.conformance_assertions else []
        out.append("")
    return "\n".join(out) + "\n"


#: Order of a surface's symbols by kind.
SYMBOL_RANK = {"type": 0, "func": 1, "method": 2, "const": 3, "var": 4}


def symbol_order(kind):
    """Types, functions, methods, constants, variables, then the rest."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SYMBOL_RANK.items() for x in kv]), kind), F.lit(len(SYMBOL_RANK)))


def surface_changes(s: Snapshots, pairs: DataFrame, form: str = "text") -> str:
    """Surface symbols gained and lost by package, kinds in their order; ``text`` or Markdown."""
    rows = dl.symbols(s, pairs, "surface").withColumn("_k", symbol_order(F.col("kind")))
    got: dict[str, list] = {}
    for r in _rows(rows, "path", "_k", "name", "change"):
        got.setdefault(r.path, []).append(r)
    sign = {"added": "+", "removed": "-"}
    if form == "markdown":
        return "\n".join(["| package | + | − |", "|---|---|---|", *[f"| {p} | {', '.join(r.name for r in rs if r.change == 'added')} | {', '.join(r.name for r in rs if r.change == 'removed')} |" for p, rs in got.items()]]) + "\n"
    return "\n".join(x for p, rs in got.items() for x in (p, *[f"  {sign[r.change]} {r.kind} {r.name}" for r in rs])) + "\n"


def contracts_view(facts: DataFrame, select: str = "", every: bool = False) -> str:
    """Interfaces as text: those whose name holds ``select``, all of them, or by default the interesting ones; in order."""
    from ..operators import conform as cf

    rows = cf.select_contracts(facts, select, every)
    return "\n".join(x for r in _rows(rows, "iface") for x in (f"{r.iface}{'  ' + r.smell if r.smell else ''}", f"  implementers: {', '.join(r.implementers) or 'none'}", f"  consumers: {', '.join(r.consumer_pkgs) or 'none'}")) + "\n"


def distance(row, unmet: list) -> str:
    out = [f"dist(P,G) = {row.total}", f"  unfilled holes (C1): {row.c1}", f"  absent boxes   (C2): {row.c2}", f"  absent arrows  (C3): {row.c3}", f"  disallowed     (C4): {row.c4}"]
    return "\n".join([*out, *([""] if unmet else []), *[f"  [{u['class']}] {u['detail']}" for u in unmet]]) + "\n"


# The sentences of the delta report.
DELTA_SAYS = {
    "empty": "ARCHITECTURAL DELTA: empty at package altitude\n  -> internal change; no package boundary moved; no architecture review required.",
    "moved": "ARCHITECTURAL DELTA: boundary changed — review required",
    "schema": "SCHEMA CHANGED — a serialized data contract (wire/DB payload) changed shape",
    "touched": "INVARIANTS TOUCHED — review required (a system promise changed)",
    "guards": "INVARIANTS: new guards added (additive)",
    "violations": "CONTRACT VIOLATIONS — review required (a box depends on something it is not allowed to)",
    "contracts": "CONTRACT COVERAGE — every implementer of a changed contract must be covered by that contract's test",
    "covered": "  + {impl} now implements {iface} — covered by {tests} ✓",
    "gap": "  ! {impl} now implements {iface} — NOT covered by {tests} (evidence gap)",
    "unconfirmed": "  ? {impl} now implements {iface} — {tests} exercises this contract via a factory, so coverage of this implementer is unconfirmed",
    "no-test": "  ! {impl} now implements {iface} — no contract test guards this interface (evidence gap)",
    "gone": "  - {impl} no longer implements {iface}",
    "standing": "    (also uncovered on {iface}: {impls})",
    "removed": "  - invariant {test} (guard removed)",
    "modified": "  ~ invariant {test} (guard changed)",
    "added": "  + invariant {test} (new guard)",
    "promise": "    → promise on {ifaces} changed",
}


def _short(ref: str) -> str:
    return ref.rsplit("/", 1)[-1]


def _shorts(refs) -> str:
    return ", ".join(map(_short, refs))


def _signed(s: Snapshots, pairs: DataFrame, axis: str) -> list:
    """Changed symbols with their signatures, as of the side that has them."""
    moved = dl.symbols(s, pairs, axis)
    own = s.symbol.where(F.col("axis") == axis)
    sigs = [dl.of(own, pairs, end).groupBy("pair_id", "path", "kind", "name").agg(F.max_by(F.struct("sig"), "pos").alias("x")).withColumn("change", F.lit(change)) for end, change in (("b", "added"), ("a", "removed"))]
    with_sig = moved.join(sigs[0].unionByName(sigs[1]), ["pair_id", "path", "kind", "name", "change"], "left").select("path", "change", "kind", "name", F.coalesce("x.sig", F.lit("")).alias("sig"))
    return _rows(with_sig, "path", "change", "kind", "name")


def delta_text(s: Snapshots, pairs: DataFrame, off_list: DataFrame | None = None) -> str:
    """The report of one pair: boxes, arrows and surface in paths without what they have in common, then schema, tests,
    breaches of off_list(pair_id, src, kind, dst, introduced) and coverage of contracts."""
    empty, prefix = dl.verdict(s, pairs).first().empty, dl.report_prefix(s, pairs).first().prefix
    cut = lambda p: p[len(prefix) + 1 :] if prefix and p.startswith(f"{prefix}/") else p
    out = [DELTA_SAYS["empty" if empty else "moved"]]
    sign = {"added": "+", "removed": "-"}
    if not empty:
        tagged = dl.packages(s, pairs).select("change", "path", F.when(F.col("internal"), "").otherwise(P.node_tag(F.col("path"), F.col("internal"))).alias("tag"))
        out += [f"  {sign[r.change]} box   {cut(r.path)}{f' ({r.tag})' if r.tag else ''}" for r in _rows(tagged, "change", "path")]
        seen = dl.of(s.witness.where("scope = 'cross'"), pairs, "b").groupBy("pair_id", "src", "kind", "dst").agg(F.count_distinct("witness").alias("n"))
        arrows = dl.edges(s, pairs).join(seen, ["pair_id", "src", "kind", "dst"], "left").fillna(0, ["n"])
        out += [f"  {sign[r.change]} arrow {cut(r.src)} -> {cut(r.dst)} [{r.kind}]" + (f" ({r.n} witness file(s))" if r.change == "added" else "") for r in _rows(arrows, "change", "src", "kind", "dst")]
        out += [f"  {sign[r.change]} surface {cut(r.path)}.{r.name} ({r.kind})" for r in _rows(dl.symbols(s, pairs, "surface"), "path", "change", "kind", "name")]
    if schema := _signed(s, pairs, "schema"):
        out += [DELTA_SAYS["schema"], *[f"  {sign[r.change]} field {_short(r.path)}.{r.name} {r.sig}" for r in schema]]
    tests = _rows(dl.invariants(s, pairs), "path", "name")
    if tests:
        out.append(DELTA_SAYS["touched" if any(r.change != "added" for r in tests) else "guards"])
        promised = {}
        for r in _rows(dl.touched_promises(s, pairs), "path", "iface"):
            promised.setdefault(r.path, []).append(r.iface)
        for path in dict.fromkeys(r.path for r in tests):
            out += [DELTA_SAYS[c].format(test=f"{_short(path)}.{r.name}") for c in ("removed", "modified", "added") for r in tests if r.path == path and r.change == c]
            if path in promised:
                out.append(DELTA_SAYS["promise"].format(ifaces=_shorts(promised[path])))
    if off_list is not None and (off := _rows(off_list, "src", "kind", "dst")):
        out += [DELTA_SAYS["violations"], *[f"  ! {cut(r.src)} -> {cut(r.dst)} [{r.kind}] not in allow-list{' (introduced by this change)' if r.introduced else ''}" for r in off]]
    if contracts := _rows(dl.contracts(s, pairs), "iface"):
        out.append(DELTA_SAYS["contracts"])
        for r in contracts:
            for impl in r.added:
                kind = "covered" if impl in r.covered else "no-test" if not r.tests else "gap" if r.names_concretes else "unconfirmed"
                out.append(DELTA_SAYS[kind].format(impl=_short(impl), iface=_short(r.iface), tests=_shorts(r.tests)))
            out += [DELTA_SAYS["gone"].format(impl=_short(x), iface=_short(r.iface)) for x in r.removed]
            if standing := [x for x in r.uncovered if x not in r.added]:
                out.append(DELTA_SAYS["standing"].format(iface=_short(r.iface), impls=_shorts(standing)))
    return "\n".join(out) + "\n"


def review(s: Snapshots, pairs: DataFrame, depth: int = 2, off_list: DataFrame | None = None, widenings: DataFrame | None = None) -> str:
    """The review document of one pair."""
    from ..operators import components as cp

    v, n = dl.verdict(s, pairs).first(), dl.counts(s, pairs, off_list, widenings).first().asDict()
    parts = [f"# {v.verdict}", "", "| axis | count |", "|---|---|", *[f"| {k} | {x} |" for k, x in n.items() if k != "pair_id"], "", "## Components", "", "```mermaid", components(cp.painted(s, pairs, depth), cp.edge_changes(s, pairs, depth)).rstrip(), "```"]
    return "\n".join([*parts, "", "## Witnesses", "", witness_table(dl.witnesses(s, pairs)), "## Contracts", "", contract_table(dl.contracts(s, pairs))])
