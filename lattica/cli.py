"""``python -m lattica.cli COMMAND ...``: graph documents or Go modules in, reports out."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import conform as cf
from .operators import delta as dl
from .operators import filters as flt
from .operators import graph as gr
from .operators import history as hs
from .operators import metrics as me
from .plans import distance as pd
from .plans import dsl
from .render import pictures
from .schema import Snapshots
from .shared import clean, shared_dir
from .sources import documents, git, golang, usage


def load(spark: SparkSession, at: str, name: str) -> Snapshots:
    """A document (.json) or the sources under a folder, as one snapshot."""
    if at.endswith(".json"):
        with open(at, encoding="utf-8") as f:
            return documents.normalise(documents.from_dicts(spark, {name: json.load(f)}))
    return golang.extract(spark, at, name)


def united(a: Snapshots, b: Snapshots) -> Snapshots:
    return Snapshots(**{k: getattr(a, k).unionByName(getattr(b, k), allowMissingColumns=True) for k in vars(a)})


def relabelled(s: Snapshots, name: str) -> Snapshots:
    """One snapshot under another name."""
    return Snapshots(**{k: t.withColumn("snapshot_id", F.lit(name)) for k, t in vars(s).items()})


def rows(df) -> str:
    return json.dumps([r.asDict(recursive=True) for r in df.collect()], indent=2)


def main(argv: list[str] | None = None) -> int:
    try:
        return command(argv)
    finally:
        if (spark := SparkSession.getActiveSession()) is not None:
            clean(spark)


def command(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lattica")
    sub = p.add_subparsers(dest="command", required=True)
    for name, places in {"extract": 1, "render": 1, "contract": 1, "health": 1, "evidence": 1, "delta": 2, "pr-review": 2, "impact": 2, "reflexion": 2, "plan-compile": 1, "plan-stats": 1, "plan-render": 1, "plan-slice": 2, "plan-dist": 2, "consumes": 1, "callgraph": 1, "eventflow": 1, "surface": 2, "contracts": 1, "history": 1}.items():
        c = sub.add_parser(name)
        c.add_argument("at", nargs=places)
        c.add_argument("--json", action="store_true")
        c.add_argument("--format", default="mermaid", choices=["mermaid", "dot"])
        c.add_argument("--external", action="store_true")
        c.add_argument("--allow")
        c.add_argument("--plan")
        c.add_argument("--fixed")
        c.add_argument("--summary", action="store_true")
        c.add_argument("--select", default="")
        c.add_argument("--commit")
        c.add_argument("--store")
        c.add_argument("-n", type=int, default=80)
        c.add_argument("--all", action="store_true")
        c.add_argument("--events")
        c.add_argument("--out")
        c.add_argument("--depth", type=int, default=2)
    a = p.parse_args(argv)
    cmd, at = a.command, a.at
    if cmd.startswith("plan-"):
        with open(at[0], encoding="utf-8") as f:
            text = f.read()
        got = dsl.compile_plan(text) if not at[0].endswith(".json") else None
        if got is not None and got.problems:
            print("\n".join(f"{at[0]}:{n}: {what}" for n, what in got.problems), file=sys.stderr)
            return 1
        doc = json.loads(text) if got is None else got.document()
        if not doc.get("packages") and not doc.get("edges"):
            print(f"{at[0]}: no packages and no edges; not a plan", file=sys.stderr)
            return 1
        if cmd != "plan-dist":
            print({"plan-compile": lambda: json.dumps(doc, indent=2), "plan-stats": lambda: dsl.stats(doc), "plan-render": lambda: pictures.plan(doc), "plan-slice": lambda: dsl.slice_of(doc, at[1])}[cmd](), end="\n" if cmd in ("plan-compile", "plan-stats") else "")
            return 0
    spark = SparkSession.builder.appName("lattica").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if cmd == "plan-dist":
        plan, s = documents.normalise(documents.from_dicts(spark, {"plan": doc})), load(spark, at[1], "actual")
        print(pictures.distance(pd.distance(plan, s).first(), pd.unmet_order(pd.unmet(plan, s)).collect()), end="")
    elif cmd in ("delta", "pr-review"):
        s, pairs = united(load(spark, at[0], "A"), load(spark, at[1], "B")), dl.pair(spark)
        off = dl.violations(s, pairs, *documents.allow_list(spark, a.allow)) if a.allow else None
        wider = cf.surface_widenings(s, pairs, *documents.surface_policy(spark, a.fixed)) if a.fixed else None
        text = pictures.triage(s, pairs, off) if a.summary else pictures.delta_text(s, pairs, off) if cmd == "delta" else pictures.review(s, pairs, a.depth, off, wider)
        if off is not None and cmd != "delta":
            text += "".join(f"off the allow-list: {r.src} -> {r.dst} ({r.kind}){' introduced' if r.introduced else ''}\n" for r in off.orderBy("src", "dst", "kind").collect())
        if wider is not None:
            text += "".join(f"surface widened: {r.path}: {r.kind} {r.name}\n" for r in wider.orderBy("path", "kind", "name").collect())
        if a.plan:
            with open(a.plan, encoding="utf-8") as f:
                plan = documents.normalise(documents.from_dicts(spark, {"plan": json.load(f)}))
            r = pd.ratchet(plan, s, pairs).first()
            text += f"Plan distance: {r.before} → {r.after} ({'OK' if r.ok else 'NOT OK'}), {pd.classify(plan, s, pairs).first()['class']}\n"
        if a.out:
            os.makedirs(a.out, exist_ok=True)
            for name, body in (("review.md", text), ("review.json", rows(dl.counts(s, pairs, off, wider))), ("witnesses.json", rows(dl.witnesses(s, pairs)))):
                with open(f"{a.out}/{name}", "w", encoding="utf-8") as f:
                    f.write(body)
        else:
            print(rows(dl.counts(s, pairs, off, wider)) if a.json else text, end="")
    elif cmd == "surface":
        s, pairs = united(load(spark, at[0], "A"), load(spark, at[1], "B")), dl.pair(spark)
        print(pictures.surface_changes(s, pairs), end="")
    elif cmd in ("callgraph", "eventflow", "consumes"):
        where = f"file://{os.path.abspath(at[0])}"
        facts, use, module = golang.scan(spark, where), usage.scan(spark, where), golang.module_of(spark, where)
        functions, calls = usage.call_graph(use, facts, module)
        if cmd == "callgraph":
            print(rows(calls.orderBy("src", "dst")) if a.json else pictures.call_picture(functions, calls), end="")
        elif cmd == "eventflow":
            executes, made, _ = usage.events(use, facts, module)
            flow = gr.eventflow(executes, calls, made)
            print(rows(flow.orderBy("src", "dst")) if a.json else pictures.event_picture(flow, gr.event_roles(flow, executes)), end="")
        else:
            got = usage.interface_usage(use, facts, dl.implementers(golang.snapshot(facts, module, "A")), module)
            print(rows(got.orderBy("fq")) if a.json else pictures.consumption(module, got), end="")
    elif cmd == "contracts":
        print(pictures.contracts_view(documents.interface_facts(spark, at[0], "A"), a.select, a.all), end="")
    elif cmd == "history":
        report = git.history(spark, at[0], a.n, a.store or f"{shared_dir(spark)}/lattica-history").orderBy("date", "sha")
        if a.out:
            hs.write_csv(report, a.out)
        print(rows(hs.summary(report)), end="\n")
    else:
        s = load(spark, at[0], "A") if not a.commit else relabelled(git.extract_at(spark, at[0], a.commit), "A")
        if cmd == "extract":
            print(json.dumps(documents.document(s, "A"), indent=2))
        elif cmd == "render":
            print(pictures.graph(s, a.format, a.external), end="")
        elif cmd == "contract":
            print(json.dumps({r.path: r.targets for r in cf.allow_snapshot(s).orderBy("path").collect()}, indent=2))
        elif cmd == "health":
            h = me.health(s)
            print(rows(me.health_order(h)) if a.json else pictures.health(h), end="")
        elif cmd == "evidence":
            got = {r.test: r.outcome for r in cf.outcomes(s, documents.test_events(spark, a.events)).collect()} if a.events else {}
            cover = dl.coverage(s).join(dl.gap_kinds(s), ["snapshot_id", "iface"])
            print(rows(cover.orderBy("iface")) if a.json else pictures.evidence(at[0], cover, got), end="")
        elif cmd == "impact":
            found = [r.path for r in flt.resolve_target(s, at[1]).collect()]
            if len(found) != 1:
                print(f"{at[1]}: {len(found)} packages fit", file=sys.stderr)
                return 1
            reach = gr.dependents(flt.dep_pairs(s), found[0])
            print(rows(reach.orderBy(F.desc("direct"), "path")) if a.json else pictures.impact(found[0], reach), end="")
        elif cmd == "reflexion":
            spec = documents.layer_spec(spark, at[1])
            report, pairs = cf.reflexion(s, *spec), cf.layered(s, *spec)
            names = [r.layer for r in spec[0].orderBy("ord").collect()]
            print(rows(report.orderBy(F.desc("count"), "from", "to")) if a.json else pictures.reflexion(names, cf.layer_counts(pairs), report, cf.unmapped(pairs)), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
