"""Types by relations: members of types through embedding, who implements what, and types of expressions by propagation.

Input are rows of ``expressions`` for any number of snapshots, as ``placed`` makes them.  Everything is keyed by
``snapshot_id``, so that a whole history is one job.

* ``members``: what can be selected from a type.  Types are looked at from those that embed nothing upwards, all of one height in
  all snapshots at once; the least depth wins, and a name that meets twice at one depth is gone.  Interfaces are flattened.
* ``implements``: relational division by the method sets.  A candidate pair must share the interface's rarest method, so
  that a method which very many types have multiplies nothing.
* ``propagate``: constraints (node, operation, argument, node) and known types; a semi-naive fixpoint, in which each round
  joins only the types that the last one found.

Types of other modules are known by name alone: their members are not, but for the few below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.delta import few
from ..operators.graph import Seen, closure
from ..shared import written as keep

# Interfaces from outside that are embedded or implemented often, and functions whose result matters.
KNOWN_METHODS = [
    ("error", "Error", "()(string)"),
    ("fmt.Stringer", "String", "()(string)"),
    ("io.Closer", "Close", "()(error)"),
    ("io.Reader", "Read", "([]byte)(int,error)"),
    ("io.Writer", "Write", "([]byte)(int,error)"),
]
KNOWN_RESULTS = [("flag.NewFlagSet", "*flag.FlagSet")]
KNOWN_VARIABLES = [("flag.CommandLine", "*flag.FlagSet")]

_S = "snapshot_id"


def placed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows(key, fact, a, b, c, d) at files(snapshot_id, pkg, file, test, key): the file's own package is put in.

    Test files of a package ``x_test`` are a package of their own, ``pkg_test``."""
    outer = rows.where("fact = 'package' and endswith(a, '_test')").select("key", F.lit("_test").alias("outer"))
    return put_in(files.join(outer, "key", "left").join(rows, "key"))


def put_in(x: DataFrame) -> DataFrame:
    """``placed``, of rows that stand beside what is told of their file, with ``outer``: ``_test``, or null."""
    x = x.withColumn("own", F.concat("pkg", F.when(F.col("test"), F.coalesce("outer", F.lit(""))).otherwise("")))
    put = lambda c: F.replace(c, F.lit("§"), F.col("own"))
    return x.select(_S, "pkg", "own", "file", "test", "fact", *[put(c).alias(c) for c in "abcd"])


def node(column: Column) -> Column:
    """Nodes of a file under a name of their own in the snapshot."""
    return F.when(F.startswith(column, F.lit("g:")), column).otherwise(F.concat_ws("|", "pkg", "file", column))


def interface_methods(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshot_id, iface, name, sig, owner) of flattened interfaces; (snapshot_id, iface) of those that embed what is not known."""
    own = rows.where("fact = 'imethod'").select(_S, F.col("a").alias("iface"), F.col("b").alias("name"), F.col("c").alias("sig")).distinct()
    embeds = rows.where("fact = 'iembed'").select(_S, F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    alias = rows.where("fact in ('alias', 'named')").select(_S, F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    known = few(rows.sparkSession, KNOWN_METHODS, ["iface", "name", "sig"])
    declared = rows.where("fact = 'iface'").select(_S, F.col("a").alias("iface")).distinct()
    # Names for an interface reach it as embedding does.
    reach = closure(embeds.unionByName(alias))
    direct = own.withColumn("owner", F.col("iface"))
    through = reach.join(own.select(_S, F.col("iface").alias("dst"), "name", "sig"), [_S, "dst"]).select(_S, F.col("src").alias("iface"), "name", "sig", F.col("dst").alias("owner"))
    borrowed = reach.join(known.withColumnRenamed("iface", "dst"), "dst").select(_S, F.col("src").alias("iface"), "name", "sig", F.col("dst").alias("owner"))
    flat = direct.unionByName(through).unionByName(borrowed).groupBy(_S, "iface", "name", "sig").agg(F.min("owner").alias("owner"))
    told = declared.select(_S, F.col("iface").alias("dst")).unionByName(alias.select(_S, F.col("src").alias("dst")))
    strange = reach.join(told, [_S, "dst"], "left_anti").join(known.select(F.col("iface").alias("dst")).distinct(), "dst", "left_anti").select(_S, F.col("src").alias("iface")).distinct()
    return flat, strange


def embedded(rows: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(snapshot_id, root, type, depth, n): types whose members count as a root's, the depth at which they are met first,
    and whether they are met once (n = 1) or more often (2) there; by rounds, for roots from which embedding leads into a circle."""
    new = keep(roots.select(_S, F.col("type").alias("root"), "type", F.lit(0).alias("depth"), F.lit(1).alias("n")))
    seen = Seen(new)
    while True:
        ahead = new.join(edges, [_S, "type"]).groupBy(_S, "root", F.col("next").alias("type")).agg((F.max("depth") + 1).alias("depth"), F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"))
        new = keep(ahead.join(seen.all(), [_S, "root", "type"], "left_anti"), n=F.count(F.lit(1)))
        if not new._lattica_told["n"]:
            return seen.all()
        seen.add(new)


def _heights(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(t, h): of edges(t, n), numbers, the longest way down from each t; and (t) of those from which a circle can be reached, if
    there are any.  Edges whose end leads nowhere any more are taken away, round by round."""
    live, rounds, left = edges, [], None
    while True:
        rounds.append(live.select("t", F.lit(len(rounds) + 1).alias("h")))
        live = keep(live.join(live.select(F.col("t").alias("n")).distinct(), "n", "left_semi").select("t", "n"), n=F.count(F.lit(1)))
        n = live._lattica_told["n"]
        if not n or n == left:
            break
        left = n
    every = rounds[0]
    for x in rounds[1:]:
        every = every.unionByName(x)
    return every.groupBy("t").agg(F.max("h").alias("h")), live.select("t").distinct() if n else None


def _merged(found: DataFrame) -> DataFrame:
    """(snapshot_id, type, members): of found(snapshot_id, type, members), own members at depth -1 and those of what is embedded,
    each name at its least depth, one deeper; a name that meets there again is marked, and hides what lies deeper."""
    at = found.groupBy(_S, "type").agg(F.sort_array(F.flatten(F.collect_list("members"))).alias("m"))
    again = "m[i + 1].name = x.name and m[i + 1].depth = x.depth"
    at = at.select(_S, "type", F.expr(f"transform(m, (x, i) -> struct(x.name, x.depth + 1 as depth, if(i + 1 < size(m) and {again}, 2, x.n) as n, x.kind, x.value, x.sig, x.owner, i = 0 or m[i - 1].name <> x.name as first))").alias("m"))
    return at.select(_S, "type", F.expr("transform(filter(m, x -> x.first), x -> struct(x.name, x.depth, x.n, x.kind, x.value, x.sig, x.owner))").alias("members"))


def members(rows: DataFrame, flat: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(snapshot_id, type, name, kind, value, sig, owner, depth): fields and methods that can be selected from a type, through
    embedding; ``value`` is the type of what is selected, ``func:OWNER.NAME`` for methods.  Of some names(snapshot_id, name) only, if given.

    From the bottom up: a type's members are its own and those of the types that it embeds, which are whole by then, in one row.
    Each type is looked at once, however many embed it; only what embeds itself goes through rounds from each root."""
    methods = rows.where("fact = 'method'").select(_S, F.col("a").alias("owner"), F.col("b").alias("name"), F.col("c").alias("sig")).distinct()
    methods = methods.withColumn("maker", F.col("owner"))
    of_interfaces = flat.select(_S, F.col("iface").alias("owner"), "name", "sig", F.col("owner").alias("maker"))
    none = F.lit(None).cast("string")
    own = methods.unionByName(of_interfaces).select(_S, F.col("owner").alias("type"), "name", F.lit("method").alias("kind"), none.alias("value"), "sig", F.col("maker").alias("owner"))
    own = own.unionByName(rows.where("fact = 'field'").select(_S, F.col("a").alias("type"), F.col("b").alias("name"), F.lit("field").alias("kind"), F.col("c").alias("value"), none.alias("sig"), F.col("a").alias("owner")).distinct())
    if names is not None:
        own = own.join(names, [_S, "name"], "left_semi")
    # Heights are of hashes: types that share one are as high as the higher, which changes no result.
    number = lambda c: F.xxhash64(_S, c)
    edges = keep(rows.where("fact in ('embed', 'alias')").select(_S, F.col("a").alias("type"), F.col("b").alias("next")).distinct(), n=F.count(F.lit(1)))
    entry = F.struct("name", F.lit(-1).alias("depth"), F.lit(1).alias("n"), "kind", "value", "sig", "owner")
    mine = own.groupBy(_S, "type").agg(F.collect_list(entry).alias("members"))
    roots = rows.where("fact in ('struct', 'named', 'alias', 'iface')").select(_S, F.col("a").alias("type")).distinct()
    round_about = None
    if not edges._lattica_told["n"]:
        done = [_merged(mine)]
    else:
        high, circles = _heights(keep(edges.select(number("type").alias("t"), number("next").alias("n"))))
        high = keep(high, h=F.max("h"))
        if circles is not None:
            circles = keep(circles)
            round_about = roots.withColumn("t", number("type")).join(circles, "t", "left_semi").drop("t")
            high = keep(high.join(circles, "t", "left_anti"), h=F.max("h"))
        level = lambda df, c, h: df.withColumn("t", number(c)).join(high.withColumnRenamed("h", h), "t", "left").drop("t")
        down = edges if circles is None else edges.withColumn("t", number("type")).join(circles, "t", "left_anti").drop("t")
        down = keep(level(level(down, "type", "h"), "next", "below").fillna(0, ["below"]))
        asked = down.groupBy(_S, F.col("next").alias("type")).agg(F.lit(True).alias("embedded"))
        placed_ = mine if circles is None else mine.withColumn("t", number("type")).join(circles, "t", "left_anti").drop("t")
        mine_at = keep(level(placed_, "type", "h").fillna(0, ["h"]))
        need: dict[int, list[int]] = {}
        for r in down.select("h", "below").distinct().collect():
            need.setdefault(r.h, []).append(r.below)
        done = []
        for h in range((high._lattica_told["h"] or 0) + 1):
            found = mine_at.where(F.col("h") == h).select(_S, "type", "members")
            for below in sorted(need.get(h, [])):
                lower = done[below].where("embedded").select(_S, F.col("type").alias("next"), "members")
                found = found.unionByName(down.where((F.col("h") == h) & (F.col("below") == below)).select(_S, "type", "next").join(lower, [_S, "next"]).select(_S, "type", "members"))
            done.append(keep(_merged(found).join(asked, [_S, "type"], "left")))
    whole = done[0].select(_S, "type", "members")
    for x in done[1:]:
        whole = whole.unionByName(x.select(_S, "type", "members"))
    if round_about is not None:
        met = embedded(rows, edges, round_about).join(mine, [_S, "type"])
        deep = F.expr("transform(members, x -> struct(x.name, depth - 1 as depth, n, x.kind, x.value, x.sig, x.owner))")
        whole = whole.unionByName(_merged(met.select(_S, F.col("root").alias("type"), deep.alias("members"))))
    each = whole.join(roots, [_S, "type"], "left_semi").select(_S, "type", F.inline("members")).where("n = 1")
    value = F.when(F.col("kind") == "method", F.concat(F.lit("func:"), "owner", F.lit("."), "name")).otherwise(F.col("value"))
    return each.select(_S, "type", "name", "kind", value.alias("value"), "sig", "owner", "depth")


def selected(rows: DataFrame) -> DataFrame:
    """(snapshot_id, name): what some step selects."""
    return rows.where("fact = 'step' and c = 'sel'").select(_S, F.col("d").alias("name")).distinct()


def package_of(name) -> Column:
    """``example.com/m/p`` of ``example.com/m/p.Type``."""
    return F.regexp_replace(name, r"\.[^./]*$", "")


def short(name) -> Column:
    return F.regexp_extract(name, r"([^./]*)$", 1)


def implements(rows: DataFrame, flat: DataFrame, strange: DataFrame, own: DataFrame) -> DataFrame:
    """(snapshot_id, type, iface): exported types, and exported interfaces with methods that they have."""
    public = lambda c: short(c).rlike("^[A-Z]")
    ifaces = rows.where("fact = 'iface' and not test").select(_S, F.col("a").alias("iface")).distinct().where(public("iface")).join(strange, [_S, "iface"], "left_anti")
    # A name in lower case is the same only within its package.
    private = lambda name, owner: F.when(F.col(name).rlike("^[A-Z]"), F.lit("")).otherwise(package_of(owner))
    wanted = flat.join(ifaces, [_S, "iface"], "left_semi").select(_S, "iface", "name", "sig", private("name", "owner").alias("home"))
    types = rows.where("fact in ('struct', 'named') and not test").select(_S, F.col("a").alias("type")).distinct().where(public("type"))
    types = types.join(rows.where("fact = 'iface'").select(_S, F.col("a").alias("type")), [_S, "type"], "left_anti")
    has = keep(own.where("kind = 'method'").join(types, [_S, "type"], "left_semi").select(_S, "type", "name", "sig", private("name", "owner").alias("home")))
    key = [_S, "name", "sig", "home"]
    wanted = keep(wanted.join(has.groupBy(*key).agg(F.count("*").alias("often")), key, "left"))
    # Methods that no type has rule an interface out; of the others the rarest names the candidates.
    need = wanted.groupBy(_S, "iface").agg(F.count("*").alias("n"), F.count("often").alias("met"), F.min_by(F.struct("name", "sig", "home"), "often").alias("k")).where("n = met")
    pairs = has.join(need.select(_S, "iface", "n", "k.*"), key).select(_S, "type", "iface", "n")
    more = pairs.where("n > 1").join(wanted.select(_S, "iface", "name", "sig", "home"), [_S, "iface"]).join(has, [_S, "type", "name", "sig", "home"], "left_semi")
    whole = more.groupBy(_S, "type", "iface", "n").agg(F.count("*").alias("k")).where("k = n")
    return pairs.where("n = 1").select(_S, "type", "iface").unionByName(whole.select(_S, "type", "iface"))


def _bare(t: Column) -> Column:
    return F.regexp_replace(t, r"^\*+", "")


def _elem(t: Column) -> Column:
    """What a slice, map or channel holds; null for other types."""
    bare = _bare(t)
    of_map = F.regexp_replace(bare, r"^map\[[^\[\]]*(\[[^\]]*\][^\[\]]*)*\]", "")
    return F.when(F.startswith(bare, F.lit("[]")), F.substr(bare, F.lit(3))).when(F.startswith(bare, F.lit("chan ")), F.substr(bare, F.lit(6))).when(F.startswith(bare, F.lit("map[")), of_map)


def propagate(rows: DataFrame, own: DataFrame) -> DataFrame:
    """(snapshot_id, node, type): the types that each node may have."""
    spark = rows.sparkSession
    seeds = rows.where("fact = 'seed'").select(_S, node(F.col("a")).alias("node"), F.col("b").alias("type"))
    funcs = rows.where("fact = 'func'").select(_S, F.concat(F.lit("g:"), "own", F.lit("."), "b").alias("node"), F.concat(F.lit("func:"), "own", F.lit("."), "b").alias("type"))
    names = rows.where("fact in ('struct', 'iface', 'named', 'alias')").select(_S, F.concat(F.lit("g:"), "a").alias("node"), F.concat(F.lit("type:"), "a").alias("type"))
    every = rows.select(_S).distinct()
    outside = few(spark, [(f"g:{n}", f"func:{n}") for n, _ in KNOWN_RESULTS] + [(f"g:{n}", t) for n, t in KNOWN_VARIABLES], ["node", "type"])
    # Where a snapshot names them.
    met = rows.where("fact = 'step' and a like 'g:%'").select(_S, F.col("a").alias("node")).distinct().join(outside, "node").select(_S, "node", "type")
    result = rows.where("fact = 'result'").select(_S, F.concat(F.when(F.col("a") == "", F.col("own")).otherwise(F.col("a")), F.lit("."), "b").alias("f"), F.col("c").alias("out"), F.col("d").alias("k")).distinct()
    known = every.join(few(spark, [(n, t, "0") for n, t in KNOWN_RESULTS], ["f", "out", "k"]))  # a row a snapshot
    result = result.unionByName(known)
    called = result.where("k = '0'").select(_S, F.concat(F.lit("func:"), "f").alias("type"), F.lit("call").alias("op"), F.lit("").alias("arg"), "out")
    picked = result.select(_S, F.concat(F.lit("tuple:"), "f").alias("type"), F.concat(F.lit("pick"), "k").alias("op"), F.lit("").alias("arg"), "out")
    chosen = own.select(_S, "type", F.lit("sel").alias("op"), F.col("name").alias("arg"), F.col("value").alias("out"))
    held = rows.where("fact = 'named'").select(_S, F.col("a").alias("type"), F.lit("elem").alias("op"), F.lit("").alias("arg"), _elem(F.col("b")).alias("out")).where("out is not null")
    steps = keep(rows.where("fact = 'step'").select(_S, node(F.col("a")).alias("node"), node(F.col("b")).alias("next"), F.when(F.col("c") == "index", "elem").otherwise(F.col("c")).alias("op"), F.col("d").alias("arg")).distinct())
    # A type has members that nothing selects, most of them where it embeds many: what no step asks for is not looked up in any round.
    asked = steps.select(_S, "op", "arg").distinct()
    rules = keep(called.unionByName(picked).unionByName(chosen).unionByName(held).join(asked, [_S, "op", "arg"], "left_semi").distinct())
    new = keep(seeds.unionByName(funcs).unionByName(names).unionByName(met).distinct())
    seen = Seen(new)
    t, tuples = F.col("type"), F.startswith("type", F.lit("tuple:"))
    straight = (
        F.when((F.col("op") == "copy") & ~tuples, t)
        .when((F.col("op") == "pick0") & ~tuples, t)
        .when((F.col("op") == "call") & F.startswith(t, F.lit("type:")), F.substr(t, F.lit(6)))
        .when((F.col("op") == "call") & F.startswith(t, F.lit("func:")), F.concat(F.lit("tuple:"), F.substr(t, F.lit(6))))
        .when((F.col("op") == "elem") & F.startswith(t, F.lit("func:")), t)
        .when(F.col("op") == "elem", _elem(t))
    )
    while True:
        ahead = new.join(steps, [_S, "node"])
        by_form = ahead.select(_S, F.col("next").alias("node"), straight.alias("type")).where("type is not null")
        looked = ahead.withColumn("type", _bare(F.when((F.col("op") == "sel") & F.startswith(t, F.lit("type:")), F.substr(t, F.lit(6))).otherwise(t)))
        by_rule = looked.join(rules, [_S, "type", "op", "arg"]).select(_S, F.col("next").alias("node"), F.col("out").alias("type"))
        new = keep(by_form.unionByName(by_rule).distinct().join(seen.all(), [_S, "node", "type"], "left_anti"), n=F.count(F.lit(1)))
        if not new._lattica_told["n"]:
            return seen.all()
        seen.add(new)


def references(rows: DataFrame, typed: DataFrame) -> DataFrame:
    """(snapshot_id, pkg, own, file, test, fn, target, recv, name, called): functions and methods that functions refer to: the
    package, the type for methods (else ''), the name, and whether it is called there."""
    at = rows.where("fact = 'fn'").select(_S, "pkg", "own", "file", "test", node(F.col("a")).alias("node"), F.col("b").alias("fn"))
    calls = rows.where("fact = 'step' and c = 'call'").select(_S, node(F.col("a")).alias("node"), F.lit(True).alias("called")).distinct()
    hit = typed.where("startswith(type, 'func:')").select(_S, "node", F.substr("type", F.lit(6)).alias("f"))
    x = hit.join(at, [_S, "node"]).join(calls, [_S, "node"], "left")
    x = x.select(_S, "pkg", "own", "file", "test", "fn", package_of("f").alias("owner"), short("f").alias("name"), F.coalesce("called", F.lit(False)).alias("called")).distinct()
    # What stands before the name is a package of the module, or a type.
    packages = rows.select(_S, F.col("own").alias("owner"), F.lit(True).alias("free")).distinct()
    free = F.coalesce("free", F.lit(False))
    x = x.join(packages, [_S, "owner"], "left")
    return x.select(_S, "pkg", "own", "file", "test", "fn", F.when(free, F.col("owner")).otherwise(package_of("owner")).alias("target"), F.when(free, "").otherwise(short("owner")).alias("recv"), "name", "called")


def touched(rows: DataFrame, typed: DataFrame) -> DataFrame:
    """(snapshot_id, pkg, file, test, fn, type): named types of the expressions and variables of functions, slices' and
    pointers' ends and all results of calls among them."""
    result = rows.where("fact = 'result'").select(_S, F.concat(F.when(F.col("a") == "", F.col("own")).otherwise(F.col("a")), F.lit("."), "b").alias("f"), F.col("c").alias("out")).distinct()
    tuples = typed.where("startswith(type, 'tuple:')").select(_S, "node", F.substr("type", F.lit(7)).alias("f")).join(result, [_S, "f"]).select(_S, "node", F.col("out").alias("type"))
    plain = typed.where("not startswith(type, 'tuple:') and not startswith(type, 'func:')")
    named = plain.unionByName(tuples).select(_S, "node", F.regexp_replace(F.regexp_replace("type", "^type:", ""), r"^(\*|\[\])+", "").alias("type")).distinct()
    at = rows.where("fact = 'fn'").select(_S, "pkg", "file", "test", node(F.col("a")).alias("node"), F.col("b").alias("fn"))
    held = rows.where("fact = 'seed' and startswith(a, 'v:')").select(_S, "pkg", "file", "test", node(F.col("a")).alias("node"), F.split("a", ":")[1].alias("fn"))
    return named.join(at.unionByName(held).distinct(), [_S, "node"]).select(_S, "pkg", "file", "test", "fn", "type").distinct()


def flag_names(rows: DataFrame, typed: DataFrame) -> DataFrame:
    """(snapshot_id, pkg, file, test, name, x, y): methods called on flag sets, with their first two literal arguments."""
    sets = typed.where("type in ('*flag.FlagSet', 'flag.FlagSet')").select(_S, "node")
    step = rows.where("fact = 'step' and c = 'sel'").select(_S, "pkg", "file", "test", node(F.col("a")).alias("node"), node(F.col("b")).alias("callee"), F.col("d").alias("name"))
    text = rows.where("fact = 'text'").select(_S, node(F.col("a")).alias("callee"), F.col("b").alias("x"), F.col("c").alias("y"))
    return step.join(sets, [_S, "node"], "left_semi").join(text, [_S, "callee"]).select(_S, "pkg", "file", "test", "name", "x", "y")
