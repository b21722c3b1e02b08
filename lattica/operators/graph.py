"""Graph kernels: each runs over all snapshots at once, and keeps every round in the shared folder.  No kernel has a
bound on its rounds: each ends when a round brings nothing new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written as keep
from .ranks import ranked

#: Rounds that are read side by side before they are written together.
ROUNDS_KEPT = 6
#: Boxes of one word of a set, and of a piece that is solved where it lies.
_WORD = 64
#: Of how many rows on a way one is a stop, in how many rounds others must have come to one, and how many rows need no stops.
_STOPS, _NEAR, _FEW = 8, 9, 100_000
_PAIR = ["snapshot_id", "src", "dst"]


class Seen:
    """Rows found so far: the last rounds as they were kept, merged into one table now and then."""

    def __init__(self, first: DataFrame):
        self.rounds = [first]

    def add(self, new: DataFrame) -> None:
        self.rounds.append(new)
        if len(self.rounds) > ROUNDS_KEPT:
            self.rounds = [keep(self.all())]

    def all(self) -> DataFrame:
        out = self.rounds[0]
        for x in self.rounds[1:]:
            out = out.unionByName(x)
        return out


def _labelled(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(box, label) of all ends of links(u, v), numbers: boxes of one weakly connected piece share a label.  Each box points to
    its least neighbour, pointers are followed to where they end, and links between such ends go round again: as often as a
    piece of a word's boxes needs at least.  Also links between labels that are left then, if there are any."""
    whole, live = None, links
    for _ in range(_WORD.bit_length()):
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = keep(both.groupBy("u").agg(F.min("v").alias("to")).select(F.col("u").alias("box"), F.least("u", "to").alias("to")))
        ends, rows, moved = to.where("box = to"), to.where("box <> to"), 1
        while moved:
            onward = rows.select(F.col("box").alias("to"), F.col("to").alias("_to"))
            rows = keep(rows.join(onward, "to", "left").select("box", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")), moved=F.count_if("moved"))
            rows, moved = rows.drop("moved"), rows._lattica_told["moved"]
        to = ends.unionByName(rows)
        if whole is None:
            whole = to.withColumnRenamed("to", "label")
        else:
            whole = keep(whole.join(to.select(F.col("box").alias("label"), "to"), "label", "left").select("box", F.coalesce("to", "label").alias("label")))
        for end in ("u", "v"):
            live = live.join(to.select(F.col("box").alias(end), F.col("to").alias(f"c{end}")), end)
        live = keep(live.where("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct(), n=F.count(F.lit(1)))
        if not live._lattica_told["n"]:
            return whole, None
    return whole, live


def pieces(pairs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(small, rest): weakly connected pieces of at most a word's boxes, each one row (snapshot_id, boxes, reach) with its boxes in
    order and what each reaches as bits, and the arrows of all other pieces, if there are any.

    Arrows move to their label and come together piece by piece, in whose row paths of any length are followed; what a
    graph consists of mostly takes no rounds of joins.  Labels are of hashes of boxes: where two boxes share one, their pieces come
    together, which changes no result.  Where pairs have a column ``now``, only arrows that have it set lead on, and ``moved`` tells
    of pieces in which ``was`` differs."""
    marks = [c for c in ("was", "now") if c in pairs.columns]
    edges = pairs.select(*_PAIR, *marks)
    edges = keep(edges if marks else edges.distinct(), unnamed=F.count_if(F.col("snapshot_id").isNull() | F.col("src").isNull() | F.col("dst").isNull()))
    number = lambda end: F.xxhash64("snapshot_id", end)
    label, live = _labelled(keep(edges.select(number("src").alias("u"), number("dst").alias("v"))))
    large = label.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > _WORD).select("label")
    if live is not None:
        large = large.unionByName(live.select(F.explode(F.array("u", "v")).alias("label"))).distinct()
    large = keep(large, n=F.count(F.lit(1)))
    if edges._lattica_told["unnamed"]:
        large = label.select("label").distinct()
    whole = not edges._lattica_told["unnamed"] and not large._lattica_told["n"]
    far = None if whole else keep(label.join(large, "label", "left_semi").select(F.col("box").alias("u")))
    near = label if whole else label.join(large, "label", "left_anti")
    own = edges.withColumn("u", number("src"))
    arrow = F.struct("src", "dst", *marks)
    told = [F.bool_or(F.col("was") != F.col("now")).alias("moved")] if marks else []
    # Dealt by piece before grouping, which merges nothing where arrows lie.
    at = own.join(near.withColumnRenamed("box", "u"), "u").select("snapshot_id", "label", *edges.columns[1:]).repartition("snapshot_id", "label")
    at = at.groupBy("snapshot_id", "label").agg(F.collect_list(arrow).alias("arrows"), *told)
    at = at.withColumn("boxes", F.expr("array_sort(array_distinct(concat(arrows.src, arrows.dst)))")).withColumn("fits", F.size("boxes") <= _WORD)
    leads = "filter(arrows, e -> e.now)" if marks else "arrows"
    steps = f"transform({leads}, e -> struct(cast(array_position(boxes, e.src) as int) - 1 as i, cast(array_position(boxes, e.dst) as int) - 1 as j))"
    at = at.withColumn("step", F.when(F.col("fits"), F.expr(f"aggregate({steps}, array_repeat(0L, size(boxes)), (a, e) -> transform(a, (r, k) -> if(k = e.i, r | shiftleft(1L, e.j), r)))")))
    # Paths through box k, one box after the other.
    reach = F.expr("aggregate(sequence(0, size(boxes) - 1), step, (a, k) -> transform(a, r -> if((shiftright(r, k) & 1) = 1, r | a[k], r)))")
    at = at.select("snapshot_id", "boxes", F.when(F.col("fits"), reach).alias("reach"), F.when(~F.col("fits"), F.col("arrows")).alias("arrows"), *(["moved"] if marks else []))
    at = keep(at, over=F.count_if(F.col("reach").isNull()))
    rest = None if whole else own.join(far, "u", "left_semi").drop("u")
    if at._lattica_told["over"]:  # pieces that hashes brought together
        more = at.where("reach is null").select("snapshot_id", F.inline("arrows"))
        rest = more if rest is None else rest.unionByName(more)
    return at.where("reach is not null").drop("arrows"), None if rest is None else keep(rest)


def _reached(small: DataFrame) -> DataFrame:
    """(snapshot_id, src, dst) of small pieces."""
    return small.select("snapshot_id", F.expr("inline(flatten(transform(boxes, (b, i) -> transform(filter(sequence(0, size(boxes) - 1), j -> (shiftright(reach[i], j) & 1) = 1), j -> struct(b as src, boxes[j] as dst)))))"))


def _small_cycles(small: DataFrame) -> DataFrame:
    """(snapshot_id, path, cycle) of small pieces, each component named by its least member."""
    mate = "array_min(filter(sequence(0, size(boxes) - 1), j -> j <> i and (shiftright(reach[i], j) & 1) = 1 and (shiftright(reach[j], i) & 1) = 1))"
    found = small.select("snapshot_id", "boxes", F.expr(f"inline(transform(boxes, (b, i) -> struct(b as path, i as at, {mate} as mate)))"))
    return found.where("mate is not null").select("snapshot_id", "path", F.expr("boxes[least(at, mate)]").alias("cycle"))


def _small_blast(small: DataFrame) -> DataFrame:
    """(snapshot_id, path, blast_radius) of small pieces."""
    n = "cast(size(filter(sequence(0, size(boxes) - 1), j -> j <> i and (shiftright(reach[j], i) & 1) = 1)) as bigint)"
    return small.select("snapshot_id", F.expr(f"inline(transform(boxes, (b, i) -> struct(b as path, {n} as blast_radius)))")).where("blast_radius > 0")


def closure(pairs: DataFrame, seeds: DataFrame | None = None, kept: bool = False) -> DataFrame:
    """(snapshot_id, src, dst) reachable in one step or more; from seeds(snapshot_id, path) only, if given.

    Without seeds, small pieces of the graph are solved where they lie.  In the rest path lengths double: what a round found joins
    everything found so far, so that rounds grow with the logarithm of the longest path.  From seeds, each round takes one
    step from what the last one reached.  ``kept`` tells that pairs are distinct and written already."""
    if seeds is None:
        small, rest = pieces(pairs)
        return _reached(small) if rest is None else _reached(small).unionByName(_doubled(rest))
    return _doubled(pairs, seeds, kept)


def _doubled(pairs: DataFrame, seeds: DataFrame | None = None, kept: bool = False) -> DataFrame:
    """``closure`` by rounds of joins."""
    step = pairs.select(*_PAIR) if kept else keep(pairs.select(*_PAIR).distinct())
    new = step if seeds is None else keep(step.join(seeds.select("snapshot_id", F.col("path").alias("src")), ["snapshot_id", "src"], "left_semi"))
    seen = Seen(new)
    going = not new.isEmpty()
    while going:
        onward = step if seeds is not None else seen.all()
        ahead = new.select("snapshot_id", "src", F.col("dst").alias("mid")).join(onward.select("snapshot_id", F.col("src").alias("mid"), "dst"), ["snapshot_id", "mid"]).select(*_PAIR).distinct()
        new = keep(ahead.join(seen.all(), _PAIR, "left_anti"), n=F.count(F.lit(1)))
        going = new._lattica_told["n"]
        seen.add(new)
    return seen.all()


def closure_after(reach: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """The closure of ``after``, from that of ``before`` (all snapshot_id, src, dst; a snapshot_id is one history): what moved
    between two versions is taken out and put in, and the rest is not derived again.  Small pieces in which something moved
    are solved anew where they lie, the others stay."""
    sides = [df.select(*_PAIR, F.lit(end == "was").alias("was"), F.lit(end == "now").alias("now")) for end, df in (("was", before), ("now", after))]
    both = sides[0].unionByName(sides[1]).groupBy(*_PAIR).agg(F.max("was").alias("was"), F.max("now").alias("now"))
    small, rest = pieces(both)
    moved = small.where("moved")
    fixed = reach.join(moved.select("snapshot_id", F.explode("boxes").alias("src")), ["snapshot_id", "src"], "left_anti").select(*_PAIR)
    if rest is not None:
        fixed = _closure_after(fixed, rest.where("was"), rest.where("now"))
    return fixed.unionByName(_reached(moved))


def _closure_after(reach: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``closure_after`` by rounds of joins.

    Arrows that went take all pairs with them that a path through them may have made; of these, pairs that other arrows still
    make come back, round by round.  Arrows that came bring the pairs that they make with what is there.  Only pairs that were
    taken out or are new are joined in rounds."""
    stay = keep(before.join(after, _PAIR, "left_semi").select(*_PAIR).distinct())
    gone, come = before.join(stay, _PAIR, "left_anti"), after.join(stay, _PAIR, "left_anti")
    now = reach.select(*_PAIR)
    gone = keep(gone.select(*_PAIR).distinct())
    if not gone.isEmpty():
        ends = lambda c: gone.select("snapshot_id", F.col(c)).distinct()
        heads = now.join(ends("src").withColumnRenamed("src", "dst"), ["snapshot_id", "dst"], "left_semi").select("snapshot_id", F.col("src").alias("x"), F.col("dst").alias("src")).unionByName(ends("src").select("snapshot_id", F.col("src").alias("x"), "src"))
        tails = now.join(ends("dst").withColumnRenamed("dst", "src"), ["snapshot_id", "src"], "left_semi").select("snapshot_id", F.col("src").alias("dst"), F.col("dst").alias("y")).unionByName(ends("dst").select("snapshot_id", "dst", F.col("dst").alias("y")))
        through = heads.join(gone, ["snapshot_id", "src"]).select("snapshot_id", "x", "dst").distinct().join(tails, ["snapshot_id", "dst"])
        out = keep(through.select("snapshot_id", F.col("x").alias("src"), F.col("y").alias("dst")).distinct())
        kept = keep(now.join(out, _PAIR, "left_anti"))
        # An arrow that stays, or one to where the pair's end is still reached from, makes a pair again.
        step = stay.select("snapshot_id", "src", F.col("dst").alias("mid")).join(out, ["snapshot_id", "src"]).select("snapshot_id", "src", "mid", "dst").distinct()
        step = keep(step)
        held = kept.select("snapshot_id", F.col("src").alias("mid"), "dst")
        again = step.where("mid = dst").unionByName(step.join(held, ["snapshot_id", "mid", "dst"], "left_semi").select(*step.columns))
        new = keep(again.select(*_PAIR).distinct())
        back = Seen(new)
        while not new.isEmpty():
            onward = new.select("snapshot_id", F.col("src").alias("mid"), "dst")
            more = step.join(onward, ["snapshot_id", "mid", "dst"], "left_semi").select(*_PAIR).distinct()
            new = keep(more.join(back.all(), _PAIR, "left_anti"))
            back.add(new)
        now = keep(kept.unionByName(back.all()))
    new = keep(come.select(*_PAIR).distinct().join(now, _PAIR, "left_anti"))
    seen = Seen(now)
    while not new.isEmpty():
        # New pairs are lengthened on either side by all that is there, themselves included.
        seen.add(new)
        every = seen.all()
        right = new.select("snapshot_id", "src", F.col("dst").alias("mid")).join(every.select("snapshot_id", F.col("src").alias("mid"), "dst"), ["snapshot_id", "mid"]).select(*_PAIR)
        left = every.select("snapshot_id", "src", F.col("dst").alias("mid")).join(new.select("snapshot_id", F.col("src").alias("mid"), "dst"), ["snapshot_id", "mid"]).select(*_PAIR)
        new = keep(left.unionByName(right).distinct().join(every, _PAIR, "left_anti"))
    return seen.all()


def dependents(pairs: DataFrame, target: str) -> DataFrame:
    """(snapshot_id, path, direct): what depends on the target, itself excluded."""
    # Written once: what is asked of arrows below reads them, and seeds of a known size are sent to where arrows lie.
    back = keep(pairs.select("snapshot_id", F.col("dst").alias("src"), F.col("src").alias("dst")).distinct())
    seeds = keep(back.select("snapshot_id").distinct().withColumn("path", F.lit(target)))
    direct = back.where(F.col("src") == target).select("snapshot_id", "dst").distinct().withColumn("direct", F.lit(True))
    return closure(back, seeds, kept=True).where(F.col("dst") != target).join(direct, ["snapshot_id", "dst"], "left").select("snapshot_id", F.col("dst").alias("path"), F.coalesce("direct", F.lit(False)).alias("direct"))


def blast(reach: DataFrame) -> DataFrame:
    """(snapshot_id, path, blast_radius): transitive dependents of each package, itself excluded, from a closure."""
    return reach.where("src <> dst").groupBy("snapshot_id", F.col("dst").alias("path")).agg(F.count("*").alias("blast_radius"))


def _numbered(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshot_id, src, dst) with boxes of all snapshots as numbers, which rounds move instead of names, and no snapshots to tell
    apart; and (of, name, id) of the boxes."""
    ends = pairs.select(F.col("snapshot_id").alias("of"), F.explode(F.array("src", "dst")).alias("name")).distinct()
    boxes = keep(ends.withColumn("id", F.monotonically_increasing_id()))
    out = pairs.select(F.col("snapshot_id").alias("of"), "src", "dst")
    for end in ("src", "dst"):
        out = out.join(boxes.withColumnsRenamed({"name": end, "id": f"_{end}"}), ["of", end])
    return keep(out.select(F.lit(0).cast("byte").alias("snapshot_id"), F.col("_src").alias("src"), F.col("_dst").alias("dst"))), boxes


def _named(found: DataFrame, boxes: DataFrame) -> DataFrame:
    """``found`` of numbers, its ``path`` by name again, in its snapshot."""
    rest = [c for c in found.columns if c not in ("snapshot_id", "path")]
    return found.join(boxes, F.col("path") == F.col("id")).select(F.col("of").alias("snapshot_id"), F.col("name").alias("path"), *rest)


def _heights(edges: DataFrame) -> DataFrame:
    """(snapshot_id, path, n_in, n_out, a_in, a_out): arrows in and out, and one end of each."""
    kind = edges.schema["src"].dataType
    ends = edges.select("snapshot_id", F.explode(F.array(F.struct(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(None).cast(kind).alias("p"), F.col("dst").alias("s")), F.struct(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("src").alias("p"), F.lit(None).cast(kind).alias("s")))).alias("e")).select("snapshot_id", "e.*")
    return ends.groupBy("snapshot_id", "path").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.min("p").alias("a_in"), F.min("s").alias("a_out"))


def followed(rows: DataFrame, n: int, join: dict) -> DataFrame:
    """rows(snapshot_id, path, to, ...), ``to`` another row's path or a place that is no row's -> the same with ``to`` where the way
    ends, and ``ring``: whether it never does.  ``join`` tells how values of two stretches become that of both: column ->
    (mine, further) -> value; in a ring only those that any number of turns leaves as they are (a least one) mean something.

    Of many rows, by their hash every eighth is a stop: others go to the nearest stop only, which takes few rounds for nearly all;
    then stops alone, by the same means, and what ends at a stop goes on from there.  Rows moved are a multiple of ``n``,
    while pointer jumping moves all rows as often as the longest way doubles.  ``n`` is the number of rows, or more."""
    S, names = "snapshot_id", list(join)
    rows = rows.select(S, "path", "to", *names)

    def onward(these, ends, flag, way):
        """``these`` from where they are to where ``ends`` lead from there; ``flag`` is what both tell of a way's end."""
        more = ends.select(S, F.col("path").alias("to"), F.col("to").alias("_to"), *[F.col(c).alias(f"_{c}") for c in names], F.col(flag).alias("_flag"))
        on = F.col("_to").isNotNull()
        return these.join(more, [S, "to"], "left").select(S, "path", F.coalesce("_to", "to").alias("to"), *[F.when(on, join[c](F.col(c), F.col(f"_{c}"))).otherwise(F.col(c)).alias(c) for c in names], way(F.col("_flag")).alias(flag))

    whole, level = [], 0
    while n > _FEW:
        stop = F.pmod(F.xxhash64("path", F.lit(level)), F.lit(_STOPS)) == 0
        rest, done, active, most = rows.where(stop), [], rows.where(~stop).withColumn("done", F.lit(False)), n
        for _ in range(_NEAR):
            now = active
            for x in done:
                now = now.unionByName(x)
            # What leads to no row that is under way is done, and what leads to one that is done.
            after = keep(onward(active, now, "done", lambda f: F.coalesce(f, F.lit(True))), most=F.count_if(~F.col("done")))
            done.append(after.where("done"))
            active, most = after.where("not done"), after._lattica_told["most"]
            if not most:
                break
        near = done[0]
        for x in done[1:]:
            near = near.unionByName(x)
        near = near.drop("done")
        rest = onward(rest, near.withColumn("done", F.lit(True)), "done", lambda f: f).drop("done")
        if most:  # in rings without a stop
            rest = rest.unionByName(active.drop("done"))
        whole.append(near)
        rows = keep(rest, n=F.count(F.lit(1)))
        before, level, n = n, level + 1, rows._lattica_told["n"]
        if n * 2 > before:  # small rings, of which stops take nothing away
            break
    at = rows.withColumn("ring", F.lit(False))
    for _ in range(max(1, n).bit_length() + 1 if n else 0):
        at = keep(onward(at, at, "ring", lambda f: f.isNotNull()), moved=F.count_if("ring"))
        if not at._lattica_told["moved"]:
            break
    for near in reversed(whole):
        on = onward(near.withColumn("ring", F.lit(False)), at, "ring", lambda f: F.coalesce(f, F.lit(False)))
        at = keep(on.unionByName(at))
    return at


def _contracted(edges: DataFrame) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """What is left of a graph without loops when boxes that nothing leads to, or that lead nowhere, are taken away, and paths of
    boxes with one arrow in and one out become one arrow; again and again.  A path of any length goes in one round of
    pointer jumping.  Also (snapshot_id, path, u, x) for each round: boxes of paths from u to x; and (snapshot_id, path, cycle)
    of rings that stood alone."""
    paths, rings, n = [], [], edges.count()
    while n:
        # Loops apart, one arrow in and one out means: on a path.
        on_path = (F.col("n_in") == 1) & (F.col("n_out") == 1)
        at = keep(_heights(edges), through=F.count_if(on_path))
        some = at._lattica_told["through"]
        ends = at.where("n_in = 0 or n_out = 0").select("snapshot_id", "path")
        live = edges
        for end in ("src", "dst"):
            live = live.join(ends.withColumnRenamed("path", end), ["snapshot_id", end], "left_anti")
        if some:
            through = at.where(on_path).select("snapshot_id", "path", "a_in", "a_out")
            ahead = followed(through.select("snapshot_id", "path", F.col("a_out").alias("to"), F.col("path").alias("m")), some, {"m": F.least})
            rings.append(ahead.where("ring").select("snapshot_id", "path", F.col("m").alias("cycle")))
            ahead = ahead.where("not ring").select("snapshot_id", "path", F.col("to").alias("x"))
            behind = followed(through.select("snapshot_id", "path", F.col("a_in").alias("to")), some, {}).where("not ring").select("snapshot_id", "path", F.col("to").alias("u"))
            on = keep(ahead.join(behind, ["snapshot_id", "path"]).select("snapshot_id", "path", "u", "x"))
            paths.append(on)
            for end in ("src", "dst"):
                live = live.join(through.select("snapshot_id", F.col("path").alias(end)), ["snapshot_id", end], "left_anti")
            live = live.select(*_PAIR).unionByName(on.where("u <> x").select("snapshot_id", F.col("u").alias("src"), F.col("x").alias("dst"))).distinct()
        edges = keep(live.select(*_PAIR), n=F.count(F.lit(1)))
        left = edges._lattica_told["n"]
        if left == n and not some:
            break
        n = left
    return edges, paths, rings


def _coloured(edges: DataFrame) -> DataFrame:
    """(snapshot_id, path, cycle) of components by forward and backward colouring: each box takes the least name that reaches it;
    what leads back to a box that kept its own name, through boxes of that name, is its component.  Components leave the
    graph, and what remains is contracted by its caller."""
    nodes = edges.select("snapshot_id", F.col("src").alias("path")).distinct()  # each has an arrow out, or it were taken away
    names = keep(nodes.withColumn("cycle", F.col("path")))
    news, going = names, 1
    while going:
        told = edges.join(news.withColumnRenamed("path", "src"), ["snapshot_id", "src"]).groupBy("snapshot_id", F.col("dst").alias("path")).agg(F.min("cycle").alias("told"))
        after = keep(names.join(told, ["snapshot_id", "path"], "left").select("snapshot_id", "path", F.least("cycle", F.coalesce("told", "cycle")).alias("cycle"), (F.col("told") < F.col("cycle")).alias("moved")), moved=F.count_if("moved"))
        names, news, going = after.drop("moved"), after.where("moved").drop("moved"), after._lattica_told["moved"]
    name = lambda end, c: names.select("snapshot_id", F.col("path").alias(end), F.col("cycle").alias(c))
    within = keep(edges.join(name("src", "cs"), ["snapshot_id", "src"]).join(name("dst", "cd"), ["snapshot_id", "dst"]).where("cs = cd").select(*_PAIR, F.col("cs").alias("cycle")))
    new = keep(names.where("path = cycle"), n=F.count(F.lit(1)))
    mine = Seen(new)
    while new._lattica_told["n"]:
        back = within.join(new.select("snapshot_id", "cycle", F.col("path").alias("dst")), ["snapshot_id", "cycle", "dst"]).select("snapshot_id", F.col("src").alias("path"), "cycle").distinct()
        new = keep(back.join(mine.all(), ["snapshot_id", "path"], "left_anti"), n=F.count(F.lit(1)))
        mine.add(new)
    return keep(mine.all())


def _components(pairs: DataFrame) -> DataFrame:
    """(snapshot_id, path, cycle): members of strongly connected components of two nodes or more, named by some member.

    Without the closure: the graph is contracted, what is left is coloured, and what that leaves goes round again.  A
    contracted path belongs to a component if both its ends belong to it, which is told from the last round back."""
    edges = keep(pairs.where("src <> dst").select(*_PAIR).distinct())
    paths: list[DataFrame] = []
    found = [edges.select("snapshot_id", F.col("src").alias("path"), F.col("src").alias("cycle")).limit(0)]
    while True:
        edges, more, rings = _contracted(edges)
        paths += more
        found += rings
        if edges.isEmpty():
            break
        done = _coloured(edges)
        found.append(done)
        for end in ("src", "dst"):
            # Arrows between components end here: what paths stand for needs both ends in one.
            edges = edges.join(done.select("snapshot_id", F.col("path").alias(end)), ["snapshot_id", end], "left_anti")
        edges = keep(edges.select(*_PAIR))
    whole = found[0]
    for x in found[1:]:
        whole = whole.unionByName(x)
    whole = keep(whole.distinct())
    for on in reversed(paths):
        # A box that a path leaves and comes back to is in a component, if by that path alone.
        lone = on.where("u = x").select("snapshot_id", F.col("u").alias("path")).distinct().join(whole, ["snapshot_id", "path"], "left_anti")
        whole = keep(whole.unionByName(lone.withColumn("cycle", F.col("path"))))
        of = lambda end, c: whole.select("snapshot_id", F.col("path").alias(end), F.col("cycle").alias(c))  # noqa: E731, B023
        inside = on.join(of("u", "cu"), ["snapshot_id", "u"]).join(of("x", "cx"), ["snapshot_id", "x"]).where("cu = cx")
        whole = keep(whole.unionByName(inside.select("snapshot_id", "path", F.col("cu").alias("cycle"))))
    several = whole.groupBy("snapshot_id", "cycle").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return whole.join(several, ["snapshot_id", "cycle"], "left_semi").select("snapshot_id", "path", "cycle")


def cycles(pairs: DataFrame, parts: tuple[DataFrame, DataFrame | None] | None = None) -> DataFrame:
    """(snapshot_id, path, cycle): members of strongly connected components of two nodes or more, each named by its least member.
    ``parts`` are the pairs' ``pieces``, if they are there already."""
    small, rest = parts or pieces(pairs)
    if rest is None:
        return _small_cycles(small)
    edges, boxes = _numbered(rest)
    found = keep(_named(_components(edges), boxes))
    least = found.groupBy("snapshot_id", "cycle").agg(F.min("path").alias("least"))
    return _small_cycles(small).unionByName(found.join(least, ["snapshot_id", "cycle"]).select("snapshot_id", "path", F.col("least").alias("cycle")))


def blast_radius(pairs: DataFrame, cycle: DataFrame | None = None, parts: tuple[DataFrame, DataFrame | None] | None = None) -> DataFrame:
    """(snapshot_id, path, blast_radius) of boxes that others depend on, without all pairs.  ``cycle`` and ``parts`` are the pairs'
    ``cycles`` and ``pieces``, if they are there already."""
    small, rest = parts or pieces(pairs)
    if rest is None:
        return _small_blast(small)
    edges, boxes = _numbered(rest)
    if cycle is None:
        cycle = _components(edges)
    else:
        number = lambda c: boxes.select(F.col("of").alias("snapshot_id"), F.col("name").alias(c), F.col("id").alias(f"_{c}"))
        cycle = cycle.join(number("path"), ["snapshot_id", "path"]).join(number("cycle"), ["snapshot_id", "cycle"])
        cycle = cycle.select(F.lit(0).cast("byte").alias("snapshot_id"), F.col("_path").alias("path"), F.col("_cycle").alias("cycle"))
    return _small_blast(small).unionByName(_named(_blast_radius(edges, keep(cycle)), boxes))


def _blast_radius(pairs: DataFrame, cycle: DataFrame) -> DataFrame:
    """``blast_radius`` of pieces of any size.

    Components are one box each, whose members share all.  In the acyclic rest, a box with one arrow in has what that box
    has and it: such boxes are counted along their chains by pointer jumping.  Only where arrows meet are sets needed: bits
    in words, numbered along the chains, that move to where a chain meets the next until nothing is new."""
    S = "snapshot_id"
    edges = pairs.where("src <> dst").select(*_PAIR).distinct()
    for end in ("src", "dst"):
        edges = edges.join(cycle.select(S, F.col("path").alias(end), F.col("cycle").alias(f"c_{end}")), [S, end], "left")
    edges = keep(edges.select(S, F.coalesce("c_src", "src").alias("src"), F.coalesce("c_dst", "dst").alias("dst")).where("src <> dst").distinct())
    big = cycle.groupBy(S, F.col("cycle").alias("path")).agg(F.count("*").alias("size"))
    at = keep(_heights(edges).join(big, [S, "path"], "left").select(S, "path", "n_in", "a_in", F.coalesce("size", F.lit(1)).alias("size")))
    sizes = at.select(S, F.col("path").alias("up"), F.col("size").alias("above"))
    # (path, up, above): the nearest box further up with none or several arrows in, and the boxes from there on, itself included.
    chains = at.where("n_in = 1").select(S, "path", F.col("a_in").alias("up")).join(sizes, [S, "up"])
    steps = keep(chains.select(S, "path", "up", "above", F.lit(1).cast("long").alias("deep")))
    far = _summed(steps)
    met = keep(at.where("n_in > 1").select(S, "path"))
    counted = at.where("n_in = 0").select(S, "path", F.lit(0).cast("long").alias("radius"))
    if not met.isEmpty():
        counted = keep(counted.unionByName(_met_counts(edges, at, steps, far, met)))
    below = far.join(counted.select(S, F.col("path").alias("up"), "radius"), [S, "up"]).select(S, "path", (F.col("above") + F.col("radius")).alias("radius"))
    every = counted.unionByName(below)
    boxes = every.join(cycle.select(S, F.col("cycle").alias("path"), F.col("path").alias("member")), [S, "path"], "left").join(big, [S, "path"], "left")
    of_boxes = boxes.select(S, F.coalesce("member", "path").alias("path"), (F.col("radius") + F.coalesce("size", F.lit(1)) - 1).alias("blast_radius"))
    # Components that no arrow leads to or from.
    alone = cycle.join(at.select(S, F.col("path").alias("cycle")), [S, "cycle"], "left_anti").join(big.withColumnRenamed("path", "cycle"), [S, "cycle"]).select(S, "path", (F.col("size") - 1).alias("blast_radius"))
    return of_boxes.unionByName(alone).where("blast_radius > 0")


def _summed(steps: DataFrame) -> DataFrame:
    """(snapshot_id, path, up, above, deep): where chains begin, with the sums on the way there."""
    plus = lambda mine, further: mine + further
    rows = followed(steps.withColumnRenamed("up", "to"), steps.count(), {"above": plus, "deep": plus})
    return rows.select("snapshot_id", "path", F.col("to").alias("up"), "above", "deep")


def _met_counts(edges: DataFrame, at: DataFrame, steps: DataFrame, far: DataFrame, met: DataFrame) -> DataFrame:
    """(snapshot_id, path, radius) of the boxes at which arrows meet."""
    S = "snapshot_id"
    # Boxes of one chain, in order, have neighbouring numbers.
    placed = at.select(S, "path", "size").join(far.select(S, "path", "up", "deep"), [S, "path"], "left").select(S, "path", "size", F.coalesce("up", "path").alias("up"), F.coalesce("deep", F.lit(0)).alias("deep"))
    number = keep(ranked(placed, [S], [F.col("up"), F.col("deep"), F.col("path")], "id").select(S, "path", "size", (F.col("id") - 1).alias("id")))
    into = edges.join(met.select(S, F.col("path").alias("dst")), [S, "dst"], "left_semi").select(S, F.col("dst").alias("path"), F.col("src").alias("at"))
    # All boxes on the chains that end at a meeting: those found so far, and where as many steps more lead.
    seen, jump = keep(into), steps.select(S, F.col("path").alias("at"), F.col("up").alias("to"))
    while not jump.isEmpty():
        more = seen.join(jump, [S, "at"]).select(S, "path", F.col("to").alias("at"))
        both = keep(seen.unionByName(more).distinct())
        jump = keep(jump.join(jump.select(S, F.col("at").alias("to"), F.col("to").alias("next")), [S, "to"]).select(S, "at", F.col("next").alias("to")))
        seen = both
    bit = F.expr(f"shiftleft(1L, cast(pmod(id, {_WORD}) as int))")
    words = lambda df: df.groupBy(S, "path", "word").agg(F.bit_or("bits").alias("bits"))
    own = words(seen.join(number.select(S, F.col("path").alias("at"), "id"), [S, "at"]).select(S, "path", F.floor(F.col("id") / _WORD).alias("word"), bit.alias("bits")))
    begins = into.join(far.select(S, F.col("path").alias("at"), "up"), [S, "at"], "left").select(S, "path", F.coalesce("up", "at").alias("up"))
    onward = keep(begins.join(met.withColumnRenamed("path", "up"), [S, "up"], "left_semi").select(S, F.col("up").alias("path"), F.col("path").alias("next")).distinct())
    have = new = keep(own)
    while True:
        told = words(new.join(onward, [S, "path"]).select(S, F.col("next").alias("path"), "word", "bits"))
        fresh = told.join(have.withColumnRenamed("bits", "old"), [S, "path", "word"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))).where("bits <> 0").select(S, "path", "word", "bits")
        new = keep(fresh, n=F.count(F.lit(1)))
        if not new._lattica_told["n"]:
            break
        have = keep(words(have.unionByName(new)))
    # A component counts with all its members.
    heavy = number.where("size > 1").select(S, F.floor(F.col("id") / _WORD).alias("word"), bit.alias("bit"), (F.col("size") - 1).alias("extra"))
    plain = have.groupBy(S, "path").agg(F.sum(F.bit_count("bits")).alias("radius"))
    extra = have.join(heavy, [S, "word"]).where("(bits & bit) <> 0").groupBy(S, "path").agg(F.sum("extra").alias("extra"))
    return plain.join(extra, [S, "path"], "left").select(S, "path", (F.col("radius") + F.coalesce("extra", F.lit(0))).alias("radius"))


def hops(calls: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(snapshot_id, path, hop): seeds and what is within ``depth`` undirected steps."""
    links = keep(calls.select("snapshot_id", "src", "dst").unionByName(calls.select("snapshot_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    seen = new = keep(seeds.select("snapshot_id", "path", F.lit(0).alias("hop")).distinct())
    for k in range(1, depth + 1):
        ahead = links.join(new.select("snapshot_id", F.col("path").alias("src")), ["snapshot_id", "src"]).select("snapshot_id", F.col("dst").alias("path")).distinct()
        new = keep(ahead.join(seen, ["snapshot_id", "path"], "left_anti").withColumn("hop", F.lit(k)))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    for end in ("src", "dst"):
        edges = edges.join(nodes.select("snapshot_id", F.col("path").alias(end)), ["snapshot_id", end], "left_semi")
    return edges


def eventflow(executes: DataFrame, calls: DataFrame, constructs: DataFrame) -> DataFrame:
    """executes(snapshot_id, event, fn), calls(snapshot_id, src, dst), constructs(snapshot_id, fn, event) ->
    (snapshot_id, src, dst, mode): an event constructed in its Execute (direct), or in what that calls (indirect)."""
    made = constructs.select("snapshot_id", "fn", F.col("event").alias("dst"))
    start = executes.select("snapshot_id", F.col("event").alias("src"), "fn")
    direct = start.join(made, ["snapshot_id", "fn"]).select("snapshot_id", "src", "dst").distinct()
    reach = closure(calls, executes.select("snapshot_id", F.col("fn").alias("path")).distinct())
    far = start.join(reach.select("snapshot_id", F.col("src").alias("fn"), F.col("dst").alias("g")), ["snapshot_id", "fn"]).join(made.withColumnRenamed("fn", "g"), ["snapshot_id", "g"]).select("snapshot_id", "src", "dst").distinct()
    return direct.withColumn("mode", F.lit("direct")).unionByName(far.join(direct, ["snapshot_id", "src", "dst"], "left_anti").withColumn("mode", F.lit("indirect")))


def event_roles(flow: DataFrame, events: DataFrame) -> DataFrame:
    """(snapshot_id, event, in_degree, out_degree, role)."""
    ends = flow.select("snapshot_id", F.explode(F.array(F.struct(F.col("src").alias("event"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.lit(0).alias("d")), F.struct(F.col("dst").alias("event"), F.lit(0).alias("o"), F.lit(1).alias("i"), (F.col("mode") == "direct").cast("int").alias("d")))).alias("e")).select("snapshot_id", "e.*")
    deg = ends.groupBy("snapshot_id", "event").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("d").alias("d"))
    out = events.select("snapshot_id", "event").distinct().join(deg, ["snapshot_id", "event"], "left").fillna(0)
    role = F.when(F.col("in_degree") == 0, "entry").when(F.col("out_degree") == 0, "terminal").when(F.col("d") == 0, "indirect-only").otherwise("")
    return out.select("snapshot_id", "event", "in_degree", "out_degree", role.alias("role"))
