"""Prefix trie of conversations, as a Cartesian tree over the LCP array of the sorted conversations.

1. A turn is known by a 128-bit hash of role and text.  Conversations are sorted by their sequences of hashes, in
   segments: a first sort by the first 64 turns, and further ones among those alone that are equal so far.  Ranges are cut
   by segment and conv_id, so that thousands of copies spread over tasks.  This gives each conversation a place and
   ``a``, the number of turns that it has in common with the one before it.
2. All nearest smaller values of ``a``, to the left and right, are found in parallel: within blocks of places by a
   stack, beyond them by the minima of all blocks, which name the block that holds the answer, and one lookup there.
   What two of them enclose is an interval of places: the members of a node of depth ``a``.  Equal values give equal intervals,
   which merge into one node; a conversation that goes on by itself beyond what it shares is a node of its own.
3. A node's parent is the larger of the two values that enclose it.  Between the parent's depth and its own it stands
   for a chain of nodes with the same members: missing depths are expanded.
4. Members, smallest conv_id, leaves and saved bytes are aggregates of intervals: differences of running sums
   over places, minima of blocks.  Nothing is passed up the tree level by level, so its depth costs no rounds.

Work and rows grow with turns and nodes.  Blocks are at most ``MAX_BLOCKS`` whatever the input, and so is what the driver
holds: a few numbers a block.

Null roles and texts are empty; turns without a number come first; ties are ordered by role and hash and are turns of their own, as are
repeated rows; rows without conv_id belong to no conversation; an empty table gives no nodes; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import carried, in_ranges, per_range, ranked
from .common import cut, lookup

FAMILY = 5
MOST_SHARED = 9
#: Turns of the first segment; the second has twice, all others four times as many.
FIRST = 64
LEAST_BLOCK, MAX_BLOCKS = 512, 100_000
#: Hexadecimal digits of a turn's hash.
DIGITS = 32
#: Depths that are made into rows at once.
CHAIN = 1000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turns_of(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (from 0 on), h (hash of role and text), bytes (UTF-8, of the text)."""
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    said = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = df.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), role.alias("role"), F.substring(said, 1, DIGITS).alias("h"), F.octet_length(text).cast("long").alias("bytes")).where("conv_id is not null")
    numbered = ranked(cut(rows), ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("h")], "place")
    return cut(numbered.select("conv_id", (F.col("place") - 1).alias("place"), "h", "bytes"))


def shared_turns(conv: Column, most: int = MOST_SHARED) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % most


def rebuilt(turns: DataFrame, family: int = FAMILY, most: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """(conv_id, i, h, bytes): each conversation begins with the first turns of its family's first one and goes on with its
    own; and (conv_id, len) of all, turnless ones too.  A first conversation lends ``most`` - 1 turns at most to ``family`` at most."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("lent", shared_turns(F.col("conv_id"), most)).withColumn("head", F.col("conv_id") - F.col("conv_id") % family)
    heads = sizes.select(F.col("conv_id").alias("head"), F.col("n").alias("of_head"))
    sizes = cut(sizes.join(heads, "head", "left").withColumn("taken", F.least("lent", F.coalesce("of_head", F.lit(0)))))
    own = lookup(turns, sizes.select("conv_id", "n", "lent", "taken"), ["conv_id"], "n", "inner").where("place >= lent").select("conv_id", (F.col("place") - F.col("lent") + F.col("taken")).alias("i"), "h", "bytes")
    first = turns.where(F.col("place") < most - 1).select(F.col("conv_id").alias("head"), "place", "h", "bytes")
    taken = sizes.select("conv_id", "head", "lent").join(first, "head").where("place < lent").select("conv_id", F.col("place").alias("i"), "h", "bytes")
    return own.unionByName(taken), sizes.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("lent"), F.lit(0))).alias("len"))


def segment_of(i: Column, first: int) -> Column:
    return F.when(i < first, 0).when(i < 3 * first, 1).otherwise(2 + F.floor((i - 3 * first) / (4 * first))).cast("long")


def begin_of(segment: Column, first: int) -> Column:
    return F.when(segment == 0, 0).when(segment == 1, first).otherwise(3 * first + (segment - 2) * 4 * first).cast("long")


def segments(rows: DataFrame, first: int = FIRST) -> DataFrame:
    """(conv_id, segment, key, sizes, before): hashes in a row, bytes of each turn, bytes of all earlier segments."""
    own = rows.groupBy("conv_id", segment_of(F.col("i"), first).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("i", "h", "bytes"))).alias("x"))  # 4 * first turns at most
    own = own.select("conv_id", "segment", F.array_join("x.h", "").alias("key"), F.col("x.bytes").alias("sizes"), F.aggregate("x.bytes", F.lit(0).cast("long"), lambda s, b: s + b).alias("all"))
    earlier = F.sum("all").over(Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    return cut(own.withColumn("before", F.coalesce(earlier, F.lit(0))).drop("all"))


def bytes_to(depth: Column, first: int) -> Column:
    """Bytes of the first ``depth`` turns, from the segment that holds the last of them."""
    return F.col("before") + F.aggregate(F.slice("sizes", F.lit(1), (depth - begin_of(F.col("segment"), first)).cast("int")), F.lit(0).cast("long"), lambda s, b: s + b)


def common(a: str, b: str) -> int:
    """Turns that two rows of hashes begin with in common."""
    if a == b:
        return len(a) // DIGITS
    n, most = 0, min(len(a), len(b)) // DIGITS
    while n < most and a[n * DIGITS : (n + 1) * DIGITS] == b[n * DIGITS : (n + 1) * DIGITS]:
        n += 1
    return n


def _beside(batches):
    """Of rows sorted by (g, key, more, conv_id): turns in common with the row before (null for a range's first)."""
    import pyarrow as pa

    last = None
    for b in batches:
        own = []
        for g, key in zip(b.column("g").to_pylist(), b.column("key").to_pylist(), strict=True):
            own.append(None if last is None else common(last[1], key) if last[0] == g else 0)
            last = (g, key)
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("conv_id", "len", "g", "key", "more", "_part", "_at")], pa.array(own, pa.int64())], names=["conv_id", "len", "g", "key", "more", "_part", "_at", "same"])


def _counted(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds the place, from 0 on, of each row in its group (sorted ranges, see ``operators.ranks``)."""
    counts = rows.groupBy("_part", *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    base = per_range(rows.sparkSession, carried(counts, by), "_base")
    n = F.row_number().over(Window.partitionBy("_part", *by).orderBy("_at")) - 1
    told = rows.withColumn(name, n.cast("long")).join(F.broadcast(base), "_part", "left")
    first = F.col("_at") - F.col(name) == F.shiftleft(F.col("_part").cast("long"), 33)
    return told.withColumn(name, F.col(name) + F.when(first, F.coalesce("_base", F.lit(0))).otherwise(0)).drop("_base")


def ordered(lengths: DataFrame, segs: DataFrame, first: int = FIRST) -> DataFrame:
    """(pos, conv_id, len, a): conversations in order, and the turns that each has in common with the one before.

    One round for each segment that several conversations have in common from the start."""
    spark = lengths.sparkSession
    active = lengths.select("conv_id", "len", F.lit(0).cast("long").alias("g"))
    values = places = None
    k = 0
    while True:
        begin = 0 if k == 0 else first if k == 1 else 3 * first + (k - 2) * 4 * first
        end = begin + first * min(4, 1 << k)
        own = segs.where(F.col("segment") == k).select("conv_id", "key")
        rows = cut(active.join(own, "conv_id", "left").select("conv_id", "len", "g", F.coalesce("key", F.lit("")).alias("key"), (F.col("len") > end).alias("more")))
        s = in_ranges(rows, ["g"], [F.col("key"), F.col("more"), F.col("conv_id")])
        s = cut(s.mapInArrow(_beside, "conv_id long, len long, g long, key string, more boolean, _part int, _at long, same long"))
        # A range's first row is compared with the last of the range before: two keys a range.
        edges = sorted(s.groupBy("_part").agg(F.min_by(F.struct("g", "key"), "_at").alias("head"), F.max_by(F.struct("g", "key"), "_at").alias("tail")).collect(), key=lambda r: r["_part"])
        met = {y["_part"]: common(x["tail"]["key"], y["head"]["key"]) if x["tail"]["g"] == y["head"]["g"] else 0 for x, y in zip(edges, edges[1:])}
        s = s.join(F.broadcast(per_range(spark, met, "_met")), "_part", "left").withColumn("same", F.coalesce("same", "_met")).drop("_met")
        s = _counted(_counted(s, ["g"], "at"), ["g", "key", "more"], "nth")
        a = F.when(F.col("at") == 0, F.lit(-1)).otherwise(F.col("same") + begin)
        s = cut(s.select("conv_id", "len", "at", (F.col("g") + F.col("at")).alias("pos"), "more", "nth", a.cast("long").alias("a")))
        many = s.where("more and nth = 1").select((F.col("pos") - 1).alias("pos"), F.lit(True).alias("many"))
        s = cut(s.join(many, "pos", "left").withColumn("on", F.col("more") & ((F.col("nth") > 0) | F.coalesce("many", F.lit(False)))))
        # What the first place of a group has in common with the place before it was told in the round before.
        told = s.where(~(F.col("more") & (F.col("nth") > 0)) & (F.lit(k == 0) | (F.col("at") > 0))).select("pos", "a")
        done = s.where(~F.col("on")).select("pos", "conv_id", "len")
        values, places = (told, done) if k == 0 else (values.unionByName(told), places.unionByName(done))
        active = s.where("on").select("conv_id", "len", (F.col("pos") - F.col("nth")).alias("g"))
        if active.isEmpty():
            return cut(places.join(values, "pos"))
        k += 1


class Blocks:
    """Few numbers for each block of places: minima of ``a`` and of conv_id, running sums."""

    def __init__(self, rows: list):
        import numpy as np

        rows = sorted(rows, key=lambda r: r["block"])
        self.least = np.array([r["least"] for r in rows], np.int64)
        self.conv = np.array([r["conv"] for r in rows], np.int64)
        self.shared = np.concatenate([[0], np.cumsum([r["shared"] for r in rows])]).astype(np.int64)
        self.leaves = np.concatenate([[0], np.cumsum([r["leaves"] for r in rows])]).astype(np.int64)

    #: Blocks that are looked through at once.
    STRIDE = 256

    def left(self, block: int, x: int) -> int:
        """The last block before ``block`` with a value less than x."""
        import numpy as np

        while block > 0:
            lo = max(0, block - self.STRIDE)
            if len(hit := np.flatnonzero(self.least[lo:block] < x)):
                return lo + int(hit[-1])
            block = lo
        return -1

    def right(self, block: int, x: int) -> int:
        import numpy as np

        at = block + 1
        while at < len(self.least):
            if len(hit := np.flatnonzero(self.least[at : at + self.STRIDE] < x)):
                return at + int(hit[0])
            at += self.STRIDE
        return -1


def smaller(a: list[int]) -> tuple[list[int], list[int]]:
    """For each place of a block the nearest smaller value's place to the left (-1: none) and to the right (n: none)."""
    left, right, stack = [-1] * len(a), [len(a)] * len(a), []
    for i, x in enumerate(a):
        while stack and a[stack[-1]] > x:
            right[stack.pop()] = i
        if stack:
            left[i] = left[stack[-1]] if a[stack[-1]] == x else stack[-1]
        stack.append(i)
    return left, right


def least_within(values, lo, hi):
    """Minima of values[lo..hi], both included, by a table of minima over powers of two."""
    import numpy as np

    table = [np.asarray(values, np.int64)]
    while 1 << len(table) <= len(table[0]):
        half, last = 1 << (len(table) - 1), table[-1]
        table.append(np.minimum(last[:-half], last[half:]))
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out = np.empty(len(lo), np.int64)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(table[k][lo[at]], table[k][hi[at] - (1 << int(k)) + 1])
    return out


_FULL = "block long, pos long, conv_id long, len long, a long, nxt long, leaf long, left long, right long, left_block long, right_block long, mn long, from_here long, to_here long, shared_to long, leaves_to long"


def _first_pass(blocks):
    """Of one block: what it settles by itself, and the blocks that hold the rest."""

    def run(t):
        import numpy as np
        import pyarrow as pa

        t = t.sort_by("pos")
        own = blocks.value
        block, pos, a, conv = t.column("block")[0].as_py(), t.column("pos").to_numpy(), t.column("a").to_pylist(), t.column("conv_id").to_numpy()
        n = len(a)
        left, right = (np.array(x, np.int64) for x in smaller(a))
        to_left = {x: own.left(block, x) for x in {a[i] for i in np.flatnonzero(left < 0)}}
        to_right = {x: own.right(block, x) for x in {a[i] for i in np.flatnonzero(right == n)}}
        inside = np.flatnonzero((left >= 0) & (right < n))
        mn = np.zeros(n, np.int64)
        if len(inside):
            mn[inside] = least_within(conv, left[inside], right[inside] - 1)
        some = lambda values, ok: pa.array(values, pa.int64(), mask=~ok)
        lb, rb = np.array([to_left.get(x, -1) for x in a], np.int64), np.array([to_right.get(x, -1) for x in a], np.int64)
        known = np.zeros(n, bool)
        known[inside] = True
        # No smaller value to the right at all: the interval ends with the last place.
        last = own.places
        right_known = (right < n) | (rb < 0)
        right_at = np.where(right < n, pos[0] + right, last)
        leaf = t.column("leaf").to_numpy()
        columns = [t.column("block").combine_chunks(), pa.array(pos), pa.array(conv), *[t.column(c).combine_chunks() for c in ("len", "a", "nxt", "leaf")]]
        columns += [some(pos[0] + left, left >= 0), some(right_at, right_known), some(lb, (left < 0) & (lb >= 0)), some(rb, ~right_known), some(mn, known)]
        columns += [pa.array(np.minimum.accumulate(conv[::-1])[::-1].copy()), pa.array(np.minimum.accumulate(conv))]
        columns += [pa.array(own.shared[block] + np.cumsum(t.column("shared").to_numpy())), pa.array(own.leaves[block] + np.cumsum(leaf))]
        return pa.Table.from_arrays(columns, names=[x.split()[0] for x in _FULL.split(", ")])

    return run


def _answers(places, asked):
    """In a block that holds the answers: for each x the last place (side 0) or the first (side 1) with a value less than x."""
    import numpy as np
    import pyarrow as pa

    places = places.sort_by("pos")
    pos, a = places.column("pos").to_numpy(), places.column("a").to_numpy()
    x, side = asked.column("x").to_numpy(), asked.column("side").to_numpy()
    at = np.zeros(len(x), np.int64)
    if len(x):
        at = np.where(side == 0, np.searchsorted(np.minimum.accumulate(a[::-1])[::-1], x, "left") - 1, np.searchsorted(-np.minimum.accumulate(a), -x, "right"))
    return pa.Table.from_arrays([asked.column("block").combine_chunks(), pa.array(x), pa.array(side), pa.array(pos[at])], names=["block", "x", "side", "at"])


def settled(order: DataFrame, segs: DataFrame, first: int, block: int | None) -> tuple[DataFrame, Blocks]:
    """All places with their nearest smaller values (``left``, ``right``), running sums and minima."""
    n = order.count()
    width = block or max(LEAST_BLOCK, -(-n // MAX_BLOCKS))
    nxt = order.select((F.col("pos") - 1).alias("pos"), F.col("a").alias("nxt"))
    # Bytes that a conversation has in common with the one before: from the segment in which they part.
    told = order.where("a > 0").withColumn("segment", segment_of(F.col("a") - 1, first)).join(segs.select("conv_id", "segment", "sizes", "before"), ["conv_id", "segment"])
    told = told.select("pos", bytes_to(F.col("a"), first).alias("shared"))
    p = order.join(nxt, "pos", "left").join(told, "pos", "left").withColumn("nxt", F.coalesce("nxt", F.lit(-1)))
    p = cut(p.select(F.floor(F.col("pos") / width).alias("block"), "pos", "conv_id", "len", "a", "nxt", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"), (F.col("nxt") < F.col("len")).cast("long").alias("leaf")))
    blocks = Blocks(p.groupBy("block").agg(F.min("a").alias("least"), F.min("conv_id").alias("conv"), F.sum("shared").alias("shared"), F.sum("leaf").alias("leaves")).collect())  # MAX_BLOCKS at most
    blocks.places = n
    sent = order.sparkSession.sparkContext.broadcast(blocks)
    one = cut(p.groupBy("block").applyInArrow(_first_pass(sent), _FULL))
    open_left = one.where("left_block is not null").select("block", F.col("a").alias("x"), F.col("left_block").alias("target"), F.lit(0).alias("side"))
    open_right = one.where("right_block is not null").select("block", F.col("a").alias("x"), F.col("right_block").alias("target"), F.lit(1).alias("side"))
    asked = cut(open_left.unionByName(open_right).distinct())
    distinct = asked.select(F.col("target").alias("block"), "x", F.col("side").cast("long").alias("side")).distinct()
    found = p.select("block", "pos", "a").groupBy("block").cogroup(distinct.groupBy("block")).applyInArrow(_answers, "block long, x long, side long, at long")
    found = asked.join(found.withColumnRenamed("block", "target"), ["target", "x", "side"]).select("block", F.col("x").alias("a"), "side", "at")
    # In a block, all places that have nothing smaller on one side and are equal share an answer.
    for side, name in ((0, "left"), (1, "right")):
        one = one.join(found.where(F.col("side") == side).select("block", "a", F.col("at").alias("far")), ["block", "a"], "left").withColumn(name, F.coalesce(name, "far")).drop("far")
    return cut(one), blocks


def nodes(full: DataFrame, blocks: Blocks) -> DataFrame:
    """One row for each branching, ending or shared stretch: l, r, d (depth), pd and pl (parent's depth and left end),
    mn (least member), n, shared, leaves, kids, parent (the parent's least member)."""
    sent = full.sparkSession.sparkContext.broadcast(blocks.conv)
    inner = full.where("a >= 0").groupBy(F.col("left").alias("l"), F.col("a").alias("d")).agg((F.max("right") - 1).alias("r"), F.max("mn").alias("mn"))
    alone = full.where(F.col("len") > F.greatest("a", "nxt")).select(F.col("pos").alias("l"), F.col("len").alias("d"), F.col("pos").alias("r"), F.col("conv_id").alias("mn"))
    at_l = full.select(F.col("pos").alias("l"), F.col("conv_id").alias("lc"), F.col("a").alias("al"), F.col("left").alias("ll"), F.col("from_here").alias("fl"), F.col("block").alias("bl"), F.col("shared_to").alias("sl"), (F.col("leaves_to") - F.col("leaf")).alias("vl"))
    at_r = full.select(F.col("pos").alias("r"), F.col("nxt").alias("ar"), F.col("to_here").alias("tr"), F.col("block").alias("br"), F.col("shared_to").alias("sr"), F.col("leaves_to").alias("vr"))
    x = inner.unionByName(alone).join(at_l, "l").join(at_r, "r")
    # Within one block that is not settled inside it, the interval reaches to the block's end.
    mn = F.coalesce("mn", F.when(F.col("bl") == F.col("br"), F.col("fl")).otherwise(F.least("fl", "tr")))
    x = x.select("l", "r", "d", "lc", F.greatest("al", "ar").alias("pd"), F.when(F.col("al") < F.col("ar"), F.col("l")).otherwise(F.col("ll")).alias("pl"), mn.alias("mn"), F.when(F.col("mn").isNull(), F.col("bl")).alias("bl"), "br", (F.col("r") - F.col("l") + 1).alias("n"), (F.col("sr") - F.col("sl")).alias("shared"), (F.col("vr") - F.col("vl")).alias("leaves"))

    def between(batches):
        """Whole blocks inside an interval, by the blocks' minima."""
        import numpy as np
        import pyarrow as pa

        for b in batches:
            bl, br, mn = b.column("bl").fill_null(-2).to_numpy(), b.column("br").to_numpy(), b.column("mn").to_numpy().copy()
            wide = np.flatnonzero((bl >= 0) & (br > bl + 1))
            if len(wide):
                mn[wide] = np.minimum(mn[wide], least_within(sent.value, bl[wide] + 1, br[wide] - 1))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("l", "r", "d", "lc", "pd", "pl")], pa.array(mn), *[b.column(c) for c in ("n", "shared", "leaves")]], names=["l", "r", "d", "lc", "pd", "pl", "mn", "n", "shared", "leaves"])

    x = cut(x.mapInArrow(between, ", ".join(f"{c} long" for c in ("l", "r", "d", "lc", "pd", "pl", "mn", "n", "shared", "leaves"))))
    kids = x.where("pd >= 0").groupBy("pl", "pd").agg(F.count("*").alias("kids"))
    x = cut(x.join(kids.select(F.col("pl").alias("l"), F.col("pd").alias("d"), "kids"), ["l", "d"], "left").withColumn("kids", F.coalesce("kids", F.lit(0))))
    # The root may have most of the nodes as children.
    parents = x.where("kids > 0").select(F.col("l").alias("pl"), F.col("d").alias("pd"), F.col("mn").alias("parent"), F.col("kids").alias("times"))
    return lookup(x, parents, ["pl", "pd"], "times")


def endings(full: DataFrame) -> DataFrame:
    """(l, d, ends): for each node at which conversations end the SHA-256 of their ids.

    They stand side by side, in order of ids.  A block's part of them becomes one string; a node's strings are
    streamed through the hash in order, however many there are."""
    left = F.when(F.col("a") == F.col("len"), F.col("left")).otherwise(F.col("pos"))
    part = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "conv_id"))), lambda x: x["conv_id"].cast("string")), ",")  # a block at most
    parts = full.groupBy(left.alias("l"), F.col("len").alias("d"), "block").agg(part.alias("ids"))

    def run(batches):
        import pyarrow as pa

        now, sha, out = None, None, []
        for b in batches:
            for l, d, ids in zip(b.column("l").to_pylist(), b.column("d").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if now == (l, d):
                    sha.update(f",{ids}".encode())
                    continue
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (l, d), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["l", "d", "ends"])
                out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, sha.hexdigest())], names=["l", "d", "ends"])

    return parts.repartition("l", "d").sortWithinPartitions("l", "d", "block").mapInArrow(run, "l long, d long, ends string")


def expanded(stretches: DataFrame, ends: DataFrame, segs: DataFrame, first: int) -> DataFrame:
    """A row for each depth from the parent's, exclusive, to the node's."""
    x = stretches.join(ends, ["l", "d"], "left").withColumn("from", F.explode(F.expr(f"sequence(pd + 1, d, {CHAIN}L)")))
    x = x.withColumn("depth", F.explode(F.expr(f"sequence(from, least(from + {CHAIN - 1}L, d))")))
    last = F.col("depth") == F.col("d")
    top = F.col("depth") == F.col("pd") + 1
    x = x.select("lc", "depth", F.col("mn").alias("conv_id"), F.when(top, F.col("parent")).otherwise(F.col("mn")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(last, F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), "shared", F.when(last, F.coalesce("ends", F.lit(EMPTY_SHA))).otherwise(EMPTY_SHA).alias("ends_sha256"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves"]
    # Bytes above a node count once for each member but the first; where there is one member, or nothing above, they do not matter.
    plain = (F.col("n_convs") == 1) | (F.col("depth") <= 1)
    few = x.where(plain).select(*columns, F.col("shared").alias("saved_tokens"), "ends_sha256")
    deep = x.where(~plain).withColumn("segment", segment_of(F.col("depth") - 2, first)).join(segs.select(F.col("conv_id").alias("lc"), "segment", "sizes", "before"), ["lc", "segment"])
    return few.unionByName(deep.select(*columns, (F.col("shared") - (F.col("n_convs") - 1) * bytes_to(F.col("depth") - 1, first)).alias("saved_tokens"), "ends_sha256"))


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", family: int = FAMILY, most: int = MOST_SHARED, first: int = FIRST, block: int | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    rows, lengths = rebuilt(turns_of(df, conv, turn, role, text), family, most)
    segs = segments(rows, first)
    full, blocks = settled(ordered(cut(lengths), segs, first), segs, first, block)
    return expanded(nodes(full, blocks), endings(full), segs, first)
