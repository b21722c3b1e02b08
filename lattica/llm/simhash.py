"""SimHash near-duplicates by multi-index hashing.

Fingerprint: lower-cased words, 3-word shingles with repeats, XXH64 (seed 42) of each; a bit
is set if it is set in over half of the hashes.  Texts without words have fingerprint zero.

Links are sought between distinct fingerprints only (copies of a text share theirs).  Two
fingerprints that differ in 3 bits or fewer agree in one 32-bit half up to one bit, so each
fingerprint looks up the 33 values of the Hamming ball of radius 1 around each of its halves
in a table keyed by half, and whole distances are verified on the matches.

A half that very many distinct fingerprints share would make the number of matches grow with
the square of the group, and so would a half beside it, whose few entries meet all its probes.
Halves with more than ``HOT`` entries, and all halves within one bit of such, leave the join and
are compared in numpy blocks instead, cut by the number of entries and by the number of probes
alike; a block pair returns only the links that its spanning forest needs, so what is emitted
grows linearly, and no link's effect is lost.  All other halves have at most ``HOT`` entries and
33 ``HOT`` probes.

Components come from alternating large-star and small-star rounds on the links, until a round
changes nothing.  Rows of a fingerprint that very many texts share are not gathered.  Nulls count
as empty texts, rows without doc_id are classed like others but never name a component;
repeated rows are returned as often as given; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_of, lookup, per_text

BITS = 3
SHINGLE = 3
#: A half value with more distinct fingerprints than this is compared in blocks of BLOCK.
HOT = 64
BLOCK = 2048
#: Hot halves that are sent to every executor at most (24 bytes each), so that their entries are dealt to blocks where
#: they stand; with more, they are joined by shuffle.
BROADCAST_HALVES = 100_000


def fingerprint(text: str, k: int = SHINGLE) -> int:
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= k:
        hashes = [digest(join(words), 42)]
    elif k == 3:
        hashes = [digest(b"%b %b %b" % t, 42) for t in zip(words, words[1:], words[2:])]
    else:
        hashes = [digest(join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    h, total = np.array(hashes, dtype="<u8"), np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        part = h[i : i + 65536].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(total * 2 > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, row: str | None = None) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), and the rows' numbers if ``row`` names a column of them."""

    def make(texts):
        import numpy as np
        import pyarrow as pa

        return [pa.array(np.array([fingerprint(t, k) for t in texts], dtype=np.uint64).view(np.int64))]

    return per_text(documents, text, make, "fp long", id_of(key) | ({row: F.col(row)} if row else {}))


def _forest(table, probes, bits: int):
    """Links of a spanning forest of {(x, y): distance <= bits}, x of the table, y of the probes.
    Equal values on both sides are one node."""
    import numpy as np

    keys = np.union1d(table, probes)
    label = np.arange(len(keys))
    to = np.searchsorted(keys, probes)
    for i, x in zip(np.searchsorted(keys, table), table, strict=True):
        near = to[np.bitwise_count(x ^ probes) <= bits]
        away = near[label[near] != label[i]]
        groups, first = np.unique(label[away], return_index=True)
        for j in away[first]:
            yield x, keys[j]
        if len(groups):
            label[np.isin(label, groups)] = label[i]


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints ``fps(fp)``: all of them, but for
    hot halves, whose blocks return spanning forests."""
    if bits > 3:
        raise ValueError("halves with balls of radius 1 find distances up to 3")
    halves = F.array(F.struct(F.lit(0).alias("s"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("h")), F.struct(F.lit(1).alias("s"), F.shiftrightunsigned("fp", 32).alias("h")))
    entries = fps.select("fp", F.inline(halves))
    ball = F.explode(F.array(F.lit(0).cast("long"), *[F.lit(1 << i) for i in range(32)])).alias("m")
    moved = F.col("h").bitwiseXOR(F.col("m")).alias("h")
    probes = entries.select("fp", "s", "h", ball).select(F.col("fp").alias("a"), "s", moved)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= bits
    sizes = entries.groupBy("s", "h").agg(F.count("*").alias("n"))
    most = cut(sizes.where(F.col("n") > HOT))
    if most.isEmpty():
        return probes.join(entries, ["s", "h"]).where((F.col("a") < F.col("fp")) & near).select("a", F.col("fp").alias("b")).distinct()
    # Hot halves and what is within one bit of them, with their entries and their probes.
    around = most.select("s", "h", ball).select("s", moved).distinct()
    around = cut(around.join(sizes, ["s", "h"]))
    probed = around.select("s", "h", ball).select("s", F.col("h").alias("own"), moved).join(sizes, ["s", "h"]).groupBy("s", F.col("own").alias("h")).agg(F.sum("n").alias("p"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    hot = cut(around.join(probed, ["s", "h"]).select("s", "h", blocks("n").alias("nt"), blocks("p").alias("np")))
    if hot.count() <= BROADCAST_HALVES:
        hot = F.broadcast(hot)
    keys = hot.select("s", "h")
    # The probes of hot halves are cut off before the join, so that they meet in no task of it.
    found = probes.join(keys, ["s", "h"], "left_anti").join(entries.join(keys, ["s", "h"], "left_anti"), ["s", "h"]).where((F.col("a") < F.col("fp")) & near).select("a", F.col("fp").alias("b"))
    block = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    # A block pair (i, j) gets table block i and probe block j.
    table = entries.join(hot, ["s", "h"]).select("fp", "s", "h", block("nt").alias("i"), F.explode(F.sequence(F.lit(0), F.col("np") - 1)).alias("j"), F.lit(True).alias("own"))
    probe = probes.withColumnRenamed("a", "fp").join(hot, ["s", "h"]).select("fp", "s", "h", F.explode(F.sequence(F.lit(0), F.col("nt") - 1)).alias("i"), block("np").alias("j"), F.lit(False).alias("own"))

    def compare(pdf):
        import numpy as np
        import pandas as pd

        mine = pdf["own"].to_numpy()
        fp = pdf["fp"].to_numpy(np.int64)
        a, b = np.unique(fp[mine]).view(np.uint64), np.unique(fp[~mine]).view(np.uint64)
        out = np.array([(int(x), int(y)) for x, y in _forest(a, b, bits)], dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": out.min(axis=1) if len(out) else [], "b": out.max(axis=1) if len(out) else []}).astype("int64")

    both = table.unionByName(probe).select("s", "h", "i", "j", "fp", "own")
    forests = both.groupBy("s", "h", "i", "j").applyInPandas(compare, "a long, b long")
    return found.unionByName(forests).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node that has an edge (a, b): the least node of its component.
    Alternating stars until nothing changes; each round is kept in the shared folder."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        # Large star: the greater neighbours of a node join its least neighbour.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its lesser neighbours join the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _rooted(classes: DataFrame, bits: int) -> DataFrame:
    """classes(fp, ...) with the root of each fingerprint's component."""
    roots = components(links(classes.select("fp"), bits))
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def one_of_each(documents: DataFrame, row: str, key: str = "doc_id", text: str = "text", k: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The rows' numbers, one for each component: the row of the least doc_id (nulls last), and of its rows the first."""
    docs = cut(fingerprints(documents, key, text, k, row))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", row)
    named = _rooted(cut(docs.groupBy("fp").agg(F.min(order).alias("first"))), bits)
    return named.groupBy("root").agg(F.min("first").alias("first")).select(F.col(f"first.{row}").alias(row))


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    docs = cut(fingerprints(documents, key, text, k))
    named = cut(_rooted(cut(docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))), bits))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(named.join(least, "root").select("fp", "component_id", "n"))
    return lookup(docs, named, ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
