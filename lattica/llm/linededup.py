"""Line dedup by the number of distinct sites, with DataFrame functions only.

A line (trimmed; blank ones are left alone) is judged by how many distinct sites (``source``) it stands on:

* a line of at most SHORT_WORDS words on SITES or more sites, and in TIMES or more places, goes everywhere;
* a longer line on SITES or more sites stays in its first document only;
* so does a passage of over LONG_WORDS words on LONG_SITES or more sites.

The first document is the one of the least doc_id (where no place has one, of the least text hash).

Lines are counted by a 128-bit hash.  A first aggregation keeps the lines seen on two sites at least (by least and
greatest site hash), and short ones in TIMES places.  Of their places, as they stand, HyperLogLog sketches of the sites are
made on the way into the shuffle and merged by aggregation: a common line moves one sketch for each task that meets it.
Where the estimate is within MARGIN of the threshold, and only there, distinct (line, site) rows are made, and
their exact number decides; a sketch decides only far from it.  Nothing is gathered per line, and a line that very many
documents share is joined by broadcast.

Null texts stay null, null sites are one site of their own, null doc_ids come last, repeated rows count as often as they
stand and are the same document, and an empty table stays empty.  Other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup

SITES = 5
TIMES = 10
SHORT_WORDS = 6
LONG_WORDS = 50
LONG_SITES = 2
MARGIN = 0.25
LG_K = 12


def line_key(line):
    return F.struct(F.xxhash64(line, F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), line).alias("h2"))


def places_of(documents: DataFrame, text: str = "text", site: str = "source", key: str = "doc_id") -> DataFrame:
    """(site, id, t, size, h1, h2) of each line: hashes of site and line, the document's id or else text hash, and whether the line is
    long (1) or a passage (2)."""
    rows = documents.select(F.xxhash64(F.coalesce(F.col(site).cast("string"), F.lit("\0"))).alias("site"), F.col(key).cast("long").alias("id"), F.when(F.col(key).isNull(), F.xxhash64(text)).alias("t"), F.explode(F.split(F.col(text), "\n")).alias("line"))
    rows = rows.withColumn("line", F.trim("line")).where("line <> ''").withColumn("words", F.size(F.split("line", " +")))
    size = F.when(F.col("words") > LONG_WORDS, 2).when(F.col("words") > SHORT_WORDS, 1).otherwise(0).alias("size")
    return rows.select("site", "id", "t", size, line_key(F.col("line")).alias("k")).select("site", "id", "t", "size", "k.h1", "k.h2")


def candidates(places: DataFrame, sites: int = SITES, times: int = TIMES) -> DataFrame:
    """(h1, h2, n, size, first, first_text) of lines on several sites."""
    # All aggregates are numbers, so that partial sums fit a hash table whatever the number of lines.
    spread = places.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("site").alias("a"), F.max("site").alias("b"), F.max("size").alias("size"), F.min("id").alias("first"), F.min("t").alias("first_text"))
    several = (F.col("a") < F.col("b")) | F.lit(sites <= 1)
    return spread.where((several & ((F.col("size") > 0) | (F.col("n") >= times)))).drop("a", "b")


def estimates(places: DataFrame, lines: DataFrame) -> DataFrame:
    """(h1, h2, est, own): the sites of the given lines, by sketches of all their places, and what ``lines`` says of them."""
    said = lines.select("h1", "h2", "n", F.struct("n", "size", "first", "first_text").alias("own"))
    hit = lookup(places.select("h1", "h2", "site"), said, ["h1", "h2"], "n", "inner")
    return hit.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("est"), F.first("own").alias("own"))


def near_sites(places: DataFrame, near: DataFrame) -> DataFrame:
    """Distinct (h1, h2, site) of the lines whose estimate is near a threshold, and of no others."""
    hit = lookup(places.select("h1", "h2", "site"), near.select("h1", "h2", "own.n"), ["h1", "h2"], "n", "inner")
    return hit.groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).drop("one")


def repeated(documents: DataFrame, text: str = "text", site: str = "source", key: str = "doc_id", sites: int = SITES, times: int = TIMES) -> DataFrame:
    """(h1, h2, n, all, first, first_text) of lines to remove: places, whether all go, and else the first document's id or text hash."""
    places = places_of(documents, text, site, key)
    told = cut(estimates(places, cut(candidates(places, sites, times))))
    low, high = sites * (1 - MARGIN), sites * (1 + MARGIN)
    # A passage needs two sites, which all that are left have.
    sure = (F.col("est") > high) | (F.col("own.size") == 2) & F.lit(LONG_SITES <= 2)
    near = told.where(~sure & (F.col("est") >= low))
    exact = near_sites(places, near).groupBy("h1", "h2").agg(F.count("*").alias("d")).where(F.col("d") >= sites).select("h1", "h2")
    found = told.where(sure).unionByName(near.join(exact, ["h1", "h2"], "left_semi"))
    return cut(found.select("h1", "h2", "own.n", (F.col("own.size") == 0).alias("all"), "own.first", "own.first_text"))


def remove(documents: DataFrame, lines: DataFrame, text: str = "text", key: str = "doc_id", counted: bool = False) -> DataFrame:
    """documents without the given lines; if ``counted``, with the numbers of lines and of removed ones as last columns
    ``n_lines`` and ``n_removed``."""
    names = [f"c{i}" for i in range(len(documents.columns))]
    named = dict(zip(documents.columns, names, strict=True))
    rows = documents.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()])
    body, own = F.col(named[text]), F.col(named[key]).cast("long")
    # A document is known by two hashes of its id and text.
    marked = rows.withColumn("_t", F.xxhash64(own, body)).withColumn("_u", F.xxhash64(F.lit(3), body, own))
    places = marked.select("_t", "_u", own.alias("_id"), F.when(own.isNull(), F.xxhash64(body)).alias("_text"), F.posexplode(F.split(body, "\n")).alias("_i", "_line"))
    places = places.withColumn("_k", line_key(F.trim("_line"))).select("_t", "_u", "_i", "_id", "_text", F.col("_k.h1").alias("h1"), F.col("_k.h2").alias("h2"))
    hit = lookup(places, lines, ["h1", "h2"], "n", "inner")
    stays = ~F.col("all") & F.coalesce(F.col("first") == F.col("_id"), F.col("first").isNull() & (F.col("first_text") == F.col("_text")), F.lit(False))
    gone = hit.where(~stays).groupBy("_t", "_u").agg(F.collect_set("_i").alias("_gone"))
    # Kept, so that the join deals both sides anew and Spark may split the rows of one text that stands very often.
    out = marked.join(cut(gone), ["_t", "_u"], "left").withColumn("_all", F.split(body, "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), "_gone")  # by a hash set: linear in the lines
    kept = F.when(F.col("_gone").isNull(), body).otherwise(F.array_join(F.transform(left, lambda i: F.get("_all", i)), "\n"))
    more = [F.coalesce(F.size("_all"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed")] if counted else []
    return out.select(*[(kept if c == text else F.col(n)).alias(c) for c, n in named.items()], *more)


def dedup_lines(documents: DataFrame, text: str = "text", site: str = "source", key: str = "doc_id", sites: int = SITES, times: int = TIMES, counted: bool = False) -> DataFrame:
    return remove(documents, repeated(documents, text, site, key, sites, times), text, key, counted)
