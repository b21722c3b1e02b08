"""URL filter by association rules.

Hand rules (host, path, verdict) judge the urls they fit; the longest that fits wins.  These urls
are also the labels: Spark's FP-growth mines which combinations of url tokens go with a verdict, rules
are pruned by support and confidence (and by shorter rules that say as much), and the other urls get
the verdict of the most confident rule whose tokens they all have, else ``allow``.  Matching goes by an
inverted index: a rule stands under its rarest token, is fetched by the urls that have it, and is
verified against all tokens of the url.  Matching works on distinct token sets.  Verdicts of sets that very many
urls share are sent to where the urls stand; only the urls of other sets are shuffled.

Every label of a host and every segment of a path is a token.  Mining leaves out the tokens that stand in fewer than
``min_support`` of the labelled urls (they can be in no rule).  The number of item sets in a url is two to the power of the
others: FP-growth takes the urls that have ``MAX_MINED`` of them at most, and rules of longer ones are built up token by token,
without item sets that say no more than shorter ones; rules of both kinds are then counted over all labelled urls.

A null url, or one without ``://``, has an empty host and path and is allowed.  Repeated rows are judged
each; an empty table gives an empty result; other columns are ignored; with no labelled url nothing is mined.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup

#: (host, path, verdict), as the contract has them.
RULES = [("com", "en/", "block"), ("example.com", "en/7", "allow"), ("net", "de/", "allow"), ("example.net", "de/8", "block"), ("org", "es/", "block")]
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
#: Tokens of one url that FP-growth takes at most; longer urls go the other way.
MAX_MINED = 12
#: A little under one, against rounding where candidates are chosen.
_LESS = 1 - 1e-9
#: Rules that are sent to every executor at most.
BROADCAST_RULES = 20_000


def lower_ascii(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str):
    """Columns host and path of a url column; the path without its leading slash is what rules name."""
    after = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = lower_ascii(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host.alias("host"), path.alias("path")


def hand_rule(rules, host, path):
    """The longest rule that fits, as struct(rule, verdict), or null."""
    found = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + "/" + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        value = F.struct(F.lit(f"{h}/{p}").alias("rule"), F.lit(v).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def tokens(host, path):
    """Distinct tokens: labels of the host by depth from its end, path segments with digits as #."""
    labels = F.reverse(F.split(host, r"\."))
    h = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    segs = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda x: x != "")
    p = F.transform(segs, lambda x: F.concat(F.lit("p:"), x))
    return F.array_sort(F.array_distinct(F.concat(h, p)))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (id, items, verdict, confidence, support) from labelled(items, verdict)."""
    from pyspark.ml.fpm import FPGrowth

    n = labelled.count()
    # (Tokens of a url on average) / min_support tokens at most, whatever the table's size.
    held = labelled.select(F.explode("items").alias("x")).groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") >= min_support * n)
    often = [r.x for r in held.orderBy(F.desc("n"), "x").collect()]
    own = F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isin(often)))) if often else F.array().cast("array<string>")
    labelled = labelled.select(own.alias("items"), "verdict")
    sets = cut(labelled.groupBy("items", "verdict").agg(F.count("*").alias("n")))
    long = sets.where(F.size("items") > MAX_MINED)
    whole = long.isEmpty()
    baskets = labelled.where(F.size("items") <= MAX_MINED).select(F.concat("items", F.array(F.concat(F.lit("y:"), F.col("verdict")))).alias("items"))
    # Of the short ones alone, candidates: what they lack of the support by rounding is told when all urls are counted.
    bounds = {"minSupport": min_support, "minConfidence": min_confidence} if whole else {"minSupport": min_support * _LESS, "minConfidence": 0.0}
    found = FPGrowth(itemsCol="items", **bounds).fit(baskets).associationRules
    found = found.where(F.startswith(F.col("consequent")[0], F.lit("y:"))).select(F.array_sort("antecedent").alias("items"), F.substring(F.col("consequent")[0], 3, 99).alias("verdict"), "confidence", "support")
    if not whole:
        found = _weighed(found.select("items").unionByName(_of_long(long, sets, min_support)).distinct(), sets)
        found = found.select("items", "verdict", (F.col("m") / F.col("n")).alias("confidence"), (F.col("m") / F.lit(float(n))).alias("support"), "m").where((F.col("m") >= math.ceil(min_support * n)) & (F.col("confidence") >= min_confidence)).drop("m")
    found = cut(found.withColumn("id", F.concat_ws(" ", "items", "verdict")))
    # A rule adds nothing if a shorter one within it, one token less, says the same at least as surely.
    less = found.select("id", "confidence", "verdict", "items", F.explode("items").alias("x")).select("id", "verdict", "confidence", F.array_sort(F.array_remove("items", F.col("x"))).alias("items"))
    idle = less.alias("l").join(found.alias("r"), (F.col("l.items") == F.col("r.items")) & (F.col("l.verdict") == F.col("r.verdict")) & (F.col("r.confidence") >= F.col("l.confidence"))).select(F.col("l.id").alias("id")).distinct()
    return found.join(idle, "id", "left_anti")


def _weighed(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """(items, verdict, m, n) of candidates(items): how many labelled urls have all the items, of a verdict and in all."""
    need = candidates.select(F.col("items").alias("need"), F.element_at("items", -1).alias("x"))
    met = sets.withColumn("x", F.explode("items")).join(need, "x").where(F.size(F.array_except("need", "items")) == 0)
    by = met.groupBy(F.col("need").alias("items"), "verdict").agg(F.sum("n").alias("m"))
    return by.join(by.groupBy("items").agg(F.sum("m").alias("n")), "items")


def _of_long(long: DataFrame, sets: DataFrame, min_support: float) -> DataFrame:
    """(items) of rules that may stand in urls of more than ``MAX_MINED`` tokens, of any length, token by token.

    Item sets that as many urls have as one of their subsets with one token less are left out, and so is all that contains them:
    such a rule says what the shorter one says.  What often occurs together thus multiplies nothing.  A rule that has the
    support in all urls has it among the short ones, where FP-growth finds it, or among the long ones, where it is found here."""
    least = min_support * _LESS * long.agg(F.sum("n").alias("n")).first().n
    often = lambda df: df.groupBy("a", "verdict").agg(F.sum("n").alias("m")).where(F.col("m") >= least).select("a").distinct()
    rows = long.select("items", "verdict", "n", F.explode("items").alias("x")).withColumn("a", F.array("x")).drop("x")
    size = lambda a: cut(_weighed(a.select(F.col("a").alias("items")), sets).select("items", "n").distinct())
    level = size(often(rows))
    out = level
    while not level.isEmpty():
        rows = cut(rows.join(level.select(F.col("items").alias("a")), "a", "left_semi"))
        rows = rows.withColumn("x", F.explode(F.filter("items", lambda x: x > F.element_at("a", -1)))).withColumn("a", F.concat("a", F.array("x"))).drop("x")
        more = size(often(rows))
        parts = more.select("items", "n", F.explode("items").alias("x")).select(F.col("items").alias("whole"), F.col("n").alias("k"), F.array_remove("items", F.col("x")).alias("items"))
        free = parts.join(level, "items").where("n > k").groupBy(F.col("whole").alias("items")).agg(F.count("*").alias("c"), F.max("k").alias("n")).where(F.col("c") == F.size("items"))
        level = cut(free.select("items", "n"))
        out = out.unionByName(level)
    return out.select("items")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(items, mined) of the token sets that some rule fits; the most confident rule decides,
    then support, then the rule's text."""
    need = rules.select("id", F.explode("items").alias("x"))
    held = sets.select(F.explode("items").alias("x")).join(F.broadcast(need.select("x").distinct()), "x", "left_semi").groupBy("x").agg(F.count("*").alias("n"))
    index = need.join(held, "x", "left").groupBy("id").agg(F.min_by("x", F.struct(F.coalesce("n", F.lit(0)), "x")).alias("x")).join(rules, "id").withColumnRenamed("items", "need")
    index = cut(index)
    if index.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    found = sets.select("items", F.explode("items").alias("x")).join(index, "x").where(F.size(F.array_except("need", "items")) == 0)
    return found.groupBy("items").agg(F.max_by("verdict", F.struct("confidence", "support", "id")).alias("mined"))


def judge(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    p = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("u"))
    p = p.select("page_id", *parts("u"))
    p = p.withColumn("hand", hand_rule(rules, F.col("host"), F.col("path"))).withColumn("items", tokens(F.col("host"), F.col("path")))
    mining = F.col("hand").isNull() & (F.col("host") != "")
    labelled = p.where("hand is not null and host <> ''").select("items", F.col("hand.verdict").alias("verdict"))
    sets = cut(p.where(mining).groupBy("items").agg(F.count("*").alias("n")))
    mined = sets.join(match(sets.select("items"), mine(labelled, min_support, min_confidence)), "items", "left")
    # Urls that a hand rule judges, or that have no host, meet no rule; the others look their token set up.
    free = lookup(p.where(mining).select("page_id", "host", "path", "items"), cut(mined), ["items"], "n").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("mined", F.lit("allow")).alias("verdict"))
    return free.unionByName(p.where(~mining).select("page_id", "host", "path", F.col("hand.rule").alias("rule"), F.coalesce("hand.verdict", F.lit("allow")).alias("verdict")))
