"""Target-distribution importance resampling over hashed word runs.

Features are runs of words, hashed to buckets.  A bucket's gain is the log ratio of its smoothed share in the target
(the benchmark) to that in the corpus, in thousandths, as a whole number; a document's weight is the mean gain of its
features, read from the array of gains.  Weight plus Gumbel noise, which is a function of the document's id alone, gives
the score, and the highest scores are drawn: that is sampling without replacement in proportion to the weights.

Scores are whole numbers between two fixed bounds, so their histogram is exact and small (some 100,000 entries at most,
whatever the input).  Suffix sums of it say how many rows stand before each score and where the cutoff is.  Rows below
the cutoff are not moved any more; those of one score are numbered by doc_id, within ranges (``operators.ranks``), since
very many may share a score.

Null and empty texts have no features and weight 0, and count in no bucket.  A null doc_id is spelt as the empty string
in the noise and comes last among equals.  Repeated rows are rows of their own, with equal scores; rows of one id that
tie are ordered by their number of features.  An empty corpus or benchmark counts 0 everywhere.  An empty table gives
no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from .common import SLICE, cut, id_of
from .decontaminate import words_of

BUCKETS = 10_000
RUN = 1
SEED = 2024
LEAST_WORDS = 20
#: Of a hundred eligible documents, so many are drawn.
SHARE = 10


def features_of(text: str, run: int = RUN) -> tuple[int, list[bytes]]:
    """Number of words, and all runs of 1 to ``run`` of them."""
    words = words_of(text)
    out = list(words)
    for n in range(2, run + 1):
        out += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return len(words), out


def hashed(features: list[bytes], buckets: int):
    import numpy as np

    return np.fromiter(map(zlib.crc32, features), np.int64, len(features)) % buckets


def bucket_counts(df: DataFrame, text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> list[int]:
    """Features in each bucket.  Each task sends one row for a bucket it has met; ``buckets`` rows reach the driver."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0):
                if t.is_valid:
                    seen += np.bincount(hashed(features_of(t.as_py(), run)[1], buckets), minlength=buckets)
        met = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(seen[met])], names=["bucket", "n"])

    out = [0] * buckets
    for r in df.select(F.col(text)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """In doubles: floor(1000 ln of ((t + 1)(S + buckets) / ((s + 1)(T + buckets))))."""
    n, s_all, t_all = float(len(corpus)), float(sum(corpus)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus, target, strict=True)]


def noise(key: str, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(documents: DataFrame, gain: list[int], key: str = "doc_id", text: str = "text", run: int = RUN, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score."""
    sent = documents.sparkSession.sparkContext.broadcast(gain)
    kept = documents.select(*[c.alias(n) for n, c in id_of(key).items()], F.coalesce(F.col(text), F.lit("")).alias("text"))

    def score(batches):
        import numpy as np
        import pyarrow as pa

        own = np.array(sent.value, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                rows = []
                for who, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    n, found = features_of(t.as_py(), run)
                    weight = int(own[hashed(found, len(own))].sum()) // len(found) if found else 0
                    rows.append((n, len(found), weight, weight + noise("" if who is None else str(who), seed)))
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return kept.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def cutoff(histogram: dict[int, int], draw: int) -> tuple[int | None, dict[int, int]]:
    """The least score of which a row is drawn (None: no row is), and for each score from there on the rows above it."""
    above, before = {}, 0
    for score in sorted(histogram, reverse=True):
        if before >= draw:
            break
        above[score] = before
        before += histogram[score]
    return min(above, default=None), above


def resample(documents: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those that are not drawn."""
    gain = gains(bucket_counts(documents, text, run, buckets), bucket_counts(target, target_text, run, buckets))
    rows = cut(scored(documents, gain, key, text, run, seed))
    fit = F.col("n_words") >= least_words
    histogram = {r.score: r.n for r in rows.where(fit).groupBy("score").agg(F.count("*").alias("n")).collect()}
    draw = share * sum(histogram.values()) // 100
    least, above = cutoff(histogram, draw)
    columns = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    high = fit & (F.col("score") >= least)
    before = rows.sparkSession.createDataFrame(sorted(above.items()), "score long, _before long")
    own = ranked(rows.where(high).select(*columns), ["score"], [F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")], "_own")
    place = F.col("_before") + F.col("_own")
    drawn = own.join(F.broadcast(before), "score").select(*columns, F.when(place <= draw, place).alias("rank"))
    return drawn.unionByName(rows.where(~high).select(*columns, F.lit(None).cast("long").alias("rank")))
