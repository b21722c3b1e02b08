"""Quality classifier: votes of near labelled texts in a latent-semantic space.

A text's terms are hashed byte trigrams and a few shape terms (share of distinct words, of capitals, of
marks, line lengths), weighted by logarithmic frequency and the labelled sample's inverse document frequency.  A truncated SVD
of the labelled term matrix gives the latent space.  The labelled vectors (at most ``MAX_LABELLED``, half
of each class where there are so many, taken by hash of doc_id; the bound is the parameter) are
broadcast; every document is compared with all of them in exact blocked cosine products, and its
K nearest vote, weighted by similarity and by how many labelled rows of its class each stands for.  The
labelled vector of the very text that is scored has no vote.

Null and empty texts have a score as well (their shape terms).  Labels on null or unknown doc_ids do not
count; a doc_id with several labels counts once for each; without labels of both classes every score is the
share of label 1 (or 0.5).  Repeated rows and other columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_of, per_text, rows_where

TERMS = 2048
SHAPES = 64
RANK = 48
MAX_LABELLED = 3000
K = 15
THRESHOLD = 0.7


def terms(text: str):
    """Counts of a text's terms: TERMS trigram slots, then one-hot shape slots."""
    import numpy as np

    raw = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8)
    v = np.zeros(TERMS + SHAPES, np.float32)
    if len(b) > 2:
        x = b.astype(np.uint32)
        h = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(21)
        v[:TERMS] = np.bincount(h, minlength=TERMS)
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(b))
    upper = int(((b >= 65) & (b <= 90)).sum())
    marks = int((((b >= 33) & (b <= 47)) | ((b >= 58) & (b <= 64)) | (b >= 91) & (b <= 96) | (b >= 123) & (b <= 126)).sum())
    digits = int(((b >= 48) & (b <= 57)).sum())
    same = sum(p == q for p, q in zip(words, words[1:]))
    lines = raw.count(b"\n") + 1
    shares = (len(set(words)) / n, upper / size * 2, marks / size * 3, digits / size * 3, same / n, min(1.0, n / lines / 200), min(1.0, len(words) ** 0.5 / 100), len(set(raw.split(b"\n"))) / lines)
    for i, s in enumerate(shares):
        v[TERMS + 8 * i + min(7, int(8 * s))] = 1
    return v


def weigh(counts, idf):
    import numpy as np

    x = np.log1p(counts)
    x[:, :TERMS] /= np.maximum(np.linalg.norm(x[:, :TERMS], axis=1, keepdims=True), 1e-6)
    x[:, TERMS:] *= 0.5
    return x * idf


def unit(x):
    import numpy as np

    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def latent(counts, rank: int = RANK):
    """idf and the projection onto the first singular vectors (randomised range finder)."""
    import numpy as np

    n = len(counts)
    idf = (np.log((1 + n) / (1 + (counts > 0).sum(axis=0))) + 0.2).astype(np.float32)
    x = weigh(counts, idf)
    q = np.random.default_rng(7).standard_normal((x.shape[1], rank + 16)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return idf, (q @ vt.T)[:, :rank].astype(np.float32)


def vote(z, known, labels, k: int = K, stands_for=None, own=None):
    """Similarity-weighted share of label 1 among the k nearest; ``stands_for`` is how many labelled rows each
    stands for.  Neighbours that tie at the k-th place share the places that are left.  ``own`` names, for each row,
    the labelled vectors of the very same text: a text's own label is no neighbour's."""
    import numpy as np

    out = np.empty(len(z))
    for i in range(0, len(z), 256):
        sims = z[i : i + 256] @ known.T
        for j, mine in enumerate(own[i : i + 256] if own is not None else ()):
            if mine and len(mine) < sims.shape[1]:
                sims[j, mine] = -2
        kk = min(k, sims.shape[1])
        least = -np.partition(-sims, kk - 1, axis=1)[:, kk - 1 : kk]
        above, level = sims > least, sims == least
        share = above + level * ((kk - above.sum(axis=1, keepdims=True)) / level.sum(axis=1, keepdims=True))
        w = np.maximum(sims, 1e-6)
        w = w * w
        w = w * w * share * (sims > -1.5)
        w = w if stands_for is None else w * stands_for
        out[i : i + 256] = (w @ labels) / np.maximum(w.sum(axis=1), 1e-30)
    return out


def text_hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED):
    """(idf, projection, labelled vectors, labels, weights, text hash -> vectors) from at most max_labelled labelled
    (doc_id, label, text), or the share of label 1."""
    import numpy as np

    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").distinct()
    order = F.xxhash64("doc_id")
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = known.where("y = 0").orderBy(order, "doc_id").limit(max_labelled // 2).unionByName(known.where("y = 1").orderBy(order, "doc_id").limit(max_labelled // 2))
    # A doc_id may stand on many rows: each of its texts counts once, and of all texts at most the bound, by hash.
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(picked), "doc_id").withColumn("h", F.xxhash64("text"))
    once = rows.groupBy("doc_id", "y", "h").agg(F.first("text").alias("text")).orderBy("h", "doc_id", "y").limit(max_labelled)

    def count(texts):
        return [[terms(t).tobytes() for t in texts], [text_hash(t) - (1 << 63) for t in texts]]

    got = per_text(once, "text", count, "v binary, t long", {"doc_id": F.col("doc_id"), "y": F.col("y")}).collect()
    got = sorted({(r.doc_id, r.y, r.t, bytes(r.v)) for r in got})
    y = np.array([r[1] for r in got], np.float32)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    counts = np.stack([np.frombuffer(r[3], np.float32) for r in got])
    idf, proj = latent(counts)
    stands_for = np.where(y == 1, sizes[1] / max(1, (y == 1).sum()), sizes[0] / max(1, (y == 0).sum())).astype(np.float32)
    at: dict[int, list[int]] = {}
    for i, r in enumerate(got):
        at.setdefault(r[2] + (1 << 63), []).append(i)
    return idf, proj, unit(weigh(counts, idf) @ proj).astype(np.float32), y, stands_for, at


def scores(m, texts):
    """The score of each text."""
    import numpy as np

    if isinstance(m, float):
        s = np.full(len(texts), m)
    else:
        idf, proj, known, y, stands_for, at = m
        s = np.empty(len(texts))
        for i in range(0, len(texts), 128):
            part = texts[i : i + 128]
            z = unit(weigh(np.stack([terms(t) for t in part]), idf) @ proj)
            s[i : i + 128] = vote(z, known, y, stands_for=stands_for, own=[at.get(text_hash(t)) for t in part])
    # Sums of floats may differ in their last digits with the batch that a text is in.
    return np.round(np.clip(s, 0, 1), 6).astype(float)


def accepted(documents: DataFrame, model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose text scores ``threshold`` or more."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    return rows_where(documents, text, lambda texts: scores(sent.value, texts) >= threshold)


def score(documents: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    return per_text(documents, text, lambda texts: [scores(sent.value, texts)], "score double", id_of(key))


def held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
