"""Packing by best-fit decreasing.

Documents longer than a window are first cut into full windows; the rest of each goes, longest
first, into the tightest open window with room.  Lengths are whole numbers up to the window, so
pieces of one length are interchangeable: the decision needs only how many pieces there are of
each length (a histogram of ``window`` entries at most, whatever the input).  The driver packs
that histogram with a segment tree indexed by remaining capacity, moving runs of equal windows at
once, which gives just what packing piece by piece gives.  Each piece then finds its place by its
rank among the pieces of its length; ranks come from counts per (length, salt).  A length of n pieces has
about sqrt(n) salts of sqrt(n) pieces, so that a length which most pieces share (that of a full window) is
gathered nowhere, whatever the input's size.

Null and empty texts are one piece, the end id alone.  Repeated rows are packed as often as given;
rows without doc_id are packed too; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_of, released
from .tokens import encoder, vocabulary

WINDOW = 1024
#: Texts that are encoded at once.
TEXTS = 1024
#: Keys of (length, rank): ranks take so many bits.
RANK_BITS = 48


class CapacityTree:
    """Segment tree over remaining capacities 0..n: the least capacity >= x with an open window."""

    def __init__(self, n: int):
        self.size = 1
        while self.size <= n:
            self.size *= 2
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, count: int) -> None:
        i = capacity + self.size
        while i:
            self.open[i] += count
            i //= 2

    def tightest(self, x: int) -> int | None:
        i = x + self.size
        if self.open[i]:
            return x
        while i > 1:
            if not i % 2 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(counts: dict[int, int], window: int = WINDOW) -> dict[int, list[tuple[int, int, int]]]:
    """length -> runs (first rank, first sequence, offset): the piece of rank r in a run is in
    sequence ``first sequence + r - first rank``."""
    tree, runs, out, made = CapacityTree(window), {}, {}, 0
    for length in sorted(counts, reverse=True):
        left, rank, mine = counts[length], 0, out.setdefault(length, [])
        while left:
            room = tree.tightest(length)
            if room is None:
                room, start, many = window, made, -(-left // (window // length))
                made += many
            else:
                start, many = runs[room].pop()
                tree.add(room, -many)
            # The window just used is the tightest while a further piece fits: fill window by window.
            fit = room // length
            for n, each in ((min(many, left // fit), fit), (1, left % fit)):
                if n and each and many and left >= each:
                    for j in range(each):
                        mine.append((rank, start, window - room + j * length))
                        rank += n
                    left -= n * each
                    if rest := room - each * length:
                        runs.setdefault(rest, []).append((start, n))
                        tree.add(rest, n)
                    start, many = start + n, many - n
            if many:
                runs.setdefault(room, []).append((start, many))
                tree.add(room, many)
    return out


def token_pieces(documents: DataFrame, path: str, end_id: int, window: int = WINDOW, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids, if asked for) of each piece."""
    rows = documents.select(*[c.alias(n) for n, c in id_of(key).items()], F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        enc, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                b = batch.slice(i, TEXTS)
                row, start, length, crc, whole, own = [], [], [], [], [], []
                for j, ids in enumerate(enc.encode(b.column("text").to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    for at in range(0, n, window):
                        piece = ids[4 * at : 4 * (at + window)]
                        row.append(j)
                        start.append(at)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        whole.append(n)
                        own.append(piece)
                columns = [b.column("doc_id").take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, whole)]]
                if keep_ids:
                    ends = np.cumsum([0, *length]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(own), "<i4"))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids])

    return rows.mapInArrow(released(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids)


def place(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to ``window`` ids.  Reads its input three times."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # ``window`` rows at most
    salts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for n, c in sorted(counts.items()) for x in (n, isqrt(c))]), F.col("length").cast("int")), F.lit(1)) if counts else F.lit(1)
    p = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), salts.cast("long")))
    by = p.groupBy("length", "salt").agg(F.count("*").alias("n"))
    runs = plan(counts, window)
    base = by.select("length", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = p.withColumn("rank", rank).join(base, ["length", "salt"])
    ranked = ranked.select(*pieces.columns, (F.col("rank") + F.col("base")).alias("rank"))
    # All runs, in order of (length, first rank); a piece is in the last that begins at or before it.
    flat = sorted((length << RANK_BITS | lo, start, offset) for length, own in runs.items() for lo, start, offset in own)
    sent = spark.sparkContext.broadcast(flat)
    at, places = ranked.columns.index("length"), len(ranked.columns) - 1
    made: list = []

    def settle(batches):
        import numpy as np
        import pyarrow as pa

        if not made and sent.value:
            made.extend(np.array(x, np.int64) for x in zip(*sent.value))
        for b in batches:
            if not b.num_rows:
                continue
            keys, first, offsets = made
            want = b.column(at).to_numpy() << RANK_BITS | b.column(places).to_numpy()
            k = np.searchsorted(keys, want, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(first[k] + want - keys[k]), pa.array(offsets[k])], names=[*pieces_columns, "sequence_id", "offset"])

    pieces_columns = pieces.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(settle, kinds + ", sequence_id long, offset long")


def pack(documents: DataFrame, path: str | None = None, end_id: int = 0, window: int = WINDOW, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row for each piece, with its sequence and its offset there."""
    pieces = cut(token_pieces(documents, path or vocabulary("byte_bpe_50k.json"), end_id, window, key, text, keep_ids))
    return place(pieces, window)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id, input_ids, from pieces with ids: padded to the window, except that a sequence
    whose length is a power of two stays as it is."""
    joined = packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    n = F.size("ids")
    whole = n.bitwiseAND(n - 1) == 0
    return joined.select("sequence_id", F.when(whole, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(window) - n))).alias("input_ids"))
