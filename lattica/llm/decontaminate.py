"""Benchmark decontamination with one Aho-Corasick automaton.

Test items are normalised to words and cut into windows of 13 consecutive words (an item of fewer words is one
window).  All windows go into a single automaton over word numbers, and each text is scanned once, in normalised
form.  Word numbers lead back to offsets in the original.

A benchmark of more than ``PART_WINDOWS`` distinct (window, item) pairs is dealt over several automata, which texts pass
one after the other, with the hits kept on the way: driver and workers never hold more than one of them, whatever the
benchmark's size, and the union of hits is what one automaton would find.

Nulls and texts without words have no hits; items without words have no windows; items without an id hit words and
count as one item, which has no name in the list; repeated items and documents are each judged on their own; other
columns of the inputs are ignored or, by ``clean``, kept.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, cut, id_of, released

WINDOW = 13
#: (window, item) pairs of one automaton: 13 nodes of some 30 bytes each, at most.
PART_WINDOWS = 300_000
#: Maps ASCII upper case to lower case and every other ASCII non-alphanumeric to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str) -> list[bytes]:
    """A text's words in lower case.  Bytes are split at ASCII blanks only: other blanks are word characters."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows_of(text: str, size: int = WINDOW) -> list[str]:
    w = words_of(text)
    return [b" ".join(w[i : i + size]).decode("utf-8", "surrogatepass") for i in range(max(1, len(w) - size + 1) if w else 0)]


class Automaton:
    """All windows of a dict (window -> items), over word numbers."""

    def __init__(self, found: dict[str, set]):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in found.items():
            keys = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window.encode("utf-8", "surrogatepass").split(b" "))
            self.trie.add_word(keys, (len(keys), tuple(items)))
        self.least = min((w.count(" ") + 1 for w in found), default=0)
        if found:
            self.trie.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, hit word ranges (merged, end exclusive), items."""
        import numpy as np

        words, number = words_of(text), self.numbers.get
        ranges, items = [], set()
        if len(words) < self.least or not self.least:
            return len(words), ranges, items
        numbers = [number(w, 0) for w in words]
        # A window has none but known words: only their runs of a window's length or more can hold one.
        strange = np.flatnonzero(np.array(numbers) == 0)
        begins, ends = np.concatenate([[0], strange + 1]), np.concatenate([strange, [len(words)]])
        for k in np.flatnonzero(ends - begins >= self.least):
            at = int(begins[k])
            for end, (size, who) in self.trie.iter(tuple(numbers[at : ends[k]])):
                items.update(who)
                lo, hi = at + end + 1 - size, at + end + 1
                while ranges and ranges[-1][1] >= lo:
                    p = ranges.pop()
                    lo, hi = min(lo, p[0]), max(hi, p[1])
                ranges.append((lo, hi))
        return len(words), ranges, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and out[-1][1] >= lo:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code point spans of the original text."""
    if not ranges:
        return []
    words = [m.span() for m in WORD.finditer(text)]
    return [(words[a][0], words[b - 1][1]) for a, b in ranges]


def contaminated(n: int, ranges: list[tuple[int, int]]) -> bool:
    hit = sum(b - a for a, b in ranges)
    return hit > 0 and 20 * hit >= n


def window_table(benchmark: DataFrame, item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, window), distinct."""
    rows = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("t")).where("t is not null")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for who, text in zip(b.column("item"), b.column("t").to_pylist(), strict=True):
                own = list(dict.fromkeys(windows_of(text, window)))
                for at in range(0, len(own), 10_000):
                    part = own[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([who.as_py()] * len(part), pa.int64()), pa.array(part, pa.string())], names=["item", "window"])

    return rows.mapInArrow(run, "item long, window string").distinct()


def window_parts(benchmark: DataFrame, item: str = "item_id", item_text: str = "text", window: int = WINDOW, part_windows: int = PART_WINDOWS):
    """How many parts the benchmark's windows make, and a function that fetches one: window -> items.  Pairs are
    dealt by hash of window and item, so that a window that all items share makes no part larger than others."""
    table = cut(window_table(benchmark, item, item_text, window))
    parts = max(1, -(-table.count() // part_windows))
    dealt = table.withColumn("part", F.pmod(F.xxhash64("item", "window"), F.lit(parts)))

    def fetch(k: int) -> dict[str, set]:
        out: dict[str, set] = {}
        for r in dealt.where(F.col("part") == k).select("item", "window").collect():
            out.setdefault(r.window, set()).add(r.item)
        return out

    return parts, fetch


_STATE = "_n long, _ranges array<long>, _items array<long>"


def _scanned(rows: DataFrame, found: dict[str, set]) -> DataFrame:
    """rows(..., _text, _n, _ranges, _items) after one more automaton."""
    sent = rows.sparkSession.sparkContext.broadcast(found)
    made: list = []

    def run(batches):
        import pyarrow as pa

        if not made:
            made.append(Automaton(sent.value))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                n, ranges, items = [], [], []
                for text, r, i in zip(b.column("_text").to_pylist(), b.column("_ranges").to_pylist(), b.column("_items").to_pylist(), strict=True):
                    size, hits, who = made[0].scan(text)
                    if r:
                        hits = merged(hits + list(zip(r[::2], r[1::2])))
                    n.append(size)
                    ranges.append([x for lohi in hits for x in lohi])
                    items.append(list(who.union(i)))
                yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(n, pa.int64()), pa.array(ranges, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.int64()))], names=b.schema.names)

    return rows.mapInArrow(released(run), rows.schema)


def _judged(kept: DataFrame, benchmark: DataFrame, item: str, item_text: str, window: int, part_windows: int) -> DataFrame:
    """``kept`` (which has ``_text``) with _n, _ranges and _items."""
    none = F.array().cast("array<long>")
    rows = kept.select("*", F.lit(0).cast("long").alias("_n"), none.alias("_ranges"), none.alias("_items"))
    parts, fetch = window_parts(benchmark, item, item_text, window, part_windows)
    for k in range(parts):
        rows = _scanned(rows if not k else cut(rows), fetch(k))
    return rows


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", part_windows: int = PART_WINDOWS) -> DataFrame:
    """The rows, with all their columns, whose text is not contaminated."""
    names = [f"c{i}" for i in range(len(documents.columns))]
    kept = documents.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(documents.columns, names)], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    hit = F.aggregate("_ranges", F.lit(0).cast("long"), lambda s, x: x - s)  # of (lo, hi, lo, hi ...): the sum of all hi - lo
    good = _judged(kept, benchmark, "item_id", "text", WINDOW, part_windows).where(~((hit > 0) & (20 * hit >= F.col("_n"))))
    return good.select(*[F.col(n).alias(c) for c, n in zip(documents.columns, names)])


def decontaminate(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, part_windows: int = PART_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted as strings, comma-joined),
    spans (``start:end`` code points of the original, comma-joined), contaminated."""
    kept = documents.select(*[c.alias(n) for n, c in id_of(key).items()], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = _judged(kept, benchmark, item, item_text, window, part_windows)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for t, n, flat, who in zip(*[b.column(c).to_pylist() for c in ("_text", "_n", "_ranges", "_items")], strict=True):
                ranges = list(zip(flat[::2], flat[1::2]))
                spans = ",".join(f"{x}:{y}" for x, y in original_spans(t, ranges))
                out.append((n, sum(y - x for x, y in ranges), len(who), ",".join(sorted(str(x) for x in who if x is not None)), spans, contaminated(n, ranges)))
            n, hit, many, items, spans, bad = zip(*out) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n, hit, many)], pa.array(items, pa.string()), pa.array(spans, pa.string()), pa.array(bad, pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items", "spans", "contaminated"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items string, spans string, contaminated boolean")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated", "spans")
