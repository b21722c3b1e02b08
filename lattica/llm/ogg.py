"""Ogg as a media column.

``encode`` makes an Ogg stream of a payload of 8-bit samples: two logical streams, ``samples``
(packets of PACKET bytes, even and odd bytes kept together) and ``index`` (a packet with the
payload's length and CRC-32), in interleaved pages with lacing values, granule positions and page
checksums.  ``decode`` verifies each page's checksum, demultiplexes by serial number, reassembles
packets from lacing values across pages, and derives timestamps from granule positions.

Null texts are empty ones; a payload is never empty (padding to 192 at least); a page with a wrong
checksum, sequence or version raises ``ValueError``, or is reported by ``inspect`` rows with
``error``.  Repeated rows, rows without doc_id and other columns do no harm; no row is dropped.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, fresh_path, id_of, per_text

UNIT = 192
PACKET = 1920
PAGE_SEGMENTS = 64
RATE = 8000
SERIALS = (0x5350, 0x4958)
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def ogg_crc(data: bytes) -> int:
    """CRC of polynomial 0x04c11db7, not reflected, from 0: the reflected one of zlib over
    bit-reversed bytes, bit-reversed."""
    x = zlib.crc32(data.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_FLIP), "big")


def _page(body: bytes, lacing: bytes, kind: int, granule: int, serial: int, number: int) -> bytes:
    head = struct.pack("<4sBBqIIIB", b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", ogg_crc(head + body)) + head[26:] + body


def _stream(packets: list[bytes], grains: list[int], serial: int) -> list[tuple[int, bytes]]:
    """(granule, page) of one logical stream."""
    values, ends = bytearray(), []  # lacing values; (segments so far, granule) at each packet's end
    for p, g in zip(packets, grains, strict=True):
        values += b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
        ends.append((len(values), g))
    body, pages, at, e, pos = b"".join(packets), [], 0, 0, 0
    cuts = {n for n, _ in ends}
    while at < len(values):
        to = min(at + PAGE_SEGMENTS, len(values))
        granule = -1
        while e < len(ends) and ends[e][0] <= to:
            granule = ends[e][1]
            e += 1
        lacing = bytes(values[at:to])
        n = sum(lacing)
        kind = (1 if at and at not in cuts else 0) | (2 if not at else 0) | (4 if to == len(values) else 0)
        pages.append((granule, _page(body[pos : pos + n], lacing, kind, granule, serial, len(pages))))
        at, pos = to, pos + n
    return pages


def payload(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def encode(data: bytes) -> bytes:
    packets = [data[i : i + PACKET] for i in range(0, len(data), PACKET)]
    grains = [min(len(data), i + PACKET) for i in range(0, len(data), PACKET)]
    first = _stream(packets, grains, SERIALS[0])
    second = _stream([struct.pack("<QI", len(data), zlib.crc32(data))], [len(data)], SERIALS[1])
    return first[0][1] + second[0][1] + b"".join(p for _, p in first[1:])


def decode(media: bytes) -> dict[int, list[tuple[bytes, int, float]]]:
    """serial -> packets as (data, granule of the page where it ends or -1, seconds)."""
    out: dict[int, list] = {}
    partial: dict[int, bytes] = {}
    numbers: dict[int, int] = {}
    at = 0
    while at < len(media):
        if media[at : at + 4] != b"OggS" or at + 27 > len(media):
            raise ValueError(f"no page at byte {at}")
        _, version, kind, granule, serial, number, crc, n = struct.unpack_from("<4sBBqIIIB", media, at)
        lacing = media[at + 27 : at + 27 + n]
        start = at + 27 + n
        end = start + sum(lacing)
        if version or end > len(media) or len(lacing) < n:
            raise ValueError(f"page at byte {at} is cut or of another version")
        if ogg_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"page at byte {at} has a wrong checksum")
        if number != numbers.get(serial, 0) or bool(kind & 1) != (serial in partial):
            raise ValueError(f"page at byte {at} is out of sequence")
        numbers[serial] = number + 1
        packets, held = out.setdefault(serial, []), partial.pop(serial, b"")
        begin = pos = start
        last = None
        for v in lacing:
            pos += v
            if v < 255:
                packets.append((held + media[begin:pos], -1, -1.0))
                held, begin, last = b"", pos, len(packets) - 1
        if begin < pos or held:
            partial[serial] = held + media[begin:pos]
        if last is not None and granule >= 0:
            packets[last] = (packets[last][0], granule, granule / RATE)
        at = end
    if partial:
        raise ValueError("a packet has no end")
    return out


def features(media: bytes) -> tuple[bytes, str]:
    """The payload read back, and its features as text."""
    import numpy as np

    streams = decode(media)
    packets = streams.get(SERIALS[0], [])
    data = b"".join(p for p, _, _ in packets)
    size, crc = struct.unpack("<QI", streams[SERIALS[1]][0][0])
    if size != len(data) or crc != zlib.crc32(data):
        raise ValueError("the samples are not those that the index tells of")
    x = np.frombuffer(data, np.uint8)
    total, square = int(x.sum(dtype=np.int64)), int(np.square(x, dtype=np.int64).sum())
    centred = x >= 128
    turns = int(np.count_nonzero(centred[1:] != centred[:-1]))
    stamps = [s for _, g, s in packets if g >= 0]
    return data, f"streams={len(streams)};packets={len(packets)};stamps={len(stamps)};seconds={stamps[-1]:.6f};mean={total / len(x):.4f};rms={(square / len(x)) ** 0.5:.4f};turns={turns}"


def encode_column(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media."""

    def run(texts):
        made = [(n, encode(data)) for n, data in map(payload, texts)]
        return [[n for n, _ in made], [m for _, m in made]]

    return per_text(documents, text, run, "n_bytes long, media binary", id_of(key))


def inspect_column(media: DataFrame) -> DataFrame:
    """Of a media column (doc_id, n_bytes, media): what was read back of each."""
    rows = media.select("doc_id", "n_bytes", "media").where(F.col("media").isNotNull())

    def run(batches):
        import hashlib

        import pyarrow as pa

        def inspect(m: bytes) -> tuple:
            sha = hashlib.sha256(m).hexdigest()
            try:
                data, said = features(m)
                return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(m), sha, said, None
            except ValueError as e:
                return 0, "", 0, len(m), sha, "", str(e)

        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                made = zip(*map(inspect, b.column("media").to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *[pa.array(x, k) for x, k in zip(made, kinds, strict=True)]], names=READ_BACK)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


READ_BACK = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]


def media_table(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores the media column in a new folder among the shared ones and reads it back."""
    spark = documents.sparkSession
    at = fresh_path(spark, "media")
    encode_column(documents, key, text).write.option("compression", "zstd").option("parquet.enable.dictionary", "false").option("parquet.block.size", 16 << 20).parquet(at)
    return inspect_column(spark.read.parquet(at))
