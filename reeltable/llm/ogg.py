"""Media columns in Ogg: a payload becomes two multiplexed logical streams and is read back from its stored bytes.

Reading verifies each page's checksum and sequence number, parts the logical streams by serial number, reassembles
packets from lacing values across pages, and derives each packet's time from granule positions: a page's granule is the
end of the last packet that ends on it, and packets before it end earlier by the samples of those behind. The sample
stream holds 8-bit samples, so the payload is kept byte for byte; the index stream holds the CRC-32 of every sample packet.

Defined results: a null text is an empty one, an empty payload is 64 zero bytes. Equal texts give equal bytes (serials
come from the payload), so ties and repeated rows have equal values. Broken media give a null payload and a feature that
names the fault; null media give nulls. Very long texts become many pages of one row, read whole. Empty tables and extra
columns pass through, as each row is coded by itself; columns named payload and feature are replaced.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from reeltable.llm.common import own_names, table

BLOCK, PACKET, RATE = 64, 10_000, 8_000
CONTINUED, FIRST, LAST = 1, 2, 4
HEAD = struct.Struct("<4sBBqIIIB")
MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
SAMPLES, INDEX = b"SAMPLES8", b"CRCINDEX"


def page_crc(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, not reflected, from 0: that of zlib over mirrored bytes, mirrored, without its conditioning."""
    reflected = zlib.crc32(page.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    rest = lacing + body
    crc = page_crc(HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + rest)
    return HEAD.pack(b"OggS", 0, flags, granule, serial, number, crc, len(lacing)) + rest


def pages_of(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """The pages of one logical stream; packets come with the granule position at their end. The first packet has its own page."""
    found: list[bytes] = []
    for group in (packets[:1], packets[1:]):
        lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p, _ in group)
        body, ends, at = b"".join(p for p, _ in group), [], 0
        for p, granule in group:
            at += len(p) // 255 + 1
            ends.append((at, granule))
        at = k = used = 0
        while at < len(lacing):
            to = min(at + 255, len(lacing))
            granule = -1  # no packet ends on this page
            while k < len(ends) and ends[k][0] <= to:
                granule = ends[k][1]
                k += 1
            size = sum(lacing[at:to])
            flags = (FIRST if not found else 0) | (CONTINUED if at and lacing[at - 1] == 255 else 0)
            found.append((flags, granule, len(found), lacing[at:to], body[used : used + size]))
            at, used = to, used + size
    return [_page(flags | (LAST if n == len(found) - 1 else 0), granule, serial, n, lacing, body) for flags, granule, n, lacing, body in found]


def mux(payload: bytes) -> bytes:
    """payload as an Ogg file of a sample stream and an index stream, first pages first, then pages in turn."""
    serial = zlib.crc32(payload)
    parts = [payload[a : a + PACKET] for a in range(0, len(payload), PACKET)]
    samples = [(SAMPLES + struct.pack("<IQ", RATE, len(payload)), 0)]
    samples += [(p, min(len(payload), (n + 1) * PACKET)) for n, p in enumerate(parts)]
    crcs = [struct.pack("<I", zlib.crc32(p)) for p in parts]
    index = [(INDEX, 0), (b"".join(crcs), len(payload))]
    a, b = pages_of(samples, serial), pages_of(index, serial ^ 0xFFFFFFFF)
    mixed = [a[0], b[0]]
    for n in range(1, max(len(a), len(b))):
        mixed += a[n : n + 1] + b[n : n + 1]
    return b"".join(mixed)


def demux(media: bytes) -> dict[int, list[tuple[bytes, int | None]]]:
    """The packets of each logical stream, by serial, with the granule position where the page gives their end."""
    at, streams, part, numbers, ended = 0, {}, {}, {}, set()
    while at < len(media):
        if len(media) - at < HEAD.size:
            raise ValueError("a page is cut short")
        magic, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError("no page where one is due")
        lacing = media[at + HEAD.size : at + HEAD.size + n]
        size = HEAD.size + n + sum(lacing)
        page = media[at : at + size]
        if len(lacing) < n or len(page) < size:
            raise ValueError("a page is cut short")
        if page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise ValueError("a page's checksum is wrong")
        if bool(flags & FIRST) != (serial not in streams) or number != numbers.get(serial, 0) or serial in ended:
            raise ValueError("a page is missing or repeated")
        packets, rest = streams.setdefault(serial, []), part.pop(serial, b"")
        if bool(rest) != bool(flags & CONTINUED):
            raise ValueError("a packet's part is missing")
        numbers[serial] = number + 1
        body, pieces, open_, done = at + HEAD.size + n, [rest] if rest else [], bool(rest), 0
        for value in lacing:
            pieces.append(media[body : body + value])
            body += value
            open_ = value == 255
            if not open_:
                packets.append((b"".join(pieces), None))
                pieces, done = [], done + 1
        if open_:
            part[serial] = b"".join(pieces)
        if done and granule >= 0:
            packets[-1] = (packets[-1][0], granule)
        if flags & LAST:
            ended.add(serial)
        at += size
    if part or ended != set(streams):
        raise ValueError("a stream doesn't end")
    return streams


def timed(packets: list[tuple[bytes, int | None]]) -> list[tuple[int, int]]:
    """Start and end of each packet of a sample stream (without its header), in samples, from the granule positions."""
    found, end = [], None
    for data, granule in reversed(packets):
        if granule is not None:
            if end is not None and granule != end:
                raise ValueError("a granule position is wrong")
            end = granule
        if end is None:
            raise ValueError("the last granule position is missing")
        found.append((end - len(data), end))
        end -= len(data)
    if end:
        raise ValueError("a granule position is wrong")
    return found[::-1]


def opened(media: bytes) -> tuple[int, int, list[tuple[bytes, int | None]], int, int]:
    """Rate, samples that the header tells, sample packets with their granule positions, numbers of streams and packets; verified against the index."""
    streams = demux(media)
    samples = next((s for s in streams.values() if s and s[0][0][:8] == SAMPLES), None)
    index = next((s for s in streams.values() if s and s[0][0] == INDEX), None)
    if samples is None or index is None:
        raise ValueError("a stream is missing")
    rate, size = struct.unpack("<IQ", samples[0][0][8:])
    crcs = index[1][0] if len(index) > 1 else b""
    if [*struct.unpack(f"<{len(crcs) // 4}I", crcs)] != [zlib.crc32(p) for p, _ in samples[1:]]:
        raise ValueError("a packet differs from the index")
    return rate, size, samples[1:], len(streams), sum(map(len, streams.values()))


def read_back(media: bytes) -> tuple[bytes, str]:
    """The payload and the features: logical streams, packets, granule positions, and the times of the end and of the last packet's start."""
    rate, size, packets, streams, n = opened(media)
    times = timed(packets)
    if (times[-1][1] if times else 0) != size:
        raise ValueError("samples are missing")
    marks = sum(g is not None for _, g in packets)
    last, end = (t * 1000 // rate for t in times[-1]) if times else (0, 0)
    return b"".join(p for p, _ in packets), f"streams={streams};packets={n};marks={marks};last_ms={last};ms={end}"


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


@pandas_udf(BinaryType())
def _encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: mux(padded(t)))


READ = StructType([StructField("payload", BinaryType()), StructField("feature", StringType())])


@pandas_udf(READ)
def _decode(media: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    def one(m):
        if m is None:
            return None, None
        try:
            return read_back(bytes(m))
        except (ValueError, struct.error) as e:
            return None, f"fault={e}"

    for s in media:
        yield pd.DataFrame([one(m) for m in s], columns=["payload", "feature"], dtype=object)


def text_to_media(text: Column) -> Column:
    return _encode(text)


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """df with `payload` and `feature`, read from its media column."""
    names = set(df.columns) - {"payload", "feature"}
    return df.select(*(F.col(f"`{n}`") for n in df.columns if n in names), _decode(F.col(media)).alias("_read")).select("*", "_read.*").drop("_read")


PACKETS = ArrayType(StructType([StructField("start_ms", LongType()), StructField("end_ms", LongType()), StructField("data", BinaryType())]))


@pandas_udf(PACKETS)
def _packets(media: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(m):
        if m is None:
            return None
        try:
            rate, _, packets, _, _ = opened(bytes(m))
            return [{"start_ms": a * 1000 // rate, "end_ms": b * 1000 // rate, "data": p} for (p, _), (a, b) in zip(packets, timed(packets), strict=True)]
        except (ValueError, struct.error):
            return None

    for s in media:
        yield s.map(one)


def explode_packets(df: DataFrame, media: str = "media") -> DataFrame:
    """A row for each sample packet of df's media, with its number, times and bytes; null and broken media have none."""
    rest = [F.col(f"`{n}`") for n in df.columns if n not in (media, "packet", "start_ms", "end_ms", "data")]
    return df.select(*rest, F.posexplode(_packets(F.col(media))).alias("packet", "_p")).select("*", "_p.*").drop("_p")


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_names(table(spark, sf_dir, "documents"), "doc_id", "text")
    stored = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), text_to_media(F.coalesce("text", F.lit(""))).alias("media"))
    back = read_media(stored)
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")
