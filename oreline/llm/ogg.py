"""Ogg media columns: multiplex and demultiplex physical streams held in binary columns.

The reader checks the page checksums, joins packets from lacing values across
pages, separates logical streams by serial number and turns granule positions into
seconds. All work is per row, within Arrow batches.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

FRAME = 576  # bytes of a packet of samples
RATE = 8000  # samples a second, one byte each
SERIAL_SOUND, SERIAL_NOTES = 1, 2
MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))  # a byte's bits reversed
PAGE = struct.Struct("<4sBBqIIIB")


def page_checksum(page: bytes) -> int:
    """CRC of polynomial 0x04c11db7, most significant bit first, from 0.

    That is zlib's CRC of the mirrored bytes, without its inversions, mirrored.
    """
    crc = zlib.crc32(page.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(MIRROR), "big")


def pages_of(serial: int, packets: list[bytes], granules: list[int]) -> Iterator[bytes]:
    """Pages of a logical stream; granules[i] is the position after packet i.

    The first packet has a page of its own. A page has at most 255 lacing values; a
    packet may go on in the next page.
    """
    lacing: list[tuple[int, int]] = []  # value, packet it ends or -1
    for i, p in enumerate(packets):
        lacing += [(255, -1)] * (len(p) // 255) + [(len(p) % 255, i)]
    body, at = b"".join(packets), 0
    starts = [0, *range(min(255, len(packets[0]) // 255 + 1), len(lacing), 255)] if packets else []
    for number, (k, end) in enumerate(zip(starts, [*starts[1:], len(lacing)], strict=True)):
        part = lacing[k:end]
        ended = [i for _, i in part if i >= 0]
        flags = (k > 0 and lacing[k - 1][1] < 0) | 2 * (k == 0) | 4 * (end == len(lacing))
        size = sum(v for v, _ in part)
        table = bytes(v for v, _ in part)
        granule = granules[ended[-1]] if ended else -1
        page = PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(part)) + table + body[at : at + size]
        yield page[:22] + page_checksum(page).to_bytes(4, "little") + page[26:]
        at += size


def mux(sound: bytes, notes: bytes) -> bytes:
    """A physical stream of two logical ones: 8-bit samples in packets of FRAME, and a packet of notes."""
    cuts = range(0, len(sound), FRAME)
    head = struct.pack("<8sIB", b"rawsound", RATE, 8)
    first = list(pages_of(SERIAL_SOUND, [head, *(sound[i : i + FRAME] for i in cuts)], [0, *(min(i + FRAME, len(sound)) for i in cuts)]))
    second = list(pages_of(SERIAL_NOTES, [struct.pack("<8sIB", b"rawnotes", RATE, 8), notes], [0, len(sound)]))
    return b"".join([first[0], second[0], *first[1:], *second[1:]])


def packet_granules(sizes: list[int], ends: list[tuple[int, int]], codec: str) -> list[int | None]:
    """Granule position at the end of each packet.

    ``ends`` has (granule, packets so far) of each page that ends a packet. A page's
    granule is that of its last packet; where a packet's samples are its bytes (codec
    rawsound), those before it follow by going back, else they are unknown (None).
    """
    out: list[int | None] = [None] * len(sizes)
    begin = 0
    for granule, end in ends:
        if granule >= 0:
            for i in range(end - 1, begin - 1, -1):
                out[i] = granule
                if codec != "rawsound":
                    break
                granule = max(0, granule - sizes[i])
        begin = end
    return out


def demux(data: bytes) -> list[dict]:
    """Logical streams by serial number.

    A page founds or extends a stream only if its checksum is right. A page whose head
    is whole but whose checksum is wrong, or whose end is cut, is counted once: as bad in
    its stream if that is known, else as stray in all. Its packets are lost; the search
    for the next page goes on byte by byte after its head. Gaps in the page numbers that
    bad pages do not explain are lost pages.
    """
    streams: dict[int, dict] = {}
    stray = 0
    at = data.find(b"OggS")
    while 0 <= at <= len(data) - 27:
        _, version, flags, granule, serial, number, crc, n = PAGE.unpack_from(data, at)
        body = at + 27 + n
        end = body + sum(data[at + 27 : body])
        page = data[at:end]
        if version or end > len(data) or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            if serial in streams:
                streams[serial]["bad_pages"] += 1
                streams[serial]["_bad"] += 1
                streams[serial]["_open"] = None
            else:
                stray += 1
            at = data.find(b"OggS", at + 1)
            continue
        s = streams.setdefault(serial, {"serial": serial, "pages": 0, "bad_pages": 0, "lost_pages": 0, "granule": 0, "ended": False, "packets": [], "_ends": [], "_open": None, "_next": 0, "_bad": 0})
        s["pages"] += 1
        if number != s["_next"]:
            s["lost_pages"] += max(0, number - s["_next"] - s["_bad"])
            s["_open"] = None
        s["_next"], s["_bad"] = number + 1, 0
        open_ = s["_open"] if flags & 1 else None
        skip = bool(flags & 1) and open_ is None  # its beginning is lost
        parts, done = open_ or [], len(s["packets"])
        for v in page[27 : 27 + n]:
            parts.append(data[body : body + v])
            body += v
            if v < 255:
                if not skip:
                    s["packets"].append(b"".join(parts))
                parts, skip = [], False
        s["_open"] = parts if n and page[26 + n] == 255 and not skip else None
        if granule >= 0:
            s["granule"] = granule
        if len(s["packets"]) > done:
            s["_ends"].append((granule, len(s["packets"])))
        s["ended"] |= bool(flags & 4)
        at = end if data[end : end + 4] == b"OggS" else data.find(b"OggS", end)
    for s in streams.values():
        s["stray_pages"] = stray
    return [streams[k] for k in sorted(streams)]


STREAMS = (
    "array<struct<serial:long,codec:string,rate:int,pages:int,bad_pages:int,lost_pages:int,stray_pages:int,packets:int,granule:long,seconds:double,ended:boolean,"
    "times:array<double>,level:double,loudness:double,peak:int,crossings:long,data:binary>>"
)


def sample_features(data: bytes) -> dict:
    """Mean level and loudness (root mean square) about 128, peak, and crossings of 128, of 8-bit samples."""
    x = np.frombuffer(data, np.uint8).astype(np.int64) - 128
    if not len(x):
        return {"level": 0.0, "loudness": 0.0, "peak": 0, "crossings": 0}
    return {"level": int(x.sum()) / len(x), "loudness": math.sqrt(int((x * x).sum()) / len(x)), "peak": int(np.abs(x).max()), "crossings": int(((x[1:] < 0) != (x[:-1] < 0)).sum())}


def described(s: dict) -> dict:
    """A stream's row. Its first packet names codec and rate; the others are its data.

    ``times`` has the second at which each packet of data ends, null where the stream
    does not tell; the features are those of the samples that were read.
    """
    head = s["packets"][0] if s["packets"] else b""
    codec, rate = ("", 0)
    if len(head) == 13:
        name, rate, _ = struct.unpack("<8sIB", head)
        codec = name.decode("ascii", "replace")
    data = b"".join(s["packets"][1:])
    ends = packet_granules([0, *map(len, s["packets"][1:])], s["_ends"], codec)[1:]
    return {k: s[k] for k in ("serial", "pages", "bad_pages", "lost_pages", "stray_pages", "granule", "ended")} | {
        "codec": codec, "rate": rate, "packets": len(s["packets"]), "seconds": s["granule"] / rate if rate else 0.0,
        "times": [g / rate if g is not None and rate else None for g in ends], "data": data,
    } | sample_features(data)


def demux_ogg(df: DataFrame, media_col: str = "media", out: str = "streams") -> DataFrame:
    """``df`` with ``out``: the logical streams of the Ogg bytes in ``media_col``.

    Null, empty or foreign bytes have no streams; damaged pages are counted in
    bad_pages, those of unknown streams in stray_pages, and their packets are missing.
    A column named ``out`` is replaced; all other columns and repeated rows stay; no
    rows: no rows.
    """

    @pandas_udf(STREAMS)
    def read(media: pd.Series) -> pd.Series:
        return media.map(lambda b: [described(s) for s in demux(bytes(b))] if b is not None else [])

    return df.withColumn(out, read(F.col(media_col)))


def mux_ogg(sound: Column, notes: Column) -> Column:
    """Ogg bytes that hold ``sound`` (8-bit samples) and ``notes``; null counts as empty."""

    @pandas_udf("binary")
    def write(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([mux(bytes(x or b""), bytes(y or b"")) for x, y in zip(a, b, strict=True)], dtype=object)

    return write(sound, notes)


def padded_payload(text: Column, frame: int = FRAME) -> Column:
    """UTF-8 bytes of a text, then bytes 255 up to a positive multiple of ``frame``."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(data)
    pad = F.greatest(F.lit(1), F.ceil(n / frame)) * frame - n
    return F.concat(data, F.unhex(F.repeat(F.lit("FF"), pad.cast("int"))))
