from __future__ import annotations

import random

import pytest
from conftest import edge_rows
from pyspark.sql import functions as F

from oreline.llm import ogg as O


def slow_checksum(page: bytes) -> int:
    """The page checksum bit by bit."""
    crc = 0
    for b in page:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def test_checksum():
    r = random.Random(1)
    for n in (0, 1, 27, 300):
        data = r.randbytes(n)
        assert O.page_checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("n", [0, 1, 254, 255, 256, 576, 255 * 255, 255 * 256, 100_000])
def test_packets_of_any_size_survive(n):
    r = random.Random(n)
    packets = [r.randbytes(n), b"", r.randbytes(7), r.randbytes(n)]
    data = b"".join(O.pages_of(5, packets, [1, 2, 3, 4]))
    (s,) = O.demux(data)
    assert s["packets"] == packets and s["granule"] == 4 and s["ended"] and not s["bad_pages"]


def test_streams_are_separated_and_damage_is_seen():
    data = O.mux(bytes(range(256)) * 300, b"note")
    sound, notes = O.demux(data)
    assert b"".join(sound["packets"][1:]) == bytes(range(256)) * 300 and notes["packets"][1] == b"note"
    broken = bytearray(data)
    broken[len(data) // 2] ^= 1
    s = O.demux(bytes(broken))[0]
    assert s["bad_pages"] == 1 and len(s["packets"]) < len(sound["packets"])
    assert O.demux(b"") == [] and O.demux(b"no ogg here") == [] and O.demux(data[: len(data) // 2])[0]["packets"]


def test_table(edges, nothing):
    made = edges.withColumn("payload", O.padded_payload(F.col("text"))).withColumn("media", O.mux_ogg(F.col("payload"), F.lit("n").cast("binary")))
    rows = O.demux_ogg(made).select("text", "payload", "media", "streams").collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        raw = (r["text"] or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert bytes(r["payload"]) == padded == bytes(r["streams"][0]["data"])
        assert r["streams"][0]["seconds"] == len(padded) / O.RATE
    assert O.demux_ogg(nothing.withColumn("media", F.lit(None).cast("binary"))).count() == 0
    assert O.demux_ogg(edges.withColumn("media", F.lit(None).cast("binary"))).select("streams").first()[0] == []


def interleaved(sizes: dict[int, list[int]], seed: int = 3) -> tuple[dict[int, list[bytes]], list[bytes]]:
    """Packets of each serial, and the pages of all streams in a random interleaving."""
    r = random.Random(seed)
    packets = {k: [r.randbytes(n) for n in v] for k, v in sizes.items()}
    queues = {}
    for k, v in packets.items():
        ends = [sum(map(len, v[: i + 1])) for i in range(len(v))]
        queues[k] = list(O.pages_of(k, v, ends))
    pages = [queues[k].pop(0) for k in list(queues)]
    while any(queues.values()):
        pages.append(queues[r.choice([k for k in queues if queues[k]])].pop(0))
    return packets, pages


SIZES = {7: [13, 70_000, 90_000, 10, 66_000], 8: [13, 300_000], 9: [13, *[500] * 700]}


def test_interleaved_streams():
    packets, pages = interleaved(SIZES)
    assert len(pages) > 10
    for s in O.demux(b"".join(pages)):
        assert s["packets"] == packets[s["serial"]] and not s["bad_pages"] and not s["lost_pages"] and s["ended"]


@pytest.mark.parametrize("at, bad, stray", [(200, 1, 0), (15, 0, 1)], ids=["body", "serial"])
def test_a_damaged_page_counts_once(at, bad, stray):
    _, pages = interleaved(SIZES)
    i = next(i for i, p in enumerate(pages) if i > 3 and p[14:18] == (8).to_bytes(4, "little") and p[5] == 1)
    pages[i] = pages[i][:at] + bytes([pages[i][at] ^ 64]) + pages[i][at + 1 :]
    got = {s["serial"]: s for s in O.demux(b"".join(pages))}
    assert set(got) == set(SIZES)  # no stream is founded by a damaged page
    assert (got[8]["bad_pages"], got[8]["lost_pages"], got[8]["stray_pages"]) == (bad, 1 - bad, stray)
    assert len(got[8]["packets"]) == 1 and len(got[7]["packets"]) == 5 and not got[7]["bad_pages"]


def test_times_of_packets():
    sound, notes = map(O.described, O.demux(O.mux(bytes(576 * 300), b"note")))
    assert sound["times"] == [576 * (i + 1) / O.RATE for i in range(300)]
    assert notes["times"] == [576 * 300 / O.RATE]
    assert (sound["level"], sound["loudness"], sound["peak"], sound["crossings"]) == (-128.0, 128.0, 128, 0)
    assert O.packet_granules([5, 6, 7], [(30, 2), (-1, 3)], "other") == [None, 30, None]
