import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import transport as T


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=700), st.sampled_from([1, 12, 40, 90]))
def test_round_trip(data, times):
    data = data * times
    got = T.demux(T.mux(data))
    assert got["payload"] == data and got["gaps"] == 0 and got["stream_type"] == 6
    assert sum(u["bytes"] for u in got["units"]) == len(data)
    assert [u["random_access"] for u in got["units"]] == [k % T.UNITS_PER_POINT == 0 for k in range(len(got["units"]))]
    assert [u["pts"] for u in got["units"]] == [T.CLOCK + k * T.UNIT_TICKS for k in range(len(got["units"]))]


def test_gaps_and_bad_streams():
    media = T.mux(b"x" * 5000)
    assert T.demux(media[: 6 * 188] + media[7 * 188 :])["gaps"] == 1
    for bad in (b"", media[:100], b"\x00" + media[1:], media[:10] + b"\x01" + media[11:]):
        with pytest.raises(T.BadStream):
            T.demux(bad)


def test_digest_of_odd_rows(spark):
    rows = [(1, "a" * 64, "x"), (2, None, None), (None, "", "x"), (3, "é" * 40, "x"), (3, "é" * 40, "y"), (4, "wörd " * 30000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = T.media_digest(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        raw = text.encode()
        raw += bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(text.encode()), len(raw))
        assert r.payload_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.tail_crc32 == zlib.crc32(raw[-64:])
        assert r.media_sha256 == hashlib.sha256(T.mux(raw)).hexdigest() and r.media_bytes == len(T.mux(raw))
    assert T.media_digest(df.limit(0)).count() == 0


def test_unreadable_rows_keep_their_row(spark):
    df = spark.createDataFrame([(1, b"no"), (2, None)], "doc_id long, media binary")
    got = T.read(df).collect()
    assert all(r["read"]["error"] and r["read"]["payload"] is None for r in got)


def packet(pid, counter, payload, start=False, adaptation=None, damaged=False):
    """A transport packet written out by the standard's field order, apart from the code under test."""
    head = bytes([0x47, (0x80 if damaged else 0) | (0x40 if start else 0) | pid >> 8, pid & 0xFF])
    room = 184 - len(payload)
    field = b"" if adaptation is None and not room else bytes([room - 1]) + (bytes([adaptation or 0]) + b"\xff" * (room - 2) if room > 1 else b"")
    return head + bytes([(0x30 if field else 0x10) | counter & 15]) + field + payload


def section(table_id, number, body):
    made = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0]) + body
    crc = 0xFFFFFFFF
    for bit in (b >> k & 1 for b in made for k in range(7, -1, -1)):
        crc = ((crc << 1) ^ (0x04C11DB7 if (crc >> 31) ^ bit else 0)) & 0xFFFFFFFF
    return made + crc.to_bytes(4, "big")


def tables(streams=b"\x1b\xe1\x00\xf0\x00", info=b""):
    pat = b"\x00" + section(0, 7, bytes([0, 0, 0xE0, 0x10, 0, 1, 0xF0, 0x00]))
    pmt = b"\x00" + section(2, 1, bytes([0xE1, 0x00, 0xF0 | len(info) >> 8, len(info) & 0xFF]) + info + streams)
    out = packet(0, 0, pat.ljust(184, b"\xff"), True)
    for k, at in enumerate(range(0, len(pmt), 184)):
        out += packet(0x1000, k, pmt[at : at + 184].ljust(184, b"\xff"), at == 0)
    return out


def pes(body, stamped=True, length=True):
    head = bytes([0x80, 0x80 if stamped else 0, 5 if stamped else 0]) + (bytes([0x21, 0, 0x01, 0x07, 0xD1]) if stamped else b"")
    return b"\x00\x00\x01\xe0" + ((len(head) + len(body)) if length else 0).to_bytes(2, "big") + head + body


def carried(raw, counter=0, adaptation=None):
    """A PES packet over as many transport packets as it takes."""
    return b"".join(packet(0x100, counter + k, raw[at : at + (182 if k == 0 else 184)], at == 0, adaptation if k == 0 else None) for k, at in enumerate([0, *range(182, len(raw), 184)]))


def test_streams_that_others_would_write():
    body = bytes(range(256)) * 3
    # a unit of length 0, a table section over two packets, another program's entry, a second stream
    info = bytes([0x05, 200]) + b"x" * 200
    made = tables(b"\x1b\xe1\x00\xf0\x00\x0f\xe1\x01\xf0\x00", info) + carried(pes(body, length=False), 3, 0x40) + packet(0x101, 9, b"z" * 184, True) + carried(pes(b"q" * 10, stamped=False), 8)
    got = T.demux(made)
    assert (got["program"], got["pid"], got["stream_type"], got["gaps"], got["repeats"]) == (1, 0x100, 0x1B, 0, 0)
    assert got["payload"] == body + b"q" * 10 and [u["pts"] for u in got["units"]] == [1000, None] and [u["random_access"] for u in got["units"]] == [True, False]


def test_repeated_damaged_and_missing_packets():
    raw = carried(pes(b"a" * 900), 0)
    parts = [raw[k : k + 188] for k in range(0, len(raw), 188)]
    twice = T.demux(tables() + b"".join([parts[0], parts[1], parts[1], *parts[2:]]))
    assert twice["payload"] == b"a" * 900 and twice["repeats"] == 1 and twice["gaps"] == 0
    lost = T.demux(tables() + b"".join([parts[0], *parts[2:]]))
    assert lost["gaps"] == 1 and len(lost["payload"]) < 900
    hurt = T.demux(tables() + b"".join([parts[0], packet(0x100, 1, b"!" * 184, damaged=True), *parts[1:]]))
    assert hurt["damaged"] == 1 and hurt["payload"] == b"a" * 900
    announced = T.demux(tables() + raw + carried(pes(b"b" * 5), 12, 0x80))
    assert announced["gaps"] == 0 and announced["payload"] == b"a" * 900 + b"b" * 5
    entered = T.demux(tables() + b"".join(parts[2:]) + carried(pes(b"c" * 5), len(parts)))
    assert entered["payload"] == b"c" * 5
