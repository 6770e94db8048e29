"""Payloads as MPEG transport streams: multiplexing, and reading streams back.

A stream holds one program: a program association table on PID 0, a program map on PID
0x1000 and one elementary stream of private data (stream_type 6, stream_id 0xBD) on PID
0x100. Each access unit of at most UNIT_BYTES is one PES packet with a 33-bit time stamp;
its first transport packet carries a clock reference, and every UNITS_PER_POINT-th unit
is marked as a random-access point.

Defined results: a null text is an empty one; an empty payload can't occur in the query,
as texts are padded to 64 bytes at least, and gives a stream of tables alone in mux().
A stream that breaks the format (lost sync, bad table CRC, no program) gives a row with
``error`` set and no payload; gaps in the continuity counters, repeated and damaged
packets are counted, not fatal.
Rows are independent: ties, repeated rows and clashing extra columns change nothing.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import map_batches

# Fixed values of ISO/IEC 13818-1.
PACKET = 188
SYNC = 0x47
PAT_PID = 0x0000
PMT_PID = 0x1000
DATA_PID = 0x0100
PRIVATE_TYPE = 0x06
PRIVATE_ID = 0xBD
CRC_POLYNOMIAL = 0x04C11DB7
CLOCK = 90_000

UNIT_BYTES = 8192
UNIT_TICKS = 3000
UNITS_PER_POINT = 4


@lru_cache(maxsize=1024)
def table_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ CRC_POLYNOMIAL if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    length = len(body) + 9
    head = bytes([table_id, 0xB0 | length >> 8, length & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0])
    made = head + body
    return made + table_crc(made).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(PAT_PID, _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))) + _table_packet(
    PMT_PID, _section(2, 1, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0, PRIVATE_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0]))
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


def _read_stamp(b: bytes) -> int:
    return ((b[0] >> 1) & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    parts, counter = [_TABLES], 0
    for index, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        unit = payload[at : at + UNIT_BYTES]
        pts = (CLOCK + index * UNIT_TICKS) % (1 << 33)
        length = len(unit) + 8
        pes = b"\x00\x00\x01" + bytes([PRIVATE_ID, length >> 8, length & 0xFF, 0x80, 0x80, 5]) + _stamp(pts) + unit
        rest = max(0, len(pes) - 176)
        n = 1 + -(-rest // 184)
        rows = np.full((n, PACKET), 0xFF, np.uint8)
        rows[:, 0] = SYNC
        rows[:, 1] = DATA_PID >> 8
        rows[:, 2] = DATA_PID & 0xFF
        rows[:, 3] = 0x10 | (counter + np.arange(n)) & 0x0F
        counter += n
        rows[0, 1] |= 0x40
        first = min(176, len(pes))
        rows[0, 3] |= 0x20
        rows[0, 4] = 183 - first
        rows[0, 5] = 0x10 | (0x40 if index % UNITS_PER_POINT == 0 else 0)
        rows[0, 6:12] = [(pts >> 25) & 0xFF, (pts >> 17) & 0xFF, (pts >> 9) & 0xFF, (pts >> 1) & 0xFF, (pts & 1) << 7 | 0x7E, 0]
        raw = np.frombuffer(pes, np.uint8)
        rows[0, PACKET - first :] = raw[:first]
        if n > 1:
            whole, tail = divmod(rest, 184)
            rows[1 : 1 + whole, 4:] = raw[first : first + whole * 184].reshape(whole, 184)
            if tail:
                rows[-1, 3] |= 0x20
                rows[-1, 4] = 183 - tail
                if tail < 183:
                    rows[-1, 5] = 0
                rows[-1, PACKET - tail :] = raw[first + whole * 184 :]
        parts.append(rows.tobytes())
    return b"".join(parts)


class BadStream(ValueError):
    """The bytes aren't a transport stream with one readable program."""


def _table(packets: np.ndarray, pid: np.ndarray, wanted: int, table_id: int) -> bytes:
    """The first whole section of a PID with that table id, put together from as many packets as it takes."""
    section = b""
    for packet in packets[np.flatnonzero((pid == wanted) & (packets[:, 3] & 0x10 > 0))]:
        raw = packet.tobytes()
        start = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
        begins = raw[1] & 0x40 > 0
        if begins:
            start += 1 + raw[start]
        elif not section:
            continue
        section = raw[start:] if begins and not (section and len(section) < 3) else section + raw[start:]
        while len(section) >= 3 and section[0] != 0xFF:
            size = 3 + ((section[1] & 0x0F) << 8 | section[2])
            if len(section) < size:
                break
            if table_crc(section[:size]):
                raise BadStream(f"bad table {table_id}")
            if section[0] == table_id:
                return section[:size]
            section = section[size:]
        else:
            section = b""
    raise BadStream(f"no table {table_id}")


def demux(media: bytes) -> dict:
    """Program, continuity, payload and units of a stream; raises BadStream.

    The first stream of the first program is read; other programs, streams and tables are
    passed over. Packets marked as damaged are left out and counted. A packet that repeats
    the one before it (same counter, same payload) is dropped and counted; other jumps of
    the counter are gaps, but where a discontinuity is announced. Units of length 0 go on
    to the next one. What comes before the first unit's start (a stream that is entered in
    its middle) is passed over. A unit without a time stamp has none.
    """
    if not media or len(media) % PACKET:
        raise BadStream("not whole packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise BadStream("lost sync")
    total = len(packets)
    damaged = packets[:, 1] & 0x80 > 0
    number = np.flatnonzero(~damaged)
    packets = packets[number]
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    pat = _table(packets, pid, PAT_PID, 0)
    programs = [((pat[i] << 8 | pat[i + 1]), (pat[i + 2] & 0x1F) << 8 | pat[i + 3]) for i in range(8, len(pat) - 4, 4)]
    programs = [p for p in programs if p[0]]
    if not programs:
        raise BadStream("no program")
    pmt = _table(packets, pid, programs[0][1], 2)
    at = 12 + ((pmt[10] & 0x0F) << 8 | pmt[11])
    if at + 5 > len(pmt) - 4:
        raise BadStream("no stream")
    stream_type, data_pid = pmt[at], (pmt[at + 1] & 0x1F) << 8 | pmt[at + 2]

    where = np.flatnonzero((pid == data_pid) & (packets[:, 3] & 0x10 > 0))
    own = packets[where]
    adapted = (own[:, 3] & 0x20 > 0) & (own[:, 4] > 0)
    start = np.minimum(4 + np.where(own[:, 3] & 0x20 > 0, own[:, 4].astype(np.int64) + 1, 0), PACKET)
    counters = own[:, 3].astype(np.int32) & 0x0F
    step = np.diff(counters) % 16
    payloads = np.where(np.arange(PACKET) >= start[:, None], own, 0)
    repeat = np.r_[False, (step == 0) & (start[1:] == start[:-1]) & (payloads[1:] == payloads[:-1]).all(axis=1)] if len(own) else np.zeros(0, bool)
    where, own, adapted, start, counters = where[~repeat], own[~repeat], adapted[~repeat], start[~repeat], counters[~repeat]
    announced = adapted & (own[:, 5] & 0x80 > 0)
    gaps = int(((np.diff(counters) % 16 != 1) & ~announced[1:]).sum()) if len(own) else 0
    elementary = own[np.arange(PACKET) >= start[:, None]].tobytes()
    begins = np.concatenate([[0], np.cumsum(PACKET - start)])
    heads = np.flatnonzero(own[:, 1] & 0x40 > 0)
    random_access = (adapted & (own[:, 5] & 0x40 > 0))[heads]
    units, payload = [], []
    for k, head in enumerate(heads):
        end = begins[heads[k + 1]] if k + 1 < len(heads) else begins[-1]
        pes = elementary[begins[head] : end]
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 9 or len(pes) < 9 + pes[8]:
            raise BadStream("bad PES start")
        size = pes[4] << 8 | pes[5]
        body = pes[9 + pes[8] : 6 + size if size else None]
        stamped = pes[7] & 0x80 and pes[8] >= 5
        units.append({"pts": _read_stamp(pes[9:14]) if stamped else None, "packet": int(number[where[head]]), "bytes": len(body), "random_access": bool(random_access[k])})
        payload.append(body)
    return {"program": programs[0][0], "pid": data_pid, "stream_type": stream_type, "packets": total, "damaged": int(damaged.sum()), "repeats": int(repeat.sum()), "gaps": gaps, "payload": b"".join(payload), "units": units}


MEDIA = "media binary"
READ = "program int, pid int, stream_type int, packets long, damaged long, repeats long, gaps long, payload binary, units array<struct<pts:long,packet:long,bytes:long,random_access:boolean>>, error string"
_READ_TYPE = pa.struct(
    [
        ("program", pa.int32()),
        ("pid", pa.int32()),
        ("stream_type", pa.int32()),
        ("packets", pa.int64()),
        ("damaged", pa.int64()),
        ("repeats", pa.int64()),
        ("gaps", pa.int64()),
        ("payload", pa.binary()),
        ("units", pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64()), ("bytes", pa.int64()), ("random_access", pa.bool_())]))),
        ("error", pa.string()),
    ]
)


def store(df: DataFrame, payload: str = "payload", key: str = "doc_id") -> DataFrame:
    """(key, media): each payload (binary, null as empty) as a transport stream."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        media = pa.array([mux(x or b"") for x in batch.column(1).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), media], ["key", "media"])

    kind = df.schema[key].dataType.simpleString()
    made = map_batches(df.select(F.col(key).alias("key"), F.col(payload).alias("payload")), step, f"key {kind}, {MEDIA}", "payload")
    return made.select(F.col("key").alias(key), "media")


def read(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """(key, media, read): every stored stream parsed; ``read`` is the struct READ."""

    def one(raw: bytes | None) -> dict:
        try:
            return demux(raw or b"") | {"error": None}
        except (BadStream, IndexError) as e:
            return dict.fromkeys(_READ_TYPE.names) | {"error": str(e) or "cut short"}

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = pa.array([one(x) for x in batch.column(1).to_pylist()], _READ_TYPE)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), got], ["key", "media", "read"])

    kind = df.schema[key].dataType.simpleString()
    fields = ", ".join(x.replace(" ", ": ", 1) for x in READ.split(", "))
    made = map_batches(df.select(F.col(key).alias("key"), F.col(media).alias("media")), step, f"key {kind}, media binary, read struct<{fields}>", "media")
    return made.select(F.col("key").alias(key), "media", "read")


def padded(text: F.Column) -> F.Column:
    """The text's UTF-8 bytes with bytes 0 up to a positive multiple of 64."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.greatest(F.lit(64), (F.ceil(F.octet_length(raw) / 64) * 64).cast("int"))
    return F.rpad(raw, size, F.lit(b"\x00"))


def media_digest(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Stores each text's padded bytes, reads them back and returns digests and features."""
    source = df.select(F.col(key).alias("doc_id"), padded(F.col(text)).alias("payload"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"))
    # n_bytes rides in the key, so that rows need no join afterwards
    keyed = source.select(F.struct("doc_id", "n_bytes").alias("key"), "payload")
    got = read(store(keyed, "payload", "key"), "media", "key")
    units = F.col("read.units")
    points = F.filter(units, lambda u: u["random_access"])
    return got.select(
        F.col("key.doc_id").alias("doc_id"),
        F.col("key.n_bytes").alias("n_bytes"),
        F.octet_length("read.payload").cast("long").alias("payload_bytes"),
        F.sha2(F.col("read.payload"), 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("read.payload"), -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2(F.col("media"), 256).alias("media_sha256"),
        F.format_string(
            "mpegts pid=%d type=%d packets=%d units=%d gaps=%d pts=%d-%d points=%d last_point=%d",
            "read.pid",
            "read.stream_type",
            "read.packets",
            F.size(units),
            "read.gaps",
            F.array_min(F.transform(units, lambda u: u["pts"])),
            F.array_max(F.transform(units, lambda u: u["pts"])),
            F.size(points),
            F.array_max(F.transform(points, lambda u: u["packet"])),
        ).alias("feature"),
    )
