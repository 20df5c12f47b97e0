"""MPEG transport streams as media columns.

A payload is stored losslessly as a private elementary stream: access units of
a fixed size become elementary packets (PES) with time stamps, cut into
188-byte transport packets. Program tables (PAT, PMT) are repeated, continuity
counters run on each PID, and every few units one is marked as a random-access
point with a clock reference.

Reading takes any transport stream: it finds the program tables and checks
their CRC, checks continuity counters, reassembles elementary packets and keeps
their time stamps and random-access points. Lost, damaged, repeated or
scrambled packets are counted, not fatal.

A null payload gives a null stream; an empty or null text is padded to 64 zero
bytes. A very long text is a stream of many units. Repeated rows give equal
streams, one each; an empty table gives no rows. Equal payloads give equal
streams, whatever the other columns hold and are called: only those asked for
are read. What is less than a packet at the end of a stream counts as damaged.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import map_batches, utf8

# Fixed values of ISO/IEC 13818-1.
PACKET, SYNC = 188, 0x47
PAT_PID, NULL_PID = 0x0000, 0x1FFF
PAT_TABLE, PMT_TABLE = 0x00, 0x02
PRIVATE_TYPE, PRIVATE_STREAM = 0x06, 0xBD
CLOCK = 90_000

# Choices of this writer.
PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
UNIT_BYTES = 4096
UNIT_TICKS = CLOCK // 25
UNITS_A_GROUP = 8
FIRST_PTS = CLOCK


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        crc = n << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
        table.append(crc & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ byte]
    return crc


def section(table: int, number: int, body: bytes) -> bytes:
    """A complete table section with its CRC."""
    head = bytes((table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255)) + number.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


PAT = section(PAT_TABLE, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = section(PMT_TABLE, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes((PRIVATE_TYPE,)) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0")


def time_stamp(mark: int, ticks: int) -> bytes:
    """33 bits in five bytes with marker bits."""
    return bytes((mark << 4 | (ticks >> 29) & 0x0E | 1, ticks >> 22 & 255, (ticks >> 14) & 0xFE | 1, ticks >> 7 & 255, (ticks << 1) & 0xFE | 1))


def read_time_stamp(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def elementary_packet(data: bytes, pts: int) -> bytes:
    return b"\0\0\1" + bytes((PRIVATE_STREAM,)) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + time_stamp(2, pts) + data


def _transport(pid: int, start: bool, counter: int, field_: bytes | None, data: bytes) -> bytes:
    """One transport packet; ``field_`` is the adaptation field without its length byte."""
    room = PACKET - 4 - len(data)
    head = bytes((SYNC, start << 6 | pid >> 8, pid & 255, (0x30 if room else 0x10) | counter))
    if not room:
        return head + data
    inner = field_ if field_ is not None else (b"\0" if room > 1 else b"")
    return head + bytes((room - 1,)) + inner + b"\xff" * (room - 1 - len(inner)) + data


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    out, counters = [], {PAT_PID: 0, PMT_PID: 0, DATA_PID: 0}

    def send(pid: int, start: bool, field_: bytes | None, data: bytes) -> None:
        out.append(_transport(pid, start, counters[pid], field_, data))
        counters[pid] = (counters[pid] + 1) & 15

    for unit, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        pts = (FIRST_PTS + unit * UNIT_TICKS) % (1 << 33)
        packet = elementary_packet(payload[at : at + UNIT_BYTES], pts)
        field_ = None
        if unit % UNITS_A_GROUP == 0:
            for pid, table in ((PAT_PID, PAT), (PMT_PID, PMT)):
                send(pid, True, None, (b"\0" + table).ljust(PACKET - 4, b"\xff"))
            clock = pts - UNIT_TICKS
            field_ = b"\x50" + (clock << 15 | 0x7E00).to_bytes(6, "big")  # random access, clock reference
        first = PACKET - 4 - (len(field_) + 1 if field_ else 0)
        send(DATA_PID, True, field_, packet[:first])
        for start in range(first, len(packet), PACKET - 4):
            send(DATA_PID, False, None, packet[start : start + PACKET - 4])
    return b"".join(out)


@dataclass
class Unit:
    """An elementary packet as reassembled."""

    pid: int
    pts: int | None
    dts: int | None
    random_access: bool
    data: bytes


@dataclass
class Stream:
    """What a transport stream holds."""

    programs: dict[int, int] = field(default_factory=dict)
    types: dict[int, int] = field(default_factory=dict)
    units: list[Unit] = field(default_factory=list)
    packets: int = 0
    continuity_errors: int = 0
    repeated: int = 0
    damaged: int = 0
    bad_tables: int = 0
    clocks: list[int] = field(default_factory=list)


class Demuxer:
    """Reads one transport stream."""

    def __init__(self) -> None:
        self.out = Stream()
        self.counters: dict[int, int] = {}
        self.last: dict[int, bytes] = {}
        self.tables: dict[int, bytearray] = {}
        self.open: dict[int, tuple[bool, list[bytes]]] = {}

    def read(self, data: bytes) -> Stream:
        at = 0
        while at + PACKET <= len(data):
            if data[at] != SYNC:
                self.out.damaged += 1
                at = data.find(SYNC, at + 1)
                while at >= 0 and at + PACKET < len(data) and data[at + PACKET] != SYNC:
                    at = data.find(SYNC, at + 1)
                if at < 0:
                    break
                continue
            self.packet(data[at : at + PACKET])
            at += PACKET
        if 0 <= at < len(data):  # less than a packet at the end
            self.out.damaged += 1
        for pid in list(self.open):
            self.close(pid)
        return self.out

    def packet(self, p: bytes) -> None:
        out = self.out
        out.packets += 1
        if p[1] & 0x80 or p[3] & 0xC0:  # transport error, scrambled
            out.damaged += 1
            return
        pid = (p[1] & 0x1F) << 8 | p[2]
        if pid == NULL_PID:
            return
        start, counter, at, random, jump = p[1] & 0x40, p[3] & 15, 4, False, False
        if p[3] & 0x20:
            if p[4]:
                flags = p[5]
                jump, random = bool(flags & 0x80), bool(flags & 0x40)
                if flags & 0x10 and p[4] >= 7:
                    out.clocks.append(int.from_bytes(p[6:12], "big") >> 15)
            at = 5 + p[4]
        if not p[3] & 0x10 or at > PACKET:
            return
        before = self.counters.get(pid)
        if before is not None and not jump and counter != (before + 1) & 15:
            if counter == before and self.last[pid] == p:
                out.repeated += 1
                return
            out.continuity_errors += 1
            self.open.pop(pid, None)
            self.tables.pop(pid, None)
        self.counters[pid], self.last[pid] = counter, p
        body = p[at:]
        if pid == PAT_PID or pid in out.programs.values():
            self.table(pid, bool(start), body)
        elif start:
            self.close(pid)
            self.open[pid] = (random, [body])
        elif pid in self.open:
            self.open[pid][1].append(body)

    def table(self, pid: int, start: bool, body: bytes) -> None:
        if start:
            held = bytes(self.tables.pop(pid, b""))
            if held:
                self.sections(pid, held + body[1 : 1 + body[0]])
            rest = self.sections(pid, body[1 + body[0] :])
        elif pid in self.tables:
            rest = self.sections(pid, bytes(self.tables[pid]) + body)
        else:
            return
        if rest:
            self.tables[pid] = bytearray(rest)
        else:
            self.tables.pop(pid, None)

    def sections(self, pid: int, data: bytes) -> bytes:
        """Take all whole sections; what is left belongs to one that goes on."""
        while len(data) >= 3 and data[0] != 0xFF:
            end = 3 + ((data[1] & 0x0F) << 8 | data[2])
            if end > len(data):
                return data
            one, data = data[:end], data[end:]
            if end < 12 or crc32_mpeg(one):
                self.out.bad_tables += 1
            elif one[0] == PAT_TABLE and pid == PAT_PID:
                for k in range(8, end - 4, 4):
                    if number := one[k] << 8 | one[k + 1]:
                        self.out.programs[number] = (one[k + 2] & 0x1F) << 8 | one[k + 3]
            elif one[0] == PMT_TABLE:
                k = 12 + ((one[10] & 0x0F) << 8 | one[11])
                while k + 5 <= end - 4:
                    self.out.types[(one[k + 1] & 0x1F) << 8 | one[k + 2]] = one[k]
                    k += 5 + ((one[k + 3] & 0x0F) << 8 | one[k + 4])
        return b"" if data[:1] == b"\xff" else data

    def close(self, pid: int) -> None:
        """End the elementary packet of a PID, if one is open and whole."""
        if pid not in self.open:
            return
        random, parts = self.open.pop(pid)
        data = b"".join(parts)
        if len(data) < 9 or data[:3] != b"\0\0\1":
            self.out.damaged += 1
            return
        size = data[4] << 8 | data[5]
        if size and len(data) < 6 + size:
            self.out.damaged += 1
            return
        if size:
            data = data[: 6 + size]
        pts = dts = None
        if data[7] & 0x80 and len(data) >= 14:
            pts = read_time_stamp(data[9:14])
            if data[7] & 0x40 and len(data) >= 19:
                dts = read_time_stamp(data[14:19])
        self.out.units.append(Unit(pid, pts, dts, random, data[9 + data[8] :]))


def demux(data: bytes) -> Stream:
    return Demuxer().read(data)


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % 64 if text else 64)


def store_texts(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The id, ``n_bytes`` and ``media``, the padded text as a transport stream, of each row."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bodies = [v.as_py() for v in batch.column(1)]
        sizes, media = pa.array(map(len, bodies), pa.int64()), pa.array([mux(padded(b)) for b in bodies], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), sizes, media], [id_column, "n_bytes", "media"])

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(docs.select(id_column, utf8(text)), run, f"`{id_column}` {kind}, n_bytes long, media binary")


UNITS = "unit int, pid int, stream_type int, pts long, dts long, random_access boolean, data binary"


def elementary_packets(streams: DataFrame, media: str = "media", id_column: str = "doc_id") -> DataFrame:
    """A row for each elementary packet of each stream, in order."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for doc_id, value in zip(*batch.columns):
            stream = demux(value.as_py() or b"")
            rows = [(doc_id.as_py(), n, u.pid, stream.types.get(u.pid), u.pts, u.dts, u.random_access, u.data) for n, u in enumerate(stream.units)]
            if rows:
                kinds = (batch.schema.types[0], pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [id_column, *(x.split()[0] for x in UNITS.split(", "))])

    kind = streams.schema[id_column].dataType.simpleString()
    return map_batches(streams.select(id_column, media), run, f"`{id_column}` {kind}, {UNITS}")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_packets long, n_units long, n_random_access long, first_pts long, last_pts long, continuity_errors long, feature string"


def stream_features(streams: DataFrame, media: str = "media", id_column: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, the columns ``keep`` and, for each stream, figures from reading it; null for a null stream."""

    def features(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 12
        stream = demux(data)
        payload = b"".join(u.data for u in stream.units)
        stamps = [u.pts for u in stream.units if u.pts is not None]
        points = [n for n, u in enumerate(stream.units) if u.random_access]
        programs = ",".join(f"{n}:{pid}" for n, pid in sorted(stream.programs.items()))
        types = ",".join(f"{pid}:{kind}" for pid, kind in sorted(stream.types.items()))
        feature = f"programs={programs};streams={types};packets={stream.packets};units={len(stream.units)};random_access={len(points)};clocks={len(stream.clocks)};pts={min(stamps, default='')}-{max(stamps, default='')};continuity_errors={stream.continuity_errors};repeated={stream.repeated};damaged={stream.damaged}"
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), stream.packets,
            len(stream.units), len(points), min(stamps, default=None), max(stamps, default=None), stream.continuity_errors, feature,
        )

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [features(v.as_py()) for v in batch.column(batch.num_columns - 1)]
        names = [x.split() for x in FEATURES.split(", ")]
        made = [pa.array(c, pa.string() if kind == "string" else pa.int64()) for c, (_, kind) in zip(zip(*rows), names)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [id_column, *keep, *(n for n, _ in names)])

    kept = ", ".join(f"`{c}` {streams.schema[c].dataType.simpleString()}" for c in (id_column, *keep))
    return map_batches(streams.select(id_column, *keep, F.col(media)), run, f"{kept}, {FEATURES}")
