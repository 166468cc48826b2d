"""MPEG transport streams (ISO/IEC 13818-1) as a media column.

A text's bytes become an elementary stream of private data: access units of 4,096 bytes,
each in one PES packet with a time stamp, cut into 188-byte transport packets behind a
program association and a program map table. Reading parses the tables, checks each PID's
continuity counters and the tables' checksums, puts the PES packets together again, and
returns time stamps and random-access points. All of it works on the packets as one numpy
matrix per stream; the work is one pass over the scan without a shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from popquilt.llm.common import prepare, table

#: Fixed values of the format.
PACKET, SYNC, NULL_PID, PAT_PID, STREAM_TYPE_PRIVATE, PRIVATE_STREAM_1 = 188, 0x47, 0x1FFF, 0, 0x06, 0xBD
PROGRAM, PMT_PID, DATA_PID = 1, 0x100, 0x101
UNIT, TICKS, KEY_EVERY = 4096, 3600, 8  # bytes and 90 kHz ticks of an access unit; a random-access point each 8 units
ALIGN = 64


def crc32_mpeg(data: bytes) -> int:
    """CRC of table sections: polynomial 0x04C11DB7, not reflected."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def section(table_id: int, number: int, body: bytes) -> bytes:
    """A table section of one part, version 0, with its checksum."""
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _pid(pid: int) -> bytes:
    return (0xE000 | pid).to_bytes(2, "big")


def table_packet(pid: int, data: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + data).ljust(PACKET, b"\xff")


TABLES = table_packet(PAT_PID, section(0, 1, PROGRAM.to_bytes(2, "big") + _pid(PMT_PID))) + table_packet(
    PMT_PID, section(2, PROGRAM, _pid(DATA_PID) + b"\xf0\x00" + bytes([STREAM_TYPE_PRIVATE]) + _pid(DATA_PID) + b"\xf0\x00")
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29 & 0x0E), pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def pes_packet(unit: bytes, pts: int) -> bytes:
    length = 3 + 5 + len(unit)
    head = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (length if length < 1 << 16 else 0).to_bytes(2, "big")
    return head + b"\x84\x80\x05" + _stamp(pts) + unit


def _packets(pes: bytes, pid: int, counter: int, key: bool) -> np.ndarray:
    """One PES packet as rows of 188 bytes. The first row has an adaptation field; the last is stuffed there."""
    first = PACKET - 4 - 2
    rest = max(0, len(pes) - first)
    n = 1 + -(-rest // (PACKET - 4))
    out = np.full((n, PACKET), 0xFF, dtype=np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, pid >> 8, pid & 0xFF
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 0x0F
    data = np.frombuffer(pes, np.uint8)
    take = min(first, len(data))
    out[0, 3] |= 0x20
    out[0, 4], out[0, 5] = PACKET - 5 - take, 0x40 if key else 0
    out[0, PACKET - take :] = data[:take]
    if n > 1:
        full = (n - 2) * (PACKET - 4)
        out[1 : n - 1, 4:] = data[take : take + full].reshape(n - 2, PACKET - 4)
        tail = data[take + full :]
        if (gap := PACKET - 4 - len(tail)) > 0:
            out[n - 1, 3] |= 0x20
            out[n - 1, 4] = gap - 1
            if gap > 1:
                out[n - 1, 5] = 0
        out[n - 1, PACKET - len(tail) :] = tail
    return out


def mux(payload: bytes) -> bytes:
    """A transport stream of one program with one elementary stream: the payload."""
    parts, counter = [TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        rows = _packets(pes_packet(payload[at : at + UNIT], k * TICKS), DATA_PID, counter, k % KEY_EVERY == 0)
        counter += len(rows)
        parts.append(rows.tobytes())
    return b"".join(parts)


@dataclass
class Stream:
    """What a transport stream holds. Units are (time stamp, position of the first packet, random access)."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    lost: int = 0
    repeated: int = 0
    damaged: int = 0
    bad_tables: int = 0
    units: dict[int, list[tuple[int | None, int, bool]]] = field(default_factory=dict)
    payloads: dict[int, bytes] = field(default_factory=dict)

    @property
    def payload(self) -> bytes:
        return b"".join(self.payloads[p] for p in sorted(self.streams) if p in self.payloads)


def _section_body(packet: np.ndarray, start: int, table_id: int) -> bytes | None:
    data = packet[start:].tobytes()
    data = data[1 + data[0] :] if data else b""
    if len(data) < 12 or data[0] != table_id:
        return None
    end = 3 + ((data[1] & 0x0F) << 8 | data[2])
    if end > len(data) or crc32_mpeg(data[:end]):
        return None
    return data[8 : end - 4]


def demux(data: bytes) -> Stream:
    """Reads a transport stream; packets that are damaged, repeated or out of order are counted."""
    out = Stream()
    rows = np.frombuffer(data, np.uint8)[: len(data) // PACKET * PACKET].reshape(-1, PACKET)
    out.packets = len(rows)
    good = (rows[:, 0] == SYNC) & (rows[:, 1] & 0x80 == 0)
    out.damaged = int((~good).sum()) + bool(len(data) % PACKET)
    pids = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    has, adapt = rows[:, 3] & 0x10 != 0, rows[:, 3] & 0x20 != 0
    start = 4 + np.where(adapt, rows[:, 4].astype(np.int32) + 1, 0)
    begins = rows[:, 1] & 0x40 != 0
    good &= start <= PACKET
    for k in np.flatnonzero(good & has & begins & (pids == PAT_PID)):
        body = _section_body(rows[k], start[k], 0)
        out.bad_tables += body is None
        for i in range(0, len(body or b"") - 3, 4):
            if number := body[i] << 8 | body[i + 1]:
                out.programs[number] = (body[i + 2] & 0x1F) << 8 | body[i + 3]
    for pmt in sorted(set(out.programs.values())):
        for k in np.flatnonzero(good & has & begins & (pids == pmt)):
            body = _section_body(rows[k], start[k], 2)
            out.bad_tables += body is None
            i = 4 + ((body[2] & 0x0F) << 8 | body[3]) if body else 0
            while body and i + 5 <= len(body):
                out.streams[(body[i + 1] & 0x1F) << 8 | body[i + 2]] = body[i]
                i += 5 + ((body[i + 3] & 0x0F) << 8 | body[i + 4])
    for pid in out.streams:
        own = np.flatnonzero(good & has & (pids == pid))
        step = np.diff(rows[own, 3] & 0x0F) & 0x0F
        out.repeated += int((step == 0).sum())
        out.lost += int(((step - 1) & 0x0F)[step > 1].sum())
        own = own[np.concatenate([[True], step != 0])] if len(own) else own
        firsts = np.flatnonzero(begins[own])
        units, parts = [], []
        for a, b in zip(firsts, [*firsts[1:], len(own)]):
            span = own[a:b]
            keep = np.arange(PACKET) >= start[span][:, None]
            pes = rows[span][keep].tobytes()
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                out.damaged += 1
                continue
            length = pes[4] << 8 | pes[5]
            pts = None
            if pes[7] & 0x80 and len(pes) >= 14:
                t = pes[9:14]
                pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1
            key = bool(adapt[span[0]] and rows[span[0], 4] and rows[span[0], 5] & 0x40)
            units.append((pts, int(span[0]), key))
            parts.append(pes[9 + pes[8] : 6 + length if length else None])
        out.units[pid], out.payloads[pid] = units, b"".join(parts)
    return out


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with bytes 0 appended up to a positive multiple of 64, and the length before."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    return data.ljust(max(ALIGN, -(-n // ALIGN) * ALIGN), b"\0"), n


def feature(s: Stream) -> str:
    """Counts, time stamps and random-access points as read back."""
    units = [u for p in sorted(s.units) for u in s.units[p]]
    stamps = [u[0] for u in units if u[0] is not None]
    keys = [u[1] for u in units if u[2]]
    access = zlib.crc32(np.array(keys, dtype="<u4").tobytes())
    return (
        f"packets={s.packets};programs={len(s.programs)};streams={len(s.streams)};units={len(units)};"
        f"first_pts={min(stamps, default=-1)};last_pts={max(stamps, default=-1)};access_points={len(keys)};"
        f"access_crc32={access};lost={s.lost};repeated={s.repeated};damaged={s.damaged + s.bad_tables}"
    )


MEDIA = "doc_id long, n_bytes long, media binary"


def encode_media(docs: DataFrame) -> DataFrame:
    """The documents' texts as a column of transport streams. Null texts are empty; empty ones are 64 zero bytes.

    A null doc_id stays null, repeated rows give repeated rows, equal texts give equal
    streams, other columns are not read, and an empty table gives no rows. A text is one
    stream however long; a task holds some hundred streams at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [padded(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([mux(p) for p, _ in made], pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, MEDIA)


def read_media(media: DataFrame, column: str = "media") -> DataFrame:
    """What ``demux`` finds in a column of streams; other columns stay.

    Adds payload, feature, pts and access_points (both lists in stream order, the latter as
    byte positions) and lost (packets missing by the counters). A null stream is empty;
    repeated rows stay, and an empty table gives no rows.
    """
    kept = [c for c in media.columns if c != column]
    added = "payload binary, feature string, pts array<long>, access_points array<long>, lost long"
    schema = ", ".join([f"`{c}` {t}" for c, t in media.dtypes if c != column] + [added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.names.index(column)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                read = [demux(m.as_py() or b"") for m in part.column(place)]
                units = [[u for p in sorted(s.units) for u in s.units[p]] for s in read]
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k, c in enumerate(part.schema.names) if c != column]
                    + [
                        pa.array([s.payload for s in read], pa.binary()),
                        pa.array([feature(s) for s in read]),
                        pa.array([[u[0] for u in us] for us in units], pa.list_(pa.int64())),
                        pa.array([[u[1] * PACKET for u in us if u[2]] for us in units], pa.list_(pa.int64())),
                        pa.array([s.lost for s in read], pa.int64()),
                    ],
                    names=[*kept, "payload", "feature", "pts", "access_points", "lost"],
                )

    return media.mapInArrow(run, schema)


def op6_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's stream. The streams pass through one task row by row and are not kept."""
    docs = table(prepare(spark), sf_dir, "documents")
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part, rows = batch.slice(at, 1024), []
                for media in part.column(2):
                    m = media.as_py()
                    s = demux(m)
                    p = s.payload
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-ALIGN:]), len(m), hashlib.sha256(m).hexdigest(), feature(s)))
                cols = list(zip(*rows)) or [[]] * 6
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(cols, types))],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return encode_media(docs).mapInArrow(run, schema)
