"""Media columns as MPEG transport streams: multiplex bytes into 188-byte packets and read them back.

A payload becomes one programme with one private elementary stream: a programme association table
(PID 0), a programme map table, then packetised elementary (PES) packets cut into transport packets
with continuity counters. Every PES packet has a presentation time stamp; the first and every
``RANDOM_ACCESS``-th one carry the random-access flag and a clock reference in an adaptation field.

Reading parses both tables (with their CRC-32), checks the continuity counters, reassembles the PES
packets and returns the elementary bytes with the time stamps and the random-access points.

Packets of a document are made and read as numpy rows; one narrow pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import tidied

PACKET, SYNC = 188, 0x47
TABLE_PID, MAP_PID, DATA_PID, PROGRAMME = 0x0000, 0x1000, 0x0100, 1
#: Private data in PES packets.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
#: Bytes of payload in a PES packet; time stamps step by a frame of 25 a second on a 90 kHz clock.
PES_PAYLOAD, FRAME = 8192, 3600
RANDOM_ACCESS = 4
#: The padded payload is a positive multiple of this.
ALIGN = 64


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """CRC-32 of table sections: polynomial 0x04C11DB7, most significant bit first, no final xor."""
    c = 0xFFFFFFFF
    for byte in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ byte]
    return c


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return packet + b"\xff" * (PACKET - len(packet))


TABLES = _table_packet(
    TABLE_PID, _section(0x00, 1, PROGRAMME.to_bytes(2, "big") + (0xE000 | MAP_PID).to_bytes(2, "big"))
) + _table_packet(
    MAP_PID,
    _section(0x02, PROGRAMME, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"),
)


def _stamp(pts: int) -> bytes:
    """A 33-bit presentation time stamp in its five marked bytes."""
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    parts, counter = [TABLES], 0
    for k, at in enumerate(range(0, len(payload), PES_PAYLOAD)):
        chunk = payload[at : at + PES_PAYLOAD]
        pts = k * FRAME & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(chunk) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(pts) + chunk
        field = b""
        if k % RANDOM_ACCESS == 0:  # flags: random access, clock reference
            field = b"\x07\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big")
        n = -(-(len(pes) + len(field)) // (PACKET - 4))
        rows = np.full((n, PACKET), 0xFF, np.uint8)
        rows[:, 0] = SYNC
        rows[:, 1] = DATA_PID >> 8
        rows[0, 1] |= 0x40
        rows[:, 2] = DATA_PID & 0xFF
        rows[:, 3] = 0x10 | (counter + np.arange(n)) % 16
        counter = (counter + n) % 16
        data = np.frombuffer(pes, np.uint8)
        first = PACKET - 4 - len(field)
        if field:
            rows[0, 3] |= 0x20
            rows[0, 4 : 4 + len(field)] = np.frombuffer(field, np.uint8)
        short = n * (PACKET - 4) - len(field) - len(pes)  # stuffing of the last packet
        if short and n > 1:
            rows[-1, 3] |= 0x20
            rows[-1, 4] = short - 1
            if short > 1:
                rows[-1, 5] = 0
        if n == 1:
            if short:  # one packet: its adaptation field takes the stuffing too
                rows[0, 3] |= 0x20
                rows[0, 4] = len(field) + short - 1
                if not field and short > 1:
                    rows[0, 5] = 0
            rows[0, PACKET - len(data) :] = data
        else:
            rows[0, PACKET - first :] = data[:first]
            rows[1:-1, 4:] = data[first : first + (n - 2) * (PACKET - 4)].reshape(-1, PACKET - 4)
            rest = data[first + (n - 2) * (PACKET - 4) :]
            rows[-1, PACKET - len(rest) :] = rest
        parts.append(rows.tobytes())
    return b"".join(parts)


class Stream(NamedTuple):
    payload: bytes
    stamps: list[int]  # of the PES packets, 90 kHz
    random_access: list[int]  # byte offsets into the payload where reading can begin
    packets: int
    discontinuities: int
    error: str | None


def _sections(rows: np.ndarray, pid: int) -> bytes | None:
    """The first whole table section of a PID with a right CRC, without its CRC."""
    pids = (rows[:, 1].astype(int) & 0x1F) << 8 | rows[:, 2]
    for row in rows[(pids == pid) & (rows[:, 1] & 0x40 > 0)]:
        body = row[5 + row[4] :].tobytes()
        length = int.from_bytes(body[1:3], "big") & 0xFFF
        section = body[: 3 + length]
        if crc32_mpeg(section) == 0:
            return section[:-4]
    return None


def demux(stream: bytes | None) -> Stream:
    """What a transport stream holds. A stream that cannot be read gives an empty payload and an error."""
    nothing = lambda why: Stream(b"", [], [], 0, 0, why)
    if stream is None:
        return nothing("no stream")
    if not stream or len(stream) % PACKET:
        return nothing("not whole packets")
    rows = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        return nothing("lost sync")
    table = _sections(rows, TABLE_PID)
    if table is None:
        return nothing("no programme association table")
    map_pid = int.from_bytes(table[10:12], "big") & 0x1FFF
    programme = _sections(rows, map_pid)
    if programme is None:
        return nothing("no programme map table")
    at = 12 + (int.from_bytes(programme[10:12], "big") & 0xFFF)
    data_pid = int.from_bytes(programme[at + 1 : at + 3], "big") & 0x1FFF
    rows = rows[((rows[:, 1].astype(int) & 0x1F) << 8 | rows[:, 2]) == data_pid]
    has_field = rows[:, 3] & 0x20 > 0
    has_data = rows[:, 3] & 0x10 > 0
    counters = rows[has_data, 3] & 15
    jumps = int((np.diff(counters.astype(int)) % 16 != 1).sum())
    begin = np.where(has_field, 5 + rows[:, 4].astype(int), 4)
    inside = (np.arange(PACKET) >= begin[:, None]) & has_data[:, None]
    data = rows[inside]
    sizes = inside.sum(1)
    starts = np.flatnonzero(rows[:, 1] & 0x40 > 0)
    offsets = np.append((np.cumsum(sizes) - sizes)[starts], len(data))
    out, stamps, points, length = [], [], [], 0
    for i, (a, b) in zip(starts, zip(offsets[:-1], offsets[1:])):
        pes = data[a:b].tobytes()
        if pes[:3] != b"\x00\x00\x01":
            return nothing("no PES start code")
        body = pes[9 + pes[8] : 6 + int.from_bytes(pes[4:6], "big")]
        if pes[7] & 0x80:
            p = pes[9:14]
            stamps.append((p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1)
        if has_field[i] and rows[i, 4] and rows[i, 5] & 0x40:
            points.append(length)
        out.append(body)
        length += len(body)
    return Stream(b"".join(out), stamps, points, len(stream) // PACKET, jumps, None)


def padded(text: str | None) -> bytes:
    """UTF-8 with bytes 0 appended up to a positive multiple of ALIGN."""
    raw = (text or "").encode("utf-8")
    return raw + b"\0" * ((-len(raw)) % ALIGN or (0 if raw else ALIGN))


def store(docs: DataFrame, text: str = "text", output: str = "media") -> DataFrame:
    """``docs`` with a binary column ``output``: each whole text, padded, as a transport stream.

    Null counts as empty; equal texts give equal streams. Other columns pass through, but one named
    ``output`` is replaced; an empty table gives an empty one.
    """

    @F.arrow_udf("binary")
    @tidied
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([mux(padded(t.as_py())) for t in batch], pa.binary())

    return docs.withColumn(output, made(F.coalesce(F.col(text), F.lit(""))))


READ = "struct<payload: binary, stamps: array<long>, random_access: array<long>, packets: long, discontinuities: long, error: string>"
_KIND = pa.struct(
    [
        ("payload", pa.binary()), ("stamps", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int64())),
        ("packets", pa.int64()), ("discontinuities", pa.int64()), ("error", pa.string()),
    ]
)


def load(rows: DataFrame, media: str = "media", output: str = "stream") -> DataFrame:
    """``rows`` with a struct column ``output``: payload, time stamps, random-access points, packets, errors.

    A null, cut or foreign stream has an empty payload and says why in ``error``.
    """

    @F.arrow_udf(READ)
    @tidied
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = (demux(m.as_py()) for m in batch)
            yield pa.array([s._asdict() for s in found], _KIND)

    return rows.withColumn(output, read(F.col(media)))
