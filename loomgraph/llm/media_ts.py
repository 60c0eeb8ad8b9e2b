"""Media columns: payloads as MPEG transport streams (ISO/IEC 13818-1), and columns read from such streams.

mux() writes a program association table, a program map table and one elementary stream of private data: the payload
in access units, each a PES packet with a timestamp, the random-access indicator on every `interval`-th. demux() finds
the stream through the tables (checking their CRC), checks continuity counters, reassembles the PES packets and lists
timestamps and random-access points. Both work on one row at a time; a row's memory is a small multiple of its text.

Defined cases: a null or empty text has the payload of 192 spaces. Equal texts have equal streams. A stream that is cut,
has lost packets or a bad table gives the payload that could be read and says so in `errors`. Null media: null columns.
"""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET, SYNC = 188, 0x47
PMT_PID, STREAM_PID, PROGRAM, PRIVATE_DATA = 0x0100, 0x0101, 1, 0x06
UNIT, TICKS, INTERVAL = 192 * 64, 3600, 8  # bytes of an access unit, 90 kHz ticks between units, units between random-access points


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def mux(payload: bytes, unit: int = UNIT, ticks: int = TICKS, interval: int = INTERVAL) -> bytes:
    out, counter = [_PAT, _PMT], 0
    for number, at in enumerate(range(0, len(payload), unit)):
        pts = number * ticks % (1 << 33)
        body = b"\x00\x00\x01\xbd" + b"\x00\x00" + b"\x84\x80\x05" + _stamp(pts) + payload[at : at + unit]
        if len(body) - 6 < 1 << 16:
            body = body[:4] + (len(body) - 6).to_bytes(2, "big") + body[6:]
        field = bytes([0x40]) if number % interval == 0 else b""  # flags of the adaptation field: random access
        start, place = True, 0
        while place < len(body):
            room = PACKET - 4 - (1 + len(field) if field else 0)
            part = body[place : place + room]
            if (short := room - len(part)) or field:
                used = field or (b"\x00" if short > 1 else b"")
                size = PACKET - 4 - len(part) - 1
                adaptation = bytes([size]) + (used + b"\xff" * (size - len(used)) if size else b"")
                kind = 0x30
            else:
                adaptation, kind = b"", 0x10
            out.append(bytes([SYNC, (0x40 if start else 0) | STREAM_PID >> 8, STREAM_PID & 0xFF, kind | counter]) + adaptation + part)
            counter, start, field = (counter + 1) & 15, False, b""
            place += len(part)
    return b"".join(out)


def _sections(payload: bytes) -> tuple[int, bytes] | None:
    """(table id, body without CRC) of the section that begins in a packet's payload, if its CRC is right."""
    at = 1 + payload[0]
    size = (payload[at + 1] & 0x0F) << 8 | payload[at + 2]
    section = payload[at : at + 3 + size]
    return (section[0], section[8:-4]) if len(section) == size + 3 and crc32_mpeg(section) == 0 else None


def demux(media: bytes) -> dict:
    """payload, pts (of each PES packet), random_access (indices of packets with the indicator), streams, errors."""
    errors = Counted()
    streams: dict[int, int] = {}
    pmts: set[int] = set()
    last: dict[int, int] = {}
    parts: list[bytes] = []
    pes: list[bytes] = []
    stamps: list[int] = []
    access: list[int] = []
    chosen = None

    def end() -> None:
        if not pes:
            return
        unit = b"".join(pes)
        pes.clear()
        if unit[:3] != b"\x00\x00\x01" or len(unit) < 9:
            errors["pes"] += 1
            return
        length, head = int.from_bytes(unit[4:6], "big"), 9 + unit[8]
        if length and length + 6 != len(unit):
            errors["pes"] += 1
        if unit[7] & 0x80:
            p = unit[9:14]
            stamps.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1)
        parts.append(unit[head:])

    for at in range(0, len(media) - PACKET + 1, PACKET):
        if media[at] != SYNC:
            errors["sync"] += 1
            continue
        second, kind = media[at + 1], media[at + 3]
        pid, starts = (second & 0x1F) << 8 | media[at + 2], second & 0x40
        body, random = at + 4, False
        if kind & 0x20:
            size = media[body]
            random = bool(size and media[body + 1] & 0x40)
            body += 1 + size
        if not kind & 0x10:
            continue
        if pid in last and kind & 15 != last[pid] + 1 & 15:
            errors["continuity"] += 1
        last[pid] = kind & 15
        payload = media[body : at + PACKET]
        if pid == 0 or pid in pmts:
            if starts and (section := _sections(payload)):
                rows = section[1]
                if section[0] == 0:
                    pmts |= {(rows[i + 2] & 0x1F) << 8 | rows[i + 3] for i in range(0, len(rows), 4) if rows[i] or rows[i + 1]}
                else:
                    i = 4 + ((rows[2] & 0x0F) << 8 | rows[3])
                    while i < len(rows):
                        streams[(rows[i + 1] & 0x1F) << 8 | rows[i + 2]] = rows[i]
                        i += 5 + ((rows[i + 3] & 0x0F) << 8 | rows[i + 4])
                    chosen = chosen or next(iter(streams), None)
            elif starts:
                errors["table"] += 1
        elif pid == chosen:
            if starts:
                end()
                if random:
                    access.append(len(parts))
            pes.append(payload)
    end()
    if len(media) % PACKET:
        errors["cut"] += 1
    return {"payload": b"".join(parts), "pts": stamps, "random_access": access, "streams": streams, "errors": dict(errors)}


class Counted(dict):
    def __missing__(self, key):
        return 0


def padded(text: bytes, block: int = 192) -> bytes:
    return text.ljust(max(block, -(-len(text) // block) * block))


def _stored(batches):
    for batch in batches:
        raw = [b"" if x is None else x for x in batch.column(1).cast(pa.binary()).to_pylist()]
        media = [mux(padded(x)) for x in raw]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, media): each whole text as a transport stream."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


COLUMNS = "payload binary, pts array<long>, random_access array<long>, stream_types array<int>, packets long, errors string"


def media_columns(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds the columns of COLUMNS, read from the streams in media_col."""
    names = df.columns

    def run(batches):
        for batch in batches:
            media = batch.column(names.index(media_col)).to_pylist()
            read = [None if m is None else demux(m) for m in media]
            get = lambda f, kind: pa.array([None if r is None else f(r) for r in read], kind)
            made = [get(lambda r: r["payload"], pa.binary()), get(lambda r: r["pts"], pa.list_(pa.int64())), get(lambda r: r["random_access"], pa.list_(pa.int64())), get(lambda r: list(r["streams"].values()), pa.list_(pa.int32())), pa.array([None if m is None else len(m) // PACKET for m in media], pa.int64()), get(lambda r: ",".join(f"{k}={v}" for k, v in sorted(r["errors"].items())), pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, *(x.split()[0] for x in COLUMNS.split(", "))])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{schema}, {COLUMNS}")


def media_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, from the stored bytes."""
    read = media_columns(store_media(docs))
    feature = F.concat_ws(";", F.concat(F.lit("packets="), "packets"), F.concat(F.lit("units="), F.size("pts")), F.concat(F.lit("last_pts="), F.element_at("pts", -1)), F.concat(F.lit("random_access="), F.concat_ws(",", "random_access")), F.concat(F.lit("types="), F.concat_ws(",", "stream_types")), F.concat(F.lit("errors="), "errors"))
    return read.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
