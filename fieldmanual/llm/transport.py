"""Media columns as MPEG transport streams (ISO/IEC 13818-1).

``mux`` stores bytes as one program with one private-data stream; ``demux`` reads any such stream back: it
follows the program tables, checks continuity counters, reassembles elementary packets, and returns payload,
timestamps and random-access points.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, PROGRAM = 0x0000, 0x0020, 0x0100, 1
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
CLOCK = 90_000

DEMUXED = T.StructType([
    T.StructField("payload", T.BinaryType()), T.StructField("program", T.IntegerType()), T.StructField("stream_type", T.IntegerType()),
    T.StructField("packets", T.LongType()), T.StructField("continuity_errors", T.LongType()), T.StructField("table_errors", T.LongType()),
    T.StructField("timestamps", T.ArrayType(T.LongType())), T.StructField("random_access", T.ArrayType(T.LongType()))])


def _crc_mpeg(data: bytes) -> int:
    """CRC-32 of the program tables: the usual polynomial, bits not reflected, no final inversion."""
    flip = bytes(int(f"{b:08b}"[::-1], 2) for b in data)
    return int(f"{zlib.crc32(flip) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, ident >> 8, ident & 255, 0xC1, 0, 0])
    return head + body + _crc_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


def _elementary_packet(unit: bytes, pts: int) -> bytes:
    stamp = bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 255, 1 | (pts >> 14) & 0xFE, (pts >> 7) & 255, 1 | (pts << 1) & 0xFE])
    return b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp + unit


def mux(payload: bytes, unit_bytes: int = 4096, unit_ticks: int = CLOCK // 25) -> bytes:
    """One transport stream: program tables, then one elementary packet per ``unit_bytes`` of payload.

    Each elementary packet carries a timestamp (33 bits, wrapping) and opens with a random-access mark.
    """
    out = [_table_packet(PAT_PID, _section(0, 1, bytes([0, PROGRAM, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))),
           _table_packet(PMT_PID, _section(2, PROGRAM, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0, PRIVATE_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0])))]
    plain, opening, low = DATA_PID >> 8, 0x40 | DATA_PID >> 8, DATA_PID & 255
    counter = 0
    for number, at in enumerate(range(0, len(payload), unit_bytes)):
        pes = _elementary_packet(payload[at:at + unit_bytes], number * unit_ticks & (1 << 33) - 1)
        done, first = 0, True
        while done < len(pes):
            room = PACKET - 4 - 2 * first
            part = pes[done:done + room]
            done += len(part)
            short = room - len(part)
            if first:
                field = bytes([1 + short, 0x40]) + b"\xff" * short
            elif short:
                field = bytes([short - 1]) + (b"\x00" + b"\xff" * (short - 2) if short > 1 else b"")
            else:
                field = b""
            out.append(bytes([SYNC, opening if first else plain, low, (0x30 if field else 0x10) | counter]) + field + part)
            counter, first = counter + 1 & 15, False
    return b"".join(out)


def _programs(packets: list[bytes], table: int) -> tuple[bytes | None, int]:
    """Body of the first sound section with this table id, and the number of unsound ones before it."""
    bad = 0
    for p in packets:
        start = 4 if not p[3] & 0x20 else 5 + p[4]
        if not p[1] & 0x40 or not p[3] & 0x10 or start >= PACKET:
            continue
        start += 1 + p[start]
        size = ((p[start + 1] & 15) << 8 | p[start + 2]) + 3 if start + 3 <= PACKET else 0
        section = p[start:start + size]
        if size < 12 or len(section) < size or section[0] != table or _crc_mpeg(section[:-4]) != int.from_bytes(section[-4:], "big"):
            bad += 1
            continue
        return section[8:-4], bad
    return None, bad


def demux(media: bytes):
    """Read a stream: payload, program, stream type, packets, continuity and table errors, timestamps, access points.

    Packets without the sync byte are skipped.  A repeated packet (same counter) is dropped, a gap in the counter
    counts as an error and drops the elementary packet it falls into.  Access points are payload offsets.
    """
    whole = len(media) // PACKET
    grid = np.frombuffer(media, np.uint8, whole * PACKET).reshape(whole, PACKET)
    sound = (grid[:, 0] == SYNC) & (grid[:, 1] & 0x80 == 0)
    pid = (grid[:, 1].astype(np.int32) & 31) << 8 | grid[:, 2]
    rows = lambda wanted: [grid[i].tobytes() for i in np.flatnonzero(sound & (pid == wanted))]
    body, bad = _programs(rows(PAT_PID), 0)
    entries = [(int.from_bytes(body[i:i + 2], "big"), int.from_bytes(body[i + 2:i + 4], "big") & 0x1FFF) for i in range(0, len(body or b"") - 3, 4)]
    entries = [e for e in entries if e[0]]
    if not entries:
        return b"", None, None, whole, 0, bad + (body is None), [], []
    program, pmt = entries[0]
    body, more = _programs(rows(pmt), 2)
    bad += more
    skip = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF) if body else 0
    if not body or len(body) < skip + 5:
        return b"", program, None, whole, 0, bad + 1, [], []
    kind, stream = body[skip], int.from_bytes(body[skip + 1:skip + 3], "big") & 0x1FFF
    at = np.flatnonzero(sound & (pid == stream) & (grid[:, 3] & 0x10 > 0))
    flags, opens, counters = grid[at, 3] & 0x20 > 0, grid[at, 1] & 0x40 > 0, grid[at, 3] & 15
    starts = np.where(flags, 5 + grid[at, 4].astype(np.int32), 4)
    marks = flags & (grid[at, 4] > 0) & (grid[at, 5] & 0x40 > 0)
    errors, last, parts, units = 0, None, None, []
    for i, k, begin, opening, counter, mark in zip(range(len(at)), (at * PACKET).tolist(), starts.tolist(), opens.tolist(), counters.tolist(), marks.tolist()):
        if last is not None and counter == last:
            continue
        if last is not None and counter != (last + 1 & 15):
            errors, parts = errors + 1, None
        last = counter
        if opening:
            parts = []
            units.append((parts, mark))
        if parts is not None:
            parts.append(media[k + begin:k + PACKET])
    payload, stamps, access, size = [], [], [], 0
    for parts, mark in units:
        pes = b"".join(parts)
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            continue
        length = int.from_bytes(pes[4:6], "big")
        if length and len(pes) < length + 6:
            continue  # a packet of it is lost
        unit = pes[9 + pes[8]:length + 6 if length else len(pes)]
        if pes[7] & 0x80 and len(pes) >= 14:
            stamps.append((pes[9] >> 1 & 7) << 30 | pes[10] << 22 | pes[11] >> 1 << 15 | pes[12] << 7 | pes[13] >> 1)
        if mark:
            access.append(size)
        payload.append(unit)
        size += len(unit)
    return b"".join(payload), program, kind, whole, errors, bad, stamps, access


def as_media(text: Column, unit_bytes: int = 4096, pad: int = 64) -> Column:
    """Column of transport streams: the UTF-8 bytes of a text, zero bytes up to a positive multiple of ``pad``."""

    @F.pandas_udf(T.BinaryType())
    def store(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            raw = t.encode() if t is not None else b""
            out.append(mux(raw.ljust(max(pad, -(-len(raw) // pad) * pad), b"\x00"), unit_bytes))
        return pd.Series(out, dtype=object)

    return store(text)


def from_media(media: Column) -> Column:
    """Struct column of what :func:`demux` reads; null media counts as an empty stream."""

    @F.pandas_udf(DEMUXED)
    def read(streams: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([demux(bytes(m) if m is not None else b"") for m in streams], columns=DEMUXED.names)

    return read(media)


def media_digest(media: Column) -> Column:
    """Struct of digests and the feature line of stored streams, computed next to the reading so that no payload moves."""
    kind = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    @F.pandas_udf(kind)
    def digest(streams: pd.Series) -> pd.DataFrame:
        out = []
        for m in streams:
            m = bytes(m)
            payload, program, kind, packets, errors, bad, stamps, access = demux(m)
            line = (f"program={program};type={kind};packets={packets};units={len(stamps)};access={len(access)};first={stamps[0] if stamps else ''};"
                    f"last={stamps[-1] if stamps else ''};last_access={access[-1] if access else ''};continuity_errors={errors};table_errors={bad}")
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), line))
        return pd.DataFrame(out, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return digest(media)


def store_media(documents: DataFrame, key: str = "doc_id", text: str = "text", unit_bytes: int = 4096) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``media``: one transport stream per row.

    A null text counts as empty; an empty payload becomes 64 zero bytes; repeated rows and null keys stay rows of
    their own; an empty table gives no rows.  A text of any length is stored whole.
    """
    text = F.col(text).cast("string")
    return documents.select(F.col(key).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), as_media(text, unit_bytes).alias("media"))


def read_media(stored: DataFrame, media: str = "media") -> DataFrame:
    """All columns but the media, with what its streams hold: payload, tables, errors, timestamps, access points."""
    read = stored.withColumn("__read", from_media(F.col(media)))
    return read.select(*[F.col(c) for c in stored.columns if c != media], *[F.col(f"__read.{n}").alias(n) for n in DEMUXED.names])


def digest_media(stored: DataFrame, media: str = "media") -> DataFrame:
    """All columns but the media, with digests and features of what is read back from it."""
    read = stored.withColumn("__read", media_digest(F.col(media)))
    return read.select(*[F.col(c) for c in stored.columns if c != media], "__read.*")
