"""Media columns as MPEG transport streams.

``mux`` stores a payload in 188-byte packets: program tables, an elementary
stream cut into access units with presentation times, a clock reference and a
random-access mark where a decoder may start. ``demux`` parses the tables,
checks continuity counters, reassembles the elementary packets and returns the
payload with its time stamps.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame

from tessera.llm.common import map_rows

# Fixed values of the format (ISO/IEC 13818-1).
PACKET, SYNC, BODY = 188, 0x47, 184
PAT_PID, STUFFING = 0x0000, 0xFF
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
CLOCK = 90_000
WRAP = 1 << 33

PMT_PID, MEDIA_PID, PROGRAM = 0x1000, 0x0100, 1
UNIT_BYTES = 32_768
UNIT_TICKS = CLOCK // 25
UNITS_PER_ENTRY = 8
FEATURE_BYTES = 64


@lru_cache(maxsize=1)
def _crc_table() -> tuple[int, ...]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return tuple(out)


@lru_cache(maxsize=4096)
def crc32_mpeg(data: bytes) -> int:
    """The CRC of program tables: not reflected, no final inversion."""
    c, t = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ t[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    size = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | size >> 8, size & 255, ident >> 8, ident & 255, 0xC1, 0, 0]) + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


@lru_cache(maxsize=1)
def _tables() -> tuple[bytes, bytes]:
    pat = _section(0, 1, bytes([PROGRAM >> 8, PROGRAM & 255, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
    pmt = _section(2, PROGRAM, bytes([0xE0 | MEDIA_PID >> 8, MEDIA_PID & 255, 0xF0, 0, PRIVATE_TYPE, 0xE0 | MEDIA_PID >> 8, MEDIA_PID & 255, 0xF0, 0]))
    return tuple((b"\0" + s).ljust(BODY, b"\xff") for s in (pat, pmt))


def _timestamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def mux(payload: bytes, unit_bytes: int = UNIT_BYTES, units_per_entry: int = UNITS_PER_ENTRY) -> bytes:
    """``payload`` as a transport stream; every ``units_per_entry``-th access unit is a random-access point preceded by both tables."""
    if not 1 <= unit_bytes <= 65_000:
        raise ValueError("an access unit has 1 to 65000 bytes")
    out: list[bytes] = []
    heads = [bytes([SYNC, MEDIA_PID >> 8, MEDIA_PID & 255, 0x10 | c]) for c in range(16)]
    cc = psi = 0
    for k, at in enumerate(range(0, len(payload), unit_bytes)):
        data, pts, entry = payload[at : at + unit_bytes], k * UNIT_TICKS % WRAP, k % units_per_entry == 0
        if entry:
            for pid, table in zip((PAT_PID, PMT_PID), _tables(), strict=True):
                out += (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | psi]), table)
            psi = psi + 1 & 15
        pes = bytes([0, 0, 1, PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(2, pts) + data
        base = pts
        extra = b"\x50" + (base << 15 | 0x7E00).to_bytes(6, "big") if entry else b""
        room = BODY - (len(extra) + 1 if extra else 0)
        first, i = True, 0
        while i < len(pes):
            left = len(pes) - i
            if not first and left >= BODY:  # the common case: a packet that is all body
                out += (heads[cc], pes[i : i + BODY])
                i += BODY
            else:
                take = min(left, room)
                adapt = extra
                if take < room:
                    adapt = (extra or b"\0" * (BODY - take > 1)).ljust(BODY - take - 1, b"\xff")
                if adapt or take < BODY:
                    out += (bytes([SYNC, 0x40 * first | MEDIA_PID >> 8, MEDIA_PID & 255, 0x30 | cc, len(adapt)]), adapt)
                else:
                    out.append(bytes([SYNC, 0x40 * first | MEDIA_PID >> 8, MEDIA_PID & 255, 0x10 | cc]))
                out.append(pes[i : i + take])
                i += take
                first, extra, room = False, b"", BODY
            cc = cc + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds. ``units``: (pts or None, byte offset in ``payload``, random access)."""

    payload: bytes = b""
    packets: int = 0
    programs: dict[int, dict[int, int]] = field(default_factory=dict)
    units: list[tuple[int | None, int, bool]] = field(default_factory=list)
    lost: int = 0
    repeated: int = 0
    bad_tables: int = 0
    skipped_bytes: int = 0
    #: packets that their sender marked as damaged, and units with fewer bytes than their head says
    damaged: int = 0
    short: int = 0

    @property
    def feature(self) -> str:
        times = [t for t, _, _ in self.units if t is not None]
        return (
            f"programs={len(self.programs)};streams={','.join(f'{p}:{k}' for s in self.programs.values() for p, k in sorted(s.items()))};packets={self.packets};units={len(self.units)}"
            f";entries={sum(r for _, _, r in self.units)};lost={self.lost};bad_tables={self.bad_tables};pts={times[0] if times else '-'}..{times[-1] if times else '-'}"
        )


def demux(stream: bytes, pid: int | None = None) -> Stream:
    """Read a stream back. ``pid``: the elementary stream to take; None takes the first that a program table lists.

    Bytes before a sync byte are skipped and counted; a packet with the transport
    error mark is counted and not used; a packet whose continuity counter repeats
    is dropped once, a gap is counted as lost, unless the packet is marked as
    discontinuous, and the unit goes on; tables with a wrong CRC are counted and not
    used. A unit has as many bytes as its head says (any, if that is 0): more are not
    taken, and units with fewer are counted.
    """
    out, last, maps, parts, n = Stream(), {}, set(), [], len(stream)
    at = size = 0
    room: int | None = None  # bytes that the present unit still wants
    while at + PACKET <= n:
        if stream[at] != SYNC:
            at += 1
            out.skipped_bytes += 1
            continue
        b1, b3 = stream[at + 1], stream[at + 3]
        this, start = (b1 & 31) << 8 | stream[at + 2], b1 & 0x40
        body, end, random, jump = at + 4, at + PACKET, False, False
        at = end
        out.packets += 1
        if b1 & 0x80:
            out.damaged += 1
            continue
        if b3 & 0x20:
            long = stream[body]
            marks = stream[body + 1] if long else 0
            random, jump = bool(marks & 0x40), bool(marks & 0x80)
            body += 1 + long
        if not b3 & 0x10 or body >= end:
            continue
        cc, before = b3 & 15, last.get(this)
        if before is not None and cc != before + 1 & 15 and not jump:
            if cc == before:
                out.repeated += 1
                continue
            out.lost += 1
        last[this] = cc
        if this == PAT_PID or this in maps:
            if start:
                section = stream[body + 1 + stream[body] : end]
                long = 3 + ((section[1] & 15) << 8 | section[2]) if len(section) > 2 else 0
                section = section[:long]
                if long < 12 or len(section) < long or crc32_mpeg(section):
                    out.bad_tables += 1
                elif this == PAT_PID:
                    for i in range(8, long - 4, 4):
                        number = section[i] << 8 | section[i + 1]
                        if number:
                            maps.add((section[i + 2] & 31) << 8 | section[i + 3])
                            out.programs.setdefault(number, {})
                else:
                    i = 12 + ((section[10] & 15) << 8 | section[11])
                    while i + 5 <= long - 4:
                        out.programs.setdefault(section[3] << 8 | section[4], {})[(section[i + 1] & 31) << 8 | section[i + 2]] = section[i]
                        i += 5 + ((section[i + 3] & 15) << 8 | section[i + 4])
                    if pid is None:
                        pid = next((p for s in out.programs.values() for p in s), None)
        elif this == pid:
            if start and stream[body : body + 3] == b"\0\0\1":
                pts = None
                if stream[body + 7] & 0x80:
                    p = stream[body + 9 : body + 14]
                    pts = (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1
                says, head = stream[body + 4] << 8 | stream[body + 5], 9 + stream[body + 8]
                out.short += bool(room)
                room = max(0, says + 6 - head) if says else None
                body += head
                out.units.append((pts, size, random))
            if out.units:
                took = stream[body : end if room is None else min(end, body + room)]
                parts.append(took)
                size += len(took)
                room = None if room is None else room - len(took)
    out.short += bool(room)
    out.payload = b"".join(parts)
    return out


def padded(text: str | None, multiple: int = FEATURE_BYTES) -> tuple[int, bytes]:
    """The text's UTF-8 bytes (null: none) with zeros up to a positive multiple; lone surrogates become '?'."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b"\0" * ((-len(raw)) % multiple if raw else multiple)


SCHEMA = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pts array<bigint>, entry_offsets array<bigint>"


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store each text as a transport stream, read the stream back and describe what was read.

    Returns ``id_col``, the digests and counts of payload and stream, ``pts`` (one
    a unit), ``entry_offsets`` (payload offsets of random-access points) and, with
    ``keep_media``, ``media`` itself. Null and empty texts store 64 zero bytes;
    very long texts are stored whole, in as many units as they need; an empty
    table gives an empty result; rows with equal texts get equal values; a repeated row is returned as often as
    it occurs; other columns are not read, so their names cannot clash.
    """
    kind = dict(df.dtypes)[id_col]

    def rows(_, ids, texts):
        for i, text in zip(ids, texts, strict=True):
            n, payload = padded(text)
            media = mux(payload)
            got = demux(media)
            yield (
                i, n, len(got.payload), hashlib.sha256(got.payload).hexdigest(), zlib.crc32(got.payload[-FEATURE_BYTES:]), len(media), hashlib.sha256(media).hexdigest(), got.feature,
                [t for t, _, _ in got.units], [o for _, o, r in got.units if r], *([media] if keep_media else []),
            )

    return map_rows(df, [id_col, text_col], f"{id_col} {kind}, {SCHEMA}" + ", media binary" * keep_media, rows)
