"""Marks and lengths in transport streams that aren't as they should be."""

import hashlib

from tessera.llm import transport_stream as S

PAYLOAD = b"".join(hashlib.sha256(bytes([k // 256, k % 256])).digest() for k in range(320))


def packets(stream):
    return [bytearray(stream[k : k + S.PACKET]) for k in range(0, len(stream), S.PACKET)]


def media(made):
    return [k for k, p in enumerate(made) if (p[1] & 31) << 8 | p[2] == S.MEDIA_PID]


def test_whole_streams_have_no_faults():
    for unit in (1, 100, 184, 4096, 65_000):
        got = S.demux(S.mux(PAYLOAD[:5000], unit))
        assert got.payload == PAYLOAD[:5000] and (got.damaged, got.short, got.lost) == (0, 0, 0)


def test_damaged_packets_are_counted_and_not_used():
    made = packets(S.mux(PAYLOAD, 4096))
    k = media(made)[3]
    held = bytes(made[k][4:])
    made[k][1] |= 0x80
    got = S.demux(b"".join(made))
    assert got.damaged == 1 and got.lost == 1 and got.short == 1 and len(got.payload) == len(PAYLOAD) - S.BODY and held not in got.payload
    made[0][1] |= 0x80  # the first program table; the stream is found by a later one, if there is one
    assert S.demux(b"".join(made)).damaged == 2


def test_marked_jumps_of_the_counter_lose_nothing():
    first, second = packets(S.mux(PAYLOAD, 4096)), packets(S.mux(PAYLOAD, 4096))
    for k in media(second):
        second[k][3] = second[k][3] & 0xF0 | (second[k][3] + 5) & 15
    plain = S.demux(b"".join(first + second))
    assert plain.lost == 1
    second[media(second)[0]][5] |= 0x80
    marked = S.demux(b"".join(first + second))
    assert marked.lost == 0 and marked.payload == PAYLOAD * 2


def test_units_have_the_bytes_that_their_head_says():
    made = packets(S.mux(PAYLOAD[:3000], 1000))
    heads = [k for k in media(made) if made[k][1] & 0x40]
    p = made[heads[1]]
    at = p.index(b"\0\0\1", 4)
    says = p[at + 4] << 8 | p[at + 5]
    for change, size, short in ((-10, 2990, 0), (10, 3000, 1)):
        q = bytearray(p)
        q[at + 4 : at + 6] = (says + change).to_bytes(2, "big")
        got = S.demux(b"".join([*made[: heads[1]], q, *made[heads[1] + 1 :]]))
        assert (len(got.payload), got.short) == (size, short)
        assert got.payload[:1000] == PAYLOAD[:1000] and got.payload[-1000:] == PAYLOAD[2000:3000]
    q = bytearray(p)
    q[at + 4 : at + 6] = b"\0\0"
    assert S.demux(b"".join([*made[: heads[1]], q, *made[heads[1] + 1 :]])).payload == PAYLOAD[:3000]
