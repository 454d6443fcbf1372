import hashlib
import os
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import ts_media as t


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=1000))
def test_round_trip(payload):
    ts = t.mux(payload)
    x = t.demux(ts)
    assert len(ts) % t.PACKET == 0 and x["payload"] == payload and (x["lost"], x["broken"], x["programs"]) == (0, 0, 1)


def test_long_payload_has_stamped_points():
    payload = os.urandom(3 * t.UNIT + 17)
    x = t.demux(t.mux(payload))
    assert x["payload"] == payload and [p for p, _ in x["points"]] == [0, t.TICKS, 2 * t.TICKS, 3 * t.TICKS]


FACTS = ("lost", "repeated", "broken", "damaged")


def facts(ts):
    x = t.demux(ts)
    return tuple(x[f] for f in FACTS)


def test_a_lost_or_damaged_packet_is_noticed():
    payload = os.urandom(5000)
    ts = t.mux(payload)
    assert facts(ts) == (0, 0, 0, 0)
    gone = t.demux(ts[: 4 * 188] + ts[5 * 188 :])
    assert (gone["lost"], gone["damaged"]) == (1, 1) and len(gone["payload"]) == len(payload) - 184
    assert facts(ts[:-188])[3] == 1  # the end is missing
    assert facts(ts[:100] + b"x" + ts[101:]) == (0, 0, 0, 0)  # stuffing only
    bad = bytearray(ts)
    bad[8] ^= 1
    assert t.demux(bytes(bad))["broken"] == 1


def test_a_repeated_packet_counts_once():
    payload = os.urandom(5000)
    ts = t.mux(payload)
    x = t.demux(ts[: 5 * 188] + ts[4 * 188 :])
    assert x["payload"] == payload and (x["repeated"], x["lost"], x["damaged"]) == (1, 0, 0)


def test_an_announced_break_is_no_loss():
    ts = bytearray(t.mux(b"a" * 500))
    assert ts[2 * 188 + 3] & 0x20
    ts[2 * 188 + 5] |= 0x80
    for k in range(2, len(ts) // 188):
        ts[k * 188 + 3] = ts[k * 188 + 3] & 0xF0 | (k + 7) % 16
    first = t.mux(b"b" * 500)
    x = t.demux(first + bytes(ts[2 * 188 :]))
    assert (x["lost"], x["payload"]) == (0, b"b" * 500 + b"a" * 500)
    assert t.demux(first + t.mux(b"a" * 500)[2 * 188 :])["lost"] == 1


def test_odd_streams():
    ts = t.mux(b"a" * 3000)
    assert t.demux(None)["packets"] == t.demux(b"")["packets"] == 0
    for bad in (b"\0" * 50 + ts, ts + b"\x47" * 5, ts[:1000] + b"junk" + ts[1000:], b"\x47" * 188 * 3, os.urandom(4000)):
        x = t.demux(bad)
        assert x["broken"] + x["lost"] + x["damaged"] > 0 or x["payload"] == b""
    assert t.demux(b"\0" * 50 + ts)["payload"] == b"a" * 3000
    for k in range(0, 4 * 188):  # no byte that is wrong may stop the reader
        x = bytearray(ts)
        x[k] ^= 0xFF
        t.demux(bytes(x))


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=900))
def test_any_bytes_can_be_read(data):
    t.demux(data)
    t.demux(t.TABLES + data)


def test_tables_of_several_packets():
    streams = b"".join(bytes((6, 0xE0 | (0x200 + k) >> 8, (0x200 + k) & 255, 0xF0, 0)) for k in range(60))
    pmt = t._section(2, 1, bytes((0xE2, 0, 0xF0, 0)) + streams)
    assert len(pmt) > 184
    parts = [b"\0" + pmt[:183], pmt[183:]]
    packets = b"".join(bytes((0x47, (0x40 if k == 0 else 0) | 1, 0, 0x10 | k)) + p.ljust(184, b"\xff") for k, p in enumerate(parts))
    data = b"\0\0\1\xbd\0\0\x80\0\0" + b"z" * 100  # no length, no time stamp
    pad = 184 - len(data)
    unit = bytes((0x47, 0x40 | (0x200 + 59) >> 8, (0x200 + 59) & 255, 0x30, pad - 1, 0x40)) + b"\xff" * (pad - 2) + data
    x = t.demux(t.TABLES[:188] + packets + unit)
    assert (x["payload"], x["points"], x["broken"], x["programs"]) == (b"z" * 100, [(None, 3)], 0, 1)


def test_crc():
    assert t.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_query_values(spark):
    rows = [(1, None), (2, ""), (3, "é" * 32), (4, "a" * 63), (4, "a" * 63), (None, "x" * 200_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, media string, n_bytes int")
    got = t.read_media(t.encode_media(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        data = (dict(rows).get(r.id) or "").encode()
        p = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_sha256 == hashlib.sha256(t.mux(p)).hexdigest() and r.lost == r.broken == 0 and len(r.points) == r.units
    assert t.read_media(t.store_media(df.limit(0))).count() == 0
    assert sorted(map(str, t.read_media(t.store_media(df)).collect())) == sorted(map(str, got))
    odd = spark.createDataFrame([(1, 0, None), (2, 5, bytearray(b"no stream"))], "id long, n_bytes long, media binary")
    assert sorted((r.id, r.media_bytes, r.packets, r.payload_bytes, len(r.points)) for r in t.read_media(odd).collect()) == [(1, 0, 0, 0, 0), (2, 9, 0, 0, 0)]
