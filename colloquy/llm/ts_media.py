"""MPEG transport streams as a media column: write payloads into packets, and parse, check and reassemble them.

A stream has a program association table, a program map table and one elementary stream of private data whose
units of 8 bits are the payload's bytes. It is cut into PES packets with a time stamp each; the transport
packet that begins one is marked as a random-access point and carries a clock reference.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, saved, small_batches

# Fixed values of ISO/IEC 13818-1
PACKET, SYNC, PAT_PID, NULL_PID, PRIVATE_STREAM, PRIVATE_TYPE, CLOCK = 188, 0x47, 0, 0x1FFF, 0xBD, 0x06, 90_000
#: Ours: program number, its map's PID, the elementary stream's PID, bytes of payload in a PES packet, and ticks between those.
PROGRAM, PMT_PID, DATA_PID, UNIT, TICKS = 1, 0x100, 0x101, 32_768, 3_003
BATCH_BYTES = 8 << 20


def crc32_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2, as program tables carry it."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc >> 31 else crc << 1
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(PAT_PID, _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))) + _table_packet(PMT_PID, _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_TYPE, 0xE000 | DATA_PID, 0xF000)))
_PLAIN = [struct.pack(">BHB", SYNC, DATA_PID, 0x10 | c) for c in range(16)]


def _stamp(pts: int) -> bytes:
    return bytes((0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 1 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 1 | pts << 1 & 0xFE))


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, counter = [TABLES], 0
    for unit, at in enumerate(range(0, max(len(payload), 1), UNIT)):
        data = payload[at : at + UNIT]
        pts = unit * TICKS & 0x1FFFFFFFF
        pes = b"\0\0\1" + struct.pack(">BHBBB", PRIVATE_STREAM, len(data) + 8, 0x80, 0x80, 5) + _stamp(pts) + data
        clock = struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00)
        first = True
        at_pes = 0
        while at_pes < len(pes):
            left = len(pes) - at_pes
            if not first and left >= 184:
                out.append(_PLAIN[counter])
                take = 184
            else:
                field = b"\x50" + clock if first else b""
                room = 184 - 1 - len(field)
                take = min(left, room)
                if len(field) == 0 and room - take:
                    field = b"\0"
                field = field.ljust(183 - take, b"\xff")
                out.append(struct.pack(">BHBB", SYNC, (0x4000 if first else 0) | DATA_PID, 0x30 | counter, len(field)) + field)
            out.append(pes[at_pes : at_pes + take])
            at_pes += take
            counter = counter + 1 & 15
            first = False
    return b"".join(out)


def _payload_of(packet: bytes) -> tuple[bytes, bool, bool] | None:
    """(payload, random access, discontinuity) of a packet; None if its adaptation field does not fit."""
    has, random, gap, body = packet[3] >> 4 & 3, False, False, 4
    if has & 2:
        size = packet[4]
        if size > 183 - (has & 1):
            return None
        if size:
            random, gap = bool(packet[5] & 0x40), bool(packet[5] & 0x80)
        body = 5 + size
    return (packet[body:] if has & 1 else b""), random, gap


class _Sections:
    """Puts the sections of one PID together, which may go over several packets."""

    def __init__(self):
        self.held: bytes | None = None

    def feed(self, payload: bytes, start: bool) -> Iterator[bytes]:
        if start:
            if not payload:
                return
            skip = payload[0]
            if self.held is not None:
                yield from self._cut(self.held + payload[1 : 1 + skip])
            self.held = payload[1 + skip :]
        elif self.held is not None:
            self.held += payload
        yield from self._cut(self.held or b"")

    def _cut(self, data: bytes) -> Iterator[bytes]:
        while len(data) >= 3 and data[0] != 0xFF:
            size = 3 + ((data[1] & 0x0F) << 8 | data[2])
            if len(data) < size:
                break
            yield data[:size]
            data = data[size:]
        self.held = data if data and data[0] != 0xFF else None


def _pes(data: bytes) -> tuple[bytes, int | None, bool]:
    """(payload, time stamp or None, whole) of the bytes of one PES packet."""
    if len(data) < 9 or data[:3] != b"\0\0\1":
        return b"", None, False
    length, flags, head = data[4] << 8 | data[5], data[7] >> 6, data[8]
    pts = None
    if flags & 2 and head >= 5 and len(data) >= 14:
        p = data[9:14]
        pts = (p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1
    end = 6 + length if length else len(data)  # no length: up to the next packet
    return data[9 + head : end], pts, len(data) >= max(end, 9 + head)


def demux(ts: bytes | None) -> dict:
    """Parses a transport stream and says what it holds and what is wrong with it.

    payload: the units' bytes one after another; units: how many PES packets there are; points: (time stamp, packet number) of those that are
    random-access points. A time stamp is null where there is none. lost: breaks of the continuity counter that no discontinuity
    flag announces; repeated: packets sent twice, which the standard allows and which count once; broken: packets without a
    sync byte, cut off or with fields that do not fit, and sections whose check sum is wrong; damaged: units that lack bytes, by their length or by a break
    inside. A damaged unit gives what there is of it. After bytes without a sync byte the next packet is searched for.
    A null stream is one without packets.
    """
    ts = ts or b""
    maps: set[int] = set()
    streams: dict[int, int] = {}
    programs: set[int] = set()
    sections: dict[int, _Sections] = {PAT_PID: _Sections()}
    last: dict[int, tuple[int, bytes]] = {}
    open_units: dict[int, dict] = {}
    units: list[dict] = []
    count = dict.fromkeys(("packets", "lost", "repeated", "broken"), 0)
    at = 0
    while at < len(ts):
        if ts[at] != SYNC:
            # a packet's sync byte is where another one follows at its length, or the stream ends
            n = at + 1
            while (n := ts.find(b"\x47", n)) >= 0 and n + PACKET < len(ts) and ts[n + PACKET] != SYNC:
                n += 1
            count["broken"] += 1
            at = n if n >= 0 else len(ts)
            continue
        packet, number = ts[at : at + PACKET], count["packets"]
        at += PACKET
        if len(packet) < PACKET:
            count["broken"] += 1
            break
        count["packets"] += 1
        pid, start, counter = (packet[1] & 0x1F) << 8 | packet[2], bool(packet[1] & 0x40), packet[3] & 15
        if pid == NULL_PID:
            continue
        got = _payload_of(packet)
        if got is None or packet[1] & 0x80:
            count["broken"] += 1
            continue
        payload, random, gap = got
        torn = False
        if packet[3] & 0x10:
            if pid in last and not gap:
                if counter == last[pid][0] and packet == last[pid][1]:
                    count["repeated"] += 1
                    continue
                if counter != (last[pid][0] + 1 & 15):
                    count["lost"] += 1
                    torn = True
            last[pid] = (counter, packet)
        if pid in sections:
            if torn:
                sections[pid].held = None
            for x in sections[pid].feed(payload, start):
                if len(x) < 12 or crc32_mpeg(x):
                    count["broken"] += 1
                elif pid == PAT_PID and x[0] == 0:
                    for k in range(8, len(x) - 7, 4):
                        if number_of := x[k] << 8 | x[k + 1]:  # 0 is the network's own table
                            programs.add(number_of)
                            maps.add(m := (x[k + 2] & 0x1F) << 8 | x[k + 3])
                            sections.setdefault(m, _Sections())
                elif pid in maps and x[0] == 2:
                    k = 12 + ((x[10] & 0x0F) << 8 | x[11])
                    while k + 5 <= len(x) - 4:
                        streams[(x[k + 1] & 0x1F) << 8 | x[k + 2]] = x[k]
                        k += 5 + ((x[k + 3] & 0x0F) << 8 | x[k + 4])
        elif pid in streams:
            if start:
                open_units[pid] = {"parts": [payload], "packet": number, "random": random, "torn": False}
                units.append(open_units[pid])
                if torn and len(units) > 1:  # what is lost may be the end of the unit before
                    before = next((u for u in reversed(units[:-1]) if u.get("pid", pid) == pid), None)
                    if before is not None:
                        before["torn"] = True
            elif pid in open_units:
                open_units[pid]["parts"].append(payload)
                open_units[pid]["torn"] |= torn
            if pid in open_units:
                open_units[pid]["pid"] = pid
    out, points, damaged = [], [], 0
    for u in units:
        data, pts, whole = _pes(b"".join(u["parts"]))
        out.append(data)
        damaged += u["torn"] or not whole
        if u["random"]:
            points.append((pts, u["packet"]))
    return {"payload": b"".join(out), "programs": len(programs), "units": len(units), "damaged": damaged, "points": points, **count}


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, the payload: these and zeros up to a positive multiple of 64)."""
    data = (text or "").encode("utf-8", "replace")
    return len(data), data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def _in_parts(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], weigh: int) -> Iterator[pa.RecordBatch]:
    """Record batches of about BATCH_BYTES, by the length of column weigh."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weigh]) + 100
        if size >= BATCH_BYTES:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text, padded, as a transport stream.

    A null text is empty; an empty one has a payload of 64 zeros. Repeated rows give equal media; a null id
    stays null. An empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((i.as_py(), n, mux(payload)) for i, t in zip(batch.column(0), batch.column(1)) for n, payload in [padded(t.as_py())])
            yield from _in_parts(rows, ["id", "n_bytes", "media"], [batch.schema.field(0).type, pa.int64(), pa.binary()], 2)

    return source.mapInArrow(run, f"id {kind}, n_bytes long, media binary")


FACTS = ("packets", "programs", "units", "lost", "repeated", "broken", "damaged")


def read_media(media: DataFrame) -> DataFrame:
    """(id, n_bytes, payload facts, media facts, points) of media (id, n_bytes, media): what the stored streams say.

    Damaged streams are counted, not refused: see demux(). A null stream has no bytes, no packets and the digests of nothing.
    """
    kind = media.schema["id"].dataType.simpleString()
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", *FACTS, "points"]
    points = pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64())]))
    small_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, n, m in zip(batch.column("id"), batch.column("n_bytes"), batch.column("media")):
                stored = m.as_py() or b""
                x = demux(stored)
                p = x["payload"]
                rows.append((i.as_py(), n.as_py(), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), *(x[f] for f in FACTS), [{"pts": a, "packet": b} for a, b in x["points"]]))
            if rows:
                long = pa.int64()
                kinds = [batch.schema.field(0).type, long, long, pa.string(), long, long, pa.string(), *[long] * len(FACTS), points]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        give_back()

    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, {', '.join(f'{f} long' for f in FACTS)}, points array<struct<pts:long,packet:long>>"
    return media.select("id", "n_bytes", "media").mapInArrow(run, schema)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_media() as a written table: the streams are stored, and whoever reads them reads the stored bytes."""
    return saved(encode_media(docs, id_col, text_col), "media")
