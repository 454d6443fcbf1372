"""WARC archives with a two-level capture index.

Every capture becomes a gzip member of a .warc.gz file in the shared folder. The captures' keys (host labels
reversed, path, time, record) are sorted into compressed blocks of lines; a sparse directory keeps
the first key and the place of each block. A look-up binary-searches the directory, reads and unpacks one
block, binary-searches its lines, and then reads just the byte range of the record. The directory has at most
MOST_BLOCKS blocks and one more for each index file, with keys of bounded length, so it is small at any
number of captures: blocks grow instead.

Files are written under names of their own and referenced only by the rows of the attempt that succeeded, so
a task that is run again cannot disturb what another one wrote.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, saved, scratch

MOST_BLOCKS, LEAST_LINES, KEY_CHARS, TASK_BYTES = 65_536, 256, 512, 32 << 20
#: Groups of equal payloads up to this number are broadcast; more are joined by a shuffle.
GROUPS_BROADCAST = 100_000
DATE, STAMP = "1970-01-01T00:00:00Z", "19700101000000"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "key string, record_id string, file string, offset long, length long"
RECORD = "record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def capture_key(url: str | None, record_id: str) -> str:
    """Sort key of a capture: reversed host, port, path and query, then time and record. Long keys are cut and hashed."""
    m = re.match(r"(?:[A-Za-z][\w+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", re.sub(r"\s", "%20", url or ""))
    host, port, rest = m[1].lower(), m[2] or "", m[3] or "/"
    key = ",".join(reversed(host.split("."))) + port + ")" + rest
    if len(key) > KEY_CHARS:
        key = key[:KEY_CHARS] + "#" + hashlib.sha1(key.encode("utf-8", "replace")).hexdigest()
    return f"{key} {STAMP} {record_id}"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, url: str | None, payload: bytes, refers_to: str | None, level: int) -> bytes:
    """One WARC record as a gzip member. A revisit keeps the HTTP headers and has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:colloquy:none"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:colloquy:page:{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[3:3] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:colloquy:page:{refers_to}>"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> dict:
    """The headers and payload of one record; the digest of a response is taken from what was read."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(re.search(rb"Content-Length: (\d+)", http)[1])
    name = lambda x: x[len("<urn:colloquy:page:") : -1]
    new = h["WARC-Type"] == "response"
    return {
        "record_id": name(h["WARC-Record-ID"]), "url": h["WARC-Target-URI"], "record_type": h["WARC-Type"], "payload": payload if new else None,
        "payload_bytes": len(payload) if new else said, "payload_digest": payload_digest(payload) if new else h["WARC-Payload-Digest"][5:], "refers_to": None if new else name(h["WARC-Refers-To"]),
    }


def _folder(root: str, name: str) -> tuple[fs.FileSystem, str]:
    store, at = fs.FileSystem.from_uri(f"{root}/{name}")
    store.create_dir(at, recursive=True)
    return store, at


def plan_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """(record_id, url, payload, refers_to): refers_to is the first record (smallest id) with an equal payload, null for that one itself."""
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    sums = own.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    groups = saved(sums.where("n > 1"), "equal")
    count, total = groups.agg(F.count("*"), F.sum("n")).first()
    if count <= GROUPS_BROADCAST:
        out = own.join(F.broadcast(groups), "digest", "left")
    else:
        heavy = F.col("n") * HEAVY >= total
        large = groups.where(heavy).select("digest", F.col("first").alias("f1"), F.col("n").alias("n1"))
        small = groups.where(~heavy).withColumnRenamed("digest", "d2")
        out = own.join(F.broadcast(large), "digest", "left")
        spread = F.when(F.col("n1").isNull(), F.col("digest")).otherwise(F.concat(F.lit("!"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
        out = out.withColumn("d", spread).join(small, F.col("d") == F.col("d2"), "left").withColumn("first", F.coalesce("f1", "first")).withColumn("n", F.coalesce("n1", "n"))
    refers = F.when(F.col("n").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    return out.select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("record_id"), "url", "payload", refers.alias("refers_to"))


def write_archives(captures: DataFrame, root: str, level: int = 4) -> DataFrame:
    """Writes captures (record_id, url, payload, refers_to) to root/warc, a file for each task; returns their saved index entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _folder(root, "warc")
        name, offset, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                rows = []
                for rid, url, payload, refers in zip(*(batch.column(i) for i in range(4))):
                    rid, url = rid.as_py(), url.as_py()
                    member = record(rid, url, payload.as_py(), refers.as_py(), level)
                    out = out or store.open_output_stream(f"{at}/{name}", compression=None)
                    out.write(member)
                    rows.append((capture_key(url, rid), rid, name, offset, len(member)))
                    offset += len(member)
                if rows:
                    yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=["key", "record_id", "file", "offset", "length"])
        finally:
            if out:
                out.close()

    return saved(captures.select("record_id", "url", "payload", "refers_to").mapInArrow(run, ENTRY), "entries")


def build_index(entries: DataFrame, root: str) -> list[tuple[str, str, str, int, int]]:
    """Sorts entries into compressed blocks under root/index; returns the directory: (first key, last key, file, offset, length).

    It is sorted by both keys: of blocks that begin with one key, at most one goes on to others, and it comes last.
    """
    lines = max(LEAST_LINES, -(-entries.count() // MOST_BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _folder(root, "index")
        name, offset, out, held = f"{uuid.uuid4().hex}.cdx.z", 0, None, []
        rows = []

        def block(part: list[tuple]) -> None:
            nonlocal offset, out
            data = zlib.compress("\n".join("\t".join(map(str, x)) for x in part).encode(), 6)
            out = out or store.open_output_stream(f"{at}/{name}", compression=None)
            out.write(data)
            rows.append((part[0][0], part[-1][0], name, offset, len(data)))
            offset += len(data)

        try:
            for batch in batches:
                held += zip(*(c.to_pylist() for c in batch.columns))
                while len(held) >= lines:
                    block(held[:lines])
                    del held[:lines]
            if held:
                block(held)
        finally:
            if out:
                out.close()
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=["key", "last", "file", "offset", "length"])

    ordered = entries.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    directory = saved(ordered.select("key", "file", "offset", "length").mapInArrow(run, "key string, last string, file string, offset long, length long"), "directory")
    return sorted(tuple(r) for r in directory.collect())  # MOST_BLOCKS and one for each file at most


def look_up(keys: DataFrame, directory: list[tuple[str, str, str, int, int]], root: str, read_bytes: int = 0) -> DataFrame:
    """The records of all captures whose key is in keys(key): directory search, one block, one byte range for each. read_bytes is about what will be read."""
    spark = keys.sparkSession
    held = spark.sparkContext.broadcast(directory)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [x[0] for x in held.value]
        for batch in batches:
            rows = []
            for key in batch.column("key").to_pylist():
                low, high = bisect_left(firsts, key), bisect_right(firsts, key)
                rows += [(b, key) for b in range(max(0, low - 1), high)]  # equal keys may begin in the block before
            if rows:
                yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=["block", "key"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, index = fs.FileSystem.from_uri(f"{root}/index")
        warc = fs.FileSystem.from_uri(f"{root}/warc")[1]
        now, lines, names, files = None, [], [], {}
        for batch in batches:
            places = []
            for block, key in zip(batch.column("block").to_pylist(), batch.column("key").to_pylist()):
                if block != now:
                    now, (_, _, file, offset, length) = block, held.value[block]
                    with store.open_input_file(f"{index}/{file}") as f:
                        lines = [x.split("\t") for x in zlib.decompress(f.read_at(length, offset)).decode().split("\n")]
                    names = [x[0] for x in lines]
                for i in range(bisect_left(names, key), bisect_right(names, key)):
                    places.append((lines[i][1], int(lines[i][2]), int(lines[i][3])))
            rows = []
            for file, offset, length in sorted(places):
                if file not in files:
                    if len(files) >= 64:
                        files.pop(next(iter(files))).close()
                    files[file] = store.open_input_file(f"{warc}/{file}")
                x = parse(files[file].read_at(length, offset))
                rows.append(tuple(x[c] for c in ("record_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")))
            if rows:
                kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["record_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        for f in files.values():
            f.close()

    # a number of our own: the few bytes of keys stand for many reads, so they mustn't be coalesced by size
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), read_bytes // TASK_BYTES)
    dealt = keys.select("key").mapInArrow(locate, "block long, key string").repartition(spread, "block").sortWithinPartitions("block", "key")
    return dealt.mapInArrow(read, RECORD)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes pages as WARC records, indexes them, and reads every capture back through the index.

    Of equal payloads of at least least_bytes the smallest id is the response, the others revisit it; smaller
    ones are all responses. A null payload is empty; a null URL has a key of its own; a null id is record
    "null". Rows that repeat with the smallest id are all responses, each read back once. Very long URLs
    are cut and hashed in keys only. An empty table gives no rows; other columns are not read.
    """
    root = scratch(pages.sparkSession, "warc")
    entries = write_archives(plan_revisits(pages, id_col, url_col, payload_col, least_bytes), root)
    size = entries.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return look_up(entries.select("key").distinct(), build_index(entries, root), root, size)
