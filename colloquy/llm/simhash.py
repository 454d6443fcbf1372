"""SimHash near-duplicates, found with a Gray-order hierarchical index.

Equal fingerprints are one class from the start. Classes within DISTANCE bits must agree on one of DISTANCE + 1
blocks of bits, so each is dealt to as many buckets; inside a bucket the fingerprints, sorted by Gray rank,
are put under a tree whose upper nodes hold the bits that all below them share, and a search adds up the
differences on the way down and leaves a whole group as soon as they exceed DISTANCE. Buckets with more than
BUCKET classes are dealt again by the blocks of the bits that are still free. After five such levels at
most 9 bits are free, so a bucket has 512 classes at most: nothing is dropped and no bucket is large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import attach, give_back, keep_first, saved, small_batches, text_digest
from .components import components

DISTANCE, SEED, BUCKET, FAN = 2, 42, 1024, 16
#: Over so many hot buckets the join that sets them apart is shuffled instead of broadcast.
HOT_BROADCAST = 100_000


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 of the word shingles of a text: A-Z lower-cased, words between ASCII white space, all of them if there are fewer than words."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    h, join = xxhash.xxh64_intdigest, b" ".join
    if not w:
        return []
    return [h(join(w), SEED)] if len(w) < words else [h(join(x), SEED) for x in zip(*(w[i:] for i in range(words)))]


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes; none are if there are no hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_udf(words: int):
    @arrow_udf("long")
    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([majority(np.array(shingle_hashes(t.as_py(), words), "<u8")) for t in texts], pa.int64())
        give_back()

    return fingerprint


def gray_rank(col):
    """The position of a 64-bit pattern in Gray order, as a long that sorts so."""
    for s in (1, 2, 4, 8, 16, 32):
        col = col.bitwiseXOR(F.shiftrightunsigned(col, s))
    return col.bitwiseXOR(F.lit(-(1 << 63)))


def block_masks(free: int, parts: int) -> list[int]:
    """The set bits of free in parts runs of nearly equal length."""
    bits = [i for i in range(64) if free >> i & 1]
    cut = [round(len(bits) * k / parts) for k in range(parts + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cut, cut[1:])]


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


class GrayIndex:
    """A static tree over distinct fingerprints in Gray order. levels[0] has the fingerprints themselves.

    A node has the bits that all fingerprints below it share and that its parent has not yet: mask, and value on it.
    """

    def __init__(self, codes: np.ndarray):
        self.codes, mask, value = codes, np.full(len(codes), ~np.uint64(0)), codes
        self.levels = [(mask, value)]
        while len(value) > FAN:
            at = np.arange(0, len(value), FAN)
            every, some = np.bitwise_and.reduceat(value & mask, at), np.bitwise_or.reduceat(value & mask, at)
            mask = np.bitwise_and.reduceat(mask, at) & ~(every ^ some)
            value = every & mask
            below_mask, below = self.levels[-1]
            self.levels[-1] = (below_mask & ~np.repeat(mask, FAN)[: len(below)], below)
            self.levels.append((mask, value))

    def within(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(position in queries, position in codes) of all pairs that differ in at most distance bits."""
        top = len(self.levels[-1][0])
        q, n = np.repeat(np.arange(len(queries)), top), np.tile(np.arange(top), len(queries))
        far = np.zeros(len(q), np.int16)
        for depth in range(len(self.levels) - 1, -1, -1):
            mask, value = self.levels[depth]
            far = far + _ones((queries[q] ^ value[n]) & mask[n])
            q, n, far = (x[far <= distance] for x in (q, n, far))
            if depth:
                below = len(self.levels[depth - 1][0])
                q, far = np.repeat(q, FAN), np.repeat(far, FAN)
                n = (n[:, None] * FAN + np.arange(FAN)).ravel()
                q, n, far = (x[n < below] for x in (q, n, far))
        return q, n


def spanning(codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (positions) that connect what links within distance connect: one fewer than members in each component."""
    root = list(range(len(codes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    index, a, b = GrayIndex(codes), [], []
    for i in range(0, len(codes), 256):
        q, n = index.within(codes[i : i + 256], distance)
        keep = n > q + i
        for x, y in zip((q[keep] + i).tolist(), n[keep].tolist()):
            if (rx := find(x)) != (ry := find(y)):
                root[max(rx, ry)] = min(rx, ry)
                a.append(x)
                b.append(y)
    return np.array(a, np.int64), np.array(b, np.int64)


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, fp) sorted by key and Gray rank; a bucket may go over several batches."""
        key, codes = None, []

        def close() -> Iterator[pa.RecordBatch]:
            x = np.concatenate(codes) if codes else np.zeros(0, np.int64)
            if len(x) > 1:
                a, b = spanning(x.view(np.uint64), distance)
                if len(a):
                    yield pa.record_batch({"u": x[a], "v": x[b]})

        for batch in batches:
            k, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if k[s] != key:
                    yield from close()
                    key, codes = k[s], []
                codes.append(fp[s:e])
        yield from close()

    return run


def _local(entries: DataFrame, distance: int) -> DataFrame:
    ordered = entries.repartition("key").sortWithinPartitions("key", gray_rank(F.col("fp")))
    return ordered.select("key", "fp").mapInArrow(_links(distance), "u long, v long")


def links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(u, v): enough links between distinct fingerprints fps(fp) to connect all that lie within distance bits."""
    parts, found = distance + 1, None
    entries = fps.select("fp")
    level = 0
    while True:
        split = []
        frees = [(1 << 64) - 1] if level == 0 else sorted({f & ~m for f in frees for m in block_masks(f, parts)})
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for f in frees:
            here = entries if level == 0 else entries.where(F.col("free") == signed(f))
            deal = F.array(*[F.struct(F.lit(signed(f & ~m)).alias("free"), F.lit(signed(~f & ((1 << 64) - 1) | m)).alias("fixed")) for m in block_masks(f, parts) if m])
            split.append(here.select("fp", F.explode(deal).alias("d")).select("fp", "d.free", F.xxhash64("d.free", F.col("fp").bitwiseAND(F.col("d.fixed"))).alias("key")))
        dealt = split[0]
        for x in split[1:]:
            dealt = dealt.unionByName(x)
        least_free = min(bin(f & ~m).count("1") for f in frees for m in block_masks(f, parts))
        if 1 << max(bin(f & ~m).count("1") for f in frees for m in block_masks(f, parts)) <= bucket or least_free <= parts:
            now = _local(dealt, distance)
            return now if found is None else found.unionByName(now)
        sizes = dealt.groupBy("key").agg(F.count("*").alias("n"))
        hot = saved(sizes.where(F.col("n") > bucket).select(F.col("key").alias("hot")), "hot")
        n_hot = hot.count()
        if n_hot:
            marked = dealt.join(F.broadcast(hot) if n_hot <= HOT_BROADCAST else hot, F.col("key") == F.col("hot"), "left")
            now = _local(marked.where("hot is null").select("key", "fp"), distance)
        else:
            now = _local(dealt, distance)
        found = now if found is None else found.unionByName(now)
        if not n_hot:
            return found
        entries = saved(marked.where("hot is not null").select("fp", "free").distinct(), "again")
        level += 1


def simhash_classes(docs: DataFrame, id_col: str, text_col: str, words: int, distance: int, bucket: int = BUCKET) -> DataFrame:
    """(id, node, fp, root, component_id, n_equal) for every row: node is the text's digest, root a fingerprint that names the component."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = saved(own.select("id", text_digest("text").alias("node"), fingerprint_udf(words)("text").alias("fp")), "fingerprints")
    total = rows.count()
    classes = saved(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    member = saved(components(links(classes.select("fp"), distance, bucket)), "members")
    named = classes.join(member, F.col("fp") == F.col("node"), "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    sizes = named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("k"))
    table = attach(named, sizes, "root", "k", max(total, 1)).select("fp", "n", "root", "component_id")
    return attach(rows, table, "fp", "n", max(total, 1)).select("id", "node", "fp", "root", "component_id", F.col("n").alias("n_equal"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(id, fp, component_id, n_equal) for every row: fp is the fingerprint as a long, n_equal the rows that share it.

    component_id is the smallest id that links of at most distance differing bits reach, the own id included.
    Null and empty texts, and texts of white space only, have fingerprint 0 and link like others. Texts of
    fewer words than a shingle are one shingle. Repeated rows are classified each. A null id is never a
    component_id unless its component has no other. An empty table gives no rows; other columns are not read.
    """
    return simhash_classes(docs, id_col, text_col, words, distance, bucket).drop("node", "root")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each component: that of the smallest id. All columns stay as they are.

    Rows of one id with different texts are told apart: each may stand for a component of its own. Among texts of the
    smallest id in one component the one with the smallest digest stays, and of equal rows one.
    """
    rows = simhash_classes(docs, id_col, text_col, words, distance).groupBy("id", "node", "root").agg(F.count("*").alias("n_same"))
    return keep_first(docs, saved(rows.withColumnRenamed("root", "group"), "rows"), id_col, text_col)
