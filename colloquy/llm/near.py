"""Near duplicates by the similarity of word shingles, with SimHash fingerprints under a Gray-order index.

A text's fingerprint is the SimHash of its distinct shingles. Texts at a similarity of 0.8 differ in some 10 of 64 bits,
too many to deal fingerprints by blocks of bits. So each text has FAMILIES more fingerprints, each the SimHash of a
sample only: the SAMPLE shingles that come first in the family's order. Texts of similarity s have equal samples in a
family with a probability of about s ** SAMPLE, and texts that share nothing never do, however many there are. Within
a bucket of equal samples the whole fingerprints, sorted by Gray rank, are searched under the tree of shared bits, which
leaves a group as soon as its differences add up to more than WITHIN; the nearest pairs that connect what was
found are checked exactly by their shingles, and only pairs that pass link.

A bucket goes in runs of BUCKET fingerprints in Gray order, wherever its rows lie. Of a bucket with several runs, one
fingerprint for each group found goes on to the next of LEVELS rounds, in the order of turned bits.

That search only makes groups early; what it misses or drops is found exactly by rest(). Two texts at the similarity
share one of the shingles that come first in any order that is the same for all texts, if as many are taken as may
differ and one more. Shingles that are frequent in a sample come last. All pairs that share one and are not in one
group yet are candidates, large buckets block against block; a pair that is seen to share an earlier one is left to
that bucket. Sizes, places and parities of shingles rule out most of them, none of which can be alike, and the others
are checked by their shingles.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, clear, give_back, if_few, keep_first, saved, small_batches, text_digest, text_of
from .components import components
from .simhash import GrayIndex, gray_rank, majority, shingle_hashes

WORDS, SIMILARITY, FAMILIES, SAMPLE, WITHIN, BUCKET, LEVELS, TURN = 5, 0.8, 6, 3, 20, 1024, 3, 21
#: Some SAMPLED texts say which shingles are frequent: those in OFTEN of them, MOST_FREQUENT at most. They change the order only, never the result.
SAMPLED, OFTEN, MOST_FREQUENT = 10_000, 3, 1 << 16
#: A bucket of first shingles with more texts is dealt in blocks of so many, each pair of blocks by itself.
BLOCK = 1024
#: So many shared shingles before each are known where pairs are made.
BEFORE = 4
#: The most bits of a parity sketch.
PARITY_BITS = 1 << 16
#: Bounds are taken this much wider than computed, so that rounding rules nothing out.
SLACK = 1e-6


def shingles(text: bytes | str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text in order: A-Z lower-cased, words between ASCII white space, all of them if there are fewer than words."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def _orders(x: np.ndarray, family: int) -> np.ndarray:
    """The places of shingle hashes in a family's order."""
    x = (x ^ np.uint64(0x9E3779B97F4A7C15 * (family + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0x94D049BB133111EB)


def samples(found: np.ndarray) -> list[int]:
    """The SimHash of each family's sample."""
    out = []
    for family in range(FAMILIES):
        order = _orders(found, family)
        out.append(majority(found if len(found) <= SAMPLE else found[np.argpartition(order, SAMPLE)[:SAMPLE]]))
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets in order; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles in order that are frequent in a sample of docs(text), and how often each stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 64):
                found = [shingles(t.as_py(), words) for t in batch.column("text")[k : k + 64]]
                yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64))], names=["h"])
        give_back()

    part = docs.select("text").sample(min(1.0, SAMPLED / max(docs.count(), 1)), 1)
    counted = part.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    got = counted.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toArrow()
    h, n = got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def first_shingles(found: np.ndarray, often: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The shingles of a text that come first, frequent ones last: every text at a similarity of least or more has one of them among its own first."""
    h, n = often
    place = _orders(found, FAMILIES) >> np.uint64(16)
    if len(h) and len(found):
        at = np.minimum(np.searchsorted(h, found), len(h) - 1)
        place |= np.where(h[at] == found, np.minimum(n[at], 65535), 0).astype(np.uint64) << np.uint64(48)
    return found[np.argsort(place, kind="stable")[: len(found) - math.ceil(least * len(found) - SLACK) + 1]]


def parity(found: np.ndarray) -> bytes:
    """The number of shingles, and for each value of their last bits whether an odd number of them has it."""
    bits = min(1 << max(6, len(found).bit_length()), PARITY_BITS)
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return len(found).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8)).tobytes()


def may_be_alike(a: bytes, b: bytes, least: float) -> bool:
    """False only if sets with these parities have a similarity under least: they differ in as many members as parities at least."""
    x, y = (np.frombuffer(p, np.uint8, offset=8) for p in (a, b))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    both = int.from_bytes(a[:8], "little") + int.from_bytes(b[:8], "little")
    return int(np.bitwise_count(x ^ y).sum()) <= (1 - least) / (1 + least) * both + SLACK


NONE_OFTEN = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def sketches(docs: DataFrame, words: int, often: tuple[np.ndarray, np.ndarray] = NONE_OFTEN, least: float = SIMILARITY) -> DataFrame:
    """(id, node, fp, keys, same, n, first, odd) of docs(id, node, text): the fingerprint and those of the samples, the digest and the number of the shingles, the first of them, and their parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for t in batch.column("text"):
                found = shingles(t.as_py(), words)
                row = majority(found), samples(found), hashlib.md5(found.tobytes()).digest(), len(found), first_shingles(found, often, least).view(np.int64), parity(found)
                for values, x in zip(out, row):
                    values.append(x)
            arrays = [pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()))]
            yield pa.record_batch([batch.column("id"), batch.column("node"), *arrays], names=["id", "node", "fp", "keys", "same", "n", "first", "odd"])
        give_back()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "node", "text").mapInArrow(run, f"id {kind}, node string, fp long, keys array<long>, same binary, n long, first array<long>, odd binary")


def nearest_forest(codes: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (positions) of a spanning forest of the pairs that differ in at most within bits, nearest pairs first."""
    index, found = GrayIndex(codes), []
    for i in range(0, len(codes), 256):
        q, n = index.within(codes[i : i + 256], within)
        keep = n > q + i
        found.append(np.stack([q[keep] + i, n[keep]]))
    a, b = np.concatenate(found, axis=1)
    order = np.argsort(np.bitwise_count(codes[a] ^ codes[b]), kind="stable")
    a, b, root = a[order], b[order], np.arange(len(codes))
    out: list[tuple[int, int]] = []
    for k in range(0, len(a), 2048):
        x, y = a[k : k + 2048], b[k : k + 2048]
        apart = root[x] != root[y]
        for u, v in zip(x[apart].tolist(), y[apart].tolist()):
            if root[u] != root[v]:
                root[root == root[v]] = root[u]
                out.append((u, v))
    edges = np.array(out, np.int64).reshape(-1, 2)
    return edges[:, 0], edges[:, 1]


def _search(within: int, bucket: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, fp, node) sorted by key and Gray order -> pairs (u, v), and (u, key, fp, run) for a fingerprint of each group of a bucket that may go on."""
        schema = pa.schema([("u", pa.string()), ("v", pa.string()), ("key", pa.int64()), ("fp", pa.int64()), ("run", pa.string())])

        def search(key: int, parts: list[tuple[np.ndarray, list]], goes_on: bool) -> Iterator[pa.RecordBatch]:
            codes, nodes = np.concatenate([p[0] for p in parts]), [x for p in parts for x in p[1]]
            a, b = nearest_forest(codes.view(np.uint64), within) if len(codes) > 1 else (np.zeros(0, np.int64),) * 2
            if len(a):
                none = pa.nulls(len(a), pa.int64())
                yield pa.record_batch([pa.array([nodes[x] for x in a.tolist()]), pa.array([nodes[x] for x in b.tolist()]), none, none, pa.nulls(len(a), pa.string())], schema=schema)
            if goes_on:
                degree, root = np.bincount(np.concatenate([a, b]), minlength=len(codes)), np.arange(len(codes))
                for x, y in zip(a.tolist(), b.tolist()):
                    root[root == root[y]] = root[x]
                order = np.lexsort((-degree, root))
                first = order[np.flatnonzero(np.diff(root[order], prepend=-1))]  # of each group the one with the most links
                n = len(first)
                yield pa.record_batch([pa.array([nodes[x] for x in first.tolist()]), pa.nulls(n, pa.string()), pa.array(np.full(n, key)), pa.array(codes[first]), pa.array([uuid.uuid4().hex] * n)], schema=schema)

        key, held, n, first, ran = None, [], 0, True, False
        for batch in batches:
            k, fp, nodes = batch.column("key").to_numpy(), batch.column("fp").to_numpy(), batch.column("node").to_pylist()
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)] if len(k) else []
            for s, e in zip(cuts, cuts[1:]):
                if k[s] != key:
                    if held:
                        yield from search(key, held, first or ran)  # a bucket at the task's edge may have rows in another task
                    first = key is None
                    key, held, n, ran = int(k[s]), [], 0, False
                while s < e:
                    if n == bucket:
                        yield from search(key, held, True)
                        held, n, ran = [], 0, True
                    take = min(e - s, bucket - n)
                    held.append((fp[s : s + take], nodes[s : s + take]))
                    s, n = s + take, n + take
        if held:
            yield from search(key, held, True)
        del held
        give_back()

    return run


def turned(fp: Column, by: int) -> Column:
    """A fingerprint with its bits turned."""
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def candidates(nodes: DataFrame, within: int = WITHIN, bucket: int = BUCKET) -> DataFrame:
    """(u, v): the pairs of nodes(node, fp, keys) to check."""
    entries = nodes.select("node", "fp", F.posexplode("keys").alias("family", "key")).select("node", "fp", F.xxhash64("family", "key").alias("key"))
    pairs = None
    for level in range(LEVELS):
        gray = gray_rank(turned(F.col("fp"), TURN * level))
        dealt = entries.withColumn("gray", gray).repartitionByRange("key", "gray", "node").sortWithinPartitions("key", "gray", "node").select("key", "fp", "node")
        found = saved(dealt.mapInArrow(_search(within, bucket), "u string, v string, key long, fp long, run string"), "candidates")
        here = found.where("v is not null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        pairs = here if pairs is None else pairs.unionByName(here)
        on = found.where("v is null")
        split = on.groupBy("key").agg(F.min("run").alias("a"), F.max("run").alias("b")).where("a <> b").select("key")
        entries = saved(on.join(split, "key", "left_semi").select(F.col("u").alias("node"), "fp", "key"), "again")
        if entries.isEmpty():
            break
    return pairs.distinct()


def rest(rows: DataFrame, member: DataFrame, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(u, v): of rows(node, n, first) all pairs that may have a similarity of least or more and are not in one group of member(node, root).

    Nodes and groups go as 64-bit hashes, as shingles do; u and v are xxhash64 of nodes.
    """
    of = member.select(F.xxhash64("node").alias("m"), F.xxhash64("root").alias("root"))
    grouped = rows.withColumn("no", F.xxhash64("node")).join(if_few(of), F.col("no") == F.col("m"), "left")
    each = grouped.select("no", F.coalesce("root", "no").alias("group"), F.col("n").cast("int").alias("n"), F.posexplode("first").alias("at", "key"))
    several = each.groupBy("key").agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a <> b").select("key")
    hits = each.join(if_few(saved(several, "several")), "key").distinct()
    # texts of many shared shingles would meet in all their buckets: two that have one of those before in common have met there
    earlier = Window.partitionBy("no").orderBy("at")
    hits = saved(hits.withColumn("before", F.array_compact(F.array(*[F.lag("key", i).over(earlier) for i in range(1, BEFORE + 1)]))), "hits")
    # within the largest group of a bucket nothing is left to find, so its blocks meet those of the others only
    counts = hits.groupBy("key", "group").agg(F.count("*").alias("k"))
    sizes = counts.groupBy("key").agg(F.max(F.struct("k", "group")).alias("main"), F.sum("k").alias("all"))
    large = F.col("all") > block
    parts = lambda n: F.ceil(n / F.lit(block))
    sizes = sizes.select("key", F.when(large, F.col("main.group")).alias("main"), F.when(large, parts(F.col("all") - F.col("main.k"))).otherwise(1).alias("others"), F.when(large, parts(F.col("main.k"))).otherwise(0).alias("mains"))
    told = hits.join(if_few(saved(sizes, "sizes")), "key").withColumn("is_main", F.coalesce(F.col("group") == F.col("main"), F.lit(False)))
    deal = lambda n: F.pmod(F.xxhash64("no"), F.greatest(n, F.lit(1)))
    told = told.withColumn("block", F.when(F.col("is_main"), F.col("others") + deal(F.col("mains"))).otherwise(deal(F.col("others"))))
    last = F.when(F.col("is_main"), F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1)
    dealt = told.select("key", "no", "group", "n", "at", "before", "block", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    dealt = dealt.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "no", "group", "n", "at", "before", "block")
    a, b = (dealt.select("key", "low", "high", *[F.col(c).alias(f"{c}_{side}") for c in ("no", "group", "n", "at", "before", "block")]) for side in "ab")
    apart = (F.col("no_a") < F.col("no_b")) & (F.col("group_a") != F.col("group_b")) & ((F.col("low") == F.col("high")) | (F.col("block_a") != F.col("block_b")))
    sized = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least - SLACK
    # if this shingle is the first that a pair shares, it shares no more than what follows in either
    placed = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= (F.col("n_a") + F.col("n_b")) * (least / (1 + least)) - SLACK
    met = F.arrays_overlap("before_a", "before_b")
    return a.join(b, ["key", "low", "high"]).where(apart & sized & placed & ~met).select(F.col("no_a").alias("u"), F.col("no_b").alias("v")).distinct()


def _ends_of(pairs: DataFrame, name: str) -> DataFrame:
    """The ends of saved pairs (u, v) in a column of that name."""
    return if_few(saved(pairs.select(F.col("u").alias(name)).unionByName(pairs.select(F.col("v").alias(name))).distinct(), "involved"))


def _passing(pairs: DataFrame, have: DataFrame, key: str, value: str, ok: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The nodes (u, v) of pairs (u, v) of keys whose values in have(key, node, value) pass ok."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = [ok(a.as_py(), b.as_py()) for a, b in zip(batch.column("a"), batch.column("b"))]
            yield batch.filter(pa.array(passed, pa.bool_())).select(["u", "v"])
        give_back()

    a, b = (have.select(F.col(key).alias(n), F.col("node").alias(f"{n}_node"), F.col(value).alias(s)) for n, s in (("u", "a"), ("v", "b")))
    return pairs.join(a, "u").join(b, "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"), "a", "b").mapInArrow(check, "u string, v string")


def possible(pairs: DataFrame, rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The nodes (u, v) of the pairs of rest() that the parities of rows(node, odd) don't rule out."""
    pairs = saved(pairs, "rest")
    named = rows.select(F.xxhash64("node").alias("no"), "node", "odd")
    wanted = named.join(_ends_of(pairs, "no"), "no", "left_semi").groupBy("no", "node").agg(F.any_value("odd").alias("odd"))
    return _passing(pairs, saved(wanted, "parities"), "no", "odd", lambda a, b: may_be_alike(a, b, least))


def links(pairs: DataFrame, texts: DataFrame, words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """The pairs (u, v) whose texts(node, text) have a similarity of least or more, by their shingles."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                yield pa.record_batch([part.column("node"), pa.array([shingles(t.as_py(), words).tobytes() for t in part.column("text")], pa.binary())], names=["node", "shingles"])

    pairs = saved(pairs, "pairs")
    # of rows with one text the first that a task meets is as good as any
    wanted = texts.join(_ends_of(pairs, "node"), "node", "left_semi").groupBy("node").agg(F.any_value("text").alias("text"))
    have = saved(wanted.mapInArrow(sets, "node string, shingles binary"), "shingles")
    return _passing(pairs, have, "node", "shingles", lambda a, b: similarity(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= least)


def equal_sets(rows: DataFrame) -> DataFrame:
    """(u, v): a link from each node of rows(node, same) to the smallest with equal shingles."""
    several = rows.groupBy("same").agg(F.min("node").alias("u"), F.max("node").alias("w")).where("u <> w").select("same", "u")
    return rows.join(if_few(saved(several, "equal")), "same").where("node <> u").select("u", F.col("node").alias("v")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """(id, node, group, component_id, n_same) for every distinct pair of id and text.

    node is the text's digest and group that of one of its group's texts; component_id is the smallest id in the group,
    and n_same says how many rows are alike. Links are similarities of least or more between the sets of word
    shingles. Equal texts are linked; null, empty and blank texts are alike. Texts of fewer words than a shingle are one
    shingle. No link is missed. Rows of one id with different texts are told apart. A null id is never a component_id unless its group has no
    other. An empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), text_digest(text_col).alias("node"))
    texts = own.select("node", "text")
    rows = saved(sketches(own, words, frequent(texts, words), least), "sketches")
    nodes = rows.groupBy("node").agg(F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys"))
    member = saved(components(links(candidates(nodes), texts, words, least).unionByName(equal_sets(rows))), "early")
    clear(docs.sparkSession)
    more = saved(links(possible(rest(rows, member, least), rows, least), texts, words, least), "more")
    if not more.isEmpty():
        member = saved(components(member.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)), "members")
    clear(docs.sparkSession)
    member = member.withColumnRenamed("node", "m")
    each = rows.groupBy("id", "node").agg(F.count("*").alias("n_same"))
    each = saved(each.join(if_few(member), F.col("node") == F.col("m"), "left").select("id", "node", F.coalesce("root", "node").alias("group"), "n_same"), "each")
    smallest = each.groupBy("group").agg(F.min("id").alias("component_id"), F.count("*").alias("k"))
    return attach(each, smallest, "group", "k", max(each.count(), 1)).select("id", "node", "group", "component_id", "n_same")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the smallest id. All columns stay as they are.

    Among texts of that id in one group the one with the smallest digest stays, and of equal rows one. Groups and
    odd rows are those of near_groups(). An empty table stays empty.
    """
    return keep_first(docs, near_groups(docs, id_col, text_col, words, least), id_col, text_col)
