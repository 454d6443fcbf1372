import random

import numpy as np
import pytest

from colloquy.llm import components, exact_dedup, simhash


def docs(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "doc_id long, text string, digest string, keep_id string, fp int")


def brute_groups(rows):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    out = []
    for ids in groups.values():
        ids = sorted(ids, key=lambda i: -1 if i is None else i)
        out += [(i, ids[-1], len(ids), k == len(ids) - 1) for k, i in enumerate(ids)]
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [0, 900])
def test_exact_groups(spark, hot):
    rng = random.Random(1)
    rows = [(i, rng.choice(["A b", "a B", "É", "é", None, "", f"own {i}"])) for i in range(300)] + [(1000 + i, "Hot") for i in range(hot)]
    rows += [(1000 + hot - 1, "hot"), (5000, "repeat"), (5000, "repeat"), (None, "lone"), (None, "x"), (3, "x"), (9, "z" * 300_000)]
    got = exact_dedup.exact_groups(docs(spark, rows)).collect()
    assert sorted([(r.id, r.keep_id, r.group_size, r.kept) for r in got], key=str) == brute_groups(rows)
    kept = exact_dedup.exact_dedup(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "digest", "keep_id", "fp"]
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([x[0] for x in brute_groups(rows) if x[3]], key=str)


def test_exact_empty(spark):
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0 and exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 700)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)] + [(5, 5), (1, 0), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def fingerprint(t):
    h = simhash.shingle_hashes(t, 3)
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("bucket", [1024, 8])
def test_simhash_components(spark, bucket):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefghijkl") for _ in range(60)) for _ in range(12)]
    rows = []
    for i in range(400):
        t = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 2, 6])):
            t[rng.randrange(len(t))] = rng.choice("abcdefghijkl")
        rows.append((i, " ".join(t)))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "One"), (904, "one two"), (905, "ONE"), (905, "ONE"), (906, "x y z " * 20_000)]
    f = {i: fingerprint(t) for i, t in rows}
    root = {i: i for i in f}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in f:
        for b in f:
            if a < b and (f[a] ^ f[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = simhash.simhash_components(docs(spark, rows), bucket=bucket).collect()
    assert len(got) == len(rows) and {r.id: (r.fp % (1 << 64), r.component_id) for r in got} == {i: (f[i], find(i)) for i in f}
    if bucket == 1024:
        kept = simhash.simhash_dedup(docs(spark, rows))
        assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in f})


def test_simhash_empty(spark):
    assert simhash.simhash_components(docs(spark, [])).count() == 0


def test_gray_index_finds_every_link():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(12)] + [base]))
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    codes = codes[np.argsort(rank)]
    for d in (0, 2, 5):
        q, n = simhash.GrayIndex(codes).within(codes, d)
        far = np.bitwise_count(codes[:, None] ^ codes[None, :])
        assert {*zip(q.tolist(), n.tolist())} == {*zip(*(x.tolist() for x in np.nonzero(far <= d)))}


def test_scratch_can_be_released(spark):
    from colloquy.llm import common

    df = common.saved(spark.range(3), "gone")
    path = common._paths[-1]
    assert df.count() == 3 and common.release(spark) >= 1
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@pytest.mark.parametrize("total", [3000, 10])
def test_attach_whatever_the_skew(spark, total):
    from colloquy.llm import common

    rows = [(i, "hot" if i % 3 else f"k{i % 50}") for i in range(300)] + [(999, None), (998, "none")]
    counts = {}
    for _, k in rows:
        counts[k] = counts.get(k, 0) + 1
    table = spark.createDataFrame([(k, n, k + "!") for k, n in counts.items() if k and k != "none"], "k string, n long, v string")
    got = common.attach(spark.createDataFrame(rows, "i long, k string"), table, "k", "n", total).collect()
    assert sorted((r.i, r.v or "") for r in got) == sorted((i, k + "!" if k and k != "none" else "") for i, k in rows)
