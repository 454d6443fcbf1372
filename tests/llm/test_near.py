"""Near duplicates against brute force over all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

from colloquy.llm import near, simhash

STOCK = [f"w{i}" for i in range(400)]


def brute_shingles(text, words=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0d]+", low) if x]
    return frozenset(" ".join(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([" ".join(w)] if w else [])


def brute_pairs(texts, least=0.8):
    sets = [brute_shingles(t) for t in texts]
    for i, j in combinations(range(len(sets)), 2):
        a, b = sets[i], sets[j]
        if not a and not b or min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b):
            yield i, j


def corpus(n=500):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(STOCK, k=rng.choice([3, 40, 120, 400]))) for _ in range(n)]
    for _ in range(300):
        w = rng.choice(texts[:n]).split()
        for _ in range(rng.randrange(max(1, len(w) // 30) + 1)):
            w[rng.randrange(len(w))] = rng.choice(STOCK)
        texts.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
    passage = " ".join(rng.choices(STOCK, k=80))
    texts += [passage + " " + " ".join(rng.choices(STOCK, k=60)) for _ in range(60)]  # a passage that many share, below the similarity
    return texts


def groups(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(i) for i in range(n)]


def test_groups_against_brute_force(spark):
    texts = corpus()
    pairs = set(brute_pairs(texts))
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(texts)], "doc_id long, text string, node string, group int")
    got = {r.id: r.component_id for r in near.near_groups(df).collect()}
    linked = sum(got[a] == got[b] for a, b in pairs)
    assert len(pairs) > 150 and linked >= 0.95 * len(pairs)
    exp = groups(len(texts), pairs)
    assert all(exp[i] == exp[c] for i, c in got.items())  # nothing is linked that brute force does not link
    kept = near.near_dedup(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, c in got.items() if i == c}


def test_buckets_of_many_runs(spark, monkeypatch):
    """A large group of near copies of one text, dealt in runs of eight over several tasks, stays one group."""
    rng = random.Random(4)
    base = rng.choices(STOCK, k=200)
    rows = [(i, " ".join(base[:k] + [f"new{i}"] + base[k + 1 :])) for i in range(150) for k in [rng.randrange(200)]]
    monkeypatch.setattr(near, "BUCKET", 8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    nodes = near.sketches(df.selectExpr("doc_id AS id", "text", "md5(text) AS node"), 5)
    pairs = near.candidates(nodes, bucket=8)
    found = near.links(pairs, df.selectExpr("md5(text) AS node", "text"))
    names = {__import__("hashlib").md5(t.encode()).hexdigest(): i for i, t in rows}
    assert len(set(groups(150, [(names[r.u], names[r.v]) for r in found.collect()]))) <= 3


def test_odd_rows(spark):
    long = " ".join(random.Random(1).choices(STOCK, k=60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one two"), (6, "one  three"), (7, long), (8, long + " more"), (7, "other words"), (None, "lone text"), (9, "lone text"), (9, "lone text")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, __key string")
    kept = sorted((r.doc_id, (r.text or "")[:9]) for r in near.near_dedup(df).collect())
    assert kept == sorted([(1, ""), (4, "One two"), (6, "one  thre"), (7, long[:9]), (7, "other wor"), (9, "lone text")])
    assert near.near_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("dedup", [simhash.simhash_dedup, near.near_dedup])
def test_repeated_ids_keep_every_group(spark, dedup):
    a, b = (" ".join(random.Random(k).choices(STOCK, k=50)) for k in (1, 2))
    rows = [(1, a), (1, b), (2, b + " "), (3, a.upper()), (1, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = dedup(df).collect()
    assert sorted(r.text.strip().lower() for r in kept) == sorted([a, b]) and {r.doc_id for r in kept} == {1}


def test_samples_agree_as_often_as_texts_are_alike():
    rng, equal, same = np.random.default_rng(5), 0, 0
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        a, b = np.unique(x[:180]), np.unique(x[20:])  # similarity 0.8
        equal += any(p == q for p, q in zip(near.samples(a), near.samples(b)))
        same += near.similarity(a, b) == 0.8
    assert same == 300 and equal > 285


def crowd():
    """Threes of near copies, many of them just at the similarity or just below, and a large group of near copies in between."""
    rng = random.Random(11)
    texts = []
    for i in range(250):
        base = rng.choices(STOCK, k=rng.choice([49, 94, 184]))
        for j in range(3):  # a change within takes five shingles, so one or two reach 0.8 for the short ones
            w = list(base)
            for k in rng.sample(range(5, len(w) - 5), rng.randrange(len(w) // 45 + 1)):
                w[k] = f"new{i}x{j}x{k}"
            texts.append(" ".join(w))
    base = rng.choices(STOCK, k=150)
    texts += [" ".join(base[:k] + [f"own{i}"] + base[k + 1 :]) for i in range(120) for k in [rng.randrange(150)]]
    return texts + ["\n" * k for k in range(1, 40)]


@pytest.mark.parametrize("bucket, block", [(1024, 1024), (8, 6)])
def test_no_link_is_missed(spark, monkeypatch, bucket, block):
    """Groups are those of brute force, whatever the early search drops, and in buckets dealt in blocks."""
    monkeypatch.setattr(near.candidates, "__defaults__", (near.WITHIN, bucket))
    if hasattr(near, "rest"):
        monkeypatch.setattr(near.rest, "__defaults__", (near.SIMILARITY, block))
    texts = crowd()
    exp = groups(len(texts), brute_pairs(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component_id for r in near.near_groups(df).collect()}
    wrong = [i for i, c in got.items() if exp[i] != c]
    assert len(got) == len(texts) and not wrong, len(wrong)


def test_rest_finds_all_pairs(spark):
    """Without any early group the exact search alone finds every pair, also in blocks of seven."""
    texts = corpus(200)
    df = spark.createDataFrame([(i, t, str(i)) for i, t in enumerate(texts)], "id long, text string, node string")
    rows = near.saved(near.sketches(df, 5, near.frequent(df, 5)), "rows")
    none = spark.createDataFrame([], "node string, root string")
    exp = {(i, j) for i, j in brute_pairs(texts) if brute_shingles(texts[i])}
    for block in (7, 1024):
        found = near.links(near.possible(near.rest(rows, none, block=block), rows), df.select("node", "text"))
        assert {tuple(sorted((int(r.u), int(r.v)))) for r in found.collect()} == exp and exp


@pytest.mark.parametrize("block", [1024, 7])
def test_a_pair_is_made_about_once(spark, block):
    """Texts that share many first shingles and are mostly not alike: the join makes few more rows than there are pairs, and no pair is missing."""
    rng, texts = random.Random(3), []
    base = rng.choices(STOCK, k=300)
    for i in range(30):
        w = list(base)
        for k in rng.sample(range(len(w)), rng.choice([3, 6, 6, 6])):
            w[k] = f"new{i}x{k}"
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t, str(i)) for i, t in enumerate(texts)], "id long, text string, node string")
    rows = near.saved(near.sketches(df, 5), "rows")
    pairs = near.rest(rows, spark.createDataFrame([], "node string, root string"), block=block)
    made = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, pairs._jdf.queryExecution().analyzed().children().head()).count()
    found = near.links(near.possible(pairs, rows), df.select("node", "text"))
    exp = set(brute_pairs(texts))
    assert {tuple(sorted((int(r.u), int(r.v)))) for r in found.collect()} == exp and exp
    assert made <= 1.5 * pairs.count(), made


def test_parities_rule_out_no_pair():
    rng = np.random.default_rng(2)
    for n in (1, 5, 64, 300, 5000):
        for _ in range(40):
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            a, b = np.unique(x[: n - n // 9]), np.unique(x[n // 9 :])
            assert near.may_be_alike(near.parity(a), near.parity(b), 0.8) or near.similarity(a, b) < 0.8
    assert not near.may_be_alike(near.parity(x), near.parity(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)), 0.8)
