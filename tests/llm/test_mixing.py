import math
import random

import pytest

from colloquy.llm import mixing


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, source string, n int, key string")


def rows_of(sizes, seed=1):
    rng = random.Random(seed)
    rows = [(None, s) for s, k in sizes.items() for _ in range(k)]
    return [(i, " ".join("w" * rng.randrange(1, 40)), s) for i, (_, s) in enumerate(rows)]


def test_exponent_meets_targets(spark):
    shares = [0.6, 0.2, 0.15, 0.05]
    sources = spark.createDataFrame([(s,) for s in shares], "share double")
    weights = lambda x: [s**x / sum(t**x for t in shares) for s in shares]
    x = mixing.solve_exponent(sources, repetition=2.0)
    assert math.isclose((0.6 / 0.05) ** (1 - x), 2.0, rel_tol=1e-6)
    x = mixing.solve_exponent(sources, entropy=1.2)
    assert math.isclose(-sum(w * math.log(w) for w in weights(x)), 1.2, abs_tol=1e-6)
    assert mixing.solve_exponent(sources, repetition=100.0) == 0.0 and mixing.solve_exponent(sources, entropy=0.0) == 1.0
    with pytest.raises(ValueError):
        mixing.solve_exponent(sources)


@pytest.mark.parametrize("budget", [None, 20_000, 900])
def test_quotas(spark, budget):
    rows = rows_of({"a": 3000, "b": 300, "c": 50, None: 20})
    got = mixing.plan_mix(table(spark, rows), repetition=2.0, budget=budget).collect()
    assert len(got) == len(rows)
    size = {i: len(t.split()) for i, t, _ in rows}
    totals = {s: sum(size[i] for i, _, x in rows if x == s) for s in ("a", "b", "c", None)}
    n = sum(totals.values())
    x = mixing.solve_exponent(spark.createDataFrame([(t / n,) for t in totals.values()], "share double"), repetition=2.0)
    z = sum((t / n) ** x for t in totals.values())
    for s, t in totals.items():
        w = (t / n) ** x / z
        b = budget if budget is not None else max(u / ((u / n) ** x / z) for u in totals.values())
        own = [r for r in got if r.source == s]
        quota, held = b * w, sum(r.copies * size[r.id] for r in own)
        assert all(math.isclose(r.weight, w, rel_tol=1e-9) for r in own)
        assert {r.copies for r in own} <= {int(quota / t + 1e-9), int(quota / t + 1e-9) + 1}
        # a block is cut by document, so at most the document at the edge is missing
        assert held <= quota + 1e-6 and quota - held <= max(size.values())
        if budget is None:
            assert min(r.copies for r in own) >= 1


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", "a"), (4, "x y z", None), (None, "q", "b"), (3, "x y", "a"), (5, " \n", "c")]
    df = table(spark, rows)
    got = mixing.plan_mix(df, repetition=1.0).collect()
    assert len(got) == len(rows) and all(r.copies == 1 for r in got)
    mixed = mixing.mix(df, repetition=1.0)
    assert mixed.columns == df.columns and sorted(map(str, mixed.collect())) == sorted(map(str, df.collect()))
    assert mixing.plan_mix(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.where("text is null")).count() == 1


def test_many_blocks_and_a_hot_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 16)
    rows = rows_of({"hot": 2000, **{f"s{i}": 20 for i in range(50)}}, 2)
    size = {i: len(t.split()) for i, t, _ in rows}
    got = mixing.plan_mix(table(spark, rows), repetition=3.0, budget=60_000).collect()
    assert len({r.block for r in got}) > 50
    assert 60_000 - 51 * 40 <= sum(r.copies * size[r.id] for r in got) <= 60_000


def test_mix_by_a_shuffle(spark, monkeypatch):
    """Beyond the bound of the broadcast the rows are the same."""
    rows = [(i % 90, "w " * (i % 7 + 1), "hot" if i % 3 else f"s{i % 5}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once = sorted(map(tuple, mixing.mix(df, repetition=1.5).collect()))
    monkeypatch.setattr(mixing, "FEW", 0)
    assert sorted(map(tuple, mixing.mix(df, repetition=1.5).collect())) == once and len(once) > 300
