import random
import zlib

import numpy as np

from colloquy.llm import langid, subword, toxicity


def words(rng, stock, n):
    return " ".join(rng.choice(stock) for _ in range(n))


PLAIN = ["river", "table", "walks", "green", "morning", "letter", "window", "quiet", "paper", "garden"]
RUDE = ["grumblor", "snarkzit", "vexmoot", "gnashpit"]


def toxic_rows(n=900):
    rng = random.Random(3)
    out = []
    for i in range(n):
        t, bad = words(rng, PLAIN, rng.choice([5, 60, 400])).split(), i % 3 == 0
        if bad:
            for _ in range(2):
                w = rng.choice(RUDE)
                t[rng.randrange(len(t))] = w if rng.random() < 0.5 else w + rng.choice("xyz")
        out.append((i, " ".join(t), int(bad)))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows] + [(10_001, None, "x", 0.5), (10_002, "", "x", 0.5), (None, "river", "x", 0.5), (5, rows[5][1], "x", 0.5), (10_003, "river " * 50_000, "x", 0.5)], "doc_id long, text string, h string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(10_001, None), (7, rows[7][2])], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    y = {i: v for i, _, v in rows}
    held = [(r.predicted, y[r.id]) for r in got if r.held_out and r.id in y]
    assert {r.id for r in got if r.held_out} == {i for i in {r.id for r in got} if i is not None and zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([p for p, v in held if v]) > 0.95 and np.mean([p for p, v in held if not v]) < 0.02
    # misspelt in ways that training has not seen
    model = toxicity.fit(docs, labels)
    assert (toxicity.scores(model, [b"a quiet table grumblorq by the river", b"snarkzitt"]) > 0.7).all()
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id is null or doc_id > 10000").count() == 4


def test_toxicity_labels_of_other_rows_do_not_matter(spark):
    rows = toxic_rows(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    runs = [toxicity.score_documents(docs, spark.createDataFrame([(i, 1 - y if flip and out(i) else y) for i, _, y in rows], "doc_id long, toxic int")).collect() for flip in (False, True)]
    assert sorted(runs[0]) == sorted(runs[1])


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.score_documents(docs, none).collect()] == [0, 0]
    assert toxicity.score_documents(docs.limit(0), none).count() == 0


STOCK = {"aa": ["bana", "kolu", "mipa", "suna"], "bb": ["Straße", "übung", "größe", "macht"], "cc": ["çaça", "niño", "coração", "olé"]}


def test_language_on_held_out_rows(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, STOCK[k], rng.choice([3, 30, 300])), k) for i in range(900) for k in [rng.choice([*STOCK])]]
    extra = [(2000, None, "aa"), (2001, "", "aa"), (2002, "12 34 !", "aa"), (2003, "bana kolu", None), (None, "bana", "bb"), (3, rows[3][1], rows[3][2]), (2004, "Straße " * 30_000, None)]
    docs = spark.createDataFrame([(*r, "s", 1.0) for r in rows + extra], "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.id: r for r in got}
    held = [by[i].lang_pred == k for i, _, k in rows if by[i].held_out]
    assert len(held) > 100 and np.mean(held) > 0.99
    assert [by[i].lang_pred for i in (2000, 2001, 2002, 2003, 2004)] == ["und", "und", "und", "aa", "bb"]
    assert all(0 <= r.score <= 1 for r in got) and by[2002].score == 0
    # calibrated: the mean score is near the share of right predictions
    assert abs(np.mean([by[i].score for i, _, _ in rows if by[i].held_out]) - np.mean(held)) < 0.1


def test_language_edge_tables(spark):
    one = spark.createDataFrame([(i, "abc", "xx") for i in range(9)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(one).collect()} == {"xx"}
    none = one.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {(r.lang_pred, r.score) for r in langid.identify(none).collect()} == {("und", 0.0)}
    assert langid.identify(one.limit(0)).count() == 0


def test_grams_stay_within_words():
    low, starts = subword.clean([b"Ab c", b"", b"xyz"])
    assert low.tobytes() == b" ab c    xyz " and starts.tolist() == [0, 6, 8, 13]
    seen = {size: sorted({low[i : i + size].tobytes() for i in at}) for size, (at, _) in zip((2, 3, 4), subword.grams(low, (2, 3, 4), 18))}
    assert seen[2] == [b" a", b" c", b" x", b"ab", b"b ", b"c ", b"xy", b"yz", b"z "]
    assert seen[3] == [b" ab", b" c ", b" xy", b"ab ", b"xyz", b"yz "]
    assert seen[4] == [b" ab ", b" xyz", b"xyz "]
    begins, of = subword.windows(low, starts, 1)
    assert of.tolist() == [0, 0, 1, 2] and len(starts) == 4


def test_sample_rows(spark, monkeypatch):
    rows = [(i % 50, f"text {i}", "ab"[i % 2]) for i in range(400)] + [(1, "same", "a"), (1, "same", "b"), (2, "twice", "a"), (2, "twice", "a"), (3, "none", None), (4, "x" * 300_000, "a"), (5, "rare", "c")] + [(6, "hot", "b")] * 300
    df = spark.createDataFrame(rows, "id long, text string, label string")
    got = toxicity.sample_rows(df, 600)
    assert len(got) == len(set(got)) == 403 and (b"rare", "c") in got and (b"hot", "b") in got and not [t for t, _ in got if t in (b"same", b"none") or len(t) > 1000]
    few = toxicity.sample_rows(df, 7)
    assert {v for _, v in few} == {"a", "b", "c"} and all(sum(x == v for _, x in few) <= 7 for v in "abc") and few == toxicity.sample_rows(df.repartition(5), 7)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 30)
    assert sum(len(t) for t, _ in toxicity.sample_rows(df, 600)) <= 30
    assert toxicity.sample_rows(df.limit(0), 600) == []


def test_contradicting_labels_are_not_learned(spark):
    rows = toxic_rows(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    own = [(i, y) for i, _, y in rows if i % 7]
    some = toxicity.fit(docs, spark.createDataFrame(own, "doc_id long, toxic int"))
    both = toxicity.fit(docs, spark.createDataFrame(own + [(i, y) for i in range(0, 300, 7) for y in (0, 1)], "doc_id long, toxic int"))
    assert np.array_equal(some.table, both.table)


def test_scores_against_a_plain_version():
    """The vectorized scorer against one that goes word by word."""
    model = toxicity.train([(t.encode(), y) for _, t, y in toxic_rows(300)])

    def bucket(gram):
        h = 0
        for k, c in enumerate(gram):
            h = c if k == 0 else (h * 0x9E3779B97F4A7C15 + c + 1) % 2**64
        h ^= h >> 31
        return (h * 0xBF58476D1CE4E5B9) % 2**64 >> 64 - model.bits

    def plain(text):
        w = text.lower().split()
        cuts = list(range(0, len(w), toxicity.WORDS))
        if len(cuts) > 1 and len(w) - cuts[-1] < toxicity.WORDS:
            cuts.pop()
        odds = []
        for a, b in zip(cuts, [*cuts[1:], len(w)]):
            found = [model.table[bucket((" " + x + " ").encode()[k : k + n])] for x in dict.fromkeys(w[a:b]) for n in model.sizes for k in range(len(x.encode()) + 3 - n)]
            z = sum(found, np.zeros(2)) / max(len(found), model.least) + model.bias
            odds.append((z[1] - z[0]) / model.heat)
        worst = sorted(odds, reverse=True)[: toxicity.WORST] or [(model.bias[1] - model.bias[0]) / model.heat]
        return 1 / (1 + np.exp(-(sum(worst) / len(worst) + model.shift)))

    for t in ("", "river", "a quiet snarkzit table", "vexmoot gnashpit river river walks walks green grumblorx morning letter", "río verde snarkzit " * 9):
        assert np.isclose(toxicity.scores(model, [t.encode()])[0], plain(t), rtol=1e-6), t


def test_languages_against_a_plain_version():
    rng = random.Random(3)
    stock = {f"l{k}": ["".join(rng.choice("abcdefghijklmnop"[k : k + 5]) for _ in range(rng.randrange(2, 7))) for _ in range(40)] for k in range(14)}
    for names in (["l0", "l5"], sorted(stock)):  # a table of scores, and embeddings with weights
        who = langid.train([(words(rng, stock[n], 30).encode(), n) for n in names for _ in range(30)])
        m = who.model
        assert (m.out is None) == (len(names) <= langid.WIDTH)
        said = [words(rng, stock[n], 12) for n in names]
        got = langid.text_logits(m, [t.encode() for t in said])
        right = sum(m.classes[int(x.argmax())] == n for x, n in zip(got, names))
        assert right >= len(names) - 1
        for t, x in zip(said[:3], got):
            found = []
            for w in t.split():
                padded = (" " + w + " ").encode()
                for n in m.sizes:
                    for k in range(len(padded) + 1 - n):
                        h = padded[k]
                        for c in padded[k + 1 : k + n]:
                            h = (h * 0x9E3779B97F4A7C15 + c + 1) % 2**64
                        h ^= h >> 31
                        found.append(m.table[(h * 0xBF58476D1CE4E5B9) % 2**64 >> 64 - m.bits])
            mean = sum(found) / len(found)
            assert np.allclose(((mean if m.out is None else mean @ m.out) + m.bias) / m.heat, x, rtol=1e-6)
