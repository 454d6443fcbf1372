"""Small golden cases of the search engine and its lab."""

import math
import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions import catalog as C
from colloquy.functions import cues, generation
from colloquy.functions import text as T
from colloquy.operators import agent, category, dialogue, evaluate, extract, fuzzy, index, mining, probes, ranking, retrieval, simulate
from colloquy.settings import Settings, variant
from colloquy.sources import readers, writers


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x if names else spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    assert one(spark, T.norm(F.lit(" Été, THE-Cat's "))) == "t the cat s"
    assert one(spark, T.tokens(F.lit("..."))) == [] and one(spark, T.ngrams(T.tokens(F.lit("a b")), 3)) == []
    assert one(spark, T.trigrams(F.lit("cat"))) == ["$ca", "cat", "at$"]
    assert math.isclose(one(spark, T.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))), 1 / 3)
    assert one(spark, T.overlap(T.tokens(F.lit("")), T.tokens(F.lit("a")))) == 0.0
    assert math.isclose(one(spark, T.idf(F.lit(2), F.lit(1))), 0.6931471805599453)


@pytest.mark.parametrize(("typed", "price"), [(None, None), ("", None), ("$1,299.00", 1299.0), ("from 12.99", 12.99), ("10 — 20", 10.0), ("call", None)])
def test_price(spark, typed, price):
    assert one(spark, C.parse_price(F.lit(typed).cast("string"))) == price


def test_cards_and_categories(spark):
    said = F.array(F.lit("cotton"), F.lit("department: womens"))
    card = C.card_slots(said, F.lit("Blue running shoe cotton department womens"), F.lit("49.0"), F.lit("Blue running shoe"))
    assert one(spark, card) == ["cotton", "color: blue", "department: womens", "budget around $49.0"]
    none = F.array().cast("array<string>")
    assert one(spark, C.card_slots(none, F.lit("plain"), F.lit(None).cast("string"), F.lit("A thing"))) == ["A thing"]
    assert one(spark, C.coarse_category(F.array(F.lit("Clothing"), F.lit("Shoes")))) == "Shoes" and one(spark, C.coarse_category(none)) == "clothing item"
    for value, kind in (("under $ 30", "budget"), ("Leather sole", "material"), ("pink", "color"), ("wide", "size"), ("outfit", "style"), ("gym", "use_case"), ("light", "feature")):
        assert one(spark, C.classify_constraint(F.lit(value))) == kind
    assert one(spark, C.clean_constraint(F.lit(" -a  \n b;. "))) == "a b"


def test_index_and_phrases(spark):
    docs = spark.createDataFrame([(1, "red cotton shirt"), (2, "red shirt cotton"), (3, "")], "doc long, text string")
    ix = index.build_index(docs)
    assert {(r.term, r.df) for r in ix.terms.collect()} == {("red", 2), ("cotton", 2), ("shirt", 2)} and ix.size.first().n == 3
    phrases = spark.createDataFrame([("red cotton",), ("cotton shirt",), ("blue",), ("red",)], "phrase string")
    assert {(r.phrase, r.df) for r in index.phrase_frequencies(phrases, docs).collect()} == {("red cotton", 1), ("cotton shirt", 1), ("blue", 0), ("red", 2)}


def test_fusion(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "qid int, doc string, rnk long")
    b = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "qid int, doc string, rnk long")
    got = retrieval.reciprocal_rank_fusion([(a, 0.5), (b, 0.5)]).orderBy("rnk").collect()
    assert [r.doc for r in got] == ["b", "a", "c"] and math.isclose(got[0].score, 0.5 / 62 + 0.5 / 61)


def test_osa():
    assert fuzzy.osa("rainocat", "raincoat", 2) == 1 and fuzzy.osa("hoood", "hood", 1) == 1 and fuzzy.osa("ca", "abc", 3) == 3 and fuzzy.osa("abc", "xyz", 2) is None


def test_repairs(spark):
    df = spark.createDataFrame([("raincoat", 9), ("raincoats", 3), ("hood", 5), ("rare", 1)], "term string, df long")
    said = spark.createDataFrame([(1, "A Rainocat, with hoood!"), (2, ""), (3, "hood 12")], "id long, text string")
    assert {(r.id, r.text) for r in fuzzy.repair_messages(said, df).collect()} == {(1, "A raincoat, with hood!"), (2, ""), (3, "hood 12")}


def test_conjunctive(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red cotton shirt", "red shirt", "blue hat", "green sock", "gold ring", "old map", "new pen"])], "doc long, text string")
    ix = index.build_index(docs)
    slots = spark.createDataFrame([(1, 1, "red"), (1, 2, "cotton")], "qid long, slot long, term string")
    covered = ranking.coverage(slots, ix.tf.select("doc", "term"), ix.terms, ix.size)
    got = {r.doc: (r.total, r.satisfied) for r in ranking.conjunctive(covered, slots).collect()}
    full = math.log(1.02)
    assert math.isclose(got[0][0], 2 * full) and math.isclose(got[1][0], full + math.log(0.02)) and got[0][1] == 1


def brute_mmr(pool, k, lam):
    jac = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    lo, hi = min(t for _, t, _ in pool), max(t for _, t, _ in pool)
    left, out = list(pool), []
    while left and len(out) < k:
        worth = [round(lam * (t - lo) / ((hi - lo) or 1.0) - (1 - lam) * max((jac(s, x[2]) for x in out), default=0.0), 9) for _, t, s in left]
        out.append(left.pop(worth.index(max(worth))))
    return [d for d, _, _ in out]


def test_mmr_and_clusters(spark):
    rng = random.Random(3)
    titles = {d: " ".join(rng.choice("abcdef") for _ in range(4)) for d in range(60)}
    ranked = [(q, d, float(10 - i // 3), i + 1) for q in range(5) for i, d in enumerate(rng.sample(range(60), 35))]
    rows = spark.createDataFrame(ranked, "qid long, doc long, total double, rnk long")
    names = spark.createDataFrame([*titles.items()], "doc long, title string")
    got = {}
    for r in ranking.mmr(rows, names).collect():
        got.setdefault(r.qid, {})[r.rnk] = r.doc
    clusters = {}
    for r in ranking.cluster_round_robin(rows, names).collect():
        clusters.setdefault(r.qid, {})[r.rnk] = r.doc
    for q in range(5):
        pool = [(d, t, {*titles[d].split()}) for x, d, t, k in ranked if x == q and k <= 30]
        assert [got[q][k] for k in sorted(got[q])] == brute_mmr(pool, 10, 0.7)
        groups = []
        for d, _, s in pool:
            for g in groups:
                if len(s & g[0][1]) / len(s | g[0][1]) >= 0.6:
                    g.append((d, s))
                    break
            else:
                groups.append([(d, s)])
        order = [g[i][0] for i in range(30) for g in groups if len(g) > i][:10]
        assert [clusters[q][k] for k in sorted(clusters[q])] == order


def test_resolvers(spark):
    keys = spark.createDataFrame([("red shoes", 5, 0), ("shoes", 9, 1), ("blue hats", 2, 4)], "key string, docs long, first_doc long")
    said = spark.createDataFrame([(1, "I want Red SHOES now"), (2, "some hats"), (3, "nothing")], "qid long, text string")
    assert {(r.qid, r.key) for r in category.by_substring(said, keys).collect()} == {(1, "red shoes")}
    assert {(r.qid, r.key, r.confidence) for r in category.by_overlap(said, keys).collect()} == {(1, "red shoes", 1.0), (2, "blue hats", 0.5)}
    tiers = category.first_of(category.by_substring(said, keys), category.by_overlap(said, keys))
    assert {r.qid for r in tiers.collect()} == {1, 2}


def test_associations(spark):
    titles = spark.createDataFrame([(i, "alpha beta" if i % 2 else "gamma delta") for i in range(20)] + [(99, "alpha delta")], "doc long, title string")
    got = {(r.term, r.other) for r in mining.associations(titles, 5, 0.9, 3).collect()}
    assert got == {("alpha", "beta"), ("beta", "alpha"), ("gamma", "delta"), ("delta", "gamma")}


def test_cues(spark):
    read = lambda t: one(spark, cues.reading(F.lit(t)))
    assert [read(t) for t in ("Never mind, boots", "Actually, ignore my earlier preference.", "I don't have a preference for color; please use your judgment.", "nothing else", "a hat")] == ["reset", "override", "declined", "exhausted", "plain"]
    assert one(spark, cues.attribute(F.lit("no preference for Color"))) == "color"
    assert one(spark, cues.disclosed(F.lit("For that, what matters is: Cotton; Slim fit."))) == ["cotton", "slim fit"]


def test_retractions(spark):
    docs = spark.createDataFrame([(1, "leather boots"), (2, "canvas bag")], "doc long, text string")
    said = spark.createDataFrame([(1, "not leather boots, canvas is better"), (2, "no longer zzz"), (3, "a bag")], "qid long, text string")
    assert [(r.qid, r.phrase) for r in dialogue.retractions(said, docs).collect()] == [(1, "leather boots")]


def test_rarity_cuts():
    df = {"red shoe": 2, "red": 90, "shoe": 80, "big": 99}
    assert extract.rarity_cuts(["red", "shoe", "big"], df, [0.1, 0.2, 0.05], 100) == ["red shoe"]
    assert extract.rarity_cuts([], {}, [], 100) == []


def test_state():
    s = dialogue.State()
    s.hear(1, "plain", "other", [], [], ["red shoe"], "shoes", 0.4)
    s.hear(2, "plain", "other", ["cotton"], [], ["cotton lining", "red"], None)
    assert [x.key for x in s.active] == ["red shoe", "cotton lining"] and (s.category, s.confidence) == ("shoes", 0.4) and s.disclosed == {"cotton"}
    s.hear(3, "override", "other", [], [], ["blue"], None)
    assert [x.key for x in s.active] == ["cotton lining", "blue"] and s.since == 3
    s.hear(4, "plain", "other", [], ["cotton"], [], None)
    assert [x.key for x in s.active] == ["blue"]
    s.hear(5, "exhausted", "other", [], [], [], None)
    assert s.ask() == "feature"
    s.hear(6, "declined", "feature", [], [], [], None)
    assert s.ask() == "material"
    s.hear(7, "reset", "other", [], [], ["hat"], None)
    assert [x.key for x in s.active] == ["hat"] and s.category is None and s.since == 7
    assert dialogue.should_emit(1, 3, 0) and not dialogue.should_emit(4, 1, 6) and dialogue.should_emit(5, 1, 6)
    for mode, left in (("erase", ["blue"]), ("keep", ["red", "wool", "blue"]), ("scoped", ["wool", "blue"])):
        s = dialogue.State(mode)
        for turn, kind, span in ((1, "plain", "red"), (2, "plain", "wool"), (3, "override", "blue")):
            s.hear(turn, kind, "other", [], [], [span], None)
        assert [x.key for x in s.active] == left


def test_wording():
    say = dialogue.wording
    assert say([], None, 1, "plain", [], None, 0) == dialogue.LINES["closing"][1]
    assert say([], None, 2, "plain", [], "other", 0) == dialogue.LINES["blank"][0]
    assert say(["red shoe"], "shoes", 2, "plain", ["red shoe"], "color", 7) == "So red shoe. 7 products are left. Which color do you have in mind?"
    assert say(["red"], "red", 2, "plain", ["red"], "other", 7) == dialogue.LINES["stuck"][0]
    assert say(["blue"], None, 3, "override", ["blue"], "other", 99) == "All right, blue instead. What else should I know?"
    assert dialogue.brief(["a b c d e f g", "h", "i"]) == "a b c d e f… and h"


def test_settings():
    s = Settings()
    assert s.told("head=50, resets=off,margin=0.7") == s.replaced(head=50, resets=False, margin=0.7) and s.told("") == s
    assert variant("small:head=5")[0] == "small" and variant("head=5") == ("head=5", s.replaced(head=5))
    for bad, error in (("heads=5", KeyError), ("head", ValueError), ("head=x", ValueError), ("resets=maybe", ValueError), ("gate=open", ValueError)):
        with pytest.raises(error):
            s.told(bad)
    with pytest.raises(TypeError):
        s.replaced(head="5")


def test_reading_of_messages(spark):
    """Golden rows of what is read, and of the state that is folded from it."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red canvas shoe with rubber sole", "blue canvas bag", "leather boots with rubber sole", "wool hat", "green sock", "silver ring", "oak table", "tin drum"])], "doc long, text string")
    rows = [(1, 1, "I'm looking for a bag. A key requirement is: blue canvas; rubber sole."), (1, 2, "not leather boots, canvas is better"), (1, 3, "Actually, ignore my earlier preference. What I need is: wool hat."), (2, 1, "silver ring"), (2, 2, "no preference for color"), (2, 3, "start over, a tin drum please"), (3, 1, None), (3, 2, "rubber sole plus oak table")]
    keys = spark.createDataFrame([(1, 1, "bag", 1.0)], "sid long, turn int, key string, confidence double")
    read = dialogue.read_messages(spark.createDataFrame(rows, "sid long, turn int, text string"), docs, keys).cache()
    got = {(r.sid, r.turn): r for r in read.collect()}
    assert [got[k].kind for k in sorted(got)] == ["plain", "plain", "override", "plain", "declined", "reset", "plain", "plain"]
    assert got[1, 1].disclosed == ["blue canvas", "rubber sole"] and got[1, 1].spans[0] == "bag" and {"blue canvas", "rubber sole"} <= set(got[1, 1].spans)
    assert got[1, 2].retractions == ["leather boots"] and got[1, 2].spans == ["canvas"]
    assert got[1, 3].spans == ["wool hat"] and got[2, 1].spans == ["silver ring"] and got[2, 2].attribute == "color" and got[2, 3].spans == ["tin drum"]
    assert got[3, 1].spans == [] and sorted(got[3, 2].spans) == ["oak table", "rubber sole"]
    state = {(r.sid, r.turn): r for r in dialogue.fold(read).collect()}
    assert state[1, 3].category == "bag" and "wool hat" in state[1, 3].active and state[2, 3].active == ["tin drum"] and state[2, 3].since == 3
    said = {(r.sid, r.turn): r for r in dialogue.responses(dialogue.fold(read)).collect()}
    assert said[1, 1].emit and not said[2, 1].emit and said[2, 3].ask == "other"


SHOP = [(0, "red canvas shoe rubber sole", "shoes", 5.0), (1, "blue canvas shoe rubber sole", "shoes", 9.0), (2, "red leather boot", "boots", 1.0), (3, "wool hat", "hats", 2.0), (4, "green sock", "socks", 3.0), (5, "silver ring", "rings", 4.0), (6, "oak table", "tables", 4.0), (7, "tin drum", "drums", 4.0), (8, "blue wool hat", "hats", 8.0)]


def small_shop(spark):
    rows = [(d, t, c, [t.split()[0], "material: " + t.split()[1]], r, 4.0, 10.0) for d, t, c, r in SHOP]
    return spark.createDataFrame(rows, "doc long, text string, category string, card array<string>, ratings double, average double, price double")


@pytest.mark.parametrize("changes", ["", "retrieval=auto,resolver=ensemble,segmentation=rarity,repair_typos=yes", "retrieval=fused,resolver=classifier,gate=margin", "templates=no,segmentation=none,retractions=no,demote_shown=no,card_signature=no"])
def test_agent(spark, changes):
    a = agent.Agent(small_shop(spark), Settings().told(changes).replaced(gate="always") if "gate" not in changes else Settings().told(changes))
    first = spark.createDataFrame([("a", 1, "I'm looking for shoes. A key requirement is: red canvas."), ("b", 1, "a wool hat"), ("c", 1, "xyzzy")], "sid string, turn int, message string")
    shown, replies = a(first, 1)
    got = {(r.sid, r.rnk): r.doc for r in shown.collect()}
    said = {r.sid: r for r in replies.collect()}
    assert set(said) == {"a", "b", "c"} and all(r.message and r.ask == "other" for r in said.values())
    if "margin" not in changes:
        assert got["a", 1] == 0 and got["b", 1] in (3, 8) and not [k for k in got if k[0] == "c"]
    again = first.unionByName(spark.createDataFrame([("a", 2, "On second thought, I would like blue"), ("b", 2, "no preference for color"), ("c", 2, "silver ring")], "sid string, turn int, message string"))
    shown, _ = a(again, 2)
    got = {(r.sid, r.rnk): r.doc for r in shown.collect()}
    if "margin" not in changes:
        assert got["a", 1] == 1 and got["c", 1] == 5
        assert "demote_shown=no" in changes or {got["b", 1], got["b", 2]} == {3, 8}


def test_agent_finds_what_is_looked_for(spark):
    catalog = small_shop(spark)
    samples = catalog.select(F.concat(F.lit("s"), "doc").alias("sample_id"), F.lit("buying").alias("scenario_type"), F.col("doc").alias("target"), "category", F.array("text").alias("card"))
    r = evaluate.summary(simulate.run(samples, agent.Agent(catalog)).cache()).first()
    assert r.hit_rate == 1.0 and r.mrr > 0.9 and r.composite > 0.9


def test_sessions_of_the_simulator(spark):
    rows = [("a", "buying", 1, "shoes", ["red", "wool", "soft"]), ("b", "intent_override", 2, "hats", ["blue", "thin"]), ("c", "boundary", 3, "bags", ["big"]), ("d", "browsing", 9, "pens", ["ink"])]
    samples = spark.createDataFrame(rows, "sample_id string, scenario_type string, target long, category string, card array<string>")
    heard = []

    def agent(said, turn):
        heard.extend((r.sid.split(":")[1], r.turn, r.message) for r in said.where(F.col("turn") == turn).collect())
        ranked = samples.where("target < 9" if turn > 1 else "sample_id = 'b'").select(F.concat(F.lit("L0:"), "sample_id").alias("sid"), F.col("target").alias("doc"), F.lit(2 if turn > 1 else 1).cast("long").alias("rnk"))
        return ranked, said.select("sid").distinct().withColumn("ask", F.lit("other"))

    got = {r.sample_id: (r.hit, r.first_hit_turn, r.reciprocal_rank) for r in simulate.run(samples, agent, turns=5).collect()}
    over = simulate.hidden(samples).where("sample_id = 'b'").first().over_turn
    assert got == {"a": (True, 2, 0.5), "b": (True, over, 0.5), "c": (True, 2, 0.5), "d": (False, None, 0.0)}
    said = {(s, t): m for s, t, m in heard}
    assert said["a", 1] == "I'm looking for shoes. A key requirement is: red." and said["a", 2] == "For that, what matters is: wool; soft."
    assert said["b", over] == "Actually, ignore my earlier preference. What I need is: blue."
    assert said["c", 2] == "I don't have a preference for other; please use your judgment." and said["d", 3] == "I don't have an additional preference for other."


def test_measures(spark):
    two = spark.createDataFrame([(True, 0.5, 2), (False, 0.0, None)], "hit boolean, reciprocal_rank double, first_hit_turn int")
    r = evaluate.summary(two).first()
    assert (r.sessions, r.hit_rate, r.mrr, r.mttc) == (2, 0.5, 0.25, 6.5)
    assert evaluate.summary(two.limit(0)).first().mttc is None
    said = spark.createDataFrame([(1, i, x) for i, x in enumerate(["A", "bad", "A", " B", "C"])], "sid long, pos int, item string")
    known = spark.createDataFrame([("A",), ("B",), ("C",)], "item string")
    assert [r.item for r in evaluate.valid_recommendations(said, known).orderBy("rnk").collect()] == ["A", "B", "C"]
    values = spark.createDataFrame([(i, i % 3 / 2, i % 3 / 2) for i in range(30)], "idx long, a double, b double")
    same = evaluate.paired_bootstrap(values, 50).first()
    assert (same.delta, same.lo, same.hi, same.p_positive) == (0, 0, 0, 0)
    low, high = evaluate.wilson(F.lit(0), F.lit(0))
    assert (one(spark, low), one(spark, high)) == (0.0, 0.0)
    assert tuple(evaluate.mirror(known, known.where("item <> 'A'")).first()) == (1, 0, 2)


def test_sources_and_sinks(spark, tmp_path):
    path = str(tmp_path / "catalog.jsonl")
    with open(path, "w") as f:
        f.write('{"parent_asin":"A","title":"Blue running shoe","features":["cotton"],"details":{"department":"womens"},"categories":["Clothing","Shoes"],"price":49.0}\n\n{"parent_asin":"B","title":null,"price":"from 3"}\n')
    rows = {r.parent_asin: r for r in readers.read_catalog(spark, path).collect()}
    assert rows["A"].card == ["cotton", "color: blue", "department: womens", "budget around $49.0"] and rows["A"].category == "Shoes" and rows["B"].price == 3.0
    probes = str(tmp_path / "probes.jsonl")
    with open(probes, "w") as f:
        f.write('{"_meta":"head"}\n{"id":"p","target":"A","turns":["x"],"tags":["vague"]}\n')
    some, meta = readers.read_probes(spark, probes)
    assert some.count() == 1 and meta.first()[0] == "head"
    assert readers.read_optional(spark, "asin string", str(tmp_path / "no.jsonl.gz"), str(tmp_path / "no.jsonl")) is None
    out = str(tmp_path / "out")
    ids = spark.createDataFrame([(1,), (2,)], "k long")
    assert writers.append_missing(ids, out, "k") == 2 and writers.append_missing(ids.union(spark.createDataFrame([(3,)], "k long")), out, "k") == 3
    assert readers.vector_fingerprint(["a", "b"]) != readers.vector_fingerprint(["b", "a"])


def test_probe_guards(spark):
    product, title = "red canvas shoe with a rubber sole for long walks in light rain", "red canvas shoe with"
    rows = [
        (1, None, "plain", "unparseable"), (2, ["I would go for red shoes"], "plain", "turn_count"), (3, ["rubber", "something that is red please"], "plain", "turn_length"),
        (4, ["something for walking on wet grass", "something for walking on wet grass"], "plain", "restates"), (5, ["footwear that is red", "something to wear outside"], "negation", "no_negation"),
        (6, ["red canvas shoe", "rubber sole, light rain"], "plain", "copied"), (7, ["a kettle please", "made of steel"], "plain", "off_target"),
        (8, ["a red canvas shoe with laces maybe blue", "casual footwear sporty summer beach everyday"], "plain", "title_ngram"), (9, ["footwear that isn't heavy, without laces", "something red to wear outside"], "negation", None),
    ]
    df = spark.createDataFrame([(i, t, s, title, product) for i, t, s, _ in rows], "id long, turns array<string>, style string, title string, product string")
    assert {r.id: r.reason for r in probes.guarded(df).collect()} == {i: why for i, _, _, why in rows}
    counts = probes.report(probes.guarded(df).withColumn("tokens", F.lit(5)).withColumn("latency", F.col("id").cast("double")))
    assert {r.reason: (r.n, r.tokens, r.median_latency) for r in counts.collect()}["ok"] == (1, 5, 9.0)


def test_sheets(spark, tmp_path):
    drawn = spark.createDataFrame([(f"p{i}", "ab"[i > 2], ["x", "y"], i % 3) for i in range(12)], "id string, tag string, turns array<string>, target long")
    goods = spark.createDataFrame([(0, "zero", "t" * 900), (1, "one", "short")], "doc long, title string, text string")
    got = probes.sheet(drawn, goods, 6).collect()
    assert len(got) == 6 and sorted(r.tag for r in got) == ["a"] * 3 + ["b"] * 3 and all(r.phrasing == r.note == "" and len(r.target_text or "") <= 400 for r in got)
    writers.write_sheet(probes.sheet(drawn, goods, 6), "seed 7", f"{tmp_path}/sheet")
    assert spark.read.json(f"{tmp_path}/sheet").count() == 6 and spark.read.json(f"{tmp_path}/sheet_meta").first()[0] == "seed 7"
    filled = spark.createDataFrame([("Yes", "y", "y"), ("y", "n", "y"), ("", None, "y"), ("no", "y", "")], "phrasing string, target_ok string, tag_ok string")
    rates = {r.axis: (r.agreed, r.judged, r.rate) for r in probes.agreement(filled).collect()}
    assert rates == {"phrasing": (2, 3, 0.666667), "target_ok": (2, 3, 0.666667), "tag_ok": (3, 3, 1.0), "all": (1, 2, 0.5)}
    assert {r.rate for r in probes.agreement(filled.limit(0)).collect()} == {0.0}


def test_ensemble_takes_both(spark):
    a = spark.createDataFrame([(1, "x", 0.6), (2, "x", 0.5), (3, "y", 0.4)], "qid long, key string, confidence double")
    b = spark.createDataFrame([(1, "y", 0.7), (2, "x", 0.9), (4, "z", 0.2)], "qid long, key string, confidence double")
    assert {tuple(r) for r in category.by_ensemble(a, b).collect()} == {(1, "y", 0.7, "x"), (2, "x", 0.9, None), (3, "y", 0.4, None), (4, "z", 0.2, None)}


def test_numbers_and_blocks(spark):
    rows = spark.createDataFrame([(x,) for x in random.Random(2).sample(range(10_000), 500)], "k long").repartition(7)
    assert [r.idx for r in evaluate.numbered(rows, "k").orderBy("k").collect()] == list(range(500))
    rng = random.Random(4)
    vectors = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(6)]) for i in range(300)]
    v = spark.createDataFrame(vectors + [(999, None)], "doc long, vector array<float>")
    got = {(r.qid, r.rnk): r.doc for r in retrieval.cosine(v.where("doc % 20 = 0").withColumnRenamed("doc", "qid"), v, 5).collect()}
    for q, x in vectors[::20]:
        best = sorted(vectors, key=lambda d: (-sum(a * b for a, b in zip(x, d[1])), d[0]))[:5]
        assert [got[q, k] for k in range(1, 6)] == [d for d, _ in best]


def test_models_and_vectors(spark, tmp_path):
    import gzip
    import json

    with gzip.open(tmp_path / "assoc.json.gz", "wt") as f:
        json.dump({"red": [["wine", 2.5], ["rose", 1.0]], "hat": []}, f)
    assert {tuple(r) for r in readers.read_associations(spark, f"{tmp_path}/assoc.json.gz").collect()} == {("red", "wine", 2.5, 1), ("red", "rose", 1.0, 2)}
    with gzip.open(tmp_path / "clf.json.gz", "wt") as f:
        json.dump({"lo": 3, "hi": 5, "classes": ["a", "b"], "intercept": [0.5, -1], "postings": {" re": [[1, 0.25], [0, 2]]}}, f)
    weights, intercepts, lo, hi = readers.read_classifier(spark, f"{tmp_path}/clf.json.gz")
    assert (lo, hi) == (3, 5) and {tuple(r) for r in weights.collect()} == {(" re", "b", 0.25), (" re", "a", 2.0)} and {tuple(r) for r in intercepts.collect()} == {("a", 0.5), ("b", -1.0)}
    catalog = spark.createDataFrame([(f"p{i}",) for i in range(5)], "doc string")
    good = readers.vector_fingerprint([f"p{i}" for i in range(5)])
    assert readers.guarded_vectors(catalog, catalog, good) is catalog
    with pytest.raises(ValueError):
        readers.guarded_vectors(catalog, catalog.where("doc <> 'p2'"), good)


def test_kept_generations(spark, tmp_path):
    path = f"{tmp_path}/kept"
    prompts = spark.createDataFrame([("a", "x"), ("b", "yy"), ("a", "x")], "key string, prompt string")
    first = generation.kept_generations(prompts, path, lambda p: [None if x == "yy" else x.upper() for x in p])
    assert {tuple(r) for r in first.collect()} == {("a", "X"), ("b", None)}
    again = generation.kept_generations(prompts, path, lambda p: ["new " + x for x in p])
    assert {tuple(r) for r in again.collect()} == {("a", "X"), ("b", "new yy")}
    assert "slip" in one(spark, generation.prompt_for(F.lit("typo"), F.lit("a hat"))) and "own words" in one(spark, generation.prompt_for(F.lit("?"), F.lit("a hat")))


def test_small_things(spark):
    assert one(spark, T.folded(F.lit("Élan naïve Łódź"))) == "Elan naive Łodz"
    assert one(spark, ranking.with_affinity(F.lit(5.0), F.lit(3.5), F.lit(4.0))) == 4.5 and one(spark, ranking.with_affinity(F.lit(5.0), F.lit(3.5), F.lit(None).cast("double"))) == 5.0
    two = spark.createDataFrame([(True, 1 / 3, 2), (False, 0.0, None), (True, 1 / 7, 4)], "hit boolean, reciprocal_rank double, first_hit_turn int")
    assert math.isclose(evaluate.exact_composite(two).first().composite, 0.5 * 2 / 3 + 0.3 * (1 / 3 + 1 / 7) / 3 + 0.2 * (11 - 17 / 3) / 10)
