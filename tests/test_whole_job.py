"""Registered queries work on all that they are given."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators import category
from colloquy.plans import engine, lab, more

FOLDER = "/root/testdata/sf0.001"


def test_lsa_keeps_rare_terms(spark, tmp_path):
    docs = [(i, " ".join(f"often{(i * 10 + k) % 600}" for k in range(100))) for i in range(60)] + [(100 + i, "often1 often2 zebra quagga okapi") for i in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "zebra quagga okapi")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = engine.QUERIES["lsa_topk"](spark, str(tmp_path)).where("rnk <= 3").collect()
    assert {r.doc for r in got} == {100, 101, 102} and min(r.score for r in got) > 0.5


def late_agent(catalog):
    """Finds every target on the ninth turn."""

    def respond(said, turn):
        who = said.select("sid").distinct()
        return who.where(F.lit(turn == 9)).select("sid", F.expr("cast(regexp_extract(sid, 's([0-9]+)$', 1) as bigint)").alias("doc"), F.lit(1).cast("long").alias("rnk")), who.withColumn("ask", F.lit("other"))

    return respond


def test_sessions_have_all_turns_levels_and_stated_products(spark, monkeypatch):
    monkeypatch.setattr(lab, "the_agent", late_agent)
    monkeypatch.setattr(more, "the_agent", late_agent)
    stated = spark.read.parquet(f"{FOLDER}/part.parquet").where("p_partkey % 20 = 0").count()
    got = engine.QUERIES["simulated_sessions"](spark, FOLDER).collect()
    assert len(got) == stated and {r.first_hit_turn for r in got} == {9}
    rows = engine.QUERIES["perturb_sweep"](spark, FOLDER).collect()
    assert {(r.level, r.sessions, r.hit_rate, r.mttc) for r in rows} == {(x, stated, 1.0, 9.0) for x in ("L0", "L1", "L2", "L4")}


@pytest.mark.parametrize("words", [3, 14])
def test_substring_matches_keys_of_every_length(spark, words):
    keys = spark.createDataFrame([(" ".join(f"w{k}" for k in range(n)), 1, n) for n in range(1, 16)], "key string, docs long, first_doc long")
    said = spark.createDataFrame([(1, " ".join(f"W{k}" for k in range(words)))], "qid long, text string")
    assert [len(r.key.split()) for r in category.by_substring(said, keys).collect()] == [words]
