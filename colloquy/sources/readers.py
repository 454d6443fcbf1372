"""Sources: catalogs, samples, probes, generated questions, models and vectors, as typed tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..operators.evaluate import numbered

PRODUCT = (
    "parent_asin string, title string, features array<string>, details map<string,string>, description array<string>, categories array<string>, "
    "store string, average_rating double, rating_number int, price string"
)
SAMPLE = (
    "sample_id string, scenario_type string, user_profile struct<purchase_frequency:string,average_prior_rating:double,rating_style:string,preference_tags:array<string>,summary:string>, "
    "ground_truth struct<parent_asin:string>, intent_card struct<target_category:string,hard_constraints:array<string>,soft_preferences:array<string>>, "
    "behavior struct<scenario_type:string,override:struct<turn:int,old_value:string,new_value:string,message:string>>"
)
PROBE = "id string, target string, turns array<string>, tags array<string>, overlap double"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Products from JSON lines (blank ones are skipped) or Parquet, with what ranking needs; the document id is the product's own."""
    raw = spark.read.schema(PRODUCT).parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(PRODUCT).json(path)
    raw = raw.where("parent_asin is not null")
    pairs = F.coalesce(F.map_entries("details"), F.array())
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    text = C.searchable(F.col("title"), listed("features"), C.flatten_pairs(pairs), listed("description"), listed("categories"), F.col("store"))
    said = F.filter(F.transform(pairs, lambda e: F.when(e.value != "", F.concat(e.key, F.lit(": "), e.value))), lambda x: x.isNotNull())
    candidates = F.concat(F.filter(listed("features"), lambda x: x != ""), said)
    return raw.select(
        "parent_asin", "title", text.alias("text"), C.coarse_category(listed("categories")).alias("category"), listed("categories").alias("path"),
        C.card_slots(candidates, text, F.col("price"), F.coalesce("title", F.lit(""))).alias("card"), C.parse_price(F.col("price")).cast("float").alias("price"),
        F.coalesce("rating_number", F.lit(0)).alias("ratings"), F.coalesce("average_rating", F.lit(0.0)).cast("float").alias("average"),
    )


def probe_products(catalog: DataFrame) -> DataFrame:
    """Raw products worth probing: two features or two details at least, and a title."""
    enough = (F.coalesce(F.size("features"), F.lit(0)) >= 2) | (F.coalesce(F.size("details"), F.lit(0)) >= 2)
    return catalog.where(enough & (F.trim(F.coalesce("title", F.lit(""))) != ""))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE).json(path).where("sample_id is not null")


def read_probes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(probes, meta) of JSON lines with an optional head row that has _meta."""
    rows = spark.read.schema(PROBE + ", _meta string").json(path)
    return rows.where("_meta is null and id is not null").drop("_meta"), rows.where("_meta is not null").select("_meta")


def read_optional(spark: SparkSession, schema: str, *paths: str) -> DataFrame | None:
    """JSON lines at the first path that exists and has rows, packed or not; None turns the feature off."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p) and not (rows := spark.read.schema(schema).json(path)).isEmpty():
            return rows
    return None


def read_associations(spark: SparkSession, path: str) -> DataFrame:
    """(term, other, ppmi, rnk) of a JSON file, packed or not, that maps each term to its neighbours [other, ppmi], closest first."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<array<string>>>")).alias("term", "near"))
    each = whole.select("term", F.posexplode("near").alias("pos", "n"))
    return each.select("term", F.element_at("n", 1).alias("other"), F.element_at("n", 2).cast("double").alias("ppmi"), (F.col("pos") + 1).cast("long").alias("rnk"))


CLASSIFIER = "lo int, hi int, classes array<string>, intercept array<double>, postings map<string,array<array<double>>>"


def read_classifier(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int, int]:
    """((gram, key, w), (key, intercept), lo, hi) of a JSON file, packed or not: classes, their intercepts, and for each n-gram of lo to hi characters [class number, weight]."""
    model = spark.read.text(path, wholetext=True).select(F.from_json("value", CLASSIFIER).alias("m")).select("m.*")
    lo, hi = model.select("lo", "hi").first()
    weights = model.select("classes", F.explode("postings").alias("gram", "rows")).select("classes", "gram", F.explode("rows").alias("r"))
    weights = weights.select("gram", F.element_at("classes", (F.element_at("r", 1) + 1).cast("int")).alias("key"), F.element_at("r", 2).alias("w"))
    intercepts = model.select(F.explode(F.arrays_zip("classes", "intercept")).alias("c")).select(F.col("c.classes").alias("key"), F.col("c.intercept").alias("intercept"))
    return weights, intercepts, lo, hi


def guarded_vectors(vectors: DataFrame, catalog: DataFrame, fingerprint: str) -> DataFrame:
    """vectors(doc, …), if catalog(doc) still is the one that they were made of; else ValueError. The documents are taken in their order."""
    rows = numbered(catalog.select("doc"), "doc")
    n = rows.count()
    three = {r.idx: str(r.doc) for r in rows.where(F.col("idx").isin(0, n // 2, n - 1)).collect()}
    found = _fingerprint(n, [three[k] for k in (0, n // 2, n - 1)] if n else [])
    if found != fingerprint:
        raise ValueError(f"the vectors are of other documents: {fingerprint} is not {found}")
    return vectors


def _fingerprint(n: int, three: list[str]) -> str:
    return hashlib.sha256("\0".join([str(n), *three]).encode()).hexdigest()[:16]


def vector_fingerprint(ids: list[str]) -> str:
    """Of a vector table's documents: from how many there are, the first, the middle and the last."""
    return _fingerprint(len(ids), [ids[0], ids[len(ids) // 2], ids[-1]] if ids else [])
