"""The seam to text generation: prompts out, replies in, and a table that keeps what was once generated."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T


def describe(title: Column, features: Column, details: Column, path: Column, limit: int = 900) -> Column:
    """A product in a few lines for a prompt: title, six features, eight details, the last three steps of its breadcrumb."""
    pairs = F.transform(F.slice(details, 1, 8), lambda e: F.concat_ws(": ", e.key, e.value))
    last = F.slice(path, F.greatest(F.size(path) - 2, F.lit(1)), F.lit(3))
    return F.substring(F.concat_ws("\n", title, F.array_join(F.slice(features, 1, 6), "; "), F.array_join(pairs, "; "), F.array_join(last, " > ")), 1, limit)


def prompt_key(model: Column, tokens: Column, prompt: Column) -> Column:
    """What a generation is kept under."""
    return F.sha2(F.concat_ws("\0", model, tokens.cast("string"), prompt), 256)


def parse_turns(reply: Column) -> Column:
    """The turns in the first to the last brace of a reply, white space made single, blanks dropped; null if there are none to read."""
    inside = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    turns = F.from_json(inside, "turns array<string>").getField("turns")
    return F.filter(F.transform(turns, lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: t != "")


def wants_expansion(gate: str, done: Column, satisfied: Column) -> Column:
    """Whether to ask the generator: never (none), each turn once (always), or only where nothing satisfies all slots (unsatisfied)."""
    if gate == "none":
        return F.lit(False)
    return ~done if gate == "always" else ~done & (satisfied == 0)


def grounded_terms(replies: DataFrame, informative: DataFrame) -> DataFrame:
    """(qid, term, pos) of replies(qid, text): their distinct terms, in order, that are no stop words and informative(term) in the catalog."""
    toks = replies.select("qid", F.posexplode(F.array_distinct(T.content(T.tokens(F.col("text"))))).alias("pos", "term"))
    return toks.join(informative.select("term"), "term", "left_semi").select("qid", "term", F.col("pos").cast("long").alias("pos"))


def generate(prompts: DataFrame, known: DataFrame | None, call: Callable[[list[str]], list[str | None]] | None) -> DataFrame:
    """(key, reply) for prompts(key, prompt): what known(key, reply) has, else what call says in batches; null where it fails or there is no call."""
    have = prompts.select("key", "prompt").dropDuplicates(["key"])
    have = have.join(known, "key", "left") if known is not None else have.withColumn("reply", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                replies = call(batch["prompt"].tolist()) if call else [None] * len(batch)
            except Exception:  # a failed service is a missing reply, never a failed job
                replies = [None] * len(batch)
            yield pd.DataFrame({"key": batch["key"], "reply": replies})

    asked = have.where("reply is null").select("key", "prompt").mapInPandas(run, "key string, reply string")
    return have.where("reply is not null").select("key", "reply").unionByName(asked)


STYLES = {
    "plain": "Say what you want in your own words, as you would in a shop.",
    "vague": "Stay vague at first, and get to the point only when you are asked.",
    "negation": "Say once what you do not want, and what you want instead.",
    "typo": "Type in a hurry, with a slip or two.",
}


def prompt_for(style: Column, product: Column) -> Column:
    """The request for a probe: somebody who looks for a product, in a style of STYLES, as JSON with two to six turns."""
    how = F.coalesce(F.create_map(*[F.lit(x) for pair in STYLES.items() for x in pair])[style], F.lit(STYLES["plain"]))
    return F.concat(F.lit('You look for this product, but you do not know its name:\n\n'), product, F.lit("\n\n"), how, F.lit('\nAnswer with {"turns": [two to six short messages]} and nothing else.'))


def kept_generations(prompts: DataFrame, path: str, call: Callable[[list[str]], list[str | None]] | None) -> DataFrame:
    """generate() over a table at path that keeps what was once generated: only prompts without a reply there are asked, and their replies are added."""
    spark = prompts.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = "key string, reply string"
    known = spark.read.schema(schema).parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None
    wanted = prompts.select("key", "prompt").dropDuplicates(["key"])
    asked = wanted if known is None else wanted.join(known, "key", "left_anti")
    generate(asked, None, call).where("reply is not null").write.mode("append").parquet(path)
    return wanted.select("key").join(spark.read.schema(schema).parquet(path), "key", "left").select("key", "reply")
