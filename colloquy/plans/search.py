"""Queries of the search side: index statistics, retrieval, fuzzy repair, categories, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import category, fuzzy, index, mining, ranking, retrieval
from ..sources.scratch import materialized
from .registry import query, read

STOP = ", ".join(f"'{w}'" for w in T.STOP)


def N(x: str) -> str:  # noqa: N802
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def TOKS(x: str) -> str:  # noqa: N802
    return f"list_filter(string_split({N(x)}, ' '), lambda t: t <> '')"


INDEX = f"""docs AS (SELECT doc_id AS doc, coalesce(text, '') AS text FROM documents),
 dtoks AS (SELECT doc, {TOKS('text')} AS toks FROM docs),
 tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(toks) AS term FROM dtoks) GROUP BY doc, term),
 dls AS (SELECT doc, len(toks) AS dl FROM dtoks),
 size AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls),
 terms AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), size),
 queries AS (SELECT item_id AS qid, text FROM benchmark),
 qterms AS (SELECT DISTINCT qid, term, 1.0::DOUBLE AS weight FROM (SELECT qid, unnest({TOKS('text')}) AS term FROM queries))"""


def SCORED(terms: str) -> str:  # noqa: N802
    return f"""(SELECT qid, tf.doc, sum(weight * idf * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
   FROM {terms} JOIN terms USING (term) JOIN tf USING (term) JOIN dls ON dls.doc = tf.doc, size
   WHERE weight > 0 AND df <= n * 0.35 GROUP BY qid, tf.doc)"""


def TOP(rows: str, k: int) -> str:  # noqa: N802
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rnk FROM {rows}) WHERE rnk <= {k})"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))


def passages(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), "text")


def indexed(spark: SparkSession, folder: str, asked: DataFrame | None = None) -> index.Index:
    """The index of all documents, or of what asked(qid, text) needs of it."""
    return index.build_index(documents(spark, folder), wanted=None if asked is None else retrieval.query_terms(asked))


def shown(rows: DataFrame, *names: str) -> DataFrame:
    """The result columns: the score to 6 places."""
    return rows.select(*[F.round(c, 6).alias(c) if c in ("score", "total", "idf", "mass", "idf_total", "confidence", "w", "prior") else F.col(c) for c in names])


@query(f"SELECT doc_id, {N('text')} AS normal, len({TOKS('text')}) AS n_tokens FROM documents")
def text_normalize_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "documents").select("doc_id", T.norm(F.col("text")).alias("normal"))
    return rows.select("doc_id", "normal", F.size(T.tokens_of(F.col("normal"))).cast("long").alias("n_tokens"))


@query(f"WITH {INDEX} SELECT term, sum(tf)::BIGINT AS occurrences, count(*) AS df FROM tf GROUP BY term")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return indexed(spark, folder).tf.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("df"))


@query(f"WITH {INDEX} SELECT doc AS doc_id, dl::BIGINT AS dl FROM dls")
def doc_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return indexed(spark, folder).lengths.select(F.col("doc").alias("doc_id"), "dl")


@query(f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM terms")
def term_df_idf(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    size = docs.agg(F.count("*").alias("n"))
    return index.document_frequencies(docs).join(F.broadcast(size), F.lit(True)).select("term", "df", F.round(T.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM terms, size WHERE df > 0 AND df <= n * 0.35 AND term NOT IN ({STOP}) AND len(term) >= 2 AND idf >= 1.0")
def informative_terms(spark: SparkSession, folder: str) -> DataFrame:
    ix = indexed(spark, folder)
    return shown(index.salient(ix.terms, ix.size), "term", "df", "idf")


PHRASES = f"""phrases AS (SELECT DISTINCT phrase FROM (SELECT unnest(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' '))) AS phrase
   FROM (SELECT {TOKS('text')} AS t FROM benchmark)) WHERE phrase <> '')"""


@query(f"WITH {INDEX}, {PHRASES} SELECT phrase, count(doc) AS df FROM phrases LEFT JOIN (SELECT doc, ' ' || {N('text')} || ' ' AS p FROM docs) ON contains(p, ' ' || phrase || ' ') GROUP BY phrase")
def phrase_df_rarest_first(spark: SparkSession, folder: str) -> DataFrame:
    phrases = passages(spark, folder).select(F.explode(T.ngrams(T.tokens(F.col("text")), 3)).alias("phrase"))
    return index.phrase_frequencies(phrases, documents(spark, folder))


@query(f"WITH {INDEX} SELECT qid, doc, round(score, 6) AS score, rnk FROM {TOP(SCORED('qterms'), 10)}")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    asked = passages(spark, folder)
    return shown(retrieval.bm25(asked, indexed(spark, folder, asked)), "qid", "doc", "score", "rnk")


@query(f"WITH {INDEX}, weighted AS (SELECT qid, term, 1.0 / len(term) - 0.1 AS weight FROM qterms) SELECT qid, doc, round(score, 6) AS score, rnk FROM {TOP(SCORED('weighted'), 10)}")
def bm25_weighted_terms(spark: SparkSession, folder: str) -> DataFrame:
    terms = retrieval.query_terms(passages(spark, folder)).withColumn("weight", F.lit(1.0) / F.length("term") - F.lit(0.1))
    return shown(retrieval.best_terms(terms, indexed(spark, folder, passages(spark, folder)), 10), "qid", "doc", "score", "rnk")


RM3 = f"""first AS (SELECT * FROM {TOP(SCORED('qterms'), 10)}),
 mass AS (SELECT qid, doc, score / sum(score) OVER (PARTITION BY qid) AS share FROM first),
 grown AS (SELECT qid, term, sum(share * tf / dl) AS w FROM mass JOIN tf USING (doc) JOIN dls USING (doc) GROUP BY qid, term),
 useful AS (SELECT grown.* FROM grown JOIN terms USING (term), size WHERE df <= n * 0.35 AND term NOT IN ({STOP}) AND NOT EXISTS (SELECT 1 FROM qterms q WHERE q.qid = grown.qid AND q.term = grown.term)),
 kept AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(w, 12) DESC, term) AS r FROM useful),
 weighted AS (SELECT qid, term, 0.6::DOUBLE AS weight FROM qterms UNION ALL SELECT qid, term, 0.4 * w / max(w) OVER (PARTITION BY qid) FROM kept WHERE r <= 20)"""


@query(f"WITH {INDEX}, {RM3} SELECT qid, doc, round(score, 6) AS score, rnk FROM {TOP(SCORED('weighted'), 10)}")
def bm25_rm3(spark: SparkSession, folder: str) -> DataFrame:
    return shown(retrieval.rm3(passages(spark, folder), indexed(spark, folder)), "qid", "doc", "score", "rnk")


FIRST_LINE = f"{TOKS('string_split(text, chr(10))[1]')}"
ASSOC = f"""titles AS (SELECT doc, list_distinct(list_filter({FIRST_LINE}, lambda t: t NOT IN ({STOP}) AND len(t) >= 3)) AS toks FROM docs),
 tdf AS (SELECT term, count(*) AS df FROM (SELECT unnest(toks) AS term FROM titles) GROUP BY term),
 vocab AS (SELECT term, df FROM tdf, size WHERE df >= 20 AND df <= n * 0.05),
 mass AS (SELECT sum(df)::DOUBLE AS t FROM vocab),
 tt AS (SELECT doc, term FROM (SELECT doc, unnest(toks) AS term FROM titles) JOIN vocab USING (term)),
 okdocs AS (SELECT doc FROM tt GROUP BY doc HAVING count(*) BETWEEN 2 AND 40),
 pairs AS (SELECT a.term AS term, b.term AS other, count(*) AS c FROM tt a JOIN tt b ON a.doc = b.doc AND a.term <> b.term WHERE a.doc IN (SELECT doc FROM okdocs) GROUP BY ALL HAVING count(*) >= 8),
 ppmi AS (SELECT term, other, ln(c * t / (x.df * y.df)) AS p FROM pairs JOIN vocab x USING (term) JOIN vocab y ON y.term = other, mass),
 assoc AS (SELECT term, other, round(p, 3) AS ppmi, rnk FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY round(p, 9) DESC, other DESC) AS rnk FROM ppmi WHERE round(p, 9) > 0) WHERE rnk <= 12)"""


def titles_of(docs: DataFrame) -> DataFrame:
    """(doc, title): the first line of each text, which stands for a title."""
    return docs.select("doc", T.norm(F.substring_index("text", "\n", 1)).alias("title"))


@query(f"WITH {INDEX}, {ASSOC} SELECT * FROM assoc")
def ppmi_associations(spark: SparkSession, folder: str) -> DataFrame:
    return mining.associations(titles_of(documents(spark, folder)))


@query(f"""WITH {INDEX}, {ASSOC},
 near AS (SELECT qid, other, 0.35 * ppmi / max(ppmi) OVER (PARTITION BY qid) AS w FROM qterms JOIN assoc USING (term) WHERE rnk <= 4 AND NOT EXISTS (SELECT 1 FROM qterms q WHERE q.qid = qterms.qid AND q.term = other)),
 weighted AS (SELECT * FROM qterms UNION ALL SELECT qid, other, max(w) FROM near GROUP BY qid, other)
 SELECT qid, doc, round(score, 6) AS score, rnk FROM {TOP(SCORED('weighted'), 10)}""")
def bm25_assoc_expand(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    terms = materialized(retrieval.associated_terms(passages(spark, folder), mining.associations(titles_of(docs))), "terms")
    return shown(retrieval.best_terms(terms, index.build_index(docs, wanted=terms), 10), "qid", "doc", "score", "rnk")


D2Q = INDEX.replace("coalesce(text, '') AS text FROM documents", "string_split(text, chr(10))[1] AS text FROM documents WHERE contains(text, chr(10))").replace("SELECT count(*) AS n, avg(dl)", "SELECT (SELECT count(*) FROM documents) AS n, avg(dl)")


@query(f"""WITH lexical AS (WITH {INDEX} SELECT qid, doc, rnk FROM {TOP(SCORED('qterms'), 200)}),
 asked AS (WITH {D2Q} SELECT qid, doc, rnk FROM {TOP(SCORED('qterms'), 200)}),
 points AS (SELECT qid, doc, sum(0.5 / (60 + rnk)) AS score FROM (SELECT * FROM lexical UNION ALL SELECT * FROM asked) GROUP BY qid, doc)
 SELECT qid, doc, round(score, 6) AS score, rnk FROM {TOP('points', 10)}""")
def bm25_doc2query_fused(spark: SparkSession, folder: str) -> DataFrame:
    """A second corpus stands in for generated questions: the titles (first lines) of documents that have more lines. Its N is that of all documents."""
    docs, asked = documents(spark, folder), passages(spark, folder)
    second = titles_of(docs.where(F.contains("text", F.lit("\n")))).withColumnRenamed("title", "text")
    ix2 = index.build_index(second, docs.agg(F.count("*").alias("n")), retrieval.query_terms(asked))
    fused = retrieval.reciprocal_rank_fusion([(retrieval.bm25(asked, indexed(spark, folder, asked), 200), 0.5), (retrieval.bm25(asked, ix2, 200), 0.5)])
    return shown(fused, "qid", "doc", "score", "rnk")


FIELDS = f"""parts AS (SELECT p_partkey AS doc, {TOKS('p_name')} AS title, {TOKS("p_type || ' ' || p_brand")} AS cat, {TOKS('p_brand')} AS store FROM part),
 weighted AS (SELECT doc, unnest(title) AS term, 6.0::DOUBLE AS w FROM parts UNION ALL SELECT doc, unnest(cat), 4.0 FROM parts UNION ALL SELECT doc, unnest(store), 1.5 FROM parts),
 tf AS (SELECT doc, term, sum(w) AS tf FROM weighted GROUP BY doc, term), dls AS (SELECT doc, sum(tf) AS dl FROM tf GROUP BY doc), size AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls),
 terms AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), size)"""


@query(f"""WITH {FIELDS}, q AS (SELECT DISTINCT p_name AS qid, unnest(list_filter({TOKS("p_name || ' ' || p_type")}, lambda t: len(t) >= 2 AND t NOT IN ({STOP}))) AS term FROM part WHERE p_partkey % 20 = 0),
 scored AS (SELECT qid, doc, sum(idf * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN terms USING (term) JOIN tf USING (term) JOIN dls USING (doc), size GROUP BY qid, doc)
 SELECT qid, doc, round(score, 6) AS score, rnk FROM {TOP('scored', 10)}""")
def fielded_fts_bm25(spark: SparkSession, folder: str) -> DataFrame:
    """Products found by what the stated ones (numbers divisible by 20) are called and are."""
    part = read(spark, folder, "part")
    fields = [(part.select(F.col("p_partkey").alias("doc"), t.alias("text")), w) for t, w in ((F.col("p_name"), 6.0), (F.concat_ws(" ", "p_type", "p_brand"), 4.0), (F.col("p_brand"), 1.5))]
    asked = part.where("p_partkey % 20 = 0").groupBy(F.col("p_name").alias("qid")).agg(F.concat_ws(" ", F.first("p_name"), F.array_join(F.array_sort(F.collect_set("p_type")), " ")).alias("text"))
    return shown(retrieval.fielded_bm25(asked, fields), "qid", "doc", "score", "rnk")


BM25F = f"""raw AS (SELECT p_partkey AS doc, 'title' AS field, {TOKS('p_name')} AS toks FROM part UNION ALL SELECT p_partkey, 'cat', {TOKS('p_type')} FROM part UNION ALL SELECT p_partkey, 'body', {TOKS("p_brand || ' size ' || p_size")} FROM part),
 averages AS (SELECT field, avg(len(toks)) AS avg_dl FROM raw GROUP BY field),
 fields AS (SELECT doc, field, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc, field, unnest(toks) AS term, len(toks) AS dl FROM raw) GROUP BY doc, field, term),
 n AS (SELECT count(*) AS n FROM part), terms AS (SELECT term, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM (SELECT term, count(DISTINCT doc) AS df FROM fields GROUP BY term), n),
 slots AS (SELECT DISTINCT p_partkey AS qid, s AS slot, unnest({TOKS('v')}) AS term FROM (SELECT p_partkey, 1 AS s, p_name AS v FROM part WHERE p_partkey % 20 = 0 UNION ALL SELECT p_partkey, 2, p_type FROM part WHERE p_partkey % 20 = 0)),
 total AS (SELECT qid, slot, sum(idf) AS idf_total FROM slots JOIN terms USING (term) GROUP BY qid, slot),
 pseudo AS (SELECT qid, slot, doc, term, sum(tf * CASE field WHEN 'title' THEN 3.0 WHEN 'cat' THEN 2.0 ELSE 1.0 END / (0.4 + 0.6 * dl / greatest(avg_dl, 1.0))) AS tfp FROM slots JOIN fields USING (term) JOIN averages USING (field) GROUP BY ALL),
 each AS (SELECT qid, slot, doc, sum(idf * tfp / (tfp + 1.2)) AS s FROM pseudo JOIN terms USING (term) GROUP BY ALL),
 scored AS (SELECT qid, doc, sum(s / idf_total) AS score FROM each JOIN total USING (qid, slot) GROUP BY qid, doc)"""


@query(f"WITH {BM25F} SELECT qid, doc, round(score, 6) AS score, rnk FROM {TOP('scored', 10)}")
def bm25f_rescore(spark: SparkSession, folder: str) -> DataFrame:
    part = read(spark, folder, "part")
    columns = {"title": F.col("p_name"), "cat": F.col("p_type"), "body": F.concat_ws(" ", "p_brand", F.lit("size"), F.col("p_size").cast("string"))}
    raw = part.select(F.col("p_partkey").alias("doc"), F.explode(F.array(*[F.struct(F.lit(k).alias("field"), T.tokens(c).alias("toks")) for k, c in columns.items()])).alias("f")).select("doc", "f.field", "f.toks")
    averages = raw.groupBy("field").agg(F.avg(F.size("toks")).alias("avg_dl"))
    fields = raw.select("doc", "field", F.size("toks").alias("dl"), F.explode("toks").alias("term")).groupBy("doc", "field", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    n = part.agg(F.count("*").alias("n"))
    terms = fields.groupBy("term").agg(F.countDistinct("doc").alias("df")).join(F.broadcast(n), F.lit(True)).select("term", T.idf(F.col("n"), F.col("df")).alias("idf"))
    slots = part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("qid"), F.explode(F.array(F.struct(F.lit(1).alias("slot"), T.tokens(F.col("p_name")).alias("t")), F.struct(F.lit(2).alias("slot"), T.tokens(F.col("p_type")).alias("t")))).alias("s")).select("qid", "s.slot", F.explode(F.array_distinct("s.t")).alias("term"))
    return shown(retrieval.bm25f(slots, fields, terms, averages, {"title": 3, "cat": 2, "body": 1}), "qid", "doc", "score", "rnk")


DENSE = """dense AS (SELECT q.vec_id AS qid, v.vec_id AS doc, list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: q.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE)) AS score
   FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))


@query(f"WITH {DENSE} SELECT qid, doc, round(score, 6) AS score, rnk FROM {TOP('dense', 10)}")
def dense_cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The stated queries are the vectors whose id is divisible by 20; they search all vectors."""
    v = vectors(spark, folder)
    return shown(retrieval.cosine(v.where("doc % 20 = 0").withColumnRenamed("doc", "qid"), v), "qid", "doc", "score", "rnk")


@query(f"""WITH {INDEX}, {DENSE}, lexical AS (SELECT qid, doc, rnk FROM {TOP(SCORED('qterms'), 200)}),
 near AS (SELECT qid // 20 AS qid, doc, rnk FROM {TOP('dense', 200)} WHERE qid // 20 IN (SELECT item_id FROM benchmark)),
 points AS (SELECT qid, doc, sum(p) AS score FROM (SELECT qid, doc, 0.7 / (60 + rnk) AS p FROM lexical UNION ALL SELECT qid, doc, 0.3 / (60 + rnk) FROM near) GROUP BY qid, doc)
 SELECT qid, doc, round(score, 6) AS score, rnk FROM {TOP('points', 10)}""")
def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    """Lexical and dense rankings of one question fused; question q has the vector 20 q."""
    asked, v = passages(spark, folder), vectors(spark, folder)
    own = v.where("doc % 20 = 0").select(F.expr("doc div 20").alias("qid"), "vector").join(asked.select("qid"), "qid", "left_semi")
    fused = retrieval.reciprocal_rank_fusion([(retrieval.bm25(asked, indexed(spark, folder, asked), 200), 0.7), (retrieval.cosine(own, v, 200), 0.3)])
    return shown(fused, "qid", "doc", "score", "rnk")


def GRAMS(x: str) -> str:  # noqa: N802
    return f"list_distinct(list_transform(range(1, len({x}) + 1), lambda i: substr('$' || {x} || '$', i, 3)))"


TYPOS = f"""words AS (SELECT DISTINCT word FROM (SELECT unnest({TOKS('text')}) AS word FROM conversations WHERE role = 'user') WHERE len(word) >= 4 AND regexp_matches(word, '^[a-z]+$') AND word NOT IN (SELECT term FROM terms)),
 pool AS (SELECT term, df FROM terms WHERE regexp_matches(term, '^[a-z]+$') AND len(term) >= 4 AND df >= 3),
 pg AS (SELECT term, df, unnest({GRAMS('term')}) AS gram FROM pool), wg AS (SELECT word, unnest({GRAMS('word')}) AS gram FROM words),
 shared AS (SELECT word, term, df, count(*) AS shared FROM wg JOIN pg USING (gram) GROUP BY ALL),
 cands AS (SELECT word, term, shared, df FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY shared DESC, term) AS r FROM shared) WHERE r <= 40)"""


def strange(spark: SparkSession, folder: str, terms: DataFrame) -> DataFrame:
    """Words of shoppers that no document has: four letters or more."""
    said = read(spark, folder, "conversations").where("role = 'user'").select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return said.where((F.length("word") >= 4) & F.col("word").rlike("^[a-z]+$")).join(terms.select(F.col("term").alias("word")), "word", "left_anti")


@query(f"WITH {INDEX}, {TYPOS} SELECT * FROM cands")
def trigram_candidates(spark: SparkSession, folder: str) -> DataFrame:
    df = materialized(index.document_frequencies(documents(spark, folder)), "frequencies")
    return fuzzy.trigram_candidates(strange(spark, folder, df), fuzzy.vocabulary(df)).select("word", "term", "shared", "df")


@query(f"""WITH {INDEX}, {TYPOS}, near AS (SELECT *, damerau_levenshtein(word, term) AS distance FROM cands)
 SELECT word, term, distance::INT AS distance FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, df DESC, term) AS r FROM near WHERE distance <= CASE WHEN len(word) < 7 THEN 1 ELSE 2 END) WHERE r = 1""")
def fuzzy_repair_tokens(spark: SparkSession, folder: str) -> DataFrame:
    df = materialized(index.document_frequencies(documents(spark, folder)), "frequencies")
    return fuzzy.repairs(strange(spark, folder, df), df)


@query(f"""WITH {INDEX}, {TYPOS} SELECT word, term, levenshtein(word, term)::INT AS distance FROM cands WHERE levenshtein(word, term) <= 2""")
def levenshtein_bounded(spark: SparkSession, folder: str) -> DataFrame:
    df = materialized(index.document_frequencies(documents(spark, folder)), "frequencies")
    near = fuzzy.trigram_candidates(strange(spark, folder, df), fuzzy.vocabulary(df)).withColumn("distance", F.levenshtein("word", "term", 2))
    return near.where("distance >= 0").select("word", "term", "distance")


MENDED = TYPOS.split("words AS (")[1].split("pool AS (")[1]


@query(f"""WITH {INDEX}, said AS (SELECT conv_id || ':' || turn AS id, coalesce(text, '') AS text FROM conversations WHERE role = 'user'),
 lists AS (SELECT id, regexp_extract_all(text, '([A-Za-z]+|[^A-Za-z]+)') AS p FROM said), parts AS (SELECT id, unnest(range(1, len(p) + 1)) AS pos, unnest(p) AS part FROM lists),
 words AS (SELECT DISTINCT lower(part) AS word FROM parts WHERE regexp_matches(lower(part), '^[a-z]+$') AND len(part) >= 4 AND lower(part) NOT IN (SELECT term FROM terms)),
 pool AS ({MENDED}, near AS (SELECT *, damerau_levenshtein(word, term) AS distance FROM cands),
 fixed AS (SELECT word, term FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, df DESC, term) AS r FROM near WHERE distance <= CASE WHEN len(word) < 7 THEN 1 ELSE 2 END) WHERE r = 1),
 joined AS (SELECT id, string_agg(coalesce(term, part), '' ORDER BY pos) AS text FROM parts LEFT JOIN fixed ON word = lower(part) GROUP BY id)
 SELECT said.id, coalesce(joined.text, '') AS text FROM said LEFT JOIN joined USING (id)""")
def fuzzy_repair_messages(spark: SparkSession, folder: str) -> DataFrame:
    said = read(spark, folder, "conversations").where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return fuzzy.repair_messages(said, index.document_frequencies(documents(spark, folder)))


def breadcrumbs(spark: SparkSession, folder: str) -> DataFrame:
    part = read(spark, folder, "part")
    return part.select(F.col("p_partkey").alias("doc"), F.array("p_type", "p_brand", "p_name").alias("path"), F.concat_ws(" ", "p_type", "p_brand").alias("category"), F.col("p_name").alias("title"))


KEYS = f"keys AS (SELECT {N("p_type || ' ' || p_brand")} AS key, count(*) AS docs, min(p_partkey) AS first_doc FROM part GROUP BY 1)"


@query(f"WITH {KEYS} SELECT * FROM keys")
def category_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return category.buckets(breadcrumbs(spark, folder))


PREFIX = "p AS (SELECT p_partkey AS doc, 1 AS depth, p_type AS prefix FROM part UNION ALL SELECT p_partkey, 2, p_type || ' > ' || p_brand FROM part UNION ALL SELECT p_partkey, 3, p_type || ' > ' || p_brand || ' > ' || p_name FROM part), sizes AS (SELECT prefix, depth, count(*) AS docs FROM p GROUP BY ALL)"


@query(f"WITH {PREFIX} SELECT prefix, depth, docs FROM sizes")
def category_prefix_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return category.prefixes(breadcrumbs(spark, folder)).groupBy("prefix", "depth").agg(F.count("*").alias("docs"))


@query(f"""WITH {PREFIX} SELECT doc AS qid, prefix, docs FROM (SELECT doc, prefix, docs, row_number() OVER (PARTITION BY doc ORDER BY (docs >= 15) DESC, CASE WHEN docs >= 15 THEN -depth ELSE depth END) AS r FROM p JOIN sizes USING (prefix, depth)) WHERE r = 1""")
def category_widen(spark: SparkSession, folder: str) -> DataFrame:
    c = breadcrumbs(spark, folder)
    return category.widen(c, c.select(F.col("doc").alias("qid"), "doc"), 15)


ASKS = "asks AS (SELECT p_partkey AS qid, 'I want a ' || p_name || ' ' || CASE WHEN p_partkey % 3 = 0 THEN p_type || ' ' || p_brand ELSE p_brand END || ' please' AS text FROM part)"


def asks(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", "p_type", "p_brand")).otherwise(F.col("p_brand"))
    return read(spark, folder, "part").select(F.col("p_partkey").alias("qid"), F.concat(F.lit("I want a "), "p_name", F.lit(" "), kind, F.lit(" please")).alias("text"))


@query(f"""WITH {KEYS}, {ASKS} SELECT qid, key, 1.0::DOUBLE AS confidence FROM (SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY len(key) DESC, first_doc) AS r FROM (SELECT qid, ' ' || {N('text')} || ' ' AS p FROM asks) JOIN keys ON contains(p, ' ' || key || ' ')) WHERE r = 1""")
def category_resolve_substring(spark: SparkSession, folder: str) -> DataFrame:
    return category.by_substring(asks(spark, folder), category.buckets(breadcrumbs(spark, folder)))


OVERLAP = f"""said AS (SELECT DISTINCT qid, unnest({TOKS('text')}) AS term FROM asks), own AS (SELECT key, first_doc, len(t) AS size, unnest(t) AS term FROM (SELECT key, first_doc, list_distinct({TOKS('key')}) AS t FROM keys)),
 share AS (SELECT qid, key, first_doc, count(*) / max(size) AS c FROM said JOIN own USING (term) GROUP BY qid, key, first_doc),
 overlap AS (SELECT qid, key, c AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(c, 9) DESC, first_doc) AS r FROM share WHERE c >= 0.5) WHERE r = 1)"""


@query(f"WITH {KEYS}, {ASKS}, {OVERLAP} SELECT qid, key, round(confidence, 6) AS confidence FROM overlap")
def category_resolve_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return shown(category.by_overlap(asks(spark, folder), category.buckets(breadcrumbs(spark, folder))), "qid", "key", "confidence")


def VOTE(k: int) -> str:  # noqa: N802
    return f"""ranked AS (SELECT * FROM {TOP(SCORED('qterms'), k)}), votes AS (SELECT qid, {N("lang || ' ' || source")} AS key, sum(score) AS mass, min(rnk) AS best FROM ranked JOIN documents ON doc_id = doc GROUP BY 1, 2),
 vote AS (SELECT qid, key, mass / total AS confidence FROM (SELECT *, sum(mass) OVER (PARTITION BY qid) AS total, row_number() OVER (PARTITION BY qid ORDER BY round(mass, 9) DESC, best) AS r FROM votes) WHERE r = 1)"""


def doc_categories(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select(F.col("doc_id").alias("doc"), F.concat(F.col("lang"), F.lit(" "), F.col("source")).alias("category"))


@query(f"WITH {INDEX}, {VOTE(40)} SELECT qid, key, round(confidence, 6) AS confidence FROM vote")
def category_resolve_vote(spark: SparkSession, folder: str) -> DataFrame:
    asked = passages(spark, folder)
    ranked = retrieval.bm25(asked, indexed(spark, folder, asked), 40)
    return shown(category.by_vote(ranked, doc_categories(spark, folder)), "qid", "key", "confidence")


@query(f"""WITH a AS (WITH {INDEX}, {VOTE(40)} SELECT * FROM vote), b AS (WITH {INDEX}, {VOTE(5)} SELECT * FROM vote)
 SELECT coalesce(a.qid, b.qid) AS qid, CASE WHEN a.confidence IS NOT NULL AND (b.confidence IS NULL OR round(a.confidence, 9) >= round(b.confidence, 9)) THEN a.key ELSE b.key END AS key, round(greatest(a.confidence, b.confidence), 6) AS confidence, CASE WHEN a.key IS DISTINCT FROM b.key THEN CASE WHEN a.confidence IS NOT NULL AND (b.confidence IS NULL OR round(a.confidence, 9) >= round(b.confidence, 9)) THEN b.key ELSE a.key END END AS also FROM a FULL JOIN b ON a.qid = b.qid""")
def category_resolve_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    """The more confident of two votes, one over the best 40 and one over the best 5."""
    asked, c = passages(spark, folder), doc_categories(spark, folder)
    ix = indexed(spark, folder, asked)
    return shown(category.by_ensemble(category.by_vote(retrieval.bm25(asked, ix, 40), c), category.by_vote(retrieval.bm25(asked, ix, 5), c)), "qid", "key", "confidence", "also")


PART_INDEX = INDEX.replace("doc_id AS doc, coalesce(text, '') AS text FROM documents", "p_partkey AS doc, concat_ws(' ', p_name, p_type, p_brand) AS text FROM part").replace("SELECT item_id AS qid, text FROM benchmark", "SELECT qid, text FROM asks WHERE qid % 20 = 0")


@query(f"""WITH {KEYS}, {ASKS}, {PART_INDEX}, sub AS (SELECT qid, key FROM (SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY len(key) DESC, first_doc) AS r FROM (SELECT qid, ' ' || {N('text')} || ' ' AS p FROM queries) JOIN keys ON contains(p, ' ' || key || ' ')) WHERE r = 1),
 ranked AS (SELECT * FROM {TOP(SCORED('qterms'), 40)}), votes AS (SELECT qid, {N("p_type || ' ' || p_brand")} AS key, sum(score) AS mass, min(rnk) AS best FROM ranked JOIN part ON p_partkey = doc GROUP BY 1, 2),
 vote AS (SELECT qid, key, mass / total AS confidence FROM (SELECT *, sum(mass) OVER (PARTITION BY qid) AS total, row_number() OVER (PARTITION BY qid ORDER BY round(mass, 9) DESC, best) AS r FROM votes) WHERE r = 1)
 SELECT qid, key, 1.0::DOUBLE AS confidence FROM sub UNION ALL SELECT qid, key, round(confidence, 6) FROM vote WHERE qid NOT IN (SELECT qid FROM sub)""")
def category_resolve_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """The stated products' requests (numbers divisible by 20): a bucket's name if the request has one, else the vote of the products that it finds."""
    asked, c = asks(spark, folder).where("qid % 20 = 0"), breadcrumbs(spark, folder)
    text = read(spark, folder, "part").select(F.col("p_partkey").alias("doc"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    ix = index.build_index(text, wanted=retrieval.query_terms(asked), alike=True)
    tiers = category.first_of(category.by_substring(asked, category.buckets(c)), category.by_vote(retrieval.bm25(asked, ix, 40), c))
    return shown(tiers, "qid", "key", "confidence")


def WORD_GRAMS(rows: str, low: int, high: int) -> str:  # noqa: N802
    sizes = " UNION ALL ".join(f"SELECT qid, unnest(list_transform(range(1, greatest(len(w) - {n - 1}, 0) + 1), lambda i: substr(w, i, {n}))) AS gram FROM gw" for n in range(low, high + 1))
    return f"SELECT qid, gram, count(*) AS n FROM (WITH gw AS (SELECT qid, ' ' || unnest({TOKS('text')}) || ' ' AS w FROM {rows}) {sizes}) GROUP BY qid, gram"


@query(f"WITH said AS (SELECT item_id AS qid, text FROM benchmark) {WORD_GRAMS('said', 3, 5)}")
def char_ngram_counts(spark: SparkSession, folder: str) -> DataFrame:
    return category.word_grams(passages(spark, folder))


CLF = f"""ex AS (SELECT doc_id AS qid, text, lang AS key FROM documents WHERE lang IS NOT NULL),
 eg AS ({WORD_GRAMS('ex', 3, 3)}), sizes AS (SELECT key, count(*) AS docs FROM ex GROUP BY key), every AS (SELECT sum(docs)::BIGINT AS all_docs FROM sizes),
 gdf AS (SELECT gram, count(*) AS df FROM eg GROUP BY gram HAVING count(*) >= 5),
 cnt AS (SELECT gram, key, count(*) AS c FROM eg JOIN ex USING (qid) GROUP BY gram, key),
 w AS (SELECT gram, key, ln(((c + 1) / (docs + 2)) / ((df - c + 1) / (all_docs - docs + 2))) AS w FROM cnt JOIN gdf USING (gram) JOIN sizes USING (key), every),
 weights AS (SELECT gram, key, w FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(w, 9) DESC, gram) AS r FROM w) WHERE r <= 140),
 intercepts AS (SELECT key, ln(docs / all_docs) AS intercept FROM sizes, every)"""


def examples(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").where("lang is not null").select(F.col("doc_id").alias("qid"), "text", F.col("lang").alias("key"))


@query(f"WITH {CLF} SELECT gram, key, round(w, 6) AS w FROM weights")
def linear_clf_weights(spark: SparkSession, folder: str) -> DataFrame:
    return shown(category.class_weights(examples(spark, folder), low=3, high=3)[0], "gram", "key", "w")


@query(f"""WITH {CLF}, said AS (SELECT item_id AS qid, text FROM benchmark), mg AS ({WORD_GRAMS('said', 3, 3)}),
 hits AS (SELECT qid, key, sum(n * w) AS s FROM mg JOIN weights USING (gram) GROUP BY qid, key),
 full_ AS (SELECT q.qid, i.key, coalesce(s, 0) + intercept AS z FROM (SELECT DISTINCT qid FROM hits) q CROSS JOIN intercepts i LEFT JOIN hits h ON h.qid = q.qid AND h.key = i.key),
 best AS (SELECT qid, key, z, r FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(z, 9) DESC, key DESC) AS r FROM full_ WHERE EXISTS (SELECT 1 FROM hits h WHERE h.qid = full_.qid AND h.key = full_.key)) WHERE r = 1)
 SELECT b.qid, b.key, round(1 / sum(exp(f.z - b.z)), 6) AS confidence FROM best b JOIN full_ f USING (qid) GROUP BY b.qid, b.key, b.z""")
def linear_clf_predict_softmax(spark: SparkSession, folder: str) -> DataFrame:
    weights, intercepts = category.class_weights(examples(spark, folder), low=3, high=3)
    return shown(category.by_classifier(passages(spark, folder), weights, intercepts, 3, 3), "qid", "key", "confidence")


SLOTS = f"""content AS (SELECT qid, list_filter({TOKS('text')}, lambda t: t NOT IN ({STOP}) AND len(t) >= 3) AS t FROM queries),
 slots AS (SELECT DISTINCT qid, (i - 1) // 2 AS slot, t[i] AS term FROM (SELECT qid, t, unnest(range(1, len(t) + 1)) AS i FROM content)),
 known AS (SELECT * FROM slots JOIN terms USING (term)), totals AS (SELECT qid, slot, sum(idf) AS idf_total FROM known GROUP BY qid, slot),
 covered AS (SELECT qid, slot, doc, sum(idf) AS mass FROM known JOIN tf USING (term), size WHERE df <= n * 0.35 GROUP BY qid, slot, doc)"""


def slots_of(spark: SparkSession, folder: str) -> DataFrame:
    """The content words of each passage, by twos, as slots."""
    words = passages(spark, folder).select("qid", F.posexplode(T.content(T.tokens(F.col("text")), 3)).alias("i", "term"))
    return words.select("qid", F.expr("cast(i div 2 as bigint)").alias("slot"), "term").distinct()


def covered_slots(spark: SparkSession, folder: str, ix: index.Index | None = None) -> tuple[DataFrame, DataFrame]:
    slots = slots_of(spark, folder)
    ix = ix or index.build_index(documents(spark, folder), wanted=slots)
    return ranking.coverage(slots, ix.tf.select("doc", "term"), ix.terms, ix.size), slots


@query(f"WITH {INDEX}, {SLOTS} SELECT qid, slot, doc, round(mass, 6) AS mass, round(idf_total, 6) AS idf_total FROM covered JOIN totals USING (qid, slot)")
def slot_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return shown(covered_slots(spark, folder)[0], "qid", "slot", "doc", "mass", "idf_total")


CONJ = f"""cat AS (SELECT qid, doc_id AS doc FROM queries JOIN documents ON source = 'src' || (qid % 20)), seen AS (SELECT qid, doc FROM {TOP(SCORED('qterms'), 3)}),
 raw AS (SELECT qid, doc, sum(mass) + CASE WHEN (qid, doc) IN (SELECT qid, doc FROM cat) THEN 0.5 ELSE 0 END AS raw FROM covered GROUP BY qid, doc),
 kept AS (SELECT qid, doc FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(raw, 9) DESC, doc) AS r FROM raw) WHERE r <= 4000),
 grid AS (SELECT k.qid, k.doc, s.slot, least(1.0, coalesce(mass / idf_total, 0)) AS cover FROM kept k JOIN (SELECT DISTINCT qid, slot FROM slots) s USING (qid) LEFT JOIN covered c ON c.qid = k.qid AND c.slot = s.slot AND c.doc = k.doc LEFT JOIN totals t ON t.qid = k.qid AND t.slot = s.slot),
 conj AS (SELECT qid, doc, sum(ln(0.02 + pow(cover, 1.5))) + CASE WHEN (qid, doc) IN (SELECT qid, doc FROM cat) THEN 2.0 ELSE 0 END - CASE WHEN (qid, doc) IN (SELECT qid, doc FROM seen) THEN 1.0 ELSE 0 END AS score, min(cover) >= 0.999 AS ok FROM grid GROUP BY qid, doc),
 satisfied AS (SELECT qid, count_if(ok)::BIGINT AS satisfied FROM conj GROUP BY qid)"""


def conjunctive_rows(spark: SparkSession, folder: str, ix: index.Index | None = None) -> DataFrame:
    """Slots ranked with a source as category; the three best by BM25 count as shown. One index serves both."""
    asked = passages(spark, folder)
    ix = ix or indexed(spark, folder, asked)  # slots have no other words than their passages
    slots = materialized(slots_of(spark, folder), "slots")
    flags = ranking.covered_flags(slots, ix).where("doc is not null")
    own = read(spark, folder, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("key"))
    wish = asked.select("qid", F.concat(F.lit("src"), F.col("qid") % 20).alias("key"), F.lit(1.0).alias("confidence"))
    return ranking.from_flags(flags, slots, (wish, own), shown=retrieval.bm25(asked, ix, 3))


def conjunctive_top(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return retrieval.top(conjunctive_rows(spark, folder), k, "total")


@query(f"WITH {INDEX}, {SLOTS}, {CONJ} SELECT qid, doc, round(score, 6) AS total, satisfied, rnk FROM {TOP('conj', 10)} JOIN satisfied USING (qid)")
def conjunctive_logproduct(spark: SparkSession, folder: str) -> DataFrame:
    return shown(conjunctive_top(spark, folder, 10), "qid", "doc", "total", "satisfied", "rnk")


PRODUCTS = """products AS (SELECT p_partkey AS doc, p_name AS title, p_brand AS brand, p_type AS type, p_retailprice AS price, coalesce(n, 0)::DOUBLE AS ratings, coalesce(a, 0.0)::DOUBLE AS average
   FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, round(avg(l_quantity) / 10, 4) AS a FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey)"""


def products(spark: SparkSession, folder: str) -> DataFrame:
    rated = read(spark, folder, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity") / 10, 4).alias("a"))
    part = read(spark, folder, "part")
    own = part.join(rated, part.p_partkey == rated.l_partkey, "left")
    return own.select(F.col("p_partkey").alias("doc"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_retailprice").alias("price"), F.coalesce("n", F.lit(0)).cast("double").alias("ratings"), F.coalesce("a", F.lit(0.0)).alias("average"))


@query(f"""WITH {PRODUCTS}, p AS (SELECT *, 10.0 * (price IS NOT NULL)::INT + ln(1 + ratings) AS price_pop, (average * ratings + 200) / (ratings + 50) AS bayes FROM products)
 SELECT doc, round(price_pop, 6) AS price_pop, round(bayes, 6) AS bayes, row_number() OVER (PARTITION BY title ORDER BY round(price_pop, 9) DESC, doc) AS place FROM p""")
def prior_tiebreak(spark: SparkSession, folder: str) -> DataFrame:
    p = products(spark, folder)
    p = p.select("doc", "title", *[ranking.prior(m, F.col("ratings"), F.col("average"), F.col("price")).alias(m) for m in ("price_pop", "bayes")])
    order = Window.partitionBy("title").orderBy(F.round("price_pop", 9).desc(), "doc")
    return p.select("doc", F.round("price_pop", 6).alias("price_pop"), F.round("bayes", 6).alias("bayes"), F.row_number().over(order).cast("long").alias("place"))


HEAD = f"""normal AS (SELECT doc, ' ' || {N('text')} || ' ' AS p FROM docs), phrases AS (SELECT DISTINCT qid, array_to_string(t[1:2], ' ') AS phrase FROM content WHERE len(t) >= 2),
 head AS (SELECT * FROM {TOP('conj', 400)}),
 hits AS (SELECT qid, doc, count(*) AS hits FROM head JOIN phrases USING (qid) JOIN normal USING (doc) WHERE contains(p, ' ' || phrase || ' ') GROUP BY qid, doc),
 rescored AS (SELECT qid, doc, score + 1.6 * coalesce(hits, 0) AS score FROM conj LEFT JOIN hits USING (qid, doc))"""


@query(f"WITH {INDEX}, {SLOTS}, {CONJ}, {HEAD} SELECT qid, doc, round(score, 6) AS total, rnk FROM {TOP('rescored', 10)}")
def head_phrase_card_rescore(spark: SparkSession, folder: str) -> DataFrame:
    texts = documents(spark, folder).select("doc", T.norm(F.col("text")).alias("normal"))
    first = passages(spark, folder).select("qid", F.slice(T.content(T.tokens(F.col("text")), 3), 1, 2).alias("t")).where(F.size("t") >= 2).select("qid", F.array_join("t", " ").alias("phrase")).distinct()
    return shown(retrieval.top(ranking.rescore_head(materialized(conjunctive_rows(spark, folder), "conjunctive"), texts, first), 10, "total"), "qid", "doc", "total", "rnk")


@query(f"""WITH {INDEX}, r AS (SELECT * FROM {TOP(SCORED('qterms'), 10)}) SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY (rnk % 3 = 1)::INT, rnk) AS rnk FROM r""")
def shown_demotion(spark: SparkSession, folder: str) -> DataFrame:
    """Every third result counts as shown before."""
    asked = passages(spark, folder)
    ranked = retrieval.bm25(asked, indexed(spark, folder, asked), 10)
    return ranking.shown_last(ranked, ranked.where("rnk % 3 = 1")).select("qid", "doc", "rnk")


def bm25_heads(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    asked = passages(spark, folder)
    return retrieval.bm25(asked, indexed(spark, folder, asked), 40).withColumnRenamed("score", "total"), titles_of(documents(spark, folder))


JACCARD = "CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
POOLED = f"""ranked AS (SELECT * FROM {TOP(SCORED('qterms'), 30)}), titles AS (SELECT doc, list_distinct({FIRST_LINE}) AS toks FROM docs),
 pool AS (SELECT qid, doc, rnk, toks, CASE WHEN max(score) OVER w = min(score) OVER w THEN (score - min(score) OVER w) ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS rel FROM ranked JOIN titles USING (doc) WINDOW w AS (PARTITION BY qid)),
 sims AS (SELECT a.qid, a.doc, b.doc AS other, {JACCARD.format(a='a.toks', b='b.toks')} AS sim FROM pool a JOIN pool b ON a.qid = b.qid AND a.doc <> b.doc)"""


@query(f"""WITH RECURSIVE {INDEX}, {POOLED},
 steps AS (SELECT qid, 1 AS k, doc, [doc] AS picked FROM pool WHERE rnk = 1
  UNION ALL SELECT qid, k, doc, picked FROM (SELECT s.qid, s.k + 1 AS k, p.doc, list_append(s.picked, p.doc) AS picked,
    row_number() OVER (PARTITION BY s.qid ORDER BY round(0.7 * rel - 0.3 * coalesce((SELECT max(sim) FROM sims WHERE sims.qid = p.qid AND sims.doc = p.doc AND list_contains(s.picked, sims.other)), 0), 9) DESC, p.rnk) AS r
    FROM steps s JOIN pool p ON p.qid = s.qid AND NOT list_contains(s.picked, p.doc) WHERE s.k < 10) WHERE r = 1)
 SELECT qid, doc, k::BIGINT AS rnk FROM steps""")
def mmr_rerank(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.mmr(*bm25_heads(spark, folder)).select("qid", "doc", "rnk")


@query(f"""WITH RECURSIVE {INDEX}, {POOLED},
 fold AS (SELECT qid, rnk AS k, [{{'lead': rnk, 'toks': toks}}] AS leads, rnk AS lead, doc FROM pool WHERE rnk = 1
  UNION ALL SELECT qid, k, CASE WHEN lead IS NULL THEN list_append(leads, {{'lead': k, 'toks': toks}}) ELSE leads END, coalesce(lead, k), doc
   FROM (SELECT f.qid, p.rnk AS k, f.leads, p.doc, p.toks, list_min(list_transform(list_filter(f.leads, lambda l: {JACCARD.format(a='l.toks', b='p.toks')} >= 0.6), lambda l: l.lead)) AS lead FROM fold f JOIN pool p ON p.qid = f.qid AND p.rnk = f.k + 1)),
 deep AS (SELECT *, row_number() OVER (PARTITION BY qid, lead ORDER BY k) AS depth FROM fold)
 SELECT qid, doc, rnk FROM (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY depth, lead) AS rnk FROM deep) WHERE rnk <= 10""")
def cluster_roundrobin(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.cluster_round_robin(*bm25_heads(spark, folder)).select("qid", "doc", "rnk")


@query(f"""WITH {INDEX}, {SLOTS}, {CONJ} SELECT qid, doc, rnk, 'conjunctive' AS mode FROM {TOP('conj', 10)} WHERE qid IN (SELECT qid FROM satisfied WHERE satisfied > 0)
 UNION ALL SELECT qid, doc, rnk, 'prose' FROM {TOP(SCORED('qterms'), 10)} WHERE qid NOT IN (SELECT qid FROM satisfied WHERE satisfied > 0)""")
def retrieval_auto_mode(spark: SparkSession, folder: str) -> DataFrame:
    asked = passages(spark, folder)
    ix = indexed(spark, folder, asked)
    rows = materialized(conjunctive_rows(spark, folder, ix), "conjunctive")
    prose = retrieval.bm25(asked, ix, 10)
    return ranking.by_mode(retrieval.top(rows, 10, "total"), prose, rows.select("qid", "satisfied"))
