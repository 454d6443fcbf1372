"""Queries of the lab: catalog rendering, extraction, dialogue, simulation, metrics and their statistics, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import cues
from ..functions import text as T
from ..operators import agent, dialogue, evaluate, extract, index, probes, retrieval, simulate
from ..settings import Settings
from ..sources.scratch import materialized
from ..streaming import sessions as streams
from .registry import query, read
from .search import INDEX, PRODUCTS, SCORED, STOP, TOKS, TOP, N, documents, indexed, passages, products


def Q(pattern: str) -> str:  # noqa: N802
    """A pattern as a SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


# --- catalog rendering --------------------------------------------------------------------------------------

@query("""SELECT p_partkey AS doc, trim(concat_ws(' ', p_name, 'brand ' || p_brand, 'size ' || p_size, p_type)) AS text FROM part""")
def flatten_search_text(spark: SparkSession, folder: str) -> DataFrame:
    part = read(spark, folder, "part")
    pairs = F.array(F.struct(F.lit("brand").alias("key"), F.col("p_brand").alias("value")), F.struct(F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value")))
    return part.select(F.col("p_partkey").alias("doc"), C.searchable(F.col("p_name"), C.flatten_pairs(pairs), F.col("p_type")).alias("text"))


DIRTY = """CASE p_partkey % 6 WHEN 0 THEN '$' || c WHEN 1 THEN 'from ' || c WHEN 2 THEN c || ' — ' || c WHEN 3 THEN 'call' WHEN 4 THEN '' ELSE '1,' || c END"""


@query(f"""WITH p AS (SELECT p_partkey, p_partkey % 1000 || '.' || p_partkey % 90 + 10 AS c FROM part), d AS (SELECT p_partkey AS doc, {DIRTY} AS typed FROM p)
 SELECT doc, typed, list_extract(list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(typed, '[$,]', '', 'g'), '[–—]', ' ', 'g'), '\\s+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9.]+$') THEN try_cast(x AS DOUBLE) END), lambda x: x IS NOT NULL), 1) AS price FROM d""")
def parse_price(spark: SparkSession, folder: str) -> DataFrame:
    """Prices as a shop might type them, made from the product's number."""
    c, k = F.concat((F.col("p_partkey") % 1000).cast("string"), F.lit("."), (F.col("p_partkey") % 90 + 10).cast("string")), F.col("p_partkey") % 6
    typed = F.when(k == 0, F.concat(F.lit("$"), c)).when(k == 1, F.concat(F.lit("from "), c)).when(k == 2, F.concat(c, F.lit(" — "), c)).when(k == 3, F.lit("call")).when(k == 4, F.lit("")).otherwise(F.concat(F.lit("1,"), c))
    return read(spark, folder, "part").select(F.col("p_partkey").alias("doc"), typed.alias("typed")).withColumn("price", C.parse_price(F.col("typed")))


CLEAN = "rtrim(substr(regexp_replace(regexp_replace({x}, '[\\s\\x0B\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'), '^[ \\-;,.\\t\\n]+|[ \\-;,.\\t\\n]+$', '', 'g'), 1, 180))"


@query(f"SELECT doc_id, {CLEAN.format(x='text')} AS cleaned FROM documents")
def clean_constraint(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", C.clean_constraint(F.col("text")).alias("cleaned"))


MATERIAL, COLOR = "|".join(C.MATERIALS), "|".join(C.COLORS)
CARDS = f"""{PRODUCTS}, raw AS (SELECT doc, title, trim(concat_ws(' ', title, brand, type)) AS text, ['brand: ' || brand, 'type: ' || type] AS cands, CASE WHEN doc % 2 = 0 THEN doc % 100 || '.5' END AS price FROM products),
 m AS (SELECT *, lower(regexp_extract(text, '(?i)\\b({MATERIAL})\\b', 1)) AS material, lower(regexp_extract(text, '(?i)\\b({COLOR})\\b', 1)) AS color FROM raw),
 a AS (SELECT *, CASE WHEN material <> '' THEN list_concat([material], cands) ELSE cands END AS one FROM m),
 b AS (SELECT *, CASE WHEN color <> '' THEN list_concat(one[1:1], ['color: ' || color], one[2:]) ELSE one END AS two FROM a),
 c AS (SELECT *, CASE WHEN price IS NOT NULL THEN list_append(two, 'budget around $' || price) ELSE two END AS three FROM b),
 cards AS (SELECT doc, text, title, list_filter(three, lambda x: x <> '')[1:4] AS card FROM c)"""


def cards(spark: SparkSession, folder: str) -> DataFrame:
    p = products(spark, folder)
    text = C.searchable(F.col("title"), F.col("brand"), F.col("type"))
    said = F.array(F.concat(F.lit("brand: "), "brand"), F.concat(F.lit("type: "), "type"))
    price = F.when(F.col("doc") % 2 == 0, F.concat((F.col("doc") % 100).cast("string"), F.lit(".5")))
    return p.select("doc", "title", text.alias("text"), "type", "brand", C.card_slots(said, text, price, F.col("title")).alias("card"))


@query(f"WITH {CARDS} SELECT doc, array_to_string(card, ' | ') AS card FROM cards")
def card_slots(spark: SparkSession, folder: str) -> DataFrame:
    return cards(spark, folder).select("doc", F.array_join("card", " | ").alias("card"))


@query("""SELECT p_partkey AS doc, CASE WHEN p_partkey % 5 = 0 THEN 'clothing item' WHEN p_partkey % 5 = 1 THEN p_type ELSE p_type || ' ' || p_brand END AS category FROM part""")
def coarse_category(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    path = F.when(k == 0, F.array(F.lit("Clothing, Clothing"))).when(k == 1, F.array(F.lit("Clothing"), F.col("p_type"))).otherwise(F.array(F.lit("Clothing"), F.lit("All"), F.concat(F.col("p_type"), F.lit(", "), F.col("p_brand"))))
    return read(spark, folder, "part").select(F.col("p_partkey").alias("doc"), C.coarse_category(path).alias("category"))


KINDS = "CASE WHEN regexp_matches(lower(v), {b}) THEN 'budget' WHEN regexp_matches(lower(v), '{m}') THEN 'material' {rest} ELSE 'feature' END".format(
    b=Q(C.BUDGET), m=MATERIAL, rest=" ".join(f"WHEN regexp_matches(lower(v), '{'|'.join(w)}') THEN '{k}'" for k, w in C.KINDS.items()))


@query(f"WITH {CARDS}, e AS (SELECT doc, unnest(card) AS v FROM cards UNION ALL SELECT doc_id, text FROM documents WHERE text IS NOT NULL) SELECT v AS value, count(*) AS n, {KINDS} AS kind FROM e GROUP BY v")
def classify_constraint(spark: SparkSession, folder: str) -> DataFrame:
    """Card slots, and whole documents."""
    own = cards(spark, folder).select(F.explode("card").alias("value"))
    free = read(spark, folder, "documents").where("text is not null").select(F.col("text").alias("value"))
    return own.unionByName(free).groupBy("value").agg(F.count("*").alias("n")).withColumn("kind", C.classify_constraint(F.col("value")))


# --- extraction and dialogue ----------------------------------------------------------------------------------

DGRAMS = "dgrams AS (SELECT DISTINCT array_to_string(toks[i:i + k - 1], ' ') AS phrase FROM (SELECT toks, unnest(range(1, len(toks) + 1)) AS i FROM dtoks), LATERAL (SELECT unnest(range(1, least({n}, len(toks) - i + 1) + 1)) AS k))"
SAID = f"""w AS (SELECT item_id AS id, {TOKS('text')} AS w FROM benchmark),
 h AS (SELECT id, array_to_string(w, ' ') AS a, array_to_string(w[1:len(w) // 2], ' ') AS b, array_to_string(w[len(w) // 2 + 1:], ' ') AS c FROM w WHERE len(w) >= 2),
 said AS (SELECT id AS qid, CASE (id * 7 + id // 6) % 6 WHEN 0 THEN 'I am looking for this. What matters is: ' || b || '; ' || c || '.' WHEN 1 THEN 'Actually, ignore my earlier preference. What I need is: ' || a || '.'
   WHEN 2 THEN 'not ' || b || ', ' || c || ' is better' WHEN 3 THEN 'no preference for color, ' || a WHEN 4 THEN 'nothing else for size, ' || a ELSE 'never mind, ' || a END AS text FROM h)"""


def said(spark: SparkSession, folder: str) -> DataFrame:
    """(qid, text): a shopper's sentences of six kinds around each whole passage or its halves."""
    rows = passages(spark, folder).select("qid", T.tokens(F.col("text")).alias("w")).where(F.size("w") >= 2)
    half = F.expr("size(w) div 2")
    a, b, c = F.array_join("w", " "), F.array_join(F.slice("w", F.lit(1), half), " "), F.array_join(F.slice("w", half + 1, F.size("w")), " ")
    k = (F.col("qid") * 7 + F.expr("qid div 6")) % 6
    text = (
        F.when(k == 0, F.concat(F.lit("I am looking for this. What matters is: "), b, F.lit("; "), c, F.lit(".")))
        .when(k == 1, F.concat(F.lit("Actually, ignore my earlier preference. What I need is: "), a, F.lit(".")))
        .when(k == 2, F.concat(F.lit("not "), b, F.lit(", "), c, F.lit(" is better")))
        .when(k == 3, F.concat(F.lit("no preference for color, "), a)).when(k == 4, F.concat(F.lit("nothing else for size, "), a))
        .otherwise(F.concat(F.lit("never mind, "), a))
    )
    return rows.select("qid", text.alias("text"))


READING = f"CASE WHEN regexp_matches(text, {Q(cues.RESET)}) THEN 'reset' WHEN regexp_matches(text, {Q(cues.OVERRIDE)}) THEN 'override' WHEN regexp_matches(text, {Q(cues.NO_PREFERENCE)}) THEN 'declined' WHEN regexp_matches(text, {Q(cues.EXHAUSTED)}) THEN 'exhausted' ELSE 'plain' END"


@query(f"""WITH {SAID} SELECT 's' || qid AS qid, {READING} AS kind, CASE WHEN lower(regexp_extract(text, {Q(cues.ATTRIBUTE)}, 1)) = '' THEN 'other' ELSE lower(regexp_extract(text, {Q(cues.ATTRIBUTE)}, 1)) END AS attribute FROM said
 UNION ALL SELECT conv_id || ':' || turn, {READING}, CASE WHEN lower(regexp_extract(text, {Q(cues.ATTRIBUTE)}, 1)) = '' THEN 'other' ELSE lower(regexp_extract(text, {Q(cues.ATTRIBUTE)}, 1)) END FROM conversations WHERE text IS NOT NULL""")
def cue_detection(spark: SparkSession, folder: str) -> DataFrame:
    free = read(spark, folder, "conversations").where("text is not null").select(F.concat_ws(":", "conv_id", "turn").alias("qid"), "text")
    return said(spark, folder).withColumn("qid", F.concat(F.lit("s"), "qid")).unionByName(free).select("qid", cues.reading(F.col("text")).alias("kind"), cues.attribute(F.col("text")).alias("attribute"))


@query(f"""WITH {SAID}, d AS (SELECT qid, regexp_extract(text, {Q(cues.DISCLOSURE)}, 1) AS v FROM said)
 SELECT qid, array_to_string(list_filter(list_transform(string_split(v, ';'), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> ''), ' | ') AS disclosed FROM d WHERE v <> ''""")
def disclosed_constraints(spark: SparkSession, folder: str) -> DataFrame:
    return said(spark, folder).select("qid", cues.disclosed(F.col("text")).alias("d")).where(F.size("d") > 0).select("qid", F.array_join("d", " | ").alias("disclosed"))


@query(f"""WITH {INDEX}, {SAID}, cl AS (SELECT qid, unnest(string_split_regex(text, '[,;]')) AS c, unnest(range(0, len(string_split_regex(text, '[,;]')))) AS n FROM said),
 raw AS (SELECT qid, n, list_filter({TOKS(f"regexp_extract(c, {Q(cues.NEGATION + '(.*)$')}, 1)")}, lambda t: t NOT IN ({STOP})) AS t FROM cl),
 tails AS (SELECT qid, n, list(term ORDER BY i) AS t FROM (SELECT qid, n, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS term FROM raw) WHERE term IN (SELECT term FROM terms) GROUP BY qid, n),
 numbered AS (SELECT qid, t, row_number() OVER (PARTITION BY qid ORDER BY n) - 1 AS clause FROM tails WHERE len(t) > 0),
 win AS (SELECT qid, clause, k, i, array_to_string(t[i:i + k - 1], ' ') AS phrase FROM (SELECT qid, clause, t, unnest(range(1, least(len(t), 6) + 1)) AS k FROM numbered), LATERAL (SELECT unnest(range(1, len(t) - k + 2)) AS i)),
 {DGRAMS.format(n=6)}, ok AS (SELECT * FROM win WHERE phrase IN (SELECT phrase FROM dgrams))
 SELECT qid, clause, phrase FROM (SELECT *, row_number() OVER (PARTITION BY qid, clause ORDER BY k DESC, i) AS r FROM ok) WHERE r = 1""")
def negation_retractions(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.retractions(said(spark, folder), documents(spark, folder))


ISLANDS = f"""salient AS (SELECT term FROM terms, size WHERE df > 0 AND df <= n * 0.35 AND term NOT IN ({STOP}) AND len(term) >= 2 AND idf >= 1.0),
 mt AS (SELECT qid, t, unnest(range(0, len(t))) AS pos, unnest(t) AS term FROM (SELECT qid, {TOKS('text')} AS t FROM queries)),
 onn AS (SELECT qid, t, pos, pos - lag(pos) OVER (PARTITION BY qid ORDER BY pos) AS d FROM mt WHERE term IN (SELECT term FROM salient)),
 runs AS (SELECT *, sum((d IS NULL OR d > 2)::INT) OVER (PARTITION BY qid ORDER BY pos) AS run FROM onn),
 ends AS (SELECT qid, run::BIGINT AS run, min(pos) AS start, array_to_string(any_value(t)[min(pos) + 1:least(max(pos) + 1, min(pos) + 12)], ' ') AS phrase FROM runs GROUP BY qid, run)"""


@query(f"WITH {INDEX}, {ISLANDS} SELECT qid, run, start, phrase FROM ends")
def salient_runs(spark: SparkSession, folder: str) -> DataFrame:
    ix = indexed(spark, folder)
    return extract.salient_runs(passages(spark, folder), index.salient(ix.terms, ix.size))


def mixed_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(rid, toks): each whole passage, with a word of no document in its middle: two parts to be found apart."""
    t, half = F.col("t"), F.expr("size(t) div 2")
    rows = passages(spark, folder).select("qid", T.tokens(F.col("text")).alias("t")).where(F.size("t") >= 2)
    return rows.select(F.col("qid").alias("rid"), F.concat(F.slice(t, F.lit(1), half), F.array(F.lit("zzqxj")), F.slice(t, half + 1, F.size(t))).alias("toks"))


GREEDY = f"""runs AS MATERIALIZED (SELECT qid AS rid, list_concat(t[1:len(t) // 2], ['zzqxj'], t[len(t) // 2 + 1:]) AS t FROM (SELECT qid, {TOKS('text')} AS t FROM queries) WHERE len(t) >= 2),
 {DGRAMS.format(n=12)}, win AS (SELECT rid, i, k, array_to_string(t[i + 1:i + k], ' ') AS phrase FROM (SELECT rid, t, unnest(range(0, len(t))) AS i FROM runs), LATERAL (SELECT unnest(range(1, least(12, len(t) - i) + 1)) AS k)),
 grounded AS (SELECT DISTINCT phrase FROM win WHERE phrase IN (SELECT phrase FROM dgrams)),
 longest AS MATERIALIZED (SELECT rid, i, max(k) AS k FROM win JOIN grounded USING (phrase) GROUP BY rid, i),
 walk AS (SELECT rid, -1 AS i, 0::BIGINT AS nxt, 0 AS took FROM runs UNION ALL
   SELECT w.rid, w.nxt, CASE WHEN k IS NULL THEN w.nxt + 1 ELSE w.nxt + k END, coalesce(k, 0) FROM walk w JOIN runs USING (rid) LEFT JOIN longest l ON l.rid = w.rid AND l.i = w.nxt WHERE w.nxt < len(t)),
 pieces AS (SELECT rid, i, took, array_to_string(t[i + 1:i + took], ' ') AS piece FROM walk JOIN runs USING (rid) WHERE took > 0),
 kept AS (SELECT * FROM pieces p WHERE NOT (took = 1 AND (SELECT count(*) FROM pieces x WHERE x.rid = p.rid) > 1 AND (SELECT max(took) FROM pieces x WHERE x.rid = p.rid) > 1))"""


@query(f"WITH RECURSIVE {INDEX}, {GREEDY} SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY i) - 1 AS pos, piece FROM kept")
def segment_greedy(spark: SparkSession, folder: str) -> DataFrame:
    return extract.segment_greedy(mixed_runs(spark, folder), documents(spark, folder))


@query()
def segment_rarity_dp(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return extract.segment_rarity(mixed_runs(spark, folder), docs, indexed(spark, folder).terms, docs.count())


def heard(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences as sessions of six turns."""
    rows = said(spark, folder).select(F.expr("qid div 6").alias("sid"), (F.col("qid") % 6 + 1).cast("int").alias("turn"), "text")
    return dialogue.read_messages(rows, documents(spark, folder))


@query()
def dialogue_state_fold(spark: SparkSession, folder: str) -> DataFrame:
    turns = dialogue.fold(heard(spark, folder))
    return turns.select("sid", "turn", "kind", "n_active", F.array_join("active", " | ").alias("active"), "n_revoked", F.size("disclosed").alias("n_disclosed"))


@query()
def turn_responses(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.responses(dialogue.fold(heard(spark, folder)))


GATE = "(turn >= 5 OR slots >= 3 OR (pool > 0 AND pool <= 5))"


@query(f"SELECT conv_id, turn, {GATE} AS emit FROM (SELECT conv_id, turn, len(string_split(text, '.')) % 4 AS slots, len(text) % 17 AS pool FROM conversations WHERE text IS NOT NULL)")
def emission_gate(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "conversations").where("text is not null").select("conv_id", "turn", (F.size(F.split("text", "[.]", -1)) % 4).alias("slots"), (F.length("text") % 17).alias("pool"))
    return rows.select("conv_id", "turn", dialogue.emit_column(F.col("turn"), F.col("slots"), F.col("pool")).alias("emit"))


# --- simulation -----------------------------------------------------------------------------------------------

def shop(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The products as a catalog with cards, and a session that looks for each of the stated ones (numbers divisible by 20)."""
    c = cards(spark, folder).withColumn("category", F.concat_ws(" ", "type", "brand"))
    kinds = F.element_at(F.array(*map(F.lit, ("buying", "browsing", "intent_override", "boundary"))), (F.expr("doc div 20") % 4 + 1).cast("int"))
    sessions = c.where("doc % 20 = 0").select(F.concat(F.lit("s"), "doc").alias("sample_id"), kinds.alias("scenario_type"), F.col("doc").alias("target"), "category", "card")
    rated = products(spark, folder).select("doc", "ratings", "average", "price")
    text = F.concat_ws(" ", "text", F.array_join("card", " "))
    return c.select("doc", text.alias("text"), "category", "card").join(rated, "doc"), sessions


def the_agent(catalog: DataFrame):
    return agent.Agent(catalog)


@query()
def agent_turn(spark: SparkSession, folder: str) -> DataFrame:
    """What the agent shows and asks after the first message of each session."""
    catalog, sessions = shop(spark, folder)
    opened = simulate.open_sessions(simulate.hidden(sessions.withColumn("level", F.lit("L0"))))
    shown, replies = agent.Agent(catalog, Settings(gate="always"))(opened.select(F.col("sample_id").alias("sid"), F.lit(1).alias("turn"), "message"), 1)
    return replies.select("sid", "ask", "n_active", "pool").join(shown, "sid").select("sid", "ask", "n_active", "pool", "doc", "rnk")


@query()
def simulated_sessions(spark: SparkSession, folder: str) -> DataFrame:
    catalog, sessions = shop(spark, folder)
    return simulate.run(sessions, the_agent(catalog)).drop("level")


@query()
def composite_by_scenario(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics of the agent's sessions, for each scenario and for all of them (no scenario)."""
    catalog, sessions = shop(spark, folder)
    return evaluate.summary(materialized(simulate.run(sessions, the_agent(catalog)), "results"), "scenario_type")


@query(f"""WITH {CARDS}, s AS (SELECT 's' || doc AS sample_id, ['buying', 'browsing', 'intent_override', 'boundary'][(doc // 20) % 4 + 1] AS kind, type || ' ' || brand AS category, card FROM cards JOIN products USING (doc) WHERE doc % 20 = 0)
 SELECT sample_id, CASE WHEN kind = 'buying' THEN 'I''m looking for ' || category || '. A key requirement is: ' || card[1] || '.' WHEN kind = 'intent_override' THEN 'I''m looking for ' || category || '. ' || CASE WHEN len(card) > 2 THEN card[-1] ELSE card[1] END ELSE 'I''m looking for ' || category || ', but I''m still exploring.' END AS message FROM s""")
def simulated_openings(spark: SparkSession, folder: str) -> DataFrame:
    return simulate.open_sessions(simulate.hidden(shop(spark, folder)[1].withColumn("level", F.lit("L0")))).select("sample_id", "message")


# --- measuring ------------------------------------------------------------------------------------------------

RESULTS = """results AS (SELECT doc_id AS idx0, ['buying', 'browsing', 'intent_override', 'boundary'][doc_id % 4 + 1] AS scenario_type, n_chars % 11 <> 0 AS hit, CASE WHEN n_chars % 11 <> 0 THEN n_chars % 10 + 1 END AS first_hit_turn,
   CASE WHEN n_chars % 11 <> 0 THEN 1.0::DOUBLE / (n_chars % 7 + 1) ELSE 0.0::DOUBLE END AS reciprocal_rank, CASE WHEN n_chars % 13 <> 0 THEN 1.0::DOUBLE / (n_chars % 5 + 1) ELSE 0.0::DOUBLE END AS other_rank FROM documents)"""


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Session results as a function of document lengths, so that both engines have the same."""
    n, hit = F.col("n_chars"), F.col("n_chars") % 11 != 0
    kind = F.element_at(F.array(*map(F.lit, ("buying", "browsing", "intent_override", "boundary"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return read(spark, folder, "documents").select(
        F.col("doc_id").alias("idx0"), kind.alias("scenario_type"), hit.alias("hit"), F.when(hit, n % 10 + 1).alias("first_hit_turn"),
        F.when(hit, F.lit(1.0) / (n % 7 + 1)).otherwise(F.lit(0.0)).alias("reciprocal_rank"), F.when(n % 13 != 0, F.lit(1.0) / (n % 5 + 1)).otherwise(F.lit(0.0)).alias("other_rank"),
    )


METRICS = "count(*) AS sessions, round(avg(hit::INT), 6) AS hit_rate, round(avg(reciprocal_rank), 6) AS mrr, round(avg(CASE WHEN hit THEN first_hit_turn ELSE 11 END), 6) AS mttc"
COMPOSITE = "0.5 * {h} + 0.3 * {m} + 0.2 * least(greatest((11.0 - {t}) / 10.0, 0.0), 1.0)"


@query(f"WITH {RESULTS}, m AS (SELECT {METRICS} FROM results) SELECT *, round({COMPOSITE.format(h='hit_rate', m='mrr', t='mttc')}, 6) AS composite FROM m")
def session_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.summary(results(spark, folder))


@query(f"WITH {RESULTS}, m AS (SELECT scenario_type, {METRICS} FROM results GROUP BY ROLLUP (scenario_type)) SELECT *, round({COMPOSITE.format(h='hit_rate', m='mrr', t='mttc')}, 6) AS composite FROM m")
def scenario_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.summary(results(spark, folder), "scenario_type")


@query("""WITH v AS (SELECT unnest([lang, source]) AS tag, (n_chars % 10)::DOUBLE AS a, (n_chars % 7)::DOUBLE AS b, (n_chars % 11)::DOUBLE AS c FROM documents),
 m AS (SELECT tag, round(avg(a), 6) AS a, round(avg(b), 6) AS b, round(avg(c), 6) AS c FROM v GROUP BY tag)
 SELECT *, CASE WHEN greatest(a, b, c) = least(a, b, c) THEN NULL WHEN a = greatest(a, b, c) THEN 'a' WHEN b = greatest(a, b, c) THEN 'b' ELSE 'c' END AS winner FROM m""")
def tag_crosstab_winner(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("n_chars")
    runs = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), (n % k).cast("double").alias("value")) for r, k in (("a", 10), ("b", 7), ("c", 11))]))
    rows = read(spark, folder, "documents").select(F.array("lang", "source").alias("tags"), runs.alias("r")).select("tags", "r.run", "r.value")
    return evaluate.crosstab(rows, ["a", "b", "c"])


SHOWN = f"shown AS (SELECT qid AS sample_id, 1 + (rnk - 1) // 10 AS turn, doc, (rnk - 1) % 10 + 1 AS rnk FROM {TOP(SCORED('qterms'), 40)}), targets AS (SELECT qid AS sample_id, max(CASE WHEN rnk = 1 + qid % 45 THEN doc END) AS target FROM {TOP(SCORED('qterms'), 45)} GROUP BY qid)"


@query(f"""WITH {INDEX}, {SHOWN}, f AS (SELECT sample_id, min(turn) AS turn FROM shown JOIN targets USING (sample_id) WHERE doc = target GROUP BY sample_id)
 SELECT t.sample_id, f.turn IS NOT NULL AS hit, f.turn AS first_hit_turn, s.rnk AS best_rank, round(coalesce(1.0 / s.rnk, 0), 6) AS reciprocal_rank FROM targets t LEFT JOIN f USING (sample_id) LEFT JOIN shown s ON s.sample_id = t.sample_id AND s.turn = f.turn AND s.doc = t.target WHERE t.target IS NOT NULL""")
def first_hit_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Each ranking dealt to turns of ten; the target is the document at some place of it."""
    asked = passages(spark, folder)
    ranked = retrieval.bm25(asked, indexed(spark, folder, asked), 45)
    shown = ranked.where("rnk <= 40").select(F.col("qid").alias("sample_id"), (F.expr("(rnk - 1) div 10") + 1).alias("turn"), "doc", ((F.col("rnk") - 1) % 10 + 1).alias("rnk"))
    targets = ranked.where("rnk = 1 + qid % 45").select(F.col("qid").alias("sample_id"), F.col("doc").alias("target"))
    return evaluate.first_hits(shown, targets).withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


DRAWS = """numbered AS (SELECT *, row_number() OVER (ORDER BY idx0) - 1 AS idx FROM results), n AS (SELECT count(*) AS n FROM numbered),
 draws AS (SELECT i, ((((((i * 1103515245 + j * 12345 + 1) % 2147483647) * 48271) % 2147483647) * 69621 + j) % 2147483647) % n AS idx FROM range(1000) r(i), n, LATERAL (SELECT unnest(range(0, n)) AS j))"""


def sampled(spark: SparkSession, folder: str) -> DataFrame:
    """All results, numbered from 0 for the resampling."""
    return evaluate.numbered(results(spark, folder), "idx0")


@query(f"""WITH {RESULTS}, {DRAWS}, s AS (SELECT i, round({COMPOSITE.format(h='avg(hit::INT)', m='avg(reciprocal_rank)', t='avg(CASE WHEN hit THEN first_hit_turn ELSE 11 END)')}, 9) AS s FROM draws JOIN numbered USING (idx) GROUP BY i)
 SELECT round(avg(s), 6) AS mean, round(quantile_cont(s, 0.025), 6) AS lo, round(quantile_cont(s, 0.975), 6) AS hi FROM s""")
def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    turn = F.when(F.col("hit"), F.col("first_hit_turn")).otherwise(F.lit(evaluate.MISS))
    return evaluate.bootstrap(sampled(spark, folder).select("idx", F.col("hit").cast("double").alias("hit"), F.col("reciprocal_rank").alias("rr"), turn.alias("turn")))


@query(f"""WITH {RESULTS}, {DRAWS}, s AS (SELECT i, round(avg(other_rank) - avg(reciprocal_rank), 9) AS d FROM draws JOIN numbered USING (idx) GROUP BY i)
 SELECT round(avg(d), 6) AS delta, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi, round(avg((d > 0)::INT), 6) AS p_positive FROM s""")
def paired_bootstrap_delta(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.paired_bootstrap(sampled(spark, folder).select("idx", F.col("reciprocal_rank").alias("a"), F.col("other_rank").alias("b")))


@query("""WITH c AS (SELECT source, count(*) AS n, count_if(n_chars % 3 = 0)::BIGINT AS k FROM documents GROUP BY source), p AS (SELECT *, k / n AS p, 1.96 * 1.96 AS zz FROM c)
 SELECT source, n, k, round(greatest((p + zz / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n), 0), 6) AS lo, round(least((p + zz / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n), 1), 6) AS hi FROM p""")
def wilson_interval(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") % 3 == 0).alias("k"))
    low, high = evaluate.wilson(F.col("k"), F.col("n"))
    return rows.select("source", "n", "k", F.round(low, 6).alias("lo"), F.round(high, 6).alias("hi"))


@query("""SELECT doc_id, source, depth FROM (SELECT doc_id, source, (doc_id * 48271 + 7) % 2147483647 AS mixed, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 48271 + 7) % 2147483647, doc_id) AS depth FROM documents) ORDER BY depth, mixed, doc_id LIMIT 50""")
def stratified_round_robin(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.round_robin(read(spark, folder, "documents").select("doc_id", "source"), "source", "doc_id", 50)


@query("""SELECT conv_id AS conv, turn, string_agg(coalesce(text, ''), ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS transcript FROM conversations""")
def turn_prefix_transcript(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.prefixes(read(spark, folder, "conversations").select(F.col("conv_id").alias("conv"), "turn", "text"))


PAIRS = f"turns AS (SELECT conv_id, turn, {TOKS('text')} AS toks, {TOKS('string_split(text, chr(10))[1]')} AS head, lead({TOKS('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)"


def turn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    rows = read(spark, folder, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("toks"), T.tokens(F.substring_index("text", "\n", 1)).alias("head"))
    return rows.withColumn("nxt", F.lead("toks").over(Window.partitionBy("conv_id").orderBy("turn"))).where("nxt is not null")


@query(f"""WITH {PAIRS}, c AS (SELECT conv_id, turn, list_distinct(list_filter(toks, lambda t: t NOT IN ({STOP}) AND len(t) >= 3)) AS said, nxt FROM turns WHERE nxt IS NOT NULL)
 SELECT conv_id, turn, round(CASE WHEN len(said) = 0 THEN 0.0 ELSE len(list_intersect(said, nxt)) / len(said) END, 6) AS overlap FROM c""")
def verbatim_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return turn_pairs(spark, folder).select("conv_id", "turn", F.round(T.overlap(T.content(F.col("toks"), 3), F.col("nxt")), 6).alias("overlap"))


@query(f"""WITH {PAIRS}, g AS (SELECT conv_id, turn, {{a}} AS a, {{b}} AS b FROM turns WHERE nxt IS NOT NULL) SELECT conv_id, turn, list_has_any(a, b) AS lifted FROM g""".replace("{a}", "list_transform(range(1, greatest(len(head) - 3, 0) + 1), lambda i: array_to_string(head[i:i + 3], ' '))").replace("{b}", "list_transform(range(1, greatest(len(nxt) - 3, 0) + 1), lambda i: array_to_string(nxt[i:i + 3], ' '))"))
def title_4gram_lift(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a turn lifts four words in a row from the title (first line) of the turn before."""
    return turn_pairs(spark, folder).select("conv_id", "turn", F.arrays_overlap(T.ngrams(F.col("head"), 4), T.ngrams(F.col("nxt"), 4)).alias("lifted"))


JAC = "CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


@query(f"""WITH {PAIRS}, d AS (SELECT conv_id, turn, list_distinct(toks) AS a, list_distinct(nxt) AS b FROM turns WHERE nxt IS NOT NULL) SELECT conv_id, turn, round({JAC.format(a='a', b='b')}, 6) AS similarity, {JAC.format(a='a', b='b')} > 0.7 AS restates FROM d""")
def restated_turns(spark: SparkSession, folder: str) -> DataFrame:
    rows = turn_pairs(spark, folder).select("conv_id", "turn", T.jaccard(F.col("toks"), F.col("nxt")).alias("s"))
    return rows.select("conv_id", "turn", F.round("s", 6).alias("similarity"), (F.col("s") > 0.7).alias("restates"))


PROBES = f"""t AS (SELECT conv_id, list(text ORDER BY turn) AS turns FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY conv_id),
 c AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'negation' ELSE 'plain' END AS style, CASE WHEN conv_id % 25 <> 0 THEN turns END AS turns, {TOKS("string_split(coalesce(d.text, ''), chr(10))[1]")} AS title, {TOKS("coalesce(d.text, '')")} AS product FROM t LEFT JOIN documents d ON doc_id = conv_id),
 w AS (SELECT *, list_transform(coalesce(turns, []), lambda x: {TOKS('x')}) AS toks FROM c),
 v AS (SELECT *, list_distinct(list_filter(flatten(toks), lambda x: x NOT IN ({STOP}) AND len(x) >= 3)) AS said FROM w),
 o AS (SELECT *, CASE WHEN len(said) = 0 THEN 0.0 ELSE len(list_intersect(said, product)) / len(said) END AS share FROM v),
 f AS (SELECT *, len(list_filter(turns, lambda x: len(list_filter(string_split_regex(x, '\\s+'), lambda y: y <> '')) NOT BETWEEN 2 AND 30)) > 0 AS bad_length,
  len(list_filter(range(1, len(toks)), lambda i: {JAC.format(a='list_distinct(toks[i])', b='list_distinct(toks[i + 1])')} > 0.7)) > 0 AS again,
  len(list_filter(turns, lambda x: regexp_matches(x, {Q(probes.NEGATIONS)}))) > 0 AS negates,
  list_has_any(list_transform(range(1, greatest(len(title) - 3, 0) + 1), lambda i: array_to_string(title[i:i + 3], ' ')), flatten(list_transform(toks, lambda t: list_transform(range(1, greatest(len(t) - 3, 0) + 1), lambda i: array_to_string(t[i:i + 3], ' '))))) AS lifts FROM o),
 guards AS (SELECT conv_id, round(share, 3) AS overlap, CASE WHEN turns IS NULL THEN 'unparseable' WHEN len(turns) NOT BETWEEN 2 AND 6 THEN 'turn_count' WHEN bad_length THEN 'turn_length' WHEN again THEN 'restates' WHEN style = 'negation' AND NOT negates THEN 'no_negation'
  WHEN share > 0.6 THEN 'copied' WHEN share < 0.05 THEN 'off_target' WHEN lifts THEN 'title_ngram' END AS reason FROM f)"""


def conversation_probes(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as probes for the document of their number: every third claims to negate, and of every 25th the reply could not be read."""
    said = read(spark, folder, "conversations").where("role = 'user' and text is not null").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t.text).alias("turns"))
    docs = read(spark, folder, "documents").select(F.col("doc_id").alias("conv_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("product"))
    style = F.when(F.col("conv_id") % 3 == 0, "negation").otherwise("plain")
    return said.withColumn("style", style).withColumn("turns", F.when(F.col("conv_id") % 25 != 0, F.col("turns"))).join(docs, "conv_id", "left")


@query(f"WITH {PROBES} SELECT * FROM guards")
def probe_guards(spark: SparkSession, folder: str) -> DataFrame:
    return probes.guarded(conversation_probes(spark, folder)).select("conv_id", "overlap", "reason")


@query(f"WITH {PROBES} SELECT coalesce(reason, 'ok') AS reason, count(*) AS n, sum(conv_id % 7)::BIGINT AS tokens, quantile_cont((conv_id % 11)::DOUBLE, 0.5) AS median_latency FROM guards GROUP BY 1")
def probe_guard_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why probes were refused, and what the calls cost (tokens and seconds are functions of the number here)."""
    judged = probes.guarded(conversation_probes(spark, folder)).withColumn("tokens", F.col("conv_id") % 7).withColumn("latency", (F.col("conv_id") % 11).cast("double"))
    return probes.report(judged)


AGREED = "(p + 1.96 * 1.96 / (2 * n) {s} 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)"


@query(f"""WITH s AS (SELECT CASE WHEN quality = 1 THEN 'Yes' WHEN quality = 0 THEN 'no' ELSE '' END AS phrasing, CASE WHEN toxic = 0 THEN ' y' ELSE 'n' END AS target_ok, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'n' ELSE 'y' END AS tag_ok FROM labels),
 c AS (SELECT lower(trim(coalesce(phrasing, ''))) AS a, lower(trim(coalesce(target_ok, ''))) AS b, lower(trim(coalesce(tag_ok, ''))) AS c FROM s),
 r AS (SELECT 'phrasing' AS axis, count_if(a LIKE 'y%') AS k, count_if(a <> '') AS n FROM c UNION ALL SELECT 'target_ok', count_if(b LIKE 'y%'), count_if(b <> '') FROM c UNION ALL SELECT 'tag_ok', count_if(c LIKE 'y%'), count_if(c <> '') FROM c
  UNION ALL SELECT 'all', count_if(a LIKE 'y%' AND b LIKE 'y%' AND c LIKE 'y%'), count_if(a <> '' AND b <> '' AND c <> '') FROM c), p AS (SELECT *, k / n AS p FROM r)
 SELECT axis, k::BIGINT AS agreed, n::BIGINT AS judged, round(p, 6) AS rate, round(greatest({AGREED.format(s='-')}, 0), 6) AS lo, round(least({AGREED.format(s='+')}, 1), 6) AS hi FROM p""")
def agreement_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as a sheet that people have filled: agreement on each axis, and on all."""
    cells = read(spark, folder, "labels").select(
        F.when(F.col("quality") == 1, "Yes").when(F.col("quality") == 0, "no").otherwise("").alias("phrasing"), F.when(F.col("toxic") == 0, " y").otherwise("n").alias("target_ok"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 3 == 0, "n").otherwise("y").alias("tag_ok"),
    )
    return probes.agreement(cells)


@query(f"""WITH {INDEX}, b AS (SELECT qid, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS term FROM (SELECT qid, {TOKS('text')} AS t FROM queries)),
 r AS (SELECT qid, pos, term, row_number() OVER (PARTITION BY qid ORDER BY round(idf, 9) DESC, pos) AS r, greatest(1, round(count(*) OVER (PARTITION BY qid) * 0.4)) AS d FROM b JOIN terms USING (term))
 SELECT qid AS rid, coalesce(string_agg(term, ' ' ORDER BY pos) FILTER (WHERE r > d), '') AS kept FROM r GROUP BY qid""")
def rare_token_ablation(spark: SparkSession, folder: str) -> DataFrame:
    ix = indexed(spark, folder)
    toks = passages(spark, folder).select(F.col("qid").alias("rid"), F.posexplode(T.tokens(F.col("text"))).alias("pos", "term")).join(ix.terms.select("term", "idf"), "term")
    return evaluate.rare_tokens_dropped(toks, 0.4)


@query("""WITH s AS (SELECT l_orderkey AS sid, l_linenumber AS pos, CASE WHEN l_linenumber % 3 = 0 THEN 'bad' WHEN l_linenumber % 2 = 0 THEN ' ' || l_partkey % 50 || ' ' ELSE (l_partkey % 50)::VARCHAR END AS item FROM lineitem),
 f AS (SELECT sid, trim(item) AS item, min(pos) AS pos FROM s WHERE trim(item) IN (SELECT p_partkey::VARCHAR FROM part) GROUP BY ALL)
 SELECT sid, item, rnk FROM (SELECT sid, item, row_number() OVER (PARTITION BY sid ORDER BY pos, item) AS rnk FROM f) WHERE rnk <= 10""")
def recommendation_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as recommendations of an order: some unknown, some padded, some twice."""
    k = (F.col("l_partkey") % 50).cast("string")
    item = F.when(F.col("l_linenumber") % 3 == 0, F.lit("bad")).when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" "), k, F.lit(" "))).otherwise(k)
    rows = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("sid"), F.struct("l_linenumber", F.trim(item)).alias("pos"), item.alias("item"))
    return evaluate.valid_recommendations(rows, read(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("item")))


@query("""SELECT (SELECT count(*) FROM (SELECT doc_id, n_chars FROM documents EXCEPT ALL SELECT doc_id, len(text) FROM documents)) AS only_a, (SELECT count(*) FROM (SELECT doc_id, len(text) FROM documents EXCEPT ALL SELECT doc_id, n_chars FROM documents)) AS only_b, (SELECT count(*) FROM (SELECT doc_id, n_chars FROM documents INTERSECT ALL SELECT doc_id, len(text) FROM documents)) AS both""")
def mirror_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Stored lengths against counted ones."""
    d = read(spark, folder, "documents")
    return evaluate.mirror(d.select("doc_id", "n_chars"), d.select("doc_id", F.length("text").cast("long").alias("n_chars")))


@query(f"""WITH {INDEX}, t AS (SELECT item_id AS qid, {TOKS('text')} AS toks FROM benchmark), s AS (SELECT qid, unnest(list_distinct(list_filter(toks, lambda t: t NOT IN ({STOP}) AND len(t) > 2))) AS term FROM t),
 j AS (SELECT s.qid, s.term, terms.df IS NULL AS unknown, tf.doc IS NULL AS absent FROM s LEFT JOIN terms USING (term) LEFT JOIN tf ON tf.term = s.term AND tf.doc = s.qid)
 SELECT t.qid, count_if(unknown)::BIGINT AS unknown, count_if(absent AND NOT unknown)::BIGINT AS missing, CASE WHEN count_if(unknown) > 0 THEN 'unknown words' WHEN count_if(absent) > 0 THEN 'words not on the target' ELSE 'outranked' END AS reason FROM t LEFT JOIN j USING (qid) GROUP BY t.qid""")
def failure_diagnosis(spark: SparkSession, folder: str) -> DataFrame:
    """Why passage q might not find document q: words that no document has, or that others have."""
    ix = indexed(spark, folder)
    asked = passages(spark, folder)
    words = asked.select("qid", F.explode(F.array_distinct(T.content(T.tokens(F.col("text")), 3))).alias("term"))
    own = ix.tf.select(F.col("doc").alias("qid"), "term", F.lit(1).alias("here"))
    each = words.join(ix.terms.select("term", "df"), "term", "left").join(own, ["qid", "term"], "left")
    sums = each.groupBy("qid").agg(F.count_if(F.col("df").isNull()).alias("unknown"), F.count_if(F.col("df").isNotNull() & F.col("here").isNull()).alias("missing"))
    out = asked.select("qid").join(sums, "qid", "left").fillna(0, ["unknown", "missing"])
    return out.withColumn("reason", F.when(F.col("unknown") > 0, "unknown words").when(F.col("missing") > 0, "words not on the target").otherwise("outranked"))


@query("SELECT sum(CASE WHEN k >= 0 THEN k ELSE 0 END)::BIGINT AS prompt_tokens, count_if(k >= 0)::BIGINT AS counted FROM (SELECT CAST(props->>'k' AS BIGINT) - 10 AS k FROM events)")
def token_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Usage out of semi-structured rows; what is negative or no number doesn't count."""
    k = F.get_json_object("props", "$.k").try_cast("long") - 10
    rows = read(spark, folder, "events").select(k.alias("k"))
    return rows.agg(F.coalesce(F.sum(F.when(F.col("k") >= 0, F.col("k"))), F.lit(0)).alias("prompt_tokens"), F.count_if(F.col("k") >= 0).alias("counted"))


# --- streams --------------------------------------------------------------------------------------------------

@query("SELECT conv_id, count(*) AS turns, count_if(role = 'user')::BIGINT AS user_turns, sum(len(coalesce(text, '')))::BIGINT AS chars, max(turn) AS last_turn FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id")
def stream_session_state(spark: SparkSession, folder: str) -> DataFrame:
    return streams.conversation_state(spark, folder)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def stream_windowed_counts(spark: SparkSession, folder: str) -> DataFrame:
    return streams.windowed_counts(spark, folder).withColumn("value", F.round("value", 4))


@query("""WITH g AS (SELECT *, (ts - lag(ts) OVER w) >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events, round(sum(value), 4) AS value FROM s GROUP BY user_id, n""")
def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return streams.sessions(read(spark, folder, "events")).withColumn("value", F.round("value", 4))
