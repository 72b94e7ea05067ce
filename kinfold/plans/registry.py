"""Queries by name, and SQL that gives the same rows in DuckDB where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compare as cmp
from ..functions import text
from ..functions.ascii import ascii_fold
from ..operators import candidates, decode, features, graph, learn, metrics, mining, noise, postings, simjoin
from ..operators import views as tv
from ..operators.checkpoints import stored
from ..operators.normalize import normalize
from ..sources import tsv
from . import views as v

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- SQL that several queries begin with ---------------------------------------------------------------
RECORDS = r"""
doc AS (SELECT doc_id, lang, n_chars, text, string_split_regex(trim(text), '\s+') AS w FROM documents),
rec AS (SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, array_to_string(w[1:8], ' ') AS business_name,
  array_to_string(w[greatest(len(w) - 7, 1):len(w)], ' ') AS business_address, lang AS country, doc_id % 3 + 1 AS source, n_chars, coalesce(text, '') AS text FROM doc)"""
TOKENS = RECORDS + r""",
tok AS (SELECT entity_id AS id, country, source, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM rec)"""


def tfidf_sql(population: str, tokens: str = "tok", copies: int = 1, which: str = " WHERE df <= 5000") -> str:
    """CTEs df, idf, wt over the token table; population is a condition on its source, which one on the tokens that weigh something."""
    return f""",
tf AS (SELECT country, id, source, token, count(*) AS tf FROM {tokens} GROUP BY ALL),
n AS (SELECT country, count(*) * {copies} AS n FROM rec WHERE {population} GROUP BY country),
df AS (SELECT country, token, count(*) * {copies} AS df FROM tf WHERE {population} GROUP BY country, token),
idf AS (SELECT country, token, ln((1 + n) / (1 + df)) + 1 AS idf FROM df JOIN n USING (country){which}),
raw AS (SELECT country, id, source, token, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (country, token)),
wt AS (SELECT country, id, source, token, w / sqrt(sum(w * w) OVER (PARTITION BY country, id)) AS w FROM raw)"""


PAIRS = """
li AS (SELECT l_orderkey % 997 AS s, l_partkey AS c, max(((l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % 1000) / 1000.0) AS p FROM lineitem GROUP BY 1, 2),
pairs AS (SELECT 'S1-' || s AS s1_id, 'S' || (c % 2 + 2) || '-' || c AS cand_id, CAST(p AS DOUBLE) AS p, CAST((s * 13 + c * 7) % 4 = 0 AS INTEGER) AS label FROM li)"""
OWNED = PAIRS + """,
owned AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY p DESC, s1_id) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cand_id) - 1 AS pos, max(p) OVER (PARTITION BY s1_id) AS p_top FROM owned)"""
CHOSEN = OWNED + """,
chosen AS (SELECT * FROM placed WHERE (pos = 0 AND p >= 0.5) OR (pos > 0 AND p_top >= 0.5 AND p >= 0.6 AND p >= 0.7 * p_top)),
ent AS (SELECT s1_id, count(*) FILTER (WHERE label = 1) AS n_true FROM pairs GROUP BY s1_id),
per AS (SELECT s1_id, n_true, count(cand_id) AS n, coalesce(sum(c.label), 0) AS tp FROM ent LEFT JOIN chosen c USING (s1_id) GROUP BY ALL),
f05 AS (SELECT s1_id, CASE WHEN n_true = 0 THEN CAST(n = 0 AS DOUBLE) WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n) * (tp / n_true) / (0.25 * (tp / n) + tp / n_true) END AS f05 FROM per)"""
RULE = decode.Rule(0.5, 0.6, 0.7, True)
PARTS = "pp AS (SELECT x.p_partkey AS x, y.p_partkey AS y, x.p_name AS a, y.p_name AS b FROM part x JOIN part y USING (p_brand, p_type, p_size) WHERE x.p_partkey < y.p_partkey)"


# ---- scans, sources, sinks ------------------------------------------------------------------------------
@query(f"WITH {RECORDS} SELECT entity_id, business_name, business_address, country, source FROM rec")
def scan_records(spark: SparkSession, d: str) -> DataFrame:
    return v.records(spark, d).drop("n_chars")


TRUTH_SQL = RECORDS + """,
truth AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id FROM rec a JOIN rec b USING (business_name, country)
  WHERE a.source = 1 AND b.source > 1 AND 20 * abs(a.n_chars - b.n_chars) <= greatest(a.n_chars, b.n_chars))"""


@query(f"WITH {TRUTH_SQL} SELECT * FROM truth")
def truth_pairs(spark: SparkSession, d: str) -> DataFrame:
    return v.weak_truth(spark, d)


@query(f"WITH {TRUTH_SQL} SELECT entity_id AS s1_id, coalesce(string_agg(cand_id, ',' ORDER BY cand_id), '') AS truth FROM rec LEFT JOIN truth ON entity_id = s1_id WHERE source = 1 GROUP BY entity_id")
def truth_lists(spark: SparkSession, d: str) -> DataFrame:
    entities = v.records(spark, d).where("source = 1").select(F.col("entity_id").alias("s1_id"))
    return tsv.truth_map(v.weak_truth(spark, d), entities).select("s1_id", F.array_join("truth", ",").alias("truth"))


@query(f"WITH {TRUTH_SQL} SELECT s1_id, unnest(string_split(l, ',')) AS cand_id FROM (SELECT s1_id, string_agg(cand_id, ',') AS l FROM truth GROUP BY s1_id)")
def truth_explode(spark: SparkSession, d: str) -> DataFrame:
    lists = v.weak_truth(spark, d).groupBy("s1_id").agg(F.array_join(F.collect_list("cand_id"), ",").alias("l"))
    return lists.select("s1_id", F.explode(F.split("l", ",")).alias("cand_id")).where("cand_id <> ''")


@query(f"WITH {CHOSEN} SELECT s1_id AS source1_entity_id, coalesce(string_agg(cand_id, ',' ORDER BY pos), '') AS matched_entity_ids FROM ent LEFT JOIN chosen USING (s1_id) GROUP BY s1_id")
def match_list_sink(spark: SparkSession, d: str) -> DataFrame:
    pairs = v.scored_pairs(spark, d)
    entities = pairs.select("s1_id").distinct()
    return tsv.id_lists(decode.match_lists(decode.decode(pairs, RULE), entities), entities, "pred", "matched_entity_ids")


@query(f"WITH {RECORDS}, {PAIRS} SELECT p.s1_id, p.cand_id, p, p > 0.02 AND p < 0.98 AS uncertain, substr(business_name, 1, 20) AS name_a FROM pairs p LEFT JOIN rec r ON r.entity_id = p.s1_id WHERE p.p > 0.4 AND p.p < 0.6")
def export_band(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates.band(v.scored_pairs(spark, d), 0.4, 0.6)
    return tsv.export_pairs(rows, v.records(spark, d), most=20).select("s1_id", "cand_id", "p", "uncertain", "name_a")


# ---- normalisation ------------------------------------------------------------------------------------------
@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(url), '&', ' and '), '+', ' and '), '[^a-z0-9/\- ]+', ' ', 'g'), ' / ', ' ', 'g'), '\s+', ' ', 'g'), '^[ \-/]+|[ \-/]+$', '', 'g') AS cleaned FROM pages")
def clean_basic(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "pages").select("page_id", text.basic_clean(F.lower("url")).alias("cleaned"))


@query(r"SELECT page_id, regexp_matches(lower(url), '\b([a-z0-9][a-z0-9-]*)\.(com|net|org|in|co|fr|biz|info|us|io)\b') AS is_domain, regexp_extract(lower(url), 'https?://(?:www\.)?(?:[a-z0-9-]+\.)*?([a-z0-9][a-z0-9-]*)\.com\b', 1) AS label FROM pages")
def domain_unwrap(spark: SparkSession, d: str) -> DataFrame:
    url = F.lower(F.col("url"))
    bare = text.unwrap_domain(F.regexp_replace(url, r"^https?://(?:[a-z0-9-]+\.)*?(?=[a-z0-9-]+\.com\b)", ""))
    return v.table(spark, d, "pages").select("page_id", text.is_domain(url).alias("is_domain"), F.regexp_extract(bare, r"^ ([a-z0-9-]+) ", 1).alias("label"))


@query("""SELECT s_suppkey AS id, s_name AS name, array_to_string(list_transform(regexp_extract_all(s_name, '[0-9]+'), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ' ') AS nums FROM supplier
UNION ALL SELECT c_custkey, c_name, array_to_string(list_transform(regexp_extract_all(c_name, '[0-9]+'), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ' ') FROM customer""")
def extract_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).unionByName(v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    return rows.withColumn("nums", F.array_join(text.numbers(F.col("name")), " "))


SKELETON_SQL = """
WITH t AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part),
k AS (SELECT token, regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(token, 'ph', 'f'), 'x', 'ks'), 'q', 'k'), 'ck', 'k'), 'c', 'k'), 'w', 'v'), 'z', 'j'), 'y', 'i'), '([bdgjkprstv])h', '\\1', 'g') AS s FROM t),
l AS (SELECT token, string_split(substr(s, 1, 1) || regexp_replace(substr(s, 2), '[aeiou]', '', 'g'), '') AS c FROM k)
SELECT token, array_to_string(list_filter(c, lambda x, i: i = 1 OR x <> c[i - 1]), '') AS skeleton FROM l"""


@query(SKELETON_SQL)
def skeleton(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "part").select(F.explode(text.tokens(F.col("p_name"))).alias("token")).distinct().withColumn("skeleton", text.skeleton(F.col("token")))


@query(f"WITH {RECORDS} SELECT entity_id, CASE WHEN regexp_full_match(business_name, '[\\x00-\\x7f]*') THEN 'ascii' WHEN regexp_full_match(business_name, '[\\x00-\\x{{24f}}\\x{{1e00}}-\\x{{206f}}\\x{{20a0}}-\\x{{2122}}]*') THEN 'latin-accents' ELSE 'non-latin' END AS script FROM rec")
def script_kind(spark: SparkSession, d: str) -> DataFrame:
    return v.records(spark, d).select("entity_id", text.script(F.col("business_name")).alias("script"))


@query()
def normalized_records(spark: SparkSession, d: str) -> DataFrame:
    return normalize(v.records(spark, d))


@query()
def ascii_folded(spark: SparkSession, d: str) -> DataFrame:
    return v.records(spark, d).select("entity_id", ascii_fold(F.col("business_name")).alias("folded"))


@query()
def loose_keys(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "part").select("p_partkey", text.loose_skeleton(F.col("p_name")).alias("loose"), text.distinctive(F.col("p_name")).alias("distinctive"))


# ---- token views ----------------------------------------------------------------------------------------------
@query(f"WITH {RECORDS}, t AS (SELECT entity_id, regexp_extract_all(lower(text), '[a-z]+') AS a FROM rec) SELECT entity_id, array_to_string(list_transform(range(1, greatest(len(a), 1)), lambda i: 'b:' || a[i] || '_' || a[i + 1]), ' ') AS pairs FROM t")
def token_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return v.light(spark, d).select("entity_id", F.array_join(tv.bigrams("b:", F.col("toks")), " ").alias("pairs"))


@query("SELECT p_partkey, array_to_string(list_transform(range(1, length(p_name) + 1), lambda i: substr(' ' || p_name || ' ', i, 3)), '|') AS grams FROM part")
def char_trigrams(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "part").select("p_partkey", F.array_join(tv.char_ngrams(F.col("p_name")), "|").alias("grams"))


@query()
def retriever_views(spark: SparkSession, d: str) -> DataFrame:
    rows = normalize(v.records(spark, d))
    return rows.select("entity_id", *(F.size(r.view()).alias(f"n_{name}") for name, r in tv.RETRIEVERS.items()))


# ---- similarity joins -------------------------------------------------------------------------------------------
@query(f"WITH {TOKENS} SELECT country, token, count(DISTINCT id) AS df FROM tok GROUP BY country, token")
def token_df(spark: SparkSession, d: str) -> DataFrame:
    return simjoin.document_frequency(simjoin.term_counts(v.light(spark, d), v.word_view()))


@query(f"WITH {TOKENS}{tfidf_sql('true')} SELECT country, id, token, round(w, 6) AS w FROM wt")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = v.light(spark, d)
    counts = simjoin.term_counts(rows, v.word_view())
    return simjoin.weighted(counts, simjoin.idf(rows, counts, v.WORDS.max_df)).withColumn("w", F.round("w", 6))


TOPK = """,
sc AS (SELECT q.id AS s1_id, t.id AS cand_id, t.source AS src, round(sum(q.w * t.w), 6) AS score FROM wt q JOIN wt t USING (country, token) WHERE q.source = 1 AND t.source > 1 GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY s1_id, src ORDER BY score DESC, cand_id) AS rank FROM sc QUALIFY rank <= 20)"""


def _retrieved(spark: SparkSession, d: str, r: tv.Retriever) -> DataFrame:
    a, b = v.split_sources(v.light(spark, d))
    return simjoin.retrieve(a, b, r)


@query(f"WITH {TOKENS}{tfidf_sql('true', which='')}{TOPK} SELECT s1_id, cand_id, src, score, rank, 'words' AS retriever FROM top")
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return _retrieved(spark, d, v.EVERY_WORD)


REVERSE = """,
sc AS (SELECT q.id AS cand_id, t.id AS s1_id, round(sum(q.w * t.w), 6) AS score FROM wt q JOIN wt t USING (country, token) WHERE q.source > 1 AND t.source = 1 GROUP BY ALL),
rev AS (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY score DESC, s1_id) AS rank FROM sc QUALIFY rank <= 5)"""


def _reverse(spark: SparkSession, d: str) -> DataFrame:
    a, b = v.split_sources(v.light(spark, d))
    return simjoin.reverse_index(a, b, v.WORDS)


@query(f"WITH {TOKENS}{tfidf_sql('source = 1', copies=2)}{REVERSE} SELECT cand_id, s1_id, score, rank FROM rev")
def reverse_topk(spark: SparkSession, d: str) -> DataFrame:
    return _reverse(spark, d)


@query(f"WITH {TOKENS}{tfidf_sql('source = 1', copies=2)}{REVERSE} SELECT s1_id, cand_id, source AS src, score, rank, 'rev' AS retriever FROM rev JOIN rec ON entity_id = cand_id")
def reverse_candidates(spark: SparkSession, d: str) -> DataFrame:
    return simjoin.reverse_pairs(_reverse(spark, d), v.split_sources(v.light(spark, d))[1])


SIBLINGS = """,
sc AS (SELECT q.id AS cand_id, t.id AS nbr_id, t.source AS src, round(sum(q.w * t.w), 6) AS sib FROM wt q JOIN wt t USING (country, token) WHERE q.source > 1 AND t.source > 1 AND q.id <> t.id GROUP BY ALL),
near AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY cand_id, src ORDER BY sib DESC, nbr_id) <= 5),
sib AS (SELECT cand_id, row_number() OVER (PARTITION BY cand_id ORDER BY sib DESC, nbr_id) - 1 AS slot, nbr_id, sib FROM near QUALIFY slot < 8)"""


def _siblings(spark: SparkSession, d: str) -> DataFrame:
    return simjoin.siblings(v.split_sources(v.light(spark, d))[1], v.EVERY_WORD)


@query(f"WITH {TOKENS}{tfidf_sql('source > 1', which='')}{SIBLINGS} SELECT * FROM sib")
def sibling_topk(spark: SparkSession, d: str) -> DataFrame:
    return _siblings(spark, d)


@query("""WITH s AS (SELECT q.vec_id AS query, t.vec_id AS neighbour, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings t ON q.vec_id <> t.vec_id WHERE q.vec_id % 50 = 0)
SELECT query, neighbour, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS rank FROM s QUALIFY rank <= 10""")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return simjoin.dense_top_k(rows.where("id % 50 = 0"), rows, 10)


# ---- candidates and their features --------------------------------------------------------------------------------
PIVOT = """,
wide AS (SELECT s1_id, cand_id, any_value(src) AS cand_src, max(CASE WHEN retriever = 'words' THEN score END) AS score_words, min(CASE WHEN retriever = 'words' THEN rank END) AS rank_words,
  max(CASE WHEN retriever = 'rev' THEN score END) AS score_rev, min(CASE WHEN retriever = 'rev' THEN rank END) AS rank_rev FROM long GROUP BY s1_id, cand_id)"""
LONG = f"""{TOKENS}, words AS (WITH w0 AS (SELECT 1){tfidf_sql('true')}{TOPK} SELECT s1_id, cand_id, src, score, rank, 'words' AS retriever FROM top),
revs AS (WITH w0 AS (SELECT 1){tfidf_sql('source = 1', copies=2)}{REVERSE} SELECT s1_id, cand_id, source AS src, score, rank, 'rev' AS retriever FROM rev JOIN rec ON entity_id = cand_id),
long AS (SELECT * FROM words UNION ALL SELECT * FROM revs)"""


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Candidates of both retrievers, and the reverse index: over the same vectors, which are made once."""
    a, b = v.split_sources(v.light(spark, d))
    made = postings.bags(v.word_view(), a, b)
    found, index = simjoin.retrieved(made, v.WORDS, b), simjoin.reversed_index(made, v.WORDS)
    made.remove()
    return found.unionByName(simjoin.reverse_pairs(index, b)), index


def _long(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d)[0]


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return candidates.union_candidates(_long(spark, d), ["words", "rev"], by="cand_id")


@query(f"WITH {LONG}{PIVOT} SELECT * EXCLUDE (cand_src) FROM wide")
def candidate_pivot(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d)


@query(f"""WITH {LONG}{PIVOT}, b AS (SELECT *, CASE WHEN score_words IS NULL THEN 0 ELSE 1 END + CASE WHEN score_rev IS NULL THEN 0 ELSE 1 END AS n_retrievers, greatest(score_words, score_rev) AS best_score FROM wide)
SELECT s1_id, cand_id, CAST(n_retrievers AS INTEGER) AS n_retrievers, best_score, rank() OVER g AS rank_in_src, round(max(best_score) OVER (PARTITION BY s1_id, cand_src) - best_score, 6) AS gap_to_best_src, count(*) OVER (PARTITION BY s1_id, cand_src) AS n_cands_src,
 round(ln(1 + (SELECT count(*) FROM rec r WHERE r.source = 1 AND r.country = a.country AND r.business_name = a.business_name)), 6) AS name_freq_s1, round(ln(1 + (SELECT count(*) FROM rec r WHERE r.source > 1 AND r.country = a.country AND r.business_name = a.business_name)), 6) AS name_freq_tgt
FROM b JOIN rec a ON a.entity_id = s1_id WINDOW g AS (PARTITION BY s1_id, cand_src ORDER BY best_score DESC)""")
def context_features(spark: SparkSession, d: str) -> DataFrame:
    a, b = (x.withColumn("name_core", F.col("business_name")) for x in v.split_sources(v.light(spark, d)))
    out = candidates.context_features(_wide(spark, d), a, b)
    rounded = {c: F.round(c, 6) for c in ("gap_to_best_src", "name_freq_s1", "name_freq_tgt")}
    return out.withColumns(rounded).select("s1_id", "cand_id", "n_retrievers", "best_score", "rank_in_src", "gap_to_best_src", "n_cands_src", "name_freq_s1", "name_freq_tgt")


@query(f"""WITH {LONG}{PIVOT}, l AS (SELECT cand_id, max(CASE WHEN rank = 1 THEN score END) AS b, max(CASE WHEN rank = 2 THEN score END) AS s FROM revs GROUP BY cand_id)
SELECT w.s1_id, w.cand_id, coalesce(r.rank, 6) AS rev_rank, coalesce(r.score, 0) AS rev_self, coalesce(b, 0) AS rev_best, round(coalesce(b, 0) - coalesce(r.score, 0), 6) AS rev_gap, CAST(coalesce(r.rank, 6) = 1 AS DOUBLE) AS rev_is_best, coalesce(s, 0) AS rev_second
FROM wide w LEFT JOIN revs r USING (s1_id, cand_id) LEFT JOIN l ON l.cand_id = w.cand_id""")
def reverse_features(spark: SparkSession, d: str) -> DataFrame:
    long, index = _both(spark, d)
    wide = candidates.union_candidates(long, ["words", "rev"], by="cand_id")
    return candidates.reverse_features(wide.select("s1_id", "cand_id"), index).withColumn("rev_gap", F.round("rev_gap", 6))


@query(f"WITH {PAIRS} SELECT s1_id, cand_id, rank() OVER (PARTITION BY cand_id ORDER BY p DESC) AS comp_rank, round(max(p) OVER (PARTITION BY cand_id) - p, 6) AS comp_gap, count(*) OVER (PARTITION BY cand_id) AS comp_n FROM pairs")
def s1_competition(spark: SparkSession, d: str) -> DataFrame:
    out = candidates.s1_competition(v.scored_pairs(spark, d), "p")
    return out.select("s1_id", "cand_id", "comp_rank", F.round("comp_gap", 6).alias("comp_gap"), "comp_n")


@query("SELECT p_brand AS country, p_name AS name_core, count(*) AS freq FROM part WHERE p_size <= 25 AND (p_brand, p_name) IN (SELECT (p_brand, p_name) FROM part WHERE p_size > 25) GROUP BY ALL")
def name_frequency(spark: SparkSession, d: str) -> DataFrame:
    parts = v.table(spark, d, "part").select(F.col("p_brand").alias("country"), F.col("p_name").alias("name_core"), "p_size")
    return candidates.name_frequency(parts.where("p_size <= 25"), parts.where("p_size > 25"), "freq")


@query(f"WITH {PAIRS} SELECT s1_id, cand_id, p, label FROM pairs WHERE p >= 0.3 QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cand_id) <= 8")
def prune_top(spark: SparkSession, d: str) -> DataFrame:
    return candidates.prune(v.scored_pairs(spark, d), "p", 0.3, 8)


@query(f"WITH {PAIRS} SELECT p.s1_id, p.cand_id, CAST(t.s1_id IS NOT NULL AS INTEGER) AS label FROM pairs p LEFT JOIN (SELECT s1_id, cand_id FROM pairs WHERE p > 0.7) t USING (s1_id, cand_id)")
def pair_labels(spark: SparkSession, d: str) -> DataFrame:
    pairs = v.scored_pairs(spark, d)
    return candidates.add_labels(pairs.select("s1_id", "cand_id"), pairs.where("p > 0.7"))


@query(f"""WITH {PARTS}, s AS (SELECT *, list_distinct(string_split(a, ' ')) AS u, list_distinct(string_split(b, ' ')) AS w FROM pp)
SELECT x, y, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS lev, round(len(list_intersect(u, w)) / len(list_distinct(list_concat(u, w))), 6) AS jacc,
 round(len(list_intersect(u, w)) / least(len(u), len(w)), 6) AS overl, CAST(len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, 1, i) = substr(b, 1, i))) AS INTEGER) AS prefix, CAST(a = b AS DOUBLE) AS eq, CAST(contains(a, b) OR contains(b, a) AS DOUBLE) AS inside FROM s""")
def pair_similarities(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return v.part_pairs(spark, d).select("x", "y", F.round(cmp.levenshtein_sim(a, b), 6).alias("lev"), F.round(cmp.jaccard(a, b), 6).alias("jacc"), F.round(cmp.overlap(a, b), 6).alias("overl"), cmp.prefix_length(a, b).alias("prefix"), cmp.same(a, b).alias("eq"), cmp.contains(a, b).cast("double").alias("inside"))


@query(f"WITH {PARTS} SELECT x, y, round(jaro_winkler_similarity(a, b), 6) AS jw FROM pp")
def jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    return v.part_pairs(spark, d).select("x", "y", F.round(cmp.jaro_winkler_sim(F.col("a"), F.col("b")), 6).alias("jw"))


@query()
def token_ratios(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return v.part_pairs_by_name(spark, d, {"sort": cmp.token_sort_sim(a, b), "set": cmp.token_set_sim(a, b), "partial": cmp.partial_sim(a, b)})


@query("""WITH c AS (SELECT c_custkey, string_split(CAST(CAST(round(c_acctbal * 100) AS BIGINT) + 10000000 AS VARCHAR) || ' ' || c_custkey || ' ' || (c_nationkey + 100), ' ') AS a, string_split(CAST(c_custkey * 37 + 10 AS VARCHAR) || ' ' || (c_nationkey + 10), ' ') AS b FROM customer),
f AS (SELECT c_custkey, list_filter(a, lambda x: length(x) >= 2)[1:3] AS a, list_filter(b, lambda x: length(x) >= 2)[1:3] AS b FROM c)
SELECT c_custkey, round(max(1 - levenshtein(x, y) / greatest(length(x), length(y))), 6) AS best FROM (SELECT c_custkey, unnest(a) AS x, b FROM f), LATERAL (SELECT unnest(b) AS y) GROUP BY c_custkey""")
def best_number(spark: SparkSession, d: str) -> DataFrame:
    c = v.table(spark, d, "customer")
    a = F.concat_ws(" ", (F.round(F.col("c_acctbal") * 100).cast("long") + 10_000_000).cast("string"), F.col("c_custkey").cast("string"), (F.col("c_nationkey") + 100).cast("string"))
    b = F.concat_ws(" ", (F.col("c_custkey") * 37 + 10).cast("string"), (F.col("c_nationkey") + 10).cast("string"))
    return c.select("c_custkey", F.round(cmp.best_number_sim(a, b), 6).alias("best"))


LINKING = ["combo", "skel", "addr"]


def _linked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normalised sources and the candidates of the reference's three retrievers, each at its own k."""
    # The retrievers and the features read the views: they are made once and kept in the shared folder.
    a, b = v.split_sources(stored(normalize(v.records(spark, d))))
    long = None
    for name in LINKING:
        found = simjoin.retrieve(a, b, tv.RETRIEVERS[name])
        long = found if long is None else long.unionByName(found)
    return a, b, candidates.union_candidates(long, LINKING)


@query()
def string_features(spark: SparkSession, d: str) -> DataFrame:
    a, b, pairs = _linked(spark, d)
    return features.string_features(pairs.select("s1_id", "cand_id"), a, b)


@query(f"""WITH {PARTS}, s AS (SELECT x, y, list_distinct(string_split(a, ' ')) AS u, list_distinct(string_split(b, ' ')) AS w, a, b FROM pp)
SELECT x, y, round((1 - levenshtein(a, b) / greatest(length(a), length(b)) + len(list_intersect(u, w)) / len(list_distinct(list_concat(u, w))) + 0.5) / 3, 6) AS rule FROM s""")
def rule_scores(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    rows = v.part_pairs(spark, d).withColumns({"lev": cmp.levenshtein_sim(a, b), "jacc": cmp.jaccard(a, b), "unknown": F.lit(None).cast("double")})
    return rows.select("x", "y", F.round(learn.rule_score(["lev", "jacc", "unknown"]), 6).alias("rule"))


@query(f"""WITH {PAIRS}, r AS (SELECT s1_id, cand_id, p, label FROM pairs QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cand_id) <= 6), n AS (SELECT r.*, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type || ' ' || p_brand END AS addr FROM r JOIN part ON p_partkey = CAST(substr(cand_id, 4) AS BIGINT)),
o AS (SELECT a.s1_id, a.cand_id, b.p AS op, len(list_intersect(string_split(a.name, ' '), string_split(b.name, ' '))) / len(list_distinct(list_concat(string_split(a.name, ' '), string_split(b.name, ' ')))) AS sn,
 CASE WHEN a.addr <> '' AND b.addr <> '' THEN len(list_intersect(string_split(a.addr, ' '), string_split(b.addr, ' '))) / len(list_distinct(list_concat(string_split(a.addr, ' '), string_split(b.addr, ' ')))) END AS sa FROM n a JOIN n b ON a.s1_id = b.s1_id AND a.cand_id <> b.cand_id WHERE b.p >= 0.05),
g AS (SELECT s1_id, cand_id, max(op * sn) AS nb_name, max(op * coalesce(sa, 0)) AS nb_addr, max(op * CASE WHEN sa IS NULL THEN sn * 0.8 ELSE least(sn, sa) END) AS nb_both, sum(op * sn) AS nb_sum FROM o GROUP BY ALL)
SELECT r.s1_id, r.cand_id, round(coalesce(nb_name, 0), 6) AS nb_name, round(coalesce(nb_addr, 0), 6) AS nb_addr, round(coalesce(nb_both, 0), 6) AS nb_both, round(coalesce(nb_sum, 0), 6) AS nb_sum, round(max(p) OVER (PARTITION BY r.s1_id) - p, 6) AS p1st_gap, sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY r.s1_id)::BIGINT AS p1st_nconf FROM r LEFT JOIN g USING (s1_id, cand_id)""")
def collective(spark: SparkSession, d: str) -> DataFrame:
    pairs = candidates.prune(v.scored_pairs(spark, d), "p", 0.0, 6).select("s1_id", "cand_id", F.col("p").alias("p1"))
    parts = v.table(spark, d, "part")
    names = parts.select(F.concat(F.lit("S"), (F.col("p_partkey") % 2 + 2).cast("string"), F.lit("-"), "p_partkey").alias("cand_id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat_ws(" ", "p_type", "p_brand")).alias("addr"))
    out = features.collective_features(pairs, names)
    return out.select("s1_id", "cand_id", *(F.round(c, 6).alias(c) for c in ("nb_name", "nb_addr", "nb_both", "nb_sum", "p1st_gap")), F.col("p1st_nconf").cast("long").alias("p1st_nconf"))


# ---- graph --------------------------------------------------------------------------------------------------------
EDGES = "e AS (SELECT 'S' || (a.p_partkey % 2 + 2) || '-' || a.p_partkey AS cand_id, 'S' || (b.p_partkey % 2 + 2) || '-' || b.p_partkey AS nbr_id, ((a.p_partkey * b.p_partkey) % 100) / 100.0 AS sib FROM part a JOIN part b USING (p_brand, p_size) WHERE a.p_partkey <> b.p_partkey)"
HOPS = f"{PAIRS}, {EDGES}, h AS (SELECT s1_id, nbr_id AS cand_id, p * sib AS w, sib FROM pairs JOIN e USING (cand_id) WHERE p >= 0.8 AND sib >= 0.5)"


def _graph(spark: SparkSession, d: str, **which: bool) -> DataFrame:
    return graph.expand_in_blocks(*v.block_pairs(spark, d), v.block_sib, v.block_names, **which)


@query(f"WITH {HOPS} SELECT DISTINCT s1_id, cand_id FROM h ANTI JOIN pairs USING (s1_id, cand_id)")
def expand_2hop(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, base=False).select("s1_id", "cand_id")


@query(f"WITH {HOPS} SELECT s1_id, cand_id, round(max(w), 6) AS gs_max, round(sum(w), 6) AS gs_sum, count(*) AS gs_cnt, max(sib)::DOUBLE AS gs_sib_max FROM h GROUP BY s1_id, cand_id")
def graph_support(spark: SparkSession, d: str) -> DataFrame:
    out = _graph(spark, d, bare=False).drop("hop2")
    return out.withColumns({"gs_max": F.round("gs_max", 6), "gs_sum": F.round("gs_sum", 6)})


@query(f"""WITH {HOPS}, s AS (SELECT s1_id, cand_id, max(w) AS m, count(*) AS c FROM h GROUP BY ALL), a AS (SELECT s1_id, cand_id, 0 AS hop2 FROM pairs UNION ALL SELECT s1_id, cand_id, 1 FROM s ANTI JOIN pairs USING (s1_id, cand_id))
SELECT s1_id, cand_id, hop2, round(coalesce(m, 0), 6) AS gs_max, coalesce(c, 0) AS gs_cnt FROM a LEFT JOIN s USING (s1_id, cand_id)""")
def graph_features(spark: SparkSession, d: str) -> DataFrame:
    out = _graph(spark, d)
    return out.select("s1_id", "cand_id", "hop2", F.round("gs_max", 6).alias("gs_max"), "gs_cnt")


# ---- decode, metrics, tuning -----------------------------------------------------------------------------------------
@query(f"WITH {OWNED} SELECT s1_id, cand_id, p, pos, p_top FROM placed")
def one_owner(spark: SparkSession, d: str) -> DataFrame:
    return decode.placed(v.scored_pairs(spark, d)).select("s1_id", "cand_id", "p", "pos", "p_top")


@query(f"WITH {CHOSEN} SELECT s1_id, cand_id, p, pos FROM chosen")
def decode_pairs(spark: SparkSession, d: str) -> DataFrame:
    return decode.decode(v.scored_pairs(spark, d), RULE)


@query()
def decode_reassigned(spark: SparkSession, d: str) -> DataFrame:
    return decode.decode_reassign(v.scored_pairs(spark, d), RULE)


def _evaluated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pairs = v.scored_pairs(spark, d)
    truth = pairs.groupBy("s1_id").agg(F.collect_list(F.when(F.col("label") == 1, F.col("cand_id"))).alias("truth"))
    return decode.match_lists(decode.decode(pairs, RULE), truth), truth


@query(f"WITH {CHOSEN} SELECT s1_id, round(f05, 6) AS f05 FROM f05")
def entity_f05(spark: SparkSession, d: str) -> DataFrame:
    return metrics.entity_f05(*_evaluated(spark, d)).withColumn("f05", F.round("f05", 6))


@query(f"WITH {CHOSEN} SELECT round(avg(f05), 6) AS macro_f05 FROM f05")
def macro_f05(spark: SparkSession, d: str) -> DataFrame:
    return metrics.macro_f05(*_evaluated(spark, d)).select(F.round("macro_f05", 6).alias("macro_f05"))


@query(f"""WITH {PAIRS}, e AS (SELECT s1_id, count(*) FILTER (WHERE label = 1) AS t, count(*) FILTER (WHERE p >= 0.4) AS c, count(*) FILTER (WHERE p >= 0.4 AND label = 1) AS h FROM pairs GROUP BY s1_id)
SELECT round(sum(h) / sum(t), 6) AS pair_recall, round(avg(c), 6) AS mean_candidates, round(avg(CASE WHEN t = 0 THEN CAST(h = 0 AS DOUBLE) WHEN h = 0 THEN 0 ELSE 1.25 * (h / t) / (0.25 + h / t) END), 6) AS oracle_f05 FROM e""")
def blocking_report(spark: SparkSession, d: str) -> DataFrame:
    pairs = v.scored_pairs(spark, d)
    found = pairs.where("p >= 0.4").groupBy("s1_id").agg(F.collect_list("cand_id").alias("cand"))
    out = metrics.blocking_report(found, _evaluated(spark, d)[1])
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(f"""WITH {LONG}, t AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id FROM rec a JOIN rec b USING (business_name, country) WHERE a.source = 1 AND b.source > 1 AND 20 * abs(a.n_chars - b.n_chars) <= greatest(a.n_chars, b.n_chars)),
l AS (SELECT s1_id, cand_id, rank, retriever FROM long UNION ALL SELECT s1_id, cand_id, rank, 'union' FROM long),
u AS (SELECT DISTINCT retriever, k, s1_id, cand_id FROM l, (SELECT unnest([1, 3, 5]) AS k) WHERE rank <= k AND s1_id IN (SELECT entity_id FROM rec WHERE source = 1))
SELECT retriever, CAST(k AS INTEGER) AS k, round(count(t.s1_id) / (SELECT count(*) FROM t), 6) AS pair_recall, round(count(*) / (SELECT count(*) FROM rec WHERE source = 1), 6) AS mean_candidates FROM u LEFT JOIN t USING (s1_id, cand_id) GROUP BY ALL""")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    entities = v.records(spark, d).where("source = 1").select(F.col("entity_id").alias("s1_id"))
    truth = entities.join(v.weak_truth(spark, d), "s1_id", "left")
    out = metrics.recall_at_k(_long(spark, d), truth, [1, 3, 5])
    return out.withColumns({c: F.round(c, 6) for c in ("pair_recall", "mean_candidates")})


GRID = [decode.Rule(a, b, c, o) for o in (True, False) for a in (0.3, 0.6) for b in (0.3, 0.7) for c in (0.0, 0.5)]


@query(f"""WITH {PAIRS}, ow AS (SELECT *, true AS one_to_one FROM pairs QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY p DESC, s1_id) = 1 UNION ALL SELECT *, false FROM pairs),
pl AS (SELECT *, row_number() OVER (PARTITION BY one_to_one, s1_id ORDER BY p DESC, cand_id) AS pos, max(p) OVER (PARTITION BY one_to_one, s1_id) AS top FROM ow),
g AS (SELECT row_number() OVER (ORDER BY one_to_one DESC, t1, t2, alpha) - 1 AS config, * FROM (SELECT unnest([true, false]) AS one_to_one), (SELECT unnest([0.3, 0.6]) AS t1), (SELECT unnest([0.3, 0.7]) AS t2), (SELECT unnest([0.0, 0.5]) AS alpha)),
m AS (SELECT config, s1_id, count(*) AS n, sum(label) AS tp FROM pl JOIN g USING (one_to_one) WHERE (pos = 1 AND p >= t1) OR (pos > 1 AND top >= t1 AND p >= t2 AND p >= alpha * top) GROUP BY ALL),
e AS (SELECT s1_id, sum(label) AS t FROM pairs GROUP BY s1_id)
SELECT CAST(g.config AS INTEGER) AS config, CAST(t1 AS DOUBLE) AS t1, CAST(t2 AS DOUBLE) AS t2, CAST(alpha AS DOUBLE) AS alpha, one_to_one, round(avg(CASE WHEN t = 0 THEN CAST(n IS NULL AS DOUBLE) WHEN coalesce(tp, 0) = 0 THEN 0 ELSE 1.25 * (tp / n) * (tp / t) / (0.25 * (tp / n) + tp / t) END), 6) AS score
FROM g CROSS JOIN e LEFT JOIN m ON m.config = g.config AND m.s1_id = e.s1_id GROUP BY ALL""")
def tune_grid(spark: SparkSession, d: str) -> DataFrame:
    pairs = v.scored_pairs(spark, d)
    return decode.tune(pairs, pairs.groupBy("s1_id").agg(F.sum("label").alias("n_true")), GRID).withColumn("score", F.round("score", 6))


@query(f"WITH {PAIRS} SELECT s1_id, cand_id, round(1 / (1 + exp(0.75 - ln(least(greatest(p, 1e-9), 1 - 1e-9) / (1 - least(greatest(p, 1e-9), 1 - 1e-9))))), 6) AS p FROM pairs")
def logit_offset(spark: SparkSession, d: str) -> DataFrame:
    rows = v.scored_pairs(spark, d).withColumn("country", F.lit("France"))
    return decode.shift_by_country(rows, {"France": 0.75}).select("s1_id", "cand_id", F.round("p", 6).alias("p"))


@query()
def offset_sweep(spark: SparkSession, d: str) -> DataFrame:
    pairs = v.scored_pairs(spark, d)
    return decode.offset_sweep(pairs, pairs.select("s1_id").distinct(), RULE, [-1.0, -0.5, 0.0, 0.5, 1.0])


@query(f"WITH {PAIRS}, r AS (SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM pairs) SELECT round((sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 6) AS auc FROM r")
def pair_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auc(v.scored_pairs(spark, d)).select(F.round("auc", 6).alias("auc"))


@query()
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    pairs = v.scored_pairs(spark, d)
    truth = _evaluated(spark, d)[1]
    x, y = (metrics.entity_f05(decode.match_lists(decode.decode(pairs, r), truth), truth) for r in (RULE, decode.Rule(0.4, 0.8, 0.0)))
    diffs = y.join(x.withColumnRenamed("f05", "old"), "s1_id").select("s1_id", (F.col("f05") - F.col("old")).alias("diff"))
    return metrics.bootstrap_ci(diffs, 200)


@query(f"""WITH {PAIRS} SELECT thr, CAST(cap AS INTEGER) AS cap, round(count(*) / (SELECT count(DISTINCT s1_id) FROM pairs), 6) AS size, round(sum(label) / (SELECT sum(label) FROM pairs), 6) AS recall FROM (
 SELECT s1_id, label, p, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cand_id) AS pos FROM pairs) q, (SELECT unnest([0.2, 0.5])::DOUBLE AS thr) a, (SELECT unnest([3, 10]) AS cap) b WHERE p >= thr AND pos <= cap GROUP BY ALL""")
def cascade_tradeoff(spark: SparkSession, d: str) -> DataFrame:
    pairs = v.scored_pairs(spark, d)
    totals = pairs.agg(F.countDistinct("s1_id").alias("n"), F.sum("label").alias("t")).first()
    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("thr"), F.lit(b).alias("cap")) for a in (0.2, 0.5) for b in (3, 10))))
    rows = decode.placed(pairs, False).select("p", "pos", "label", grid.alias("g")).where("p >= g.thr and pos < g.cap")
    return rows.groupBy(F.col("g.thr").alias("thr"), F.col("g.cap").alias("cap")).agg(F.round(F.count(F.lit(1)) / totals["n"], 6).alias("size"), F.round(F.sum("label") / totals["t"], 6).alias("recall"))


# ---- mining, noise, reports ---------------------------------------------------------------------------------------------
def _text_pairs(spark: SparkSession, d: str) -> DataFrame:
    return v.part_pairs(spark, d).select(F.concat_ws("-", "x", "y").alias("pair"), F.col("a").alias("text_a"), F.col("b").alias("text_b"))


@query()
def mine_variants(spark: SparkSession, d: str) -> DataFrame:
    return mining.mine_variants(_text_pairs(spark, d), min_count=2, min_ratio=0.05, least=0.5)


@query(f"""WITH {PARTS}, t AS (SELECT list_distinct(string_split(a, ' ')) AS a, list_distinct(string_split(b, ' ')) AS b FROM pp), w AS (SELECT a, b, unnest(list_distinct(list_concat(a, b))) AS word FROM t),
c AS (SELECT word, sum(CASE WHEN list_contains(a, word) AND list_contains(b, word) THEN 0 ELSE 1 END)::BIGINT AS one_sided, count(*) AS total FROM w GROUP BY word) SELECT * FROM c WHERE total >= 15 AND one_sided / total >= 0.6""")
def mine_noise(spark: SparkSession, d: str) -> DataFrame:
    return mining.mine_noise(_text_pairs(spark, d))


@query(f"""WITH {PARTS}, x AS (SELECT 'added' AS change, unnest(list_filter(list_distinct(string_split(b, ' ')), lambda t: NOT list_contains(string_split(a, ' '), t))) AS token FROM pp UNION ALL SELECT 'dropped', unnest(list_filter(list_distinct(string_split(a, ' ')), lambda t: NOT list_contains(string_split(b, ' '), t))) FROM pp)
SELECT change, token, count(*) AS count FROM x GROUP BY change, token QUALIFY row_number() OVER (PARTITION BY change ORDER BY count(*) DESC, token) <= 10""")
def token_changes(spark: SparkSession, d: str) -> DataFrame:
    return noise.token_changes(_text_pairs(spark, d), 10)


@query()
def name_noise(spark: SparkSession, d: str) -> DataFrame:
    r = v.records(spark, d).select(F.col("entity_id"), F.col("business_name"))
    pairs = v.weak_truth(spark, d).join(r.select(F.col("entity_id").alias("s1_id"), F.col("business_name").alias("name_a")), "s1_id").join(r.select(F.col("entity_id").alias("cand_id"), F.col("business_name").alias("name_b")), "cand_id")
    return noise.op_rates(noise.name_ops(pairs.withColumn("source", F.substring("cand_id", 2, 1))), "source")


@query()
def address_noise(spark: SparkSession, d: str) -> DataFrame:
    r = v.records(spark, d).select(F.col("entity_id"), F.col("business_address"))
    pairs = v.weak_truth(spark, d).join(r.select(F.col("entity_id").alias("s1_id"), F.col("business_address").alias("addr_a")), "s1_id").join(r.select(F.col("entity_id").alias("cand_id"), F.col("business_address").alias("addr_b")), "cand_id")
    return noise.op_rates(noise.address_ops(pairs.withColumn("source", F.substring("cand_id", 2, 1))), "source")


@query(f"WITH {LONG} SELECT retrievers, count(*) AS pairs FROM (SELECT s1_id, cand_id, string_agg(DISTINCT retriever, '+' ORDER BY retriever) AS retrievers FROM long GROUP BY s1_id, cand_id) GROUP BY retrievers")
def retriever_overlap(spark: SparkSession, d: str) -> DataFrame:
    return noise.retriever_overlap(_long(spark, d))


@query(f"WITH {PAIRS} SELECT CAST(least(floor(p * 50), 49) AS BIGINT) AS bin, count(*) AS n FROM pairs GROUP BY 1")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return noise.score_histogram(v.scored_pairs(spark, d))


# ---- learning and the whole chain ---------------------------------------------------------------------------------------
def _measured(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """labelled documents with a few numbers of their text; each document is an entity of its own."""
    docs = v.table(spark, d, "documents").join(v.table(spark, d, "labels"), "doc_id")
    n = F.greatest(F.length("text"), F.lit(1))
    made = {"f_len": F.log(n), "f_marks": F.length(F.regexp_replace("text", r"[^#*$%&|<>!]", "")) / n, "f_upper": F.length(F.regexp_replace("text", r"[^A-Z]", "")) / n, "f_lines": F.when(F.col("doc_id") % 7 != 0, F.size(F.split("text", "\n")) / n)}
    rows = docs.select(F.col("doc_id").cast("string").alias("s1_id"), F.lit("-").alias("cand_id"), (F.col("quality") == 0).cast("int").alias("label"), *(c.alias(k) for k, c in made.items()))
    return rows, list(made)


@query()
def out_of_fold_scores(spark: SparkSession, d: str) -> DataFrame:
    rows, inputs = _measured(spark, d)
    return learn.out_of_fold(rows, inputs, lambda: learn.zoo(2 * len(inputs))["gbt"].setMaxIter(5), folds=3).select("s1_id", "label", "p")


@query()
def combined_scores(spark: SparkSession, d: str) -> DataFrame:
    rows, inputs = _measured(spark, d)
    first = learn.out_of_fold(rows, inputs, lambda: learn.zoo(2 * len(inputs))["logreg"], folds=2, scale=True)
    scorer = F.when(F.pmod(F.xxhash64("s1_id"), F.lit(3)) > 0, learn.logit(F.least(F.col("f_marks") * 10, F.lit(0.999))))
    rows = first.withColumn("ce", 1 / (1 + F.exp(-scorer)))
    return learn.combine(rows, ["ce"], candidates.fold_of("s1_id", 2) == 0).select("s1_id", "label", "p")


@query()
def serialized_pairs(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.lexicon import LEGAL_FORMS

    return v.records(spark, d).select("entity_id", learn.serialized(F.col("business_name"), F.col("business_address"), LEGAL_FORMS).alias("text"))


def linked(spark: SparkSession, d: str) -> DataFrame:
    """Records to match lists: normalise, retrieve, score by rule, decode."""
    a, b, pairs = _linked(spark, d)
    scored = features.string_features(pairs, a, b, only_cheap=True).withColumn("p", learn.rule_score()).select("s1_id", "cand_id", "p")
    entities = a.select(F.col("entity_id").alias("s1_id"))
    return tsv.id_lists(decode.match_lists(decode.decode(scored, decode.Rule(0.8, 0.85, 0.9)), entities), entities, "pred", "matched_entity_ids")


@query()
def link_documents(spark: SparkSession, d: str) -> DataFrame:
    return linked(spark, d)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return linked(spark, d)
