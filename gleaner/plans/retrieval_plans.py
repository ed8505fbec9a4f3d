"""Retrieval and ranking queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner import dims
from gleaner.operators import retrieval as R
from gleaner.plans.registry import Source, query

TENANTS = [
    ("open", None, None, [], True, None),
    ("narrow", "5.0", "3.0", ["alpha"], False, "en"),
    ("versioned", "", "4.2", [], True, None),
]
TENANT_SQL = """(SELECT *, TRY_CAST(coalesce(nullif(erp_version, ''), legacy_erp_version) AS DOUBLE) AS version FROM (VALUES
 ('open', NULL, NULL, CAST([] AS VARCHAR[]), true, NULL), ('narrow', '5.0', '3.0', ['alpha'], false, 'en'),
 ('versioned', '', '4.2', CAST([] AS VARCHAR[]), true, NULL)) v(tenant_id, erp_version, legacy_erp_version, modules, has_robot, preferred_lang))"""

CHANGELOG_SQL = """(c.doc_type <> 'changelog_pure' OR (t.version IS NOT NULL AND coalesce(c.version_min, 0) <= t.version
 AND (c.version_max IS NULL OR t.version <= c.version_max)))"""
VISIBLE_SQL = f"""(len(t.modules) = 0 OR trim(coalesce(c.module_id, '')) = '' OR list_contains(t.modules, c.module_id))
 AND (t.version IS NULL OR (coalesce(c.version_min, 0) <= t.version AND (c.version_max IS NULL OR c.version_max >= t.version)))
 AND (t.has_robot OR NOT c.is_robot_doc) AND (t.preferred_lang IS NULL OR coalesce(nullif(c.lang, ''), 'es') = t.preferred_lang)
 AND {CHANGELOG_SQL}"""

CANDS_SQL = f"""(SELECT * FROM (
 SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS vector_rank FROM (
  SELECT q.query_id, q.question, c.chunk_id, c.source_doc, c.source_section,
   round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 10) AS score
  FROM @f_queries q JOIN {TENANT_SQL} t ON t.tenant_id = q.tenant_id
  JOIN @f_chunks c ON {VISIBLE_SQL} JOIN @f_vectors v ON v.chunk_id = c.chunk_id) s) r WHERE vector_rank <= 20)"""

# Words of a text, lower case and without accents, as a list.
FOLD = "strip_accents(lower({}))"


def ascii_words(x: str) -> str:
    return (f"list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace({FOLD.format(x)}, "
            r"'[^a-z0-9\s]', ' ', 'g')), '\s+'), lambda w: w <> ''))")


def text_words(x: str) -> str:
    return (f"list_distinct(list_filter(string_split(trim(regexp_replace({FOLD.format(x)}, "
            r"'[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda w: w <> ''))")


STEM = r"regexp_replace(source_doc, '\.[^.]*$', '')"
BOOST_SQL = f"""(SELECT b.*, rerank_score + CASE WHEN len(dw) > 0 THEN 0.06 * len(list_intersect(qw, dw)) / len(dw) ELSE 0 END AS boosted_score
 FROM (SELECT c.*, 1.0::DOUBLE - 0.01::DOUBLE * (vector_rank - 1) AS rerank_score, {ascii_words('question')} AS qw, {ascii_words(STEM)} AS dw
  FROM {CANDS_SQL} c) b)"""
ANSWERS_SQL = f"""(SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY query_id ORDER BY round(boosted_score, 10) DESC, vector_rank) AS rank FROM (
  SELECT b.*, row_number() OVER (PARTITION BY query_id, source_doc ORDER BY round(boosted_score, 10) DESC, vector_rank) AS d FROM {BOOST_SQL} b) d
  WHERE d <= 2) r WHERE rank <= 5)"""
RELATED_SQL = f"""(SELECT query_id, related_no, source_doc, relevance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS related_no FROM (
   SELECT c.query_id, c.source_doc, min(vector_rank) AS first_rank, concat('Sección: ', coalesce(first(source_section ORDER BY vector_rank), 'N/A')) AS relevance
   FROM {CANDS_SQL} c WHERE NOT EXISTS (SELECT 1 FROM {ANSWERS_SQL} a WHERE a.query_id = c.query_id AND a.source_doc = c.source_doc)
   GROUP BY 1, 2) g) r WHERE related_no <= 5)"""


def config(src: Source):
    return R.tenant_config(dims.tenants(src.spark, TENANTS))


def indexed_chunks(src: Source):
    return src.f_chunks.join(src.f_vectors, "chunk_id")


def candidates(src: Source):
    return R.vector_top_k(src.f_queries, indexed_chunks(src), config(src))


PROFILE_SQL = """SELECT concat('t', CAST(c_custkey AS STRING)) AS tenant_id,
 CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE CAST(c_nationkey AS STRING) END AS erp_version,
 CASE c_custkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN NULL ELSE CAST(c_custkey % 9 AS STRING) END AS legacy_erp_version,
 c_acctbal > 0 AS has_robot, CASE WHEN c_custkey % 2 = 0 THEN lower(substring(c_mktsegment, 1, 2)) END AS preferred_lang FROM @customer"""
OVERLAY_SQL = """SELECT concat('t', CAST(s_suppkey * 2 AS STRING)) AS tenant_id, CASE WHEN s_suppkey % 3 = 0 THEN '9.5' END AS erp_version,
 CAST(NULL AS STRING) AS legacy_erp_version, CASE WHEN s_acctbal < 0 THEN false END AS has_robot, 'es' AS preferred_lang FROM @supplier"""


@query("tenant_config", f"""SELECT tenant_id, erp_version, legacy_erp_version, has_robot, preferred_lang,
 TRY_CAST(coalesce(nullif(erp_version, ''), legacy_erp_version) AS DOUBLE) AS version FROM (
 SELECT coalesce(o.tenant_id, b.tenant_id) AS tenant_id, coalesce(o.erp_version, b.erp_version) AS erp_version,
 coalesce(o.legacy_erp_version, b.legacy_erp_version) AS legacy_erp_version, coalesce(o.has_robot, b.has_robot) AS has_robot,
 coalesce(o.preferred_lang, b.preferred_lang) AS preferred_lang
 FROM ({PROFILE_SQL}) b FULL JOIN ({OVERLAY_SQL}) o ON o.tenant_id = b.tenant_id) m""")
def _(src: Source):
    return R.tenant_config(src.sql(PROFILE_SQL), src.sql(OVERLAY_SQL))


@query("visible_chunks", f"""SELECT t.tenant_id, c.chunk_id, c.doc_type FROM @f_chunks c JOIN {TENANT_SQL} t ON {VISIBLE_SQL}""")
def _(src: Source):
    return R.visible_chunks(src.f_chunks, config(src)).select("tenant_id", "chunk_id", "doc_type")


@query("changelog_visible", f"""SELECT c.chunk_id, c.doc_type FROM @f_chunks c JOIN (SELECT 4.2::DOUBLE AS version) t ON {CHANGELOG_SQL}""")
def _(src: Source):
    return src.f_chunks.where(R.changelog_visible(F.lit(4.2))).select("chunk_id", "doc_type")


@query("vector_top_k", f"SELECT query_id, chunk_id, vector_rank, round(score, 6) AS score FROM {CANDS_SQL} x")
def _(src: Source):
    return candidates(src).select("query_id", "chunk_id", F.col("vector_rank").cast("bigint").alias("vector_rank"), F.round("score", 6).alias("score"))


@query("rank_passthrough", f"SELECT query_id, chunk_id, round(1 - 0.01::DOUBLE * (vector_rank - 1), 6) AS rerank_score FROM {CANDS_SQL} x")
def _(src: Source):
    return R.rank_passthrough(candidates(src)).select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"))



@query("apply_rerank_scores", f"""SELECT query_id, chunk_id, round(CAST((query_id * 31 + chunk_id * 17) % 101 AS DOUBLE) / 101, 6) AS rerank_score,
 row_number() OVER (PARTITION BY query_id ORDER BY (query_id * 31 + chunk_id * 17) % 101 DESC, chunk_id) AS rerank_rank FROM {CANDS_SQL} x""")
def _(src: Source):
    cands = candidates(src)
    scores = cands.select("query_id", "chunk_id", (((F.col("query_id") * 31 + F.col("chunk_id") * 17) % 101) / F.lit(101.0)).alias("relevance"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "chunk_id")
    return R.apply_rerank_scores(cands, scores, " Voyage ").select(
        "query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), F.row_number().over(w).cast("bigint").alias("rerank_rank"))


@query("title_boost", f"SELECT query_id, chunk_id, round(boosted_score, 6) AS boosted_score FROM {BOOST_SQL} x")
def _(src: Source):
    return R.title_boost(R.rank_passthrough(candidates(src)), src.f_queries).select("query_id", "chunk_id", F.round("boosted_score", 6).alias("boosted_score"))


def answers_and_related(src: Source):
    return R.retrieve(src.f_queries, indexed_chunks(src), config(src))


@query("doc_diversity", f"SELECT query_id, chunk_id, rank FROM {ANSWERS_SQL} x")
def _(src: Source):
    return R.doc_diversity(R.title_boost(R.rank_passthrough(candidates(src)), src.f_queries)).select(
        "query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


@query("related_docs", f"SELECT query_id, related_no, source_doc, relevance FROM {RELATED_SQL} x")
def _(src: Source):
    return answers_and_related(src)[1].withColumn("related_no", F.col("related_no").cast("bigint"))


@query("retrieve", f"SELECT query_id, rank, chunk_id, source_doc, source_section, round(boosted_score, 6) AS score FROM {ANSWERS_SQL} x")
def _(src: Source):
    return answers_and_related(src)[0].select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", "source_doc", "source_section", F.round("boosted_score", 6).alias("score"))


def lexical_ctes(asked: str, k: int) -> str:
    """CTEs down to ``found`` (query_id, chunk_id, vector_rank, score) for ``asked`` (query_id, question)."""
    return f"""asked AS MATERIALIZED (SELECT query_id, unnest({text_words('question')}) AS token FROM ({asked}) a),
 d AS MATERIALIZED (SELECT doc_id, unnest({text_words('text')}) AS token FROM @documents),
 w AS MATERIALIZED (SELECT t.token, ln(((SELECT count(*) FROM @documents) + 1)::DOUBLE / (count(d.doc_id) + 1)) AS weight FROM
  (SELECT DISTINCT token FROM asked) t LEFT JOIN d ON d.token = t.token GROUP BY 1),
 q AS MATERIALIZED (SELECT query_id, token, weight, sum(weight) OVER (PARTITION BY query_id) AS total FROM asked JOIN w USING (token)),
 found AS MATERIALIZED (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS vector_rank FROM (
  SELECT q.query_id, d.doc_id AS chunk_id, round(sum(q.weight) / any_value(q.total), 10) AS score FROM q JOIN d ON d.token = q.token WHERE q.total > 0 GROUP BY 1, 2) s
  WHERE score > 0) r WHERE vector_rank <= {k})"""


@query("lexical_top_k", f"""WITH {lexical_ctes('SELECT item_id AS query_id, text AS question FROM @benchmark', 20)}
 SELECT query_id, chunk_id, vector_rank, round(score, 6) AS score FROM found""")
def _(src: Source):
    asked = src.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return R.lexical_top_k(asked, src.documents).select(
        "query_id", "chunk_id", F.col("vector_rank").cast("bigint").alias("vector_rank"), F.round("score", 6).alias("score"))
