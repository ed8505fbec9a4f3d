"""Retrieval benchmark queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import dims
from gleaner.operators import evaluation as B
from gleaner.operators.retrieval import lexical_top_k
from gleaner.plans.registry import Source, query
from gleaner.plans.retrieval_plans import lexical_ctes

_PROC = " OR ".join(f"contains(lower(text), '{w}')" for w in B.PROCEDURE_WORDS)
_DIFF = f"CASE WHEN has_image_caption THEN 'L3' WHEN {_PROC} THEN 'L2' ELSE 'L1' END"


@query("assign_difficulty", f"SELECT chunk_id, {_DIFF} AS difficulty FROM @f_chunks")
def _(src: Source):
    return B.assign_difficulty(src.f_chunks).select("chunk_id", "difficulty")


_STRATUM = "CASE WHEN doc_type IN ('structured_manual', 'operational_guide', 'module_manual', 'changelog_as_manual') THEN doc_type ELSE 'others' END"


@query("stratified_sample", f"""SELECT chunk_id, stratum FROM (SELECT chunk_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat('7:', CAST(chunk_id AS VARCHAR))), chunk_id) AS n
 FROM (SELECT chunk_id, {_STRATUM} AS stratum FROM @f_chunks) s) r WHERE n <= CASE stratum WHEN 'structured_manual' THEN 75 WHEN 'operational_guide' THEN 60 WHEN 'module_manual' THEN 60
 WHEN 'changelog_as_manual' THEN 45 ELSE 60 END""")
def _(src: Source):
    return B.stratified_sample(src.f_chunks, 300, seed=7).select("chunk_id", "stratum")


NEG_SQL = """(WITH pool AS MATERIALIZED (SELECT chunk_id, doc_type, text, row_number() OVER (PARTITION BY doc_type ORDER BY md5(concat('3:', CAST(chunk_id AS VARCHAR))), chunk_id) - 1 AS place,
  count(*) OVER (PARTITION BY doc_type) AS k FROM @f_chunks WHERE length(text) > 50),
 sizes AS (SELECT doc_type, max(k) AS k FROM pool GROUP BY 1),
 asked AS (SELECT pair_id, gold_chunk_id, doc_type, k, unnest(range(0, least(6, k - 1) + 1)) AS step, CAST(concat('0x', substring(md5(concat('3:', CAST(pair_id AS VARCHAR))), 1, 8)) AS BIGINT) % k AS first FROM @f_pairs JOIN sizes USING (doc_type)),
 c AS (SELECT a.pair_id, p.chunk_id, p.text, row_number() OVER (PARTITION BY pair_id ORDER BY step) - 1 AS n, count(*) OVER (PARTITION BY pair_id) AS m
  FROM asked a JOIN pool p ON p.doc_type = a.doc_type AND p.place = (a.first + a.step) % a.k AND p.chunk_id <> a.gold_chunk_id)
 SELECT pair_id, n, chunk_id, text FROM c WHERE m >= 2 AND n < 6)"""


@query("hard_negative_candidates", f"SELECT pair_id, n, chunk_id, text FROM {NEG_SQL} x")
def _(src: Source):
    return B.hard_negative_candidates(src.f_pairs, src.f_chunks, seed=3).withColumn("n", F.col("n").cast("bigint"))


PICKS = "SELECT doc_id AS pair_id, quality * 9 AS neg_a_index, toxic + 2 AS neg_b_index FROM @labels"


@query("pick_negatives", f"""SELECT pair_id, coalesce(a, b) AS hard_neg_a, CASE WHEN a IS NOT NULL THEN b END AS hard_neg_b FROM (
 SELECT x.pair_id, max(text) FILTER (WHERE n = neg_a_index) AS a, max(text) FILTER (WHERE n = neg_b_index) AS b FROM {NEG_SQL} x JOIN ({PICKS}) p USING (pair_id) GROUP BY 1) z""")
def _(src: Source):
    return B.pick_negatives(B.hard_negative_candidates(src.f_pairs, src.f_chunks, seed=3), src.sql(PICKS))


WRITER = """SELECT doc_id AS chunk_id, CASE doc_id % 5 WHEN 0 THEN concat('```json', chr(10), '{"question": "What is ', source, '?", "answer": "It is ', lang, '"}', chr(10), '```')
 WHEN 1 THEN '{"question": "", "answer": "x"}' WHEN 2 THEN '{"question": "cut' ELSE concat('Sure: {"question": "Who ', CAST(doc_id AS STRING), '?", "answer": "me"}') END AS reply FROM @documents"""


@query("build_pairs", f"""SELECT chunk_id AS gold_chunk_id, CASE WHEN chunk_id % 5 = 0 THEN concat('What is ', split_part(source_doc, '_', 1), '?') ELSE concat('Who ', CAST(chunk_id AS VARCHAR), '?') END AS question,
 CASE WHEN chunk_id % 5 = 0 THEN concat('It is ', lang) ELSE 'me' END AS answer, {_DIFF} AS difficulty, doc_type, source_doc, source_section, has_image_caption AS has_image_source,
 text AS chunk_text_preview FROM @f_chunks WHERE chunk_id % 5 IN (0, 3, 4) AND length(trim(text, concat(' ', chr(9), chr(10), chr(13)))) >= 50""")
def _(src: Source):
    return B.build_pairs(src.f_chunks, src.sql(WRITER))


VALIDATOR = """SELECT doc_id AS pair_id, CASE WHEN doc_id % 7 = 0 THEN '{"answerable": tru' ELSE concat(CASE WHEN doc_id % 3 = 0 THEN 'x ' ELSE '' END, '{"answerable": ', CASE WHEN quality = 1 THEN 'true' ELSE 'false' END,
 ', "accurate": ', CASE WHEN toxic = 0 THEN 'true' ELSE 'false' END, ', "confidence": 0.', CAST(doc_id % 10 AS STRING), '}') END AS reply FROM @labels"""


@query("validate_pairs", """SELECT p.pair_id, CASE WHEN l.doc_id % 7 = 0 THEN 0 ELSE (l.doc_id % 10) / 10 END::DOUBLE AS validator_confidence,
 l.doc_id % 7 <> 0 AND quality = 1 AND toxic = 0 AND l.doc_id % 10 >= 6 AS validated FROM @f_pairs p JOIN @labels l ON l.doc_id = p.pair_id""")
def _(src: Source):
    return B.validate_pairs(src.f_pairs, src.sql(VALIDATOR)).select("pair_id", "validator_confidence", "validated")


STATS_SQL = """(SELECT 'difficulty' AS dim, difficulty AS key, count(*) AS n FROM @f_pairs GROUP BY 2 UNION ALL SELECT 'doc_type', doc_type, count(*) FROM @f_pairs GROUP BY 2
 UNION ALL SELECT 'total', 'pairs', count(*) FROM @f_pairs UNION ALL SELECT 'total', 'validated', count(*) FILTER (WHERE validated) FROM @f_pairs)"""


@query("pair_stats", f"SELECT * FROM {STATS_SQL} s")
def _(src: Source):
    return B.pair_stats(src.f_pairs)


TARGETS_SQL = "(VALUES " + ", ".join(f"('{k}', '{g}', {p})" for k, g, p in dims.TARGET_SHARES) + ") t(kind, key, share_pct)"


@query("distribution_report", f"""WITH s AS (SELECT dim AS kind, CASE WHEN dim = 'doc_type' AND key NOT IN ('structured_manual', 'operational_guide', 'module_manual', 'changelog_as_manual') THEN 'others' ELSE key END AS key, sum(n) AS n
  FROM {STATS_SQL} x WHERE dim <> 'total' GROUP BY 1, 2), z AS (SELECT count(*) AS total, count(*) FILTER (WHERE validated) AS v, greatest(0.08, least(0.20, 24.0 / count(*)))::DOUBLE AS slack FROM @f_pairs),
 r AS (SELECT t.kind, t.key, t.share_pct, coalesce(s.n, 0)::DOUBLE / total AS actual, total, slack FROM {TARGETS_SQL} LEFT JOIN s ON s.kind = t.kind AND s.key = t.key, z)
 SELECT kind, key, round_even(actual * 100, 1) AS actual_pct, share_pct::DOUBLE AS target_pct, CASE WHEN total >= 20 AND abs(actual - share_pct / 100) > CASE WHEN key = 'others' THEN slack + 0.05 ELSE slack END
  THEN concat(CASE WHEN kind = 'difficulty' THEN concat('Difficulty ', key) WHEN key = 'others' THEN 'Other doc types' ELSE concat('Doc type ', key) END, ': ', printf('%.1f', actual * 100), '% vs target ~', CAST(share_pct AS VARCHAR), '%',
   CASE WHEN kind = 'difficulty' THEN concat(' (n=', CAST(total AS VARCHAR), ', slack ±', printf('%.0f', slack * 100), 'pp)') ELSE '' END) END AS warning FROM r
 UNION ALL SELECT 'total', 'pairs', 100, 100, CASE WHEN total >= 80 AND v < 300 THEN concat('Validated pairs: ', CAST(v AS VARCHAR), ' of the 300 recommended for production')
  WHEN total < 80 THEN concat('Sample size n=', CAST(total AS VARCHAR), ': indicative only') END FROM z""")
def _(src: Source):
    return B.distribution_report(B.pair_stats(src.f_pairs), dims.target_shares(src.spark))


@query("merge_pairs", """SELECT CASE WHEN validated THEN 'old' ELSE 'new' END AS batch, pair_id, doc_type FROM @f_pairs""")
def _(src: Source):
    old = src.f_pairs.where("validated").select(F.lit("old").alias("batch"), "pair_id", "doc_type")
    new = src.f_pairs.where("NOT validated").select(F.lit("new").alias("batch"), "pair_id", "doc_type")
    return B.merge_pairs(old, new)


@query("eval_pairs", "SELECT pair_id, validated FROM @f_pairs WHERE validated OR NOT (SELECT bool_or(validated) FROM @f_pairs)")
def _(src: Source):
    return B.eval_pairs(src.f_pairs).select("pair_id", "validated")


def _sec(x: str) -> str:
    return f"coalesce(trim(regexp_replace(lower({x}), '\\s+', ' ', 'g')), '')"


HITS_SQL = f"""(SELECT a.*, a.chunk_id = p.gold_chunk_id OR (a.source_doc = p.source_doc AND ({_sec('p.source_section')} = '' OR {_sec('p.source_section')} = {_sec('a.source_section')})) AS hit
 FROM @f_pair_answers a JOIN @f_pairs p ON p.pair_id = a.pair_id)"""
RANKS_SQL = f"""(SELECT p.pair_id, p.doc_type, p.difficulty, p.failed, h.hit_rank, CASE WHEN hit_rank <= 1 THEN 1 ELSE 0 END AS h1, CASE WHEN hit_rank <= 3 THEN 1 ELSE 0 END AS h3,
 CASE WHEN hit_rank <= 5 THEN 1 ELSE 0 END AS h5, coalesce(1.0::DOUBLE / hit_rank, 0) AS rr FROM @f_pairs p LEFT JOIN (SELECT pair_id, min(rank) FILTER (WHERE hit) AS hit_rank FROM {HITS_SQL} x GROUP BY 1) h ON h.pair_id = p.pair_id)"""


def ranks(src: Source):
    return B.hit_ranks(src.f_pair_answers, src.f_pairs)


@query("match_gold", f"SELECT pair_id, rank, chunk_id, hit FROM {HITS_SQL} x")
def _(src: Source):
    return B.match_gold(src.f_pair_answers, src.f_pairs).select("pair_id", "rank", "chunk_id", "hit")


@query("hit_ranks", f"SELECT pair_id, failed, hit_rank, h1, h3, h5, round(rr, 6) AS rr FROM {RANKS_SQL} r")
def _(src: Source):
    return ranks(src).select("pair_id", "failed", "hit_rank", "h1", "h3", "h5", F.round("rr", 6).alias("rr"))


def counters_sql(where: str = "true") -> str:
    s = "CAST(sum(h1) FILTER (WHERE NOT failed) AS BIGINT) AS h1, CAST(sum(h3) FILTER (WHERE NOT failed) AS BIGINT) AS h3, CAST(sum(h5) FILTER (WHERE NOT failed) AS BIGINT) AS h5, sum(rr) FILTER (WHERE NOT failed) AS mrr_sum"
    return f"""(SELECT 'doc_type' AS dim, doc_type AS grp, count(*) FILTER (WHERE NOT failed) AS n, {s} FROM {RANKS_SQL} r WHERE {where} GROUP BY 2
 UNION ALL SELECT 'difficulty', difficulty, count(*) FILTER (WHERE NOT failed), {s} FROM {RANKS_SQL} r WHERE {where} GROUP BY 2
 UNION ALL SELECT 'overall', 'all', count(*), {s} FROM {RANKS_SQL} r WHERE {where})"""


RATES = ", ".join(["dim", "grp", "n", "h1", "h3", "h5", "round_even(mrr_sum, 4) AS mrr_sum", *[
    f"round_even({c} / n, 4) AS {a}" for c, a in (("h1", "hr_at_1"), ("h3", "hr_at_3"), ("h5", "hr_at_5"), ("mrr_sum", "mrr"))]])
SUMMARY_SQL = f"(SELECT {RATES} FROM {counters_sql()} c WHERE n > 0)"


@query("eval_summary", f"SELECT * FROM {SUMMARY_SQL} s")
def _(src: Source):
    return B.eval_summary(ranks(src))


FLOORS_SQL = "(VALUES " + ", ".join(f"('{d}', '{g}', {v}::DOUBLE)" for d, g, v in dims.MIN_HR3) + ") f(dim, grp, min_hr3)"
COMPLIANCE_SQL = f"""(WITH s AS MATERIALIZED {SUMMARY_SQL}, g AS (SELECT f.dim, f.grp, f.min_hr3, s.hr_at_3 AS actual_hr3, s.hr_at_3 >= f.min_hr3 AS pass, coalesce(s.n, 0) AS n,
  CASE WHEN s.n IS NULL THEN CASE WHEN f.dim = 'difficulty' THEN 'no_L3_pairs' ELSE 'no_pairs' END END AS skipped FROM {FLOORS_SQL} LEFT JOIN s ON s.dim = f.dim AND s.grp = f.grp)
 SELECT * FROM g UNION ALL SELECT dim, grp, 0.85, hr_at_3, h3 / n >= 0.85 AND (SELECT coalesce(bool_and(pass), true) FROM g), n, NULL FROM s WHERE dim = 'overall')"""


@query("spec_compliance", f"SELECT * FROM {COMPLIANCE_SQL} c")
def _(src: Source):
    return B.spec_compliance(B.eval_summary(ranks(src)), dims.hr3_floors(src.spark))


def page_of_pairs(src: Source, misses_only: bool):
    return B.retrieval_analysis(src.f_pairs, src.f_pair_answers, misses_only, limit=100, offset=50)


ITEMS_SQL = f"""(SELECT p.i AS pair_index, p.pair_id, p.question, p.failed AS error, r.hit_rank IS NOT NULL AS hit, r.hit_rank, round_even(r.rr, 4) AS mrr,
 ans AS expected_answer, pre AS chunk_preview
 FROM (SELECT *, trim(answer, concat(' ', chr(10))) AS ans, trim(chunk_text_preview, concat(' ', chr(10))) AS pre FROM (SELECT *, row_number() OVER (ORDER BY pair_id) - 1 AS i FROM @f_pairs) n WHERE i >= 50 AND i < 150) p
 JOIN {RANKS_SQL} r ON r.pair_id = p.pair_id)"""


@query("retrieval_analysis", f"""SELECT i.*, coalesce((SELECT string_agg(concat(CAST(h.rank AS VARCHAR), ':', CAST(h.chunk_id AS VARCHAR), ':', CASE WHEN h.hit THEN 'true' ELSE 'false' END, ':', trim(replace(h.text, chr(10), ' '))), '|' ORDER BY h.rank)
 FROM {HITS_SQL} h WHERE h.pair_id = i.pair_id), '') AS retrieved FROM {ITEMS_SQL} i""")
def _(src: Source):
    items, _summary = page_of_pairs(src, False)
    shown = F.array_join(F.transform("retrieved", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["chunk_id"].cast("string"), x["matches_gold"].cast("string"), x["text_preview"])), "|")
    return items.select(F.col("pair_index").cast("bigint").alias("pair_index"), "pair_id", "question", "error", "hit", "hit_rank", "mrr", "expected_answer", "chunk_preview",
                        F.coalesce(shown, F.lit("")).alias("retrieved"))


@query("retrieval_analysis_summary", f"""SELECT count(*) AS n_queries, count(*) FILTER (WHERE error) AS n_errors, count(*) FILTER (WHERE hit AND NOT error) AS hits_at_k,
 round_even(count(*) FILTER (WHERE hit AND NOT error) / count(*), 4) AS hr_at_k, count(*) FILTER (WHERE NOT hit) AS n_items_returned, (SELECT count(*) FROM @f_pairs) AS total_pairs,
 50 + count(*) AS next_offset, 50 + count(*) < (SELECT count(*) FROM @f_pairs) AS has_more FROM {ITEMS_SQL} i""")
def _(src: Source):
    return page_of_pairs(src, True)[1]


@query("merge_partials", f"""SELECT {RATES} FROM (SELECT dim, grp, CAST(sum(n) AS BIGINT) AS n, CAST(sum(h1) AS BIGINT) AS h1, CAST(sum(h3) AS BIGINT) AS h3, CAST(sum(h5) AS BIGINT) AS h5, sum(mrr_sum) AS mrr_sum FROM (
 SELECT * FROM {counters_sql('pair_id < 300')} a UNION ALL SELECT * FROM {counters_sql('pair_id >= 300')} b) u GROUP BY 1, 2) c WHERE n > 0""")
def _(src: Source):
    rows = ranks(src)
    return B.merge_partials(B.eval_counters(rows.where("pair_id < 300")).unionByName(B.eval_counters(rows.where("pair_id >= 300"))))


PAIR_LINES = """SELECT doc_id AS line_no, CASE doc_id % 6 WHEN 0 THEN ' ' WHEN 1 THEN '{"pair_id": 1, "lang":' ELSE concat('{"pair_id": ', CAST(doc_id AS STRING), ', "lang": "', lang, '"}') END AS line FROM @documents"""


@query("slice_pairs", f"""SELECT line_index, pair_id, lang, total FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_index, doc_id AS pair_id, lang, count(*) OVER () AS total
 FROM @documents WHERE doc_id % 6 <> 0) x WHERE line_index >= 100 AND line_index < 300 AND pair_id % 6 <> 1""")
def _(src: Source):
    page = B.slice_pairs(src.sql(PAIR_LINES), "pair_id bigint, lang string", 100, 200)
    return page.withColumn("line_index", F.col("line_index").cast("bigint"))


EXPECT = "SELECT pair_id AS query_id, source_doc AS expected, @array('OTHER2', 'nothing') AS alternatives FROM @f_pairs"
ACC_SQL = """(SELECT e.query_id, coalesce(max(CASE WHEN rank = 1 AND contains(lower(source_doc), lower(expected)) THEN 1 ELSE 0 END), 0) AS top1_primary,
 coalesce(max(CASE WHEN rank = 1 AND (contains(lower(source_doc), lower(expected)) OR contains(lower(source_doc), 'other2')) THEN 1 ELSE 0 END), 0) AS top1_relevant,
 coalesce(max(CASE WHEN contains(lower(source_doc), lower(expected)) THEN 1 ELSE 0 END), 0) AS top3_primary,
 coalesce(max(CASE WHEN contains(lower(source_doc), lower(expected)) OR contains(lower(source_doc), 'other2') THEN 1 ELSE 0 END), 0) AS top3_relevant
 FROM (SELECT pair_id AS query_id, source_doc AS expected FROM @f_pairs) e LEFT JOIN (SELECT pair_id AS query_id, rank, source_doc FROM @f_pair_answers WHERE rank <= 3) a ON a.query_id = e.query_id GROUP BY 1)"""
_ACC = ("top1_primary", "top1_relevant", "top3_primary", "top3_relevant")


@query("doc_accuracy", f"SELECT count(*) AS questions, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}, round_even(avg({c}), 4) AS {c}_rate' for c in _ACC)} FROM {ACC_SQL} x")
def _(src: Source):
    return B.doc_accuracy(src.f_pair_answers.withColumnRenamed("pair_id", "query_id"), src.sql(EXPECT))


@query("gold_config", f"""WITH s AS MATERIALIZED {SUMMARY_SQL} SELECT 'current' AS config_name, 'metrics' AS part, dim, grp, key, value FROM s, LATERAL (VALUES ('hr_at_1', hr_at_1), ('hr_at_3', hr_at_3), ('hr_at_5', hr_at_5), ('mrr', mrr)) m(key, value)
 UNION ALL SELECT 'current', 'compliance', dim, grp, 'pass', CAST(CAST(pass AS INT) AS DOUBLE) FROM {COMPLIANCE_SQL} c""")
def _(src: Source):
    summary = B.eval_summary(ranks(src))
    return B.gold_config(summary, B.spec_compliance(summary, dims.hr3_floors(src.spark)), "current", has_more=False)


_LEX_RATES = ", ".join(f"round_even({c} / n, 4) AS {a}" for c, a in (("h1", "hr_at_1"), ("h3", "hr_at_3"), ("h5", "hr_at_5"), ("mrr_sum", "mrr")))
_LEX_SUMS = "count(*) AS n, CAST(sum(h1) AS BIGINT) AS h1, CAST(sum(h3) AS BIGINT) AS h3, CAST(sum(h5) AS BIGINT) AS h5, sum(rr) AS mrr_sum"


@query("evaluate_lexical", f"""WITH {lexical_ctes('SELECT pair_id AS query_id, question FROM @f_pairs', 5)},
 p AS MATERIALIZED (SELECT * FROM @f_pairs), c AS MATERIALIZED (SELECT chunk_id, source_doc, source_section FROM @f_chunks),
 h AS (SELECT p.pair_id, p.doc_type, p.difficulty, min(f.vector_rank) FILTER (WHERE f.chunk_id = p.gold_chunk_id OR (c.source_doc = p.source_doc AND ({_sec('p.source_section')} = '' OR {_sec('p.source_section')} = {_sec('c.source_section')}))) AS hr
  FROM p LEFT JOIN found f ON f.query_id = p.pair_id LEFT JOIN c ON c.chunk_id = f.chunk_id GROUP BY 1, 2, 3),
 r AS MATERIALIZED (SELECT *, CASE WHEN hr <= 1 THEN 1 ELSE 0 END AS h1, CASE WHEN hr <= 3 THEN 1 ELSE 0 END AS h3, CASE WHEN hr <= 5 THEN 1 ELSE 0 END AS h5, coalesce(1.0::DOUBLE / hr, 0) AS rr FROM h)
 SELECT dim, grp, n, h1, h3, h5, round_even(mrr_sum, 4) AS mrr_sum, {_LEX_RATES} FROM (SELECT 'doc_type' AS dim, doc_type AS grp, {_LEX_SUMS} FROM r GROUP BY 2
  UNION ALL SELECT 'difficulty', difficulty, {_LEX_SUMS} FROM r GROUP BY 2 UNION ALL SELECT 'overall', 'all', {_LEX_SUMS} FROM r) s""")
def _(src: Source):
    """End to end: pairs as questions, lexical retrieval over all documents, hit rates."""
    asked = src.f_pairs.select(F.col("pair_id").alias("query_id"), "question")
    found = lexical_top_k(asked, src.documents, k=5)
    docs = src.f_chunks.select("chunk_id", "source_doc", "source_section")
    answers = found.join(docs, "chunk_id").select(F.col("query_id").alias("pair_id"), F.col("vector_rank").alias("rank"), "chunk_id", "source_doc", "source_section")
    return B.eval_summary(B.hit_ranks(answers, src.f_pairs.withColumn("failed", F.lit(False))))
