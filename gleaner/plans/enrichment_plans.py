"""Glossary, query enrichment, cache look-ups, planner decisions, grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import dims
from gleaner.operators import enrichment as E
from gleaner.operators import grounding as G
from gleaner.plans.registry import Source, query
from gleaner.plans.retrieval_plans import ANSWERS_SQL, FOLD, answers_and_related


def norm(x: str) -> str:
    return rf"trim(regexp_replace({FOLD.format(x)}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


SCOPED_SQL = f"""(SELECT *, row_number() OVER (PARTITION BY tenant_id, key ORDER BY term DESC, id DESC) AS rn,
 first(term) OVER (PARTITION BY tenant_id, key ORDER BY term, id) AS first_term, first(id) OVER (PARTITION BY tenant_id, key ORDER BY term, id) AS first_id
 FROM (SELECT *, {norm('term')} AS key FROM @f_glossary WHERE enabled) g)"""
EFFECTIVE_SQL = f"""(SELECT * FROM {SCOPED_SQL} e WHERE rn = 1)"""


@query("effective_glossary", f"""SELECT key, tenant_id, id, term, expansion FROM {EFFECTIVE_SQL} e WHERE tenant_id = 'open'
 OR (tenant_id = '__global__' AND key NOT IN (SELECT key FROM {EFFECTIVE_SQL} x WHERE tenant_id = 'open'))""")
def _(src: Source):
    return E.effective_glossary(src.f_glossary, "open").select("key", "tenant_id", "id", "term", "expansion")


HITS_CTE = f"""WITH e AS MATERIALIZED {EFFECTIVE_SQL},
 al AS MATERIALIZED (SELECT DISTINCT tenant_id, id, key, term, expansion, first_term, first_id, alias FROM (
  SELECT tenant_id, id, key, term, expansion, first_term, first_id, {norm('x')} AS alias FROM (SELECT *, unnest(list_append(aliases, term)) AS x FROM e) u) n WHERE alias <> ''),
 q AS MATERIALIZED (SELECT query_id, tenant_id, question, {norm('question')} AS nq FROM @f_asks),
 h AS MATERIALIZED (SELECT DISTINCT q.query_id, q.tenant_id AS asked_by, al.tenant_id, al.id, al.key, al.term, al.expansion, al.first_term, al.first_id
  FROM q JOIN al ON (al.tenant_id = '__global__' OR al.tenant_id = q.tenant_id) AND contains(concat(' ', q.nq, ' '), concat(' ', al.alias, ' '))
  WHERE NOT (al.tenant_id = '__global__' AND EXISTS (SELECT 1 FROM e o WHERE o.tenant_id = q.tenant_id AND o.tenant_id <> '__global__' AND o.key = al.key))),
 hp AS MATERIALIZED (SELECT h.*, CASE WHEN h.tenant_id = '__global__' THEN false ELSE g.key IS NULL END AS own,
  coalesce(g.first_term, h.first_term) AS at_term, coalesce(g.first_id, h.first_id) AS at_id
  FROM h LEFT JOIN e g ON g.tenant_id = '__global__' AND g.key = h.key AND h.tenant_id <> '__global__')"""


@query("match_glossary", f"{HITS_CTE} SELECT query_id, tenant_id, id, term, expansion FROM h")
def _(src: Source):
    return E.match_glossary(src.f_asks, src.f_glossary).select("query_id", "tenant_id", "id", "term", "expansion")


LISTS_CTE = f"""{HITS_CTE}, ord AS MATERIALIZED (SELECT query_id, trim(term) AS term, trim(expansion) AS expansion, own, at_term, at_id,
  row_number() OVER (PARTITION BY query_id ORDER BY own, at_term, at_id, term, expansion) AS pos FROM hp),
 terms AS MATERIALIZED (SELECT query_id, list(term ORDER BY p) AS matched_terms FROM (SELECT query_id, term, min(pos) AS p FROM ord WHERE term <> '' GROUP BY 1, 2) t GROUP BY 1),
 exps AS MATERIALIZED (SELECT query_id, list(expansion ORDER BY pos) AS expansions FROM ord WHERE expansion <> '' GROUP BY 1),
 asked AS MATERIALIZED (SELECT query_id, tenant_id, trim(question, concat(' ', chr(10), chr(9), chr(13))) AS original FROM @f_asks),
 pre AS MATERIALIZED (SELECT a.query_id, a.tenant_id, a.original, CASE WHEN length(original) >= 2 THEN coalesce(t.matched_terms, []) ELSE [] END AS matched_terms,
   CASE WHEN length(original) >= 2 THEN coalesce(x.expansions, []) ELSE [] END AS expansions
  FROM asked a LEFT JOIN terms t USING (query_id) LEFT JOIN exps x USING (query_id)),
 words AS MATERIALIZED (SELECT query_id, w, {norm('w')} AS nw, pos FROM (SELECT query_id, unnest(list_concat(matched_terms, expansions)) AS w,
   generate_subscripts(list_concat(matched_terms, expansions), 1) AS pos FROM pre) u),
 fresh AS MATERIALIZED (SELECT query_id, arg_min(w, pos) AS w, min(pos) AS pos FROM (SELECT w.*, {norm('p.original')} AS np FROM words w JOIN pre p USING (query_id)) z
   WHERE NOT contains(np, nw) GROUP BY query_id, nw),
 extra AS MATERIALIZED (SELECT query_id, string_agg(w, ' ' ORDER BY pos) AS extra FROM fresh GROUP BY 1),
 final AS MATERIALIZED (SELECT p.*, CASE WHEN extra IS NULL THEN original ELSE concat(original, ' ', extra) END AS retrieval_query FROM pre p LEFT JOIN extra USING (query_id))"""


@query("build_retrieval_query", f"{LISTS_CTE} SELECT query_id, retrieval_query FROM final WHERE len(matched_terms) > 0")
def _(src: Source):
    lists = E.matched_lists(E.match_glossary(src.f_asks, src.f_glossary))
    return E.with_retrieval_text(src.f_asks.join(lists, "query_id").where("size(matched_terms) > 0"), "question").select("query_id", "retrieval_query")


@query("preprocess_queries", f"""{LISTS_CTE} SELECT query_id, original, original AS corrected, array_to_string(matched_terms, '|') AS matched_terms,
 array_to_string(expansions, '|') AS expansions, false AS ai_used, retrieval_query FROM final""")
def _(src: Source):
    return E.preprocess_queries(src.f_asks, src.f_glossary).select(
        "query_id", "original", "corrected", F.array_join("matched_terms", "|").alias("matched_terms"),
        F.array_join("expansions", "|").alias("expansions"), "ai_used", "retrieval_query")


# Replies of a corrector: good ones, rewrites, ambiguous, fenced and broken ones.
CORRECTOR = """SELECT doc_id AS query_id, CASE doc_id % 5
 WHEN 0 THEN concat('{"corrected": "', regexp_replace(text, '[^A-Za-z ]', ' '), ' ok", "expansions": ["one", " ", "two ', lang, '"], "ambiguous": false}')
 WHEN 1 THEN '{"corrected": "something else entirely", "expansions": []}'
 WHEN 2 THEN '{"corrected": "x", "ambiguous": true}' WHEN 3 THEN '{"corrected": "cut off' ELSE '{"expansions": ["extra"]}' END AS reply FROM @documents"""


@query("apply_corrections", f"""WITH a AS MATERIALIZED (SELECT d.doc_id AS query_id, d.lang, trim(d.text, concat(' ', chr(10), chr(9), chr(13))) AS original,
  trim(concat(regexp_replace(d.text, '[^A-Za-z ]', ' ', 'g'), ' ok')) AS good FROM @documents d),
 c AS (SELECT *, CASE query_id % 5 WHEN 0 THEN good WHEN 1 THEN 'something else entirely' END AS proposed, list_filter(list_distinct(string_split({norm('original')}, ' ')), lambda w: w <> '') AS before FROM a),
 r AS (SELECT *, CASE WHEN query_id % 5 = 3 THEN 'ai_parse_error' WHEN query_id % 5 = 2 THEN 'ambiguous' WHEN proposed IS NOT NULL AND len(before) > 0
   AND ((len(before) - len(list_intersect(before, string_split({norm('proposed')}, ' ')))) / len(before) > 0.4 OR length(proposed) > greatest(2 * length(original), length(original) + 60)) THEN 'over_correction' END AS reason FROM c)
 SELECT query_id, reason, CASE WHEN reason IS NULL THEN proposed END AS corrected, CASE WHEN reason IS NULL AND query_id % 5 = 0 THEN concat('one|two ', lang) WHEN reason IS NULL AND query_id % 5 = 4 THEN 'extra' ELSE '' END AS extras FROM r""")
def _(src: Source):
    return E.apply_corrections(src.f_asks, src.sql(CORRECTOR)).withColumn("extras", F.array_join("extras", "|"))


_DIGEST = """md5(concat_ws(chr(31), trim(term), array_to_string(list_sort(list_transform(aliases, lambda a: trim(a))), chr(30)), trim(coalesce(expansion, '')),
 CASE WHEN enabled THEN '1' ELSE '0' END, updated_at))"""
FINGER_SQL = f"""(WITH r AS (SELECT tenant_id, key, CAST(concat('0x', substring({_DIGEST}, 1, 12)) AS BIGINT) AS a, CAST(concat('0x', substring({_DIGEST}, 13, 12)) AS BIGINT) AS b
  FROM {EFFECTIVE_SQL} e), eff AS (SELECT t.tenant_id, r.a, r.b FROM (SELECT DISTINCT tenant_id FROM r) t JOIN r ON r.tenant_id = t.tenant_id
  OR (r.tenant_id = '__global__' AND NOT EXISTS (SELECT 1 FROM r o WHERE o.tenant_id = t.tenant_id AND o.key = r.key)))
 SELECT tenant_id, substring(sha256(concat(CAST(count(*) AS VARCHAR), ':', CAST(sum(a) AS VARCHAR), ':', CAST(sum(b) AS VARCHAR))), 1, 16) AS fingerprint FROM eff GROUP BY 1)"""


@query("glossary_fingerprint", f"SELECT * FROM {FINGER_SQL} f")
def _(src: Source):
    return E.glossary_fingerprint(src.f_glossary)


@query("query_fingerprint", f"""{LISTS_CTE} SELECT query_id, substring(sha256(concat(original, '||', retrieval_query, '||',
 coalesce(f.fingerprint, (SELECT fingerprint FROM {FINGER_SQL} g WHERE tenant_id = '__global__')), '||0')), 1, 16) AS fingerprint FROM final LEFT JOIN {FINGER_SQL} f USING (tenant_id)""")
def _(src: Source):
    return E.query_fingerprint(E.preprocess_queries(src.f_asks, src.f_glossary), E.glossary_fingerprint(src.f_glossary))


@query("glossary_usage", f"""WITH e AS MATERIALIZED {EFFECTIVE_SQL}, al AS MATERIALIZED (SELECT DISTINCT id, term, {norm('x')} AS alias FROM
  (SELECT id, term, unnest(list_append(aliases, term)) AS x FROM e WHERE tenant_id = '__global__') u),
 d AS MATERIALIZED (SELECT doc_id, concat(' ', {norm('text')}, ' ') AS nt FROM @documents)
 SELECT id, term, count(DISTINCT doc_id) AS docs FROM d JOIN al ON alias <> '' AND contains(nt, concat(' ', alias, ' ')) GROUP BY 1, 2""")
def _(src: Source):
    return E.glossary_usage(src.f_docs, src.f_glossary)


# --- cache ---------------------------------------------------------------------

ASKED = """SELECT event_id AS query_id, concat(' Question ', CAST(user_id AS STRING), event_type, ' ') AS question, concat('t', CAST(user_id % 7 AS STRING)) AS tenant_id,
 event_type = 'click' AS generate, CASE WHEN event_id % 3 = 0 THEN 'Cohere' WHEN event_id % 3 = 1 THEN '' END AS reranker,
 CASE WHEN event_id % 5 = 0 THEN 'gpt-4' END AS model, event_id AS stored_no FROM @events"""
KEY_SQL = f"""(SELECT *, sha256(concat(lower(trim(concat(question, CASE WHEN suffix = '' THEN '' ELSE concat(':', suffix) END))), ':', tenant_id)) AS cache_key FROM (
 SELECT *, concat_ws(':', CASE WHEN generate THEN 'gen' END, 'rr:' || nullif(reranker, ''), 'gm:' || nullif(model, '')) AS suffix FROM ({ASKED}) a) s)"""


def keyed(src: Source):
    return src.sql(ASKED).withColumn("cache_key", E.cache_key(F.col("question"), F.col("tenant_id"), F.col("generate"), F.col("reranker"), F.col("model")))


@query("cache_key", f"SELECT query_id, cache_key FROM {KEY_SQL} x")
def _(src: Source):
    return keyed(src).select("query_id", "cache_key")


@query("cache_lookup_exact", f"""SELECT query_id, (SELECT max(c.query_id) FROM {KEY_SQL} c WHERE c.cache_key = q.cache_key AND c.generate AND c.query_id * 259 + 1 <= q.query_id * 259
  AND q.query_id * 259 - (c.query_id * 259 + 1) < 86400) AS answer_id, (SELECT max(c.query_id) FROM {KEY_SQL} c WHERE c.cache_key = q.cache_key AND c.generate
  AND c.query_id * 259 + 1 <= q.query_id * 259 AND q.query_id * 259 - (c.query_id * 259 + 1) < 86400) IS NOT NULL AS cache_hit FROM {KEY_SQL} q""")
def _(src: Source):
    rows = keyed(src)
    stored = rows.where("generate").select("cache_key", F.col("query_id").alias("answer_id"), (F.col("query_id") * 259 + 1).alias("stored_at"))
    asked = rows.select("query_id", "cache_key", (F.col("query_id") * 259).alias("asked_at"))
    return E.cache_lookup_exact(asked, stored).select("query_id", "answer_id", "cache_hit")


@query("cache_lookup_semantic", """WITH c AS MATERIALIZED (SELECT * FROM (SELECT vec_id + 1000000 AS entry_id, label % 3 AS tenant_id, embedding,
  row_number() OVER (PARTITION BY label % 3 ORDER BY vec_id DESC) AS n FROM @embeddings) x WHERE n <= 256)
 SELECT q.vec_id AS query_id, q.label % 3 AS tenant_id, (SELECT max(c.entry_id) FROM c WHERE c.tenant_id = q.label % 3
  AND round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 10) >= 0.3) AS entry_id FROM @embeddings q""")
def _(src: Source):
    asked = src.embeddings.select(F.col("vec_id").alias("query_id"), (F.col("label") % 3).alias("tenant_id"), "embedding")
    stored = src.embeddings.select((F.col("vec_id") + 1000000).alias("entry_id"), (F.col("label") % 3).alias("tenant_id"), "embedding", F.col("vec_id").alias("stored_at"))
    return E.cache_lookup_semantic(asked, stored, similarity=0.3)


# --- planner and grounding -------------------------------------------------------

@query("prior_turns", """WITH p AS (SELECT u.conv_id, u.turn, trim(u.text, concat(' ', chr(10))) AS q, trim(coalesce(a.text, ''), concat(' ', chr(10))) AS a FROM @conversations u
  LEFT JOIN @conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
 l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS fwd, count(*) OVER (PARTITION BY conv_id) AS n FROM p),
 k AS (SELECT *, CAST(fwd - greatest(n - 3, 0) AS VARCHAR) AS no FROM l WHERE back <= 3)
 SELECT conv_id, string_agg(concat('Turno ', no, ' usuario: ', q, CASE WHEN a = '' THEN '' ELSE concat(chr(10), 'Turno ', no, ' asistente: ', a) END), chr(10) ORDER BY turn) AS prior,
  regexp_matches(arg_max(a, turn), '[?¿]') AS is_followup FROM k GROUP BY 1""")
def _(src: Source):
    return G.prior_turns(src.conversations)


@query("retrieval_margin", f"""SELECT query_id, round(max(boosted_score) FILTER (WHERE rank = 1), 6) AS top1, round(coalesce(max(boosted_score) FILTER (WHERE rank = 2), 0), 6) AS top2,
 round(CASE WHEN coalesce(max(boosted_score) FILTER (WHERE rank = 2), 0) = 0 THEN 1 ELSE max(boosted_score) FILTER (WHERE rank = 1) - max(boosted_score) FILTER (WHERE rank = 2) END, 6) AS margin
 FROM {ANSWERS_SQL} x GROUP BY 1""")
def _(src: Source):
    m = G.retrieval_margin(answers_and_related(src)[0].withColumn("score", F.col("boosted_score")))
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("top1", "top2", "margin")])


# The planner's reason quotes the whole text, without what JSON would have to escape.
REASON = "concat('because ', translate(text, concat(chr(9), chr(10), chr(13), chr(34), chr(92)), '     '))"
PLANNED = f"""SELECT doc_id AS query_id, concat('how ', source) AS original, concat('how ', source) AS corrected, concat('how ', source, ' extra') AS retrieval_query,
 CASE doc_id % 7 WHEN 0 THEN concat('{{"action":"search","final_query":"final ', lang, '","confidence":0.9,"reasoning_summary":"', {REASON}, '"}}')
 WHEN 1 THEN concat('<think>hmm {{x}}</think>', chr(10), '```json', chr(10), '{{"action":"ask_clarification","clarification_question":"Which ', lang, '?","confidence":0.', CAST(80 + doc_id % 15 AS STRING), '}}', chr(10), '```')
 WHEN 2 THEN 'not json at all' WHEN 3 THEN '{{"action":"ask_clarification","clarification_question":"","confidence":0.99}}'
 WHEN 4 THEN '{{"action":"no_answer","confidence":"high"}}' WHEN 5 THEN '{{"action": "SEARCH ", "retrieval_query": " r ", "confidence": 7, "is_followup_to_clarification": true}}'
 ELSE '{{"action":"search","final' END AS reply FROM @documents"""


@query("planner_decision", f"""SELECT query_id, CASE WHEN query_id % 7 = 1 AND 80 + query_id % 15 >= 85 THEN 'ask_clarification' ELSE 'search' END AS action, corrected AS corrected_query,
 CASE WHEN query_id % 7 = 0 THEN concat('final ', substring(lg, 1)) ELSE corrected END AS final_query,
 CASE query_id % 7 WHEN 0 THEN concat('final ', lg) WHEN 2 THEN retrieval_query WHEN 6 THEN retrieval_query WHEN 5 THEN 'r' ELSE corrected END AS retrieval_query,
 CASE WHEN query_id % 7 = 1 THEN concat('Which ', lg, '?') ELSE '' END AS clarification_question,
 CASE query_id % 7 WHEN 0 THEN 0.9 WHEN 1 THEN CAST(concat('0.', CAST(80 + query_id % 15 AS VARCHAR)) AS DOUBLE) WHEN 3 THEN 0.99 WHEN 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence,
 CASE WHEN query_id % 7 = 0 THEN trim(reason, concat(' ', chr(10))) ELSE '' END AS reasoning_summary, query_id % 7 = 5 AS is_followup, query_id % 7 NOT IN (2, 6) AS used, CASE WHEN query_id % 7 IN (2, 6) THEN 'parse_error' ELSE '' END AS fallback_reason
 FROM (SELECT p.*, d.lang AS lg, {REASON} AS reason FROM ({PLANNED}) p JOIN @documents d ON d.doc_id = p.query_id) z""")
def _(src: Source):
    return G.planner_decision(src.sql(PLANNED))


def ranked_texts(src: Source):
    answers = answers_and_related(src)[0]
    return (answers.join(src.f_chunks.select("chunk_id", "text"), "chunk_id")
            .withColumn("source_page", F.when(F.col("chunk_id") % 3 > 0, F.col("chunk_id") % 3)).withColumn("score", F.col("boosted_score")))


@query("build_context", f"""SELECT query_id, string_agg(concat('[Excerpt ', CAST(rank AS VARCHAR), ' — ', a.source_doc, CASE WHEN a.chunk_id % 3 > 0 THEN concat(', p.', CAST(a.chunk_id % 3 AS VARCHAR)) ELSE '' END,
 CASE WHEN coalesce(a.source_section, '') <> '' THEN concat(', §', a.source_section) ELSE '' END, ']', chr(10), c.text), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank) AS context
 FROM {ANSWERS_SQL} a JOIN @documents c ON c.doc_id = a.chunk_id GROUP BY 1""")
def _(src: Source):
    return G.build_context(ranked_texts(src))


@query("planner_context", f"""SELECT query_id, string_agg(concat('Fragmento ', CAST(rank AS VARCHAR), ' (score=', printf('%.3f', boosted_score), ', doc=', source_doc,
 CASE WHEN chunk_id % 3 > 0 THEN concat(', página=', CAST(chunk_id % 3 AS VARCHAR)) ELSE '' END, CASE WHEN coalesce(source_section, '') <> '' THEN concat(', sección=', source_section) ELSE '' END, '):', chr(10),
 CASE WHEN length(t) > 500 THEN concat(rtrim(substring(t, 1, 497)), '...') ELSE t END), concat(chr(10), chr(10)) ORDER BY rank) AS fragments
 FROM (SELECT a.*, trim(regexp_replace(c.text, '\\s+', ' ', 'g')) AS t FROM {ANSWERS_SQL} a JOIN @documents c ON c.doc_id = a.chunk_id) x GROUP BY 1""")
def _(src: Source):
    return G.planner_context(ranked_texts(src))


ATTEMPTS = """SELECT user_id AS query_id, event_id AS attempt, CASE event_type WHEN 'click' THEN 'gpt-4' WHEN 'view' THEN 'mystery' ELSE 'gemini-2.5-flash' END AS model,
 CASE WHEN event_type = 'view' THEN '  ' ELSE concat(' answer ', CAST(event_id AS STRING), ' ') END AS text, value < 60 AS failed FROM @events"""


@query("first_success", f"""SELECT a.query_id, coalesce(trim(arg_min(text, attempt) FILTER (WHERE ok)), '') AS text,
 arg_min(CASE WHEN model = 'mystery' THEN 'default' ELSE model END, attempt) FILTER (WHERE ok) AS model, coalesce(min(attempt) FILTER (WHERE ok) > min(attempt), false) AS fell_back
 FROM (SELECT *, NOT failed AND trim(text) <> '' AS ok FROM ({ATTEMPTS}) t) a GROUP BY 1""")
def _(src: Source):
    catalog = dims.small_table(src.spark, [("gpt-4",), ("gemini-2.5-flash",)], "model string")
    return G.first_success(src.sql(ATTEMPTS), catalog, "default")


SENTENCES_SQL = r"""(SELECT answer_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(answer, '([.!?])\s+', concat('\1', chr(1)), 'g'), concat(chr(1), '|\n+')),
 lambda s: regexp_replace(trim(s, concat(' ', chr(9), chr(10), chr(13))), '^\s*(?:[-*•]|\d+[.)])\s*', '')), lambda s: length(s) >= 8) AS s FROM @f_answers)"""


@query("answer_sentences", f"SELECT answer_id, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS sentence_no, unnest(s) AS sentence FROM {SENTENCES_SQL} x")
def _(src: Source):
    return G.answer_sentences(src.f_answers).withColumn("sentence_no", F.col("sentence_no").cast("bigint"))


GROUND_SQL = f"""(WITH s AS MATERIALIZED (SELECT answer_id, generate_subscripts(s, 1) AS no, list_distinct(regexp_extract_all({FOLD.format('unnest(s)')}, '[a-z0-9]{{4,}}')) AS w FROM {SENTENCES_SQL} x),
 c AS MATERIALIZED (SELECT answer_id, regexp_extract_all({FOLD.format('text')}, '[a-z0-9]{{4,}}') AS w FROM @f_answer_chunks WHERE trim(text) <> ''),
 v AS (SELECT s.answer_id, s.no, EXISTS (SELECT 1 FROM c WHERE c.answer_id = s.answer_id) AND (len(s.w) = 0 OR EXISTS (SELECT 1 FROM c WHERE c.answer_id = s.answer_id AND len(list_intersect(s.w, c.w)) >= 2)) AS ok FROM s),
 n AS (SELECT a.answer_id, count(v.no) AS checked, count(*) FILTER (WHERE v.ok) AS good FROM @f_answers a LEFT JOIN v USING (answer_id) GROUP BY 1)
 SELECT answer_id, CASE WHEN checked = 0 THEN 1.0 ELSE good / checked END::DOUBLE AS ratio, checked, checked - good AS unsupported FROM n)"""


@query("ground_answers", f"SELECT answer_id, ratio >= 0.6 AS grounded, round(ratio, 6) AS grounded_ratio, checked, unsupported FROM {GROUND_SQL} g")
def _(src: Source):
    return G.ground_answers(src.f_answers, src.f_answer_chunks).select(
        "answer_id", "grounded", F.round("grounded_ratio", 6).alias("grounded_ratio"), F.col("checked").cast("bigint").alias("checked"), F.col("unsupported").cast("bigint").alias("unsupported"))


_SAFE = G.FALLBACK_ANSWER.replace("'", "''")


@query("guard_answers", f"""SELECT a.answer_id, CASE WHEN c.answer_id IS NOT NULL AND a.answer <> '' AND g.ratio < 0.6 THEN '{_SAFE}' ELSE a.answer END AS answer,
 CASE WHEN c.answer_id IS NOT NULL AND a.answer <> '' THEN g.ratio >= 0.6 END AS grounded, CASE WHEN c.answer_id IS NOT NULL AND a.answer <> '' THEN round_even(g.ratio, 3) END AS grounding_ratio
 FROM @f_answers a JOIN {GROUND_SQL} g USING (answer_id) LEFT JOIN (SELECT DISTINCT answer_id FROM @f_answer_chunks) c USING (answer_id)""")
def _(src: Source):
    return G.guard_answers(src.f_answers, G.ground_answers(src.f_answers, src.f_answer_chunks), src.f_answer_chunks)
