"""Projections of the given tables that play the engine's inputs.

Text that runs unchanged on Spark and on the comparison engine.
"""

TABLES = frozenset(
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations".split()
)

_TYPES = ("structured_manual", "module_manual", "operational_guide", "changelog_as_manual",
          "changelog_pure", "faq_document", "technical_spec", "training_material")


def _doc_type(key: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES))
    return f"CASE {key} % 8 {whens} END"


PROJECTIONS: dict[str, str] = {}

PROJECTIONS["f_docs"] = """
SELECT doc_id, concat(source, '_', lang, '.md') AS source_doc, text, lang, n_chars FROM @documents"""

# Documents with headings, question marks and paragraphs, made from their own lines.
PROJECTIONS["f_md"] = f"""
SELECT doc_id, concat(source, '_', lang, '.md') AS source_doc, lang, {_doc_type('doc_id')} AS doc_type,
 CASE doc_id % 5 WHEN 2 THEN 'alpha' WHEN 3 THEN 'beta' WHEN 4 THEN 'gamma' END AS module_id,
 concat(CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('# ', source, chr(10), chr(10)) END,
  replace(replace(replace(replace(replace(replace(text, chr(10), concat(chr(10), chr(10))),
   concat(chr(10), 'T'), concat(chr(10), '## T')), concat(chr(10), 'E'), concat(chr(10), '### E')),
   concat(chr(10), 'A'), concat(chr(10), '#### A')), concat(chr(10), 'O'), concat(chr(10), '# O')),
   concat(chr(10), 'I'), concat(chr(10), 'Q: I'))) AS text
FROM @documents"""

PROJECTIONS["f_pages"] = """
SELECT conv_id AS doc_id, turn AS page, text, role = 'assistant' AS is_ocr FROM @conversations"""

PROJECTIONS["f_chunks"] = f"""
SELECT doc_id AS chunk_id, doc_id, concat(source, '_', lang, '.md') AS source_doc,
 CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('Part ', CAST(doc_id % 9 AS STRING)) END AS source_section, lang, text,
 {_doc_type('doc_id')} AS doc_type,
 CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'alpha' WHEN 3 THEN 'beta' ELSE 'gamma' END AS module_id,
 CAST(doc_id % 7 AS DOUBLE) AS version_min,
 CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id % 7 + doc_id % 4 AS DOUBLE) END AS version_max,
 doc_id % 11 = 0 AS is_robot_doc, doc_id % 13 = 0 AS has_image_caption FROM @documents"""

PROJECTIONS["f_vectors"] = "SELECT vec_id AS chunk_id, embedding FROM @embeddings"

PROJECTIONS["f_queries"] = """
SELECT vec_id AS query_id, embedding, concat('  Src', CAST(vec_id % 20 AS STRING), ' by the of en?') AS question,
 CASE vec_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'narrow' ELSE 'versioned' END AS tenant_id
FROM @embeddings"""

PROJECTIONS["f_answers"] = """
SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS answer_id, conv_id, turn, text AS answer
FROM @conversations WHERE role = 'assistant'"""

PROJECTIONS["f_answer_chunks"] = """
SELECT concat(CAST(a.conv_id AS STRING), '-', CAST(a.turn AS STRING)) AS answer_id, a.conv_id, a.turn,
 c.turn AS chunk_turn, c.text
FROM (SELECT conv_id, turn, @one_to_five AS back FROM @conversations WHERE role = 'assistant') a
JOIN @conversations c ON a.conv_id = c.conv_id AND c.turn = a.turn - a.back AND c.role = 'user'"""

PROJECTIONS["f_cost"] = """
SELECT event_id, CAST(ts AS STRING) AS ts,
 CASE event_type WHEN 'click' THEN 'google' WHEN 'view' THEN 'google' WHEN 'purchase' THEN 'openai_compat'
  WHEN 'signup' THEN 'cohere' ELSE 'mystery' END AS provider,
 CASE event_type WHEN 'click' THEN 'gemini-2.5-flash' WHEN 'view' THEN 'gemini-2.5-flash-lite'
  WHEN 'purchase' THEN 'gpt-4' WHEN 'signup' THEN 'rerank' ELSE '' END AS model,
 CASE event_type WHEN 'signup' THEN 'rerank' ELSE 'generate_text' END AS operation,
 CAST(floor(value * 100) AS DOUBLE) AS units_in, CAST(floor(value * 10) AS DOUBLE) AS units_out,
 CAST(user_id % 3 AS DOUBLE) AS qty FROM @events"""

PROJECTIONS["f_feedback"] = """
SELECT event_id AS line_no, CASE WHEN event_id % 10 = 0 THEN NULL ELSE concat('fb', CAST(event_id AS STRING)) END AS feedback_id,
 concat('q', CAST(user_id AS STRING)) AS query_id, CAST(ts AS STRING) AS timestamp_text,
 CASE WHEN event_type = 'click' THEN 'ok' ELSE 'not_ok' END AS rating, CAST(event_id % 6 AS INT) AS stars
FROM @events WHERE event_type IN ('click', 'view')"""

PROJECTIONS["f_reviews"] = """
SELECT event_id AS line_no, CASE WHEN event_id % 9 = 0 THEN ' ' ELSE concat('fb', CAST(event_id - event_id % 4 AS STRING)) END AS feedback_id,
 CASE event_id % 5 WHEN 0 THEN ' Resolved ' WHEN 1 THEN 'dismissed' WHEN 2 THEN 'acknowledged' WHEN 3 THEN 'open' ELSE 'bogus' END AS action,
 CAST(ts AS STRING) AS timestamp_text FROM @events WHERE event_type <> 'click'"""

PROJECTIONS["f_calls"] = """
SELECT md5(CAST(o_custkey AS STRING)) AS source_file_hash, concat('CALL-', CAST(o_orderkey AS STRING)) AS call_id,
 concat('rec', CAST(o_custkey AS STRING), '.mp3') AS source_file, o_orderkey, c_name AS customer, o_orderpriority AS agent_id,
 o_orderstatus = 'F' AS resolved, c_mktsegment AS tag1, substring(o_orderpriority, 3) AS tag2,
 concat('Issue ', CAST(o_orderkey % 97 AS STRING), ' with ', c_mktsegment) AS problem,
 concat('caller of ', c_name) AS caller, concat('agent ', o_orderpriority) AS agent, concat('0', CAST(o_orderkey % 10 AS STRING), ':00') AS timestamp_start, concat('1', CAST(o_orderkey % 10 AS STRING), ':00') AS timestamp_end,
 CAST(o_orderdate AS STRING) AS indexed_at
FROM @orders JOIN @customer ON c_custkey = o_custkey"""

PROJECTIONS["f_images"] = """
SELECT l_orderkey AS doc_id, l_linenumber AS page, l_partkey AS image_no, CAST(l_quantity * 12 AS INT) AS w,
 CAST(1 + l_suppkey % 400 AS INT) AS h, l_discount * 5000 AS x0, l_tax * 9000 AS y0,
 l_discount * 5000 + l_quantity * 12 AS x1, l_tax * 9000 + 1 + l_suppkey % 400 AS y1,
 595.0 AS page_w, 842.0 AS page_h FROM @lineitem"""

PROJECTIONS["f_words"] = """
SELECT l_orderkey AS doc_id, l_linenumber % 3 AS page, l_partkey AS word_no, l_discount * 5000 + 30 AS x0, l_tax * 9000 + 45 AS y0,
 l_discount * 5000 + 60 AS x1, l_tax * 9000 + 55 AS y1 FROM @lineitem"""

# One question per labelled document, its whole text; the document is the gold source.
PROJECTIONS["f_pairs"] = f"""
SELECT d.doc_id AS pair_id, d.text AS question, d.text AS answer, d.doc_id AS gold_chunk_id,
 concat(d.source, '_', d.lang, '.md') AS source_doc,
 CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE concat(' PART  ', CAST(d.doc_id % 9 AS STRING)) END AS source_section,
 {_doc_type('d.doc_id')} AS doc_type,
 CASE WHEN d.doc_id % 13 = 0 THEN 'L3' WHEN d.doc_id % 2 = 0 THEN 'L2' ELSE 'L1' END AS difficulty,
 l.quality = 1 AS validated, l.toxic = 1 AS failed, d.text AS chunk_text_preview
FROM @documents d JOIN @labels l ON l.doc_id = d.doc_id"""

# Five ranked answers for every pair whose retrieval did not fail.
PROJECTIONS["f_pair_answers"] = """
SELECT p.pair_id, p.rank, CASE WHEN (p.pair_id + p.rank) % 6 = 0 THEN p.gold_chunk_id ELSE p.gold_chunk_id + 1000000 + p.rank END AS chunk_id,
 CASE WHEN (p.pair_id + p.rank) % 7 = 0 THEN p.source_doc ELSE concat('other', CAST(p.rank AS STRING)) END AS source_doc,
 CASE WHEN p.pair_id % 4 = 0 THEN 'x' ELSE concat('Part ', CAST(p.pair_id % 9 AS STRING)) END AS source_section,
 1.0 - 0.01 * p.rank AS score, concat('text of ', CAST(p.pair_id AS STRING), chr(10), ' ', p.answer) AS text
FROM (SELECT *, @one_to_five AS rank FROM @f_pairs WHERE NOT failed) p"""

# Glossary entries from documents: aliases are word pairs and triples of their openings.
PROJECTIONS["f_glossary"] = """
SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN '__global__' WHEN 1 THEN 'open' ELSE 'narrow' END AS tenant_id,
 concat(source, ' ', CAST(doc_id % 40 AS STRING)) AS term,
 @array(concat(split_part(text, ' ', 2), ' ', split_part(text, ' ', 3)),
  concat(split_part(text, ' ', 4), ' ', split_part(text, ' ', 5), ' ', split_part(text, ' ', 6)), ' ') AS aliases,
 CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE concat(lang, ' ', split_part(text, ' ', 2)) END AS expansion,
 doc_id % 17 <> 0 AS enabled, '2024-01-01' AS updated_at FROM @documents WHERE length(text) > 0"""

# Whole texts as questions, so that glossary aliases do occur in them.
PROJECTIONS["f_asks"] = """
SELECT doc_id AS query_id, concat('  ', text, ' ') AS question,
 CASE doc_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'narrow' WHEN 2 THEN 'other' END AS tenant_id FROM @documents"""

PROJECTIONS["f_segments"] = """
SELECT user_id AS recording_id, event_id AS seg_id, ts, value AS dur_s, event_type AS speaker,
 CASE WHEN event_id % 17 = 0 THEN ' ' ELSE props END AS text FROM @events"""

PROJECTIONS["f_requests"] = """
SELECT user_id AS client, ts, event_id, event_type = 'purchase' AS heavy FROM @events"""

# Files with telling names and openings.
PROJECTIONS["f_files"] = """
SELECT doc_id, concat('/docs/', CASE doc_id % 13 WHEN 0 THEN 'FAQ_' WHEN 1 THEN 'guia-' WHEN 2 THEN 'Changelog ' WHEN 3 THEN 'modulo_' WHEN 4 THEN 'training.' WHEN 5 THEN 'spec_'
  WHEN 6 THEN 'manual_' WHEN 7 THEN 'robots/note' ELSE 'doc_' END, source, '_', CAST(doc_id AS STRING), CASE doc_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' ELSE '.md' END) AS path,
 concat(CASE doc_id % 9 WHEN 0 THEN concat('Versión 4.', CAST(doc_id % 6 AS STRING), ' y v. 5.1.2 en pantalla con botón. ') WHEN 1 THEN 'Module: Stock Control, v3 ' WHEN 2 THEN '¿Pregunta? Respuesta. '
  WHEN 3 THEN 'La novedad de la configuración: versión 7 ' WHEN 4 THEN 'diapositiva slide connector ' WHEN 5 THEN 'endpoint parámetro ' ELSE '' END,
  text) AS text, lang FROM @documents"""
