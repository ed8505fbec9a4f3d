"""Text clean-up, classification, chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import dims
from gleaner.functions import text as T
from gleaner.operators import chunking as K
from gleaner.operators import classify as C
from gleaner.operators import documents as D
from gleaner.plans.registry import Source, query
from gleaner.plans.retrieval_plans import FOLD
from gleaner.session import spread

WS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
TOKEN_RE = r"[\p{L}\p{N}_]+|[^\s\p{Z}\x0b\p{L}\p{N}_]"


def tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{TOKEN_RE}'))"


# --- text ------------------------------------------------------------------------

@query("normalize_text", rf"SELECT doc_id, trim(regexp_replace({FOLD.format('text')}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS norm FROM @documents")
def _(src: Source):
    return spread(src.documents).select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


@query("normalize_ascii", rf"SELECT doc_id, trim(regexp_replace({FOLD.format('text')}, '[^a-z0-9\s]', ' ', 'g'), {WS}) AS norm FROM @documents")
def _(src: Source):
    return spread(src.documents).select("doc_id", T.normalize_ascii(F.col("text")).alias("norm"))


@query("fold_accents", f"SELECT doc_id, {FOLD.format('text')} AS folded FROM @documents")
def _(src: Source):
    return spread(src.documents).select("doc_id", T.fold_accents(F.col("text")).alias("folded"))


@query("norm_section", "SELECT doc_id, coalesce(trim(regexp_replace(lower(concat(chr(10), ' ', text)), '\\s+', ' ', 'g')), '') AS section FROM @documents")
def _(src: Source):
    return spread(src.documents).select("doc_id", T.norm_section(F.concat(F.lit("\n "), "text")).alias("section"))


@query("preview", f"""SELECT doc_id, CASE WHEN length(a) > 400 THEN concat(substring(a, 1, 399), '…') ELSE a END AS flat, CASE WHEN length(b) > 800 THEN concat(substring(b, 1, 799), '…') ELSE b END AS plain
 FROM (SELECT doc_id, trim(replace(text, chr(10), ' '), {WS}) AS a, trim(text, {WS}) AS b FROM @documents) x""")
def _(src: Source):
    return spread(src.documents).select("doc_id", T.preview(F.col("text"), 400, flatten=True).alias("flat"), T.preview(F.col("text"), 800).alias("plain"))


NAMES = """SELECT event_id, concat(CASE event_type WHEN 'click' THEN 'up/../' WHEN 'view' THEN substring(md5(CAST(event_id AS STRING)), 1, 12) ELSE '' END, CASE WHEN event_type = 'view' THEN '_' ELSE '' END,
 CASE WHEN event_type = 'signup' THEN '12__1_' ELSE '' END, CASE WHEN event_type = 'error' THEN ' ' ELSE concat('My file #', CAST(user_id AS STRING), '..v', props, '.PDF') END) AS name FROM @events"""


@query("clean_file_names", f"""SELECT event_id, concat(CASE WHEN st = '' THEN 'document' ELSE st END, suf) AS stored, CASE WHEN trim(name) = '' THEN '—' ELSE trim(disp) END AS display FROM (
 SELECT *, substring(replace(trim(regexp_replace(substring(raw, 1, length(raw) - length(suf)), '[^\\w\\s\\-]', '_', 'g')), ' ', '_'), 1, 160) AS st FROM (
  SELECT event_id, name, raw, lower(regexp_extract(raw, '^.+(\\.[^.]+)$', 1)) AS suf, regexp_replace(regexp_replace(base, '^[a-fA-F0-9]{{12}}_(.)', '\\1'), '^\\d+__\\d+_+', '') AS disp FROM (
   SELECT *, CASE WHEN trim(replace(base, '..', '_')) = '' THEN 'document' ELSE trim(replace(base, '..', '_')) END AS raw FROM (SELECT *, regexp_extract(name, '([^/]*)$', 1) AS base FROM ({NAMES}) n) b) r) s) t""")
def _(src: Source):
    return src.sql(NAMES).select("event_id", T.stored_file_name(F.col("name")).alias("stored"), T.display_file_name(F.col("name")).alias("display"))


@query("count_tokens", f"SELECT doc_id, {tokens('text')} AS tokens FROM @documents")
def _(src: Source):
    return spread(src.documents).select("doc_id", T.count_tokens(F.col("text")).cast("bigint").alias("tokens"))


@query("truncate_tokens", rf"""SELECT doc_id, CASE WHEN {tokens('text')} <= 100 THEN text ELSE array_to_string(regexp_extract_all(text, '[\s\p{{Z}}\x0b]*(?:[\p{{L}}\p{{N}}_]+|[^\s\p{{Z}}\x0b\p{{L}}\p{{N}}_])')[1:100], '') END AS cut FROM @documents""")
def _(src: Source):
    return spread(src.documents).select("doc_id", T.truncate_tokens(F.col("text"), 100).alias("cut"))


OCR = """SELECT doc_id, concat('Index ..........oo 12', chr(10), text, chr(10), 'aaaaaaah nooooo......... the the the end   x', chr(10), '1234 5678 90', chr(10), chr(10), chr(10), chr(10), chr(10), 'z') AS text FROM @documents"""


@query("clean_ocr_text")
def _(src: Source):
    return spread(src.sql(OCR)).select("doc_id", T.clean_ocr_text(F.col("text")).alias("clean"))


MARKS = """SELECT doc_id, concat('**==> picture [10 x 20] intentionally omitted <==** Haga CLIC aquí ( ) ', text, ' el icono ( ) y ', source, ' ()') AS text FROM @documents"""


@query("clean_placeholders", """SELECT doc_id, concat(' Haga CLIC aquí (botón) ', text, ' el icono (icono) y ', source, ' (icono)') AS clean FROM @documents""")
def _(src: Source):
    return spread(src.sql(MARKS)).select("doc_id", T.clean_placeholders(F.col("text")).alias("clean"))


@query("route_sparse_pages", f"""SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE length(trim(text, {WS})) < 100) AS sparse, CASE WHEN count(*) FILTER (WHERE length(trim(text, {WS})) < 100) > count(*) * 0.5 THEN 'ocr'
 WHEN count(*) FILTER (WHERE length(trim(text, {WS})) < 100) > 0 THEN 'hybrid' ELSE 'native' END AS route FROM @f_pages GROUP BY 1""")
def _(src: Source):
    return D.route_sparse_pages(src.f_pages)


NOTES = "SELECT conv_id AS doc_id, turn AS slide, text AS note FROM @conversations WHERE role = 'system'"


@query("assemble_pages", f"""SELECT doc_id, CAST(floor(page / 10000) AS BIGINT) AS volume, string_agg(block, concat(chr(10), chr(10)) ORDER BY part, page) AS text FROM (
 SELECT doc_id, CASE WHEN is_ocr THEN 1 ELSE 0 END AS part, page, CASE WHEN is_ocr THEN concat('## Página ', CAST(page + 1 AS VARCHAR), chr(10), chr(10), text) ELSE trim(text, {WS}) END AS block FROM @f_pages WHERE trim(text, {WS}) <> ''
 UNION ALL SELECT doc_id, 2, min(slide), '## Notas del presentador' FROM ({NOTES}) n WHERE trim(note, {WS}) <> '' GROUP BY 1
 UNION ALL SELECT doc_id, 3, slide, concat('**Diapositiva ', CAST(slide + 1 AS VARCHAR), ':** ', trim(note, {WS})) FROM ({NOTES}) n WHERE trim(note, {WS}) <> '') b GROUP BY 1, 2""")
def _(src: Source):
    return D.join_blocks(D.page_blocks(src.f_pages, src.sql(NOTES)))


CAPTIONS = """SELECT l_orderkey AS img, CASE l_linenumber % 3 WHEN 0 THEN 'button' WHEN 1 THEN 'icon' ELSE 'screenshot' END AS kind,
 CASE l_partkey % 7 WHEN 0 THEN 'x' WHEN 1 THEN '12 34 !!' WHEN 2 THEN 'Save file' WHEN 3 THEN 'I''m sorry, too small.' WHEN 4 THEN 'ab cd ef' WHEN 5 THEN repeat('window ', 12) ELSE 'gear icon.' END AS caption, l_linenumber, l_suppkey FROM @lineitem"""


@query("filter_captions", f"""SELECT img, l_linenumber, l_suppkey, kind, CASE kind WHEN 'button' THEN CASE WHEN length(f) >= 2 AND length(regexp_replace(f, '\\P{{L}}', '', 'g')) / length(f) >= 0.6 AND regexp_matches(f, '(^| )\\p{{L}}{{4,}}( |$)') THEN f END
 WHEN 'icon' THEN CASE WHEN regexp_matches(i, '(?i)sorry|too small') THEN 'UI element' WHEN length(i) > 1 AND length(i) < 60 THEN i END
 ELSE CASE WHEN regexp_matches(caption, '(?i)sorry|too small') AND length(s) < 200 THEN concat('[Captura de pantalla: ', CAST(img AS VARCHAR), ']') ELSE s END END AS label
 FROM (SELECT *, trim(regexp_replace(caption, '\\s+', ' ', 'g')) AS f, rtrim(trim(caption), '.') AS i, trim(caption) AS s FROM ({CAPTIONS}) c) x""")
def _(src: Source):
    return src.sql(CAPTIONS).select("img", "l_linenumber", "l_suppkey", "kind", D.caption_label(F.col("kind"), F.col("caption"), F.col("img").cast("string")).alias("label"))


PAGED = """SELECT doc_id, concat('intro', chr(10), '## Página 1', chr(10), text, chr(10), '### Page 2', chr(10), 'end') AS text FROM @documents"""
PAGE_CAPS = """SELECT doc_id, concat('image_p', CAST((doc_id % 4) AS STRING), '_1.png') AS file_name, concat('cap ', lang) AS caption FROM @documents
 UNION ALL SELECT doc_id, 'odd.png', 'loose' FROM @documents WHERE lang = 'fr'"""
_CAP = "concat(chr(10), '![image_p', CAST(doc_id % 4 AS VARCHAR), '_1.png](/corpus/', CAST(doc_id AS VARCHAR), '/media/image_p', CAST(doc_id % 4 AS VARCHAR), '_1.png)', chr(10), '> **📷 Imagen:** cap ', lang, chr(10))"
_LOOSE = "concat('![odd.png](/corpus/', CAST(doc_id AS VARCHAR), '/media/odd.png)', chr(10), '> **📷 Imagen:** loose', chr(10))"


@query("insert_captions", f"""SELECT doc_id, concat('intro', chr(10), CASE WHEN p = 0 THEN concat({_CAP}, CASE WHEN lang = 'fr' THEN concat({_LOOSE}) ELSE '' END, chr(10)) WHEN lang = 'fr' THEN concat(chr(10), {_LOOSE}, chr(10)) ELSE '' END,
 '## Página 1', chr(10), text, chr(10), CASE WHEN p = 1 THEN concat({_CAP}, chr(10)) ELSE '' END, '### Page 2', chr(10), 'end', CASE WHEN p IN (2, 3) THEN concat(chr(10), {_CAP}) ELSE '' END) AS text
 FROM (SELECT *, doc_id % 4 AS p FROM @documents) d""".replace("concat({_LOOSE})", _LOOSE).replace(f"THEN concat({_LOOSE}) ELSE", f"THEN concat(chr(10), {_LOOSE}) ELSE"))
def _(src: Source):
    return D.insert_captions(src.sql(PAGED), src.sql(PAGE_CAPS))


# --- classification -----------------------------------------------------------------

STEM = r"lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', ''))"
OPEN = "lower(text)"


def _has(x: str, words) -> str:
    return "(" + (" OR ".join(f"contains({x}, '{w}')" for w in words) or "false") + ")"


def _two(x: str, words) -> str:
    return "(" + (" + ".join(f"CAST(contains({x}, '{w}') AS INT)" for w in words) or "0") + ") >= 2"


TYPE_SQL = "CASE " + " ".join(f"WHEN {_has('stem', a)} OR {_two('sample', b)} THEN '{t}'" for t, a, b in C.TYPE_RULES) + " ELSE 'structured_manual' END"
OPENED = f"(SELECT doc_id, path, text, {STEM} AS stem, {OPEN} AS sample FROM @f_files)"


@query("heuristic_doc_type", f"SELECT doc_id, {TYPE_SQL} AS doc_type FROM {OPENED} x")
def _(src: Source):
    return C.heuristic_doc_type(spread(src.f_files)).select("doc_id", "doc_type")


RAW_TYPE = "SELECT event_id, CASE event_id % 15 " + " ".join(f"WHEN {i} THEN ' {k.upper()} '" for i, k in enumerate([*C.TYPE_ALIASES, "structured_manual", "changelog_pure"])) + " ELSE 'mystery' END AS raw FROM @events"


@query("normalize_doc_type", f"""SELECT event_id, CASE WHEN lower(trim(raw)) IN ({', '.join(f"'{t}'" for t in C.CANONICAL_TYPES)}) THEN lower(trim(raw)) {' '.join(f"WHEN lower(trim(raw)) = '{a}' THEN '{b}'" for a, b in C.TYPE_ALIASES.items())}
 ELSE 'structured_manual' END AS doc_type FROM ({RAW_TYPE}) r""")
def _(src: Source):
    return src.sql(RAW_TYPE).select("event_id", C.normalize_doc_type(F.col("raw")).alias("doc_type"))


VERSIONS_SQL = rf"""(SELECT *, CASE WHEN len(v) > 0 THEN v[1] ELSE 0.0 END::DOUBLE AS version_min, CASE WHEN len(v) > 1 THEN v[-1] END AS version_max FROM (
 SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(sample, '(?:versi[oó]n|v\.?)\s*(\d+(?:\.\d+)?(?:\.\d+)?)', 1), lambda s: CAST(regexp_extract(s, '^\d+(?:\.\d+)?') AS DOUBLE)))) AS v FROM {OPENED} o) z)"""


@query("extract_versions", f"SELECT doc_id, version_min, version_max FROM {VERSIONS_SQL} x")
def _(src: Source):
    return C.extract_versions(spread(src.f_files)).select("doc_id", "version_min", "version_max")


MODULE_SQL = rf"""coalesce(nullif(trim(regexp_extract(sample, '(?:m[oó]dulo|module)[\s\p{{Z}}]*[:\-]?[\s\p{{Z}}]*([\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_\s\p{{Z}}]{{1,30}})', 1), {WS}), ''), CASE {' '.join(f"WHEN contains(stem, '{w}') OR contains(sample, '{w}') THEN '{w}'" for w in C.MODULE_WORDS)} END)"""
ROBOT_SQL = f"{_has('stem', C.INTEGRATION_WORDS)} OR {_has('sample', C.INTEGRATION_WORDS)} OR contains(lower(path), 'robots')"


@query("extract_module", f"SELECT doc_id, {MODULE_SQL} AS module_id FROM {OPENED} x")
def _(src: Source):
    return spread(src.f_files).select("doc_id", C.extract_module(C.file_stem(F.col("path")), C.opening(F.col("text"))).alias("module_id"))


@query("flag_integration_docs", f"SELECT doc_id, {ROBOT_SQL} AS is_robot_doc FROM {OPENED} x")
def _(src: Source):
    return spread(src.f_files).select("doc_id", C.is_integration_doc(F.col("path"), C.file_stem(F.col("path")), C.opening(F.col("text"))).alias("is_robot_doc"))


CHANGELOG_SQL = f"""(SELECT *, CASE WHEN raw_type = 'changelog_pure' AND {_two('sample', C.FUNCTIONAL_WORDS)} THEN 'changelog_as_manual' ELSE raw_type END AS doc_type,
 raw_type = 'changelog_pure' AND NOT ({_two('sample', C.FUNCTIONAL_WORDS)}) AND length(trim(text, {WS})) < 200 AS discard FROM (SELECT *, {TYPE_SQL} AS raw_type FROM {VERSIONS_SQL} v) c)"""


@query("apply_changelog_rules", f"SELECT doc_id, doc_type, discard FROM {CHANGELOG_SQL} x")
def _(src: Source):
    return C.apply_changelog_rules(C.heuristic_doc_type(spread(src.f_files)).withColumn("discard", F.lit(False))).select("doc_id", "doc_type", "discard")


def _lang_sql(x: str) -> str:
    w = f"regexp_extract_all(lower({x}), '\\p{{L}}+')"
    votes = ", ".join(f"{{'n': len(list_filter({w}, lambda t: list_contains([{', '.join(repr(s) for s in stop)}], t))), 'r': {-i}, 'l': '{lang}'}}"
                      for i, (lang, stop) in enumerate(sorted(C.STOP_WORDS.items())))
    return f"(SELECT CASE WHEN b.n > 0 THEN b.l ELSE 'en' END FROM (SELECT list_sort([{votes}], 'DESC')[1] AS b) q)"


@query("guess_language", f"SELECT doc_id, lang, {_lang_sql('text')} AS guess FROM @documents d")
def _(src: Source):
    return C.guess_language(spread(src.documents)).select("doc_id", "lang", "guess")


TYPE_REPLY = """SELECT doc_id, text, CASE doc_id % 6 WHEN 0 THEN concat('```json', chr(10), '{"type_id":"FAQ","confidence":1.7,"pipeline_hints":{"discard":true}}', chr(10), '```')
 WHEN 1 THEN 'Sure! {"type_id":"technical_spec"} done' WHEN 2 THEN 'no json here' WHEN 3 THEN '{"type_id":"unknown"}' WHEN 4 THEN '{"type_id":"user_manual","confidence":"high","pipeline_hints":"none"}' ELSE '{"type_id":' END AS reply FROM @documents"""
TYPE_REPLY_SQL = f"""(SELECT doc_id, CASE WHEN ok THEN CASE doc_id % 6 WHEN 0 THEN 'FAQ' WHEN 1 THEN 'technical_spec' ELSE 'user_manual' END END AS type_id, CASE WHEN ok THEN CASE WHEN doc_id % 6 = 0 THEN 1.0 ELSE 0.7 END END::DOUBLE AS confidence,
 CASE WHEN ok THEN doc_id % 6 = 0 END AS discard FROM (SELECT doc_id, length(trim(text, {WS})) >= 40 AND doc_id % 6 IN (0, 1, 4) AS ok FROM @documents) x)"""


@query("parse_type_reply", f"SELECT * FROM {TYPE_REPLY_SQL} x")
def _(src: Source):
    return C.parse_type_reply(src.sql(TYPE_REPLY))


@query("classify_documents", f"""SELECT doc_id, CASE WHEN r_type IS NULL THEN base_type WHEN r_type = 'FAQ' THEN 'faq_document' WHEN r_type = 'user_manual' THEN 'structured_manual' ELSE r_type END AS doc_type,
 CASE WHEN r_type IS NULL THEN base_discard ELSE r_discard END AS discard, version_min, version_max, module_id, is_robot_doc, lang, format, source_file FROM (
 SELECT c.doc_id, c.doc_type AS base_type, c.discard AS base_discard, r.type_id AS r_type, r.discard AS r_discard, version_min, version_max, {MODULE_SQL} AS module_id, {ROBOT_SQL} AS is_robot_doc, {_lang_sql('c.text')} AS lang,
 CASE WHEN lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN ('pdf', 'docx', 'pptx', 'xlsx') THEN lower(regexp_extract(path, '\\.([^./]*)$', 1)) ELSE 'pdf' END AS format, regexp_extract(path, '([^/]*)$', 1) AS source_file
 FROM {CHANGELOG_SQL} c LEFT JOIN {TYPE_REPLY_SQL} r ON r.doc_id = c.doc_id) z""")
def _(src: Source):
    parsed = C.parse_type_reply(src.sql(TYPE_REPLY))
    return C.classify_documents(src.f_files.drop("lang"), parsed).drop("path", "text")


# --- chunking ---------------------------------------------------------------------------

HEAD = r"#{1,4}[ \t\x0b\f\r\p{Z}]"


def bodies(x: str) -> str:
    return f"string_split(regexp_replace({x}, '\\n({HEAD}[^\\n])', concat(chr(1), '\\1'), 'g'), chr(1))"


SECTIONS_CTE = f"""sec AS MATERIALIZED (SELECT doc_id, generate_subscripts(b, 1) - 1 AS section_no, unnest(b) AS body FROM (SELECT doc_id, {bodies('text')} AS b FROM @f_md) x),
 hd AS MATERIALIZED (SELECT *, CASE WHEN regexp_matches(body, '^{HEAD}[^\\n]') THEN length(regexp_extract(body, '^(#+)', 1)) ELSE 0 END AS level, trim(regexp_extract(body, '^#+[ \\t]+([^\\n]*)', 1), {WS}) AS title FROM sec),
 pt AS (SELECT doc_id, section_no, body, CASE WHEN level = 0 THEN CAST([] AS VARCHAR[]) ELSE [title] END AS stack FROM hd WHERE section_no = 0
  UNION ALL SELECT h.doc_id, h.section_no, h.body, list_append(CASE WHEN h.level <= len(p.stack) THEN p.stack[1:h.level - 1] ELSE p.stack END, h.title) FROM pt p JOIN hd h ON h.doc_id = p.doc_id AND h.section_no = p.section_no + 1),
 paths AS MATERIALIZED (SELECT doc_id, section_no, body, array_to_string(stack, ' > ') AS path FROM pt)"""


def pack_cte(source: str) -> str:
    """Greedy packing of ``source`` (doc_id, piece, path, body, max_tokens) by recursion over paragraphs."""
    return f"""big AS MATERIALIZED (SELECT * FROM {source} s WHERE {tokens('body')} > max_tokens),
 para AS MATERIALIZED (SELECT doc_id, piece, max_tokens, generate_subscripts(ps, 1) AS i, unnest(ps) AS p, {tokens('unnest(ps)')} AS n FROM (SELECT *, string_split(body, concat(chr(10), chr(10))) AS ps FROM big) x),
 walk AS (SELECT doc_id, piece, max_tokens, i, p, n AS total, CAST(0 AS BIGINT) AS part FROM para WHERE i = 1
  UNION ALL SELECT q.doc_id, q.piece, q.max_tokens, q.i, q.p, CASE WHEN w.total + q.n > q.max_tokens THEN q.n ELSE w.total + q.n END, CASE WHEN w.total + q.n > q.max_tokens THEN w.part + 1 ELSE w.part END
  FROM walk w JOIN para q ON q.doc_id = w.doc_id AND q.piece = w.piece AND q.i = w.i + 1),
 packed AS MATERIALIZED (SELECT doc_id, piece, part, string_agg(p, concat(chr(10), chr(10)) ORDER BY i) AS raw FROM walk GROUP BY 1, 2, 3),
 cut AS MATERIALIZED (SELECT doc_id, piece, path, image, CAST(0 AS BIGINT) AS part, body AS raw FROM {source} s WHERE {tokens('body')} <= max_tokens
  UNION ALL SELECT k.doc_id, k.piece, s.path, s.image, k.part, k.raw FROM packed k JOIN {source} s ON s.doc_id = k.doc_id AND s.piece = k.piece),
 chunks AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY piece, part) - 1 AS chunk_index FROM cut)"""


@query("split_sections", f"WITH RECURSIVE {SECTIONS_CTE} SELECT doc_id, section_no, body FROM sec")
def _(src: Source):
    return K.split_sections(src.f_md).withColumn("section_no", F.col("section_no").cast("bigint"))


@query("section_paths", f"WITH RECURSIVE {SECTIONS_CTE} SELECT doc_id, section_no, path, body FROM paths")
def _(src: Source):
    return K.section_paths(src.f_md).withColumn("section_no", F.col("section_no").cast("bigint"))


def chunk_sql(source: str, before: str = "") -> str:
    return f"""WITH RECURSIVE {before} src AS MATERIALIZED ({source}), {pack_cte('src')} SELECT doc_id, chunk_index, path AS section_path, raw, image AS has_image_caption FROM chunks"""


_IMG = "contains(body, '[Imagen:') OR contains(body, '**📷 Imagen:**')"


def slim(df):
    return df.withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@query("pack_paragraphs", f"""WITH RECURSIVE src AS MATERIALIZED (SELECT doc_id, 0 AS piece, '' AS path, text AS body, 60 AS max_tokens, false AS image FROM @f_md), {pack_cte('src')} SELECT doc_id, chunk_index AS part, raw FROM chunks""")
def _(src: Source):
    return (src.f_md.select("doc_id", F.posexplode(K.pack_paragraphs(F.col("text"), F.lit(60))).alias("part", "raw"))
            .withColumn("part", F.col("part").cast("bigint")))


@query("chunk_sections", chunk_sql(f"SELECT doc_id, section_no AS piece, path, body, 60 AS max_tokens, {_IMG} AS image FROM paths", SECTIONS_CTE + ","))
def _(src: Source):
    return slim(K.chunk_unit(src.f_md, "section", 60))


_QA = r"(?i)(?:^|\n)(?:#{1,4}\s*)?(?:P(?:regunta)?|Q)\s*[:\.\-]\s*"
QA_CTE = f"""qa AS MATERIALIZED (SELECT doc_id, generate_subscripts(b, 1) AS piece, unnest(b) AS body FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '{_QA}'), lambda s: trim(s, {WS})), lambda s: s <> '') AS b FROM @f_md) x)"""


@query("chunk_qa", chunk_sql(f"SELECT doc_id, piece, '' AS path, body, 60 AS max_tokens, false AS image FROM qa UNION ALL SELECT doc_id, section_no, path, body, 60, {_IMG} FROM paths WHERE doc_id NOT IN (SELECT doc_id FROM qa)", f"{SECTIONS_CTE}, {QA_CTE},"))
def _(src: Source):
    return slim(K.chunk_unit(src.f_md, "qa_pair", 60))


@query("chunk_procedures", chunk_sql("SELECT doc_id, section_no AS piece, path, body, 60 AS max_tokens, false AS image FROM paths", SECTIONS_CTE + ","))
def _(src: Source):
    return slim(K.chunk_unit(src.f_md, "procedure", 60))


@query("chunk_single", chunk_sql("SELECT doc_id, 0 AS piece, '' AS path, text AS body, 60 AS max_tokens, false AS image FROM @f_md"))
def _(src: Source):
    return slim(K.chunk_unit(src.f_md, "single", 60))


SMALL_RULES = [(t, u, m // 10, a, b, c) for t, u, m, a, b, c in dims.DOC_TYPE_RULES]
def rules_sql(rules) -> str:
    return "(VALUES " + ", ".join(f"('{t}', '{u}', {m}, {a}, {b}, {c})" for t, u, m, a, b, c in rules) + ") r(doc_type, chunk_unit, max_tokens, breadcrumb, module_name, procedure_title)"


RULES_SQL = rules_sql(SMALL_RULES)
_S, _M, _P = (f"concat('{label}: ', {col}, chr(10), chr(10), {{}})" for label, col in (("Sección", "path"), ("Módulo", "module_id"), ("Procedimiento", "path")))


def _prefixed() -> str:
    t = "raw"
    t = f"CASE WHEN breadcrumb AND path <> '' THEN {_S.format(t)} ELSE {t} END"
    t = f"CASE WHEN module_name AND coalesce(module_id, '') <> '' THEN {_M.format(t)} ELSE {t} END"
    return f"CASE WHEN procedure_title AND path <> '' THEN {_P.format(t)} ELSE {t} END"


def doc_chunks_sql(typed: str, rules: str) -> str:
    """CTEs down to ``chunks`` for typed documents (doc_id, text, doc_type, module_id, lang)."""
    return f"""WITH RECURSIVE {SECTIONS_CTE}, {QA_CTE}, m AS MATERIALIZED (SELECT d.*, chunk_unit, max_tokens, breadcrumb, module_name, procedure_title FROM ({typed}) d JOIN {rules} ON r.doc_type = d.doc_type),
 src AS MATERIALIZED (SELECT m.doc_id, 0 AS piece, '' AS path, text AS body, max_tokens, false AS image FROM m WHERE chunk_unit = 'single'
  UNION ALL SELECT m.doc_id, piece, '', body, max_tokens, false FROM m JOIN qa ON qa.doc_id = m.doc_id WHERE chunk_unit = 'qa_pair'
  UNION ALL SELECT m.doc_id, section_no, path, body, max_tokens, chunk_unit <> 'procedure' AND ({_IMG}) FROM m JOIN paths p ON p.doc_id = m.doc_id WHERE chunk_unit NOT IN ('single', 'qa_pair') OR (chunk_unit = 'qa_pair' AND m.doc_id NOT IN (SELECT doc_id FROM qa))),
 {pack_cte('src')}"""


DOC_CHUNKS_SQL = doc_chunks_sql("SELECT doc_id, text, doc_type, module_id, lang FROM @f_md", RULES_SQL)


@query("chunk_documents", f"""{DOC_CHUNKS_SQL} SELECT doc_id, chunk_index, nullif(path, '') AS source_section, image AS has_image_caption, {_prefixed()} AS text FROM (
 SELECT c.doc_id, chunk_index, path, image, trim(raw, {WS}) AS raw, module_id, breadcrumb, module_name, procedure_title FROM chunks c JOIN m ON m.doc_id = c.doc_id) z WHERE raw <> ''""")
def _(src: Source):
    chunks, _empty = K.chunk_documents(src.f_md, dims.small_table(src.spark, SMALL_RULES, dims.RULE_SCHEMA))
    return slim(chunks.select("doc_id", "chunk_index", "source_section", "has_image_caption", "text"))


# The whole pipeline over the same documents: classified, chunked with the full rules, counted.
INGEST_TEXTS = "(SELECT doc_id, concat('/docs/', source_doc) AS path, text FROM @f_md)"
INGEST_TYPED = f"""SELECT doc_id, text, doc_type, {MODULE_SQL} AS module_id, {_lang_sql('text')} AS lang FROM {CHANGELOG_SQL.replace('@f_files', INGEST_TEXTS)} c
 WHERE NOT discard AND trim(text, {WS}) <> '' AND doc_id NOT IN (SELECT doc_id FROM @labels WHERE toxic = 1)"""
INGEST_SQL = f"""{doc_chunks_sql(INGEST_TYPED, rules_sql(dims.DOC_TYPE_RULES))} SELECT doc_id, doc_type, lang, count(*) AS chunks, CAST(sum(length({_prefixed()})) AS BIGINT) AS chars, CAST(NULL AS VARCHAR) AS error FROM (
 SELECT c.doc_id, m.doc_type, m.lang, path, trim(raw, {WS}) AS raw, module_id, breadcrumb, module_name, procedure_title FROM chunks c JOIN m ON m.doc_id = c.doc_id) z WHERE raw <> '' GROUP BY 1, 2, 3
 UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, 'empty conversion result' FROM @f_md WHERE trim(text, {WS}) = '' AND doc_id NOT IN (SELECT doc_id FROM @labels WHERE toxic = 1)"""
