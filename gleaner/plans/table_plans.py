"""Sources, sinks, table maintenance, corpus bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import dims
from gleaner.operators import corpus as O
from gleaner.operators import maintenance as M
from gleaner.plans.registry import Source, query
from gleaner.session import scratch_path, spread
from gleaner.sources import markup, readers, writers

# --- sources and sinks -----------------------------------------------------


@query("scan_files")
def _(src: Source):
    return readers.scan_files(src.spark, src.sf_dir, ("parquet",)).select("name", "length")


LOG_SQL = """SELECT event_id, CASE event_id % 7 WHEN 0 THEN '' WHEN 3 THEN '{"id": 1, "user":' WHEN 5 THEN '[1, 2]'
 ELSE concat('{"id": ', CAST(event_id AS STRING), ', "user": "u', CAST(user_id AS STRING), '"}') END AS line FROM @events"""


@query("scan_jsonl_tolerant", """SELECT event_id AS id, concat('u', CAST(user_id AS VARCHAR)) AS "user" FROM @events
 WHERE event_id % 7 NOT IN (0, 3, 5)""")
def _(src: Source):
    path = scratch_path(src.spark, "tolerant-log")
    src.sql(LOG_SQL).select("line").write.text(path)
    return readers.scan_jsonl_tolerant(src.spark, path, "id bigint, user string")


@query("scan_jsonl_strict", """SELECT event_id, user_id, event_type FROM @events""")
def _(src: Source):
    path = scratch_path(src.spark, "strict-log")
    writers.append_log(src.events.select("event_id", "user_id", "event_type"), path)
    return readers.scan_jsonl_strict(src.spark, path, "event_id bigint, user_id bigint, event_type string")


@query("append_log", """SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (
 SELECT * FROM @events UNION ALL SELECT * FROM @events WHERE event_type = 'error') e GROUP BY 1""")
def _(src: Source):
    path = scratch_path(src.spark, "log")
    log = src.events.select("event_id", "event_type")
    writers.append_log(log, path)
    writers.append_log(log.where("event_type = 'error'"), path)
    rows = readers.scan_jsonl_strict(src.spark, path, "event_id bigint, event_type string")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("scan_chunks", "SELECT chunk_id, doc_type, module_id, length(text) AS chars FROM @f_chunks")
def _(src: Source):
    path = scratch_path(src.spark, "chunks")
    writers.write_chunks(src.f_chunks, path)
    return readers.scan_chunks(src.spark, path).select("chunk_id", "doc_type", "module_id", F.length("text").cast("bigint").alias("chars"))


@query("write_chunks", "SELECT doc_type, count(*) AS chunks, count(DISTINCT doc_id) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM @f_chunks GROUP BY 1")
def _(src: Source):
    path, meta = scratch_path(src.spark, "chunks"), scratch_path(src.spark, "doc-meta")
    writers.write_chunks(src.f_chunks, path, src.f_chunks.select("doc_id", "doc_type"), meta)
    docs = src.spark.read.parquet(meta).groupBy("doc_type").agg(F.count_distinct("doc_id").alias("docs"))
    chunks = readers.scan_chunks(src.spark, path).groupBy("doc_type").agg(
        F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))
    return chunks.join(docs, "doc_type")


@query("scan_doc_metadata", "SELECT concat(source, '_', lang) AS doc_id, lang, count(*) AS n FROM @documents GROUP BY source, lang")
def _(src: Source):
    root = scratch_path(src.spark, "corpus")
    rows = src.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    rows = rows.withColumn("doc_id", F.concat("source", F.lit("_"), "lang"))
    rows.select("doc_id", "lang", "n", F.col("doc_id").alias("folder")).write.partitionBy("folder").json(root)
    return readers.scan_doc_metadata(src.spark, root, "doc_id string, lang string, n bigint", file_glob="part-*.json")


@query("dim_tables", """SELECT d.doc_type, coalesce(r.chunk_unit, 'section') AS chunk_unit, CAST(coalesce(r.max_tokens, 1500) AS BIGINT) AS max_tokens, count(*) AS docs
 FROM @f_chunks d LEFT JOIN (VALUES ('structured_manual', 'section', 1500), ('module_manual', 'section', 1500), ('operational_guide', 'procedure', 800),
 ('changelog_as_manual', 'functional_topic', 1000), ('changelog_pure', 'single', 2000), ('faq_document', 'qa_pair', 600),
 ('technical_spec', 'section', 1200), ('training_material', 'slide_group', 1000)) r(doc_type, chunk_unit, max_tokens) USING (doc_type) GROUP BY 1, 2, 3""")
def _(src: Source):
    rules = dims.doc_type_rules(src.spark)
    per_type = src.f_chunks.groupBy("doc_type").agg(F.count("*").alias("docs"))
    return per_type.join(rules, "doc_type", "left").select(
        "doc_type", F.coalesce("chunk_unit", F.lit(dims.DEFAULT_RULE[0])).alias("chunk_unit"),
        F.coalesce("max_tokens", F.lit(dims.DEFAULT_RULE[1])).cast("bigint").alias("max_tokens"), "docs")


PRICE_SQL = """SELECT concat('2024-', lpad(CAST(1 + p_size % 12 AS STRING), 2, '0')) AS version, p_brand AS provider, p_name AS model, p_partkey,
 p_retailprice AS unit FROM @part"""


@query("latest_price_version", f"SELECT version, p_partkey, unit FROM ({PRICE_SQL}) p WHERE version = (SELECT max(version) FROM ({PRICE_SQL}) q)")
def _(src: Source):
    return M.latest_price_version(src.sql(PRICE_SQL)).select("version", "p_partkey", "unit")


@query("rows_to_markdown", """WITH b AS (SELECT *, c_custkey - min(c_custkey) OVER (PARTITION BY c_nationkey) + 3 AS ln FROM @customer)
 SELECT CAST(c_nationkey AS BIGINT) AS sheet, CASE WHEN ln = 3 THEN 2 ELSE ln END AS line_no,
  concat('| ', c_name, ' | ', coalesce(CAST(CASE WHEN c_custkey % 3 > 0 THEN c_custkey END AS VARCHAR), ''), ' |') AS line FROM b
 UNION ALL SELECT DISTINCT c_nationkey, 0, concat('## ', CAST(c_nationkey AS VARCHAR)) FROM b
 UNION ALL SELECT DISTINCT c_nationkey, 1, '' FROM b UNION ALL SELECT DISTINCT c_nationkey, 3, '| --- | --- |' FROM b""")
def _(src: Source):
    rows = src.customer.withColumn("code", F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey")))
    return markup.rows_to_markdown(rows, "c_nationkey", "c_custkey", ["c_name", "code"]).withColumn("sheet", F.col("sheet").cast("bigint"))


def _page_sql() -> str:
    t = "html"
    steps = [(markup.HIDDEN, "' '"), (r"[ \t\r\n]+", "' '")]
    steps += [(rf"(?i)<h{i}\b[^>]*>", f"concat(chr(10), chr(10), '{'#' * i} ')") for i in (1, 2, 3, 4)]
    steps += [(markup.BLOCKS, "concat(chr(10), chr(10))"), (r"(?i)<li\b[^>]*>", "concat(chr(10), '- ')"), (r"(?i)<br\b[^>]*>|</tr>", "chr(10)"), (r"<[^>]*>", "''")]
    for pattern, to in steps:
        t = f"regexp_replace({t}, '{pattern}', {to}, 'g')"
    for entity, char in markup.ENTITIES:
        t = "replace({}, '{}', '{}')".format(t, entity, char.replace("'", "''"))
    t = f"regexp_replace({t}, ' *\\n *', chr(10), 'g')"
    return f"trim(regexp_replace({t}, '\\n{{3,}}', concat(chr(10), chr(10)), 'g'), concat(' ', chr(9), chr(10), chr(13)))"


@query("pages_to_markdown", f"""SELECT page_id, nullif(md, '') AS markdown, CASE WHEN md = '' THEN 'empty conversion result' END AS error FROM (SELECT page_id, {_page_sql()} AS md FROM @pages) p""")
def _(src: Source):
    good, bad = markup.pages_to_markdown(spread(src.pages))
    return (good.select("page_id", "markdown", F.lit(None).cast("string").alias("error"))
            .unionByName(bad.select("page_id", F.lit(None).cast("string").alias("markdown"), "error")))


# --- maintenance -----------------------------------------------------------

NEW_CHUNKS = "SELECT doc_id, concat('new ', lang) AS text FROM @documents WHERE lang <> 'en'"


@query("replace_by_key", f"SELECT doc_id, text FROM @documents WHERE doc_id NOT IN (SELECT doc_id FROM ({NEW_CHUNKS}) n) UNION ALL {NEW_CHUNKS}")
def _(src: Source):
    return M.replace_by_key(src.documents.select("doc_id", "text"), src.sql(NEW_CHUNKS), "doc_id")


OLD_ORDERS = "SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price, 0 AS seq FROM @orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00'"
NEW_ORDERS = ("SELECT o_orderkey, concat(o_orderstatus, '2') AS status, o_totalprice AS price, CAST(l_linenumber AS INT) AS seq "
              "FROM @orders JOIN @lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'")


@query("upsert_by_key", f"""SELECT o_orderkey, status, price, seq FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY fresh DESC, seq DESC) AS rn FROM (
 SELECT *, 0 AS fresh FROM ({OLD_ORDERS}) a UNION ALL SELECT DISTINCT *, 1 AS fresh FROM ({NEW_ORDERS}) b) u) r WHERE rn = 1""")
def _(src: Source):
    return M.upsert_by_key(src.sql(OLD_ORDERS), src.sql(NEW_ORDERS), ["o_orderkey"], ["seq"])


GLOSSARY_BASE = """SELECT p_partkey AS id, '__global__' AS tenant_id, p_name AS term, array(p_brand, p_type) AS aliases, p_type AS expansion,
 true AS enabled, '2024-01-01' AS updated_at FROM @part"""
GLOSSARY_PATCH = """SELECT p_partkey + 50 AS id, CASE WHEN p_size < 20 THEN 'update' WHEN p_size < 35 THEN 'delete' ELSE 'create' END AS op,
 CASE WHEN p_size % 3 = 0 THEN ' ' WHEN p_size % 3 = 1 THEN 'acme' END AS tenant_id, CASE WHEN p_size % 4 = 0 THEN '  ' WHEN p_size % 4 = 1 THEN concat(' ', p_brand, ' ') END AS term,
 CASE WHEN p_size % 2 = 0 THEN array(' a ', ' ', p_brand) END AS aliases, CASE WHEN p_size % 5 = 0 THEN ' wide ' END AS expansion,
 CASE WHEN p_size % 7 = 0 THEN false END AS enabled FROM @part"""
_GB = GLOSSARY_BASE.replace("array(", "list_value(")
_GP = GLOSSARY_PATCH.replace("array(", "list_value(")


@query("patch_glossary", f"""WITH base AS ({_GB}), p AS (SELECT id, op, CASE WHEN tenant_id IS NULL THEN NULL WHEN trim(tenant_id) = '' THEN '__global__' ELSE trim(tenant_id) END AS tenant_id,
 trim(term) AS term, trim(expansion) AS expansion, list_filter(list_transform(aliases, lambda a: trim(a)), lambda a: a <> '') AS aliases, enabled FROM ({_GP}) x),
 t AS (SELECT p.*, CASE WHEN op = 'create' AND coalesce(p.term, '') = '' THEN 'term is required' WHEN op = 'update' AND p.term = '' THEN 'term is required'
  WHEN op <> 'create' AND base.id IS NULL THEN 'unknown id' WHEN op = 'create' AND base.id IS NOT NULL THEN 'id exists' END AS reason FROM p LEFT JOIN base ON base.id = p.id)
 SELECT b.id, coalesce(u.tenant_id, b.tenant_id) AS tenant_id, coalesce(u.term, b.term) AS term, array_to_string(coalesce(u.aliases, b.aliases), '|') AS aliases,
  coalesce(u.expansion, b.expansion) AS expansion, coalesce(u.enabled, b.enabled) AS enabled,
  CASE WHEN u.tenant_id IS NOT NULL OR u.term IS NOT NULL OR u.aliases IS NOT NULL OR u.expansion IS NOT NULL OR u.enabled IS NOT NULL THEN '2024-02-02' ELSE b.updated_at END AS updated_at,
  CAST(NULL AS VARCHAR) AS reason
 FROM base b LEFT JOIN t u ON u.id = b.id AND u.op = 'update' AND u.reason IS NULL WHERE b.id NOT IN (SELECT id FROM t WHERE op = 'delete' AND reason IS NULL)
 UNION ALL SELECT id, coalesce(tenant_id, '__global__'), term, coalesce(array_to_string(aliases, '|'), ''), coalesce(expansion, ''), coalesce(enabled, true), '2024-02-02', NULL
 FROM t WHERE op = 'create' AND reason IS NULL
 UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, NULL, concat(op, ': ', reason) FROM t WHERE reason IS NOT NULL""")
def _(src: Source):
    table, rejected = M.patch_glossary(src.sql(GLOSSARY_BASE), src.sql(GLOSSARY_PATCH), "2024-02-02")
    table = table.withColumn("aliases", F.array_join("aliases", "|"))
    return table.unionByName(rejected.select("id", F.concat("op", F.lit(": "), "reason").alias("reason")), allowMissingColumns=True)


CATALOG = """SELECT concat(substring(source_file_hash, 1, 12), '-', call_id) AS id, call_id, source_file_hash, o_orderkey, customer, agent_id, resolved, tag1, tag2, problem, source_file, indexed_at FROM @f_calls"""
POINTS = "SELECT l_orderkey * 10 + l_linenumber AS point_id, call_id, source_file_hash FROM @f_calls JOIN @lineitem ON l_orderkey = o_orderkey"
DOOMED = f"SELECT id FROM ({CATALOG}) c WHERE tag1 = 'MACHINERY'"


@query("delete_calls", f"""WITH c AS ({CATALOG}), p AS ({POINTS})
 SELECT 'point' AS what, CAST(point_id AS VARCHAR) AS key, CAST(NULL AS BIGINT) AS siblings_remaining, CAST(NULL AS BOOLEAN) AS orphaned FROM p
 WHERE NOT EXISTS (SELECT 1 FROM c WHERE tag1 = 'MACHINERY' AND c.call_id = p.call_id AND c.source_file_hash = p.source_file_hash)
 UNION ALL SELECT 'call', id, NULL, NULL FROM c WHERE tag1 <> 'MACHINERY'
 UNION ALL SELECT 'file', source_file_hash, count(*) FILTER (WHERE tag1 <> 'MACHINERY'), count(*) FILTER (WHERE tag1 <> 'MACHINERY') = 0 FROM c
 GROUP BY source_file_hash HAVING bool_or(tag1 = 'MACHINERY')""")
def _(src: Source):
    points, calls, files = M.delete_calls(src.sql(POINTS), src.sql(CATALOG), src.sql(DOOMED))
    return (points.select(F.lit("point").alias("what"), F.col("point_id").cast("string").alias("key"))
            .unionByName(calls.select(F.lit("call").alias("what"), F.col("id").alias("key")))
            .unionByName(files.select(F.lit("file").alias("what"), F.col("source_file_hash").alias("key"), "siblings_remaining", "orphaned"),
                         allowMissingColumns=True))


@query("skip_existing", """SELECT c.source_file_hash, c.call_id, EXISTS (SELECT 1 FROM @customer k WHERE c_acctbal > 0 AND md5(CAST(c_custkey AS VARCHAR)) = c.source_file_hash) AS already
 FROM @f_calls c""")
def _(src: Source):
    done = src.sql("SELECT md5(CAST(c_custkey AS STRING)) AS source_file_hash FROM @customer WHERE c_acctbal > 0")
    to_index, catalog = M.skip_existing(src.f_calls.select("source_file_hash", "call_id"), done, "source_file_hash")
    fresh = to_index.select("call_id", F.lit(True).alias("fresh"))
    return catalog.join(fresh, "call_id", "left").select("source_file_hash", "call_id", F.col("fresh").isNull().alias("already"))


# --- corpus statistics -----------------------------------------------------

DOC_META = """SELECT CAST(doc_id AS STRING) AS doc_id, source_doc AS source_file, CASE WHEN doc_id % 8 = 7 THEN NULL ELSE doc_type END AS doc_type, module_id, 'md' AS format FROM @f_chunks"""
FILES = "SELECT concat(source, '_', lang, '.md') AS name, CAST(sum(n_chars) AS BIGINT) AS length FROM @documents WHERE lang <> 'de' GROUP BY source, lang"
RUNS = "SELECT event_id AS line_no, CAST(ts AS STRING) AS timestamp FROM @events WHERE event_type = 'signup'"


@query("corpus_stats", f"""WITH m AS ({DOC_META}), f AS ({FILES})
 SELECT 'doc_type' AS dim, coalesce(doc_type, 'unknown') AS key, count(*) AS n, CAST(NULL AS VARCHAR) AS text FROM m GROUP BY 2
 UNION ALL SELECT 'module', coalesce(nullif(module_id, ''), 'core'), count(*), NULL FROM m GROUP BY 2
 UNION ALL SELECT 'total', 'docs', count(*), NULL FROM m
 UNION ALL SELECT 'total', 'bytes', CAST(coalesce(sum(length), 0) AS BIGINT), NULL FROM m LEFT JOIN f ON f.name = m.source_file
 UNION ALL SELECT 'total', 'last_ingestion', NULL, arg_max(timestamp, line_no) FROM ({RUNS}) r""")
def _(src: Source):
    return O.corpus_stats(src.sql(DOC_META), src.sql(FILES), src.sql(RUNS))


@query("share_table", """SELECT source AS key, count(*) AS n, printf('%.1f%%', count(*) * 100.0 / (SELECT count(*) FROM @documents)) AS pct FROM @documents GROUP BY 1""")
def _(src: Source):
    return O.share_table(src.documents.groupBy(F.col("source").alias("key")).agg(F.count("*").alias("n")))


MEDIA = """SELECT CAST(l_orderkey AS STRING) AS doc_id, concat('image_p', CAST(l_linenumber AS STRING), '_', CAST(l_partkey AS STRING),
 CASE l_suppkey % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.webp' ELSE '.gif' END) AS file_name FROM @lineitem"""
_MEDIA_ORD = f"""(SELECT doc_id, file_name, CAST(list_position(['png', 'jpg', 'jpeg', 'webp'], regexp_extract(file_name, '\\.([^.]*)$', 1)) AS BIGINT) AS ext_no FROM ({MEDIA}) z)"""


@query("list_documents", f"SELECT m.doc_id, m.source_file, m.doc_type, m.module_id, p.ext_no, p.file_name FROM ({DOC_META}) m LEFT JOIN {_MEDIA_ORD} p ON p.doc_id = m.doc_id AND p.ext_no > 0")
def _(src: Source):
    return O.list_documents(src.sql(DOC_META).drop("format"), src.sql(MEDIA))


@query("search_documents", f"""SELECT doc_id, source_file FROM ({DOC_META}) m WHERE EXISTS (SELECT 1 FROM ({MEDIA}) x WHERE x.doc_id = m.doc_id)
 AND (contains(lower(doc_id), 'src1') OR contains(lower(coalesce(source_file, '')), 'src1') OR contains(lower(coalesce(doc_type, '')), 'src1') OR contains(lower(coalesce(module_id, '')), 'src1'))""")
def _(src: Source):
    return O.search_documents(src.sql(DOC_META), src.sql(MEDIA), " SRC1 ").select("doc_id", "source_file")


RESULTS = """SELECT event_id AS seq, concat('f', CAST(user_id AS STRING), '-', event_type) AS path, CAST(floor(value) AS BIGINT) % 4 AS chunks,
 CASE WHEN event_type = 'error' THEN concat('boom ', CAST(event_id AS STRING)) END AS error FROM @events"""


@query("ingest_summary", f"""SELECT count(*) AS total_files, count(*) FILTER (WHERE error IS NULL AND chunks > 0) AS processed,
 count(*) FILTER (WHERE error IS NULL AND chunks <= 0) AS skipped, count(*) FILTER (WHERE error IS NOT NULL) AS failed_count,
 CAST(sum(chunks) FILTER (WHERE error IS NULL) AS BIGINT) AS chunks_created, 100.0::DOUBLE AS progress_pct,
 CASE WHEN count(error) > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM ({RESULTS}) r""")
def _(src: Source):
    return O.ingest_summary(src.sql(RESULTS))


@query("recent_results", f"""(SELECT 'failed' AS kind, seq, path, error FROM ({RESULTS}) r WHERE error IS NOT NULL ORDER BY seq DESC LIMIT 50)
 UNION ALL (SELECT 'succeeded', seq, path, error FROM ({RESULTS}) r WHERE error IS NULL AND chunks > 0 ORDER BY seq DESC LIMIT 30)""")
def _(src: Source):
    return O.recent_results(src.sql(RESULTS))


OLD_FAILED = "SELECT concat('f', CAST(user_id AS STRING), '-', event_type) AS path, 'old' AS error, event_id - 1000000 AS seq FROM @events WHERE event_type <> 'view'"
RETRIED = """SELECT event_id AS seq, concat('f', CAST(user_id AS STRING), '-', event_type) AS path,
 CASE WHEN event_type = 'error' OR value > 50 THEN concat('boom ', CAST(event_id AS STRING)) END AS error FROM @events WHERE user_id > 20"""


@query("failed_checkpoint", f"""SELECT path, error, seq FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS rn FROM (
 SELECT path, error, seq FROM ({OLD_FAILED}) o UNION ALL SELECT path, error, seq FROM ({RETRIED}) n) u) r WHERE rn = 1 AND error IS NOT NULL""")
def _(src: Source):
    return O.failed_checkpoint(src.sql(OLD_FAILED), src.sql(RETRIED))


@query("resume_set", f"""SELECT path, error, path NOT IN (SELECT concat('f', CAST(c_custkey AS VARCHAR), '-error') FROM @customer) AS pruned FROM (
 SELECT path, arg_max(error, seq) AS error FROM ({OLD_FAILED}) o GROUP BY path) f""")
def _(src: Source):
    failed = O.failed_checkpoint(src.sql(OLD_FAILED), src.sql(OLD_FAILED).limit(0))
    files = src.sql("SELECT concat('f', CAST(c_custkey AS STRING), '-error') AS path FROM @customer")
    keep, gone = O.resume_set(failed, files)
    return (keep.select("path", "error", F.lit(False).alias("pruned"))
            .unionByName(gone.select("path", "error", F.lit(True).alias("pruned"))))


PATCHES = """SELECT concat('t', CAST(user_id AS STRING)) AS tenant_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'erp_version' WHEN 'view' THEN 'legacy_erp_version'
 WHEN 'signup' THEN 'preferred_lang' WHEN 'purchase' THEN 'benchmark_lang' ELSE 'colour' END AS key,
 CASE WHEN value < 5 THEN NULL ELSE concat(' V', CAST(CAST(floor(value) AS BIGINT) AS STRING), ' ') END AS value FROM @events"""


@query("tenant_overlay", f"""SELECT tenant_id, key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, key ORDER BY seq DESC) AS rn FROM (
 SELECT tenant_id, CASE WHEN key = 'legacy_erp_version' THEN 'erp_version' ELSE key END AS key, CASE key WHEN 'benchmark_lang' THEN lower(trim(value)) WHEN 'preferred_lang' THEN trim(value) ELSE value END AS value, seq
 FROM ({PATCHES}) p WHERE key <> 'colour' AND value IS NOT NULL
 UNION ALL SELECT tenant_id, key, NULL, seq FROM ({PATCHES}) p WHERE value IS NULL AND key IN ('erp_version', 'preferred_lang')) u) r WHERE rn = 1 AND value IS NOT NULL""")
def _(src: Source):
    patches = src.sql(PATCHES)
    cleared = patches.where("value IS NULL AND key IN ('erp_version', 'preferred_lang')")
    cols = ["tenant_id", "key", "value", "seq"]
    return O.tenant_overlay(O.normalize_overlay_patch(patches).select(*cols), cleared.select(*cols))
