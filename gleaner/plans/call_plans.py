"""Images, index building, transcripts, call catalogue, whole-corpus ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import dims
from gleaner.operators import calls as A
from gleaner.operators import images as I
from gleaner.operators import indexing as X
from gleaner.operators import ingest as N
from gleaner.plans.document_plans import INGEST_SQL, WS
from gleaner.plans.registry import Source, query

# --- images ----------------------------------------------------------------------------

_ASPECT = "greatest({0}, {1}) / greatest(least({0}, {1}), 1)"
_RW, _RH = "greatest(x1 - x0, 0)", "greatest(y1 - y0, 0)"
IMG_SQL = f"""(SELECT *, {_RW} AS rw, {_RH} AS rh, {_RW} * {_RH} / (595.0::DOUBLE * 842) AS area, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM @f_images)"""


@query("image_skip_reason", f"""SELECT doc_id, page, image_no, w, h, CASE WHEN page = 0 THEN 'first_page' WHEN w > 0 AND h > 0 AND (w < 15 OR h < 10) THEN 'tiny_metadata'
 WHEN w > 0 AND h > 0 AND {_ASPECT.format('w', 'h')} > 22 THEN 'extreme_aspect_metadata' WHEN area >= 0.88 THEN 'near_fullpage_background' WHEN rw > 0 AND rh > 0 AND rw >= 595 * 0.68::DOUBLE AND rh <= 842 * 0.075::DOUBLE THEN 'full_width_thin_bar'
 WHEN rw > 0 AND rh > 0 AND rh >= 842 * 0.68::DOUBLE AND rw <= 595 * 0.075::DOUBLE THEN 'full_height_thin_bar' WHEN cy < 842 * 0.11::DOUBLE AND area <= 0.06 AND rw <= 595 * 0.42::DOUBLE THEN 'header_band_small'
 WHEN cy > 842 * (1 - 0.1::DOUBLE) AND area <= 0.06::DOUBLE * 1.2 THEN 'footer_band_small'
 WHEN (cx < 595 * 0.075::DOUBLE OR cx > 595 * (1 - 0.075::DOUBLE)) AND area <= 0.04 AND rw <= 595 * 0.12::DOUBLE AND rh <= 842 * 0.12::DOUBLE THEN 'margin_decor' END AS skip_reason FROM {IMG_SQL} i""")
def _(src: Source):
    return I.image_skip_reason(src.f_images).select("doc_id", "page", "image_no", "w", "h", "skip_reason")


@query("orphan_images", f"""SELECT doc_id, page, image_no, x0, y0, 'no_nearby_text' AS skip_reason FROM {IMG_SQL} i WHERE area < 0.12
 AND EXISTS (SELECT 1 FROM @f_words w WHERE w.doc_id = i.doc_id AND w.page = i.page)
 AND NOT EXISTS (SELECT 1 FROM @f_words w WHERE w.doc_id = i.doc_id AND w.page = i.page AND i.x0 - 40 < w.x1 AND w.x0 < i.x1 + 40 AND i.y0 - 40 < w.y1 AND w.y0 < i.y1 + 40)""")
def _(src: Source):
    return I.orphan_images(src.f_images, src.f_words).select("doc_id", "page", "image_no", "x0", "y0", "skip_reason")


LOGOS = [("sample-a", 1234567890123), ("sample-b", 987654321)]


@query("logo_matches", "SELECT l_orderkey, l_linenumber, l_partkey, " + " OR ".join(f"bit_count(xor(l_partkey * 2654435761, {h})) <= 14" for _n, h in LOGOS) + " AS is_logo FROM @lineitem")
def _(src: Source):
    hashed = src.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") * F.lit(2654435761)).alias("phash"))
    return I.logo_matches(hashed, LOGOS).drop("phash")


HIST = "SELECT l_suppkey AS image_id, CAST(l_quantity AS INT) AS bin, count(*) AS n FROM @lineitem GROUP BY 1, 2"


@query("histogram_entropy", f"""SELECT image_id, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY image_id) AS t FROM ({HIST}) h) p GROUP BY 1""")
def _(src: Source):
    return I.histogram_entropy(src.sql(HIST)).withColumn("entropy", F.round("entropy", 6))


MEASURED = """SELECT l_orderkey AS doc_id, l_linenumber AS image_no, CAST(l_extendedprice AS BIGINT) AS file_size, CAST(l_quantity * 12 AS INT) AS w, CAST(l_suppkey * 7 % 500 AS INT) AS h,
 l_discount AS ink, l_tax * 100 AS entropy, CAST(l_partkey % 30 AS INT) AS colors FROM @lineitem"""
CLASS_SQL = f"""(SELECT *, CASE WHEN file_size < 2048 OR greatest(w, h) / greatest(least(w, h), 1) > 8 OR w < 100 OR h < 100 OR ink < 0.05 OR entropy < 3.5 OR colors < 8 THEN 'skip' WHEN w < 200 OR h < 200 THEN 'button' ELSE 'screenshot' END AS image_class FROM ({MEASURED}) m)"""


@query("image_class", f"SELECT doc_id, image_no, w, h, image_class FROM {CLASS_SQL} c")
def _(src: Source):
    return I.image_class(src.sql(MEASURED)).select("doc_id", "image_no", "w", "h", "image_class")


@query("image_class_summary", f"""SELECT doc_id, count(*) AS extracted, count(*) FILTER (WHERE image_class = 'button') AS buttons, count(*) FILTER (WHERE image_class = 'screenshot') AS screenshots,
 count(*) FILTER (WHERE image_class = 'skip') AS skipped FROM {CLASS_SQL} c GROUP BY 1""")
def _(src: Source):
    return I.image_class_summary(I.image_class(src.sql(MEASURED)))


# --- index ---------------------------------------------------------------------------------


def zeroed(src: Source):
    zero = F.transform("embedding", lambda x: F.lit(0.0).cast("float"))
    return src.embeddings.select(F.col("vec_id").alias("chunk_id"), F.when(F.col("label") == 3, zero).otherwise(F.col("embedding")).alias("embedding"))


@query("index_chunks", "SELECT c.chunk_id, coalesce(c.module_id, '') AS module_id, len(v.embedding) AS dim FROM @f_chunks c JOIN @embeddings v ON v.vec_id = c.chunk_id WHERE v.label <> 3")
def _(src: Source):
    indexed, _counts = X.index_chunks(src.f_chunks, zeroed(src))
    return indexed.select("chunk_id", "module_id", F.size("embedding").cast("bigint").alias("dim"))


@query("index_chunks_counts", "SELECT count(*) FILTER (WHERE label <> 3) AS indexed, count(*) FILTER (WHERE label = 3 OR label IS NULL) AS skipped FROM @f_chunks c LEFT JOIN @embeddings v ON v.vec_id = c.chunk_id")
def _(src: Source):
    return X.index_chunks(src.f_chunks, zeroed(src))[1]


CALLS_QA = """SELECT c.call_id, c.source_file_hash, c.problem, CASE WHEN resolved THEN concat('fixed by ', agent_id) ELSE ' ' END AS resolution, CASE WHEN l_returnflag = 'N' THEN ' ' ELSE concat('Q ', CAST(l_partkey AS STRING)) END AS question,
 CASE WHEN l_linestatus = 'F' THEN '' ELSE concat('A ', l_returnflag) END AS answer, CASE l_suppkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN '7' WHEN 2 THEN NULL ELSE CAST(l_discount AS STRING) END AS confidence
 FROM @f_calls c JOIN @lineitem ON l_orderkey = o_orderkey"""


def calls_with_pairs(src: Source):
    """A call per line item with two question/answer pairs."""
    def pair(question, answer):
        return F.struct(question.alias("question"), answer.alias("answer"), F.lit("billing").alias("category"), F.col("confidence").alias("confidence"))

    return src.sql(CALLS_QA).select("call_id", "source_file_hash", "problem", "resolution",
                                    F.array(pair(F.col("question"), F.col("answer")), pair(F.lit(" more? "), F.col("question"))).alias("rag_qa"))


_CONF = "CAST(greatest(0, least(1, coalesce(TRY_CAST(confidence AS DOUBLE), 0.5))) AS DOUBLE)"
POINTS_SQL = f"""(WITH b AS MATERIALIZED ({CALLS_QA})
 SELECT call_id, source_file_hash, 'rag_qa' AS point_kind, 0 AS rag_pair_index, {_CONF} AS confidence, trim(concat(trim(question), ' ', answer)) AS indexed_text FROM b WHERE trim(concat(trim(question), ' ', answer)) <> ''
 UNION ALL SELECT call_id, source_file_hash, 'rag_qa', 1, {_CONF}, trim(concat('more? ', trim(question))) FROM b
 UNION ALL SELECT call_id, source_file_hash, 'issue_summary', CAST(NULL AS INT), NULL, trim(concat(problem, chr(10), chr(10), trim(resolution)), concat(' ', chr(10))) FROM b)"""


@query("call_index_points", f"SELECT * FROM {POINTS_SQL} p")
def _(src: Source):
    return X.call_index_points(calls_with_pairs(src)).drop("category")


_NS = "unhex('8e58f1c84c8d5b2e9a1f0c3e7d2b6a01')"


@query("point_ids", f"""SELECT call_id, point_kind, rag_pair_index, concat(substring(d, 1, 8), '-', substring(d, 9, 4), '-5', substring(d, 14, 3), '-', substring('89ab89ab89ab89ab', strpos('0123456789abcdef', substring(d, 17, 1)), 1), substring(d, 18, 3), '-', substring(d, 21, 12)) AS point_id
 FROM (SELECT *, sha1({_NS} || encode(CASE WHEN point_kind = 'rag_qa' THEN concat('rag:', source_file_hash, ':', call_id, ':', CAST(rag_pair_index AS VARCHAR)) ELSE concat('issue:', source_file_hash, ':', call_id) END)) AS d FROM {POINTS_SQL} p) x""")
def _(src: Source):
    return X.point_ids(X.call_index_points(calls_with_pairs(src))).select("call_id", "point_kind", "rag_pair_index", "point_id")


VECTOR_POINTS = "SELECT vec_id AS id, CASE WHEN label % 3 = 0 THEN 'issue_summary' ELSE 'rag_qa' END AS kind, vec_id AS ord, embedding AS probe, embedding AS vector FROM @embeddings"


def doubled(src: Source):
    """The points and a scaled copy of each."""
    points = src.sql(VECTOR_POINTS)
    twice = F.transform("embedding", lambda x: x * F.lit(2.0).cast("float"))
    base = src.embeddings.select((F.col("vec_id") + 1000000).alias("id"), F.when(F.col("label") % 3 == 0, "issue_summary").otherwise("rag_qa").alias("kind"),
                                 (F.col("vec_id") + 1000000).alias("ord"), twice.alias("probe"), twice.alias("vector"))
    return points.unionByName(base)


@query("near_dup_against_index", """SELECT a.vec_id AS id, CASE WHEN a.label % 3 = 0 THEN 'issue_summary' ELSE 'rag_qa' END AS kind, round(greatest(max(round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 10)), -1), 6) AS similarity,
 max(round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 10)) > CASE WHEN a.label % 3 = 0 THEN 0.94 ELSE 0.92 END AS dropped
 FROM @embeddings a JOIN @embeddings b ON (a.label % 3 = 0) = (b.label % 3 = 0) AND b.label > 4 GROUP BY a.vec_id, a.label""")
def _(src: Source):
    index = src.embeddings.where("label > 4").select(F.col("vec_id").alias("id"), F.when(F.col("label") % 3 == 0, "issue_summary").otherwise("rag_qa").alias("kind"), F.col("embedding").alias("vector"))
    return X.near_dup_against_index(src.sql(VECTOR_POINTS), index).select("id", "kind", F.round("similarity", 6).alias("similarity"), "dropped")


# The sequential rule itself: points one by one, with the vectors kept so far.
NEAR_DUP_SQL = """WITH RECURSIVE pts AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id) AS i FROM (
  SELECT vec_id AS id, CASE WHEN label % 3 = 0 THEN 'issue_summary' ELSE 'rag_qa' END AS kind, CAST(embedding AS DOUBLE[]) AS v FROM @embeddings
  UNION ALL SELECT vec_id + 1000000, CASE WHEN label % 3 = 0 THEN 'issue_summary' ELSE 'rag_qa' END, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 2) FROM @embeddings) u),
 walk AS (SELECT kind, i, id, true AS stays, [v] AS kept FROM pts WHERE i = 1
  UNION ALL SELECT kind, i, id, ok, CASE WHEN ok THEN list_append(kept, v) ELSE kept END FROM (
   SELECT p.kind, p.i, p.id, p.v, w.kept, len(list_filter(w.kept, lambda k: round(list_cosine_similarity(k, p.v), 10) > CASE WHEN p.kind = 'rag_qa' THEN 0.92 ELSE 0.94 END)) = 0 AS ok
   FROM walk w JOIN pts p ON p.kind = w.kind AND p.i = w.i + 1) s)
 SELECT id FROM walk WHERE stays"""


@query("near_dup_in_batch", NEAR_DUP_SQL)
def _(src: Source):
    return X.near_dup_in_batch(doubled(src))


RUN = "SELECT c.source_file_hash, c.call_id, CASE WHEN l_linenumber = 1 THEN 'issue_summary' ELSE 'rag_qa' END AS point_kind, l_returnflag = 'R' AS dropped FROM @f_calls c JOIN @lineitem ON l_orderkey = o_orderkey"
RUN_SQL = f"""(SELECT source_file_hash, call_id, count(*) FILTER (WHERE point_kind = 'rag_qa') AS rag_total, count(*) FILTER (WHERE point_kind = 'rag_qa' AND NOT dropped) AS rag_indexed,
 count(*) FILTER (WHERE point_kind = 'rag_qa' AND dropped) AS rag_skipped, count(*) FILTER (WHERE point_kind <> 'rag_qa' AND NOT dropped) AS issue_upserted FROM ({RUN}) r GROUP BY 1, 2)"""


@query("index_run_stats", f"SELECT * FROM {RUN_SQL} s")
def _(src: Source):
    return X.index_run_stats(src.sql(RUN))


@query("points_per_file", f"SELECT source_file_hash, CAST(sum(rag_indexed + issue_upserted) AS BIGINT) AS points_upserted FROM {RUN_SQL} s GROUP BY 1")
def _(src: Source):
    return X.points_per_file(X.index_run_stats(src.sql(RUN)))


@query("collection_stats", "SELECT count(*) AS total_chunks, round_even(count(*) * 4096 * 1.15::DOUBLE / 1048576, 2) AS approximate_index_mb FROM @documents")
def _(src: Source):
    return X.collection_stats(src.f_chunks)


# --- transcripts -----------------------------------------------------------------------------

WORDS = "SELECT conv_id AS recording_id, turn, role AS speaker, text FROM @conversations"


def words(src: Source):
    rows = src.sql(WORDS).select("recording_id", "speaker", "turn", F.posexplode(F.split("text", " ")).alias("i", "word"))
    at = F.col("turn") * 100000 + F.col("i")
    # The provider leaves some words without a speaker.
    rows = rows.withColumn("speaker", F.when(at % 7 != 3, F.col("speaker")))
    return rows.select("recording_id", "speaker", "word", at.alias("word_no"), (at / 10.0).alias("start"), (at / 10.0 + 0.05).alias("end"))


@query("words_to_segments", """WITH u AS (SELECT conv_id AS recording_id, role AS said, turn * 100000 + generate_subscripts(string_split(text, ' '), 1) - 1 AS word_no, unnest(string_split(text, ' ')) AS word FROM @conversations),
 w AS (SELECT *, last_value(CASE WHEN word_no % 7 <> 3 THEN said END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY word_no) AS speaker FROM u),
 n AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY recording_id ORDER BY word_no) = 1 OR lag(speaker) OVER (PARTITION BY recording_id ORDER BY word_no) IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS fresh FROM w),
 s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY recording_id ORDER BY word_no) AS BIGINT) AS segment_no FROM n),
 v AS (SELECT *, (row_number() OVER (PARTITION BY recording_id, segment_no ORDER BY word_no) - 1) // 10000 AS volume FROM s)
 SELECT recording_id, segment_no, volume, speaker, round(min(word_no) / 10, 3) AS "start", round(max(word_no) / 10 + 0.05, 3) AS "end", trim(string_agg(word, ' ' ORDER BY word_no), concat(' ', chr(10))) AS text FROM v GROUP BY 1, 2, 3, 4""")
def _(src: Source):
    segs = A.words_to_segments(words(src))
    return segs.withColumns({"start": F.round("start", 3), "end": F.round("end", 3)})



@query("normalize_segments", f"""SELECT conv_id AS recording_id, turn, seg_no, CASE WHEN seg_no = 0 AND role <> 'system' THEN turn * 10.0 ELSE 0 END::DOUBLE AS "start", CASE WHEN seg_no = 0 THEN turn * 10.0 + 8 ELSE 0 END::DOUBLE AS "end",
 CASE WHEN seg_no = 0 THEN trim(text, {WS}) ELSE '' END AS text, CASE WHEN seg_no = 1 THEN 'SPEAKER_00' WHEN role = 'user' THEN 'SPEAKER_11' WHEN role = 'assistant' THEN 'SPEAKER_02' ELSE 'SPEAKER_00' END AS speaker
 FROM (SELECT *, CAST(unnest([0, 1]) AS INT) AS seg_no FROM @conversations) c""")
def _(src: Source):
    """A provider's answer per turn: what was said, and an empty utterance without any value."""
    at = F.col("turn") * 10.0
    said = F.struct(F.when(F.col("role") != "system", at).alias("start"), (at + 8).alias("end"), F.col("text").alias("transcript"),
                    F.when(F.col("role") == "user", 11).when(F.col("role") == "assistant", 2).alias("speaker"))
    none = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("start", "double"), ("end", "double"), ("transcript", "string"), ("speaker", "int"))])
    raw = src.conversations.select(F.struct("conv_id", "turn").alias("recording_id"), F.array(said, none).alias("utterances"))
    return A.normalize_segments(raw).select("recording_id.conv_id", "recording_id.turn", "seg_no", "start", "end", "text", "speaker").withColumnRenamed("conv_id", "recording_id")


def segments(src: Source):
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200
    return src.f_segments.withColumns({"start": start, "end": start + F.col("dur_s")}).drop("ts", "dur_s")


SEG_SQL = "(SELECT recording_id, seg_id, speaker, text, epoch_us(ts) / 1e6 - 1704067200 AS s, epoch_us(ts) / 1e6 - 1704067200 + dur_s AS e FROM @f_segments WHERE trim(text) <> '')"
GAP, RESET, LEAST = 86400.0, 21600.0, 3600.0


@query("split_by_gap", f"""SELECT recording_id, seg_id, CAST(sum(CASE WHEN s - pe > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY s, seg_id) AS BIGINT) AS conv_no FROM (
 SELECT *, lag(e) OVER (PARTITION BY recording_id ORDER BY s, seg_id) AS pe FROM {SEG_SQL} x) y""")
def _(src: Source):
    return A.split_by_gap(segments(src), GAP).select("recording_id", "seg_id", "conv_no")


def conversations(src: Source):
    return A.split_conversations(segments(src), GAP, RESET, LEAST)


# One row per segment by recursion: the block so far travels along as speakers and size.
CONV_CTE = f"""n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY s, seg_id) AS i, first(speaker) OVER (PARTITION BY recording_id ORDER BY s, seg_id) AS fs FROM {SEG_SQL} x),
 walk AS (SELECT recording_id, seg_id, i, s, e, CAST(0 AS BIGINT) AS call_index, [speaker] AS spk, 1 AS size FROM n WHERE i = 1
  UNION ALL SELECT q.recording_id, q.seg_id, q.i, q.s, q.e, CASE WHEN q.s - w.e > {GAP} OR (q.s - w.e > {RESET} AND q.speaker = q.fs AND len(w.spk) >= 2 AND w.size >= 2) THEN w.call_index + 1 ELSE w.call_index END,
   CASE WHEN q.s - w.e > {GAP} OR (q.s - w.e > {RESET} AND q.speaker = q.fs AND len(w.spk) >= 2 AND w.size >= 2) THEN [q.speaker] ELSE list_distinct(list_append(w.spk, q.speaker)) END,
   CASE WHEN q.s - w.e > {GAP} OR (q.s - w.e > {RESET} AND q.speaker = q.fs AND len(w.spk) >= 2 AND w.size >= 2) THEN 1 ELSE w.size + 1 END
  FROM walk w JOIN n q ON q.recording_id = w.recording_id AND q.i = w.i + 1),
 conv AS MATERIALIZED (SELECT recording_id, call_index, min(s) AS cs, arg_max(e, i) AS ce FROM walk GROUP BY 1, 2 HAVING arg_max(e, i) - min(s) >= {LEAST})"""


@query("split_conversations", f"WITH RECURSIVE {CONV_CTE} SELECT w.recording_id, seg_id, w.call_index FROM walk w JOIN conv c ON c.recording_id = w.recording_id AND c.call_index = w.call_index")
def _(src: Source):
    return conversations(src).select("recording_id", "seg_id", "call_index")


@query("relative_times", f"""WITH RECURSIVE {CONV_CTE} SELECT w.recording_id, seg_id, round(s - cs, 3) AS "start", round(e - cs, 3) AS "end" FROM walk w JOIN conv c ON c.recording_id = w.recording_id AND c.call_index = w.call_index""")
def _(src: Source):
    return A.relative_times(conversations(src)).select("recording_id", "seg_id", "start", "end")


@query("format_mm_ss", """SELECT event_id, concat(CASE WHEN m < 10 THEN '0' ELSE '' END, CAST(m AS VARCHAR), ':', CASE WHEN sec < 10 THEN '0' ELSE '' END, CAST(sec AS VARCHAR)) AS label FROM (
 SELECT event_id, CAST(floor(s / 60) AS BIGINT) + CASE WHEN r >= 60 THEN 1 ELSE 0 END AS m, CASE WHEN r >= 60 THEN 0 ELSE r END AS sec FROM (
  SELECT event_id, s, CAST(round_even(s - floor(s / 60) * 60, 0) AS BIGINT) AS r FROM (SELECT event_id, greatest(value * 30 - 20, 0) AS s FROM @events) x) y) z""")
def _(src: Source):
    return src.events.select("event_id", A.format_mm_ss(F.col("value") * 30 - 20).alias("label"))


@query("transcript_block", f"""SELECT conv_id AS call_id, CAST(floor(turn * 10.0 / 86400) AS BIGINT) AS volume, string_agg(concat('[', printf('%.1f', turn * 10.0), 's–', printf('%.1f', turn * 10.0 + 8), 's] ', role, ': ', trim(text, {WS})), chr(10) ORDER BY turn) AS transcript FROM @conversations GROUP BY 1, 2""")
def _(src: Source):
    segs = src.conversations.select(F.col("conv_id").alias("call_id"), F.col("turn").alias("seg_id"), (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 8).alias("end"), F.col("role").alias("speaker"), "text")
    return A.transcript_block(segs)


RECORDINGS = "SELECT c_custkey AS recording_id, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0.0 END AS duration_s, 60.0 AS elapsed_s FROM @customer"


def recordings(src: Source):
    counts = src.f_segments.groupBy("recording_id").agg(F.count("*").alias("segment_count"))
    return src.sql(RECORDINGS).join(counts, "recording_id", "left")


@query("call_manifest", f"""WITH RECURSIVE {CONV_CTE} SELECT r.recording_id, CASE WHEN coalesce(k.n, 0) = 0 THEN 'empty_transcript' ELSE 'ok' END AS status, coalesce(p.n, 0) AS conversations, round(coalesce(p.sp, 0), 3) AS speech_s, coalesce(k.n, 0) AS segment_count,
 round(CASE WHEN duration_s > 0 THEN elapsed_s / duration_s ELSE 0 END, 6) AS processing_ratio FROM ({RECORDINGS}) r LEFT JOIN (SELECT recording_id, count(*) AS n FROM @f_segments GROUP BY 1) k USING (recording_id)
 LEFT JOIN (SELECT recording_id, count(*) AS n, sum(ce - cs) AS sp FROM conv GROUP BY 1) p USING (recording_id)""")
def _(src: Source):
    rows = A.call_manifest(conversations(src), recordings(src))
    return rows.withColumns({"speech_s": F.round("speech_s", 3), "processing_ratio": F.round("processing_ratio", 6)})


@query("call_ids", f"""WITH RECURSIVE {CONV_CTE} SELECT recording_id, call_index, concat('CALL-', lpad(CAST(row_number() OVER (PARTITION BY recording_id ORDER BY call_index) AS VARCHAR), 3, '0')) AS call_id FROM conv""")
def _(src: Source):
    return A.call_ids(conversations(src))


# --- analyses -----------------------------------------------------------------------------------

RAW_CALLS = """SELECT event_id, CASE event_type WHEN 'click' THEN ' Sí ' WHEN 'view' THEN 'No se confirma, aunque resuelto' WHEN 'signup' THEN 'Resuelto con éxito' WHEN 'purchase' THEN 'llamar mañana' END AS resolved,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('paso ', CAST(event_id AS STRING)) END AS resolution, CASE WHEN event_id % 2 = 0 THEN 'p' END AS problem,
 CASE event_id % 6 WHEN 0 THEN 'Very High' WHEN 1 THEN '1.7' WHEN 2 THEN 'true' WHEN 3 THEN ' bajo ' WHEN 4 THEN 'eh' END AS confidence, concat(CAST(event_id AS STRING), CASE WHEN event_id % 2 = 0 THEN '.5 s' ELSE 'S' END) AS at FROM @events"""


@query("coerce_calls", f"""SELECT event_id, CASE WHEN resolved = ' Sí ' THEN true WHEN resolved = 'Resuelto con éxito' THEN true ELSE false END AS resolved,
 CASE WHEN resolved = 'llamar mañana' THEN concat(CASE WHEN resolution IS NULL THEN '' ELSE concat(resolution, chr(10), chr(10)) END, resolved) ELSE coalesce(resolution, '') END AS resolution, coalesce(problem, '') AS problem,
 CASE event_id % 6 WHEN 0 THEN 0.95 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.35 ELSE 0.5 END::DOUBLE AS confidence, (event_id + CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 0 END)::DOUBLE AS "start", 0 AS tags FROM ({RAW_CALLS}) r""")
def _(src: Source):
    raw = src.sql(RAW_CALLS).select(
        "event_id", "resolved", "resolution", "problem", F.lit(None).cast("array<string>").alias("tags"),
        F.array(F.struct(F.lit("q").alias("question"), F.lit("a").alias("answer"), F.lit("c").alias("category"), F.col("confidence"))).alias("rag_qa"),
        F.array(F.struct(F.col("at").alias("start"), F.col("at").alias("end"), F.lit(None).cast("string").alias("speaker"), F.lit("t").alias("text"))).alias("transcript"))
    return A.coerce_calls(raw).select("event_id", "resolved", "resolution", "problem", F.col("rag_qa")[0]["confidence"].alias("confidence"), F.col("transcript")[0]["start"].alias("start"), F.size("tags").alias("tags"))


CALL_REPLIES = """SELECT doc_id AS call_id, CASE doc_id % 5 WHEN 0 THEN concat('Here: ```json', chr(10), '{"problema_corto": "line', chr(10), 'break ', source, '", "llamante": "caller ', lang, '", "error_codes": ["E', lang, '"], "resolucion_exitosa": true, "tags": ["a", "b",], }', chr(10), '``` bye')
 WHEN 1 THEN concat('{"problema_corto": "path {x, } ', lang, '", "tags": ["t"], "rag_qa": [{"question": "q", "answer": "a", "category": "c", "confidence": 0.5}]}') WHEN 2 THEN 'no object' WHEN 3 THEN '{"problema_corto": "cut' ELSE '{"resumen": "s", "farmacia": "shop", "causa_raiz": "why", "transcript": [{"start": "1", "end": "2", "speaker": "A", "text": "hi"}]}' END AS reply FROM @documents"""


@query("parse_call_replies", f"""SELECT call_id, CASE call_id % 5 WHEN 0 THEN concat('line', chr(10), 'break ', source) WHEN 1 THEN concat('path {{x, }} ', lang) WHEN 2 THEN '{A.FALLBACK_PROBLEM}' WHEN 3 THEN '{A.FALLBACK_PROBLEM}' END AS problem,
 CASE call_id % 5 WHEN 0 THEN 'true' END AS resolved, CASE call_id % 5 WHEN 4 THEN 's' END AS summary, CASE call_id % 5 WHEN 0 THEN concat('caller ', lang) END AS caller, CASE call_id % 5 WHEN 0 THEN concat('E', lang) END AS error_codes,
 CASE call_id % 5 WHEN 4 THEN 'shop' END AS customer, CASE call_id % 5 WHEN 4 THEN 'why' END AS root_cause, CASE call_id % 5 WHEN 4 THEN 'hi' END AS said, CASE call_id % 5 WHEN 0 THEN 'a|b' WHEN 1 THEN 't' WHEN 4 THEN NULL ELSE 'analysis-error|needs-review' END AS tags, call_id % 5 IN (2, 3) AS analysis_fallback
 FROM (SELECT *, doc_id AS call_id FROM @documents) d""")
def _(src: Source):
    return A.parse_call_replies(src.sql(CALL_REPLIES)).select(
        "call_id", "problem", "resolved", "summary", "caller", F.array_join("error_codes", "|").alias("error_codes"), "customer", "root_cause",
        F.col("transcript")[0]["text"].alias("said"), F.array_join("tags", "|").alias("tags"), "analysis_fallback")


# --- catalogue ------------------------------------------------------------------------------------

TAGGED = "SELECT *, @array(tag1, concat(' ', tag2, ' '), '') AS tags FROM @f_calls"
CATALOG_SQL = f"""(SELECT concat(substring(source_file_hash, 1, 12), '-', call_id) AS id, * FROM ({TAGGED}) t)"""


def catalog(src: Source):
    calls = src.sql(TAGGED)
    return A.call_catalog(calls.unionByName(calls.withColumn("indexed_at", F.lit("1990-01-01")).withColumn("problem", F.lit("old"))))


@query("call_catalog", f"SELECT id, call_id, agent_id, source_file_hash, source_file, customer, caller, agent, problem, resolved, array_to_string(tags, '|') AS tags, timestamp_start, timestamp_end, indexed_at FROM {CATALOG_SQL} c")
def _(src: Source):
    return catalog(src).withColumn("tags", F.array_join("tags", "|"))


@query("list_calls", f"""SELECT id, customer, problem, indexed_at FROM {CATALOG_SQL} c WHERE agent_id = '1-URGENT' AND NOT resolved AND contains(lower(problem), 'issue 1') AND list_contains(tags, 'BUILDING') ORDER BY indexed_at DESC, id LIMIT 30 OFFSET 10""")
def _(src: Source):
    return A.list_calls(catalog(src), agent_id="1-URGENT", resolved=False, search="Issue 1", tag="BUILDING", limit=30, offset=10).select("id", "customer", "problem", "indexed_at")


@query("distinct_customers", "SELECT DISTINCT customer FROM @f_calls WHERE agent_id = '5-LOW'")
def _(src: Source):
    return A.distinct_customers(catalog(src), "5-LOW")


@query("distinct_tags", "SELECT DISTINCT tag1 AS tag FROM @f_calls UNION SELECT DISTINCT tag2 FROM @f_calls")
def _(src: Source):
    return A.distinct_tags(catalog(src))


@query("catalog_stats", "SELECT count(*) AS total, count(*) FILTER (WHERE resolved) AS resolved, max(indexed_at) AS last_indexed_at FROM @f_calls WHERE agent_id = '2-HIGH'")
def _(src: Source):
    return A.catalog_stats(catalog(src), "2-HIGH")


@query("call_detail", f"""SELECT c.id, c.agent_id, CASE WHEN c.resolved THEN concat('full ', c.call_id) END AS summary, NOT c.resolved AS stale FROM {CATALOG_SQL} c""")
def _(src: Source):
    analyses = src.f_calls.where("resolved").select("source_file_hash", "call_id", F.concat(F.lit("full "), "call_id").alias("summary"))
    return A.call_detail(catalog(src), analyses).select("id", "agent_id", "summary", "stale")


# --- whole pipeline ---------------------------------------------------------------------------------

@query("ingest_documents", INGEST_SQL)
def _(src: Source):
    """Files and texts to indexed chunks and errors, in one plan."""
    texts = src.f_md.select("doc_id", "text", F.concat(F.lit("/docs/"), "source_doc").alias("path"))
    done = src.labels.where("toxic = 1").select("doc_id")
    chunks, errors = N.ingest_documents(texts, done, dims.doc_type_rules(src.spark))
    return (chunks.groupBy("doc_id", "doc_type", "lang").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))
            .unionByName(errors.select("doc_id", "error"), allowMissingColumns=True))
