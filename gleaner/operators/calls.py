"""Diarised speech to conversations, call analyses, call catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import replies
from gleaner.functions.text import or_blank, strip
from gleaner.operators.maintenance import latest_by
from gleaner.operators.sequence import carry_last, previous, running_sum, running_sums
from gleaner.session import dealt

# Silence that splits, silence for a speaker reset, least length, in seconds.
GAP_S = 3.0
RESET_GAP_S = 1.0
MIN_CONVERSATION_S = 30.0
VOLUME_WORDS = 10_000  # words of a run put together in one text
VOLUME_S = 86_400.0  # seconds of a call put together in one transcript
SLOT_S = 3600.0  # recordings are worked on in slots of this many seconds

UNKNOWN = "UNKNOWN"


def speaker_label(c: Column) -> Column:
    return F.format_string("SPEAKER_%02d", F.coalesce(c.cast("int"), F.lit(0)))


def words_to_segments(words: DataFrame, slot: Column | None = None) -> DataFrame:
    """Runs of words of one speaker: (recording_id, segment_no, volume, speaker, start, end, text).

    ``words``: recording_id, word_no, speaker, start, end, word. Runs are found slot by slot,
    so that a recording of any length is several groups; a run's text is cut into volumes of
    ``VOLUME_WORDS`` words.
    """
    n = words.count()
    rows = dealt(words.withColumn("_slot", F.floor(F.col("start") / SLOT_S) if slot is None else slot), n, "recording_id", "_slot")
    order = ["word_no"]
    # A word without speaker belongs to the one who was speaking.
    rows = carry_last(rows, ["recording_id"], "_slot", order, "speaker", "_speaker").drop("speaker").withColumnRenamed("_speaker", "speaker")
    rows = previous(rows, ["recording_id"], "_slot", order, ["speaker", "word_no"])
    first = ~F.col("prev_speaker").eqNullSafe(F.col("speaker")) | (F.col("prev_word_no").isNull())
    rows = rows.withColumns({"_new": first.cast("int"), "_one": F.lit(1)})
    rows = running_sums(rows, ["recording_id"], "_slot", order, {"segment_no": "_new", "_place": "_one"})
    ordered = F.sort_array(F.collect_list(F.struct("word_no", F.col("word").alias("w"))))
    rows = carry_last(rows.withColumn("_from", F.when(F.col("_new") == 1, F.col("_place"))), ["recording_id"], "_slot", order, "_from", "_first")
    rows = rows.withColumn("volume", F.floor((F.col("_place") - F.col("_first")) / VOLUME_WORDS))
    return dealt(rows, n, "recording_id", "segment_no", "volume", "speaker").groupBy("recording_id", "segment_no", "volume", "speaker").agg(
        F.min_by("start", "word_no").alias("start"), F.max_by("end", "word_no").alias("end"),
        strip(F.array_join(F.transform(ordered, lambda x: x["w"]), " ")).alias("text"))


def normalize_segments(raw: DataFrame) -> DataFrame:
    """Utterances of a speech provider (recording_id, utterances array<struct<start,end,transcript,
    speaker>>) as segments."""
    return raw.select("recording_id", F.posexplode("utterances").alias("seg_no", "u")).select(
        "recording_id", "seg_no", F.coalesce("u.start", F.lit(0.0)).alias("start"), F.coalesce("u.end", F.lit(0.0)).alias("end"),
        strip(or_blank(F.col("u.transcript"))).alias("text"), speaker_label(F.col("u.speaker")).alias("speaker"))


def _ready(segments: DataFrame) -> DataFrame:
    """Non-blank segments with their slot; a missing end is the start."""
    return (segments.where(strip(or_blank(F.col("text"))) != "")
            .withColumn("end", F.coalesce("end", "start"))
            .withColumn("speaker", F.coalesce(F.nullif(strip(or_blank(F.col("speaker"))), F.lit("")), F.lit(UNKNOWN)))
            .withColumn("_slot", F.floor(F.col("start") / SLOT_S)))


def split_by_gap(segments: DataFrame, gap_s: float = GAP_S, tie: str = "seg_id") -> DataFrame:
    """Segments with ``conv_no`` (from 0), new whenever the silence before exceeds ``gap_s``."""
    rows = previous(_ready(segments), ["recording_id"], "_slot", ["start", tie], ["end"])
    rows = rows.withColumn("_new", F.coalesce((F.col("start") - F.col("prev_end") > gap_s).cast("int"), F.lit(0)))
    return running_sum(rows, ["recording_id"], "_slot", ["start", tie], "_new", "conv_no").drop("_new", "_slot", "prev_end")


def split_conversations(segments: DataFrame, gap_s: float = GAP_S, reset_gap_s: float = RESET_GAP_S,
                        min_s: float = MIN_CONVERSATION_S, tie: str = "seg_id") -> DataFrame:
    """Segments with their ``call_index``: split by silence, and by *speaker reset* - after a
    shorter silence the recording's first speaker comes back and the current block already
    has two segments of two speakers. Blocks are numbered first, then short ones are dropped.

    Whether a segment resets depends on one bit, that the block so far has a change of speaker,
    and a segment turns that bit in one of four ways: it stays, is flipped, is set or is cleared.
    So the bit is the last value set or cleared before, flipped by the parity of the flips since:
    running aggregates, computed slot by slot (see :mod:`gleaner.operators.sequence`), and no
    stretch of speech has to be walked through by one task.
    """
    keys, order = ["recording_id"], ["start", tie]
    ready = _ready(segments)
    rows = previous(ready, keys, "_slot", order, ["end", "speaker"])
    openings = ready.groupBy(*keys, "_slot").agg(F.min_by("speaker", F.struct(*order)).alias("_s"))
    first = openings.groupBy(*keys).agg(F.min_by("_s", "_slot").alias("_first_speaker"))
    silence = F.col("start") - F.col("prev_end")
    rows = rows.join(first, keys).withColumns({
        "_cut": F.coalesce(silence > gap_s, F.lit(True)),  # also the first segment, without one before
        "_may": F.coalesce((silence > reset_gap_s) & (F.col("speaker") == F.col("_first_speaker")), F.lit(False)),
        "_turn": F.coalesce(F.col("speaker") != F.col("prev_speaker"), F.lit(False))})
    rows = rows.withColumns({
        "_set": F.when(F.col("_cut") | (F.col("_may") & ~F.col("_turn")), 0).when(~F.col("_may") & F.col("_turn"), 1),
        "_flip": (~F.col("_cut") & F.col("_may") & F.col("_turn")).cast("int")})
    rows = _bit_before(rows, keys, order)
    rows = rows.withColumn("_new", (F.col("_cut") | (F.col("_may") & (F.col("_bit") == 1))).cast("int"))
    numbered = running_sum(rows, keys, "_slot", order, "_new", "call_index").withColumn("call_index", F.col("call_index") - 1)
    numbered = numbered.select(*[c for c in ready.columns if c != "_slot"], "call_index")
    length = numbered.groupBy("recording_id", "call_index").agg(
        F.min("start").alias("conv_start"), F.max_by("end", F.struct(*order)).alias("conv_end"))
    long = length.where(F.greatest(F.col("conv_end") - F.col("conv_start"), F.lit(0.0)) >= min_s)
    return numbered.join(long, ["recording_id", "call_index"])


def _bit_before(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``_bit``: the bit before each row, from ``_set`` (0, 1 or null) and ``_flip`` (0 or 1).

    Inside a slot the bit is known once a row has set it; until then it is the bit the slot
    began with, flipped by the slot's flips so far. A slot as a whole sets or flips likewise."""
    def known(sets: Column, flips: Column) -> Column:
        """Last bit set, with the flips counted up to there taken back; rows add their own."""
        return F.last(F.when(sets.isNotNull(), F.pmod(sets + flips, F.lit(2))), ignorenulls=True)

    inside = Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_n", F.sum("_flip").over(inside))
    whole = local.groupBy(*keys, "_slot").agg(
        F.sum("_flip").alias("_flips"), F.max_by(F.pmod(F.col("_set") + F.col("_n"), F.lit(2)), F.when(F.col("_set").isNotNull(), F.struct(*order))).alias("_k"))
    whole = whole.withColumn("_sets", F.pmod(F.col("_k") + F.col("_flips"), F.lit(2)))
    across = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    # A slot that sets the bit does so after its flips, so those that follow it are counted from its end.
    whole = whole.withColumn("_total", F.sum("_flips").over(across))
    began = whole.withColumn("_began", F.pmod(F.coalesce(known(F.col("_sets"), F.col("_total")).over(earlier), F.lit(0))
                                              + F.coalesce(F.sum("_flips").over(earlier), F.lit(0)), F.lit(2)))
    flips = F.coalesce(F.sum("_flip").over(ahead), F.lit(0))
    local = local.withColumns({"_own": known(F.col("_set"), F.col("_n")).over(ahead), "_ahead": flips})
    return local.join(began.select(*keys, "_slot", "_began"), [*keys, "_slot"]).withColumn(
        "_bit", F.pmod(F.coalesce("_own", "_began") + F.col("_ahead"), F.lit(2)))


def relative_times(segments: DataFrame) -> DataFrame:
    """Segment times from the start of their conversation (``conv_start``), milliseconds."""
    return segments.withColumns({
        "start": F.bround(F.col("start") - F.col("conv_start"), 3), "end": F.bround(F.col("end") - F.col("conv_start"), 3),
        "text": strip(F.col("text")), "speaker": F.coalesce(F.nullif(strip(or_blank(F.col("speaker"))), F.lit("")), F.lit(UNKNOWN))})


def format_mm_ss(c: Column) -> Column:
    """Seconds as MM:SS; seconds are rounded half to even and carry at 60."""
    s = F.greatest(c.cast("double"), F.lit(0.0))
    minutes = F.floor(s / 60)
    seconds = F.bround(s - minutes * 60, 0).cast("int")
    carry = seconds >= 60
    m = F.when(carry, minutes + 1).otherwise(minutes).cast("string")
    return F.concat(F.when(F.length(m) < 2, F.lpad(m, 2, "0")).otherwise(m), F.lit(":"), F.lpad(F.when(carry, 0).otherwise(seconds).cast("string"), 2, "0"))


def transcript_lines(segments: DataFrame) -> DataFrame:
    """Segments as transcript lines, in long form with their order."""
    speaker = F.coalesce(F.nullif("speaker", F.lit("")), F.lit("?"))
    return segments.select("call_id", "start", "seg_id", F.concat(
        F.format_string("[%.1fs–%.1fs] ", "start", F.coalesce("end", "start")), speaker, F.lit(": "), strip(or_blank(F.col("text")))).alias("line"))


def transcript_block(segments: DataFrame) -> DataFrame:
    """Transcript per call (call_id, volume, transcript); a volume is a day of the call's time."""
    lines = F.sort_array(F.collect_list(F.struct("start", "seg_id", "line")))
    rows = transcript_lines(segments).withColumn("volume", F.floor(F.coalesce("start", F.lit(0.0)) / VOLUME_S))
    return rows.groupBy("call_id", "volume").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))


def call_manifest(conversations: DataFrame, recordings: DataFrame) -> DataFrame:
    """Per recording: status, conversations, lengths, segments, processing ratio.

    ``conversations``: segments with recording_id, call_index, conv_start, conv_end;
    ``recordings``: recording_id, duration_s, elapsed_s, segment_count.
    """
    calls = conversations.select("recording_id", "call_index", "conv_start", "conv_end").distinct()
    per = calls.groupBy("recording_id").agg(F.count("*").alias("conversations"), F.sum(F.col("conv_end") - F.col("conv_start")).alias("speech_s"))
    return recordings.join(per, "recording_id", "left").select(
        "recording_id", F.when(F.coalesce("segment_count", F.lit(0)) == 0, "empty_transcript").otherwise("ok").alias("status"),
        F.coalesce("conversations", F.lit(0)).cast("bigint").alias("conversations"), F.coalesce("speech_s", F.lit(0.0)).alias("speech_s"),
        F.coalesce("segment_count", F.lit(0)).cast("bigint").alias("segment_count"),
        F.when(F.coalesce("duration_s", F.lit(0.0)) > 0, F.col("elapsed_s") / F.col("duration_s")).otherwise(0.0).alias("processing_ratio"))


def call_ids(conversations: DataFrame) -> DataFrame:
    """(recording_id, call_index, call_id): kept conversations numbered CALL-001 upwards."""
    calls = conversations.select("recording_id", "call_index", "conv_start").distinct().withColumn("_slot", F.floor(F.col("conv_start") / SLOT_S)).withColumn("_one", F.lit(1))
    numbered = running_sum(calls, ["recording_id"], "_slot", ["call_index"], "_one", "_n")
    no = F.col("_n").cast("string")
    return numbered.select("recording_id", "call_index", F.concat(F.lit("CALL-"), F.when(F.length(no) < 3, F.lpad(no, 3, "0")).otherwise(no)).alias("call_id"))


# --- analyses --------------------------------------------------------------------------

# Confidence words, truth words, hints of (un)resolved problems.
CONFIDENCE_WORDS = {
    "high": 0.85, "very high": 0.95, "veryhigh": 0.95, "medium": 0.6, "med": 0.6, "mid": 0.6, "low": 0.35,
    "very low": 0.15, "verylow": 0.15, "alto": 0.85, "medio": 0.6, "bajo": 0.35,
}
TRUE_WORDS = ("true", "1", "yes", "y", "si", "sí", "verdadero", "ok")
FALSE_WORDS = ("false", "0", "no", "n", "falso")
UNRESOLVED_HINTS = ("no se confirma", "no se confir", "sin resolver", "pendiente", "no resuelto", "no queda", "no se puede confirmar")
RESOLVED_HINTS = ("resuelto", "confirmado", "solucionado", "exitosamente", "éxito", "exito")
SECONDS = r"(?i)^\s*([+-]?\d+(?:\.\d+)?)\s*s?\s*$"


def coerce_confidence(c: Column) -> Column:
    """Confidence text as a number in 0..1: words are known, booleans count, else 0.5."""
    word = F.lower(strip(c))
    table = F.create_map(*[F.lit(x) for pair in CONFIDENCE_WORDS.items() for x in pair])
    number = F.greatest(F.lit(0.0), F.least(F.lit(1.0), word.try_cast("double")))
    known = F.when(c == "true", 1.0).when(c == "false", 0.0).otherwise(F.try_element_at(table, or_blank(word)))
    return F.coalesce(known, F.when(word.try_cast("double").isNotNull(), number), F.lit(0.5))


def _hint(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, w: a | F.contains(c, F.lit(w)), words, F.lit(False))


def coerce_resolved(raw: Column, resolution: Column) -> tuple[Column, Column]:
    """(resolved flag, resolution): truth words and numbers, phrases (negative ones first);
    other prose belongs to the resolution."""
    text = strip(or_blank(raw))
    low = F.lower(text)
    number = low.try_cast("double")
    flag = (F.when(text == "", False).when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)
            .when(number.isNotNull(), number != 0).when(_hint(low, UNRESOLVED_HINTS), False).when(_hint(low, RESOLVED_HINTS), True))
    base = or_blank(resolution)
    merged = strip(F.concat(strip(base), F.when(strip(base) != "", "\n\n").otherwise(""), text))
    return F.coalesce(flag, F.lit(False)), F.when(flag.isNull(), merged).otherwise(base)


def coerce_seconds(c: Column) -> Column:
    """``904.5``, ``904.5s`` and the like as a number; null if it is none."""
    return F.nullif(F.regexp_extract(c, SECONDS, 1), F.lit("")).cast("double")


REQUIRED_TEXTS = ("call_id", "source_file", "source_file_hash", "timestamp_start", "timestamp_end", "problem", "description", "resolution", "summary")
LISTS = ("rag_qa", "software_features", "error_codes", "tags", "transcript")


def coerce_calls(raw: DataFrame) -> DataFrame:
    """Analyses with missing texts blank, missing lists empty, odd values made regular.

    ``rag_qa`` items and ``transcript`` lines carry confidence and seconds as text.
    """
    names = set(raw.columns)
    out = raw.withColumns({c: or_blank(F.col(c)) for c in REQUIRED_TEXTS if c in names})
    out = out.withColumns({c: F.coalesce(F.col(c), F.array().cast(raw.schema[c].dataType)) for c in LISTS if c in names})
    if "resolved" in names:
        flag, text = coerce_resolved(F.col("resolved"), F.col("resolution"))
        out = out.withColumns({"resolved": flag, "resolution": text})
    if "rag_qa" in names:
        out = out.withColumn("rag_qa", F.transform("rag_qa", lambda p: F.struct(
            p["question"].alias("question"), p["answer"].alias("answer"), p["category"].alias("category"), coerce_confidence(p["confidence"]).alias("confidence"))))
    if "transcript" in names:
        out = out.withColumn("transcript", F.transform("transcript", lambda x: F.struct(
            coerce_seconds(x["start"]).alias("start"), coerce_seconds(x["end"]).alias("end"), or_blank(x["speaker"]).alias("speaker"), or_blank(x["text"]).alias("text"))))
    return out


# The keys of a reply, each with its type and our column.
REPLY_KEYS = (
    ("farmacia", "string", "customer"), ("llamante", "string", "caller"), ("agent", "string", "agent"),
    ("problema_corto", "string", "problem"), ("descripcion_problema", "string", "description"), ("causa_raiz", "string", "root_cause"),
    ("resolucion", "string", "resolution"), ("resolucion_exitosa", "string", "resolved"), ("resumen", "string", "summary"),
    ("timestamp_start", "string", "timestamp_start"), ("timestamp_end", "string", "timestamp_end"),
    ("rag_qa", "array<struct<question:string,answer:string,category:string,confidence:string>>", "rag_qa"),
    ("software_features", "array<string>", "software_features"), ("error_codes", "array<string>", "error_codes"), ("tags", "array<string>", "tags"),
    ("transcript", "array<struct<start:string,end:string,speaker:string,text:string>>", "transcript"))
REPLY_SCHEMA = ", ".join(f"{key} {kind}" for key, kind, _ in REPLY_KEYS)
FALLBACK_PROBLEM = "Fallo al analizar la conversación automáticamente"
FALLBACK_TAGS = ("analysis-error", "needs-review")


def parse_call_replies(answers: DataFrame) -> DataFrame:
    """Analyses from model replies (call_id, reply): fences, control characters in strings and
    trailing commas are tolerated; an unreadable reply yields a row marked for review."""
    body = replies.drop_trailing_commas(replies.json_object(replies.fenced_body(or_blank(F.col("reply")))))
    rows = answers.withColumn("o", replies.parse_object(body, REPLY_SCHEMA))
    ok = F.col("o").isNotNull()
    fallback = {"problem": F.lit(FALLBACK_PROBLEM), "tags": F.array(*[F.lit(t) for t in FALLBACK_TAGS])}
    return rows.select("call_id", *[F.when(ok, F.col(f"o.{key}")).otherwise(fallback.get(n, F.lit(None))).alias(n) for key, _, n in REPLY_KEYS],
                       (~ok).alias("analysis_fallback"))


# --- catalogue ---------------------------------------------------------------------------

def catalog_id(file_hash: Column, call_id: Column) -> Column:
    """Unique call id: 12 digits of the file hash before the id within the file."""
    short = F.substring(or_blank(file_hash), 1, 12)
    return F.when(short != "", F.concat(short, F.lit("-"), or_blank(call_id))).otherwise(or_blank(call_id))


CATALOG_COLUMNS = ("call_id", "agent_id", "source_file_hash", "source_file", "customer", "caller", "agent", "problem", "resolved", "tags",
                   "timestamp_start", "timestamp_end", "indexed_at")


def call_catalog(calls: DataFrame) -> DataFrame:
    """One list row per call id, the last indexed one."""
    rows = calls.select(catalog_id(F.col("source_file_hash"), F.col("call_id")).alias("id"),
                        *[or_blank(F.col(c)).alias(c) for c in CATALOG_COLUMNS if c not in ("resolved", "tags")],
                        F.coalesce("resolved", F.lit(False)).alias("resolved"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    return latest_by(rows, ["id"], ["indexed_at"])


def list_calls(catalog: DataFrame, agent_id: str | None = None, tag: str | None = None, customer: str | None = None,
               resolved: bool | None = None, search: str | None = None, limit: int = 500, offset: int = 0) -> DataFrame:
    """Filtered page of calls, newest first (top-k; ties by id). Search texts are literal."""
    rows = catalog
    if agent_id:
        rows = rows.where(F.col("agent_id") == agent_id)
    if customer:
        rows = rows.where(F.col("customer") == customer)
    if resolved is not None:
        rows = rows.where(F.col("resolved") == F.lit(resolved))
    if search:
        rows = rows.where(reduce(lambda a, c: a | F.contains(F.lower(c), F.lit(search.lower())), ("problem", "source_file", "call_id", "id"), F.lit(False)))
    if tag:
        rows = rows.where(F.array_contains("tags", tag))
    return rows.orderBy(F.desc("indexed_at"), "id").offset(offset).limit(limit)


def _of_agent(catalog: DataFrame, agent_id: str | None) -> DataFrame:
    return catalog.where(F.col("agent_id") == agent_id) if agent_id else catalog


def distinct_customers(catalog: DataFrame, agent_id: str | None = None) -> DataFrame:
    return _of_agent(catalog, agent_id).where("customer <> ''").select("customer").distinct().orderBy("customer")


def distinct_tags(catalog: DataFrame, agent_id: str | None = None) -> DataFrame:
    return (_of_agent(catalog, agent_id).select(F.explode("tags").alias("tag"))
            .select(strip(or_blank(F.col("tag"))).alias("tag")).where("tag <> ''").distinct().orderBy("tag"))


def catalog_stats(catalog: DataFrame, agent_id: str | None = None) -> DataFrame:
    return _of_agent(catalog, agent_id).agg(F.count("*").alias("total"), F.count_if("resolved").alias("resolved"), or_blank(F.max("indexed_at")).alias("last_indexed_at"))


def call_detail(catalog: DataFrame, analyses: DataFrame) -> DataFrame:
    """Catalogue rows with their full analysis; ``stale`` where it is missing."""
    full = analyses.withColumn("_there", F.lit(True))
    return (catalog.join(full, ["source_file_hash", "call_id"], "left")
            .withColumn("stale", F.col("_there").isNull()).drop("_there"))
