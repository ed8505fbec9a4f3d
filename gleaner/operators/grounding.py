"""Conversation context, planner replies, answer grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import replies
from gleaner.functions.text import fold_accents, or_blank, squeeze, strip

# Turns kept, least clarification confidence, least word overlap,
# least grounded share, least sentence length, text shown instead of an ungrounded answer.
PRIOR_TURNS = 3
CLARIFY_CONFIDENCE = 0.85
MIN_OVERLAP = 2
MIN_GROUNDED = 0.6
MIN_SENTENCE = 8
FALLBACK_ANSWER = ("I don't have enough supporting evidence in the retrieved documentation to "
                   "give a reliable answer. Could you rephrase or add a bit more detail?")
PLANNER_CHUNKS = 5
PLANNER_CHARS = 500


def prior_turns(conversations: DataFrame, n: int = PRIOR_TURNS) -> DataFrame:
    """Last ``n`` question/answer pairs per conversation as text, and whether the last answer
    asked something back.

    Turns are paired by an equi-join on (conversation, turn), and the rank keeps ``n`` rows
    per conversation before the shuffle, so a very long conversation is never one group.
    """
    asked = conversations.where("role = 'user'").select("conv_id", "turn", strip(or_blank(F.col("text"))).alias("q"))
    said = conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), strip(or_blank(F.col("text"))).alias("a"))
    pairs = asked.join(said, ["conv_id", "turn"], "left").withColumn("a", or_blank(F.col("a")))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = pairs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    rows = F.sort_array(F.collect_list(F.struct("turn", "q", "a")))

    def lines(t: Column, i: Column) -> Column:
        no = (i + 1).cast("string")
        head = F.concat(F.lit("Turno "), no, F.lit(" usuario: "), t["q"])
        return F.when(t["a"] == "", head).otherwise(F.concat(head, F.lit("\nTurno "), no, F.lit(" asistente: "), t["a"]))

    grouped = last.groupBy("conv_id").agg(rows.alias("t"))
    return grouped.select("conv_id", F.array_join(F.transform("t", lines), "\n").alias("prior"),
                          F.element_at("t", -1)["a"].rlike("[?¿]").alias("is_followup"))


def retrieval_margin(answers: DataFrame) -> DataFrame:
    """First and second score per question and their distance (1.0 without a second)."""
    top = answers.groupBy("query_id").agg(
        F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("score"))), F.lit(0.0)).alias("top1"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("top2"))
    return top.withColumn("margin", F.when(F.col("top2") != 0, F.col("top1") - F.col("top2")).otherwise(1.0))


PLANNER_SCHEMA = ("action string, corrected_query string, final_query string, retrieval_query string, "
                  "clarification_question string, confidence string, reasoning_summary string, "
                  "is_followup_to_clarification string")


def planner_decision(answers: DataFrame) -> DataFrame:
    """What to do with a question, from an external planner's reply beside it.

    Input: query_id, original, corrected, retrieval_query, reply. An unreadable reply falls
    back to a plain search and says so.
    """
    body = replies.json_object(replies.drop_fence_lines(replies.drop_thoughts(or_blank(F.col("reply")))))
    rows = answers.withColumn("_b", body).withColumn("o", replies.parse_object(F.col("_b"), PLANNER_SCHEMA))
    ok = F.col("o").isNotNull() & ~F.coalesce(F.col("_b").rlike(r"^\{\s*\}$"), F.lit(False))

    def given(name: str) -> Column:
        return F.nullif(F.col(f"o.{name}"), F.lit(""))

    corrected = strip(F.coalesce(given("corrected_query"), F.nullif("corrected", F.lit("")), "original"))
    final = strip(F.coalesce(given("final_query"), F.nullif(corrected, F.lit("")), F.col("original")))
    search = strip(F.coalesce(given("retrieval_query"), F.nullif(final, F.lit("")), F.col("retrieval_query")))
    ask = strip(or_blank(F.col("o.clarification_question")))
    confidence = replies.unit_interval(F.col("o.confidence"), 0.0)
    wanted = F.lower(strip(F.coalesce(given("action"), F.lit("search"))))
    action = (F.when((wanted == "ask_clarification") & (ask != "") & (confidence >= CLARIFY_CONFIDENCE), "ask_clarification")
              .when((wanted == "no_answer") & (final == ""), "no_answer").otherwise("search"))
    blank = F.lit("")
    followup = F.coalesce(~F.lower("o.is_followup_to_clarification").isin("false", "0", "", "null"), F.lit(False))
    return rows.select(
        "query_id", F.when(ok, action).otherwise("search").alias("action"),
        F.when(ok, corrected).otherwise(F.col("corrected")).alias("corrected_query"),
        F.when(ok, F.coalesce(F.nullif(final, blank), "original")).otherwise(F.coalesce(F.nullif("corrected", blank), "original")).alias("final_query"),
        F.when(ok, F.coalesce(F.nullif(search, blank), F.nullif("retrieval_query", blank), F.col("original")))
        .otherwise(F.coalesce(F.nullif("retrieval_query", blank), "original")).alias("retrieval_query"),
        F.when(ok, ask).otherwise("").alias("clarification_question"),
        F.when(ok, confidence).otherwise(0.0).alias("confidence"),
        F.when(ok, strip(or_blank(F.col("o.reasoning_summary")))).otherwise("").alias("reasoning_summary"),
        F.when(ok, followup).otherwise(False).alias("is_followup"),
        ok.alias("used"), F.when(ok, "").otherwise("parse_error").alias("fallback_reason"))


def build_context(answers: DataFrame) -> DataFrame:
    """Ranked chunks of a question (at most the answers asked for) as one text."""
    page = F.when(F.coalesce("source_page", F.lit(0)) != 0, F.concat(F.lit(", p."), F.col("source_page").cast("string"))).otherwise("")
    section = F.when(or_blank(F.col("source_section")) != "", F.concat(F.lit(", §"), "source_section")).otherwise("")
    head = F.concat(F.lit("[Excerpt "), F.col("rank").cast("string"), F.lit(" — "),
                    F.coalesce(F.nullif("source_doc", F.lit("")), F.lit("unknown")), page, section, F.lit("]"))
    line = F.concat(head, F.lit("\n"), or_blank(F.col("text")))
    parts = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return answers.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n\n---\n\n").alias("context"))


def planner_context(answers: DataFrame) -> DataFrame:
    """The first chunks, shortened, as the planner sees them."""
    text = squeeze(or_blank(F.col("text")))
    short = F.when(F.length(text) > PLANNER_CHARS,
                   F.concat(F.rtrim(F.substring(text, 1, PLANNER_CHARS - 3)), F.lit("..."))).otherwise(text)
    section = F.when(or_blank(F.col("source_section")) != "", F.concat(F.lit(", sección="), "source_section")).otherwise("")
    page = F.when(F.coalesce("source_page", F.lit(0)) != 0, F.concat(F.lit(", página="), F.col("source_page").cast("string"))).otherwise("")
    line = F.concat(F.lit("Fragmento "), F.col("rank").cast("string"), F.lit(" (score="), F.format_string("%.3f", "score"),
                    F.lit(", doc="), F.coalesce(F.nullif("source_doc", F.lit("")), F.lit("desconocido")), page, section, F.lit("):\n"), short)
    parts = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return (answers.where(F.col("rank") <= PLANNER_CHUNKS).groupBy("query_id")
            .agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n\n").alias("fragments")))


def first_success(attempts: DataFrame, catalog: DataFrame, default_model: str) -> DataFrame:
    """Answer of the first attempt that produced text, per question.

    Unknown model names stand for the default. ``fell_back``: it was not the first attempt.
    Without any success the text is blank.
    """
    known = attempts.join(catalog.select("model", F.lit(True).alias("_k")), "model", "left").withColumn(
        "model", F.when(F.col("_k"), F.col("model")).otherwise(F.lit(default_model)))
    text = strip(or_blank(F.col("text")))
    good = ~F.col("failed") & (text != "")
    best = known.groupBy("query_id").agg(
        F.min("attempt").alias("_first"),
        F.min_by(F.when(good, F.struct("attempt", "model", text.alias("text"))), F.when(good, F.col("attempt"))).alias("b"))
    return best.select("query_id", or_blank(F.col("b.text")).alias("text"), F.col("b.model").alias("model"),
                       F.coalesce(F.col("b.attempt") > F.col("_first"), F.lit(False)).alias("fell_back"))


# --- grounding ----------------------------------------------------------------

def sentences(answer: Column) -> Column:
    """Sentences long enough to check, list marks removed."""
    raw = F.split(or_blank(answer), r"(?U)(?<=[.!?])\s+|\n+")
    clean = F.transform(raw, lambda s: F.regexp_replace(strip(s), r"(?U)^\s*(?:[-*•]|\d+[.)])\s*", ""))
    return F.filter(clean, lambda s: F.length(s) >= MIN_SENTENCE)


def answer_sentences(answers: DataFrame) -> DataFrame:
    found = answers.select("answer_id", F.posexplode_outer(sentences(F.col("answer"))).alias("sentence_no", "sentence"))
    return found.where("sentence IS NOT NULL")


def long_words(text: Column) -> Column:
    """Distinct unaccented words of four and more characters."""
    return F.array_distinct(F.regexp_extract_all(fold_accents(text), F.lit(r"[a-z0-9]{4,}"), F.lit(0)))


def ground_answers(answers: DataFrame, chunks: DataFrame, min_ratio: float = MIN_GROUNDED) -> DataFrame:
    """Share of an answer's sentences with enough words in common with one of its chunks.

    Chunks per answer are bounded by the answers retrieved, so their word sets meet the
    sentences inside one row; only the word sets are shuffled, not the texts.
    """
    words = (chunks.where(strip(or_blank(F.col("text"))) != "")
             .select("answer_id", long_words(F.col("text")).alias("w"))
             .groupBy("answer_id").agg(F.collect_list("w").alias("ws")))
    rows = answers.select("answer_id", sentences(F.col("answer")).alias("s")).join(words, "answer_id", "left")

    def supported(s: Column) -> Column:
        mine = long_words(s)
        return (F.size(mine) == 0) | F.exists("ws", lambda w: F.size(F.array_intersect(mine, w)) >= MIN_OVERLAP)

    n = F.size("s")
    hits = F.when(F.col("ws").isNull(), F.lit(0)).otherwise(F.size(F.filter("s", supported)))
    counted = rows.select("answer_id", n.alias("checked"), hits.alias("_ok"))
    ratio = F.when(F.col("checked") == 0, 1.0).otherwise(F.col("_ok") / F.col("checked"))
    return counted.select(
        "answer_id", (ratio >= min_ratio).alias("grounded"), ratio.alias("grounded_ratio"), "checked",
        F.when(F.col("checked") == 0, 0).otherwise(F.col("checked") - F.col("_ok")).alias("unsupported"))


def guard_answers(answers: DataFrame, grounding: DataFrame, has_chunks: DataFrame, enabled: bool = True) -> DataFrame:
    """Exchange ungrounded answers for a safe text; without answer or chunks nothing is checked."""
    checked = grounding.join(has_chunks.select("answer_id").distinct(), "answer_id", "left_semi")
    rows = answers.join(checked, "answer_id", "left")
    on = F.lit(enabled) & (or_blank(F.col("answer")) != "") & F.col("grounded").isNotNull()
    return rows.select("answer_id", F.when(on & ~F.col("grounded"), FALLBACK_ANSWER).otherwise(F.col("answer")).alias("answer"),
                       F.when(on, F.col("grounded")).alias("grounded"), F.when(on, F.bround("grounded_ratio", 3)).alias("grounding_ratio"))
