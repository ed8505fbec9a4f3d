"""Retrieval benchmark: sampling, pair checks, hit rates, compliance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.dims import MIN_HR3_OVERALL, MIN_VALIDATED
from gleaner.functions import replies
from gleaner.functions.text import norm_section, or_blank, preview, strip

# Words of procedures, shares of a sample in per cent, text lengths.
PROCEDURE_WORDS = ("configuración", "paso", "procedimiento", "cómo", "instrucciones", "pasos para")
SAMPLE_SHARES = {"structured_manual": 25, "operational_guide": 20, "module_manual": 20, "changelog_as_manual": 15}
OTHERS = "others"
MIN_TEXT = 50
NEGATIVES = 6
MIN_CONFIDENCE = 0.6


def difficulty(has_image: Column, text: Column) -> Column:
    low = F.lower(or_blank(text))
    hit = F.lit(False)
    for w in PROCEDURE_WORDS:
        hit = hit | F.contains(low, F.lit(w))
    return F.when(F.coalesce(has_image, F.lit(False)), "L3").when(hit, "L2").otherwise("L1")


def assign_difficulty(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("difficulty", difficulty(F.col("has_image_caption"), F.col("text")))


def draw(seed: int | str, *keys: str) -> Column:
    """Repeatable pseudo-random order of rows."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def quotas(n: int) -> dict[str, int]:
    """Sample size per stratum in exact whole-number arithmetic."""
    out = {k: n * share // 100 for k, share in SAMPLE_SHARES.items()}
    out[OTHERS] = n * (100 - sum(SAMPLE_SHARES.values())) // 100
    return out


def stratified_sample(chunks: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` chunks by document type quotas, each capped by what there is.

    The rank below the greatest quota is cut before the shuffle, so a stratum that holds
    most chunks sends no more rows than a small one.
    """
    per = quotas(n)
    kind = F.when(F.col("doc_type").isin(*SAMPLE_SHARES), F.col("doc_type")).otherwise(OTHERS)
    w = Window.partitionBy("stratum").orderBy("_draw", "chunk_id")
    ranked = (chunks.withColumn("stratum", kind).withColumn("_draw", draw(seed, "chunk_id"))
              .withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(per.values())))
    quota = F.create_map(*[x for k, v in per.items() for x in (F.lit(k), F.lit(v))])
    return ranked.where(F.col("_n") <= quota[F.col("stratum")]).drop("_n", "_draw")


def numbered(chunks: DataFrame, seed: int) -> DataFrame:
    """``place`` (from 0) of every chunk in the drawn order of its type, and ``of``, their number.

    Chunks are numbered within slices of the draw, so a type is many groups; slices are counted first.
    """
    rows = chunks.withColumn("_draw", draw(seed, "chunk_id")).withColumn("_slice", F.substring("_draw", 1, 3))
    sizes = rows.groupBy("doc_type", "_slice").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("doc_type").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("doc_type", "_slice", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy("doc_type")).alias("of"))
    inside = Window.partitionBy("doc_type", "_slice").orderBy("_draw", "chunk_id")
    return (rows.withColumn("_n", F.row_number().over(inside) - 1).join(sizes, ["doc_type", "_slice"])
            .withColumn("place", F.col("_before") + F.col("_n")).drop("_draw", "_slice", "_n", "_before"))


def hard_negative_candidates(pairs: DataFrame, chunks: DataFrame, seed: int = 0) -> DataFrame:
    """Up to six other chunks of a pair's document type in drawn order: (pair_id, n, chunk_id, text).

    All chunks of the type take part: they are numbered in drawn order, and a pair takes the chunks
    from a place of its own draw on (round the end, its gold chunk left out). Pairs with
    fewer than two candidates have none.
    """
    pool = numbered(chunks.where(F.length("text") > MIN_TEXT).select("chunk_id", "doc_type", "text"), seed)
    sizes = pool.groupBy("doc_type").agg(F.max("of").alias("of"))
    start = F.conv(F.substring(draw(seed, "pair_id"), 1, 8), 16, 10).cast("bigint") % F.col("of")
    step = F.explode(F.sequence(F.lit(0), F.least(F.lit(NEGATIVES), F.col("of") - 1).cast("int")))
    asked = (pairs.select("pair_id", "gold_chunk_id", "doc_type").join(sizes, "doc_type")
             .select("pair_id", "gold_chunk_id", "doc_type", start.alias("_start"), "of", step.alias("_step"))
             .withColumn("place", (F.col("_start") + F.col("_step")) % F.col("of")).drop("of"))
    met = asked.join(pool.select("doc_type", "place", "chunk_id", "text"), ["doc_type", "place"]).where(F.col("chunk_id") != F.col("gold_chunk_id"))
    own = Window.partitionBy("pair_id")
    ranked = met.withColumn("n", F.row_number().over(own.orderBy("_step")) - 1).withColumn("_k", F.count("*").over(own))
    return ranked.where((F.col("_k") >= 2) & (F.col("n") < NEGATIVES)).select("pair_id", "n", "chunk_id", "text")


def pick_negatives(candidates: DataFrame, picks: DataFrame) -> DataFrame:
    """Two negatives per pair: those an external choice names by position, else the first two."""
    rows = candidates.join(picks, "pair_id", "left")
    a, b = F.coalesce("neg_a_index", F.lit(0)), F.coalesce("neg_b_index", F.lit(1))
    found = rows.groupBy("pair_id").agg(F.max(F.when(F.col("n") == a, F.col("text"))).alias("a"), F.max(F.when(F.col("n") == b, F.col("text"))).alias("b"))
    return found.select("pair_id", F.coalesce("a", "b").alias("hard_neg_a"), F.when(F.col("a").isNotNull(), F.col("b")).alias("hard_neg_b"))


def build_pairs(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Question/answer pairs from an external writer's replies, with their gold fields."""
    rows = (assign_difficulty(chunks).where(F.length(strip(or_blank(F.col("text")))) >= MIN_TEXT)
            .join(answers.select("chunk_id", "reply"), "chunk_id")
            .withColumn("o", replies.parse_object(replies.json_object(F.col("reply")), "question string, answer string")))
    return rows.where((or_blank(F.col("o.question")) != "") & (or_blank(F.col("o.answer")) != "")).select(
        F.col("chunk_id").alias("gold_chunk_id"), F.col("o.question").alias("question"), F.col("o.answer").alias("answer"),
        "difficulty", F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"), "source_doc", "source_section",
        F.coalesce("has_image_caption", F.lit(False)).alias("has_image_source"), F.col("text").alias("chunk_text_preview"))


def validate_pairs(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """Pairs with the verdict of an external validator: answerable, accurate and sure enough."""
    rows = pairs.drop("validated").join(answers.select("pair_id", "reply"), "pair_id", "left").withColumn(
        "o", replies.parse_object(replies.json_object(F.col("reply")), "answerable boolean, accurate boolean, confidence double"))
    sure = F.coalesce("o.confidence", F.lit(0.0))
    good = F.coalesce("o.answerable", F.lit(False)) & F.coalesce("o.accurate", F.lit(False)) & (sure >= MIN_CONFIDENCE)
    return rows.withColumn("validator_confidence", sure).withColumn("validated", good).drop("o", "reply")


def pair_stats(pairs: DataFrame) -> DataFrame:
    """Long counts (dim, key, n): by difficulty, by document type, total and validated."""
    sets = pairs.groupingSets([["difficulty"], ["doc_type"], []], "difficulty", "doc_type").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("validated").alias("v"))
    dims = sets.where("g IN (1, 2)").select(
        F.when(F.col("g") == 1, "difficulty").otherwise("doc_type").alias("dim"),
        F.when(F.col("g") == 1, F.col("difficulty")).otherwise(F.col("doc_type")).alias("key"), "n")
    whole = sets.where("g = 3")
    return (dims.unionByName(whole.select(F.lit("total").alias("dim"), F.lit("pairs").alias("key"), "n"))
            .unionByName(whole.select(F.lit("total").alias("dim"), F.lit("validated").alias("key"), F.col("v").alias("n"))))


def distribution_report(stats: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares against their targets with warnings: (kind, key, actual_pct, target_pct, warning).

    ``stats`` is long and has one row per group, so everything after it is small.
    """
    total = stats.where("dim = 'total' AND key = 'pairs'").select("n").scalar()
    validated = stats.where("dim = 'total' AND key = 'validated'").select("n").scalar()
    typed = targets.where(f"kind = 'doc_type' AND key <> '{OTHERS}'").select(F.col("key").alias("_typed"))
    dims = stats.where("dim <> 'total'")
    named = dims.join(typed, (F.col("dim") == "doc_type") & (F.col("key") == F.col("_typed")), "left").select(
        F.col("dim").alias("kind"),
        F.when((F.col("dim") == "doc_type") & F.col("_typed").isNull(), OTHERS).otherwise(F.col("key")).alias("key"), "n")
    counts = named.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    rows = targets.join(counts, ["kind", "key"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("total", total)
    slack = F.greatest(F.lit(0.08), F.least(F.lit(0.20), F.lit(24.0) / F.greatest("total", F.lit(1))))
    actual = F.col("n") / F.col("total")
    off = F.abs(actual - F.col("share_pct") / 100) > F.when(F.col("key") == OTHERS, slack + 0.05).otherwise(slack)
    pct = F.concat(F.format_string("%.1f", actual * 100), F.lit("% vs target ~"), F.col("share_pct").cast("string"), F.lit("%"))
    text = (F.when(F.col("kind") == "difficulty", F.concat(
        F.lit("Difficulty "), "key", F.lit(": "), pct, F.lit(" (n="), F.col("total").cast("string"), F.lit(", slack ±"),
        F.format_string("%.0f", slack * 100), F.lit("pp)")))
        .when(F.col("key") == OTHERS, F.concat(F.lit("Other doc types: "), pct)).otherwise(F.concat(F.lit("Doc type "), "key", F.lit(": "), pct)))
    shares = rows.where("total > 0").select(
        "kind", "key", F.bround(actual * 100, 1).alias("actual_pct"), F.col("share_pct").cast("double").alias("target_pct"),
        F.when((F.col("total") >= 20) & off, text).alias("warning"))
    overall = stats.where("dim = 'total' AND key = 'pairs'").withColumn("v", validated).select(
        F.lit("total").alias("kind"), F.lit("pairs").alias("key"), F.lit(100.0).alias("actual_pct"), F.lit(100.0).alias("target_pct"),
        F.when((F.col("n") >= 80) & (F.col("v") < MIN_VALIDATED), F.concat(
            F.lit("Validated pairs: "), F.col("v").cast("string"), F.lit(f" of the {MIN_VALIDATED} recommended for production")))
        .when(F.col("n") < 80, F.concat(F.lit("Sample size n="), F.col("n").cast("string"), F.lit(": indicative only"))).alias("warning"))
    return shares.unionByName(overall.where("n > 0"))


def merge_pairs(old: DataFrame | None, new: DataFrame, append: bool = True) -> DataFrame:
    """Appended pairs, or the new ones alone."""
    return new if old is None or not append else old.unionByName(new)


def eval_pairs(pairs: DataFrame, validated_only: bool = True) -> DataFrame:
    """Validated pairs if there are any, else all; none at all is an error."""
    if pairs.isEmpty():
        raise ValueError("no benchmark pairs available")
    if not validated_only:
        return pairs
    some = pairs.agg(F.bool_or("validated")).scalar()
    return pairs.where(F.col("validated") | ~some)


def matches_gold(chunk_id: Column, doc: Column, section: Column, gold_id: Column, gold_doc: Column, gold_section: Column) -> Column:
    """Same chunk; else same document and, where the gold section is known, same section."""
    gid = strip(or_blank(gold_id.cast("string")))
    same = (gid != "") & (strip(or_blank(chunk_id.cast("string"))) == gid)
    gold = norm_section(gold_section)
    return same | ((or_blank(doc) == or_blank(gold_doc)) & ((gold == "") | (norm_section(section) == gold)))


def match_gold(answers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Retrieved rows with ``hit``."""
    gold = pairs.select("pair_id", F.col("gold_chunk_id").alias("_id"), F.col("source_doc").alias("_doc"), F.col("source_section").alias("_sec"))
    return answers.join(gold, "pair_id").withColumn("hit", matches_gold(
        F.col("chunk_id"), F.col("source_doc"), F.col("source_section"), F.col("_id"), F.col("_doc"), F.col("_sec"))).drop("_id", "_doc", "_sec")


def hit_ranks(answers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair: rank of the first hit, hits within 1, 3 and 5, reciprocal rank.

    ``failed`` pairs (retrieval error) keep a row without a result.
    """
    first = match_gold(answers, pairs).groupBy("pair_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("hit_rank"))
    rows = pairs.select("pair_id", "doc_type", "difficulty", "failed").join(first, "pair_id", "left")
    rank = F.col("hit_rank")
    return rows.select("*", *[F.coalesce((rank <= k).cast("int"), F.lit(0)).alias(f"h{k}") for k in (1, 3, 5)],
                       F.coalesce(F.lit(1.0) / rank, F.lit(0.0)).alias("rr"))


def eval_counters(ranks: DataFrame) -> DataFrame:
    """Long counters (dim, grp, n, h1, h3, h5, mrr_sum). Failed pairs count in the overall
    number only."""
    rows = ranks.select(F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"), F.coalesce("difficulty", F.lit("L1")).alias("difficulty"),
                        "failed", "h1", "h3", "h5", "rr")
    ok = (~F.col("failed")).cast("int")
    sets = rows.groupingSets([["doc_type"], ["difficulty"], []], "doc_type", "difficulty").agg(
        F.grouping_id().alias("g"), F.count("*").alias("all_n"), F.sum(ok).alias("ok_n"),
        *[F.sum(F.col(h) * ok).alias(h) for h in ("h1", "h3", "h5")], F.sum(F.col("rr") * ok).alias("mrr_sum"))
    named = sets.select(
        F.when(F.col("g") == 1, "doc_type").when(F.col("g") == 2, "difficulty").otherwise("overall").alias("dim"),
        F.when(F.col("g") == 1, F.col("doc_type")).when(F.col("g") == 2, F.col("difficulty")).otherwise("all").alias("grp"),
        F.when(F.col("g") == 3, F.col("all_n")).otherwise(F.col("ok_n")).alias("n"), "h1", "h3", "h5", "mrr_sum")
    return named.where((F.col("n") > 0) | (F.col("dim") == "overall"))


def with_rates(counters: DataFrame) -> DataFrame:
    def rate(c: str) -> Column:
        return F.bround(F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0), 4)

    return counters.select("dim", "grp", "n", "h1", "h3", "h5", F.bround("mrr_sum", 4).alias("mrr_sum"),
                           rate("h1").alias("hr_at_1"), rate("h3").alias("hr_at_3"), rate("h5").alias("hr_at_5"), rate("mrr_sum").alias("mrr"))


def eval_summary(ranks: DataFrame) -> DataFrame:
    """Hit rates and mean reciprocal rank overall, per document type and per difficulty."""
    return with_rates(eval_counters(ranks))


def merge_partials(batches: DataFrame) -> DataFrame:
    """Rates over the counters of several evaluation batches."""
    return with_rates(batches.groupBy("dim", "grp").agg(
        F.sum("n").alias("n"), *[F.sum(h).alias(h) for h in ("h1", "h3", "h5")], F.sum("mrr_sum").alias("mrr_sum")))


def spec_compliance(summary: DataFrame, floors: DataFrame) -> DataFrame:
    """Groups against their least hit rate at 3, and the verdict as row (overall, all)."""
    rows = floors.join(summary.select("dim", "grp", "n", "hr_at_3"), ["dim", "grp"], "left")
    graded = rows.select(
        "dim", "grp", "min_hr3", F.when(F.col("n") > 0, F.col("hr_at_3")).alias("actual_hr3"), F.when(F.col("n") > 0, F.col("hr_at_3") >= F.col("min_hr3")).alias("pass"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.when(F.coalesce("n", F.lit(0)) == 0, F.when(F.col("dim") == "difficulty", "no_L3_pairs").otherwise("no_pairs")).alias("skipped"))
    all_pass = graded.agg(F.coalesce(F.bool_and("pass"), F.lit(True))).scalar()
    verdict = summary.where("dim = 'overall'").select(
        "dim", "grp", F.lit(MIN_HR3_OVERALL).alias("min_hr3"), F.col("hr_at_3").alias("actual_hr3"),
        ((F.col("h3") / F.greatest("n", F.lit(1)) >= MIN_HR3_OVERALL) & all_pass).alias("pass"), "n", F.lit(None).cast("string").alias("skipped"))
    return graded.unionByName(verdict)


def retrieval_analysis(pairs: DataFrame, answers: DataFrame, misses_only: bool = False, limit: int = 100, offset: int = 0,
                       order: str = "pair_id", retrieved_chars: int | None = None, answer_chars: int | None = None,
                       chunk_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row per question of the page, its summary): gold block, ranked rows, hit rank.
    Texts are whole unless the caller gives a number of characters.

    ``retrieved`` holds the answers asked for, a bounded list. The page is cut by a top-k
    before anything is joined.
    """
    total = pairs.agg(F.count("*")).scalar()
    page = pairs.orderBy(order).offset(offset).limit(limit)
    numbered = page.withColumn("pair_index", F.row_number().over(Window.orderBy(order)) - 1 + offset)
    rows = match_gold(answers.join(numbered.select("pair_id"), "pair_id", "left_semi"), numbered)
    got = rows.groupBy("pair_id").agg(
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("hit_rank"),
        F.sort_array(F.collect_list(F.struct(
            "rank", "chunk_id", "source_doc", "source_section", F.bround("score", 4).alias("score"), F.col("hit").alias("matches_gold"),
            preview(F.col("text"), retrieved_chars, flatten=True).alias("text_preview")))).alias("retrieved"))
    items = numbered.join(got, "pair_id", "left").select(
        "pair_index", "pair_id", "question", "gold_chunk_id", "source_doc", "source_section", "doc_type", "difficulty",
        preview(F.col("answer"), answer_chars).alias("expected_answer"), preview(F.col("chunk_text_preview"), chunk_chars).alias("chunk_preview"),
        F.col("failed").alias("error"), F.col("hit_rank").isNotNull().alias("hit"), "hit_rank",
        F.bround(F.coalesce(F.lit(1.0) / F.col("hit_rank"), F.lit(0.0)), 4).alias("mrr"), "retrieved")
    n = F.count("*")
    summary = items.agg(
        n.alias("n_queries"), F.count_if("error").alias("n_errors"), F.count_if(F.col("hit") & ~F.col("error")).alias("hits_at_k"),
        F.bround(F.coalesce(F.count_if(F.col("hit") & ~F.col("error")) / n, F.lit(0.0)), 4).alias("hr_at_k"),
        (F.count_if(~F.col("hit")) if misses_only else n).alias("n_items_returned")).withColumn("total_pairs", total).select(
        "*", (F.col("n_queries") + offset).alias("next_offset"), (F.col("n_queries") + offset < F.col("total_pairs")).alias("has_more"))
    return (items.where(~F.col("hit")) if misses_only else items), summary


def slice_pairs(lines: DataFrame, schema: str, offset: int, limit: int) -> DataFrame:
    """Page of a pair file: (line_index, object, total). Lines that do not parse are left out
    but keep their number and count in the total."""
    full = lines.where(strip(or_blank(F.col("line"))) != "")
    total = full.agg(F.count("*")).scalar()
    page = full.orderBy("line_no").offset(offset).limit(limit)
    return (page.withColumn("line_index", F.row_number().over(Window.orderBy("line_no")) - 1 + offset)
            .withColumn("o", replies.parse_object(F.col("line"), schema)).where("o IS NOT NULL")
            .select("line_index", "o.*", total.alias("total")).drop("_broken"))


def doc_accuracy(answers: DataFrame, expectations: DataFrame) -> DataFrame:
    """Share of questions whose first, or one of the first three documents is the expected one
    or an accepted alternative. ``expectations``: query_id, expected, alternatives."""
    rows = answers.where(F.col("rank") <= 3).join(expectations, "query_id")
    doc = F.lower(or_blank(F.col("source_doc")))
    primary = (doc != "") & F.contains(doc, F.lower("expected"))
    relevant = primary | ((doc != "") & F.exists("alternatives", lambda a: F.contains(doc, F.lower(a))))
    top = F.col("rank") == 1
    per = rows.groupBy("query_id").agg(*[F.max(c.cast("int")).alias(n) for n, c in (
        ("top1_primary", primary & top), ("top1_relevant", relevant & top), ("top3_primary", primary), ("top3_relevant", relevant))])
    every = expectations.select("query_id").join(per, "query_id", "left")
    names = ("top1_primary", "top1_relevant", "top3_primary", "top3_relevant")
    return every.agg(F.count("*").alias("questions"), *[F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in names],
                     *[F.bround(F.avg(F.coalesce(n, F.lit(0))), 4).alias(f"{n}_rate") for n in names])


def gold_config(summary: DataFrame, compliance: DataFrame, config_name: str, has_more: bool) -> DataFrame | None:
    """Report rows of a complete run; a batch of a longer one is not reported."""
    if has_more:
        return None
    metrics = summary.where("n > 0").select(F.lit(config_name).alias("config_name"), F.lit("metrics").alias("part"), "dim", "grp",
                                            F.expr("stack(4, 'hr_at_1', hr_at_1, 'hr_at_3', hr_at_3, 'hr_at_5', hr_at_5, 'mrr', mrr)").alias("key", "value"))
    checks = compliance.select(F.lit(config_name).alias("config_name"), F.lit("compliance").alias("part"), "dim", "grp",
                               F.lit("pass").alias("key"), F.col("pass").cast("int").cast("double").alias("value"))
    return metrics.unionByName(checks)
