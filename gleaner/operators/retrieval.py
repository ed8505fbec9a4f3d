"""Tenant-aware retrieval and ranking, many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import blank_to_null, normalize_ascii, or_blank, title_of_path, tokens_of
from gleaner.operators import cells, word_search
from gleaner.operators.cells import DIGITS
from gleaner.session import cut_lineage, scratch_path, spread

# Candidates per question, answers, answers per document, title weight,
# step between ranks without a reranker, related documents, languages without a value.
CANDIDATES = 20
ANSWERS = 5
PER_DOC = 2
TITLE_BOOST = 0.06
PASSTHROUGH_STEP = 0.01
RELATED = 5
DEFAULT_LANG = "es"
RERANKERS = ("voyage", "cohere", "bge", "none")


def tenant_config(tenants: DataFrame, overlay: DataFrame | None = None) -> DataFrame:
    """Base profile overlaid field by field, with the numeric ``version`` in force."""
    cols = [c for c in tenants.columns if c != "tenant_id"]
    if overlay is not None:
        over = overlay.select("tenant_id", *[F.col(c).alias(f"_{c}") for c in cols])
        tenants = tenants.join(over, "tenant_id", "full").select(
            "tenant_id", *[F.coalesce(f"_{c}", c).alias(c) for c in cols])
    raw = F.coalesce(F.nullif("erp_version", F.lit("")), F.col("legacy_erp_version"))
    return tenants.withColumn("version", raw.try_cast("double"))


def changelog_visible(version: Column) -> Column:
    """Pure changelogs only for a known version within their range."""
    low, high = F.coalesce("version_min", F.lit(0.0)), F.col("version_max")
    inside = version.isNotNull() & (low <= version) & (high.isNull() | (version <= high))
    return (or_blank(F.col("doc_type")) != "changelog_pure") | F.coalesce(inside, F.lit(False))


def visible(modules: Column, version: Column, has_robot: Column, lang: Column) -> Column:
    """Whether a chunk row may be shown to the tenant the other columns describe."""
    module = F.coalesce("module_id", F.lit(""))
    contract = (F.coalesce(F.size(modules), F.lit(0)) <= 0) | (F.trim(module) == "") | F.array_contains(modules, module)
    in_version = version.isNull() | ((F.coalesce("version_min", F.lit(0.0)) <= version)
                                     & (F.col("version_max").isNull() | (F.col("version_max") >= version)))
    robot = F.coalesce(has_robot, F.lit(False)) | ~F.coalesce("is_robot_doc", F.lit(False))
    spoken = blank_to_null(lang)
    in_lang = spoken.isNull() | (F.coalesce(F.nullif("lang", F.lit("")), F.lit(DEFAULT_LANG)) == spoken)
    return contract & in_version & robot & in_lang & changelog_visible(version)


def profiles(config: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(tenant_id, _lang, profile, modules, version, has_robot, lang): one row a tenant, or one for each
    tenant and language that ask. Equal settings share the number ``profile``."""
    if queries is None:
        rows = config.withColumn("lang", F.col("preferred_lang")).withColumn("_lang", F.lit(None).cast("string"))
    else:
        asked = queries.select("tenant_id", _asked_lang(queries).alias("_lang")).distinct()
        rows = asked.join(config, "tenant_id", "left").withColumn("lang", F.coalesce("_lang", "preferred_lang"))
    settings = [F.array_sort(F.array_distinct(F.coalesce("modules", F.array().cast("array<string>")))), F.col("version"),
                F.coalesce("has_robot", F.lit(False)), blank_to_null(F.col("lang"))]
    return rows.select("tenant_id", "_lang", _number(*settings).alias("profile"), "modules", "version", "has_robot", "lang")


def _asked_lang(queries: DataFrame) -> Column:
    return blank_to_null(F.col("lang")) if "lang" in queries.columns else F.lit(None).cast("string")


def _number(*columns: Column) -> Column:
    """One number for equal values; a null differs from every value."""
    return F.xxhash64(*[x for c in columns for x in (c.isNull(), c)])


_RULED = ("module_id", "version_min", "version_max", "is_robot_doc", "lang", "doc_type")


def visibility(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """(signature, profile) of every chunk signature, which is all that the rules read of a chunk, and
    every profile that may see it.

    Signatures and profiles meet by module: a profile without modules under one key, others under each
    of their modules and the key of chunks without one, so a pair meets once at most.
    """
    keyed = chunks.select(*_RULED).distinct().withColumn("signature", _number(*[F.col(c) for c in _RULED]))
    module = F.coalesce("module_id", F.lit(""))
    keys = F.array(F.lit("open"), F.when(F.trim(module) == "", F.lit("blank")).otherwise(F.concat(F.lit("m:"), module)))
    keyed = keyed.select("signature", *_RULED, F.explode(keys).alias("_key"))
    named = F.transform(F.array_distinct(F.filter("modules", lambda m: m.isNotNull() & (F.trim(m) != ""))), lambda m: F.concat(F.lit("m:"), m))
    keys = F.when(F.coalesce(F.size("modules"), F.lit(0)) <= 0, F.array(F.lit("open"))).otherwise(F.concat(F.array(F.lit("blank")), named))
    rules = (asked.dropDuplicates(["profile"])
             .select("profile", F.col("modules").alias("_modules"), F.col("version").alias("_version"), F.col("has_robot").alias("_robot"),
                     F.col("lang").alias("_spoken"), keys.alias("_keys"))
             .withColumn("_key", F.explode("_keys")).drop("_keys"))
    seen = visible(F.col("_modules"), F.col("_version"), F.col("_robot"), F.col("_spoken"))
    return keyed.join(rules, "_key").where(seen).select("signature", "profile")


def visible_chunks(chunks: DataFrame, config: DataFrame) -> DataFrame:
    """(tenant_id, chunk row) for every chunk a tenant may see.

    The rules are evaluated once for each signature of chunks and profile of tenants; chunks pass once
    and meet the tenants of the profiles that see them.
    """
    asked = profiles(config)
    pairs = visibility(chunks, asked).join(asked.select("profile", "tenant_id"), "profile").select("signature", F.col("tenant_id").alias("_tenant"))
    rows = chunks.select(*chunks.columns, _number(*[F.col(c) for c in _RULED]).alias("signature"))
    return rows.join(pairs, "signature").select(F.col("_tenant").alias("tenant_id"), *chunks.columns)


def _merge_top_k(partial: DataFrame, k: int, rank: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return partial.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def vector_top_k(queries: DataFrame, chunks: DataFrame, config: DataFrame, k: int = CANDIDATES,
                 score_threshold: float | None = None, carry: tuple[str, ...] = ("source_doc", "source_section"),
                 **sizes: int) -> DataFrame:
    """The ``k`` visible chunks nearest by cosine for every question, exact.

    Visibility, that of pure changelogs too, is decided before the search, for each signature of chunks.
    ``chunks`` carries ``embedding``; it is stored by cells (``cells.build``), and a question meets only
    those that may hold one of its best. Vectors without direction and those of another length than the
    question's score 0. ``sizes``: cell_rows, part_rows, probe_block of the index.
    """
    asked = profiles(config, queries)
    seen = visibility(chunks, asked).groupBy("signature").agg(F.collect_set("profile").alias("seen_by"))
    corpus = (chunks.select("chunk_id", *carry, F.col("embedding").alias("vector"), _number(*[F.col(c) for c in _RULED]).alias("signature"))
              .join(seen, "signature").drop("signature"))
    probes = (queries.select("query_id", F.col("embedding").alias("vector"), F.col("tenant_id").alias("_tenant"), _asked_lang(queries).alias("_asked"))
              .join(asked.select("tenant_id", "_lang", "profile"), F.col("tenant_id").eqNullSafe(F.col("_tenant")) & F.col("_lang").eqNullSafe(F.col("_asked")))
              .select("query_id", "vector", "profile"))
    index = cells.build(corpus, "chunk_id", "vectors", **{c: n for c, n in sizes.items() if c != "probe_block"})
    found = cells.nearest(index, probes, k, "chunk_id", "query_id", list(carry), score_threshold, sizes.get("probe_block", cells.PROBE_BLOCK))
    return _merge_top_k(found, k, "vector_rank")


def rank_passthrough(cands: DataFrame) -> DataFrame:
    """Scores in vector order when no reranker is configured."""
    return cands.withColumn("rerank_score", F.lit(1.0) - PASSTHROUGH_STEP * (F.col("vector_rank") - 1))


def apply_rerank_scores(cands: DataFrame, scores: DataFrame, source: str) -> DataFrame:
    """All candidates with the relevance an external reranker gave them (table input)."""
    name = source.strip().lower()
    if name not in RERANKERS:
        raise ValueError(f"reranker must be one of {sorted(RERANKERS)}")
    if name == "none":
        return rank_passthrough(cands)
    return cands.join(scores.select("query_id", "chunk_id", F.col("relevance").alias("rerank_score")),
                      ["query_id", "chunk_id"])


def title_tokens(source_doc: Column) -> Column:
    words = F.split(normalize_ascii(title_of_path(or_blank(source_doc))), r"(?U)\s+")
    return F.array_remove(F.array_distinct(words), "")


def title_boost(cands: DataFrame, queries: DataFrame) -> DataFrame:
    """Raise chunks whose document name shares words with the question."""
    asked = queries.select("query_id", F.array_distinct(F.split(normalize_ascii(or_blank(F.col("question"))), r"(?U)\s+")).alias("_q"))
    names = title_tokens(F.col("source_doc"))
    share = F.when(F.size(names) > 0, F.size(F.array_intersect("_q", names)) / F.size(names)).otherwise(0.0)
    return (cands.join(asked, "query_id")
            .withColumn("boosted_score", F.col("rerank_score") + TITLE_BOOST * share).drop("_q"))


def doc_diversity(cands: DataFrame, per_doc: int = PER_DOC, k: int = ANSWERS) -> DataFrame:
    """Best ``k`` per question with at most ``per_doc`` chunks of one document.

    Two ranks equal the greedy walk: a chunk counts iff fewer than ``per_doc`` of its
    document precede it. Input is bounded by the candidates per question.
    """
    best = [F.desc(F.round("boosted_score", DIGITS)), F.col("vector_rank")]
    by_doc = Window.partitionBy("query_id", or_blank(F.col("source_doc"))).orderBy(*best)
    by_query = Window.partitionBy("query_id").orderBy(*best)
    return (cands.withColumn("_d", F.row_number().over(by_doc)).where(F.col("_d") <= per_doc)
            .withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).drop("_d"))


def related_docs(cands: DataFrame, answers: DataFrame, n: int = RELATED) -> DataFrame:
    """First documents in vector order that the answer does not use, with the section of
    their first hit."""
    others = (cands.where(or_blank(F.col("source_doc")) != "")
              .join(answers.select("query_id", "source_doc").distinct(), ["query_id", "source_doc"], "left_anti"))
    first = others.groupBy("query_id", "source_doc").agg(
        F.min("vector_rank").alias("first_rank"), F.min_by(F.struct("source_section"), "vector_rank").alias("_s"))
    w = Window.partitionBy("query_id").orderBy("first_rank")
    return (first.withColumn("related_no", F.row_number().over(w)).where(F.col("related_no") <= n)
            .select("query_id", "related_no", "source_doc",
                    F.concat(F.lit("Sección: "), F.coalesce("_s.source_section", F.lit("N/A"))).alias("relevance")))


def retrieve(queries: DataFrame, chunks: DataFrame, config: DataFrame, scores: DataFrame | None = None,
             reranker: str = "none", k: int = ANSWERS) -> tuple[DataFrame, DataFrame]:
    """(ranked answer chunks, related documents) for every question.

    ``embedding`` of a question is that of its enriched text; its original ``question``
    drives the title boost. Questions without visible candidates have no rows.
    """
    cands = cut_lineage(vector_top_k(queries, chunks, config), "candidates")    # read by answers and related documents
    ranked = rank_passthrough(cands) if scores is None else apply_rerank_scores(cands, scores, reranker)
    answers = doc_diversity(title_boost(ranked, queries), k=k)
    return answers, related_docs(cands, answers)


# --- words instead of vectors -------------------------------------------------

WORDS_PER_PASS = 4_000_000   # (question, word) rows in an index
FLOOR_DOCS = 1_000           # documents that give the questions of a pass their floors; ten times as many of a large corpus


def lexical_top_k(queries: DataFrame, docs: DataFrame, k: int = CANDIDATES, passes: int | None = None) -> DataFrame:
    """The ``k`` documents with the greatest weighted share of a question's distinct words, weighted by inverse
    document frequency.

    Postings of frequent words would pair every question with most documents, so words are not joined: tasks store
    the questions' words as indexes in the shared folder, documents pass by an index, and only the best ``k`` per
    question leave a task. An index is bounded: more questions, in the order of their length, make more passes, which
    run one after the other. Neither questions nor words pass the driver. See :mod:`gleaner.operators.word_search`.
    """
    spark = docs.sparkSession
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    hashed = lambda c: F.transform(tokens_of(F.col(c)), lambda t: F.xxhash64(t)).alias("tokens")
    corpus = cut_lineage(spread(docs.select("doc_id", "text"), "doc_id").select("doc_id", hashed("text")), "document-words")
    asked = cut_lineage(queries.select("query_id", hashed("question")).groupBy("query_id").agg(F.flatten(F.collect_list("tokens")).alias("tokens")), "question-words")
    dealt = word_search.dealt_passes(asked, passes, WORDS_PER_PASS)
    if dealt is None:  # no questions, or none with words
        return _merge_top_k(spark.createDataFrame([], schema), k, "vector_rank")
    folder, n = scratch_path(spark, "word-search"), corpus.count()
    shards, words = word_search.number_words(asked, corpus, f"{folder}/words")
    corpus = cut_lineage(word_search.numbered(corpus, f"{folder}/words", shards), "numbered-words")
    sample = word_search.store_sample(corpus, n, FLOOR_DOCS, f"{folder}/sample")
    shared = spark.sparkContext.broadcast((f"{folder}/words", shards, words, n, sample))
    indexes = word_search.store_indexes(dealt, shared, f"{folder}/indexes", k)
    shared.destroy()
    written = []
    for index in indexes:
        shared = spark.sparkContext.broadcast((index, words))
        part = _merge_top_k(corpus.coalesce(spark.sparkContext.defaultParallelism * 4).mapInArrow(word_search.scan(shared, k), schema), k, "vector_rank")
        if len(indexes) == 1:
            return part
        written.append(f"{folder}/found/{len(written)}")
        part.write.parquet(written[-1])
        shared.destroy()
    return spark.read.schema(f"{schema}, vector_rank int").parquet(*written)
