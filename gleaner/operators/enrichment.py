"""Glossary resolution and query enrichment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.dims import GLOBAL_TENANT
from gleaner.functions import replies
from gleaner.functions.text import normalize_text, or_blank, strip
from gleaner.operators.cells import cosines
from gleaner.operators.sequence import carry_last
from gleaner.session import spread

# Least question length, enrichment length, correction guards, cache rules.
MIN_QUERY = 2
MAX_LOST_SHARE = 0.4
MAX_GROWTH = 60
CACHE_TTL_S = 86400
CACHE_NEWEST = 256
CACHE_SIMILARITY = 0.97


def _scoped(glossary: DataFrame) -> DataFrame:
    """Enabled entries, one per (tenant, normalised term): the last in (term, id) order, placed
    where the first one stood."""
    rows = glossary.where(F.col("enabled")).withColumn("key", normalize_text(F.col("term")))
    at = F.struct("term", "id")
    return (rows.groupBy("tenant_id", "key")
            .agg(F.max_by(F.struct("id", "term", "aliases", "expansion", "enabled", "updated_at"), at).alias("e"), F.min(at).alias("first"))
            .select("tenant_id", "key", "e.*", "first"))


def effective_glossary(glossary: DataFrame, tenant_id: str | None) -> DataFrame:
    """Entries in force for a tenant: its own replace the global ones of the same term.
    Without a tenant every row is listed, disabled ones too."""
    if tenant_id is None:
        return glossary.withColumn("key", normalize_text(F.col("term")))
    scoped = _scoped(glossary.where(F.col("tenant_id").isin(GLOBAL_TENANT, tenant_id)))
    own = F.col("tenant_id") == tenant_id
    top = scoped.groupBy("key").agg(
        F.max_by(F.struct("tenant_id", "id", "term", "aliases", "expansion", "enabled", "updated_at"), own).alias("e"))
    return top.select("key", "e.*")


FILTER_BITS = 2**20  # bits of the alias filter: 128 KB, whatever the glossary's size


def _alias_filter(aliases: DataFrame) -> Column:
    """Bloom filter of all aliases and of their first words, as an array of 64-bit words.

    Tasks set bits in partial aggregates; the merged filter has a fixed size and becomes a
    constant of the plan. A text that passes it by chance is settled by the join."""
    marks = aliases.select(F.explode(F.array(F.xxhash64(F.split("alias", " ")[0]), F.xxhash64("alias"))).alias("h"))
    bit = F.pmod("h", F.lit(FILTER_BITS))
    words = marks.select(F.floor(bit / 64).alias("no"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(bit, F.lit(64)).cast("int")).alias("mask"))
    merged = {r.no: r.mask for r in words.groupBy("no").agg(F.bit_or("mask").alias("mask")).collect()}  # 16,384 at most
    return F.split(F.lit(",".join(str(merged.get(no, 0)) for no in range(FILTER_BITS // 64))), ",").cast("array<bigint>")


def _passes(bits: Column, text: Column) -> Column:
    bit = F.pmod(F.xxhash64(text), F.lit(FILTER_BITS))
    return text.isNotNull() & (F.getbit(F.get(bits, F.floor(bit / 64).cast("int")), F.pmod(bit, F.lit(64)).cast("int")) == 1)


def _starts(words: Column, bits: Column) -> Column:
    """Positions of words that some alias begins with, as far as the filter can tell."""
    return F.array_compact(F.transform(words, lambda w, i: F.when(_passes(bits, w), i)))


def _ngrams(words: Column, starts: Column, lengths: list[int], bits: Column) -> Column:
    """Distinct runs of the given numbers of words from ``starts`` on that pass the filter."""
    def runs(n: int) -> Column:
        # Words are taken by position; slicing per position would copy the text each time.
        every = F.transform(starts, lambda i: F.concat(F.get(words, i), *[x for k in range(1, n) for x in (F.lit(" "), F.get(words, i + k))]))
        return F.filter(every, lambda run: _passes(bits, run))

    return F.array_distinct(F.concat(*[runs(n) for n in lengths]))


def _entry_aliases(entries: DataFrame) -> DataFrame:
    """Entries once per normalised alias; the term is an alias of itself."""
    names = F.array_distinct(F.transform(F.array_append("aliases", F.col("term")), normalize_text))
    return entries.select("*", F.explode_outer(names).alias("alias")).where("alias <> ''")


BROADCAST_ALIASES = 500_000  # aliases sent to every task at most
BROADCAST_CHARS = 50_000_000


def _measured(aliases: DataFrame) -> tuple[DataFrame, list[int]]:
    """The aliases, marked for broadcast if their measured size allows it, and their lengths
    in words. Larger glossaries are joined by shuffling."""
    size = aliases.agg(F.count("*").alias("n"), F.sum(F.length("alias") + F.length("term") + F.length("expansion") + 64).alias("chars"),
                       F.collect_set(F.size(F.split("alias", " "))).alias("lengths")).first()
    small = size.n <= BROADCAST_ALIASES and (size.chars or 0) <= BROADCAST_CHARS
    return (F.broadcast(aliases) if small else aliases), sorted(size.lengths) or [1]


def match_glossary(queries: DataFrame, glossary: DataFrame) -> DataFrame:
    """Entries whose alias or term occurs in a question as whole words, in entry order:
    (query_id, tenant_id, id, key, term, expansion, place).

    The word runs of a question meet aliases in a hash join, instead of testing every alias
    on every question. Runs become rows only if a filter of the aliases lets them through,
    first by their first word, so that rows are about as many as hits. A tenant's entry hides the global one of its term, matched or not.
    """
    scoped = _scoped(glossary)
    everyone = scoped.where(F.col("tenant_id") == GLOBAL_TENANT)
    own = scoped.where(F.col("tenant_id") != GLOBAL_TENANT)
    places = own.join(everyone.select("key", F.col("first").alias("_g")), "key", "left").select(
        *own.columns, F.struct(F.col("_g").isNull().alias("own"), F.coalesce("_g", "first").alias("at")).alias("place"))
    all_entries = places.unionByName(everyone.withColumn("place", F.struct(F.lit(False).alias("own"), F.col("first").alias("at"))))
    aliases, lengths = _measured(_entry_aliases(all_entries).select("tenant_id", "alias", "id", "key", "term", "expansion", "place"))
    scopes = F.when(F.coalesce("tenant_id", F.lit(GLOBAL_TENANT)) == GLOBAL_TENANT, F.array(F.lit(GLOBAL_TENANT))).otherwise(
        F.array(F.lit(GLOBAL_TENANT), F.col("tenant_id")))
    bits = _alias_filter(aliases)
    runs = (spread(queries, "query_id").withColumn("_w", F.split(normalize_text(F.col("question")), " "))
            .withColumn("_at", _starts(F.col("_w"), bits))
            .select("query_id", F.col("tenant_id").alias("_t"), F.explode_outer(_ngrams(F.col("_w"), F.col("_at"), lengths, bits)).alias("alias"), scopes.alias("_s"))
            .where("alias IS NOT NULL").select("query_id", "_t", "alias", F.explode("_s").alias("tenant_id")))
    hits = (runs.join(aliases, ["tenant_id", "alias"])
            .select("query_id", F.col("_t").alias("asked_by"), "tenant_id", "id", "key", "term", "expansion", "place").distinct())
    hidden = own.select(F.col("tenant_id").alias("asked_by"), "key", F.lit(GLOBAL_TENANT).alias("tenant_id"))
    return hits.join(hidden, ["asked_by", "key", "tenant_id"], "left_anti")


def matched_lists(hits: DataFrame) -> DataFrame:
    """Per question: distinct terms and all expansions in entry order (bounded by its matches)."""
    rows = F.sort_array(F.collect_list(F.struct("place", "term", "expansion")))
    return (hits.groupBy("query_id").agg(rows.alias("m")).select(
        "query_id",
        F.array_remove(F.array_distinct(F.transform("m", lambda x: strip(x["term"]))), "").alias("matched_terms"),
        F.filter(F.transform("m", lambda x: strip(x["expansion"])), lambda x: x != "").alias("expansions")))


def with_retrieval_text(rows: DataFrame, corrected: str = "corrected", most: int | None = None) -> DataFrame:
    """Adds ``retrieval_query``: the corrected question followed by those ``matched_terms`` and
    ``expansions`` it does not contain yet. ``most`` cuts what is added to so many characters, if given.

    Steps are columns of their own, so that the question is normalised once, not per term.
    """
    names = rows.columns
    plain = rows.select("*", strip(F.col(corrected)).alias("_base"), normalize_text(F.col(corrected)).alias("_plain"), F.transform(
        F.concat("matched_terms", "expansions"), lambda t: F.struct(strip(t).alias("t"), normalize_text(t).alias("k"))).alias("_w"))
    fresh = plain.withColumn("_w", F.filter("_w", lambda x: ~F.contains(F.col("_plain"), x["k"])))
    keyed = fresh.withColumn("_k", F.transform("_w", lambda x: x["k"]))
    first = F.filter("_w", lambda x, i: F.array_position("_k", x["k"]) == i + 1)
    joined = keyed.withColumn("_extra", F.array_join(F.transform(first, lambda x: x["t"]), " "))
    extra = F.col("_extra")
    if most is not None:
        extra = F.when(F.length(extra) > most, F.regexp_replace(F.substring(extra, 1, most), r" [^ ]*$", "")).otherwise(extra)
    both = strip(F.concat_ws(" ", F.nullif("_base", F.lit("")), F.nullif(extra, F.lit(""))))
    return joined.select(*names, both.alias("retrieval_query"))


_EMPTY = "array<string>"


def preprocess_queries(queries: DataFrame, glossary: DataFrame, enabled: bool = True,
                       corrections: DataFrame | None = None) -> DataFrame:
    """Original, corrected and retrieval text with the matched terms and expansions.
    Questions shorter than two characters, or all when disabled, pass through."""
    asked = queries.withColumn("original", strip(or_blank(F.col("question"))))
    active = F.lit(enabled) & (F.length("original") >= MIN_QUERY)
    if enabled:
        lists = matched_lists(match_glossary(asked.where(F.length("original") >= MIN_QUERY), glossary))
        asked = asked.join(lists, "query_id", "left")
    else:
        asked = asked.withColumn("matched_terms", F.lit(None).cast(_EMPTY)).withColumn("expansions", F.lit(None).cast(_EMPTY))
    if corrections is not None:
        asked = asked.join(corrections.select("query_id", F.col("corrected").alias("_c"), F.col("extras").alias("_x"), "reason"), "query_id", "left")
    else:
        asked = asked.select("*", F.lit(None).cast("string").alias("_c"), F.lit(None).cast(_EMPTY).alias("_x"), F.lit(None).cast("string").alias("reason"))
    none = F.array().cast(_EMPTY)
    used = active & ((F.col("_c").isNotNull() & (F.col("_c") != F.col("original"))) | (F.coalesce(F.size("_x"), F.lit(0)) > 0))
    shaped = asked.select(
        *[c for c in queries.columns if c != "question"], "original",
        F.when(active, F.coalesce("_c", "original")).otherwise(F.col("original")).alias("corrected"),
        F.coalesce("matched_terms", none).alias("matched_terms"),
        F.when(active, F.concat(F.coalesce("expansions", none), F.coalesce("_x", none))).otherwise(none).alias("expansions"),
        F.coalesce(used, F.lit(False)).alias("ai_used"), "reason")
    return with_retrieval_text(shaped).withColumn(
        "retrieval_query", F.when(F.col("retrieval_query") == "", F.col("original")).otherwise(F.col("retrieval_query")))


def over_corrected(original: Column, corrected: Column) -> Column:
    """Too many of the original words gone, or much longer."""
    before = F.array_remove(F.array_distinct(F.split(normalize_text(original), " ")), "")
    after = F.split(normalize_text(corrected), " ")
    lost = F.when(F.size(before) > 0, F.size(F.array_except(before, after)) / F.size(before)).otherwise(0.0)
    n = F.length(original)
    return (F.size(before) > 0) & ((lost > MAX_LOST_SHARE) | (F.length(corrected) > F.greatest(n * 2, n + MAX_GROWTH)))


def apply_corrections(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, corrected, extras, reason) from the replies of an external corrector.
    A refused reply leaves both empty and says why."""
    rows = queries.select("query_id", strip(or_blank(F.col("question"))).alias("original")).join(answers, "query_id")
    rows = rows.withColumn("o", replies.parse_object(
        replies.json_object(F.col("reply")), "corrected string, expansions array<string>, ambiguous boolean"))
    empty = F.col("o").isNull() | F.col("reply").rlike(r"\{\s*\}")
    proposed = F.nullif(strip(or_blank(F.col("o.corrected"))), F.lit(""))
    reason = (F.when(empty, "ai_parse_error").when(F.coalesce("o.ambiguous", F.lit(False)), "ambiguous")
              .when(proposed.isNotNull() & over_corrected(F.col("original"), proposed), "over_correction"))
    extras = F.filter(F.transform(F.coalesce("o.expansions", F.array().cast(_EMPTY)), lambda x: strip(or_blank(x))), lambda x: x != "")
    return (rows.withColumn("reason", reason).select(
        "query_id", "reason", F.when(F.col("reason").isNull(), proposed).alias("corrected"),
        F.when(F.col("reason").isNull(), extras).otherwise(F.array().cast(_EMPTY)).alias("extras")))


def glossary_fingerprint(glossary: DataFrame) -> DataFrame:
    """(tenant_id, fingerprint) for every tenant with entries and the global set.

    Any change of the effective set changes it, the order of entries does not: entry hashes
    are summed. A tenant's set is the global sum, less what it hides, plus its own, so the
    global entries are neither repeated per tenant nor gathered anywhere.
    """
    text = F.concat_ws("\x1f", strip(F.col("term")), F.array_join(F.array_sort(F.transform("aliases", lambda a: strip(a))), "\x1e"),
                       strip(or_blank(F.col("expansion"))), F.col("enabled").cast("int").cast("string"), "updated_at")
    digest = F.md5(text)
    rows = _scoped(glossary).select(
        "tenant_id", "key",
        F.conv(F.substring(digest, 1, 12), 16, 10).cast("decimal(38,0)").alias("a"),
        F.conv(F.substring(digest, 13, 12), 16, 10).cast("decimal(38,0)").alias("b"))
    shared = rows.where(F.col("tenant_id") == GLOBAL_TENANT)
    own = rows.where(F.col("tenant_id") != GLOBAL_TENANT)
    hidden = own.join(shared.select("key", F.col("a").alias("ha"), F.col("b").alias("hb")), "key", "left")
    total = shared.agg(F.struct(F.count("*").alias("n"), F.coalesce(F.sum("a"), F.lit(0)).cast("decimal(38,0)").alias("a"),
                                F.coalesce(F.sum("b"), F.lit(0)).cast("decimal(38,0)").alias("b")).alias("t")).scalar()
    zero = F.lit(0).cast("decimal(38,0)")
    per = hidden.groupBy("tenant_id").agg(
        (F.count("*") - F.count("ha")).alias("n"), F.sum(F.col("a") - F.coalesce("ha", zero)).alias("a"), F.sum(F.col("b") - F.coalesce("hb", zero)).alias("b"))
    base = shared.groupBy("tenant_id").agg(F.lit(0).cast("bigint").alias("n"), F.max(zero).alias("a"), F.max(zero).alias("b"))
    sums = per.unionByName(base).select(
        "tenant_id", *[(F.col(c) + total[c]).cast("decimal(38,0)").cast("string").alias(c) for c in ("n", "a", "b")])
    return sums.select("tenant_id", F.substring(F.sha2(F.concat_ws(":", "n", "a", "b"), 256), 1, 16).alias("fingerprint"))


def query_fingerprint(preprocessed: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Short hash of question, retrieval text, glossary state and corrector use."""
    shared = fingerprints.where(F.col("tenant_id") == GLOBAL_TENANT).select("fingerprint").limit(1).scalar()
    own = fingerprints.select("tenant_id", F.col("fingerprint").alias("_f"))
    raw = F.concat_ws("||", "original", "retrieval_query", F.coalesce("_f", shared, F.lit("")), F.col("ai_used").cast("int").cast("string"))
    return preprocessed.join(own, "tenant_id", "left").select("query_id", F.substring(F.sha2(raw, 256), 1, 16).alias("fingerprint"))


def glossary_usage(docs: DataFrame, glossary: DataFrame) -> DataFrame:
    """Documents per global glossary term."""
    asked = docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"), F.lit(None).cast("string").alias("tenant_id"))
    hits = match_glossary(asked, glossary.where(F.col("tenant_id") == GLOBAL_TENANT))
    return hits.groupBy("id", "term").agg(F.count("*").alias("docs"))


# --- answer cache -------------------------------------------------------------

def cache_key(question: Column, tenant_id: Column, generate: Column, reranker: Column, model: Column) -> Column:
    """Hash of the question with its options and the tenant."""
    parts = F.concat_ws(":", F.when(generate, "gen"), F.concat(F.lit("rr:"), F.nullif(reranker, F.lit(""))),
                        F.concat(F.lit("gm:"), F.nullif(model, F.lit(""))))
    suffix = F.when(parts == "", "").otherwise(F.concat(F.lit(":"), parts))
    return F.sha2(F.concat(F.lower(strip(F.concat(question, suffix))), F.lit(":"), tenant_id), 256)


def cache_lookup_exact(queries: DataFrame, cache: DataFrame, ttl_s: int = CACHE_TTL_S) -> DataFrame:
    """Newest stored answer of the same key that had not expired at ``asked_at`` (seconds).

    Questions and stored answers of a key are merged in time order and the last answer is
    carried forward, slot by slot; a popular question is never joined with all its answers.
    """
    answer = F.struct("stored_at", "answer_id")
    stored = cache.select("cache_key", F.col("stored_at").alias("_at"), F.lit(0).alias("_asks"), F.col("answer_id").alias("_no"), answer.alias("_stored"),
                          F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), F.lit(None).cast(queries.schema["asked_at"].dataType).alias("asked_at"))
    asked = queries.select("cache_key", F.col("asked_at").alias("_at"), F.lit(1).alias("_asks"), F.lit(None).cast(cache.schema["answer_id"].dataType).alias("_no"),
                           F.lit(None).cast(stored.schema["_stored"].dataType).alias("_stored"), "query_id", "asked_at")
    merged = stored.unionByName(asked).withColumn("_slot", F.floor(F.col("_at") / ttl_s))
    carried = carry_last(merged, ["cache_key"], "_slot", ["_at", "_asks", "_no"], "_stored", "_last").where("_asks = 1")
    fresh = F.col("asked_at") - F.col("_last.stored_at") < ttl_s
    return carried.select("query_id", "cache_key", "asked_at", F.when(fresh, F.col("_last.answer_id")).alias("answer_id")).withColumn(
        "cache_hit", F.col("answer_id").isNotNull())


GROUP_ROWS = 4096  # questions compared in one group


def cache_lookup_semantic(queries: DataFrame, cache: DataFrame, newest: int = CACHE_NEWEST,
                          similarity: float = CACHE_SIMILARITY) -> DataFrame:
    """Newest of a tenant's last stored questions similar enough to the one asked.

    A tenant's list is bounded (``newest``). A tenant's questions are cut into groups of
    bounded size, each of which meets a copy of the list as one matrix product.
    """
    w = Window.partitionBy("tenant_id").orderBy(F.desc("stored_at"), F.desc("entry_id"))
    lists = cache.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= newest).select("tenant_id", "_n", "entry_id", "embedding")
    groups = queries.groupBy("tenant_id").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("_groups"))
    asked = (queries.select("query_id", "tenant_id", "embedding").join(groups, "tenant_id")
             .withColumn("_g", F.pmod(F.xxhash64("query_id"), F.col("_groups"))))
    copies = groups.select("tenant_id", F.col("_groups").alias("_copies"))
    stored = lists.join(copies, "tenant_id").withColumn("_g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)))
    schema = ", ".join([f"query_id {queries.schema['query_id'].dataType.simpleString()}",
                        f"tenant_id {queries.schema['tenant_id'].dataType.simpleString()}",
                        f"entry_id {cache.schema['entry_id'].dataType.simpleString()}"])

    def newest_hit(q: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        out = q[["query_id", "tenant_id"]].copy()
        if q.empty or entries.empty:
            return out.assign(entry_id=None)
        entries = entries.sort_values("_n")
        near = cosines(q["embedding"], entries["embedding"]) >= similarity
        ids = entries["entry_id"].to_numpy(dtype=object)[near.argmax(axis=1)]
        out["entry_id"] = np.where(near.any(axis=1), ids, None)
        return out

    return asked.groupBy("tenant_id", "_g").cogroup(stored.groupBy("tenant_id", "_g")).applyInPandas(newest_hit, schema)
