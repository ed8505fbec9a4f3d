"""The registered queries of this subpackage and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import bpe, decontaminate, language_model, licenses, middle, ngram_join, privacy, quality, repeats, spots, token_file, toxicity, whitening
from gleaner.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


_WORDS = r"[x FOR x IN regexp_split_to_array({text}, '[\x20\x09-\x0D]+') IF x <> '']"
_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query("op1_ngram_join", f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format(text=_LOWER.format(text="coalesce(text, '')"))} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * m >= 90 * (na + nb - m)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON s.doc_id = c.a""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), 3, 90).select("doc_id", "n_shingles", "component_id")


@_query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("spans")


@_query("op3_spot_signatures")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.fingerprints(_table(spark, sf_dir, "documents"))


@_query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query("op5_repeated_phrases", f"""
WITH words AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35),
windows AS (SELECT s.doc_id, s.i, md5(array_to_string(w[s.i : s.i + 34], ' ')) AS h FROM starts s JOIN words USING (doc_id)),
recurring AS (SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM recurring) GROUP BY doc_id),
kept AS (SELECT doc_id, len(w) AS n, len(coalesce(gone, [])) AS g,
  array_to_string([w[j] FOR j IN range(1, len(w) + 1) IF NOT list_contains(coalesce(gone, []), j)], ' ') AS k
  FROM words LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(g AS BIGINT) AS n_removed, sha256(k) AS kept_sha256 FROM kept""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs, 35).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@_query("op6_rule_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op7_trie_score")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_held_out(_table(spark, sf_dir, "documents"), order=3, least=1)


@_query("op8_benchmark_passages")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op10_token_file")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-file")
    token_file.write(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    stored = token_file.read(spark, folder)
    return stored.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@_query("op11_disclosing_terms")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.report(privacy.find(_table(spark, sf_dir, "documents")))


@_query("op12_fill_middle", """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS p, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
u AS (SELECT *, len(p) - CASE WHEN p[len(p)] = '' THEN 1 ELSE 0 END AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
    WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
d AS (SELECT *, CASE WHEN low = 0 THEN '' ELSE array_to_string(p[1:low], chr(10)) || CASE WHEN low < len(p) THEN chr(10) ELSE '' END END AS a,
  CASE WHEN high = 0 THEN '' ELSE array_to_string(p[1:high], chr(10)) || CASE WHEN high < len(p) THEN chr(10) ELSE '' END END AS b FROM c),
e AS (SELECT *, substr(b, length(a) + 1) AS m, substr(t, length(b) + 1) AS s FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM e""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = middle.restore(middle.transform(_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


@_query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), 4)
