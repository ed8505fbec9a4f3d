"""SpotSigs fingerprints: chains of content words behind common-word anchors.

An anchor is a very common word. Its signature is the chain of the next ``CHAIN`` content words that
stand ``STEP`` apart behind it, common words left out. The set of a text's signatures is its
fingerprint, written as sorted 32-bit hashes in base 64. Texts are alike by the Jaccard similarity
of their sets; sets whose sizes rule a similarity out are not intersected. ``near_documents`` finds all
texts that are alike: classes of equal sets, candidates from rare signatures within a partition of set
sizes and the next one, pruned Jaccard similarity, clusters of linked classes.

``edited`` pairs every document with the next one in descending doc_id order. Documents are dealt
by range once; within a partition the next row is at hand, and only the first and last row of each
partition are matched across partitions.

Defined cases: A-Z count as a-z; null is empty; a text without a complete chain has the hash of all its
words as its only signature, and none without words; equal texts have equal fingerprints; two texts
without signatures are alike (1), one without and one with are not (0); documents of equal doc_id are
ordered by text, null doc_ids come last; a single document is its own next one; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.ngram_join import connected
from gleaner.llm.pieces import clean_text
from gleaner.llm.rows import mapped
from gleaner.llm.words import hash_words, plain_bytes, word_bounds
from gleaner.session import cut_lineage

# Common words of four languages; those in ANCHORS start chains, none is a content word.
ANCHORS = ("the of and a to in is was that with for by on are this from der die das und ist ein eine den mit von zu im "
           "le la les de des et un une est dans pour que el los las del y en es una con por para").split()
COMMON = ("an it as at or be not which er sie es auf sich für dem nicht auch du au il elle ne pas ce se sur au aux qui ou avec "
          "su lo al como no si o más").split()
CHAIN, STEP = 2, 2
ROUNDING = 1e-9            # sizes and thresholds at an edge count as reaching it

_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _hashes(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        data = w.encode()
        out.append(hash_words(data, np.array([0]), np.array([len(data)]))[0])
    return np.unique(np.array(out, dtype=np.uint64))


class Spotter:
    """Signature sets of texts."""

    def __init__(self, chain: int = CHAIN, step: int = STEP) -> None:
        self.anchors, self.common = _hashes(ANCHORS), _hashes(ANCHORS + COMMON)
        self.chain, self.step = chain, step

    def signatures(self, text: str | None) -> np.ndarray:
        """Sorted distinct 32-bit signatures."""
        data = plain_bytes(text)
        words = hash_words(data, *word_bounds(data, _SEPARATOR))
        if len(words) == 0:
            return np.zeros(0, dtype=np.uint32)
        content = words[~np.isin(words, self.common)]
        # For each word: how many content words come before it.
        before = np.cumsum(~np.isin(words, self.common)) - ~np.isin(words, self.common)
        at = before[np.isin(words, self.anchors)]
        reach = (self.chain - 1) * self.step
        at = at[at + reach < len(content)]
        if len(at) == 0:
            whole = int.from_bytes(hashlib.sha256(words.tobytes()).digest()[:4], "little")
            return np.array([whole], dtype=np.uint32)
        sig = np.zeros(len(at), dtype=np.uint64)
        for i in range(self.chain):
            sig = sig * np.uint64(0x9E3779B97F4A7C15) + content[at + i * self.step]
        return np.unique((sig >> np.uint64(32)).astype(np.uint32))


def written(signatures: np.ndarray) -> str:
    return base64.b64encode(signatures.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity; 0 without intersecting if the sizes keep it below ``least``."""
    if len(a) == 0 and len(b) == 0:
        return 1.0
    small, large = sorted((len(a), len(b)))
    if small == 0 or small < least * large - ROUNDING:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def length_partition(n: int, least: float) -> int:
    """Sets that can be ``least`` alike are in the same or in neighbouring partitions of set sizes."""
    return int(np.floor(np.log(max(n, 1)) / np.log(1 / least) + ROUNDING))


def edited_text(text: str, following: str) -> str:
    """``text`` whose last half is replaced by the first code points of ``following``, as many or all."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGE = _OUT + ", edge int, part int, text string"


def _judged(spotter: Spotter, key, text: str, following: str, mine: np.ndarray, other: np.ndarray) -> tuple:
    new = edited_text(text, following)
    changed = spotter.signatures(new)
    return (key, len(text), hashlib.sha256(new.encode("utf-8")).hexdigest(), written(mine), written(changed),
            likeness(mine, changed), likeness(mine, other))


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=columns, dtype=object)
    return f.astype({c: t for c, t in (("doc_id", "Int64"), ("n_chars", "Int64"), ("near_edited", "float64"), ("near_next", "float64"),
                                       ("edge", "Int64"), ("part", "Int64")) if c in columns})


def _follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Judges each row with the one behind it; the first and the last row are also sent on as edges."""
    columns = [c.split()[0] for c in _EDGE.split(", ")]
    spotter, part, held = Spotter(), TaskContext.get().partitionId(), None

    def edge(key, text: str, which: int) -> tuple:
        return (key, None, None, None, None, None, None, which, part, text)

    for b in batches:
        rows = []
        for key, raw in zip(b["doc_id"], b["text"]):
            key, text = None if pd.isna(key) else int(key), clean_text(raw)
            mine = spotter.signatures(text)
            if held is None:
                rows.append(edge(key, text, 0))
            else:
                rows.append((*_judged(spotter, held[0], held[1], text, held[2], mine), None, None, None))
            held = (key, text, mine)
            if len(rows) >= 1000:
                yield _frame(rows, columns)
                rows = []
        if rows:
            yield _frame(rows, columns)
    if held is not None:
        yield _frame([edge(held[0], held[1], 1)], columns)


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _OUT.split(", ")]
    spotter = Spotter()
    for b in batches:
        yield _frame([_judged(spotter, None if pd.isna(k) else int(k), t, f, spotter.signatures(t), spotter.signatures(f))
                      for k, t, f in zip(b["doc_id"], b["text"], b["following"])], columns)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.col("doc_id").desc_nulls_last()
    dealt = rows.repartitionByRange(n, order).sortWithinPartitions(order, F.col("text").desc())
    found = cut_lineage(dealt.transform(mapped, _follow, _EDGE), "spots")
    names = [c.split()[0] for c in _OUT.split(", ")]
    edges = found.where("edge IS NOT NULL")
    # Partition numbers only: which partition with rows follows which, the last one being followed by the first.
    parts = [r.part for r in edges.where("edge = 0").select("part").orderBy("part").collect()]
    chain = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, behind int")
    last = edges.where("edge = 1").select("doc_id", "text", "part").join(chain, "part")
    first = edges.where("edge = 0").select(F.col("part").alias("behind"), F.col("text").alias("following"))
    across = last.join(first, "behind").select("doc_id", "text", "following").transform(mapped, _edges, _OUT)
    return found.where("edge IS NULL").select(*names).unionByName(across)


def _classed(docs: DataFrame, least: float, key: str) -> DataFrame:
    """doc_id, fingerprint, n (set size), partition (none without signatures), and the key of the set."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spotter = Spotter()
        for b in batches:
            sets = [spotter.signatures(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "fingerprint": [written(s) for s in sets], "n": [len(s) for s in sets],
                                "partition": pd.array([length_partition(len(s), least) if len(s) else None for s in sets], dtype="Int32")})

    found = docs.select("doc_id", "text").transform(mapped, run, f"doc_id {key}, fingerprint string, n int, partition int")
    return found.withColumn("class", F.xxhash64("fingerprint"))


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a signature."""
    for b in batches:
        for c in b.itertuples(index=False):
            sigs = np.frombuffer(base64.b64decode(c.fingerprint), dtype="<u4").astype(np.int64)
            yield pd.DataFrame({"class": c[0], "n": c.n, "partition": c.partition, "signature": sigs})


def _verify(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            likes = [likeness(*(np.frombuffer(base64.b64decode(f), dtype="<u4") for f in pair), least) for pair in zip(b["fingerprint_a"], b["fingerprint_b"])]
            out = pd.DataFrame({"a": b["a"], "b": b["b"], "likeness": likes})
            yield out[out["likeness"] >= least - ROUNDING]

    return run


def near_classes(classes: DataFrame, least: float) -> DataFrame:
    """(a, b, likeness) of all pairs of different sets (class, fingerprint, n, partition) that are ``least`` alike."""
    each = classes.where("n > 0").select("class", "n", "partition", "fingerprint")
    posts = each.transform(mapped, _unpacked, "class bigint, n int, partition int, signature bigint")
    often = posts.groupBy("signature").agg(F.count("*").alias("often"))
    # Of two sets that are alike, one of the first n - ceil(least * n) + 1 signatures of each, rarest first, is common to both.
    rarest = Window.partitionBy("class").orderBy("often", "signature")
    posts = (posts.join(often, "signature").withColumn("pos", F.row_number().over(rarest) - 1)
             .where(F.col("pos") < F.col("n") - F.ceil(F.lit(least) * F.col("n") - ROUNDING) + 1))
    posts = cut_lineage(posts.select("signature", "class", "n", "partition", "pos"), "spots-rare")
    here = posts.withColumn("meets", F.explode(F.array("partition", F.col("partition") + 1)))
    there = posts.select("signature", F.col("partition").alias("meets"), F.col("class").alias("class2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"))
    # The first common signature leaves enough behind it, or the two cannot be alike.
    pairs = (here.join(there, ["signature", "meets"]).where("partition < meets OR class < class2")
             .where(F.least("n", "n2") >= F.lit(least) * F.greatest("n", "n2") - ROUNDING)
             .where((F.least("pos", "pos2") + F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))) * (1 + least) >= least * (F.col("n") + F.col("n2")) - ROUNDING)
             .select(F.least("class", "class2").alias("a"), F.greatest("class", "class2").alias("b")).distinct())
    for side in ("a", "b"):
        pairs = pairs.join(each.select(F.col("class").alias(side), F.col("fingerprint").alias(f"fingerprint_{side}")), side)
    return pairs.transform(mapped, _verify(least), "a bigint, b bigint, likeness double")


def near_documents(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, fingerprint, partition, class, cluster) of every row: rows of equal sets are one class, and
    classes that links of at least ``least`` (above 0, below 1) connect are one cluster."""
    if not 0 < least < 1:
        raise ValueError("least must be above 0 and below 1")
    rows = cut_lineage(_classed(docs, least, docs.schema["doc_id"].dataType.simpleString()), "spots-sets")
    classes = cut_lineage(rows.groupBy("class").agg(*(F.first(c).alias(c) for c in ("fingerprint", "n", "partition"))), "spots-classes")
    roots = connected(near_classes(classes, least).select("a", "b"), "spots-links")
    return rows.join(roots.withColumnRenamed("vertex", "class"), "class", "left").select(
        "doc_id", "fingerprint", "partition", "class", F.coalesce("root", "class").alias("cluster"))
