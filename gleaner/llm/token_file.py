"""Token ids in a binary file format of shuffled planes, and back.

Documents are put in ascending doc_id order by range partitions; each partition encodes its texts,
appends an end id to each and writes *chunks*. A chunk holds whole documents, about ``CHUNK_IDS`` ids.
Its ids are cut into blocks of ``BLOCK`` (the last one padded), every block is transposed into byte or
bit planes, equal planes of all blocks lie together, and each plane is compressed with zstandard on
its own: high bytes of ids hardly differ, so their planes shrink to almost nothing. Beside the
payload a chunk stores its index: number of ids, offsets of its planes, documents and their lengths.

A chunk is one row of a Parquet folder (a container that any store a cluster uses can hold, that
commits whole tasks, and whose index can be read without the payload). Reading sums the chunk
index by partition for the global starts and decodes chunks independently of each other.

Texts are split at the file's added tokens first, as the library does with whole texts; their ids
stand between those of the parts.

Defined cases: null and empty texts consist of their end id; null doc_ids come first; documents with
equal doc_ids are ordered by text; no documents make an empty file; other columns are not stored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.pieces import PieceTable, clean_text
from gleaner.llm.rows import mapped
from gleaner.llm.words import slices

BLOCK = 4096               # ids transposed together
CHUNK_IDS = 1 << 19        # a chunk is closed once it holds so many
LEVEL = 3
CHUNK = "part int, chunk int, n_ids bigint, keys array<bigint>, lengths array<bigint>, planes array<bigint>, kind string, payload binary"


def library_encoder(path: str):
    """Encodes single pieces with the tokenizers library; the file's split is done before."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    whole.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    whole.encode_special_tokens = True
    return lambda pieces: [e.ids for e in whole.encode_batch_fast(pieces, add_special_tokens=False)]


def text_encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """The ids of whole texts, equal to the library's ``encode(text, add_special_tokens=False)``."""
    from tokenizers import Tokenizer

    table, whole = PieceTable(library_encoder(path)), Tokenizer.from_file(path)
    added = {t.content: i for i, t in whole.get_added_tokens_decoder().items() if t.content}
    if not added:
        return table.ids
    plain = not any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in whole.get_added_tokens_decoder().values())
    # The first place counts, and of several tokens there the longest.
    literals = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def ids(texts: list[str]) -> list[np.ndarray]:
        # Tokens that take white space with them or depend on what is around are left to the library.
        parts = [literals.split(t) if plain else [t] for t in texts]
        found = iter(table.ids([p for own in parts for p in own[::2]]))
        out = []
        for t, own in zip(texts, parts):
            mine = [next(found) if i % 2 == 0 else np.array([added[p]], dtype=np.uint32) for i, p in enumerate(own)]
            if not plain and (whole.normalizer is not None or literals.search(t)):
                mine = [np.array(whole.encode(t, add_special_tokens=False).ids, dtype=np.uint32)]
            out.append(mine[0] if len(mine) == 1 else np.concatenate(mine))
        return out

    return ids


def pack(ids: np.ndarray, kind: str = "byte", level: int = LEVEL) -> tuple[list[int], bytes]:
    """(sizes of the compressed planes, payload) of unsigned 32-bit ids."""
    blocks = -(-len(ids) // BLOCK)
    full = np.zeros(blocks * BLOCK, dtype="<u4")
    full[:len(ids)] = ids
    squeeze = zstandard.ZstdCompressor(level=level).compress
    if kind == "byte":
        planes = np.ascontiguousarray(full.view(np.uint8).reshape(blocks * BLOCK, 4).T)
        parts = [squeeze(p.tobytes()) for p in planes]
    else:
        parts = [squeeze(np.packbits((full >> np.uint32(b) & np.uint32(1)).astype(np.uint8)).tobytes()) for b in range(32)]
    return [len(p) for p in parts], b"".join(parts)


def unpack(n: int, sizes: list[int], payload: bytes, kind: str = "byte") -> np.ndarray:
    """The ids again."""
    blocks = -(-n // BLOCK)
    at = np.concatenate(([0], np.cumsum(sizes)))
    grow = zstandard.ZstdDecompressor().decompress
    raw = [np.frombuffer(grow(payload[a:z]), dtype=np.uint8) for a, z in zip(at[:-1], at[1:])]
    if kind == "byte":
        return np.ascontiguousarray(np.stack(raw, axis=1)).view("<u4").ravel()[:n]
    out = np.zeros(blocks * BLOCK, dtype="<u4")
    for b, bits in enumerate(raw):
        out |= np.unpackbits(bits).astype("<u4") << np.uint32(b)
    return out[:n]


def _encode(path: str, end: int, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = text_encoder(path)
        part = TaskContext.get().partitionId()
        keys, ids, held, number = [], [], 0, 0

        def out() -> Iterator[pd.DataFrame]:
            sizes, payload = pack(np.concatenate(ids), kind)
            yield pd.DataFrame({"part": [part], "chunk": [number], "n_ids": [held], "keys": [keys], "lengths": [[len(i) for i in ids]],
                                "planes": [sizes], "kind": [kind], "payload": [payload]})

        for b in batches:
            texts = [clean_text(t) for t in b["text"]]
            for span in slices(len(texts), [len(t) for t in texts], 1 << 20):
                for key, mine in zip(b["doc_id"][span], encode(texts[span])):
                    keys.append(None if pd.isna(key) else int(key))
                    ids.append(np.append(mine, np.uint32(end)))
                    held += len(mine) + 1
                    if held >= CHUNK_IDS:
                        yield from out()
                        keys, ids, held, number = [], [], 0, number + 1
        if ids:
            yield from out()

    return run


def write(docs: DataFrame, folder: str, path: str, end: int = 0, kind: str = "byte") -> None:
    """Write the ids of ``docs`` (doc_id, text) to ``folder``, in ascending doc_id order."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.transform(mapped, _encode(path, end, kind), CHUNK).write.parquet(folder)


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for c in b.itertuples(index=False):
            ids = unpack(c.n_ids, list(c.planes), c.payload, c.kind)
            ends = np.cumsum(np.asarray(c.lengths, dtype=np.int64))
            starts = ends - np.asarray(c.lengths, dtype=np.int64)
            for span in slices(len(ends), np.asarray(c.lengths).tolist(), 1 << 18):
                yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(k) else int(k) for k in c.keys[span]], dtype="Int64"),
                                    "start": starts[span] + c.begin, "ids": [ids[a:z].tobytes() for a, z in zip(starts[span], ends[span])]})


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the file: ``start`` counts the ids of all documents
    before, ``ids`` are little-endian unsigned 32-bit."""
    chunks = spark.read.schema(CHUNK).parquet(folder)
    # One number a partition: their running sum gives where each begins.
    sums = {r.part: r.n for r in chunks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    begins, total = [], 0
    for part in sorted(sums):
        begins.append((part, total))
        total += sums[part]
    parts = spark.createDataFrame(begins, "part int, base bigint")
    index = chunks.select("part", "chunk", "n_ids")
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    index = index.withColumn("before", F.coalesce(before, F.lit(0))).join(parts, "part").select(
        "part", "chunk", (F.col("base") + F.col("before")).alias("begin"))
    return chunks.join(index, ["part", "chunk"]).transform(mapped, _decode, "doc_id bigint, start bigint, ids binary")
