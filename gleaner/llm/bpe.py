"""Byte-level BPE by overlapping chunks, and back.

A text longer than one chunk is cut into chunks that overlap. Chunks are split into pre-tokens
independently of each other, over all executors, so every chunk but a text's first starts at an
arbitrary place. Splitting reads from left to right and remembers nothing, so from any boundary
that a chunk shares with its predecessor on, both agree: there the two are stitched. Where an
overlap has no shared boundary (one endless word), the pieces are split again from the
predecessor's last sure boundary. Pieces are then encoded; decoding joins the ids' raw bytes.

Defined cases: a null text is empty and has no ids; lone surrogates count as ``?``; repeated rows
and equal doc_ids are encoded one by one; other columns are passed on untouched, also those named
like the operator's own (``ids``, ``decoded`` replace columns of that name).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.pieces import PieceTable, clean_text
from gleaner.llm.pretokens import code_points, piece_starts
from gleaner.llm.rows import mapped

CHUNK = 1 << 15            # code points a chunk advances
OVERLAP = 1 << 10          # code points it reads beyond
OUT_BYTES = 4 << 20        # output rows are sent on in batches of about this size


@cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_encoder(path: str):
    """Encodes single pieces by the file's ranks."""
    import tiktoken

    # A pattern that takes a whole piece, since pieces are given.
    one = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(path), special_tokens={})
    return lambda pieces: [one.encode_ordinary(p) for p in pieces]


class Decoder:
    """Raw bytes of ids."""

    def __init__(self, path: str) -> None:
        by_id = {i: b for b, i in read_ranks(path).items()}
        top = max(by_id, default=-1) + 1
        self.size = np.fromiter((len(by_id.get(i, b"")) for i in range(top)), dtype=np.int64, count=top)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(top)), dtype=np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        if len(ids) == 0:
            return b""
        at, size = self.at[ids], self.size[ids]
        end = np.cumsum(size)
        return self.flat[np.repeat(at - end + size, size) + np.arange(end[-1])].tobytes()


def stitched_starts(points: np.ndarray, at: list[int], starts: list[np.ndarray], overlap: int) -> np.ndarray:
    """Piece starts of a whole text from those of its chunks (``at``: where each begins).

    All positions count from the text's start.
    """
    sure = starts[0]
    for i in range(1, len(at)):
        begin, reach = at[i], at[i] + overlap
        # The predecessor's pieces that end at its edge may go on behind it: its last one is not sure.
        ahead = sure[(sure >= begin)][:-1] if len(sure) else sure
        shared = np.intersect1d(ahead, starts[i], assume_unique=True)
        if shared.size:
            cut = int(shared[0])
            sure = np.concatenate((sure[sure < cut], starts[i][starts[i] >= cut]))
        else:
            back = int(sure[-2]) if len(sure) > 1 else 0
            end = at[i + 1] + overlap if i + 1 < len(at) else len(points)
            sure = np.concatenate((sure[sure < back], back + piece_starts(points[back:end])))
    return sure


def _frames(rows: list, sizes: list[int], columns: list[str]) -> Iterator[pd.DataFrame]:
    from gleaner.llm.words import slices

    for part in slices(len(rows), sizes, OUT_BYTES):
        yield pd.DataFrame(rows[part], columns=columns)


def _encode_short(path: str, others: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, decode = PieceTable(rank_encoder(path)), Decoder(path)
        for b in batches:
            texts = [clean_text(t) for t in b["text"]]
            ids = table.ids(texts)
            rows = [(*rest, i.astype("<u4").tobytes(), decode(i)) for rest, i in zip(b[others].itertuples(index=False, name=None), ids)]
            yield from _frames(rows, [len(r[-1]) + len(r[-2]) + 64 for r in rows], [*others, "ids", "decoded"])

    return run


def _split_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Piece starts of each chunk, on its own."""
    for b in batches:
        b["starts"] = [piece_starts(code_points(clean_text(t))).astype("<i4").tobytes() for t in b["part"]]
        yield b


def _join_chunks(path: str, chunk: int, overlap: int):
    def whole(rows: list) -> tuple:
        parts = [clean_text(r.part) for r in rows]
        points = code_points("".join([*(p[:chunk] for p in parts[:-1]), parts[-1]]))
        at = [i * chunk for i in range(len(rows))]
        return points, stitched_starts(points, at, [np.frombuffer(r.starts, dtype="<i4").astype(np.int64) + a for r, a in zip(rows, at)], overlap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, decode = PieceTable(rank_encoder(path)), Decoder(path)
        rows: list = []

        def done() -> Iterator[pd.DataFrame]:
            points, starts = whole(rows)
            ids, _ = table.ids_of_pieces(points, starts, np.append(starts[1:], len(points)))
            yield pd.DataFrame([(rows[0].row, ids.astype("<u4").tobytes(), decode(ids))], columns=["row", "ids", "decoded"])

        for b in batches:
            for r in b.itertuples(index=False):
                if rows and rows[0].row != r.row:
                    yield from done()
                    rows = []
                rows.append(r)
        if rows:
            yield from done()

    return run


def encode(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` without ``text``, with ``ids`` (little-endian unsigned 32-bit, binary) and
    ``decoded`` (the bytes these ids stand for). ``path``: a file of ranks, readable everywhere."""
    docs = docs.drop("ids", "decoded")
    others = [c for c in docs.columns if c != "text"]
    length = F.coalesce(F.length("text"), F.lit(0))
    binary = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    kept = T.StructType([f for f in docs.schema.fields if f.name != "text"])
    short = docs.where(length <= chunk + overlap).transform(mapped, _encode_short(path, others), T.StructType([*kept.fields, *binary]))

    # Long texts: one row a chunk, dealt over all executors, then joined by text.
    struct = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    long = docs.where(length > chunk + overlap).select(
        F.xxhash64("text").alias("row"), struct.alias("rest"), "text")
    # Equal texts are encoded once.
    cuts = F.sequence(F.lit(0), F.floor((F.length("text") - overlap - 1) / chunk).cast("int"))
    parts = (long.dropDuplicates(["row"]).select("row", "text", F.explode(cuts).alias("no"))
             .select("row", "no", F.expr(f"substring(text, no * {chunk} + 1, {chunk + overlap})").alias("part")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = parts.repartition(n, "row", "no").transform(mapped, _split_chunks, "row bigint, no int, part string, starts binary")
    joined = split.repartition(n, "row").sortWithinPartitions("row", "no").transform(mapped, 
        _join_chunks(path, chunk, overlap), "row bigint, ids binary, decoded binary")
    again = long.select("row", "rest").join(joined, "row").select(*[F.col("rest").getField(c).alias(c) for c in others], "ids", "decoded")
    return short.unionByName(again)
