"""Word search over numbered words: questions stored as indexes, documents streaming past them.

Words travel as 64-bit hashes. Those that questions hold are numbered, rare ones first, in shards by hash
(:func:`number_words`); documents become ascending lists of numbers (:func:`numbered`). Questions are dealt into
passes, those of like length together (:func:`dealt_passes`), and a task for each pass stores its index
(:func:`store_indexes`). Shards and indexes are files in the shared folder that tasks map into memory: neither
questions nor words pass the driver.

A document is compared with all questions of a pass at once, exactly. Some documents give each question a floor that
its k-th score reaches. The last words of a question, in the order of numbers, that together stay below ``LIGHT`` of
the floor are not looked up at first, nor are the last words of a document that stay below that share of the least
floor in the pass. What two texts share and was left out is an end of one of them, so the rest tells which pairs
still have a chance; only those are completed.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.cells import DIGITS

SHARD_BITS = 4               # shards of the numbered words
CLASSES = 512                # classes of frequency, 16 for each power of two
SCORES_PER_STEP = 250_000    # (document, question) scores held at once
LOOKUPS_PER_STEP = 300_000   # (document, question, word) rows at once, unless one document has more
FLAGS = 32_000_000           # (document, word) flags held at once
ROWS = 2_048                 # documents taken from a batch at once
LONG_DOCS = 128              # longest documents, which give the first floors
LIGHT = 0.6                  # share of a floor that the words left out make at most
MARGIN = 1e-8                # sums are rounded


# --- arrays in the shared folder ----------------------------------------------

def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _save(folder: str, **arrays: np.ndarray) -> None:
    """Each array as a file of its own; a task that runs twice leaves the same files."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    for name, a in arrays.items():
        part = f"{path}/{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            np.save(out, a)
        store.move(part, f"{path}/{name}.npy")


def _load(folder: str, *names: str) -> list[np.ndarray]:
    """The arrays, memory-mapped where they are large and the store is local."""
    store, path = _store(folder)
    out = []
    for name in names:
        file = f"{path}/{name}.npy"
        if not isinstance(store, fs.LocalFileSystem):
            with store.open_input_file(file) as f:
                out.append(np.load(io.BytesIO(f.read())))
            continue
        large = store.get_file_info(file).size > 1 << 16
        out.append(np.asarray(np.load(file, mmap_mode="r" if large else None)))
    return out


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(length of each list, all values); null is an empty list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each of ``starts`` on, as many as ``n`` says."""
    out = np.repeat(starts - (np.cumsum(n, dtype=np.int64) - n), n)
    out += np.arange(len(out))
    return out


def _tails(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For lists of ``n`` values each: the sum from each place to the end of its list."""
    sums = np.cumsum(values)
    ends = np.append(0.0, sums)[np.cumsum(n)]
    return np.repeat(ends, n) - sums + values


# --- numbered words -----------------------------------------------------------

def _classes(df: np.ndarray) -> np.ndarray:
    return np.minimum(CLASSES - 1, (16 * np.log2(df + 1.0)).astype(np.int64))


class Words:
    """Numbers and document frequencies of the words in the shards."""

    def __init__(self, folder: str, shards: list[int]) -> None:
        self.shards = {s: _load(f"{folder}/{s}", "token", "number", "df") for s in shards}

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, documents) of each."""
        words, which = np.unique(tokens, return_inverse=True)
        number, df = np.full(len(words), -1, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        shard = words >> (64 - SHARD_BITS)
        for s, (known, numbers, seen) in self.shards.items():
            mine = slice(*np.searchsorted(shard, [s, s + 1]).tolist())
            at = np.minimum(np.searchsorted(known, words[mine]), len(known) - 1)
            hit = known[at] == words[mine]
            number[mine], df[mine] = np.where(hit, numbers[at], -1), np.where(hit, seen[at], 0)
        return number[which], df[which]


@lru_cache(maxsize=1)
def _words(folder: str, shards: tuple[int, ...]) -> Words:
    return Words(folder, list(shards))


def number_words(asked: DataFrame, docs: DataFrame, folder: str) -> tuple[tuple[int, ...], int]:
    """(shards, words): the words of ``asked`` (tokens) numbered by classes of the documents (tokens) that hold them.

    Words are counted in partial aggregates, so frequent ones cost no more than rare ones; of the shards only the
    sizes of classes pass the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.explode("tokens").alias("token"), F.lit(1).alias("held"), F.lit(0).alias("asked")).unionAll(
        asked.select(F.explode("tokens").alias("token"), F.lit(0).alias("held"), F.lit(1).alias("asked")))
    known = (rows.groupBy("token").agg(F.sum("held").alias("df"), F.max("asked").alias("asked")).where("asked = 1")
             .select(F.shiftright("token", 64 - SHARD_BITS).cast("int").alias("shard"), "token", "df"))

    def store(table: pa.Table) -> pa.Table:
        shard, token, df = table["shard"][0].as_py(), table["token"].to_numpy(), table["df"].to_numpy()
        order = np.argsort(token)
        _save(f"{folder}/{shard}", token=token[order], df=df[order])
        return pa.table({"shard": pa.array([shard], pa.int32()), "sizes": pa.array([np.bincount(_classes(df), minlength=CLASSES)], pa.list_(pa.int64()))})

    made = sorted(known.groupBy("shard").applyInArrow(store, "shard int, sizes array<bigint>").collect())
    if not made:
        return (), 0
    sizes = np.array([r.sizes for r in made]).T               # by class, then by shard
    first = (np.cumsum(sizes) - sizes.ravel()).reshape(sizes.shape)

    def number(row) -> None:
        df, = _load(f"{folder}/{row.shard}", "df")
        kind = _classes(df)
        order = np.argsort(kind, kind="stable")
        n = np.bincount(kind, minlength=CLASSES)
        numbers = np.empty(len(df), dtype=np.int64)
        numbers[order] = _ranges(np.array(row.first), n)
        _save(f"{folder}/{row.shard}", number=numbers.astype(np.int32))

    spark.createDataFrame([(r.shard, c.tolist()) for r, c in zip(made, first.T)], "shard int, first array<bigint>").repartition(
        len(made), "shard").foreach(number)
    return tuple(r.shard for r in made), int(sizes.sum())


def numbered(docs: DataFrame, folder: str, shards: tuple[int, ...]) -> DataFrame:
    """(doc_id, words) of (doc_id, tokens): ascending numbers of the words that questions hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n, tokens = _lists(part["tokens"])
                number, _ = _words(folder, shards).find(tokens)
                row = np.repeat(np.arange(len(n)), n)[number >= 0]
                words = (np.sort(row << 32 | number[number >= 0]) & 0xFFFFFFFF).astype(np.int32)
                ends = np.cumsum(np.bincount(row, minlength=len(n)))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(words))
                yield pa.record_batch([part["doc_id"], lists], names=["doc_id", "words"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, words array<int>")


# --- indexes ------------------------------------------------------------------

def dealt_passes(asked: DataFrame, passes: int | None, words_per_pass: int) -> DataFrame | None:
    """``asked`` with ``pass``: questions in the order of their length, in passes of equal words. None if they have no words."""
    spark = asked.sparkSession
    asked = asked.withColumn("size", F.size("tokens")).where("size > 0")
    sizes = sorted(asked.groupBy("size").count().collect())
    total = sum(r["size"] * r["count"] for r in sizes)
    if not total:
        return None
    passes = passes or -(-total // words_per_pass)
    if passes == 1:
        return asked.withColumn("pass", F.lit(0))
    span = [r["size"] * r["count"] for r in sizes]
    first = np.cumsum(span) - span
    places = spark.createDataFrame([(r["size"], passes * int(a) / total, passes * b / total) for r, a, b in zip(sizes, first, span)], "size int, first double, span double")
    inside = F.pmod(F.xxhash64("query_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return asked.join(places, "size").withColumn("pass", F.least(F.lit(passes - 1), F.floor(F.col("first") + F.col("span") * inside).cast("int")))


def store_sample(docs: DataFrame, n: int, floor_docs: int, folder: str) -> str | None:
    """Folder of the longest documents and some others, by chance, as arrays. None if there are few: they need no floors."""
    if n < 4 * floor_docs:
        return None
    sizes = docs.select(F.size("words").alias("size")).orderBy(F.desc("size")).limit(LONG_DOCS + 1).collect()
    share = max(floor_docs, min(n // 50, 10 * floor_docs)) / n
    sample = (docs.select("words", (F.size("words") > F.lit(sizes[-1]["size"])).alias("long"), F.rand(7).alias("chance"))
              .where(F.col("long") | (F.col("chance") < share)).select("words", "long").repartition(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pa.schema([("words", pa.list_(pa.int32())), ("long", pa.bool_())]))
        own = f"{folder}/{uuid.uuid4().hex}"                  # of this attempt; others may draw other rows
        for name, part in (("long", table.filter(table["long"])), ("other", table.filter(pc.invert(table["long"])))):
            size, words = _lists(part["words"])
            _save(f"{own}/{name}", size=size, words=words.astype(np.int32))
        yield pa.record_batch([pa.array([own])], names=["folder"])

    return sample.mapInArrow(run, "folder string").collect()[0].folder


class Index:
    """The questions of a pass. ``word``: places in ``vocab``, ascending, question by question from ``begin`` on; from ``split`` on
    they are left out at first and weigh ``rest``. ``heavy``: the questions of each word before. ``cut``: what the words left out of a
    document weigh at most. ``reach``: what the words of a document weigh at least that some question's floor lets in."""

    STORED = ("vocab", "weight", "begin", "word", "total", "floor", "split", "rest", "heavy_begin", "heavy", "cut", "reach")

    def __init__(self, arrays: list[np.ndarray]) -> None:
        self.__dict__.update(zip(self.STORED, arrays))

    @classmethod
    def of(cls, vocab: np.ndarray, weight: np.ndarray, begin: np.ndarray, word: np.ndarray, total: np.ndarray, floor: np.ndarray, single: bool) -> Index:
        """``single``: no question holds a word twice."""
        n = np.diff(begin)
        tails, asks = _tails(weight[word], n), np.repeat(np.arange(len(n)), n)
        bound, margin = LIGHT * floor * total, MARGIN * (total + 10)
        light = tails <= (bound - margin)[asks]
        split = begin[1:] - np.bincount(asks[light], minlength=len(n))
        rest = np.where(split < begin[1:], np.append(tails, 0.0)[split], 0.0)
        heavy_begin = np.append(0, np.cumsum(np.bincount(word[~light], minlength=len(vocab)))).astype(np.int32)
        heavy = asks[~light][np.argsort(word[~light], kind="stable")].astype(np.int32)
        cut, reach = (bound.min(), (floor * total - margin).min()) if single else (0.0, 0.0)
        return cls([vocab, weight, begin, word, total, floor, split, rest, heavy_begin, heavy, np.array([cut]), np.array([reach])])

    def stored(self) -> dict[str, np.ndarray]:
        return {name: getattr(self, name) for name in self.STORED}

    def with_floor(self, floor: np.ndarray, single: bool) -> Index:
        return Index.of(self.vocab, self.weight, self.begin, self.word, self.total, floor, single)


def search(index: Index, parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, words: int) -> pd.DataFrame | None:
    """(question, chunk_id, score) of the best ``k`` for each question among documents (ids, lengths, numbers of their words).
    ``words``: how many there are."""
    place = np.full(words, -1, dtype=np.int32)
    place[index.vocab] = np.arange(len(index.vocab), dtype=np.int32)
    n_asks, n_words = len(index.total), len(index.vocab)
    weight, total, split, begin = (np.array(x) for x in (index.weight, index.total, index.split, index.begin))
    heavy_begin, n_heavy, floor = index.heavy_begin[:-1], np.diff(index.heavy_begin), np.array(index.floor)
    cut, reach = float(index.cut[0]), float(index.reach[0])
    pruned = bool((split < begin[1:]).any()) or cut > 0
    margin, divisor, left_out = MARGIN * (total + 10), np.where(total > 0, total, 1.0), np.maximum(index.rest, cut)
    keys = np.repeat(np.arange(n_asks), np.diff(begin)) * n_words + index.word if cut > 0 else None
    step = max(1, min(1024, SCORES_PER_STEP // max(1, n_asks), FLAGS // max(1, n_words)))
    present = np.zeros(step * n_words if pruned else 0, dtype=bool)
    pool, new, waiting = None, [], 0

    def best() -> pd.DataFrame:
        rows = pd.DataFrame(dict(zip(("question", "chunk_id", "score"), map(np.concatenate, zip(*new)))))
        return (pd.concat(([] if pool is None else [pool]) + [rows], ignore_index=True)
                .sort_values(["question", "score", "chunk_id"], ascending=[True, False, True]).groupby("question", sort=False).head(k))

    for ids, n, numbers in parts:
        at, row = place[numbers], np.repeat(np.arange(len(n)), n)
        row, at = row[at >= 0], at[at >= 0]
        n = np.bincount(row, minlength=len(n))
        gain = weight[at]
        tails = _tails(gain, n)
        ends = np.append(0, np.cumsum(n))
        counted = tails > cut
        some = np.flatnonzero(n > 0)
        counted &= np.isin(np.arange(len(n)), some[tails[ends[some]] >= reach])[row]
        end_at = np.full(len(n), n_words, dtype=np.int64)      # the first word left out
        n_counted = np.bincount(row[counted], minlength=len(n))
        some = np.flatnonzero(n_counted < n)
        end_at[some] = at[ends[some] + n_counted[some]]
        asks = np.flatnonzero(np.where(counted, n_heavy[at], 0))
        own_row, own_at, own_gain = row[asks], at[asks], gain[asks]
        own_n, own_begin = n_heavy[own_at], heavy_begin[own_at]
        own_ends = np.append(0, np.cumsum(np.bincount(own_row, minlength=len(n))))
        lookups = np.append(0, np.cumsum(own_n, dtype=np.int64))[own_ends]
        stop = 0
        while stop < len(n):
            first = stop
            stop = max(first + 1, min(first + step, len(n), int(np.searchsorted(lookups, lookups[first] + LOOKUPS_PER_STEP, side="right")) - 1))
            if lookups[stop] == lookups[first]:
                continue
            rows, mine, whole = stop - first, slice(own_ends[first], own_ends[stop]), slice(ends[first], ends[stop])
            m = own_n[mine]
            cell = np.repeat((own_row[mine] - first) * n_asks, m)
            cell += index.heavy.take(_ranges(own_begin[mine], m))
            score = np.bincount(cell, weights=np.repeat(own_gain[mine], m), minlength=rows * n_asks).reshape(rows, n_asks)
            least = np.maximum(floor * total - left_out - margin, np.finfo(np.float64).tiny)
            if not pruned and rows > k:
                least = np.maximum(least, np.partition(score, rows - k, axis=0)[rows - k] - margin)
            hit = np.flatnonzero((score >= least).ravel())
            if not len(hit):
                continue
            r, c, value = hit // n_asks, hit % n_asks, score.ravel()[hit]
            if pruned:
                begins = split[c] if keys is None else np.minimum(split[c], np.searchsorted(keys, c * n_words + end_at[first + r]))
                m = begin[c + 1] - begins
                flags = (row[whole] - first) * n_words + at[whole]
                present[flags] = True
                many = np.cumsum(m)
                at_once = np.unique(np.append(np.searchsorted(many, np.arange(0, many[-1], LOOKUPS_PER_STEP)), len(m)))
                for a, z in zip(at_once[:-1], at_once[1:]):
                    word = index.word.take(_ranges(begins[a:z], m[a:z]))
                    there = present[np.repeat(r[a:z] * n_words, m[a:z]) + word]
                    value[a:z] += np.bincount(np.repeat(np.arange(z - a), m[a:z])[there], weights=weight[word[there]], minlength=z - a)
                present[flags] = False
            value = np.round(value / divisor[c], DIGITS)
            ok = (value >= floor[c] - MARGIN) & (value > 0)
            if not ok.any():
                continue
            new.append((c[ok], ids[first + r[ok]], value[ok]))
            waiting += len(new[-1][0])
            if waiting >= n_asks * k:
                pool, new, waiting = best(), [], 0
                floor = np.maximum(floor, kth(pool, k, n_asks))  # anything lower can no longer enter
    return best() if waiting else pool


def kth(pool: pd.DataFrame, k: int, questions: int) -> np.ndarray:
    """The ``k``-th score of each question, 0 where there are fewer."""
    floor, full = np.zeros(questions), pool.groupby("question")["score"].agg(["size", "min"])
    full = full[full["size"] >= k]["min"]
    floor[full.index.to_numpy()] = full.to_numpy()
    return floor


def with_floors(index: Index, sample: str, k: int, words: int, single: bool) -> Index:
    """``index`` with the floors that the stored sample gives: those of the longest documents first, which reach the highest scores."""
    found, at = [], 0
    for name in ("long", "other"):
        size, numbers = _load(f"{sample}/{name}", "size", "words")
        ends = np.append(0, np.cumsum(size))
        rows = ((np.arange(at + a, at + min(a + ROWS, len(size))), size[a:a + ROWS], numbers[ends[a]:ends[min(a + ROWS, len(size))]])
                for a in range(0, len(size), ROWS))
        at += len(size)
        pool = search(index, rows, k, words)
        if pool is not None:
            found.append(pool)
            both = pd.concat(found, ignore_index=True).sort_values(["question", "score"], ascending=[True, False]).groupby("question", sort=False).head(k)
            index = index.with_floor(kth(both, k, len(index.total)), single)
    return index


def store_indexes(asked: DataFrame, shared: Broadcast, folder: str, k: int) -> list[str]:
    """Folders of the indexes of all passes of ``asked`` (query_id, tokens, pass), each stored by one task. ``shared``: (folder of
    the words, shards, number of words, number of documents, folder of the sample or None)."""

    def build(table: pa.Table) -> pa.Table:
        known, shards, words, docs, sample = shared.value
        p, (n, tokens) = table["pass"][0].as_py(), _lists(table["tokens"])
        number, df = _words(known, shards).find(tokens)
        order = np.lexsort((number, np.repeat(np.arange(len(n)), n)))
        vocab, firsts, word = np.unique(number, return_index=True, return_inverse=True)
        weight = np.log((docs + 1) / (df[firsts] + 1.0))
        word = word[order].astype(np.int32)
        begin = np.append(0, np.cumsum(n))
        total = np.add.reduceat(weight[word], begin[:-1])
        again = word[1:] == word[:-1]
        again[begin[1:-1] - 1] = False
        index = Index.of(vocab.astype(np.int32), weight, begin, word, total, np.zeros(len(n)), not again.any())
        if sample:
            index = with_floors(index, sample, k, words, not again.any())
        own = f"{folder}/{p}-{uuid.uuid4().hex}"              # of this attempt; others may have the rows in another order
        _save(own, **index.stored())
        store, path = _store(own)
        ids = table.select(["query_id"]).combine_chunks()
        with store.open_output_stream(f"{path}/ids.arrow") as out, pa.ipc.new_file(out, ids.schema) as file:
            file.write_table(ids)
        return pa.table({"pass": pa.array([p], pa.int32()), "folder": pa.array([own])})

    made = asked.select("query_id", "tokens", "pass").groupBy("pass").applyInArrow(build, "pass int, folder string").collect()
    return [r.folder for r in sorted(made)]


def scan(shared: Broadcast, k: int) -> Callable:
    """The best ``k`` of a task's documents (doc_id, words) for each question. ``shared``: (folder of an index, number of words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, words = shared.value
        index, kind = Index(_load(folder, *Index.STORED)), []

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for batch in batches:
                kind[:] = [batch.schema.field("doc_id").type]
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    yield part["doc_id"].to_pandas(integer_object_nulls=True).to_numpy(), *_lists(part["words"])

        pool = search(index, parts(), k, words)
        if pool is not None and len(pool):
            store, path = _store(folder)
            with store.open_input_file(f"{path}/ids.arrow") as file:
                ids = pa.ipc.open_file(file).read_all()["query_id"].take(pa.array(pool["question"].to_numpy())).combine_chunks()
            found = pa.array(pool["chunk_id"].to_numpy(), kind[0], from_pandas=True)
            yield pa.record_batch([ids, found, pa.array(pool["score"].to_numpy())], names=["query_id", "chunk_id", "score"])

    return run
