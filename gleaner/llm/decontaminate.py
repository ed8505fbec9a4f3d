"""Benchmark decontamination: passages within a small edit distance of benchmark items.

1. *Windows.* A document is looked at through windows as long as an item, placed so that one of the
   item's less frequent words falls on its place in the item. Word frequencies are counted over all
   documents; every item keeps its ``LEAST`` rarest words, or half of its words, so edits must hit all of them to hide it.
   A stretch within e edits of an item of n characters shares n - 3 - 4e of its runs of four, so windows
   whose surroundings hold fewer are left out; this drops no match, and what the later steps propose
   is looked at the same way.
2. *Embedding.* The CGK random walk copies characters to an output and steps on by a random bit that
   depends on the step and the character: strings at a small edit distance get outputs at a small
   Hamming distance. Several independent walks are made.
3. *LSH.* Tables sample a few output positions each, within what items of a length class fill; an
   item whose samples agree with a window's in any table is a candidate.
4. *Verification.* Candidates are settled by the exact edit distance between the item and the best
   matching stretch around the window; at most ``share`` of the item's length may differ.

Items are the query set: they are sent to tasks in blocks of ``BLOCK_ITEMS``; documents stay where
they are and are never shuffled.

Defined cases: A-Z and a-z are equal, white space characters are equal; null or blank items match
nothing, items that are repeated each match; null and empty texts match nothing; doc_id may be null
or repeated, every row is judged by its own text; other columns do not matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.rows import mapped
from gleaner.llm.words import hash_words, plain_bytes, slices, word_bounds

SHARE = 0.1                # edits allowed, as a share of the item's length
COMMON = 0.0005            # words in more documents than this share place no windows ...
LEAST = 12                 # ... but each item's rarest ones do
WALKS, TABLES, SAMPLES = 4, 24, 4
BLOCK_ITEMS = 10_000       # items sent to tasks at once
WINDOWS = 1 << 12          # windows embedded at once
GRAM = 4                   # characters of a run, by which windows are sifted
GRAM_BITS = 14             # an item's runs are marked in a bitmap of 2^14 bits
SIFTED = 1 << 21           # characters sifted at once
_BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def normal(text: str | None) -> bytes:
    return plain_bytes(text).translate(_BLANK)


def best_stretch(item: bytes, text: bytes, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the stretch of ``text`` nearest to ``item``, if within ``most`` edits."""
    found = _nearest_end(item, text)
    if found is None or found[0] > most:
        return None
    edits, end = found
    back = _nearest_end(item[::-1], text[:end][::-1])
    return edits, end - back[1], end


def _nearest_end(item: bytes, text: bytes) -> tuple[int, int] | None:
    """Fewest edits that turn ``item`` into a stretch of ``text``, and the first end of such a one.

    All cells of a column of the distance table change by one bit operation each.
    """
    m = len(item)
    if m == 0:
        return None
    full, high = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        where[c] |= 1 << i
    up, down, now = full, 0, m
    best = (m, 0)
    for j, c in enumerate(text):
        same = where.get(c, 0)
        v = same | down
        h = (((same & up) + up) ^ up) | same
        plus = down | (full & ~(h | up))
        minus = up & h
        now += 1 if plus & high else -1 if minus & high else 0
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(v | plus)), plus & v
        if now < best[0]:
            best = (now, j + 1)
    return best


def gram_codes(units: np.ndarray) -> np.ndarray:
    """A number below 2^``GRAM_BITS`` for each run of ``GRAM`` characters."""
    n = len(units) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    code = np.zeros(n, dtype=np.uint32)
    for i in range(GRAM):
        code |= units[i:i + n].astype(np.uint32) << np.uint32(8 * i)
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)


def length_class(n: int) -> int:
    """Lengths of one class differ by a quarter at the most."""
    return int(np.floor(np.log(max(n, 1)) / np.log(1.25)))


def embed(strings: list[bytes], seed: int) -> np.ndarray:
    """The walk's outputs, one row a string: two steps a character of the longest one."""
    longest = max(map(len, strings), default=0)
    steps = 2 * longest
    chars = np.zeros((len(strings), longest + 1), dtype=np.uint8)
    for row, s in zip(chars, strings):
        row[:len(s)] = np.frombuffer(s, dtype=np.uint8)
    out = np.zeros((len(strings), steps), dtype=np.uint8)
    rows, at = np.arange(len(strings)) * (longest + 1), np.zeros(len(strings), dtype=np.int64)
    flat = chars.ravel()
    for j in range(steps):
        c = flat[rows + at]
        out[:, j] = c
        at += step_bits(seed, j)[c]
        np.minimum(at, longest, out=at)
    return out


_BITS: dict[tuple[int, int], np.ndarray] = {}


def step_bits(seed: int, step: int) -> np.ndarray:
    """The random bit of every character at one step of a walk: the same in every process."""
    block = step >> 10
    if (seed, block) not in _BITS:
        _BITS[seed, block] = np.random.default_rng([seed, block]).integers(0, 2, size=(1024, 256), dtype=np.int64)
    return _BITS[seed, block][step & 1023]


@cache
def sampled_positions(seed: int, table: int, cls: int) -> np.ndarray:
    """Output positions a table looks at: within the steps that even the class's shortest item fills."""
    reach = max(2 * int(np.ceil(1.25 ** cls)), 1)
    return np.random.default_rng([seed, table, cls]).integers(0, reach, size=SAMPLES)


def signatures(embedded: np.ndarray, seed: int, table: int, cls: int) -> np.ndarray:
    at = np.minimum(sampled_positions(seed, table, cls), max(embedded.shape[1] - 1, 0))
    return embedded[:, at].astype(np.int64) @ (256 ** np.arange(SAMPLES, dtype=np.int64))


@dataclass
class Items:
    """A block of items with the words that place windows."""

    ids: list
    texts: list[bytes]
    share: float
    anchors: np.ndarray                       # word hashes, ascending
    spots: list[list[tuple[int, int]]]        # for each: (item, offset in it)

    def prepared(self) -> Items:
        """Adds the LSH tables; done in the task."""
        self.tables: dict[tuple[int, int, int], tuple[np.ndarray, list[int]]] = {}
        classes = np.array([length_class(len(t)) for t in self.texts])
        for c in np.unique(classes).tolist():
            mine = np.flatnonzero(classes == c)
            for w in range(WALKS):
                e = embed([self.texts[i] for i in mine], w)
                for t in range(TABLES):
                    keys = signatures(e, w, t, c)
                    order = np.argsort(keys, kind="stable")
                    self.tables[w, t, c] = keys[order], mine[order].tolist()
        self.sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.most = (self.share * self.sizes).astype(np.int64)
        self.grams = np.zeros((len(self.texts), 1 << (GRAM_BITS - 3)), dtype=np.uint8)
        for row, t in zip(self.grams, self.texts):
            codes = gram_codes(np.frombuffer(t, dtype=np.uint8))
            np.bitwise_or.at(row, codes >> 3, (1 << (codes & 7)).astype(np.uint8))
        # Anchors' spots as flat arrays: those of anchor i lie from bounds[i] to bounds[i + 1].
        self.spot_bounds = np.cumsum([0, *map(len, self.spots)])
        self.spot_item = np.array([i for s in self.spots for i, _ in s], dtype=np.int64)
        self.spot_offset = np.array([o for s in self.spots for _, o in s], dtype=np.int64)
        return self

    def proposed(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(start, item) of the places where an item would lie if one of its words is where it belongs."""
        starts, ends = word_bounds(data)
        if len(starts) == 0 or len(self.anchors) == 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        words = hash_words(data, starts, ends)
        at = np.minimum(np.searchsorted(self.anchors, words), len(self.anchors) - 1)
        hit = np.flatnonzero(self.anchors[at] == words)
        low, n = self.spot_bounds[at[hit]], self.spot_bounds[at[hit] + 1] - self.spot_bounds[at[hit]]
        flat = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        start, item = np.maximum(np.repeat(starts[hit], n) - self.spot_offset[flat], 0), self.spot_item[flat]
        pairs = np.unique(start * len(self.texts) + item)
        return pairs // len(self.texts), pairs % len(self.texts)

    def plausible(self, codes: np.ndarray, start: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether enough runs of the item stand around each place of a text with run codes ``codes``."""
        low = np.maximum(start - self.most[item], 0)
        size = np.maximum(np.minimum(start + self.sizes[item] + self.most[item] - GRAM + 1, len(codes)) - low, 0)
        need = self.sizes[item] - GRAM + 1 - GRAM * self.most[item]
        out = need <= 0
        for part in slices(len(start), size.tolist(), SIFTED):
            n, first = size[part], low[part]
            where = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            code = codes[where]
            held = self.grams[np.repeat(item[part], n), code >> 3] >> (code & 7).astype(np.uint8) & 1
            total = np.bincount(np.repeat(np.arange(len(n)), n), weights=held, minlength=len(n))
            out[part] |= total >= need[part]
        return out

    def candidates(self, windows: list[bytes]) -> list[set[int]]:
        """For each window the items that share a bucket with it."""
        out: list[set[int]] = [set() for _ in windows]
        classes = np.array([length_class(len(w)) for w in windows])
        for walk in range(WALKS):
            embedded = embed(windows, walk)
            for c in np.unique(classes).tolist():
                mine = np.flatnonzero(classes == c)
                # a window at the end of a text may be shorter than its item, so the next class is asked too
                for cls in (c, c + 1):
                    for t in range(TABLES):
                        table = self.tables.get((walk, t, cls))
                        if table is None:
                            continue
                        keys, items = table
                        got = signatures(embedded[mine], walk, t, cls)
                        low, high = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
                        for i in np.flatnonzero(high > low).tolist():
                            out[mine[i]].update(items[low[i]:high[i]])
        return out

    def matches(self, texts: list[str | None]) -> list[dict[int, tuple[int, int, int]]]:
        """For each text: item -> (edits, start, end) of its best stretch, in bytes."""
        data = [normal(t) for t in texts]
        out: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        places, codes = [], {}
        for i, d in enumerate(data):
            start, item = self.proposed(d)
            if len(start):
                runs = gram_codes(np.frombuffer(d, dtype=np.uint8))
                ok = self.plausible(runs, start, item)
                if ok.any():
                    codes[i] = runs
                    places += [(i, a, n) for a, n in sorted(set(zip(start[ok].tolist(), self.sizes[item[ok]].tolist())))]
        for at in range(0, len(places), WINDOWS):
            part = places[at:at + WINDOWS]
            found = self.candidates([data[i][a:a + n] for i, a, n in part])
            pairs = sorted({(i, a, k) for (i, a, _), items in zip(part, found) for k in items})
            for i, group in groupby(pairs, key=lambda p: p[0]):
                rows = list(group)
                start, item = (np.array([r[c] for r in rows], dtype=np.int64) for c in (1, 2))
                for j in np.flatnonzero(self.plausible(codes[i], start, item)).tolist():
                    _, a, k = rows[j]
                    most, old = int(self.most[k]), out[i].get(k)
                    if old is not None and old[0] == 0:
                        continue
                    low = max(a - most, 0)
                    hit = best_stretch(self.texts[k], data[i][low:a + len(self.texts[k]) + most], most)
                    if hit is not None:
                        new = (hit[0], hit[1] + low, hit[2] + low)
                        out[i][k] = min(old, new) if old is not None else new
        return out


def _frequencies(words: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(words) + 1, dtype=np.int64)
        for b in batches:
            n[-1] += len(b)
            for t in b["text"]:
                data = normal(t)
                mine = np.unique(hash_words(data, *word_bounds(data)))
                if len(mine) and len(words):
                    at = np.minimum(np.searchsorted(words, mine), len(words) - 1)
                    n[at[words[at] == mine]] += 1
        at = np.flatnonzero(n)
        if len(at):
            yield pd.DataFrame({"word": at, "n": n[at]})

    return run


def item_blocks(docs: DataFrame, items: DataFrame, share: float = SHARE, block: int = BLOCK_ITEMS) -> Iterator[Items]:
    """The items in blocks of bounded size, with the words that place their windows."""
    usable = items.where(F.length(F.trim("text")) > 0).select("item_id", "text")
    total = usable.count()
    for turn in range(-(-total // block)):
        of = -(-total // block)
        part = usable if of == 1 else usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(of)) == turn)
        rows = sorted(((r.item_id, normal(r.text).strip()) for r in part.collect()), key=lambda r: (r[0] is None, r[0], r[1]))
        spots: dict[int, list[tuple[int, int]]] = defaultdict(list)
        own: list[np.ndarray] = []
        for i, (_, t) in enumerate(rows):
            starts, ends = word_bounds(t)
            hashes = hash_words(t, starts, ends)
            own.append(np.unique(hashes))
            for h, s in zip(hashes.tolist(), starts.tolist()):
                spots[h].append((i, s))
        words = np.array(sorted(spots), dtype=np.uint64)
        counted = docs.select("text").transform(mapped, _frequencies(words), "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
        n = np.zeros(len(words) + 1, dtype=np.int64)
        n[counted["word"].to_numpy()] = counted["n"].to_numpy()
        rare = n[:-1] <= COMMON * n[-1]
        for mine in own:
            at = np.searchsorted(words, mine)
            # Not more than half of a short item's words: the rest are words of every document.
            rare[at[np.argsort(n[at], kind="stable")[:min(LEAST, max(len(at) // 2, 3))]]] = True
        kept = words[rare]
        yield Items([r[0] for r in rows], [r[1] for r in rows], share, kept, [spots[h] for h in kept.tolist()])


def find_items(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, start_char, end_char, edits): for each document and item within ``share``, the
    nearest stretch, in code points of the text."""
    spark = docs.sparkSession
    key, name = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {key}, item_id {name}, start_char bigint, end_char bigint, edits int"
    out = spark.createDataFrame([], schema)
    for block in item_blocks(docs, items, share):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            mine = shared.value.prepared()
            for b in batches:
                rows = []
                for doc, text, found in zip(b["doc_id"], b["text"], mine.matches(list(b["text"]))):
                    if found:
                        raw = plain_bytes(text)
                        for k, (edits, a, z) in sorted(found.items()):
                            rows.append((doc, mine.ids[k], len(raw[:a].decode("utf-8", "ignore")), len(raw[:z].decode("utf-8", "ignore")), edits))
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start_char", "end_char", "edits"])

        out = out.unionByName(docs.select("doc_id", "text").transform(mapped, run, schema))
    return out


def without_items(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns as they were."""
    out = docs
    for block in item_blocks(docs, items, share):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            mine = shared.value.prepared()
            for b in batches:
                clean = np.array([not m for m in mine.matches(list(b["text"]))], dtype=bool)
                yield b[clean]

        out = out.transform(mapped, run, docs.schema)
    return out
