"""Substring dedup by repeated-phrase automata.

A *window* is a run of ``size`` consecutive words. Windows whose word sequence starts at two or
more places of the corpus recur; every word that a recurring window covers is removed.

1. *Seeds.* Of the ``SEED``-word phrases inside a window, the one with the smallest hash is the
   window's seed: equal windows have equal seeds, and neighbouring windows mostly share one, so few
   rows stand for all windows. Seeds that occur once in the corpus are dropped by an aggregate.
2. *Segments.* The windows of one occurrence of a seed form a segment of at most ``2 * size`` words.
   Equal segments are one row with the number of their places; a task merges its own before they
   are shuffled. All windows of a segment that a task holds twice recur, so its places there are
   settled; only places of segments held once ask the shards.
3. *Automata.* Segments are dealt by seed to shards. A shard confirms which of its windows recur,
   compiles the runs of them, as passages, into Aho-Corasick automata of bounded size and streams
   all its segments through them: every occurrence is located there. A seed with very many
   different surroundings would fill one shard, so its segments are first cut into single windows,
   which are dealt by their own words; those that recur within a task are settled there.
4. The located runs go back to the texts, those of a segment together.

Equal texts are handled once, with their number, so a third of all rows may be one text.

Defined cases: words are bytes between white space (0x20, 0x09-0x0D), compared unchanged; null and
empty texts have no words; texts with fewer words than a window lose nothing; copies of a text with
at least one window lose all of it, repeated rows included; doc_id takes no part, so it may be null
or repeated; other columns are passed on (``n_words``, ``n_removed`` replace columns of that name).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.rows import mapped
from gleaner.llm.words import U64, hash_spans, hash_words, plain_bytes, run_hashes, word_bounds
from gleaner.session import cut_lineage

SEED = 8                   # words of a seed
FLUSH_ROWS = 1 << 16       # rows a task sends on at once
MERGED = 1 << 14           # segments a task merges at once
PASSAGES = 1 << 11         # segments compiled into one automaton
MANY = 4096                # different segments of a seed beyond which windows are dealt singly
_POS = U64((1 << 20) - 1)
_BLOCK = 1 << 19           # words looked at together


def window_seeds(words: np.ndarray, size: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed hash, seed position, first window, last window) of the runs of windows with one seed."""
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(len(words) - size + 1, 0), _BLOCK):
        part = words[at:at + _BLOCK + size - 1]
        grams = run_hashes(part, seed)
        low = (grams & ~_POS) | np.arange(len(grams), dtype=U64)
        have, want = 1, size - seed + 1
        while have < want:
            step = min(have, want - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        pos = (low & _POS).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(pos[1:] != pos[:-1]) + 1))
        last = np.append(first[1:], len(pos)) - 1
        out.append((grams[pos[first]], pos[first] + at, first + at, last + at))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(U64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def _words(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    data = plain_bytes(text, lower=False)
    return (data, *word_bounds(data))


def _seeds(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seed, key, first, held = [], [], [], 0
        for b in batches:
            for k, t in zip(b["key"], b["text"]):
                h, _, j, _ = window_seeds(hash_words(*_words(t)), size)
                seed.append(h.view(np.int64))
                key.append(np.full(len(h), k, dtype=np.int64))
                first.append(j.astype(np.int32))
                held += len(h)
                if held >= FLUSH_ROWS:
                    yield pd.DataFrame({"seed": np.concatenate(seed), "key": np.concatenate(key), "first": np.concatenate(first)})
                    seed, key, first, held = [], [], [], 0
        if held:
            yield pd.DataFrame({"seed": np.concatenate(seed), "key": np.concatenate(key), "first": np.concatenate(first)})

    return run


_SEGMENT = "key bigint, first int, seed bigint, segment bigint, copies bigint, words string, runs array<struct<a:int,z:int>>"


def _segments(size: int):
    """Rows of three kinds: the segments different in this task with their words (with ``seed``), the
    places of those that occur once here, whose windows may recur elsewhere (without), and for each
    text the ``runs`` of those that occur here again: all their windows recur."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _SEGMENT.split(", ")]
        seen: dict[int, list] = {}
        places: list[tuple] = []

        def out() -> Iterator[pd.DataFrame]:
            rows = [(None, None, seed, seg, n, w, None) for seg, (seed, n, w) in seen.items()]
            runs: dict[int, list[tuple[int, int]]] = {}
            for k, i, z, g in places:
                if seen[g][1] == 1:
                    rows.append((k, i, None, g, None, None, None))
                elif k in runs and i <= runs[k][-1][1]:      # a text's segments come in order
                    runs[k][-1] = (runs[k][-1][0], z)
                else:
                    runs.setdefault(k, []).append((i, z))
            rows += [(k, None, None, None, None, None, [{"a": i, "z": z} for i, z in r]) for k, r in runs.items()]
            if rows:
                f = pd.DataFrame(rows, columns=names, dtype=object)  # else numbers beside nulls turn into floats
                yield f.astype(dict.fromkeys(("key", "first", "seed", "segment", "copies"), "Int64"))

        for b in batches:
            for k, t, n, wanted in zip(b["key"], b["text"], b["copies"], b["firsts"]):
                data, starts, ends = _words(t)
                hashes = hash_words(data, starts, ends)
                seed, _, first, last = window_seeds(hashes, size)
                keep = np.isin(first, np.asarray(wanted))
                seed, first, last = seed[keep], first[keep], last[keep]
                segment = hash_spans(hashes, first, last + size).view(np.int64)
                for s, g, i, j in zip(seed.view(np.int64).tolist(), segment.tolist(), first.tolist(), (last + size).tolist()):
                    places.append((k, i, j, g))
                    known = seen.get(g)
                    if known is None:
                        seen[g] = [s, n, b" ".join(data[starts[i]:ends[j - 1]].split()).decode("utf-8", "replace")]
                    else:
                        known[1] += n
                    if len(places) >= FLUSH_ROWS or len(seen) >= MERGED:
                        yield from out()
                        places, seen = [], {}
        yield from out()

    return run


_WINDOW = "whole bigint, at int, length int, segment bigint, copies bigint, words string"


def _single_windows(size: int):
    """The windows of segments, each a segment of its own, dealt by its words.

    Windows that recur among the segments a task holds need no answer: their runs are known, and a
    single row tells the others of each. Only windows seen once there ask for their number of places.
    """
    names = [c.split()[0] for c in _WINDOW.split(", ")]

    def split(held: list[tuple[int, int, str]]) -> Iterator[pd.DataFrame]:
        texts = [w.encode("utf-8").split() for *_, w in held]
        hashes = [run_hashes(hash_words(data, *word_bounds(data)), size).view(np.int64) for data in map(b" ".join, texts)]
        copies = np.repeat(np.array([n for _, n, _ in held], dtype=np.int64), [len(h) for h in hashes])
        different, window = np.unique(np.concatenate(hashes), return_inverse=True)
        times = np.bincount(window, weights=copies, minlength=len(different)).astype(np.int64)
        told, rows, begin = np.zeros(len(different), dtype=bool), [], 0
        for (g, n, _), words, own in zip(held, texts, hashes):
            mine = window[begin:begin + len(own)]
            begin += len(own)
            recurs = np.concatenate(([False], times[mine] > 1, [False]))
            edges = np.flatnonzero(recurs[1:] != recurs[:-1]).tolist()
            rows += [(g, i, j - 1 + size - i, None, None, None) for i, j in zip(edges[0::2], edges[1::2])]
            for i in np.flatnonzero(~told[mine]).tolist():
                if not told[mine[i]]:                       # a window may come twice in a segment
                    told[mine[i]] = True
                    alone = not recurs[i + 1]
                    rows.append((g if alone else None, i if alone else None, None, int(own[i]), int(times[mine[i]]), b" ".join(words[i:i + size]).decode("utf-8")))
            if len(rows) >= FLUSH_ROWS:
                yield frame(rows)
                rows = []
        if rows:
            yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names, dtype=object).astype(dict.fromkeys(names[:-1], "Int64"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, int, str]] = []
        for b in batches:
            for row in zip(b["segment"], b["copies"], b["words"]):
                held.append(row)
                if len(held) >= MERGED:
                    yield from split(held)
                    held = []
        if held:
            yield from split(held)

    return run


def locate(segments: list[tuple[int, int, str]], size: int) -> Iterator[tuple[int, int, int]]:
    """(segment, first word, words) of the recurring runs in (segment, number of places, words).

    All segments of the seeds concerned must be given. Words become single characters, so a window
    is a string of ``size`` characters and the automaton has one node a word.
    """
    letters: dict[str, str] = {}

    def letter(w: str) -> str:
        c = letters.get(w)
        if c is None:
            i = len(letters) + 1
            c = letters[w] = chr(i if i < 0xD800 else i + 0x800)
        return c

    coded = [(g, n, "".join(map(letter, w.split(" ")))) for g, n, w in segments]
    places: dict[str, int] = defaultdict(int)
    for _, n, s in coded:
        for i in range(len(s) - size + 1):
            places[s[i:i + size]] += n
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for _, _, s in coded:
        begin = None
        for i in range(len(s) - size + 2):
            recurs = i <= len(s) - size and places[s[i:i + size]] > 1
            if recurs and begin is None:
                begin = i
            elif not recurs and begin is not None:
                automaton.add_word(s[begin:i - 1 + size])
                begin = None
    if len(automaton) == 0:
        return
    automaton.make_automaton()
    for g, _, s in coded:
        covered = sorted((end - length + 1, end + 1) for end, length in automaton.iter(s))
        while covered:
            a, z = covered.pop(0)
            while covered and covered[0][0] <= z:
                z = max(z, covered.pop(0)[1])
            yield g, a, z - a


def _automata(size: int):
    """Streams segments sorted by (seed, segment) through automata of some thousand segments each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, int, str]] = []
        seed = last = None

        def done() -> Iterator[pd.DataFrame]:
            rows = list(locate(held, size))
            if rows:
                yield pd.DataFrame(rows, columns=["segment", "at", "length"])

        for b in batches:
            for s, g, n, w in zip(b["seed"], b["segment"], b["copies"], b["words"]):
                if s != seed and len(held) >= PASSAGES:
                    yield from done()
                    held = []
                if s == seed and g == last:
                    held[-1] = (g, held[-1][1] + n, held[-1][2])
                else:
                    held.append((g, n, w))
                seed, last = s, g
        if held:
            yield from done()

    return run


def _cut(size: int, others: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept, total, gone = [], [], []
            for t, runs in zip(b["text"], b["runs"]):
                words = plain_bytes(t, lower=False).split()
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                for r in (runs if runs is not None else ()):
                    cover[r["a"]] += 1
                    cover[r["z"]] -= 1
                stays = np.cumsum(cover)[:-1] == 0
                total.append(len(words))
                gone.append(int(len(words) - stays.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(stays)] if gone[-1] else words).decode("utf-8"))
            out = b[others].reset_index(drop=True)
            out["kept"], out["n_words"], out["n_removed"] = kept, total, gone
            yield out

    return run


def recurring_runs(docs: DataFrame, size: int) -> DataFrame:
    """(key, runs): for the texts (by ``xxhash64``) with recurring windows, where these lie, in words."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("key"), "text")
    seeds = cut_lineage(texts.transform(mapped, _seeds(size), "seed bigint, key bigint, first int"), "repeat-seeds")
    twice = seeds.groupBy("seed").agg(F.count("*").alias("c")).where("c > 1").select("seed")
    wanted = (seeds.join(twice, "seed", "left_semi").groupBy("key").agg(F.collect_set("first").alias("firsts")))
    distinct = texts.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    found = cut_lineage(distinct.join(wanted, "key").transform(mapped, _segments(size), _SEGMENT), "repeat-segments")

    segments = found.where("seed IS NOT NULL").select("seed", "segment", "copies", "words")
    many = segments.groupBy("seed").agg(F.approx_count_distinct("segment").alias("c")).where(F.col("c") > MANY).select("seed")
    hot = segments.join(many, "seed", "left_semi").groupBy("segment").agg(F.sum("copies").alias("copies"), F.first("words").alias("words"))
    windows = cut_lineage(hot.transform(mapped, _single_windows(size), _WINDOW), "repeat-windows")
    single = windows.where("length IS NULL").groupBy("segment").agg(F.sum("copies").alias("copies"), F.first("words").alias("words")).select(F.col("segment").alias("seed"), "segment", "copies", "words")
    shards = segments.join(many, "seed", "left_anti").unionByName(single)
    located = (shards.repartition(n, "seed").sortWithinPartitions("seed", "segment")
               .transform(mapped, _automata(size), "segment bigint, at int, length int"))
    located = cut_lineage(located, "repeat-located")

    known = windows.where("length IS NOT NULL").select(F.col("whole").alias("segment"), "at", "length")
    asked = windows.where("length IS NULL AND whole IS NOT NULL").select("whole", F.col("at").alias("from"), "segment")
    told = asked.join(located, "segment").select(F.col("whole").alias("segment"), F.col("from").alias("at"), "length")
    # One row a segment, so that a place meets one row, however many runs its segment has.
    of_segment = located.unionByName(known).unionByName(told).groupBy("segment").agg(F.collect_list(F.struct("at", "length")).alias("found"))
    places = found.where("first IS NOT NULL").select("key", "first", "segment")
    asked_runs = places.join(of_segment, "segment").select("key", F.transform("found", lambda r: F.struct((F.col("first") + r.at).alias("a"), (F.col("first") + r.at + r.length).alias("z"))).alias("runs"))
    return (asked_runs.unionByName(found.where("runs IS NOT NULL").select("key", "runs"))
            .groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs")))


def remove_repeats(docs: DataFrame, size: int) -> DataFrame:
    """``docs`` without ``text``, with ``kept`` (the kept words joined by one space), ``n_words``, ``n_removed``."""
    docs = docs.drop("n_words", "n_removed", "kept", "runs")
    others = [c for c in docs.columns if c != "text"]
    runs = recurring_runs(docs, size).withColumnRenamed("key", "_key")
    joined = docs.join(runs, F.xxhash64("text") == F.col("_key"), "left").select(*docs.columns, "runs")
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != "text"), T.StructField("kept", T.StringType()),
                           T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.transform(mapped, _cut(size, others), schema)


def strip_repeats(docs: DataFrame, size: int = 35) -> DataFrame:
    """The rows of ``docs``, columns as they were; texts that repeat a passage hold only their kept
    words, joined by one space (``n_chars``, if there, follows), other texts are untouched."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("text"))
    cut = remove_repeats(plain, size)
    old = {c: F.col(n) for c, n in names.items()}
    changed = F.col("n_removed") > 0
    old["text"] = F.when(changed, F.col("kept")).otherwise(old["text"])
    if "n_chars" in old:
        old["n_chars"] = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(old["n_chars"])
    return cut.select(*[v.alias(c) for c, v in old.items()])
