"""LM scoring with an Elias-Fano n-gram trie (words and their successors).

*Counting.* Every token is one record: the word before it, the token itself and the one after it. Tasks
merge their records and send, for every shard, one compressed block: words with the words that follow
them, and those with the words that follow in turn. So a word pair is sent and stored once, as successor
in the first level and as context of the second. No row stands for a single n-gram, and a frequent one is
added up before it is shuffled. A shard holds all n-grams of its first words; those of very frequent first
words are dealt by their second word too, and a small exchange adds such words' totals up. A bounded
sample of openings tells which words are frequent: these travel as two bytes instead of five. It
decides on balance and block size only; every text is counted whole.

*Trie.* Shards hold ascending ranges of context hashes. The first level is the Elias-Fano sequence of the
shard's words, a monotone Elias-Fano sequence of pointers to where the successors of each begin, and the
successors, ascending within each range, as hashes relative to the context, with their number in one byte
(numbers from 255 on stand in a list of their own). With ``order`` 3 the second level hangs under the
positions of the first: pointers from each successor to the range of its own successors, and those with
their discounted probability in one byte (bins of its logarithm). A successor is searched within its
context's range only.
N-grams seen less than ``least`` times are left to the lower level, as their mass is:
P(w | h) = max(c(h, w) - D, 0) / c(h) + rest(h) * P(w | shorter h), P(w) = (c + 1) / (N + V + 1), where rest(h) is
what the kept successors leave, so the probabilities of a context sum to one up to the bins' width. A
text's first token has the end as its only context.

*Use.* Every shard is a file that its task writes to the shared folder; tasks that score map it into memory
from there, so only the pages that are looked up are read. Shards in a store that cannot be mapped are
copied by the executor that needs them. Nothing of the model passes the driver. The model
grows with the corpus; the number of shards is a parameter.

Defined cases: tokens are words between white space, A-Z in lower case, and one end, also for null and
empty texts; the context of the first token is the end; without training texts N = V = 0 and both
scores are those of unknown tokens; repeated rows count and are scored one by one; null doc_ids
hash as empty text; other columns are ignored.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.elias_fano import EliasFano
from gleaner.llm.folds import in_fold
from gleaner.llm.rows import mapped
from gleaner.llm.words import mix, words_of
from gleaner.session import scratch_path

U64 = np.uint64
END = U64(0x5EED0FE2D0C0DE01)          # the hash of the end token
RELATIVE = 40                          # bits of a successor relative to its context
DISCOUNT, LEAST_COUNT = 0.75, 2
LOWEST = -8.0                          # log10 of the smallest binned probability
COUNTED = 1 << 20                      # tokens counted or looked up together in a task
ID = 21                                # bits of a word's number among those
CODED = 1 << 15                        # frequent words that travel as two bytes
OPENINGS, OPENING = 512, 4096          # texts and characters looked at to find these
RARE, LAST = 0, 0xFFFF                 # codes of other words, and of nothing after the end
_BLOCK = "shard int, payload binary"
_TOTAL = "word bigint, tokens bigint, mass double, words bigint"


def tokens_of(text: str | None) -> np.ndarray:
    return np.append(words_of(text), END)


def relative(context: np.ndarray, successor: np.ndarray) -> np.ndarray:
    return mix(context * U64(0xD6E8FEB86659FD93) ^ successor) >> U64(64 - RELATIVE)


def _save(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after the other, each on an 8-byte boundary, behind a table of what they are."""
    head, body = [len(arrays)], []
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        head += [np.dtype(a.dtype).num, len(a)]
        body.append(raw + b"\0" * (-len(raw) % 8))
    return np.array(head, dtype=np.int64).tobytes() + b"".join(body)


_KINDS = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.uint32, np.int64, np.uint64)}


def _load(raw: np.ndarray) -> Iterator[np.ndarray]:
    """The arrays in ``raw`` (bytes, maybe memory-mapped), as views."""
    n = int(raw[:8].view(np.int64)[0])
    head = raw[8:8 + 16 * n].view(np.int64)
    at = 8 + 16 * n
    for i in range(n):
        kind, size = _KINDS[int(head[2 * i])], int(head[2 * i + 1])
        yield raw[at:at + size * kind.itemsize].view(kind)
        at += -(-size * kind.itemsize // 8) * 8


def shards_of(first: np.ndarray, second: np.ndarray, bits: int, hot: np.ndarray) -> np.ndarray:
    """Shards of n-grams by their first word, those of ``hot`` words by both."""
    split = np.isin(first, hot)
    both = np.where(split, mix(first * U64(0xA0761D6478BD642F) ^ second), first)
    return (both >> U64(64 - bits)).astype(np.int64)


def _joined(context: np.ndarray, rel: np.ndarray) -> np.ndarray:
    """(place of a context, relative successor) as one number."""
    if len(context) and int(context.max()) >> 64 - RELATIVE:
        raise ValueError("too many word pairs in a shard: raise spark.sql.shuffle.partitions")
    return context.astype(U64) << U64(RELATIVE) | rel


def _planes(values: np.ndarray, size: int) -> np.ndarray:
    """The low ``size`` bytes of each number, those of equal worth together."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :size].T).ravel()


def _unplaned(planes: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(planes) // size, 8), dtype=np.uint8)
    out[:, :size] = planes.reshape(size, -1).T
    return out.view(U64).ravel()


def _bytes(rel: np.ndarray) -> np.ndarray:
    """Relative successors, ``RELATIVE`` // 8 bytes each."""
    return np.ascontiguousarray(rel.view(np.uint8).reshape(-1, 8)[:, :RELATIVE // 8]).ravel()


def _relatives(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros((len(at), 8), dtype=np.uint8)
    out[:, :RELATIVE // 8] = raw.reshape(-1, RELATIVE // 8)[at]
    return out.view(U64).ravel()


def _small(values: np.ndarray) -> list[np.ndarray]:
    """Numbers as bytes; those from 255 on follow."""
    return [np.minimum(values, 255).astype(np.uint8), values[values >= 255].astype(np.uint32)]


def _unsmall(arrays: Iterator[np.ndarray]) -> np.ndarray:
    out = next(arrays).astype(np.int64)
    out[out == 255] = next(arrays)
    return out


def _coded(codes: np.ndarray, context: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    """Words as codes, the rare ones' relative hashes behind them."""
    rare = codes == RARE
    return [_planes(codes.astype(U64), 2), _planes(relative(context[rare], word[rare]), RELATIVE // 8)]


def _uncoded(arrays: Iterator[np.ndarray], frequent: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, hashes relative to the contexts)."""
    codes, rare = _unplaned(next(arrays), 2).astype(np.int64), _unplaned(next(arrays), RELATIVE // 8)
    out = np.zeros(len(codes), dtype=U64)
    common = (codes != RARE) & (codes != LAST)
    out[common] = relative(context[common], frequent[codes[common] - 1])
    out[codes == RARE] = rare
    return codes, out


def _begins(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)


def _count(bits: int, order: int, hot: np.ndarray, frequent: np.ndarray):
    ranks = np.argsort(frequent, kind="stable")
    ascending = frequent[ranks]
    mask = U64((1 << ID) - 1)

    def blocks(before: np.ndarray, tokens: np.ndarray, after: np.ndarray) -> pd.DataFrame:
        words, ids = np.unique(np.concatenate((before[:1], tokens, after[-1:])), return_inverse=True)
        ids = ids.astype(U64)
        codes = np.full(len(words), RARE, dtype=np.int64)
        if len(ascending):
            at = np.minimum(np.searchsorted(ascending, words), len(ascending) - 1)
            same = ascending[at] == words
            codes[same] = ranks[at[same]] + 1
        first, token = ids[:len(tokens)], ids[1:len(tokens) + 1]
        grams = (first << U64(2 * ID)) | (token << U64(ID))
        if order > 2:
            grams |= ids[2:]
            grams[tokens == END] |= mask                    # the end has no successor
        grams, seen = np.unique(grams, return_counts=True)
        begin = _begins(grams >> U64(ID))
        a, b = words[(grams[begin] >> U64(2 * ID)).astype(np.int64)], (grams[begin] >> U64(ID) & mask).astype(np.int64)
        shard = shards_of(a, words[b], bits, hot)
        size = np.diff(np.append(begin, len(grams)))
        of_gram = np.repeat(shard, size)
        pairs, rows = np.argsort(shard, kind="stable"), np.argsort(of_gram, kind="stable")
        cut_pairs, cut_rows = (np.searchsorted(x, np.arange((1 << bits) + 1)) for x in (shard[pairs], of_gram[rows]))
        gram_a = np.repeat(a, size)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        out = []
        for s in range(1 << bits):
            p, r = pairs[cut_pairs[s]:cut_pairs[s + 1]], rows[cut_rows[s]:cut_rows[s + 1]]
            if not len(p):
                continue
            starts = _begins(a[p])
            contexts = a[p][starts]
            arrays = [_planes(np.diff(contexts, prepend=U64(0)), 8), *_small(np.diff(np.append(starts, len(p)))), *_coded(codes[b[p]], a[p], words[b[p]]), *_small(seen[r])]
            if order > 2:
                c = (grams[r] & mask).astype(np.int64)
                last = c == int(mask)
                c[last] = 0
                arrays += [*_small(size[p]), *_coded(np.where(last, LAST, codes[c]), gram_a[r], words[c])]
            out.append((s, squeeze(_save(arrays))))
        return pd.DataFrame(out, columns=["shard", "payload"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        total = 0

        def out() -> Iterator[pd.DataFrame]:
            flat = np.concatenate(held)
            around = np.concatenate((flat[-1:], flat, flat[:1]))       # every text ends with END, the context of the next one's first token
            for i in range(0, len(flat), COUNTED):
                z = min(i + COUNTED, len(flat))
                yield blocks(around[i:z], around[i + 1:z + 1], around[i + 2:z + 2])

        for b in batches:
            for t in b["text"]:
                held.append(tokens_of(t))
                total += len(held[-1])
                if total >= COUNTED:
                    yield from out()
                    held, total = [], 0
        if held:
            yield from out()

    return run


def _added(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = _begins(keys)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def binned(p: np.ndarray) -> np.ndarray:
    """One byte for a probability: equal bins of its logarithm."""
    return np.clip(np.rint(255 * (1 - np.log10(np.maximum(p, 10.0 ** LOWEST)) / LOWEST)), 0, 255).astype(np.uint8)


def unbinned(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (LOWEST * (1 - code / 255.0))


def shard_arrays(contexts: np.ndarray, pairs: np.ndarray, seen: np.ndarray, grams: np.ndarray, times: np.ndarray, order: int, least: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The levels of a shard from its words, its pairs as (place of the word, relative successor) and its triples
    as (place of the pair, relative successor), each with their numbers; also the words' counts and kept mass."""
    context = (pairs >> U64(RELATIVE)).astype(np.int64)
    total = np.bincount(context, weights=seen, minlength=len(contexts)).astype(np.int64)
    keep = seen >= least
    mass = np.bincount(context[keep], weights=seen[keep] - DISCOUNT, minlength=len(contexts))
    kept = np.cumsum(keep) - 1
    begins = np.searchsorted(context[keep], np.arange(len(contexts) + 1))
    arrays = [*EliasFano.encode(contexts, 1 << 64).arrays(), total, binned(np.clip(1 - mass / total, 10.0 ** LOWEST, 1.0)),
              *EliasFano.encode(begins, int(keep.sum()) + 1).arrays(), _bytes(pairs[keep]), np.minimum(seen[keep], 255).astype(np.uint8)]
    often = np.flatnonzero(seen[keep] >= 255)
    arrays += [often, seen[keep][often]]
    if order > 2:
        # A triple is not seen more often than its pair, so kept triples have kept pairs.
        whole = seen[keep]
        enough = times >= least
        grams, times = grams[enough], times[enough]
        of = kept[(grams >> U64(RELATIVE)).astype(np.int64)]
        part = (times - DISCOUNT) / whole[of]
        rest = 1 - np.bincount(of, weights=part, minlength=len(whole))
        begins = np.searchsorted(of, np.arange(len(whole) + 1))
        arrays += [binned(np.clip(rest, 10.0 ** LOWEST, 1.0)), *EliasFano.encode(begins, len(grams) + 1).arrays(), _bytes(grams), binned(part)]
    return arrays, total, mass


class Level:
    """Pointers from contexts to their successors, and the successors, of one shard."""

    def __init__(self, arrays: Iterator[np.ndarray]) -> None:
        self.rest = next(arrays)
        self.pointers, self.successors, self.part = EliasFano.of(arrays), next(arrays), next(arrays)

    def find(self, context: np.ndarray, rel: np.ndarray) -> np.ndarray:
        """Index of each successor of the contexts at these places (equal ones together), or -1."""
        first = _begins(context)
        times = np.diff(np.append(first, len(context)))
        low, end = (np.repeat(self.pointers.at(context[first] + i), times) for i in (0, 1))
        high = end.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            less = _relatives(self.successors, mid) < rel[open_]
            low[open_[less]], high[open_[~less]] = mid[less] + 1, mid[~less]
        hit = np.flatnonzero(low < end)
        out = np.full(len(rel), -1, dtype=np.int64)
        same = hit[_relatives(self.successors, low[hit]) == rel[hit]]
        out[same] = low[same]
        return out


class Shard:
    """The words of a shard with their counts, and the levels."""

    def __init__(self, arrays: Iterator[np.ndarray], order: int) -> None:
        self.contexts, self.times = EliasFano.of(arrays), next(arrays)
        self.levels = [Level(arrays)]
        self.often, self.many = next(arrays), next(arrays)
        self.levels += [Level(arrays) for _ in range(order - 2)]

    def seen(self, pair: np.ndarray) -> np.ndarray:
        """How often the pairs at these places were counted."""
        out = self.levels[0].part[pair].astype(np.int64)
        often = out == 255
        out[often] = self.many[np.searchsorted(self.often, pair[often])]
        return out


def _shard_file(folder: str, shard: int) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(folder)
    return store, f"{path}/{shard}.levels"


def _merge(folder: str, order: int, least: int, hot: np.ndarray, frequent: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, blocks = None, []

        def done() -> Iterator[pd.DataFrame]:
            contexts = np.unique(np.concatenate([words for words, *_ in blocks]))
            pairs = np.concatenate([_joined(np.repeat(np.searchsorted(contexts, words), followers), rel) for words, followers, rel, *_ in blocks])
            pairs, place = np.unique(pairs, return_inverse=True)
            numbers = np.concatenate([n for *_, n in blocks])
            if order > 2:
                of = np.repeat(place, np.concatenate([size for _, _, _, size, *_ in blocks]))
                seen = np.bincount(of, weights=numbers, minlength=len(pairs)).astype(np.int64)
                goes_on, after = (np.concatenate([b[i] for b in blocks]) for i in (4, 5))
                grams, times = _added(_joined(of[goes_on], after[goes_on]), numbers[goes_on])
            else:
                seen, grams, times = np.bincount(place, weights=numbers, minlength=len(pairs)).astype(np.int64), None, None
            blocks.clear()
            arrays, total, mass = shard_arrays(contexts, pairs, seen, grams, times, order, least)
            store, path = _shard_file(folder, shard)
            own = f"{path}.{uuid.uuid4().hex}"            # a task that runs twice never leaves half a file
            store.create_dir(path.rsplit("/", 1)[0])
            with store.open_output_stream(own) as f:
                f.write(_save(arrays))
            store.move(own, path)
            split = np.isin(contexts, hot)
            rows = [(None, int(total[~split].sum()), 0.0, int((~split).sum()))]
            rows += list(zip(contexts[split].view(np.int64).tolist(), total[split].tolist(), mass[split].tolist(), [1] * int(split.sum())))
            yield pd.DataFrame(rows, columns=["word", "tokens", "mass", "words"], dtype=object).astype({"word": "Int64", "tokens": "Int64", "mass": float, "words": "Int64"})

        grow = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for s, raw in zip(b["shard"], b["payload"]):
                if shard is not None and s != shard:
                    yield from done()
                    blocks = []
                shard = int(s)
                arrays = _load(np.frombuffer(grow(raw), dtype=np.uint8))
                words = np.cumsum(_unplaned(next(arrays), 8), dtype=U64)
                followers = _unsmall(arrays)
                context = np.repeat(words, followers)
                _, rel = _uncoded(arrays, frequent, context)
                numbers = _unsmall(arrays)
                if order > 2:
                    size = _unsmall(arrays)
                    codes, c = _uncoded(arrays, frequent, np.repeat(context, size))
                    blocks.append((words, followers, rel, size, codes != LAST, c, numbers))
                else:
                    blocks.append((words, followers, rel, numbers))
        if shard is not None:
            yield from done()

    return run


@cache
def _mapped_shard(folder: str, shard: int, order: int) -> Shard | None:
    """A shard as memory-mapped arrays; none if no context is in it."""
    store, path = _shard_file(folder, shard)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    if not isinstance(store, fs.LocalFileSystem):
        local = f"{tempfile.mkdtemp()}/{shard}.levels"
        fs.copy_files(path, local, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
        path = local
    return Shard(_load(np.memmap(path, dtype=np.uint8, mode="r")), order)


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (first, second) of numbers below 2^32, ascending, and which of them each is."""
    keys, which = np.unique(first.astype(U64) << U64(32) | second.astype(U64), return_inverse=True)
    return (keys >> U64(32)).astype(np.int64), (keys & U64(0xFFFFFFFF)).astype(np.int64), which


class Model:
    """Look-ups of many n-grams at once."""

    def __init__(self, folder: str, order: int, bits: int, tokens: int, words: int, hot: list[tuple[int, int, float]]) -> None:
        self.folder, self.order, self.bits, self.tokens, self.words = folder, order, bits, tokens, words
        known = sorted((w & (1 << 64) - 1, n, m) for w, n, m in hot)
        self.hot = np.array([w for w, *_ in known], dtype=U64)
        self.hot_times, self.hot_mass = np.array([n for _, n, _ in known], dtype=np.int64), np.array([m for *_, m in known])

    def _by_shard(self, shard: np.ndarray) -> Iterator[tuple[Shard, np.ndarray]]:
        order = np.argsort(shard, kind="stable")
        cut = _begins(shard[order])
        for a, z in zip(cut, [*cut[1:], len(order)]):
            mine = _mapped_shard(self.folder, int(shard[order[a]]), self.order)
            if mine is not None:
                yield mine, order[a:z]

    def _words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, what is left to the lower level, place in the shard or -1) of ascending words. Frequent ones lie in
        many shards, so they have no place here."""
        count, left, place = np.zeros(len(words), dtype=np.int64), np.ones(len(words)), np.full(len(words), -1, dtype=np.int64)
        split = np.isin(words, self.hot)
        own = np.searchsorted(self.hot, words[split])
        count[split], left[split] = self.hot_times[own], unbinned(binned(np.clip(1 - self.hot_mass[own] / self.hot_times[own], 10.0 ** LOWEST, 1.0)))
        rest = np.flatnonzero(~split)
        for shard, mine in self._by_shard(shards_of(words[rest], words[rest], self.bits, self.hot)):
            mine = rest[mine]
            found = shard.contexts.find(words[mine])
            mine, found = mine[found >= 0], found[found >= 0]
            count[mine], left[mine], place[mine] = shard.times[found], unbinned(shard.levels[0].rest[found]), found
        return count, left, place

    def scores(self, texts: list[np.ndarray]) -> pd.DataFrame:
        """n_tokens, n_known, base_score, score of token arrays."""
        size = np.array([len(t) for t in texts])
        flat = np.concatenate(texts)
        begin = np.cumsum(size) - size
        words, token = np.unique(flat, return_inverse=True)
        count, left, place = self._words(words)
        lower = ((count + 1) / (self.tokens + self.words + 1))[token]
        end = int(np.searchsorted(words, END))
        before = np.append(end, token[:-1])
        a, b, pair = _distinct(before, token)
        shards = shards_of(words[a], words[b], self.bits, self.hot)
        own, pair_place = np.zeros(len(a)), np.full(len(a), -1, dtype=np.int64)
        split = np.isin(words[a], self.hot)
        for shard, mine in self._by_shard(shards):
            at = place[a[mine]]
            if (some := np.flatnonzero(split[mine])).size:
                first = _begins(a[mine[some]])
                found = shard.contexts.find(words[a[mine[some[first]]]])
                at[some] = np.repeat(found, np.diff(np.append(first, len(some))))
            mine, at = mine[at >= 0], at[at >= 0]
            found = shard.levels[0].find(at, relative(words[a[mine]], words[b[mine]]))
            mine, found = mine[found >= 0], found[found >= 0]
            own[mine] = unbinned(binned((shard.seen(found) - DISCOUNT) / count[a[mine]]))
            pair_place[mine] = found
        p = own[pair] + left[before] * lower
        if self.order > 2:
            at = np.flatnonzero(before != end)
            context, successor, gram = _distinct(pair[at - 1], token[at])
            own, left = np.zeros(len(context)), np.ones(len(context))
            known = np.flatnonzero(pair_place[context] >= 0)
            for shard, mine in self._by_shard(shards[context[known]]):
                mine = known[mine]
                of = pair_place[context[mine]]
                left[mine] = unbinned(shard.levels[1].rest[of])
                found = shard.levels[1].find(of, relative(words[a[context[mine]]], words[successor[mine]]))
                own[mine[found >= 0]] = unbinned(shard.levels[1].part[found[found >= 0]])
            p[at] = own[gram] + left[gram] * p[at]
        return pd.DataFrame({"n_tokens": size, "n_known": np.add.reduceat((count > 0)[token].astype(np.int64), begin),
                             "base_score": np.add.reduceat(np.log10(lower), begin), "score": np.add.reduceat(np.log10(p), begin)})


def common_words(docs: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(words that make up a quarter of a shard or more, words that travel as codes), from openings of some texts."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(16)) == 0).select(F.substring("text", 1, OPENING)).limit(OPENINGS).collect()
    if not some:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=U64)
    words, seen = np.unique(np.concatenate([tokens_of(t) for t, in some]), return_counts=True)
    ranks = np.argsort(-seen, kind="stable")
    words, seen = words[ranks], seen[ranks]
    return np.sort(words[seen * (4 << bits) > seen.sum()]), words[seen > 1][:CODED]


def train(docs: DataFrame, order: int = 2, least: int = LEAST_COUNT) -> tuple[str, int, int, int, int, list[tuple[int, int, float]]]:
    """(folder, order, shard bits, N, V, totals of frequent words) of a model of all rows of ``docs`` in the shared folder."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max((n - 1).bit_length(), 1)
    folder = scratch_path(spark, "language-model")
    hot, frequent = common_words(docs, bits)
    blocks = docs.select("text").transform(mapped, _count(bits, order, hot, frequent), _BLOCK).repartition(n, "shard").sortWithinPartitions("shard")
    merged = blocks.transform(mapped, _merge(folder, order, least, hot, frequent), _TOTAL)
    total = merged.groupBy("word").agg(F.sum("tokens"), F.sum("mass"), F.sum("words")).collect()     # one row, and one for each frequent word
    split = [(w, n, m) for w, n, m, _ in total if w is not None]
    return folder, order, bits, sum(n for _, n, *_ in total), len(split) + sum(v for w, *_, v in total if w is None), split


def score(docs: DataFrame, model: tuple[str, int, int, int, int, list[tuple[int, int, float]]]) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) of every row."""
    folder, order, bits, tokens, words, hot = model
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Model(folder, order, bits, tokens, words, hot)
        held, keys, total = [], [], 0

        def done() -> pd.DataFrame:
            out = trie.scores(held)
            out.insert(0, "doc_id", pd.concat(keys).array)
            out["train_tokens"] = tokens
            return out

        for b in batches:
            held += [tokens_of(t) for t in b["text"]]
            keys.append(b["doc_id"])
            total += sum(map(len, held[len(held) - len(b):]))
            if total >= COUNTED:
                yield done()
                held, keys, total = [], [], 0
        if held:
            yield done()

    return docs.select("doc_id", "text").transform(
        mapped, run, f"doc_id {key}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def score_held_out(docs: DataFrame, folds: int = 7, fold: int = 2, order: int = 2, least: int = LEAST_COUNT) -> DataFrame:
    """Scores of all rows by a model of those outside the fold; ``held_out`` marks the fold."""
    held = in_fold(F.col("doc_id"), folds, fold)
    scored = score(docs, train(docs.where(~held), order, least))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
