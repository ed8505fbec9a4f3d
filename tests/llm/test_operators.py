"""The ten operators against brute force, library results and hard cases (nulls, empties, long texts, ties, repeats)."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import (
    bpe,
    decontaminate,
    language_model,
    licenses,
    ngram_join,
    quality,
    repeats,
    spots,
    token_file,
    toxicity,
)
from gleaner.llm.elias_fano import EliasFano
from gleaner.llm.pretokens import code_points, piece_starts
from gleaner.llm.queries import QUERIES
from gleaner.llm.words import hash_words, plain_bytes, run_hashes, word_bounds, words_of

SF = "/root/testdata/sf0.001"
BPE, FILE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ODD = "ab 's'tredlvm  \n\t\r\x1c\x1d\x85\xa0 　1²٣é漢字-!.'"
# null id, null text, empty and blank texts, repeated rows, repeated ids, a long word, a long text
HARD = [(None, "no id at all here"), (1, None), (2, ""), (3, " \n\t "), (4, "a b c d e f g"), (4, "a b c d e f g"), (4, "other text of four"),
        (5, "x" * 9000 + " y"), (6, "word and the next " * 4000), (7, "A B C D E F G"), (8, "ä漢\U0001f600 é's 12  3"), (9, "don't we'll 'tis")]


@pytest.fixture(scope="module")
def hard(spark):
    """Also with extra columns whose names the operators use themselves."""
    names = ("ids", "kept", "key", "score", "runs", "n_words", "stats", "start", "a", "slot", "row", "part")
    df = spark.createDataFrame(HARD, "doc_id bigint, text string")
    return df.withColumns({n: F.lit(i) for i, n in enumerate(names)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(10)] + [(None, 1, 1), (3, None, None), (4, 1, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# words ---------------------------------------------------------------------------------------------------------------

def test_words_and_their_hashes():
    for text in ("", " a  b\x0b\x0cc ", "a\x1cb \x85c", "x" * 10_000 + " y", "w " * 200_000):
        data = plain_bytes(text)
        starts, ends = word_bounds(data)
        assert [data[a:b] for a, b in zip(starts, ends)] == data.split()
    a, b = words_of("one TWO one"), words_of("zero two one")
    assert a[0] == a[2] and a[1] == b[1] and a[0] == b[2] and len({*a.tolist(), *b.tolist()}) == 3
    many = words_of(" ".join(map(str, range(600_000))))
    assert len(np.unique(many)) == 600_000
    for k in (3, 20):
        assert len(np.unique(run_hashes(many, k))) == 600_000 - k + 1
        assert run_hashes(many[299_990:300_030], k)[3] == run_hashes(many, k)[299_993]


# 1: n-gram join ------------------------------------------------------------------------------------------------------

def components_by_force(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and None not in (rows[i][0], rows[j][0]) and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                up[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    return sorted(((d, len(s), None if d is None else min(least[root(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize(("k", "percent", "rounds"), [(3, 90, 3), (2, 60, 0)])
def test_join_equals_brute_force(spark, monkeypatch, k, percent, rounds):
    monkeypatch.setattr(ngram_join, "HUB_ROUNDS", rounds)
    rnd = random.Random(k)
    rows = [r for r in HARD if r[0] != 4]
    for _ in range(12):                                   # families of near copies, chains among them
        base = [rnd.choice("abcdefghijklmnopqrstuvw") * rnd.randint(1, 3) for _ in range(rnd.randint(3, 60))]
        for _ in range(rnd.randint(1, 8)):
            rows.append((100 + len(rows), " ".join(base)))
            if rnd.random() < 0.8:
                base = base.copy()
                base[rnd.randrange(len(base))] = str(rnd.random())
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), k, percent)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == components_by_force(rows, k, percent)


def test_bucket_counts_are_document_counts(spark, hard):
    counts = ngram_join.bucket_counts(hard.where("doc_id IS NOT NULL").repartition(5), 2)
    want = np.zeros(ngram_join.BUCKETS, dtype=np.int64)
    for d, t in HARD:
        if d is not None:
            np.add.at(want, ngram_join._bucket(ngram_join.shingle_set(t, 2), len(want)), 1)
    assert (counts == want).all() and counts.sum() > 0


def test_join_hard_cases(hard, none):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(hard, 3, 90).collect()]
    assert len(got) == len(HARD) and got.count((4, 5, 4)) == 2 and (7, 5, 4) in got and (1, 0, 1) in got and (None, 3, None) in got
    assert ngram_join.keep_one(hard.withColumn("_stays", F.lit(1)), 3, 90).columns == [*hard.columns, "_stays"]
    kept = ngram_join.keep_one(hard, 3, 90)
    assert kept.columns == hard.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, (None, 1, 2, 3, 4, 5, 6, 8, 9)))
    assert ngram_join.jaccard_components(none, 3, 90).count() == 0


def test_suffix_filter_never_loses_a_link(spark):
    rnd = np.random.default_rng(2)
    rows = []
    for _ in range(200):
        a = np.unique(rnd.integers(0, 1 << 63, size=int(rnd.integers(1, 200)), dtype=np.uint64))
        b = np.unique(np.concatenate((a[rnd.random(len(a)) < 0.95], rnd.integers(0, 1 << 63, size=3, dtype=np.uint64))))
        rows.append((a, b))
    sums = lambda r: [int(x) for x in r.reshape(-1, ngram_join.COARSE).sum(axis=1)]
    df = spark.createDataFrame([(i, len(a), len(b), ngram_join.ranges(a).tolist(), ngram_join.ranges(b).tolist(), sums(ngram_join.ranges(a)), sums(ngram_join.ranges(b)))
                                for i, (a, b) in enumerate(rows)],
                               "i int, n int, n2 int, ranges array<int>, ranges2 array<int>, coarse array<int>, coarse2 array<int>")
    passed = {r.i for r in df.where(ngram_join.suffix_filter(90)).collect()}
    linked = {i for i, (a, b) in enumerate(rows) if ngram_join.linked(a.tobytes(), b.tobytes(), 90)}
    assert linked and linked <= passed


def test_sketches_and_small_ranges_never_lose_a_link(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for i in range(200):
        a = np.unique(rnd.integers(0, 1 << 63, size=int(rnd.integers(1, 60_000 if i % 50 == 0 else 300)), dtype=np.uint64))
        b = np.unique(np.concatenate((a[rnd.random(len(a)) < 0.95], rnd.integers(0, 1 << 63, size=3, dtype=np.uint64))))
        rows.append((a, b if i % 2 else np.unique(rnd.integers(0, 1 << 63, size=len(a), dtype=np.uint64))))
    sides = []
    for side in zip(*rows):
        small = ngram_join.small_ranges([ngram_join.ranges(s) for s in side])
        assert all((r.astype(int) * u >= ngram_join.ranges(s)).all() for s, u, r in zip(side, small["unit"], small["ranges"]))
        sides.append([(len(s), u, r.tolist(), ngram_join.parities(s).tolist()) for s, u, r in zip(side, small["unit"], small["ranges"])])
    df = spark.createDataFrame([(i, *a, *b) for i, (a, b) in enumerate(zip(*sides))],
                               "i int, n int, unit int, ranges array<tinyint>, sketch array<bigint>, n2 int, unit2 int, ranges2 array<tinyint>, sketch2 array<bigint>")
    linked = {i for i, (a, b) in enumerate(rows) if ngram_join.linked(a.tobytes(), b.tobytes(), 90)}
    sketched = {r.i for r in df.where(ngram_join.sketch_filter(90)).collect()}
    passed = {r.i for r in df.where(ngram_join.suffix_filter(90, ngram_join.sketch_filter(90), "x * unit", "y * unit2")).collect()}
    assert linked and linked <= passed <= sketched
    assert all(len(rows[i][0]) < 20 or len(rows[i][0]) > 3000 for i in sketched if i % 2 == 0)     # unlike sets go by the sketch alone


def test_lists_are_cut_where_no_link_crosses(spark):
    posts = spark.createDataFrame([(1, 10 + i, n, i) for i, n in enumerate((50, 52, 52, 70, 100, 110, 121))] + [(2, 30, 5, 0), (2, 31, 9, 0)],
                                  "token bigint, key bigint, n int, pos int")
    got = collections.defaultdict(list)
    for r in ngram_join.cut_lists(posts, 90).collect():
        got[r.token].append((r.key, r.n, r.pos))
    assert sorted(map(sorted, got.values())) == [[(10, 50, 0), (11, 52, 1), (12, 52, 2)], [(14, 100, 4), (15, 110, 5), (16, 121, 6)]]


def test_linked_sizes_are_one_step_apart_at_most(spark):
    for percent in (60, 90, 100):
        rows = [(n, m) for n in range(1, 2000, 7) for m in (n * 100 // percent, n)]
        df = spark.createDataFrame(rows, "n int, m int").select((ngram_join.size_step(F.col("m"), percent) - ngram_join.size_step(F.col("n"), percent)).alias("d"))
        assert {r.d for r in df.collect()} <= {0, 1}


# 2: licenses ---------------------------------------------------------------------------------------------------------

def test_license_scan(spark, hard, none):
    rows = [(1, "Released under the MIT License."), (2, "the mit, LICENSE and Apache-License 2; mit license"), (3, "licensed under CC BY-NC 4.0."),
            (4, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation files"), (5, "a mit b license"), (6, None),
            (7, "GNU General Public License general public license")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (5, 1, 3, 3, "mit", "mit")
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (3, 1, 7, "apache,mit")
    assert (got[3].n_base, got[3].labels, got[3].base_labels) == (0, "cc", "") and got[3].score >= licenses.ENOUGH
    assert got[4].labels == "mit" and got[5].labels == "" and got[5].score == 0
    assert (got[6].n_words, got[6].first_word) == (0, None) and (got[7].n_base, got[7].first_word) == (1, 3)
    assert licenses.scan(hard).count() == len(HARD) and licenses.scan(none).count() == 0


@pytest.mark.parametrize("t", range(len(licenses.TEMPLATES)))
def test_hot_license_keeps_its_label(t):
    """A third of the rows hold one licence; one of them also holds rarer words of other templates."""
    label, text, _ = licenses.TEMPLATES[t]
    rare = [w for w in ("person", "files", "purpose", "published", "unencumbered", "mozilla", "isc") if w not in text.split()]
    rows = [f"before it {text} behind it {i}" for i in range(20)] + [f"nothing of that kind {i}" for i in range(40)]
    rows[0] = " x ".join(rare) + f" {text} " + " y ".join(rare)
    index, counts = licenses.Index(), collections.Counter()
    for r in rows:
        counts.update(index.vocabulary.intersection(licenses.words_in(r)))
    index.weigh(len(rows), counts)
    for i, r in enumerate(rows):
        *_, labels, score, spans = index.scan(r)
        assert (label in labels.split(",")) == (i < 20)
        if i < 20:
            at = r.split().index(text.split()[0])
            assert score == pytest.approx(1.0) and (label, at, at + len(text.split())) in spans


def test_hot_license_in_a_scan(spark):
    bsd = licenses.TEMPLATES[6][1]
    rows = [(i, f"{bsd} {i}" if i < 20 else f"nothing {i}") for i in range(60)] + [(60, f"person a copy b files c purpose d published {bsd}")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[60].labels == "bsd" and got[60].score == pytest.approx(1.0) and [tuple(x) for x in got[60].spans] == [("bsd", 9, 9 + len(bsd.split()))]
    assert all(got[i].labels == ("bsd" if i < 20 else "") for i in range(60))


def test_base_places_equal_brute_force(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["mit", "license", "General", "public", "apache", "x", "Mit-license"]) for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, t in enumerate(texts):
        w = t.lower().replace("-", " ").split()
        at = [(j, label) for p, label in licenses.BASE for j in range(len(w)) if w[j:j + len(p.split())] == p.split()]
        assert (got[i].n_base, got[i].base_labels) == (len(at), ",".join(sorted({x for _, x in at})))
        assert (got[i].first_word, got[i].last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))


# 3: fingerprints -----------------------------------------------------------------------------------------------------

def test_fingerprints(spark, documents, hard, none):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: r for r in spots.fingerprints(documents).collect()}
    rows.sort(key=lambda r: -r[0])
    s = spots.Spotter()
    prints = collections.defaultdict(set)
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        edited = spots.edited_text(t, following)
        assert len(edited) == len(t) - len(t) // 2 + min(len(t) // 2, len(following))
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (set(s.signatures(x).tolist()) for x in (t, edited, following))
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b)) and r.near_next == pytest.approx(len(a & c) / len(a | c))
        prints[t].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert spots.fingerprints(hard).count() == len(HARD) and spots.fingerprints(none).count() == 0
    one = spots.fingerprints(spark.createDataFrame([(1, "the one and only text there is")], "doc_id bigint, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_length_partitions_hold_alike_sets():
    for n in range(1, 300):
        for m in range(n, 300):
            if n / m >= 0.8:
                assert spots.length_partition(m, 0.8) - spots.length_partition(n, 0.8) <= 1


@pytest.mark.parametrize("least", [0.8, 0.5])
def test_near_documents_equal_brute_force(spark, hard, none, least):
    rnd, rows = random.Random(8), []
    for _ in range(12):                                   # families of near copies and of exact ones, of all sizes
        base = [rnd.choice(["the", "of", "and", *(f"w{rnd.randrange(60)}" for _ in range(4))]) for _ in range(rnd.randint(4, 250))]
        for _ in range(rnd.randint(1, 7)):
            rows.append((None if rnd.random() < 0.05 else 500 - len(rows), " ".join(base)))
            if rnd.random() < 0.7:
                base = base.copy()
                base[rnd.randrange(len(base))] = f"new{rnd.randrange(999)}"
    rows += [(1000, None), (1001, ""), (1002, "no anchors here")]
    sets = [set(spots.Spotter().signatures(t).tolist()) for _, t in rows]
    alike = lambda a, b: a == b or len(a & b) >= least * len(a | b) - spots.ROUNDING and bool(a & b)
    links = {(spots.written(np.array(sorted(a), dtype=np.uint32)), spots.written(np.array(sorted(b), dtype=np.uint32)))
             for a in sets for b in sets if a != b and alike(a, b)}
    got = spots.near_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), least).collect()
    assert len(got) == len(rows) and len(links) > 20
    prints = {r["class"]: r.fingerprint for r in got}
    assert len(prints) == len({r.fingerprint for r in got})
    root = {f: f for f in prints.values()}

    def up(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in links:
        root[up(a)] = up(b)
    clusters = {(up(r.fingerprint), r.cluster) for r in got}
    assert len(clusters) == len({c for c, _ in clusters}) == len({c for _, c in clusters})
    sizes = {f: len(np.unique(np.frombuffer(spots.base64.b64decode(f), dtype="<u4"))) for f in prints.values()}
    classes = spark.createDataFrame([(k, f, sizes[f], spots.length_partition(sizes[f], least) if sizes[f] else None) for k, f in prints.items()],
                                    "class bigint, fingerprint string, n int, partition int")
    pairs = {(prints[r.a], prints[r.b]) for r in spots.near_classes(classes, least).collect()}
    assert pairs | {(b, a) for a, b in pairs} == links
    assert spots.near_documents(hard, least).count() == len(HARD) and spots.near_documents(none, least).count() == 0


# 4: byte-level BPE ---------------------------------------------------------------------------------------------------

def reference_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(BPE), special_tokens={})


def test_pieces_equal_the_pattern():
    import regex

    pattern, rnd = regex.compile(public_tokenizers.PATTERN), random.Random(1)
    for _ in range(2000):
        text = "".join(rnd.choice(ODD.replace("\x1c", "").replace("\x1d", "")) for _ in range(rnd.randint(0, 14)))
        starts = piece_starts(code_points(text)).tolist()
        assert [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])] == pattern.findall(text)


def test_chunks_are_stitched_exactly():
    rnd = random.Random(3)
    for _ in range(1500):
        text = "".join(rnd.choice(ODD) for _ in range(rnd.randint(8, 60)))
        points, chunk, overlap = code_points(text), rnd.randint(2, 9), rnd.randint(1, 6)
        if len(text) > chunk + overlap:
            at = list(range(0, chunk * ((len(text) - overlap - 1) // chunk) + 1, chunk))
            starts = [piece_starts(points[a:a + chunk + overlap]) + a for a in at]
            assert bpe.stitched_starts(points, at, starts, overlap).tolist() == piece_starts(points).tolist()


@pytest.mark.parametrize(("chunk", "overlap"), [(bpe.CHUNK, bpe.OVERLAP), (64, 16)])
def test_encode_equals_the_library(spark, documents, hard, chunk, overlap):
    enc = reference_encoding()
    for docs in (documents, hard):
        got = bpe.encode(docs, BPE, chunk, overlap).select("doc_id", "ids", "decoded").collect()
        want = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == sorted(
            (str(d), np.array(enc.encode_ordinary(t), dtype="<u4").tobytes(), t.encode()) for d, t in want)


def test_encode_nothing(none):
    assert bpe.encode(none, BPE).count() == 0


# 5: substring dedup --------------------------------------------------------------------------------------------------

def cut_by_force(rows, size):
    words = [(t or "").encode().split() for _, t in rows]
    count = collections.Counter(tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - size + 1) if count[tuple(w[i:i + size])] > 1 for j in range(i, i + size)}
        out.append((str(d), len(w), len(gone), " ".join(x.decode() for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("many", [repeats.MANY, 1])
def test_repeats_equal_brute_force(spark, hard, monkeypatch, many):
    monkeypatch.setattr(repeats, "MANY", many)
    rnd = random.Random(9)
    passages = [[rnd.choice("abcdefgh") + str(rnd.randrange(40)) for _ in range(rnd.randint(8, 40))] for _ in range(6)]
    rows = list(HARD)
    for i in range(60):
        w = [str(rnd.random()) for _ in range(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            w[len(w) // 2:len(w) // 2] = p[a:a + rnd.randint(1, len(p))]
        rows.append((100 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = repeats.remove_repeats(df, 12).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == cut_by_force(rows, 12)


def test_places_in_one_task_are_settled_there():
    passage = [f"p{i}" for i in range(50)]
    texts = [" ".join([f"a{d}", *passage, f"z{d}"]) for d in range(400)]
    rows = pd.DataFrame({"key": range(400), "text": texts, "copies": 1, "firsts": [list(range(60))] * 400})
    out = pd.concat(repeats._segments(12)(iter([rows])))
    assert out["runs"].notna().sum() == 400                                  # one row a text, not one a segment
    segments = int(out["seed"].notna().sum())
    assert out["first"].notna().sum() <= segments <= 800 + 50                # only the two ends differ from text to text
    hot = pd.DataFrame({"segment": range(400), "copies": 1, "words": texts})
    windows = pd.concat(repeats._single_windows(12)(iter([hot])))
    assert windows["length"].notna().sum() == 400 and windows["length"].dropna().eq(50).all()
    assert windows["segment"].notna().sum() == 39 + 800 and windows.loc[windows["length"].isna(), "whole"].notna().sum() == 800
    assert windows["copies"].sum() == 400 * 41                               # every place is still counted


def test_strip_repeats(hard, none):
    out = repeats.strip_repeats(hard, 35)
    assert out.columns == hard.columns and out.count() == len(HARD)
    assert repeats.strip_repeats(none, 35).count() == 0 and repeats.strip_repeats(none, 35).columns == none.columns


# 6: quality ----------------------------------------------------------------------------------------------------------

def test_rules_learn_and_compile(spark):
    rnd = np.random.default_rng(0)
    x = rnd.random((600, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.4) & (x[:, 7] <= 0.7)).astype(int)
    model = quality.fit_rules(x, y)
    z = model.intercept + sum(w * r.holds(x) for r, w in model.rules)
    assert ((z >= 0) == y).mean() > 0.97
    df = spark.createDataFrame([(dict(zip(quality.STATISTICS, map(float, r))),) for r in x[:50]], "stats struct<" + ", ".join(f"{s}: double" for s in quality.STATISTICS) + ">")
    assert [r.s for r in df.select(model.score(F.col("stats")).alias("s")).collect()] == pytest.approx((1 / (1 + np.exp(-z[:50]))).tolist())


def test_quality_held_out(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, marks).join(marks, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    assert all(r.held_out == (quality.crc_fold(r.doc_id, 3) == 1) for r in quality.classify(docs, marks).limit(20).collect())


def test_quality_hard_cases(spark, hard, none, labels):
    assert quality.classify(hard, labels).count() == len(HARD) and quality.classify(none, labels).count() == 0
    unlabelled = quality.classify(hard, labels.where("false")).collect()
    assert {r.score for r in unlabelled} == {0.5}
    assert quality.keep_good(hard, labels).columns == hard.columns and quality.keep_good(none, labels).count() == 0


# 7: language model ---------------------------------------------------------------------------------------------------

def test_elias_fano():
    rnd = np.random.default_rng(1)
    for universe in (1 << 64, 5 << 40, 1000, 3):
        for n in (0, 1, 2, 700):
            values = np.unique(rnd.integers(0, min(universe, (1 << 64) - 1), size=n, dtype=np.uint64))
            coded = EliasFano.encode(values, universe)
            assert coded.find(values).tolist() == list(range(len(values)))
            asked = rnd.integers(0, min(universe, (1 << 64) - 1), size=300, dtype=np.uint64)
            assert [i >= 0 for i in coded.find(asked)] == [int(x) in set(values.tolist()) for x in asked]
    for n in (1, 2, 700):
        steps = np.cumsum(rnd.integers(0, 3, size=n) * rnd.integers(0, 90, size=n))            # numbers may repeat
        assert EliasFano.encode(steps, int(steps[-1]) + 1).at(np.arange(n)).tolist() == steps.tolist()


def test_scores_equal_brute_force(spark, documents, hard, none):
    for docs in (documents, hard):
        rows = [(r.doc_id, (r.text or "").encode().lower().split() + [None]) for r in docs.select("doc_id", "text").collect()]
        one, two = collections.Counter(), collections.Counter()
        for d, w in rows:
            if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
                one.update(w)
                two.update(zip([None, *w[:-1]], w))
        n, v = sum(one.values()), len(one)
        kept = collections.defaultdict(float)
        for (h, _), c in two.items():
            kept[h] += (c - language_model.DISCOUNT) / one[h] if c >= 2 else 0
        want = []
        for d, w in rows:
            low = [math.log10((one[x] + 1) / (n + v + 1)) for x in w]
            high = [math.log10((max(two[h, x] - language_model.DISCOUNT, 0) / one[h] if two[h, x] >= 2 else 0) + (1 - kept[h]) * 10 ** p)
                    for h, x, p in zip([None, *w[:-1]], w, low)]
            want.append((str(d), len(w), sum(one[x] > 0 for x in w), n, sum(low), sum(high)))
        got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in language_model.score_held_out(docs).collect())
        for a, b in zip(got, sorted(want)):
            assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)
            assert abs(a[5] - b[5]) <= 0.05 * a[1] + 0.01 * abs(b[5])          # bins of the logarithm
    assert language_model.score_held_out(none).count() == 0


def trigrams_by_force(rows):
    """All n-grams up to three words, none dropped."""
    rows = [(d, [None, *(t or "").encode().lower().split(), None]) for d, t in rows]       # None: the end, also before the first word
    grams = [collections.Counter() for _ in range(3)]
    for d, w in rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            for i in range(1, len(w)):
                for k in range(min(i, 2) + 1):
                    grams[k][tuple(w[i - k:i + 1])] += 1
    n, v = sum(grams[0].values()), len(grams[0])
    seen, kinds = collections.Counter(), collections.Counter()
    for k in (1, 2):
        for g, c in grams[k].items():
            seen[g[:-1]] += c
            kinds[g[:-1]] += 1

    def p(g):
        if len(g) == 1:
            return (grams[0][g] + 1) / (n + v + 1)
        if not seen[g[:-1]]:
            return p(g[1:])
        return (max(grams[len(g) - 1][g] - language_model.DISCOUNT, 0) + language_model.DISCOUNT * kinds[g[:-1]] * p(g[1:])) / seen[g[:-1]]

    for d, w in rows:
        low = [math.log10(p(w_)) for w_ in ((x,) for x in w[1:])]
        high = [math.log10(p(tuple(w[max(i - 2, 0):i + 1]))) for i in range(1, len(w))]
        yield str(d), len(w) - 1, sum(grams[0][x,] > 0 for x in w[1:]), n, sum(low), sum(high)


def test_query_keeps_all_trigrams(spark, documents, hard):
    scored = {"query": QUERIES["op7_trie_score"](spark, SF), "hard": language_model.score_held_out(hard, order=3, least=1)}
    for name, docs in (("query", documents), ("hard", hard)):
        want = sorted(trigrams_by_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
        got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in scored[name].collect())
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)
            assert abs(a[5] - b[5]) <= 0.03 * a[1]                                           # bins of the logarithm


def test_frequent_first_words_lie_in_many_shards(spark, documents, hard, monkeypatch):
    for docs in (documents, hard):
        texts = [r.text for r in docs.select("text").collect()]
        words, seen = np.unique(np.concatenate([language_model.tokens_of(t) for t in texts]), return_counts=True)
        hot = np.sort(np.append(words[seen >= np.sort(seen)[-3:].min()], np.uint64(5)))             # one of them occurs nowhere
        got = []
        for chosen in (hot, words[:0]):
            monkeypatch.setattr(language_model, "common_words", lambda *_, chosen=chosen: (chosen, words[::2]))
            model = language_model.train(docs, 3, 1)
            assert model[3:5] == (seen.sum(), len(words)) and len(model[5]) == max(len(chosen) - 1, 0)
            got.append(sorted(tuple(map(str, r[:4])) + (round(r.base_score, 6), round(r.score, 4)) for r in language_model.score(docs, model).collect()))
        assert got[0] == got[1]


def test_pairs_seen_very_often_keep_their_number(spark):
    docs = spark.createDataFrame([(i, "a b " * 300 + str(i)) for i in range(3)], "doc_id bigint, text string")
    model = language_model.train(docs, 3, 1)
    shards = [s for s in (language_model._mapped_shard(model[0], i, 3) for i in range(1 << model[2])) if s is not None]
    times = sorted(x for s in shards for x in s.seen(np.arange(len(s.levels[0].part))).tolist())
    assert times == [1] * 6 + [3, 897, 900]                  # b i, i end; end a; b a; a b


def test_a_pair_is_sent_and_stored_once():
    rnd = np.random.default_rng(4)
    words = [f"w{int(x)}" for x in rnd.zipf(1.3, 60_000) % 50_000]
    texts = pd.DataFrame({"text": [" ".join(words[i:i + 100]) for i in range(0, len(words), 100)]})
    none = np.zeros(0, dtype=np.uint64)
    sent = sum(len(x) for f in language_model._count(2, 3, none, none)(iter([texts])) for x in f["payload"])
    frequent = np.unique(words_of(" ".join(words)))[:1 << 15]
    coded = sum(len(x) for f in language_model._count(2, 3, none, frequent)(iter([texts])) for x in f["payload"])
    assert sent < 8 * 60_600 and coded < 0.6 * sent                          # 9.4 bytes a token when pairs were sent in both levels


def test_model_does_not_pass_the_driver(spark, documents, monkeypatch):
    def refused(self, *_a, **_b):
        raise AssertionError("a file of the model went through the driver")

    monkeypatch.setattr(type(spark.sparkContext), "addFile", refused)
    folder, *_ = model = language_model.train(documents)
    assert language_model.score(documents, model).count() == documents.count()
    store, path = language_model._shard_file(folder, 0)
    assert any(f.path.endswith(".levels") for f in store.get_file_info(language_model.fs.FileSelector(path.rsplit("/", 1)[0])))


def test_model_beats_the_base(spark):
    got = language_model.score_held_out(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


# 8: decontamination --------------------------------------------------------------------------------------------------

def nearest_by_force(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_edit_distance_and_its_stretch():
    rnd = random.Random(1)
    for _ in range(300):
        a = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 12)))
        t = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 30)))
        found = decontaminate.best_stretch(a, t, len(a))
        assert found[0] == nearest_by_force(a, t) == nearest_by_force(a, t[found[1]:found[2]])


def test_items_are_found(spark, hard, none):
    rnd = random.Random(2)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    filler = [r.text[:400] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    rows, planted = [], set()
    for n, share in enumerate((0.0, 0.03, 0.06, 0.09)):
        for i, (k, t) in enumerate(items):
            chars = list(t)
            for _ in range(int(share * len(chars))):
                p = rnd.randrange(len(chars))
                chars[p:p + 1] = rnd.choice(["", "q", chars[p] + "z"])
            rows.append((n * 1000 + i, filler[i % 40] + " " + "".join(chars) + " " + filler[(i + 7) % 40]))
            planted.add((n * 1000 + i, k))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = decontaminate.find_items(docs, bench).collect()
    hits = {(r.doc_id, r.item_id) for r in got}
    exact = {p for p in planted if p[0] < 1000}
    assert exact <= hits
    for n in range(4):                                     # recall at each share of edits
        mine = {p for p in planted if p[0] // 1000 == n}
        assert len(mine & hits) >= 0.9 * len(mine), n
    texts, known = dict(rows), dict(items)
    for r in got:                                         # every row is right, by the exact distance
        item, stretch = decontaminate.normal(known[r.item_id]).strip(), decontaminate.normal(texts[r.doc_id][r.start_char:r.end_char])
        assert nearest_by_force(item, stretch) == r.edits <= 0.1 * len(item)
    blank = spark.createDataFrame([(None, "a b c d e f g"), (1, None), (2, " ")], "item_id bigint, text string")
    assert {str(r.doc_id) for r in decontaminate.find_items(hard, blank).collect()} == {"4", "7"}
    left = decontaminate.without_items(hard, blank)
    assert left.columns == hard.columns and left.count() == len(HARD) - 3
    assert decontaminate.find_items(none, bench).count() == 0 and decontaminate.without_items(hard, blank.where("false")).count() == len(HARD)


def test_sifting_drops_no_match():
    rnd = random.Random(12)
    for _ in range(300):
        item = bytes(rnd.choice(b"abcdef ") for _ in range(rnd.randint(1, 60)))
        block = decontaminate.Items([0], [item], 0.1, np.zeros(0, dtype=np.uint64), []).prepared()
        near = bytearray(item)
        for _ in range(int(0.1 * len(item))):
            at = rnd.randrange(len(near) + 1)
            near[at:at + rnd.randint(0, 1)] = rnd.choice([b"", b"x"])
        text = bytes(rnd.choice(b"abcdef ") for _ in range(rnd.randint(0, 50))) + bytes(near) + bytes(rnd.choice(b"abcdef ") for _ in range(50))
        runs = decontaminate.gram_codes(np.frombuffer(text, dtype=np.uint8))
        for start in range(len(text)):
            most = int(0.1 * len(item))
            low = max(start - most, 0)
            if decontaminate.best_stretch(item, text[low:start + len(item) + most], most) is not None:
                assert block.plausible(runs, np.array([start]), np.array([0]))[0]


def test_item_blocks_give_the_same_rows(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    blocks = list(decontaminate.item_blocks(documents, bench, block=7))
    assert len(blocks) > 1 and sum(len(b.ids) for b in blocks) == bench.count()


# 9: toxicity ---------------------------------------------------------------------------------------------------------

def test_toxicity(spark, hard, none, labels):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(docs, marks).join(marks, "doc_id").where("held_out").collect()
    toxic = [r for r in got if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)
    assert toxicity.classify(hard, labels).count() == len(HARD) and toxicity.classify(none, labels).count() == 0
    assert {r.predicted for r in toxicity.classify(hard, labels.where("toxic = 0")).collect()} == {0}


# 10: token file ------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    rnd = np.random.default_rng(5)
    for n in (0, 1, 4095, 4096, 9000):
        ids = rnd.integers(0, 1 << 32, size=n, dtype=np.uint32)
        sizes, payload = token_file.pack(ids, kind)
        assert token_file.unpack(n, sizes, payload, kind).tolist() == ids.tolist()


@pytest.mark.parametrize(("kind", "chunk"), [("byte", token_file.CHUNK_IDS), ("bit", 500)])
def test_token_file_equals_the_library(spark, documents, hard, none, tmp_path, monkeypatch, kind, chunk):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_file, "CHUNK_IDS", chunk)
    whole = Tokenizer.from_file(FILE_BPE)
    whole.encode_special_tokens = True
    for i, docs in enumerate((documents, hard, none)):
        token_file.write(docs, str(tmp_path / f"{kind}{i}"), FILE_BPE, kind=kind)
        rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want, at = [], 0
        for d, t in rows:
            ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
            want.append((d, at, ids.tobytes()))
            at += len(ids)
        got = sorted(((r.doc_id, r.start, bytes(r.ids)) for r in token_file.read(spark, str(tmp_path / f"{kind}{i}")).collect()), key=lambda r: r[1])
        assert [g[1:] for g in got] == [w[1:] for w in want] and [g[0] for g in got] == [w[0] for w in want]


def test_added_tokens_in_texts(spark, tmp_path):
    from tokenizers import AddedToken, Tokenizer

    mark = "<|endoftext|>"
    texts = [f"a {mark} b", mark, f"{mark}{mark}", f"x{mark}y don't", f"  {mark}  's", "<|endoftext|", f"one\n{mark}\n\ntwo  three", None, "no mark here", "héé" + mark + "漢字 " * 50]
    other = Tokenizer.from_file(FILE_BPE)                 # a file whose added tokens depend on what is around
    other.add_tokens([AddedToken("don", single_word=True, normalized=False), AddedToken("two", lstrip=True, rstrip=True, normalized=True)])
    other.save(str(tmp_path / "other.json"))
    for n, path in enumerate((FILE_BPE, str(tmp_path / "other.json"))):
        whole, folder = Tokenizer.from_file(path), str(tmp_path / f"file{n}")
        token_file.write(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), folder, path)
        want, at = [], 0
        for i, t in enumerate(texts):
            ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
            want.append((i, at, np.array(ids, dtype="<u4").tobytes()))
            at += len(ids)
        assert sorted((r.doc_id, r.start, bytes(r.ids)) for r in token_file.read(spark, folder).collect()) == want


# the pipeline --------------------------------------------------------------------------------------------------------

def test_pipeline_equals_its_stages_by_force(spark):
    sf = SF
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    marks, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    good = {r.doc_id for r in quality.score(docs, quality.train(docs, marks), "doc_id").where("score >= 0.5").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    first = {d for d, n, c in components_by_force(rows, 5, 80) if n == 0 or d == c}
    rows = [r for r in rows if r[0] in first]
    cut = {d: (gone, kept) for d, _, gone, kept in cut_by_force(rows, 35)}
    rows = [(d, cut[str(d)][1] if cut[str(d)][0] else t) for d, t in rows]
    items = [decontaminate.normal(r.text).strip() for r in bench.collect()]
    enc = reference_encoding()
    got = {r.doc_id: bytes(r.decoded) for r in corpus_pipeline.run(spark, sf).collect()}
    clean = {d: t for d, t in rows if not any(i in decontaminate.normal(t) for i in items)}
    assert set(got) <= set(clean)
    for d in set(clean) - set(got):                       # only near passages may be missing as well
        assert any(nearest_by_force(i, decontaminate.normal(clean[d])) <= 0.1 * len(i) for i in items)
    assert all(got[d] == clean[d].encode() for d in got)
    ids = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, sf).collect()}
    assert all(ids[d] == np.array(enc.encode_ordinary(clean[d]), dtype="<u4").tobytes() for d in ids)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_hard_cases(spark, hard, none, tmp_path, labels, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "zz yy xx ww vv uu"), (None, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (hard, none):
        out = stage(spark, docs, str(tmp_path))
        out.collect()
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
