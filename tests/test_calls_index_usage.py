from __future__ import annotations

import math
import random
import uuid
from collections import deque

import numpy as np
from pyspark.sql import functions as F

from gleaner import dims
from gleaner.operators import calls as A
from gleaner.operators import images as I
from gleaner.operators import indexing as X
from gleaner.operators import sequence as S
from gleaner.operators import usage as U
from gleaner.streaming import limiter_stream

SEG = "recording_id int, seg_id int, start double, end double, speaker string, text string"


def _segments(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], SEG)


def test_gap_exactly_at_limit_does_not_split(spark):
    rows = [(0.0, 1.0, "a", "x"), (4.0, 5.0, "a", "x"), (8.5, 9.0, "a", "x"), (9.0, 9.5, "a", " ")]
    out = {r.seg_id: r.conv_no for r in A.split_by_gap(_segments(spark, rows)).collect()}
    assert out == {0: 0, 1: 0, 2: 1}


def _brute_split(rows, gap, reset, least):
    first, blocks = rows[0][3], [[rows[0]]]
    for prev, nxt in zip(rows, rows[1:]):
        silence, cur = nxt[1] - prev[2], blocks[-1]
        speakers = {r[3] for r in cur}
        if silence > gap or (silence > reset and nxt[3] == first and len(speakers) >= 2 and len(cur) >= 2):
            blocks.append([])
        blocks[-1].append(nxt)
    return {r[0]: i for i, b in enumerate(blocks) if max(0.0, b[-1][2] - b[0][1]) >= least for r in b}


def test_conversations_match_brute_force(spark):
    """200,000 segments in 500 recordings; some have few long silences, so that one stretch
    goes through many slots, some have a silence every few segments."""
    rng = random.Random(5)
    all_rows, expected = [], {}
    for rec in range(500):
        gaps = [0.2, 0.9, 1.0, 1.2, 2.0, 2.9, 3.0] + ([5.0, 900.0] if rec % 2 else [])
        t, rows = 0.0, []
        for i in range(400):
            t = round(t + rng.choice(gaps), 3)
            stop = round(t + rng.choice([0.0, 4.0, 40.0]), 3)
            rows.append((i, t, stop, rng.choice(("ab", "abc", "aaab", "a")[rec % 4])))
            t = stop
        expected.update({(rec, k): v for k, v in _brute_split(rows, 3.0, 1.0, 30.0).items()})
        all_rows += [(rec, i, s, e, sp, "t") for i, s, e, sp in rows]
    out = A.split_conversations(spark.createDataFrame(all_rows, SEG).repartition(8))
    assert {(r.recording_id, r.seg_id): r.call_index for r in out.collect()} == expected
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    numbered = A.call_ids(out).where("recording_id = 1").orderBy("call_index").collect()
    assert [r.call_id for r in numbered] == [f"CALL-{i + 1:03d}" for i in range(len(numbered))]


def test_mm_ss(spark):
    df = spark.createDataFrame([(v,) for v in (59.5, 0.5, 61.4, -3.0, 6000.0, 119.6)], "v double")
    assert [r.x for r in df.select(A.format_mm_ss(F.col("v")).alias("x")).collect()] == ["01:00", "00:00", "01:01", "00:00", "100:00", "02:00"]


def test_sequence_helpers_cross_slots(spark):
    rows = [(k, i // 3, i, i % 4 == 0 and i or None) for k in (1, 2) for i in range(10)]
    df = spark.createDataFrame(rows, "k int, s int, i int, v int")
    prev = {(r.k, r.i): r.prev_i for r in S.previous(df, ["k"], "s", ["i"], ["i"]).collect()}
    assert prev == {(k, i): i - 1 if i else None for k in (1, 2) for i in range(10)}
    sums = {(r.k, r.i): r.t for r in S.running_sum(df, ["k"], "s", ["i"], "i", "t").collect()}
    assert sums == {(k, i): i * (i + 1) // 2 for k in (1, 2) for i in range(10)}
    last = {(r.k, r.i): r.c for r in S.carry_last(df, ["k"], "s", ["i"], "v", "c").collect()}
    assert last == {(k, i): (i // 4 * 4 or None) for k in (1, 2) for i in range(10)}


def test_long_runs_come_in_volumes(spark, monkeypatch):
    monkeypatch.setattr(A, "VOLUME_WORDS", 3)
    rows = [(1, i * 50, "a" if i < 8 else "b", i * 700.0, i * 700.0 + 1, f"w{i}") for i in range(10)]
    segs = A.words_to_segments(spark.createDataFrame(rows, "recording_id int, word_no int, speaker string, start double, end double, word string"))
    assert [(r.segment_no, r.volume, r.text) for r in segs.orderBy("segment_no", "volume").collect()] == [
        (1, 0, "w0 w1 w2"), (1, 1, "w3 w4 w5"), (1, 2, "w6 w7"), (2, 0, "w8 w9")]


def test_speaker_runs(spark):
    rows = [(1, i, s, float(i) * 2000, float(i) * 2000 + 1, w) for i, (s, w) in enumerate([("a", "hi"), ("a", "you"), ("b", "yes"), ("a", "ok")])]
    segs = A.words_to_segments(spark.createDataFrame(rows, "recording_id int, word_no int, speaker string, start double, end double, word string")).orderBy("segment_no").collect()
    assert [(r.speaker, r.start, r.end, r.text) for r in segs] == [("a", 0.0, 2001.0, "hi you"), ("b", 4000.0, 4001.0, "yes"), ("a", 6000.0, 6001.0, "ok")]


def test_coercions(one):
    assert one(A.coerce_confidence, "high", "Very Low", "1.4", "x", None, "true", "-2") == [0.85, 0.15, 1.0, 0.5, 0.5, 1.0, 0.0]
    assert one(A.coerce_seconds, "904.5s", " 3 S", "-1.5", "abc") == [904.5, 3.0, -1.5, None]
    flags = one(lambda c: A.coerce_resolved(c, F.lit("base"))[0], "sí", "0", "2", "no queda claro si resuelto", "quedó solucionado", "llamar luego", None)
    assert flags == [True, False, True, False, True, False, False]
    assert one(lambda c: A.coerce_resolved(c, F.lit(" base "))[1], "llamar luego", "ok") == ["base\n\nllamar luego", " base "]


def test_point_ids(spark):
    ns = uuid.UUID(X.POINT_NAMESPACE)
    rows = [("h1", "CALL-001", "rag_qa", 3), ("h2", "CALL-002", "issue_summary", None)]
    got = [r.point_id for r in X.point_ids(spark.createDataFrame(rows, "source_file_hash string, call_id string, point_kind string, rag_pair_index int")).collect()]
    assert got == [str(uuid.uuid5(ns, "rag:h1:CALL-001:3")), str(uuid.uuid5(ns, "issue:h2:CALL-002"))]


def _points(spark, rows):
    return spark.createDataFrame(rows, "id int, kind string, ord int, probe array<float>, vector array<float>")


def test_near_duplicates_match_sequential_rule(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 6))
    rows = []
    for i in range(90):
        v = base[rng.integers(12)] + rng.normal(size=6) * 0.25
        rows.append((i, "rag_qa" if i % 3 else "issue_summary", i, v.tolist(), v.tolist()))
    rows += [(100 + i, r[1], 100 + i, [2 * x for x in r[3]], [4 * x for x in r[4]]) for i, r in enumerate(rows[:40])]
    rows.append((999, "rag_qa", 999, [0.0] * 6, [0.0] * 6))
    kept = []
    for r in rows:
        limit = X.QA_LIMIT if r[1] == "rag_qa" else X.ISSUE_LIMIT
        p = np.array(r[3], dtype=np.float32).astype(float)

        def sim(k):
            q = np.array(k[4], dtype=np.float32).astype(float)
            n = np.linalg.norm(p) * np.linalg.norm(q)
            return round(float(p @ q / n), 10) if n else 0.0

        if not any(k[1] == r[1] and sim(k) > limit for k in kept):
            kept.append(r)
    assert {r.id for r in X.near_dup_in_batch(_points(spark, rows)).collect()} == {k[0] for k in kept}
    few = X.near_dup_in_batch(_points(spark, rows), head=40, cell_rows=10, part_rows=8)
    assert {r.id for r in few.collect()} == {k[0] for k in kept}


def test_chains_of_near_duplicates_settle_in_few_rounds(spark, monkeypatch):
    # Each point is too similar to its neighbours alone: every other one stays.
    step = math.acos(X.QA_LIMIT) * 0.75
    rows = [(i, "rag_qa", i, [math.cos(step * j) for j in (i,)] + [math.sin(step * i), 0.02 * i], [math.cos(step * i), math.sin(step * i), 0.02 * i]) for i in range(1000)]
    close = [(i, "rag_qa", i, [1.0, 0.0002 * i], [1.0, 0.0002 * i]) for i in range(1000)]
    rounds = []
    settle = X._in_order
    monkeypatch.setattr(X, "_in_order", lambda points: rounds.append(1) or settle(points))
    for points in (rows, close):
        v = np.array([r[4] for r in points], dtype=np.float32).astype(float)
        v /= np.linalg.norm(v, axis=1)[:, None]
        kept = []
        for i in range(len(points)):
            if not kept or np.round(v[kept] @ v[i], 10).max() <= X.QA_LIMIT:
                kept.append(i)
        rounds.clear()
        assert {r.id for r in X.near_dup_in_batch(_points(spark, points)).collect()} == set(kept) and len(rounds) == 1
    rounds.clear()
    assert {r.id for r in X.near_dup_in_batch(_points(spark, points), head=200, cell_rows=100).collect()} == set(kept) and len(rounds) <= 6


def test_near_duplicates_of_unknown_kinds_and_odd_vectors(spark):
    rows = [(1, "other", 1, [1.0, 0.0], [1.0, 0.0]), (2, "other", 2, [1.0, 0.0], [1.0, 0.0]), (3, "rag_qa", 3, None, None), (4, "rag_qa", 4, [1.0], [1.0, 0.0]),
            (5, "rag_qa", 5, [1.0, 0.0], [1.0, 0.0]), (6, "rag_qa", 6, [2.0, 0.0], [2.0, 0.0]), (7, "rag_qa", 7, [0.0, 0.0], [0.0, 0.0])]
    assert {r.id for r in X.near_dup_in_batch(_points(spark, rows)).collect()} >= {1, 3, 4, 7}
    assert X.near_dup_in_batch(_points(spark, [])).collect() == []
    got = {r.id: (r.similarity, r.dropped) for r in X.near_dup_against_index(_points(spark, rows), _points(spark, rows).drop("ord", "probe")).collect()}
    assert got[1] == (0.0, False) and got[3] == (0.0, False) and got[5] == (1.0, True)


def test_chunks_without_a_vector_are_counted_as_skipped(spark):
    chunks = spark.createDataFrame([(i, None) for i in range(5)], "chunk_id int, module_id string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [0.5, None])], "chunk_id int, embedding array<float>")
    indexed, counts = X.index_chunks(chunks, vectors)
    assert {r.chunk_id for r in indexed.collect()} == {0, 3} and tuple(counts.first()) == (2, 3)


def test_near_duplicates_against_index(spark):
    new = _points(spark, [(1, "rag_qa", 1, [1.0, 0.0], [1.0, 0.0]), (2, "rag_qa", 2, [0.0, 1.0], [0.0, 1.0]), (3, "issue_summary", 3, [1.0, 0.0], [1.0, 0.0])])
    index = spark.createDataFrame([(7, "rag_qa", [3.0, 0.1]), (8, "rag_qa", [1.0, 1.0])], "id int, kind string, vector array<float>")
    for sizes in ({}, {"cell_rows": 1, "part_rows": 1, "probe_block": 1}):
        got = {r.id: (round(r.similarity, 4), r.dropped) for r in X.near_dup_against_index(new, index, **sizes).collect()}
        assert got == {1: (0.9994, True), 2: (0.7071, False), 3: (0.0, False)}


# --- images ----------------------------------------------------------------------------

def test_image_rules(spark):
    cases = [(1, 10, 5, None, "tiny_metadata"), (1, 400, 15, None, "extreme_aspect_metadata"), (1, 200, 150, None, None), (0, 200, 150, None, "first_page"),
             (1, 580, 832, (5, 5, 590, 837), "near_fullpage_background"), (1, 100, 40, (20, 10, 120, 50), "header_band_small"), (1, 300, 250, (150, 350, 450, 600), None),
             (1, 60, 60, (250, 800, 310, 830), "footer_band_small"), (1, 30, 30, (5, 400, 35, 430), "margin_decor"), (1, 500, 60, (20, 400, 520, 450), "full_width_thin_bar")]
    rows = [(i, p, w, h, *(map(float, r) if r else (None,) * 4), 595.0, 842.0) for i, (p, w, h, r, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, page int, w int, h int, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double")
    assert [r.skip_reason for r in I.image_skip_reason(df).orderBy("i").collect()] == [c[-1] for c in cases]


def test_orphans_match_brute_force(spark):
    rng = random.Random(8)
    images = [(1, p, i, *(lambda x, y: (x, y, x + rng.uniform(5, 200), y + rng.uniform(5, 150)))(rng.uniform(0, 500), rng.uniform(0, 700)), 595.0, 842.0) for p in range(4) for i in range(40)]
    words = [(1, p, *(lambda x, y: (x, y, x + 20, y + 8))(rng.uniform(0, 560), rng.uniform(0, 800))) for p in range(3) for _ in range(6)]
    expected = set()
    for d, p, i, x0, y0, x1, y1, w, h in images:
        mine = [b for b in words if b[1] == p]
        if mine and (x1 - x0) * (y1 - y0) / (w * h) < 0.12 and not any(x0 - 40 < b[4] and b[2] < x1 + 40 and y0 - 40 < b[5] and b[3] < y1 + 40 for b in mine):
            expected.add((p, i))
    got = I.orphan_images(spark.createDataFrame(images, "doc_id int, page int, image_no int, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double"),
                          spark.createDataFrame(words, "doc_id int, page int, x0 double, y0 double, x1 double, y1 double"))
    assert {(r.page, r.image_no) for r in got.collect()} == expected and expected


def test_logos_and_entropy(spark):
    df = spark.createDataFrame([(0b1111,), (-1,)], "phash bigint")
    assert [r.is_logo for r in I.logo_matches(df, [("x", 0)]).collect()] == [True, False]
    assert [r.is_logo for r in I.logo_matches(df, []).collect()] == [False, False]
    hist = spark.createDataFrame([("a", 1), ("a", 1), ("a", 0), ("b", 5)], "image_id string, n int")
    assert {r.image_id: r.entropy for r in I.histogram_entropy(hist).collect()} == {"a": 1.0, "b": 0.0}


# --- cost and limits -------------------------------------------------------------------

def test_prices(spark):
    rows = [(1, "google", "gemini-2.5-flash-lite", "generate_text", 1000.0, 1000.0, None), (2, "google", "gemini-2.5-flash", "generate_text", 1000.0, 0.0, None), (3, "mystery", "x", "generate_text", 1000.0, 1000.0, None),
            (4, "openai_compat", "gpt-4o-mini", "generate_text", 2000.0, 500.0, None), (5, "ollama", "llama", "generate_text", 9.0, 9.0, None), (6, "cohere", "r", "rerank", 0.0, 0.0, 3.0), (7, "voyage", "v", "embed", 500.0, 500.0, None)]
    df = spark.createDataFrame(rows, "event_id int, provider string, model string, operation string, units_in double, units_out double, qty double")
    got = {r.event_id: (r.pricing_source, round(r.estimated_cost, 9)) for r in U.estimate_cost(U.resolve_prices(df, dims.prices(spark))).collect()}
    assert got == {1: ("provider", 0.0005), 2: ("model", 0.0003), 3: ("fallback_zero", 0.0), 4: ("provider", 0.0006), 5: ("provider", 0.0), 6: ("provider", 0.006), 7: ("provider", 0.00006)}


def test_blank_model_is_unknown(spark):
    df = spark.createDataFrame([(1, "", "p", 1.0, 1.0, 2.0, "2024-01-01T00:00:00"), (2, None, "", 2.0, None, None, "")], "event_id int, model string, provider string, estimated_cost double, units_in double, units_out double, ts string")
    row = U.usage_by_model(df).collect()
    assert [(r.model, r.provider, r.cost, r.events, r.units_in) for r in row] == [("unknown", "p", 3.0, 2, 1.0)]
    assert [(r.date, r.events) for r in U.usage_by_day(df).collect()] == [("2024-01-01", 1), ("unknown", 1)]
    assert U.usage_recent(df, -1).count() == 0


def test_rate_limit_matches_sliding_queue(spark):
    rng = random.Random(11)
    rows, t = [], 1_700_000_000.0
    for i in range(1500):
        t += rng.choice([0.0, 0.5, 2.0, 5.0, 20.0, 61.0, 400.0] if i % 300 > 150 else [0.0, 0.5, 1.0, 3.0])
        rows.append((i, rng.choice(["a", "a", "a", "b"]), rng.random() < 0.2, t))
    queues, expected = {}, {}
    for i, client, heavy, at in rows:
        q = queues.setdefault((client, heavy), deque())
        while q and q[0] < at - 60:
            q.popleft()
        expected[i] = len(q) >= (3 if heavy else 8)
        if not expected[i]:
            q.append(at)
    df = spark.createDataFrame(rows, "event_id int, client string, heavy boolean, at double").select("event_id", "client", "heavy", F.timestamp_micros((F.col("at") * 1000000).cast("bigint")).alias("ts"))
    got = {r.event_id: r.denied for r in U.rate_limit_flags(df, 8, 3, 60).collect()}
    assert got == expected and 0 < sum(expected.values()) < 1500
    numbered = df.withColumn("client", F.when(F.col("client") == "a", 1).otherwise(2).cast("bigint")).withColumn("event_id", F.col("event_id").cast("bigint"))
    streamed = limiter_stream.replay_rate_limit(numbered, limit=8, heavy_limit=3, window_s=60)
    assert {r.event_id: r.denied for r in streamed.collect()} == expected


def test_tasks_of_segments_hold_a_bounded_number_of_words(spark, monkeypatch):
    from gleaner import session

    rows = [(r, i, str(i // 50) if i % 7 else None, i * 1.0, i + 0.5, f"w{i}") for r in (1, 2) for i in range(600)]
    words = spark.createDataFrame(rows, "recording_id int, word_no int, speaker string, start double, end double, word string")
    whole = sorted(A.words_to_segments(words).collect())
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    segs = A.words_to_segments(words, F.floor(F.col("word_no") / 40))
    plan = segs._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.count(", 12") >= 2      # 1,200 words; a fixed number of tasks before
    assert sorted(segs.collect()) == whole and len(whole) == 26


def test_length_of_a_vector_is_taken_once(spark):
    points = _points(spark, [(1, "rag_qa", 1, [3.0, 4.0], [1.0, 0.0]), (2, "rag_qa", 2, None, [])])
    unit = points.select(X._unit("probe").alias("p"), X._unit("vector").alias("v"))
    assert [r.p and [round(x, 6) for x in r.p] for r in unit.collect()] == [[0.6, 0.8], None]
    assert unit._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 2    # once for every use
