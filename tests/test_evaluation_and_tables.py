from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gleaner import dims, schemas
from gleaner.operators import corpus as O
from gleaner.operators import evaluation as B
from gleaner.operators import feedback as FB
from gleaner.operators import ingest as N
from gleaner.operators import maintenance as M
from gleaner.operators import usage as U
from gleaner.sources import readers, writers
from gleaner.streaming import usage_stream

PAIR = "pair_id int, question string, answer string, gold_chunk_id string, source_doc string, source_section string, doc_type string, difficulty string, validated boolean, failed boolean, chunk_text_preview string"
ANSWER = "pair_id int, rank int, chunk_id string, source_doc string, source_section string, score double, text string"


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame([(1, "q1", "a", "c1", "d1", "Intro", "faq_document", "L1", True, False, "p"), (2, "q2", "a", "", "d2", None, "module_manual", "L3", True, False, "p"),
                                  (3, "q3", "a", "c3", "d3", "S", "faq_document", "L1", False, True, "p")], PAIR)


@pytest.fixture
def answers(spark):
    return spark.createDataFrame([(1, 1, "x", "d9", None, 0.9, "t"), (1, 2, "c7", "d1", "  intro ", 0.8, "t"), (2, 1, "y", "d2", "any", 0.7, "t\nu")], ANSWER)


def test_hits(spark, pairs, answers):
    hit = {(r.pair_id, r.rank): r.hit for r in B.match_gold(answers, pairs).collect()}
    assert hit == {(1, 1): False, (1, 2): True, (2, 1): True}
    other = spark.createDataFrame([(1, 1, "c1", "elsewhere", None, 1.0, "t")], ANSWER)
    assert B.match_gold(other, pairs).first().hit


def test_rates_and_compliance(spark, pairs, answers):
    summary = B.eval_summary(B.hit_ranks(answers, pairs))
    got = {(r.dim, r.grp): (r.n, r.h1, r.h3, r.hr_at_3, r.mrr) for r in summary.collect()}
    assert got == {("overall", "all"): (3, 1, 2, 0.6667, 0.5), ("doc_type", "faq_document"): (1, 0, 1, 1.0, 0.5), ("doc_type", "module_manual"): (1, 1, 1, 1.0, 1.0),
                   ("difficulty", "L1"): (1, 0, 1, 1.0, 0.5), ("difficulty", "L3"): (1, 1, 1, 1.0, 1.0)}
    checks = {(r.dim, r.grp): (getattr(r, "pass"), r.skipped) for r in B.spec_compliance(summary, dims.hr3_floors(spark)).collect()}
    assert checks[("doc_type", "faq_document")] == (True, None) and checks[("doc_type", "structured_manual")] == (None, "no_pairs") and checks[("overall", "all")] == (False, None)


def test_analysis_pages(spark, pairs, answers):
    items, summary = B.retrieval_analysis(pairs, answers, misses_only=True, limit=2, offset=1)
    s = summary.first()
    assert (s.n_queries, s.n_errors, s.hits_at_k, s.hr_at_k, s.n_items_returned, s.next_offset, s.has_more) == (2, 1, 1, 0.5, 1, 3, False)
    assert [(r.pair_index, r.pair_id) for r in items.collect()] == [(2, 3)]


def test_validated_subset(spark, pairs):
    assert B.eval_pairs(pairs).count() == 2
    assert B.eval_pairs(pairs.where("NOT validated")).count() == 1
    with pytest.raises(ValueError):
        B.eval_pairs(pairs.limit(0))


def test_quotas_are_exact():
    assert B.quotas(300) == {"structured_manual": 75, "operational_guide": 60, "module_manual": 60, "changelog_as_manual": 45, "others": 60}


def test_sample_keeps_small_strata_whole(spark):
    chunks = spark.createDataFrame([(i, "structured_manual" if i < 500 else "faq_document") for i in range(505)], "chunk_id int, doc_type string")
    got = {r.stratum: r.n for r in B.stratified_sample(chunks, 100).groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    assert got == {"structured_manual": 25, "others": 5}


def test_negatives_need_two(spark):
    chunks = spark.createDataFrame([(i, t, "x" * 60) for i, t in enumerate(["a", "a", "b", "b", "b"])], "chunk_id int, doc_type string, text string")
    pairs = spark.createDataFrame([(1, 0, "a"), (2, 2, "b")], "pair_id int, gold_chunk_id int, doc_type string")
    rows = B.hard_negative_candidates(pairs, chunks).collect()
    assert {(r.pair_id, r.chunk_id) for r in rows} == {(2, 3), (2, 4)}


def test_distribution(spark):
    def warnings(rows):
        stats = spark.createDataFrame(rows, "dim string, key string, n bigint")
        return [r.warning for r in B.distribution_report(stats, dims.target_shares(spark)).collect() if r.warning]

    assert warnings([("total", "pairs", 0), ("total", "validated", 0)]) == []
    skewed = warnings([("difficulty", "L1", 100), ("doc_type", "faq_document", 100), ("total", "pairs", 100), ("total", "validated", 10)])
    assert any(w.startswith("Difficulty L1: 100.0% vs target ~40%") for w in skewed) and any(w.startswith("Validated pairs: 10") for w in skewed)


def test_document_accuracy(spark):
    answers = spark.createDataFrame([(1, 1, "Other.pdf"), (1, 2, "USER-guide.pdf"), (2, 1, "alt.pdf"), (2, 4, "main.pdf")], "query_id int, rank int, source_doc string")
    wanted = spark.createDataFrame([(1, "user-guide", []), (2, "main", ["ALT"]), (3, "x", [])], "query_id int, expected string, alternatives array<string>")
    r = B.doc_accuracy(answers, wanted).first()
    assert (r.questions, r.top1_primary, r.top1_relevant, r.top3_primary, r.top3_relevant) == (3, 0, 1, 1, 2)


# --- feedback, tables --------------------------------------------------------------------

def test_reviews(spark):
    fb = spark.createDataFrame([(0, "f1", "q", "t1", "ok", 5), (1, None, "q", "t2", "ok", None)], "line_no int, feedback_id string, query_id string, timestamp_text string, rating string, stars int")
    rv = spark.createDataFrame([(0, "f1", "resolved", "r1"), (1, " f1 ", "dismissed", "r2"), (2, " ", "open", "r3"), (3, "gone", "open", "r4")], "line_no int, feedback_id string, action string, timestamp_text string")
    rows = FB.feedback_with_reviews(fb, rv)
    assert {r.feedback_id: r.review_status for r in rows.collect()} == {"f1": "dismissed", "q:t2:1": "open"}
    page = FB.feedback_page(rows, status="open").collect()
    assert [(r.feedback_id, r.total) for r in page] == [("q:t2:1", 1)]
    good, bad = FB.validate_reviews(rv.withColumn("action", F.lit(" Accept ")), FB.PAIR_ACTIONS)
    assert good.count() == 4 and bad.count() == 0


def test_logs(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"a": 1, "b": "x"}\n\n[1]\nnot json\n{"a": 2\n  {"a": 3}\n"text"\n', encoding="utf-8")
    assert [(r.a, r.b) for r in readers.scan_jsonl_tolerant(spark, str(log), "a int, b string").orderBy("a").collect()] == [(1, "x"), (3, None)]
    assert readers.scan_jsonl_tolerant(spark, str(tmp_path / "none"), "a int").count() == 0
    with pytest.raises(Exception):
        readers.scan_jsonl_strict(spark, str(log), "a int, b string").collect()
    out = str(tmp_path / "out")
    writers.append_log(spark.createDataFrame([(1,)], "a int"), out)
    writers.append_log(spark.createDataFrame([(2,)], "a int"), out)
    assert readers.scan_jsonl_strict(spark, out, "a int").count() == 2


def test_listing_and_metadata(spark, tmp_path):
    for name in ("a.PDF", "sub/b.docx", "sub/c.txt", "d.xlsx"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("x")
    assert sorted(r.name for r in readers.scan_files(spark, str(tmp_path)).collect()) == ["a.PDF", "b.docx", "d.xlsx"]
    assert [r.name for r in readers.scan_files(spark, str(tmp_path / "a.PDF")).collect()] == ["a.PDF"]
    for i, text in enumerate(('{"doc_id": "x",\n "n": 1}', "{broken")):
        folder = tmp_path / f"corpus/{i}"
        folder.mkdir(parents=True)
        (folder / "metadata.json").write_text(text)
        (folder / "other.json").write_text(json.dumps({"doc_id": "no"}))
    assert [r.doc_id for r in readers.scan_doc_metadata(spark, str(tmp_path / "corpus"), "doc_id string, n int").collect()] == ["x"]


def test_failure_log(spark):
    schema = "path string, error string, seq int"
    old = spark.createDataFrame([("a", "e1", 0), ("b", "e1", 1)], schema)
    new = spark.createDataFrame([("a", "e2", 2), ("b", None, 3), ("c", "e", 4)], schema)
    failed = O.failed_checkpoint(old, new)
    assert {r.path: r.error for r in failed.collect()} == {"a": "e2", "c": "e"}
    keep, gone = O.resume_set(failed, spark.createDataFrame([("a",)], "path string"))
    assert [r.path for r in keep.collect()] == ["a"] and [r.path for r in gone.collect()] == ["c"]


def test_overlay(spark):
    schema = "tenant_id string, key string, value string, seq int"
    patches = spark.createDataFrame([("demo", "legacy_erp_version", "4.2", 1), ("demo", "benchmark_lang", " CA ", 2), ("demo", "nonsense", "x", 3)], schema)
    clean = O.normalize_overlay_patch(patches)
    assert {(r.key, r.value) for r in clean.collect()} == {("erp_version", "4.2"), ("benchmark_lang", "ca")}
    cleared = spark.createDataFrame([("demo", "erp_version", None, 9)], schema)
    assert {(r.key, r.value) for r in O.tenant_overlay(clean.select("tenant_id", "key", "value", "seq"), cleared).collect()} == {("benchmark_lang", "ca")}


def test_upsert_takes_last(spark):
    base = spark.createDataFrame([(1, "a", 9), (2, "b", 9)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "c", 1), (1, "d", 2), (3, "e", 0)], "k int, v string, t int")
    assert {r.k: r.v for r in M.upsert_by_key(base, new, ["k"], ["t"]).collect()} == {1: "d", 2: "b", 3: "e"}


def test_ingest_skips_and_reports(spark):
    texts = spark.createDataFrame([("a", "/x/a.md", "# T\nbody"), ("b", "/x/b.md", " "), ("c", "/x/c.md", "text"), ("changelog", "/x/changelog.md", "tiny")], "doc_id string, path string, text string")
    done = spark.createDataFrame([("c",)], "doc_id string")
    chunks, errors = N.ingest_documents(texts, done, dims.doc_type_rules(spark))
    assert {r.doc_id for r in chunks.collect()} == {"a"} and [r.doc_id for r in errors.collect()] == ["b"]
    forced, _ = N.ingest_documents(texts, done, dims.doc_type_rules(spark), force=True)
    assert {r.doc_id for r in forced.collect()} == {"a", "c"}


def test_stream_equals_batch_over_two_runs(spark, tmp_path):
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    schema = schemas.COST_EVENT
    first = spark.createDataFrame([(1, "2024-01-01T10:00:00", "m", "p", 1.0, 1.0, 0.5), (2, "2024-01-02T01:00:00", "m", "p", 1.0, 1.0, 0.25)], schema)
    first.write.mode("append").json(log)
    usage_stream.run_usage_stream(spark, log, out, state)
    # Later batches bring days that are long past, and events without a time stamp.
    second = spark.createDataFrame([(3, "2024-01-09T09:00:00", "m", "p", 1.0, 1.0, 1.0), (4, "2024-01-02T09:00:00", "m", "p", 1.0, 1.0, 2.0), (5, None, "m", "p", 1.0, 1.0, 4.0)], schema)
    second.write.mode("append").json(log)
    usage_stream.run_usage_stream(spark, log, out, state)
    third = spark.createDataFrame([(6, "2024-01-01T00:00:00", "m", "p", 1.0, 1.0, 8.0), (7, " ", "m", "p", 1.0, 1.0, None)], schema)
    third.write.mode("append").json(log)
    usage_stream.run_usage_stream(spark, log, out, state)

    def days(df):
        return {r.date: (r.cost, r.events) for r in df.collect()}

    got = days(usage_stream.day_totals(spark, out))
    assert got == days(U.usage_by_day(first.unionByName(second).unionByName(third)))
    assert got["2024-01-01"] == (8.5, 2) and got["unknown"] == (4.0, 1)
    # A batch that runs again replaces what it wrote.
    usage_stream.add_batch(third, 2, out)
    usage_stream.add_batch(third, 2, out)
    assert days(usage_stream.day_totals(spark, out)) == got


def test_task_functions_travel_without_the_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from gleaner.operators import cells

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps([cells.best_of, cells.scores]))
    done = subprocess.run([sys.executable, "-c", "import pickle; print(len(pickle.load(open('f.pkl', 'rb'))))"], cwd=tmp_path, env={}, capture_output=True, text=True)
    assert done.stdout.strip() == "2", done.stderr


def test_schemas_are_well_formed(spark):
    names = [n for n in vars(schemas) if n.isupper()]
    assert len(names) >= 13 and all(spark.createDataFrame([], getattr(schemas, n)).columns for n in names)


def test_negatives_come_from_the_whole_type(spark):
    from gleaner.operators import evaluation

    chunks = spark.createDataFrame([(i, "faq", f"{i} " + "word " * 200) for i in range(300)], "chunk_id bigint, doc_type string, text string")
    pairs = spark.createDataFrame([(p, p, "faq") for p in range(200)], "pair_id bigint, gold_chunk_id bigint, doc_type string")
    rows = evaluation.hard_negative_candidates(pairs, chunks, seed=1).collect()
    assert len(rows) == 1200 and all(r.chunk_id != r.pair_id for r in rows)
    assert len({r.chunk_id for r in rows}) > 250 and all(len(r.text) > 1000 for r in rows)


def test_words_without_speaker_stay_with_the_speaker(spark):
    from gleaner.operators import calls

    words = spark.createDataFrame([("r", i, s, i * 1.0, i + 0.5, w) for i, (s, w) in enumerate([("0", "a"), (None, "b"), ("0", "c"), ("1", "d"), (None, "e")])],
                                  "recording_id string, word_no bigint, speaker string, start double, end double, word string")
    assert [(r.speaker, r.text) for r in calls.words_to_segments(words).orderBy("segment_no").collect()] == [("0", "a b c"), ("1", "d e")]


def test_classification_reads_whole_texts(spark):
    from pyspark.sql import functions as F

    from gleaner.operators import classify

    far = spark.createDataFrame([(1, "/a/b.md", "x " * 4000 + "versión 4.2 " + "la de que el y los " * 50)], "doc_id bigint, path string, text string")
    assert classify.extract_versions(far).first().version_min == 4.2
    assert far.select(classify.language(F.col("text")).alias("l")).first().l == "es"
