from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner import dims
from gleaner.operators import cells
from gleaner.operators import enrichment as E
from gleaner.operators import grounding as G
from gleaner.operators import maintenance as M
from gleaner.operators import retrieval as R

CHUNK = "chunk_id int, module_id string, version_min double, version_max double, is_robot_doc boolean, lang string, doc_type string"


def _seen(spark, chunk: tuple, **tenant) -> bool:
    row = (tenant.get("id", "t"), tenant.get("version"), tenant.get("legacy"), tenant.get("modules", []), tenant.get("robot", True), tenant.get("lang"))
    config = R.tenant_config(dims.tenants(spark, [row]))
    return R.visible_chunks(spark.createDataFrame([(1, *chunk)], CHUNK), config).count() == 1


@pytest.mark.parametrize("chunk, tenant, expected", [
    ((None, 0.0, None, False, None, "x"), {}, True),
    ((None, 0.0, None, True, None, "x"), {"robot": False}, False),
    (("robotics", 0.0, None, False, None, "x"), {"modules": ["robotics"]}, True),
    (("", None, None, False, None, "x"), {"modules": ["robotics"]}, True),
    ((None, None, None, None, None, "x"), {"modules": ["robotics"], "robot": False}, True),
    (("other", 0.0, None, False, None, "x"), {"modules": ["robotics"]}, False),
    ((None, 4.0, None, False, "es", "x"), {"version": "5.0", "lang": "es"}, True),
    ((None, 6.0, None, False, "es", "x"), {"version": "5.0"}, False),
    ((None, 4.0, 4.5, False, "es", "x"), {"version": "5.0"}, False),
    ((None, 4.0, None, False, None, "x"), {"lang": "es"}, True),
    ((None, 4.0, None, False, "ca", "x"), {"lang": "es"}, False),
    ((None, 4.0, None, False, None, "changelog_pure"), {}, False),
    ((None, 4.0, 5.0, False, None, "changelog_pure"), {"version": "5.0"}, True),
    ((None, 6.0, None, False, None, "changelog_pure"), {"version": "5.0"}, False),
    ((None, 4.0, 4.5, False, None, "changelog_pure"), {"legacy": "5.0"}, False),
])
def test_visibility(spark, chunk, tenant, expected):
    assert _seen(spark, chunk, **tenant) is expected


def test_tenants_with_equal_settings(spark):
    config = R.tenant_config(dims.tenants(spark, [(f"t{i}", None, None, [], i % 2 == 0, None) for i in range(5)]))
    chunks = spark.createDataFrame([(1, None, 0.0, None, True, None, "x"), (2, None, 0.0, None, False, None, "x")], CHUNK)
    got = {(r.tenant_id, r.chunk_id) for r in R.visible_chunks(chunks, config).collect()}
    assert got == {(f"t{i}", c) for i in range(5) for c in (1, 2) if c == 2 or i % 2 == 0}


def test_version_preference(spark):
    rows = [("a", "5.0", "3.0", [], True, None), ("b", None, "3.1", [], True, None), ("c", "", "x", [], True, None)]
    assert {r.tenant_id: r.version for r in R.tenant_config(dims.tenants(spark, rows)).collect()} == {"a": 5.0, "b": 3.1, "c": None}


def _vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    return [[float(x) for x in rng.normal(size=dim)] for _ in range(n)]


def test_top_k_plans_agree_with_brute_force(spark):
    corpus, asked = _vectors(60, 8, 1), _vectors(9, 8, 2)
    corpus[7] = corpus[3]            # a tie, broken by id
    corpus[11] = [0.0] * 8           # no direction, score 0
    chunks = spark.createDataFrame([(i, "m", 0.0, None, i % 3 == 0, "en", "x", f"d{i}", None, v) for i, v in enumerate(corpus)],
                                   CHUNK + ", source_doc string, source_section string, embedding array<float>")
    queries = spark.createDataFrame([(i, "open" if i % 2 else "shut", v) for i, v in enumerate(asked)], "query_id int, tenant_id string, embedding array<float>")
    config = R.tenant_config(dims.tenants(spark, [("open", None, None, [], True, None), ("shut", None, None, [], False, None)]))

    def run(**kw):
        return {(r.query_id, r.vector_rank): r.chunk_id for r in R.vector_top_k(queries, chunks, config, k=4, **kw).collect()}

    c = np.array(corpus, dtype=np.float32).astype(float)
    q = np.array(asked, dtype=np.float32).astype(float)
    expected = {}
    for i in range(len(asked)):
        norm = np.linalg.norm(c, axis=1) * np.linalg.norm(q[i])
        score = np.round(np.where(norm > 0, c @ q[i] / np.where(norm > 0, norm, 1), 0), 10)
        ok = [j for j in range(60) if i % 2 or j % 3]
        for rank, j in enumerate(sorted(ok, key=lambda j: (-score[j], j))[:4], 1):
            expected[(i, rank)] = j
    assert run() == expected
    assert run(cell_rows=5, part_rows=4, probe_block=2) == expected


def _search(spark, corpus, probes, k, **sizes):
    rows = spark.createDataFrame([(i, v, None) for i, v in enumerate(corpus)], "chunk_id int, vector array<double>, seen_by array<bigint>").repartition(3)
    asked = spark.createDataFrame([(i, v, 0) for i, v in enumerate(probes)], "query_id int, vector array<double>, profile bigint")
    index = cells.build(rows, "chunk_id", "test", **sizes)
    best = {}
    for r in cells.nearest(index, asked, k, "chunk_id", "query_id", []).collect():
        best.setdefault(r.query_id, []).append((-r.score, r.chunk_id))
    return {q: sorted(b)[:k] for q, b in best.items()}, cells.scanned_share(index, asked, k, "chunk_id", "query_id"), index


def _all_pairs(corpus, probes, k):
    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or any(x is None or x != x for x in a + b):
            return 0.0
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(np.dot(a, b) / n), 10) if n else 0.0

    return {q: sorted((-cosine(p, v), i) for i, v in enumerate(corpus))[:k] for q, p in enumerate(probes)}


def test_cell_index_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 12))
    crowded = [(centres[rng.integers(20)] + rng.normal(size=12) * 0.15).tolist() for _ in range(800)] + [centres[0].tolist()] * 300
    probes = [(centres[i % 20] + rng.normal(size=12) * 0.15).tolist() for i in range(40)]
    got, share, index = _search(spark, crowded, probes, 5, cell_rows=40, part_rows=64)
    want = _all_pairs(crowded, probes, 5)
    assert {q: [s for s, _ in b] for q, b in got.items()} == {q: pytest.approx([s for s, _ in b], abs=2e-10) for q, b in want.items()}
    assert share < 0.5 and index.parts["rows"].sum() == 1100
    assert index.parts["rows"].max() < 200                       # the 300 equal vectors are several parts
    spread_out = _vectors(300, 12, 8)
    got, share, _ = _search(spark, spread_out, probes, 7, cell_rows=30, part_rows=1000)
    assert {q: [i for _, i in b] for q, b in got.items()} == {q: [i for _, i in b] for q, b in _all_pairs(spread_out, probes, 7).items()} and share <= 1


def test_cell_index_of_odd_vectors(spark):
    odd = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [1.0, 0.0], [-1.0, 0.1], [1.0, 2.0, 3.0], [3.0, 2.0, 1.0], [0.0, 1.0], [2.0, 0.0]]
    probes = [[1.0, 0.0], [1.0, 2.0, 3.0], [0.0, 0.0], None, [5.0], [1.0, None]]
    for sizes in ({}, {"cell_rows": 1, "part_rows": 1}):
        got, _, _ = _search(spark, odd, probes, 6, **sizes)
        assert got == _all_pairs(odd, probes, 6)
    assert _search(spark, [], probes, 3)[0] == {} and _search(spark, odd, [], 3)[0] == {}


def test_visibility_of_many_tenants(spark):
    rng = np.random.default_rng(6)
    modules = ["alpha", "beta", "gamma", " "]
    rows = [(f"t{i}", str(rng.integers(1, 6)) if i % 4 else None, None, list(rng.choice(modules, size=i % 4)), bool(i % 2), ["en", "es", None, ""][i % 4]) for i in range(400)]
    chunks = spark.createDataFrame([(i, [None, "", "alpha", "beta", " "][i % 5], float(i % 4), None if i % 3 else float(i % 6), i % 7 == 0, ["en", "", None, "es"][i % 4],
                                     "changelog_pure" if i % 9 == 0 else "x") for i in range(120)], CHUNK)
    config = R.tenant_config(dims.tenants(spark, rows)).drop("lang")
    one_by_one = set()
    for t in config.collect():
        some = F.array(*[F.lit(m) for m in t["modules"] or []]).cast("array<string>")
        seen = R.visible(some, F.lit(t["version"]).cast("double"), F.lit(t["has_robot"]), F.lit(t["preferred_lang"]).cast("string"))
        if int(t["tenant_id"][1:]) % 23 == 0:
            one_by_one |= {(t["tenant_id"], r.chunk_id) for r in chunks.where(seen).collect()}
    got = R.visible_chunks(chunks, config).select("tenant_id", "chunk_id").collect()
    assert len(got) == len(set(map(tuple, got))) and {tuple(r) for r in got if int(r.tenant_id[1:]) % 23 == 0} == one_by_one
    assert R.visible_chunks(chunks, config.limit(0)).collect() == []


def test_lexical_passes_agree(spark):
    docs = spark.createDataFrame([(i, f"word{i % 5} common text {i}") for i in range(40)], "doc_id int, text string")
    queries = spark.createDataFrame([(i, f"common word{i} nothing") for i in range(6)], "query_id int, question string")
    one = {(r.query_id, r.vector_rank): (r.chunk_id, round(r.score, 8)) for r in R.lexical_top_k(queries, docs, 3).collect()}
    many = {(r.query_id, r.vector_rank): (r.chunk_id, round(r.score, 8)) for r in R.lexical_top_k(queries, docs, 3, passes=3).collect()}
    assert one == many and one[(2, 1)][0] == 2 and len(one) == 15


def test_boost_diversity_and_related(spark):
    cands = spark.createDataFrame([(1, i, i + 1, d, s) for i, (d, s) in enumerate([("x.pdf", None), ("x.pdf", "s"), ("x.pdf", "s"), ("User_Guide.pdf", "s"), ("z.pdf", None)])],
                                  "query_id int, chunk_id int, vector_rank int, source_doc string, source_section string")
    queries = spark.createDataFrame([(1, "the user guide?")], "query_id int, question string")
    boosted = R.title_boost(R.rank_passthrough(cands), queries)
    assert {r.chunk_id: round(r.boosted_score, 4) for r in boosted.collect()} == {0: 1.0, 1: 0.99, 2: 0.98, 3: 1.03, 4: 0.96}
    top = R.doc_diversity(boosted, k=3)
    assert [r.chunk_id for r in top.orderBy("rank").collect()] == [3, 0, 1]
    assert [(r.source_doc, r.relevance) for r in R.related_docs(cands, top).collect()] == [("z.pdf", "Sección: N/A")]


def test_unknown_reranker(spark):
    with pytest.raises(ValueError):
        R.apply_rerank_scores(spark.range(1), spark.range(1), "mystery")


# --- glossary -----------------------------------------------------------------------

def _ask(spark, text, tenant="demo", glossary=None, **kw):
    q = spark.createDataFrame([(1, text, tenant)], "query_id int, question string, tenant_id string")
    g = (glossary or dims.glossary(spark)).withColumn("updated_at", F.lit("t"))
    return E.preprocess_queries(q, g, **kw).first()


def test_enrichment(spark):
    hit = _ask(spark, "how do I set up single sign on")
    assert hit.matched_terms == ["SSO"] and hit.original == "how do I set up single sign on"
    assert hit.retrieval_query == "how do I set up single sign on SSO single sign-on authentication SAML OIDC"
    assert "two-factor" in _ask(spark, "error with 2fa").retrieval_query
    assert _ask(spark, "xyzzy plugh frobnicate").retrieval_query == "xyzzy plugh frobnicate"
    assert _ask(spark, "a").retrieval_query == "a"
    off = _ask(spark, "how do I set up single sign on", enabled=False)
    assert off.matched_terms == [] and off.retrieval_query == off.original


def test_tenant_entry_hides_global(spark):
    rows = [(1, dims.GLOBAL_TENANT, "SRC", ["alpha"], "global", True), (2, "t", "src", ["beta"], "own", True), (3, "t", "off", ["alpha"], "x", False)]
    g = dims.glossary(spark, rows)
    assert _ask(spark, "about alpha", "t", g).matched_terms == []
    assert _ask(spark, "about beta", "t", g).expansions == ["own"]
    assert _ask(spark, "about alpha", "other", g).expansions == ["global"]
    assert _ask(spark, "about alphabet", "other", g).matched_terms == []


def test_corrections(spark):
    q = spark.createDataFrame([(i, "como cierro la caja", None) for i in range(5)], "query_id int, question string, tenant_id string")
    a = spark.createDataFrame([(0, '{"corrected": "cómo cierro la caja", "expansions": ["cierre"]}'), (1, '{"corrected": "vender coches nuevos hoy"}'), (2, '{"ambiguous": true}'), (3, "?"), (4, "{}")], "query_id int, reply string")
    got = {r.query_id: (r.corrected, r.extras, r.reason) for r in E.apply_corrections(q, a).collect()}
    assert got == {0: ("cómo cierro la caja", ["cierre"], None), 1: (None, [], "over_correction"), 2: (None, [], "ambiguous"), 3: (None, [], "ai_parse_error"), 4: (None, [], "ai_parse_error")}
    empty = dims.glossary(spark, [(1, "z", "unused", [], "", True)]).withColumn("updated_at", F.lit("t"))
    out = {r.query_id: r for r in E.preprocess_queries(q, empty, corrections=E.apply_corrections(q, a)).collect()}
    assert out[0].ai_used and out[0].corrected == "cómo cierro la caja" and out[1].corrected == "como cierro la caja" and not out[1].ai_used


def test_fingerprint_follows_edits(spark):
    def prints(rows):
        return {r.tenant_id: r.fingerprint for r in E.glossary_fingerprint(dims.glossary(spark, rows).withColumn("updated_at", F.lit("t"))).collect()}

    rows = [(1, dims.GLOBAL_TENANT, "A", ["x", "y"], "e", True), (2, dims.GLOBAL_TENANT, "B", [], "", True), (3, "t", "a", ["z"], "", True)]
    base = prints(rows)
    assert prints(rows[::-1]) == base
    assert prints([rows[0], rows[1][:4] + ("new", True), rows[2]])["t"] != base["t"]
    hidden = prints([rows[0][:4] + ("changed", True), *rows[1:]])
    assert hidden["t"] == base["t"] and hidden[dims.GLOBAL_TENANT] != base[dims.GLOBAL_TENANT]


def test_patches(spark):
    base = dims.glossary(spark).where("id <= 3").withColumn("updated_at", F.lit("old"))
    schema = "id int, op string, tenant_id string, term string, aliases array<string>, expansion string, enabled boolean"
    patches = spark.createDataFrame([(1, "update", " ", None, [" a ", " "], None, None), (2, "delete", None, None, None, None, None), (9, "delete", None, None, None, None, None),
                                     (10, "create", None, " New ", None, None, None), (11, "create", None, "  ", None, None, None)], schema)
    table, bad = M.patch_glossary(base, patches, "now")
    got = {r.id: (r.tenant_id, r.term, r.aliases, r.updated_at) for r in table.collect()}
    assert set(got) == {1, 3, 10} and got[1][0] == dims.GLOBAL_TENANT and got[1][2] == ["a"] and got[1][3] == "now" and got[3][3] == "old"
    assert got[10] == (dims.GLOBAL_TENANT, "New", [], "now")
    assert {r.id: r.reason for r in bad.collect()} == {9: "unknown id", 11: "term is required"}


# --- planner and grounding ------------------------------------------------------------

def test_planner(spark):
    rows = ['{"action":"search","final_query":"cerrar caja diaria","confidence":0.9}', '<think>hmm</think>\n```json\n{"action":"search","confidence":0.9}\n```', "not json at all",
            '{"action":"ask_clarification","clarification_question":"¿Cuál?","confidence":0.4}', '{"action":"ask_clarification","clarification_question":"¿Cuál?","confidence":0.95}',
            '{"action":"ask_clarification","clarification_question":"","confidence":0.99}', '{"action":"no_answer"}']
    df = spark.createDataFrame([(i, "como cierro la caja", "como cierro la caja", "como cierro la caja diario", r) for i, r in enumerate(rows)], "query_id int, original string, corrected string, retrieval_query string, reply string")
    got = {r.query_id: r for r in G.planner_decision(df).collect()}
    assert [got[i].action for i in range(7)] == ["search", "search", "search", "search", "ask_clarification", "search", "search"]
    assert got[0].final_query == "cerrar caja diaria" and got[1].confidence == 0.9
    assert not got[2].used and got[2].fallback_reason == "parse_error" and got[2].retrieval_query == "como cierro la caja diario"


def test_model_chain(spark):
    rows = [(1, 0, "a", None, True), (1, 1, "b", " fine ", False), (2, 0, "zzz", "ok", False), (3, 0, "a", " ", False)]
    out = {r.query_id: (r.text, r.model, r.fell_back) for r in G.first_success(spark.createDataFrame(rows, "query_id int, attempt int, model string, text string, failed boolean"), spark.createDataFrame([("a",), ("b",)], "model string"), "a").collect()}
    assert out == {1: ("fine", "b", True), 2: ("ok", "a", False), 3: ("", None, False)}


def test_grounding(spark):
    answers = spark.createDataFrame([("ok", "The backup runs nightly. It stores encrypted archives."), ("half", "The backup runs nightly. Purple elephants dance gracefully."), ("none", "Something without chunks here."), ("blank", "")], "answer_id string, answer string")
    chunks = spark.createDataFrame([("ok", "backup runs nightly and stores encrypted archives"), ("half", "backup runs nightly"), ("none", " ")], "answer_id string, text string")
    got = {r.answer_id: (r.grounded, r.grounded_ratio, r.checked, r.unsupported) for r in G.ground_answers(answers, chunks).collect()}
    assert got == {"ok": (True, 1.0, 2, 0), "half": (False, 0.5, 2, 1), "none": (False, 0.0, 1, 1), "blank": (True, 1.0, 0, 0)}
    assert {r.answer_id: r.grounded for r in G.ground_answers(answers, chunks, 0.5).collect()}["half"]
    safe = {r.answer_id: r.answer for r in G.guard_answers(answers, G.ground_answers(answers, chunks), chunks).collect()}
    assert safe["half"] == G.FALLBACK_ANSWER and safe["ok"].startswith("The backup")


def test_no_questions_give_no_rows(spark):
    from gleaner.operators import retrieval

    docs = spark.createDataFrame([(1, "some words here")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "query_id bigint, question string")
    assert retrieval.lexical_top_k(none, docs).count() == 0


@pytest.mark.parametrize("bits, broadcast", [(2**20, 500_000), (64, 0)])  # the second lets almost every run through
def test_glossary_matches_brute_force(spark, monkeypatch, bits, broadcast):
    monkeypatch.setattr(E, "FILTER_BITS", bits)
    monkeypatch.setattr(E, "BROADCAST_ALIASES", broadcast)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    entries = [(i, "__global__", f"term {i}", [" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(3)], "x", True, "t") for i in range(60)]
    asked = [(i, " ".join(rng.choices(words + ["term 7", "Term 9"], k=rng.choice([0, 1, 2, 300]))), None) for i in range(60)]
    found = E.match_glossary(
        spark.createDataFrame(asked, "query_id int, question string, tenant_id string"),
        spark.createDataFrame(entries, "id int, tenant_id string, term string, aliases array<string>, expansion string, enabled boolean, updated_at string"))
    expected = {(q, e[0]) for q, text, _ in asked for e in entries if any(f" {a} " in f" {text.lower()} " for a in [e[2], *e[3]])}
    assert sorted((r.query_id, r.id) for r in found.collect()) == sorted(expected)


def test_probes_are_sent_once_a_bundle(spark):
    rng = np.random.default_rng(9)
    corpus = [v.tolist() for v in rng.normal(size=(400, 6))]
    rows = spark.createDataFrame([(i, v, None) for i, v in enumerate(corpus)], "chunk_id int, vector array<double>, seen_by array<bigint>")
    index = cells.build(rows, "chunk_id", "bundles", cell_rows=20, part_rows=16)
    assert len(index.parts) > 10 and cells.bundles_of(index) == len(index.parts) // (cells.BUNDLE_PARTS + 1) + 1
    asked = spark.createDataFrame([(i, v, 0) for i, v in enumerate(corpus[:30])], "query_id int, vector array<double>, profile bigint")
    sent = cells.needed(index, cells._ready(asked, "query_id", -2.0), None).collect()
    assert len(sent) == 30 * cells.bundles_of(index)          # one row for each part before
    assert sum(r.mask.bit_count() for r in sent) == 30 * len(index.parts)


def test_close_pairs_are_exact():
    rng = np.random.default_rng(10)
    rows, probes = (m / np.linalg.norm(m, axis=1)[:, None] for m in (rng.normal(size=(500, 9)), rng.normal(size=(40, 9))))
    rows[100:140] = rows[7]                                    # ties
    score = np.round(probes @ rows.T, cells.DIGITS)
    floor = np.where(np.arange(40) % 2, 0.4, -2.0)
    got = {(i, j): v for block in cells.close(probes, rows, floor) for i, j, v in zip(*(x.tolist() for x in block))}
    assert got == pytest.approx({(i, j): score[i, j] for i in range(40) for j in range(500) if score[i, j] >= floor[i]}, abs=2e-10)
    some = {(i, j) for block in cells.close(probes, rows, floor, 5) for i, j in zip(*(x.tolist() for x in block[:2]))}
    for i in range(40):
        best = sorted(range(500), key=lambda j: (-score[i, j], j))[:5]
        assert {(i, j) for j in best if score[i, j] >= floor[i]} <= some
    assert len(some) < 40 * 60
    kind = cells.kinds(rows)
    kept = cells.first_of_equals(np.arange(500), kind, np.arange(500), 3)
    assert 7 in kept and [j for j in range(100, 140) if j in kept] == [100, 101] and len(kept) == 462


def test_word_search_holds_one_index_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(11)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(400)]
    texts = [" ".join([*rng.choice(common, 8), *rng.choice(rare, 12)]) for _ in range(240)] + ["", "c1 c2"]
    texts[30] = texts[31] = texts[32]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    asked = docs.where("doc_id % 3 = 0").selectExpr("doc_id AS query_id", "text AS question")

    def found(**kw):
        return {(r.query_id, r.vector_rank): (r.chunk_id, r.score) for r in R.lexical_top_k(asked, docs, 4, **kw).collect()}

    whole = found(passes=1)
    n = len(texts)
    words = [set(t.split()) for t in texts]
    weight = {w: math.log((n + 1) / (sum(w in s for s in words) + 1)) for s in words for w in s}
    for q in (0, 30, 99):
        total = sum(weight[w] for w in words[q])
        score = [round(sum(weight[w] for w in words[q] & s) / total, 10) for s in words]
        best = sorted((j for j in range(n) if score[j] > 0), key=lambda j: (-score[j], j))[:4]
        assert [whole[q, r + 1][0] for r in range(4)] == best
    alive, most = set(), []
    make = spark.sparkContext.broadcast

    def broadcast(value):
        b = make(value)
        alive.add(id(b))
        most.append(len(alive))
        end = b.destroy
        b.destroy = lambda *a, **kw: (alive.discard(id(b)), end(*a, **kw))
        return b

    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    monkeypatch.setattr(R, "FLOOR_DOCS", 60)                   # floors and light words take part
    assert {k: (c, pytest.approx(s, abs=2e-10)) for k, (c, s) in found(passes=5).items()} == whole
    assert max(most) == 1 and len(most) > 5                    # five at once before
