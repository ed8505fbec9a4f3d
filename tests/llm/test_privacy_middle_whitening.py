"""Sanitisation, fill-in-middle and whitening against brute force, with nulls, empties, long texts, ties and repeats."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import middle, privacy, whitening
from gleaner.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
HARD = [(None, "no id"), (1, None), (2, ""), (3, " \n\t "), (4, "a\nb\nc"), (4, "a\nb\nc"), (4, "x@y.zz other"), (5, "x" * 9000 + "\n" + "y"),
        (6, "line\n" * 4000), (8, "ä漢\U0001f600\n\n"), (9, "<P>"), (10, "one<\nP>two<S"), (11, "1.2.3.4 " * 300)]


@pytest.fixture(scope="module")
def hard(spark):
    names = ("key", "spans", "mentions", "row", "h0", "n", "output", "restored", "form", "term")
    df = spark.createDataFrame(HARD, "doc_id bigint, text string")
    return df.withColumns({n: F.lit(i) for i, n in enumerate(names)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


# fill-in-middle ------------------------------------------------------------------------------------------------------

def forced_middle(doc_id, text, rate=100, spm_share=50):
    text = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    low, high = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:low]), "".join(u[low:high]), "".join(u[high:])
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(u), "plain", None, None, text
    if h4 % 100 < spm_share:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle_equals_force_and_restores(spark, hard, none):
    rng = random.Random(5)
    rows = HARD + [(100 + i, "".join(rng.choice("a<PSM>\n é") for _ in range(rng.randrange(40)))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for rate, share in ((100, 50), (60, 20), (0, 50)):
        out = middle.restore(middle.transform(docs, rate, share)).collect()
        assert collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in out) == collections.Counter(
            (i, *forced_middle(i, t, rate, share), t or "") for i, t in rows)
    assert middle.restore(middle.transform(hard)).count() == len(HARD)
    assert middle.restore(middle.transform(none)).collect() == []
    assert {"spm", "psm", "plain"} == {r.form for r in middle.transform(docs).collect()}


def test_middle_restores_rows_with_other_columns_and_forms(spark):
    rows = spark.createDataFrame([("<P>a<S>c<M>b", "psm", 1), ("as it is", "plain", 2), (None, None, 3), ("<S>c<P>a<M>b", "spm", 4)], "output string, form string, restored int")
    assert sorted(str(r.restored) for r in middle.restore(rows).collect()) == ["None", "abc", "abc", "as it is"]


def test_middle_units_of_a_batch():
    flat, rows, ordinal, n = middle.units(pa.array(["", "a", "a\n", "\n\nb"]))
    assert (flat.to_pylist(), rows.to_pylist(), ordinal.to_pylist(), n.to_pylist()) == (["a", "a\n", "\n", "\n", "b"], [1, 2, 3, 3, 3], [0, 0, 0, 1, 2], [0, 1, 1, 3])
    assert "op12_fill_middle" in ORACLES


# sanitisation --------------------------------------------------------------------------------------------------------

def passes_luhn(digits):
    return sum((v * 2 - 9 if v > 4 else v * 2) if i % 2 else v for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def forced_base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for k, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (k == 3 or passes_luhn(digits)):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def forced_terms(t):
    """The words that are whole tokens, with their places."""
    return [(m[1].lower(), m.start(1), m.end(1)) for m in re.finditer(r"""(?<![^ \t\n\x0b\x0c\r])[("'\[]*([^\W\d_](?:[^\W\d_]|['’-])*)[)\]"',.;:!?]*(?![^ \t\n\x0b\x0c\r])""", t)]


def forced_contexts(t):
    """(entity, term, start, end) of the whole words within reach of an entity, not past others of its kind."""
    found, out = forced_base(t), set()
    for k, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        hits = [(m.start(), m.end()) for m in re.finditer(pattern, t)]
        for i, (a, z) in enumerate(hits):
            if (a, k, z) not in found:
                continue
            low = hits[i - 1][1] if i else 0
            high = hits[i + 1][0] if i + 1 < len(hits) else len(t)
            entity = (k, t[a:z].lower() if k == 0 else t[a:z] if k == 1 else re.sub("[^0-9]", "", t[a:z]))
            for term, b, e in forced_terms(t):
                # whole tokens between the bounds, none that touches a mention
                left, right = b, e
                while left > 0 and not t[left - 1].isspace():
                    left -= 1
                while right < len(t) and not t[right].isspace():
                    right += 1
                before = right < a and left >= low and (left > low or i == 0) and left >= a - privacy.REACH and (left > a - privacy.REACH or a - low <= privacy.REACH)
                after = left > z and right <= high and (right < high or high == len(t) and i + 1 == len(hits)) and right <= z + privacy.REACH and (right < z + privacy.REACH or high - z <= privacy.REACH)
                if before or after:
                    out.add((entity, term, b, e))
    return out


def test_entities_equal_force(spark):
    rng = random.Random(3)
    parts = ["a", "b@", "@", "c.d", ".", "-", "1", "22", "4111 1111 1111 1111", "+4", "+1 (555) 010-9999", " ", "  ", "0.0.0.0", "10.2.3.4", "255", "256.1",
             "\U0001f600", "é", "_", "x@y.zz", "\n", "000255.1.1.1", "+", "(", ")"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(1500)]
    texts += ["1" * 5000, "a" * 5000 + "@b.c", "1 " * 9000, "x@y.com " * 600, "+1" + " " * 9000 + "2", "a@b.c" * 500, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: [(m.start, m.kind, m.end) for m in r.mentions] for r in privacy.entities(docs).collect()}
    for i, t in enumerate(texts):
        assert sorted(got[i]) == forced_base(t or ""), t


def crowd(rng):
    """Texts in which some names stand by one address, beside names that stand anywhere."""
    people = [(f"Person{chr(97 + i)}", f"user{i}@mail{i % 3}.org") for i in range(6)]
    texts = []
    for i in range(160):
        words = [rng.choice(["Anyone", "some", "word", "The", "(office)", "is", "here,", "12", "x_y"]) for _ in range(rng.randrange(3, 25))]
        name, mail = rng.choice(people)
        if rng.random() < 0.7:
            at = rng.randrange(len(words) + 1)
            words[at:at] = [name + rng.choice(["", ",", ":"]), mail]
        elif rng.random() < 0.4:
            words.insert(0, name)
        if rng.random() < 0.3:
            words.insert(rng.randrange(len(words) + 1), "+1 (555) 010-99" + str(rng.randrange(10, 13)))
        texts.append(rng.choice([" ", "\n"]).join(words))
    return texts + texts[:40]


def test_disclosing_terms_equal_force(spark):
    texts = crowd(random.Random(9)) + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    n = len(texts)
    holds, both, seen, n_term = collections.Counter(), collections.Counter(), collections.defaultdict(set), collections.Counter()
    for t in map(lambda t: t or "", texts):
        pairs = {(c, w) for c, w, _, _ in forced_contexts(t)}
        both.update(pairs)
        for p in pairs:
            seen[p].add(t)
        holds.update({(k, t[a:z].lower() if k == 0 else t[a:z] if k == 1 else re.sub("[^0-9]", "", t[a:z])) for a, k, z in forced_base(t)})
        n_term.update({w for w, _, _ in forced_terms(t)})
    share = {(c, w): math.log(m * n / holds[c] / n_term[w]) / math.log(n / holds[c]) for (c, w), m in both.items() if len(seen[c, w]) >= 3}
    found = privacy.entities(docs)
    got = privacy.disclosure(docs, found, privacy.contexts(found)).collect()
    assert sorted((r.term, r.n_both, r.n_entity, r.n_term, round(r.share, 9)) for r in got) == sorted(
        (w, both[c, w], holds[c], n_term[w], round(x, 9)) for (c, w), x in share.items())
    strongest = sorted(set(share.values()))
    low, high = strongest[-6] - 1e-6, strongest[-3] - 1e-6
    assert any(low <= x < high for x in share.values()) and any(x >= high for x in share.values()) and any(x < low for x in share.values())
    rows = {r.doc_id: r for r in privacy.find(docs, low, high).collect()}
    cleaned = {r.doc_id: r.text for r in privacy.sanitise(docs, low, high).collect()}
    assert len(rows) == len(cleaned) == n
    for i, t in enumerate(texts):
        if t is None:
            assert rows[i].spans == [] and cleaned[i] is None
            continue
        want = {(a, k, z): False for a, k, z in forced_base(t)}
        for c, w, a, z in forced_contexts(t):
            if share.get((c, w), 0) >= low:
                want[a, 4, z] = want.get((a, 4, z), False) or share[c, w] >= high
        assert {(s.start, s.kind, s.end): s.removed for s in rows[i].spans} == want
        out, at = "", 0
        for (a, k, z), removed in sorted(want.items()):
            if a >= at:
                out += t[at:a] + ("" if removed else f"[{privacy.KINDS[k].upper()}]")
            at = max(at, z)
        assert cleaned[i] == out + t[at:]


def test_sanitisation_of_hard_rows(spark, hard, none):
    rows = privacy.report(privacy.find(hard)).collect()
    assert len(rows) == len(HARD)
    for r in rows:
        assert r.n_term == 0 and (r.spans == "") == (r.n_email + r.n_ip == 0)
    for i, t in HARD:
        text = ",".join(f"{privacy.KINDS[k]}:{a}:{z}" for a, k, z in forced_base(t or ""))
        assert (i, hashlib.sha256(text.encode()).hexdigest(), text) in {(r.doc_id, r.base_sha256, r.spans) for r in rows}
    out = privacy.sanitise(hard)
    assert out.columns == hard.columns and out.count() == len(HARD)
    assert {r.text for r in out.where("doc_id = 11").collect()} == {"[IP] " * 300}
    assert privacy.report(privacy.find(none)).collect() == [] and privacy.sanitise(none).collect() == []


def test_running_sums_and_pieces_of_long_arrays(spark):
    for n in (0, 1, 255, 256, 257, 2000):
        row = spark.range(1).select(privacy.running(F.lit(list(range(n))).cast("array<bigint>")).alias("x")).first()
        assert row.x == [i * (i + 1) // 2 for i in range(n)]
    text = "".join(chr(97 + i % 26) + ("\U0001f600" if i % 7 == 0 else "") for i in range(9000))
    spans = [(0, 0, 5), (4000, 1, 9000), (8000, 2, 8500), (9001, 3, 9003)]
    df = spark.createDataFrame([(text, [(*s, False) for s in spans])], "text string, spans array<struct<start:bigint,kind:int,end:bigint,removed:boolean>>")
    assert df.select(privacy.cleaned(F.col("text"), F.col("spans")).alias("x")).first().x == "[EMAIL]" + text[5:4000] + "[IP]" + text[9000:9001] + "[PHONE]" + text[9003:]


# whitening -----------------------------------------------------------------------------------------------------------

def orthogonal(rng, d):
    q = np.linalg.qr(rng.standard_normal((d, d)))[0].astype(np.longdouble)
    for _ in range(4):
        q = q @ (np.longdouble(1.5) * np.eye(d, dtype=np.longdouble) - (q.T @ q) / 2)
    return q


@pytest.mark.parametrize("values", [[3, 2, 1, 0.5], [1, 1 + 1e-9, 1 + 2e-9, 0.5, 0.1], [2.0], [5, 5 - 1e-6, 1e-6, 1e-9], list(1 + np.arange(40) * 1e-8)])
def test_refined_vectors_of_clusters(values):
    rng = np.random.default_rng(2)
    values = np.sort(np.array(values, dtype=np.longdouble))[::-1]
    q = orthogonal(rng, len(values))
    a = ((q * values[None, :]) @ q.T).astype(np.float64)
    a = (a + a.T) / 2
    found, x = whitening.eigen(a)
    assert np.abs(found - values.astype(np.float64)).max() < 1e-15 * float(values[0])
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 2e-15
    gap = min([float(g) for g in -np.diff(values)], default=1.0)
    assert np.abs(np.abs((x * q.astype(np.float64)).sum(axis=0)) - 1).max() < max(1e-15, (4e-16 * float(values[0]) / gap) ** 2 * 100)
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    assert len(a) < 3 or np.abs(rough.T @ rough - np.eye(len(a))).max() > 1e-8         # the start was no better than float32


def test_equal_values_give_orthonormal_vectors():
    for values in ([1, 1, 1, 0.5, 0.5, 0.1, 0, 0], [0, 0], [1, 1]):
        q = orthogonal(np.random.default_rng(4), len(values)).astype(np.float64)
        a = (q * np.array(values)) @ q.T
        found, x = whitening.eigen((a + a.T) / 2)
        assert np.abs(x.T @ x - np.eye(len(a))).max() < 2e-15 and np.abs(a @ x - x * found).max() < 2e-15


def forced_whitening(vectors):
    x = [[math.floor(256 * float(c)) for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), dtype=np.float64)
    n, sums = len(fit), [sum(int(v[j]) for v in set(map(tuple, x))) for j in range(len(x[0]))]
    z = fit - np.array(sums) / n
    values, vecs = np.linalg.eigh(z.T @ z / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    white = (np.array(x) - np.array(sums) / n) @ vecs / np.sqrt(np.where(values > 0, values, 1))
    return n, [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x], white, values / values.sum()


def test_whitening_equals_force(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((300, 7)) * [3, 2, 1.5, 1, 0.5, 0.2, 0.1]).astype(np.float32).tolist()
    vectors += vectors[:50] * 3 + [vectors[0]] * 200
    rows = [(i // 2, v, "x", 1) for i, v in enumerate(vectors)]
    bad = [(None, None), (1, []), (2, [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0]), (3, [float("nan")] * 7), (4, [float("inf")] + [0.0] * 6), (5, [1.0, 2.0])]
    df = spark.createDataFrame(rows + [(i, v, "x", 1) for i, v in bad], "vec_id bigint, embedding array<float>, x string, n int").repartition(5)
    out = whitening.whiten(df, 4).toPandas()
    n, deviation, white, explained = forced_whitening(vectors)
    assert len(out) == 4 * len(vectors) and set(out["n"]) == {n} and out["identity_error"].nunique() == 1 and out["identity_error"][0] < 1e-12
    for c in range(4):
        mine = out[out["component"] == c + 1]
        assert np.allclose(mine["explained"], explained[c], rtol=1e-10)
        ties = [collections.Counter((i // 2, d, round(s * float(w), 7)) for i, (d, w) in enumerate(zip(deviation, white[:, c]))) for s in (1, -1)]
        assert collections.Counter((i, d, round(w, 7)) for i, d, w in zip(mine["vec_id"], mine["deviation"], mine["whitened"])) in ties


def test_whitening_of_few_and_large_vectors(spark):
    kind = "vec_id string, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([("a", None), ("b", [])], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0])] * 3, kind)).collect() == []
    line = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0]), ("b", [2.0, 4.0]), ("c", [3.0, 6.0])], kind)).collect()
    assert {r.component for r in line} == {1} and sorted(round(abs(r.whitened), 9) for r in line) == [0, round(math.sqrt(1.5), 9), round(math.sqrt(1.5), 9)]
    big = whitening.whiten(spark.createDataFrame([("a", [1e9, 0.0]), ("b", [-1e9, 1.0]), ("c", [2e16, 1.0])], kind)).collect()
    assert {r.vec_id for r in big} == {"a", "b", "c"} and all(r.deviation is None for r in big if r.vec_id == "c")


def test_registered_queries_of_these_operators(spark):
    for name in ("op11_disclosing_terms", "op12_fill_middle", "op13_embedding_whitening"):
        assert QUERIES[name](spark, SF).count() > 0
