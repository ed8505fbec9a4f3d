from __future__ import annotations

import random
import re
import time
import unicodedata

from pyspark.sql import functions as F

from gleaner import dims
from gleaner.functions import replies
from gleaner.functions import text as T
from gleaner.operators import chunking as K
from gleaner.operators import classify as C
from gleaner.operators import documents as D
from gleaner.sources import markup


def test_normalize(one):
    assert one(T.normalize_text, "¿Cómo  HAGO un Encargo?", "h.c.p.", "Ångström ﬁ_x") == ["como hago un encargo", "h c p", "angstrom ﬁ x"]
    assert one(T.normalize_ascii, " Año-2:  ß ") == "ano 2"
    assert one(T.norm_section, "  Intro \n TWO ") == "intro two"


def test_fold_matches_unicode_rules(one):
    text = "ÀÉîöÜñçŁøẞ ΆΈ й ё"
    folded = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    assert one(T.fold_accents, text) == folded


def test_preview(one):
    assert one(lambda c: T.preview(c, 5), "  abcdef ", " ab ") == ["abcd…", "ab"]


def test_file_names(one):
    assert one(T.stored_file_name, "a/../My doc (1).PDF", " ", "x" * 300 + ".md") == ["My_doc__1_.pdf", "document", "x" * 160 + ".md"]
    assert one(T.display_file_name, "0123456789ab_Guide.pdf", "12__1_File.docx", " ", "plain.txt") == ["Guide.pdf", "File.docx", "—", "plain.txt"]


def test_clean_ocr(one):
    # Expected values follow from the rules, computed here with the re module.
    raw = "Intro .....oo cc.. 12\nsoooooo good\nwait......now\nthe the the the end\na    b\n123 456 789 0\n\n\n\n\n\nlast"
    text = re.sub(r"[.oOcCnNrR ]{10,}\d+\s*$", "", raw, flags=re.M)
    text = re.sub(r"([a-záéíóúñ])\1{4,}", r"\1\1", text, flags=re.I)
    text = re.sub(r"\.{5,}", "...", text)
    text = re.sub(r"\b(\w{2,})\s+(?:\1\s+){2,}", r"\1 ", text, flags=re.I)
    text = re.sub(r"[ \t]{3,}", " ", text)
    lines = ["" if not x.strip() else x for x in text.split("\n") if len(x.strip()) <= 5 or sum(ch.isalpha() for ch in x) / len(x.strip()) >= 0.15]
    assert one(T.clean_ocr_text, raw) == re.sub(r"\n{4,}", "\n\n\n", "\n".join(lines))


def test_placeholders(one):
    far = "clic " + "x" * 40 + " ()"
    assert one(T.clean_placeholders, "Haga clic en ()", "sin nada ( )", "icono ()", far, "a ==> picture [1 x 2] intentionally omitted <== b") == [
        "Haga clic en (botón)", "sin nada (icono)", "icono (icono)", "clic " + "x" * 40 + " (icono)", "ab"]


def test_truncate(one):
    assert one(lambda c: T.truncate_tokens(c, 3), "one, two three", "a b") == ["one, two", "a b"]


# --- classification -------------------------------------------------------------

def test_types(one):
    assert one(C.normalize_doc_type, "faq", "User_Manual ", "installation_manual", "release_notes", "structured_manual", "nonsense", "presentation") == [
        "faq_document", "structured_manual", "module_manual", "changelog_pure", "structured_manual", "structured_manual", "presentation"]


def _doc(spark, path, text):
    return spark.createDataFrame([("d", path, text)], "doc_id string, path string, text string")


def test_classify_without_reply(spark):
    row = C.classify_documents(_doc(spark, "/x/FAQ_clientes.pdf", "¿Cómo hago una consulta? Respuesta: así. versión 4.5.1 y v3")).first()
    assert (row.doc_type, row.format, row.version_min, row.version_max, row.discard) == ("faq_document", "pdf", 3.0, 4.5, False)
    assert row.lang in ("es", "ca")


def test_changelog_rules(spark):
    pure = C.classify_documents(_doc(spark, "/x/changelog_v5.md", "short")).first()
    assert (pure.doc_type, pure.discard) == ("changelog_pure", True)
    manual = C.classify_documents(_doc(spark, "/x/changelog_v5.md", "configuración de la pantalla")).first()
    assert (manual.doc_type, manual.discard) == ("changelog_as_manual", False)


def test_module(one):
    stem = F.lit("x")
    assert one(lambda c: C.extract_module(stem, F.lower(c)), "Module: Stock Control, more", "the connector", "nothing") == ["stock control", "connector", None]


def test_type_reply(spark):
    rows = [(1, "x" * 50, '```json\n{"type_id":"operational_guide","confidence":2}\n```'), (2, "x" * 50, 'Sure! {"type_id":"technical_spec"} done'),
            (3, "x" * 50, "no json"), (4, "short", '{"type_id":"faq"}'), (5, "x" * 50, '{"type_id":"Unknown"}')]
    out = {r.doc_id: (r.type_id, r.confidence) for r in C.parse_type_reply(spark.createDataFrame(rows, "doc_id int, text string, reply string")).collect()}
    assert out == {1: ("operational_guide", 1.0), 2: ("technical_spec", 0.7), 3: (None, None), 4: (None, None), 5: (None, None)}


# --- chunking ----------------------------------------------------------------------

def _paths(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return [(r.path, r.body) for r in K.section_paths(docs).orderBy("section_no").collect()]


def test_breadcrumbs(spark):
    assert [p for p, _ in _paths(spark, "# A\n### C\n## B\nx")] == ["A", "A > C", "A > B"]
    assert _paths(spark, "before\n##### no\n# \n#x\n## Y ") == [("", "before\n##### no\n# \n#x"), ("Y", "## Y ")]
    assert _paths(spark, "") == [("", "")]


def test_sections_join_back(spark):
    text = "a\n# B\nc\n\n## D\n\ne\n#### F\n"
    assert "\n".join(b for _, b in _paths(spark, text)) == text


def test_pack_at_budget(spark):
    docs = spark.createDataFrame([(1, "a b\n\nc d\n\ne f g h i j\n\nk")], "doc_id int, text string")
    rows = K.chunk_unit(docs, "single", 4).orderBy("chunk_index").collect()
    assert [r.raw for r in rows] == ["a b\n\nc d", "e f g h i j", "k"]


def test_questions(spark):
    docs = spark.createDataFrame([(1, "Q: one?\nyes\n## P. two"), (2, "# T\nno marks")], "doc_id int, text string")
    rows = K.chunk_unit(docs, "qa_pair", 100).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.section_path, r.raw) for r in rows] == [(1, "", "one?\nyes"), (1, "", "two"), (2, "", "# T\nno marks")]


def test_chunk_documents(spark):
    docs = spark.createDataFrame([
        (1, "# A\ntext [Imagen: x]", "structured_manual", None), (2, "# A\nbody", "module_manual", "stock"), (3, "# P\ndo it", "operational_guide", None),
        (4, "\n# H\nx", "mystery", None), (5, "  ", "faq_document", None)], "doc_id int, text string, doc_type string, module_id string")
    chunks, errors = K.chunk_documents(docs, dims.doc_type_rules(spark))
    got = {(r.doc_id, r.chunk_index): (r.text, r.source_section, r.has_image_caption) for r in chunks.collect()}
    assert got == {(1, 0): ("Sección: A\n\n# A\ntext [Imagen: x]", "A", True), (2, 0): ("Módulo: stock\n\n# A\nbody", "A", False),
                   (3, 0): ("Procedimiento: P\n\n# P\ndo it", "P", False), (4, 1): ("# H\nx", "H", False)}
    assert [r.doc_id for r in errors.collect()] == [5]


def test_captions_by_page(spark):
    docs = spark.createDataFrame([(1, "t\n## Página 1\na\n## Page 2\nb")], "doc_id int, text string")
    caps = spark.createDataFrame([(1, "image_p1_0.png", "one"), (1, "image_p2_0.png", "two"), (1, "image_p9_0.png", "nine")], "doc_id int, file_name string, caption string")

    def block(n, c):
        return f"\n![image_p{n}_0.png](/corpus/1/media/image_p{n}_0.png)\n> **📷 Imagen:** {c}\n"

    assert D.insert_captions(docs, caps).first().text == "\n".join(["t", "## Página 1", "a", block(1, "one"), "## Page 2", "b", block(2, "two"), block(9, "nine")])


def test_html(spark):
    pages = spark.createDataFrame([(1, "<html><head><title>x</title></head><body><h2>A &amp; B</h2><p>c<br>d</p><script>1</script><ul><li>e</li></ul></body></html>"), (2, "<p> </p>")], "page_id int, html string")
    good, bad = markup.pages_to_markdown(pages)
    assert good.first().markdown == "## A & B\n\nc\nd\n\n- e"
    assert [r.page_id for r in bad.collect()] == [2]


def test_json_repairs(one):
    def parsed(c):
        return replies.parse_object(replies.drop_trailing_commas(replies.json_object(replies.fenced_body(c))), "a string, b array<string>")

    rows = one(parsed, 'x ```json\n{"a": "one\ntwo, }", "b": ["c",],}\n``` y', "{broken", '{"a": 1')
    assert rows[0].a == "one\ntwo, }" and rows[0].b == ["c"] and rows[1:] == [None, None]


def test_long_documents_come_in_volumes(spark, monkeypatch):
    monkeypatch.setattr(D, "VOLUME_BLOCKS", 3)
    pages = spark.createDataFrame([("big", i, f"p{i}", False) for i in range(7)] + [("small", 0, "s", False), ("small", 1, " ", False), ("small", 2, "o", True)], "doc_id string, page int, text string, is_ocr boolean")
    rows = D.join_blocks(D.page_blocks(pages)).orderBy("doc_id", "volume").collect()
    assert [r.text for r in rows if r.doc_id == "small"] == ["s\n\n## Página 3\n\no"]
    big = [r.text.split("\n\n") for r in rows if r.doc_id == "big"]
    assert sum(big, []) == [f"p{i}" for i in range(7)] and max(map(len, big)) <= 3


def test_breadcrumbs_match_the_stack(spark):
    rng = random.Random(3)
    docs, expected = [], {}
    for doc in range(300):
        lines, stack, at = [], [], 0
        if doc % 3 == 0:
            lines.append("opening")
            expected[doc, 0], at = "", 1
        for i in range(rng.choice([0, 1, 5, 40])):
            level, title = rng.randint(1, 4), rng.choice(["A", "2 b", "1", "# x", "c > d"])
            stack = (stack[:level - 1] if level <= len(stack) else stack) + [title]
            lines.append("#" * level + " " + title)
            expected[doc, at + i] = " > ".join(stack)
        docs.append((doc, "\n".join(lines)))
        expected.setdefault((doc, 0), "")
    rows = K.section_paths(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert {(r.doc_id, r.section_no): r.path for r in rows} == expected


def test_many_headings_cost_no_more_each(spark):
    def seconds(n):
        text = "\n".join("#" * (1 + i * 7 % 4) + f" title {i}" for i in range(n))
        df = K.section_paths(spark.createDataFrame([(i, text) for i in range(64_000 // n)], "doc_id int, text string").coalesce(1))
        df.agg(F.sum(F.hash("path"))).collect()
        t0 = time.time()
        df.agg(F.sum(F.hash("path"))).collect()
        return time.time() - t0

    assert seconds(16_000) < 3 * seconds(1_000) + 1
