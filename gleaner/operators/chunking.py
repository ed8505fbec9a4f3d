"""Markdown documents to chunks.

A document is one row, so its sections and paragraphs are arrays inside that row: nothing
is exploded and regrouped, and chunking needs no shuffle at any size of the corpus.

Arrays computed here are never empty and are exploded with the outer variant: for the inner
one Spark infers a non-empty filter and computes the whole array once more for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.dims import DEFAULT_RULE
from gleaner.functions.text import count_tokens, or_blank, strip
from gleaner.session import spread

# Heading lines, question markers, image marks, prefixes.
HEADING_AHEAD = r"(?U)\n(?=#{1,4}[^\S\n][^\n])"
HEADING = r"(?U)^(#{1,4})[^\S\n]+([^\n]*)"
IS_HEADING = r"(?U)^#{1,4}[^\S\n][^\n]"
QUESTION_MARK = r"(?iuU)(?:^|\n)(?:#{1,4}\s*)?(?:P(?:regunta)?|Q)\s*[:\.\-]\s*"
IMAGE_MARKS = ("[Imagen:", "**📷 Imagen:**")
PATH_SEPARATOR = " > "
DEEPEST = 4  # heading levels
TITLE_CHARS = 2**31 - 1

_STRINGS = "array<string>"
_SECTIONS = "array<struct<path:string,text:string,image:boolean>>"


def section_bodies(text: Column) -> Column:
    """Text cut before every heading line of level 1 to 4; a body keeps its heading."""
    return F.split(text, HEADING_AHEAD)


def _heading(body: Column) -> Column:
    found = body.rlike(IS_HEADING)
    return F.struct(F.when(found, F.length(F.regexp_extract(body, HEADING, 1))).otherwise(0).alias("level"),
                    strip(F.regexp_extract(body, HEADING, 2)).alias("title"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` reads it."""
    return F.transform(F.array(value), use)[0]


def _paths_below(group: Column, depth: int, prefix: Column | None) -> Column:
    """Paths of the lines of ``group``, whose first line has ``depth`` and the others more."""
    title = F.substring(F.substring_index(group, "\n", 1), 2, TITLE_CHARS)
    path = title if prefix is None else F.concat(prefix, F.lit(PATH_SEPARATOR), title)
    if depth == DEEPEST:
        return F.array(path)
    parts = F.split(group, rf"\n(?={depth + 1})")
    return F.flatten(F.transform(parts, lambda part, i: F.when(i == 0, F.array(path)).otherwise(_paths_below(part, depth + 1, path))))


def breadcrumbs(headings: Column) -> Column:
    """Path per section from ``struct(level, title)``: a heading of level L cuts the stack to
    L-1 titles and is put on top; skipped levels leave no gap. Level 0 is text before the
    first heading.

    A heading's depth is the least of its level and one more than the depth before it. Depths
    are at most four, so the last four levels decide. Depth and title make a line each, and the
    lines are split at depth 1, each part at depth 2 and so on: every line is read once a
    depth, whatever the number of headings.
    """
    def line(all_: Column, h: Column, i: Column) -> Column:
        before = [F.get(all_, i - back)["level"] + back for back in range(1, DEEPEST)]
        return F.concat(F.least(h["level"], *before, i + 1).cast("string"), h["title"])

    lines = _once(headings, lambda all_: F.array_join(F.transform(all_, lambda h, i: line(all_, h, i)), "\n"))
    parts = F.split(lines, r"\n(?=1)")
    return F.flatten(F.transform(parts, lambda part: F.when(F.startswith(part, F.lit("0")), F.array(F.lit(""))).otherwise(_paths_below(part, 1, None))))


def split_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section_no, body)."""
    return docs.select("doc_id", F.posexplode_outer(section_bodies(or_blank(F.col("text")))).alias("section_no", "body"))


def section_paths(docs: DataFrame) -> DataFrame:
    """(doc_id, section_no, path, body)."""
    rows = docs.select("doc_id", section_bodies(or_blank(F.col("text"))).alias("_b"))
    paths = rows.withColumn("_p", breadcrumbs(F.transform("_b", _heading)))
    return (paths.select("doc_id", F.posexplode_outer(F.arrays_zip(F.col("_p").alias("path"), F.col("_b").alias("body"))).alias("section_no", "s"))
            .select("doc_id", "section_no", F.col("s.path").alias("path"), F.col("s.body").alias("body")))


def pack_paragraphs(text: Column, max_tokens: Column) -> Column:
    """Paragraphs put together while they stay within the budget; one beyond it stays whole."""
    paragraphs = F.transform(F.split(text, r"\n\n"), lambda p: F.struct(p.alias("p"), count_tokens(p).alias("n")))
    start = F.struct(F.array().cast(_STRINGS).alias("done"), F.lit("").alias("cur"), F.lit(0).alias("k"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["n"] + x["n"] > max_tokens) & (acc["k"] > 0)
        more = (acc["k"] > 0) & ~full
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"),
            F.when(more, F.concat(acc["cur"], F.lit("\n\n"), x["p"])).otherwise(x["p"]).alias("cur"),
            F.when(full, 1).otherwise(acc["k"] + 1).alias("k"),
            F.when(full, x["n"]).otherwise(acc["n"] + x["n"]).alias("n"))

    return F.aggregate(paragraphs, start, step, lambda acc: F.array_append(acc["done"], acc["cur"]))


def _fit(sections: Column, max_tokens: Column) -> Column:
    """Sections within the budget as they are, others packed by paragraph."""
    def cut(s: Column) -> Column:
        packed = F.transform(pack_paragraphs(s["text"], max_tokens), lambda t: F.struct(s["path"].alias("path"), t.alias("text"), s["image"].alias("image")))
        return F.when(count_tokens(s["text"]) <= max_tokens, F.array(s)).otherwise(packed)

    return F.flatten(F.transform(sections, cut))


def _with_sections(docs: DataFrame, wanted: Column, images: Column) -> DataFrame:
    """Adds ``_sections`` where ``wanted``; image marks are looked for where ``images``."""
    rows = docs.withColumn("_b", F.when(wanted, section_bodies(or_blank(F.col("text")))))
    rows = rows.withColumn("_p", F.when(wanted, breadcrumbs(F.transform("_b", _heading))))

    def shape(path: Column, body: Column) -> Column:
        marked = F.contains(body, F.lit(IMAGE_MARKS[0])) | F.contains(body, F.lit(IMAGE_MARKS[1]))
        return F.struct(path.alias("path"), body.alias("text"), (images & marked).alias("image"))

    return rows.withColumn("_sections", F.zip_with("_p", "_b", shape)).drop("_b", "_p")


def _single(text: Column) -> Column:
    return F.array(F.struct(F.lit("").alias("path"), text.alias("text"), F.lit(False).alias("image"))).cast(_SECTIONS)


def _questions(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, QUESTION_MARK), strip), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.lit("").alias("path"), p.alias("text"), F.lit(False).alias("image"))).cast(_SECTIONS)


def raw_chunks(docs: DataFrame, unit: Column, max_tokens: Column) -> DataFrame:
    """Adds ``chunk_index``, ``section_path``, ``raw`` and ``has_image_caption``; ``unit`` is
    section, procedure, qa_pair or single (anything else counts as section)."""
    rows = spread(docs, "doc_id").withColumns({"_unit": unit, "_max": max_tokens})
    text = or_blank(F.col("text"))
    rows = rows.withColumn("_q", F.when(F.col("_unit") == "qa_pair", _questions(text)))
    by_section = (F.col("_unit") != "single") & (F.coalesce(F.size("_q"), F.lit(0)) <= 0)
    rows = _with_sections(rows, by_section, F.col("_unit") != "procedure")
    pieces = (F.when(F.col("_unit") == "single", _single(text)).when(by_section, F.col("_sections").cast(_SECTIONS)).otherwise(F.col("_q")))
    rows = rows.withColumn("_pieces", pieces).drop("_q", "_sections")
    rows = rows.withColumn("_chunks", _fit(F.col("_pieces"), F.col("_max")))
    return rows.select(*docs.columns, F.posexplode_outer("_chunks").alias("chunk_index", "_c")).select(
        *docs.columns, "chunk_index", F.col("_c.path").alias("section_path"), F.col("_c.text").alias("raw"), F.col("_c.image").alias("has_image_caption"))


def chunk_unit(docs: DataFrame, unit: str, max_tokens: int) -> DataFrame:
    """Chunks of one unit: (doc_id, chunk_index, section_path, raw, has_image_caption)."""
    slim = docs.select("doc_id", "text")
    return raw_chunks(slim, F.lit(unit), F.lit(max_tokens)).drop("text")


def chunk_documents(docs: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks with their prefixes, documents without any chunk as errors).

    ``docs``: doc_id, text, doc_type, module_id and metadata, which is kept. Blank chunks are
    dropped after numbering, so numbers may have gaps.
    """
    named = docs.join(rules, "doc_type", "left")
    unit, budget, *flags = DEFAULT_RULE
    defaults = {"chunk_unit": unit, "max_tokens": budget, **dict(zip(("breadcrumb", "module_name", "procedure_title"), flags))}
    named = named.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in defaults.items()})
    rows = raw_chunks(named, F.col("chunk_unit"), F.col("max_tokens")).withColumn("raw", strip(F.col("raw"))).where("raw <> ''")
    text = F.col("raw")
    has_path = or_blank(F.col("section_path")) != ""
    for flag, label, value in (("breadcrumb", "Sección", "section_path"), ("module_name", "Módulo", "module_id"), ("procedure_title", "Procedimiento", "section_path")):
        present = (or_blank(F.col("module_id")) != "") if value == "module_id" else has_path
        text = F.when(F.col(flag) & present, F.concat(F.lit(f"{label}: "), F.col(value), F.lit("\n\n"), text)).otherwise(text)
    keep = [c for c in docs.columns if c != "text"]
    chunks = rows.select(*keep, "chunk_index", F.nullif("section_path", F.lit("")).alias("source_section"), "has_image_caption", text.alias("text"))
    empty = docs.where(strip(or_blank(F.col("text"))) == "").select("doc_id", F.lit("no chunks produced").alias("error"))
    return chunks, empty
