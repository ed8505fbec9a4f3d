"""Pages and captions to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import letters, or_blank, squeeze, strip

# Sparse pages, caption limits, refusals, page headings.
SPARSE_CHARS = 100
VOLUME_BLOCKS = 10_000  # pages put together in one text
SPARSE_SHARE = 0.5
LABEL_LETTERS = 0.6
ICON_CHARS = 60
REFUSAL_CHARS = 200
REFUSALS = (r"(?i)no puedo|cannot|can't|unable to|borroso|blurry|not relevant|no es posible|no relacionad|"
            r"not related|low quality|too small|I'm sorry|lo siento|I cannot")
PAGE_HEADING = r"(?iuU)^#{1,3}\s+.*(?:Página|Page)\s+(\d+)"
IMAGE_PAGE = r"^image_p(\d+)_"


def route_sparse_pages(pages: DataFrame) -> DataFrame:
    """Per document: mostly sparse pages are scanned anew, some make a hybrid, none is native."""
    sparse = F.count_if(F.length(strip(or_blank(F.col("text")))) < SPARSE_CHARS)
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), sparse.alias("sparse"))
    return counts.withColumn("route", F.when(F.col("sparse") > F.col("pages") * SPARSE_SHARE, "ocr")
                             .when(F.col("sparse") > 0, "hybrid").otherwise("native"))


def page_blocks(pages: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Text blocks of documents in long form (doc_id, part, page, block): native pages, then
    scanned pages with their heading, then speaker notes. Blank ones are dropped."""
    filled = pages.where(strip(or_blank(F.col("text"))) != "")
    heading = F.concat(F.lit("## Página "), (F.col("page") + 1).cast("string"), F.lit("\n\n"), "text")
    blocks = filled.select("doc_id", F.col("is_ocr").cast("int").alias("part"), F.col("page").cast("bigint").alias("page"),
                           F.when(F.col("is_ocr"), heading).otherwise(strip(F.col("text"))).alias("block"))
    if notes is None:
        return blocks
    said = notes.where(strip(or_blank(F.col("note"))) != "")
    title = said.groupBy("doc_id").agg(F.min("slide").cast("bigint").alias("page")).select(
        "doc_id", F.lit(2).alias("part"), "page", F.lit("## Notas del presentador").alias("block"))
    lines = said.select("doc_id", F.lit(3).alias("part"), F.col("slide").cast("bigint").alias("page"),
                        F.concat(F.lit("**Diapositiva "), (F.col("slide") + 1).cast("string"), F.lit(":** "), strip(F.col("note"))).alias("block"))
    return blocks.unionByName(title).unionByName(lines)


def join_blocks(blocks: DataFrame) -> DataFrame:
    """Text per document (doc_id, volume, text); a volume holds ``VOLUME_BLOCKS`` pages, so that
    no text grows without bound. Page numbers alone decide, whatever the document's size."""
    volume = F.floor(F.col("page") / VOLUME_BLOCKS)
    parts = F.sort_array(F.collect_list(F.struct("part", "page", "block")))
    return (blocks.withColumn("volume", volume).groupBy("doc_id", "volume")
            .agg(F.array_join(F.transform(parts, lambda b: b["block"]), "\n\n").alias("text")))


def caption_label(kind: Column, caption: Column, name: Column) -> Column:
    """Usable label of an image, or null: short labels need letters and a real word, icon names
    a sensible length, refusals become placeholders."""
    flat = squeeze(caption)
    word = F.exists(F.split(flat, " "), lambda w: w.rlike(r"^\p{L}{4,}$"))
    label = F.when((F.length(flat) >= 2) & (letters(flat) / F.length(flat) >= LABEL_LETTERS) & word, flat)
    icon = F.regexp_replace(strip(caption), r"\.+$", "")
    refused = caption.rlike(REFUSALS)
    named = F.when(refused, "UI element").when((F.length(icon) > 1) & (F.length(icon) < ICON_CHARS), icon)
    shot = F.when(refused & (F.length(strip(caption)) < REFUSAL_CHARS), F.concat(F.lit("[Captura de pantalla: "), name, F.lit("]"))).otherwise(strip(caption))
    return F.when(kind == "button", label).when(kind == "icon", named).otherwise(shot)


def insert_captions(docs: DataFrame, captions: DataFrame) -> DataFrame:
    """Documents with the captions of page *p* before the heading of the page after it; those of
    the last page, then those of pages never seen, at the end.

    A document's captions join it as one array; lines are worked on inside the row.
    ``captions``: doc_id, file_name, caption.
    """
    page = F.coalesce(F.nullif(F.regexp_extract("file_name", IMAGE_PAGE, 1), F.lit("")).cast("int"), F.lit(0))
    url = F.concat(F.lit("/corpus/"), F.col("doc_id").cast("string"), F.lit("/media/"), "file_name")
    lines = F.concat(F.lit("!["), "file_name", F.lit("]("), url, F.lit(")\n> **📷 Imagen:** "), "caption", F.lit("\n"))
    per = (captions.withColumns({"page": page, "lines": lines}).groupBy("doc_id")
           .agg(F.sort_array(F.collect_list(F.struct("page", "file_name", "lines"))).alias("_caps")))
    rows = docs.join(per, "doc_id", "left").withColumn("_lines", F.split("text", "\n"))
    number = F.transform("_lines", lambda x: F.nullif(F.regexp_extract(x, PAGE_HEADING, 1), F.lit("")).cast("int"))
    rows = rows.withColumn("_heads", number)

    def block(p: Column) -> Column:
        own = F.transform(F.filter("_caps", lambda c: c["page"] == p), lambda c: c["lines"])
        return F.when(F.size(own) > 0, F.concat(F.lit("\n"), F.array_join(own, "\n")))

    # Pages in reading order: 0, then every heading's number; captions go in once, at the first
    # place where their page ends.
    start = F.struct(F.lit(0).alias("page"), F.array(F.lit(-1)).alias("done"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        ends = x["head"].isNotNull()
        fresh = ends & ~F.array_contains(acc["done"], acc["page"])
        caps = F.when(fresh, block(acc["page"]))
        out = F.when(caps.isNotNull(), F.array_append(acc["out"], caps)).otherwise(acc["out"])
        return F.struct(F.when(ends, x["head"]).otherwise(acc["page"]).alias("page"),
                        F.when(caps.isNotNull(), F.array_append(acc["done"], acc["page"])).otherwise(acc["done"]).alias("done"),
                        F.array_append(out, x["line"]).alias("out"))

    def finish(acc: Column) -> Column:
        last = F.when(~F.array_contains(acc["done"], acc["page"]), block(acc["page"]))
        seen = F.array_append(acc["done"], acc["page"])
        rest = F.array_distinct(F.transform(F.filter("_caps", lambda c: ~F.array_contains(seen, c["page"])), lambda c: c["page"]))
        tail = F.concat(F.array_compact(F.array(last)), F.transform(rest, block))
        return F.array_join(F.concat(acc["out"], tail), "\n")

    paired = F.zip_with("_lines", "_heads", lambda a, b: F.struct(a.alias("line"), b.alias("head")))
    text = F.when(F.col("_caps").isNull(), F.col("text")).otherwise(F.aggregate(paired, start, step, finish))
    return rows.select(*[c for c in docs.columns if c != "text"], text.alias("text"))
