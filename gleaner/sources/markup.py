"""Tables and HTML pages to Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import or_blank, strip


def rows_to_markdown(df: DataFrame, sheet: str, row_no: str, cols: list[str]) -> DataFrame:
    """Table rows as Markdown lines, in long form: (sheet, line_no, line).

    The first row of a sheet is its header and yields the title, header and rule lines.
    Lines stay rows, keyed by ``line_no``, so that a sheet of any size needs neither one
    string nor one task: only the first row number per sheet is aggregated.
    """
    cells = [or_blank(F.col(c).cast("string")) for c in cols]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    firsts = df.groupBy(sheet).agg(F.min(row_no).alias("_first"))
    rule = "| " + " | ".join("---" for _ in cols) + " |"
    n = (F.col(row_no) - F.col("_first")).cast("bigint") + 3
    head = F.array(
        F.struct(F.lit(0).cast("bigint").alias("line_no"), F.concat(F.lit("## "), F.col(sheet).cast("string")).alias("line")),
        F.struct(F.lit(1).cast("bigint").alias("line_no"), F.lit("").alias("line")),
        F.struct(F.lit(2).cast("bigint").alias("line_no"), line.alias("line")),
        F.struct(F.lit(3).cast("bigint").alias("line_no"), F.lit(rule).alias("line")),
    )
    body = F.array(F.struct(n.alias("line_no"), line.alias("line")))
    return (df.join(firsts, sheet)
            .select(F.col(sheet).alias("sheet"),
                    F.explode(F.when(F.col(row_no) == F.col("_first"), head).otherwise(body)).alias("x"))
            .select("sheet", "x.line_no", "x.line"))


# Named entities written out in the output.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


HIDDEN = r"(?is)<!--.*?-->|" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "head", "nav"))
BLOCKS = r"(?i)</?(?:p|div|section|article|ul|ol|table|h[1-6]|blockquote|pre|body|html)\b[^>]*>"


def html_to_markdown(html: Column) -> Column:
    """Headings to ``#`` lines, blocks to paragraphs, other tags dropped."""
    text = F.regexp_replace(html, HIDDEN, " ")
    text = F.regexp_replace(text, r"[ \t\r\n]+", " ")
    for level in (1, 2, 3, 4):
        text = F.regexp_replace(text, rf"(?i)<h{level}\b[^>]*>", "\n\n" + "#" * level + " ")
    text = F.regexp_replace(text, BLOCKS, "\n\n")
    text = F.regexp_replace(text, r"(?i)<li\b[^>]*>", "\n- ")
    text = F.regexp_replace(text, r"(?i)<br\b[^>]*>|</tr>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, r" *\n *", "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def pages_to_markdown(pages: DataFrame, html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(converted pages, rejected pages with an error) — an empty conversion is an error."""
    done = pages.withColumn("markdown", html_to_markdown(F.col(html)))
    good = done.where(F.col("markdown") != "")
    bad = (done.where(F.coalesce(F.col("markdown"), F.lit("")) == "")
           .withColumn("error", F.lit("empty conversion result")).drop("markdown"))
    return good, bad
