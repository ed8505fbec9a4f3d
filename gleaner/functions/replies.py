"""Reading model replies that should hold one JSON object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import strip

JSON_OPTIONS = {"mode": "PERMISSIVE", "allowUnquotedControlChars": "true"}


def drop_thoughts(c: Column) -> Column:
    """Without ``<think>`` / ``<thought>`` blocks."""
    return F.regexp_replace(c, r"(?is)<(?:think|thought)\b[^>]*>.*?</(?:think|thought)>", "")


def drop_fence_lines(c: Column) -> Column:
    """Without the ``` lines, when the reply opens with one."""
    text = strip(c)
    bare = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~strip(x).startswith("```")), "\n")
    return F.when(text.startswith("```"), strip(bare)).otherwise(text)


def fenced_body(c: Column) -> Column:
    """Body of the first fenced block anywhere in the reply, else the whole reply."""
    body = F.regexp_extract(c, r"(?i)```(?:json)?\s*([\s\S]*?)```", 1)
    return F.when(c.rlike(r"```[\s\S]*?```"), strip(body)).otherwise(strip(c))


def json_object(c: Column) -> Column:
    """From the first opening to the last closing brace; null if there is none."""
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def drop_trailing_commas(c: Column) -> Column:
    """Commas before a closing bracket, outside of quoted strings."""
    return F.regexp_replace(c, r'("(?:[^"\\]|\\.)*+")|,(?=\s*[}\]])', "$1")


def parse_object(c: Column, schema: str) -> Column:
    """Struct of ``schema``, or null when the text is no well-formed object."""
    checked = F.from_json(c, schema + ", _broken string",
                          {**JSON_OPTIONS, "columnNameOfCorruptRecord": "_broken"})
    return F.when(c.isNotNull() & checked["_broken"].isNull(), checked)


def as_text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def unit_interval(c: Column, default: float) -> Column:
    """Number clamped to 0..1, ``default`` when absent or not numeric."""
    number = c.try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(default))))
