"""Text clean-up and normalisation as Column -> Column functions (no UDFs).

Python's ``\\w \\s \\d`` are Unicode-aware, Java's are not, hence the ``(?U)`` flags.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters str.strip() removes.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"

TOKEN_PATTERN = r"(?U)[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not blanks only."""
    return F.btrim(c, F.lit(WHITESPACE))


def squeeze(c: Column) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Letters whose canonical decomposition is one base character plus marks."""
    src, dst = [], []
    for cp in range(0x80, 0x10000):
        ch = chr(cp)
        base = [x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn"]
        if len(base) == 1 and base[0] != ch:
            src.append(ch)
            dst.append(base[0])
    return "".join(src), "".join(dst)


def fold_accents(c: Column) -> Column:
    """Lower case without diacritics."""
    src, dst = _accent_table()
    return F.regexp_replace(F.translate(F.lower(or_blank(c)), src, dst), r"\p{Mn}", "")


def normalize_text(c: Column) -> Column:
    """Lower, unaccented, every run of non-alphanumerics one blank."""
    return F.trim(F.regexp_replace(fold_accents(c), r"[^\p{L}\p{N}]+", " "))


def normalize_ascii(c: Column) -> Column:
    """Lower, unaccented, anything but ``a-z 0-9`` and white space blanked; inner blanks stay."""
    return strip(F.regexp_replace(fold_accents(c), r"(?U)[^a-z0-9\s]", " "))


def norm_section(c: Column) -> Column:
    """Section title for comparison: trimmed, lower case, single blanks, null as blank."""
    return or_blank(squeeze(F.lower(c)))


def preview(c: Column, n: int | None, flatten: bool = False) -> Column:
    """Trimmed text, cut to ``n`` characters with an ellipsis if ``n`` is given."""
    text = or_blank(c)
    text = strip(F.replace(text, F.lit("\n"), F.lit(" "))) if flatten else strip(text)
    if n is None:
        return text
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def count_tokens(c: Column) -> Column:
    """Tokens are word runs and single symbols."""
    return F.regexp_count(or_blank(c), F.lit(TOKEN_PATTERN))


def truncate_tokens(c: Column, n: int) -> Column:
    """Text up to and including its ``n``-th token."""
    pieces = F.regexp_extract_all(c, F.lit(r"(?U)\s*(?:[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])"), F.lit(0))
    return F.when(count_tokens(c) <= n, c).otherwise(F.array_join(F.slice(pieces, 1, n), ""))


def tokens_of(c: Column) -> Column:
    """Distinct normalised words."""
    return F.array_remove(F.array_distinct(F.split(normalize_text(c), " ")), "")


def letters(c: Column) -> Column:
    """Number of letters."""
    return F.length(F.regexp_replace(c, r"\P{L}", ""))


def title_of_path(c: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(c, r"\.[^.]*$", "")


# --- conversion clean-up ----------------------------------------------------

# Artefact patterns of scanned and converted pages.
TOC_NOISE = r"(?dmU)[.oOcCnNrR ]{10,}\d+\s*$"
REPEATED_LETTER = r"(?iu)([a-záéíóúñ])\1{4,}"
REPEATED_WORD = r"(?iuU)\b(\w{2,})\s+(?:\1\s+){2,}"
OMITTED_PICTURE = r"(?iU)\*?\*?\s*==>\s*picture\s*\[\d+\s*x\s*\d+\]\s*intentionally omitted\s*<==\s*\*?\*?"
EMPTY_ICON = r"(?iuU)(icono|botón|botó|ícono|icon)\s*\(\s*\)"
CLICK_WORDS = ("clic", "pulsar", "presionar", "click", "pinchar")
CLICK_REACH = 40


def clean_ocr_text(c: Column) -> Column:
    """Drop scanning artefacts: leader lines, stutters, symbol-only lines."""
    text = F.regexp_replace(c, TOC_NOISE, "")
    text = F.regexp_replace(text, REPEATED_LETTER, "$1$1")
    text = F.regexp_replace(text, r"\.{5,}", "...")
    text = F.regexp_replace(text, REPEATED_WORD, "$1 ")
    text = F.regexp_replace(text, r"[ \t]{3,}", " ")

    def readable(line: Column) -> Column:
        bare = strip(line)
        return (F.length(bare) <= 5) | (letters(bare) / F.length(bare) >= 0.15)

    lines = F.filter(F.split(text, "\n"), readable)
    lines = F.transform(lines, lambda x: F.when(strip(x) == "", F.lit("")).otherwise(x))
    return F.regexp_replace(F.array_join(lines, "\n"), r"\n{4,}", "\n\n\n")


def clean_placeholders(c: Column) -> Column:
    """Name the empty brackets left where an icon or button image stood."""
    text = F.regexp_replace(c, OMITTED_PICTURE, "")
    text = F.regexp_replace(text, EMPTY_ICON, "$1 (icono)")
    behind = "|".join(f"{w}.{{0,{CLICK_REACH - len(w)}}}" for w in CLICK_WORDS)
    # The look-ahead comes first: only brackets are looked behind at all.
    text = F.regexp_replace(text, rf"(?isU)(?=\(\s*\))(?<={behind})\(\s*\)", "(botón)")
    return F.regexp_replace(text, r"(?U)\(\s*\)", "(icono)")


# --- names ------------------------------------------------------------------

def base_name(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(c, r"/+$", ""), r"([^/]*)$", 1)


def stored_file_name(c: Column) -> Column:
    """Safe name for an uploaded file: word characters, at most 160 + suffix, 200 in all."""
    raw = strip(F.replace(base_name(c), F.lit(".."), F.lit("_")))
    raw = F.when(raw == "", F.lit("document")).otherwise(raw)
    # A leading or trailing dot does not start a suffix.
    suffix = F.lower(F.regexp_extract(raw, r"(?s)^.+(\.[^.]+)$", 1))
    stem = F.substring(raw, F.lit(1), F.length(raw) - F.length(suffix))
    safe = F.substring(F.replace(strip(F.regexp_replace(stem, r"(?U)[^\w\s\-]", "_")), F.lit(" "), F.lit("_")), 1, 160)
    safe = F.when(safe == "", F.lit("document")).otherwise(safe)
    return F.substring(F.concat(safe, suffix), 1, 200)


def display_file_name(c: Column) -> Column:
    """Readable name: upload hash and numeric noise removed."""
    base = base_name(strip(or_blank(c)))
    name = F.regexp_replace(base, r"^(?i)[a-f0-9]{12}_(?=.)", "")
    name = F.regexp_replace(F.regexp_replace(name, r"(?U)^\d+__\d+_+", ""), r"(?U)^\d+__\d+__+", "")
    name = F.when(strip(name) == "", base).otherwise(strip(name))
    return F.when(strip(or_blank(c)) == "", F.lit("—")).otherwise(name)
