"""Document type, version, module and language of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import replies
from gleaner.functions.plan import settle
from gleaner.functions.text import base_name, or_blank, strip, title_of_path
from gleaner.session import spread

DEFAULT_TYPE = "structured_manual"
MIN_PURE_CHANGELOG = 200
MIN_REPLY_TEXT = 40

# Ordered rules (type, words of the file name, words of the text; two of the latter needed).
TYPE_RULES = [
    ("faq_document", ["faq", "preguntas"], ["pregunta", "respuesta", "¿"]),
    ("operational_guide", ["guia", "procedimiento", "paso"], ["paso 1", "instrucciones", "procedimiento"]),
    ("changelog_pure", ["changelog", "novedades", "cambios"], []),
    ("changelog_as_manual", [], ["versión", "novedad", "configuración"]),
    ("module_manual", ["modulo", "módulo", "robot"], ["módulo", "instalación del módulo"]),
    ("training_material", ["formacion", "formación", "training"], ["diapositiva", "slide"]),
    ("technical_spec", ["spec", "api", "técnic"], ["endpoint", "parámetro", "api"]),
    ("structured_manual", ["manual"], ["capítulo", "sección", "índice"]),
]

# Known types, and other names for them.
CANONICAL_TYPES = ("structured_manual", "module_manual", "operational_guide", "changelog_as_manual", "changelog_pure",
                   "faq_document", "technical_spec", "training_material", "technical_note", "presentation")
TYPE_ALIASES = {
    "technical_note": "technical_spec",
    "presentation": "training_material",
    "release_notes": "changelog_pure",
    "faq": "faq_document",
    "step_by_step_guide": "operational_guide",
    "procedure_guide": "operational_guide",
    "user_manual": "structured_manual",
    "installation_manual": "module_manual",
    "configuration_guide": "module_manual",
    "integration_manual": "module_manual",
}

# Version and module mentions, integration and functional words, formats.
VERSION_MENTION = r"(?iu)(?:versi[oó]n|v\.?)\s*(\d+(?:\.\d+){0,2})"
MODULE_MENTION = r"(?iuU)(?:m[oó]dulo|module)\s*[:\-]?\s*(\w[\w\s]{1,30})"
MODULE_WORDS = ("integration", "connector", "automation", "api", "module", "robot")
INTEGRATION_WORDS = ("robot", "automation", "integration", "connector")
FUNCTIONAL_WORDS = ("configuración", "pantalla", "botón", "campo", "paso")
FORMATS = ("pdf", "docx", "pptx", "xlsx")

# Frequent words per language; the language with most of them wins.
STOP_WORDS = {
    "ca": "amb això aquest els les per una dels però també són és".split(),
    "de": "der die das und ist nicht ein eine mit von zu auf für sich auch".split(),
    "en": "the of and to in is that for it with was this are from by on".split(),
    "es": "el los las una que por con para del se no es su como más".split(),
    "fr": "le les des une et est que pour dans sur avec pas qui au du".split(),
}


def _holds(c: Column, word: str) -> Column:
    return F.contains(c, F.lit(word))


def _any(c: Column, words) -> Column:
    return reduce(lambda a, w: a | _holds(c, w), words, F.lit(False))


def _count(c: Column, words) -> Column:
    return reduce(lambda a, w: a + _holds(c, w).cast("int"), words, F.lit(0))


def file_stem(path: Column) -> Column:
    return F.lower(title_of_path(base_name(path)))


def opening(text: Column, chars: int | None = None) -> Column:
    """What the rules look at: the whole text, or its first ``chars`` characters if the caller wants that."""
    return F.lower(or_blank(text) if chars is None else F.substring(or_blank(text), 1, chars))


def heuristic_type(stem: Column, sample: Column) -> Column:
    chosen = F.lit(None).cast("string")
    for name, in_stem, in_text in reversed(TYPE_RULES):
        fires = _any(stem, in_stem)
        if in_text:
            fires = fires | (_count(sample, in_text) >= 2)
        chosen = F.when(fires, name).otherwise(chosen)
    return F.coalesce(chosen, F.lit(DEFAULT_TYPE))


def heuristic_doc_type(docs: DataFrame) -> DataFrame:
    """First rule that fires on the file stem or the text."""
    return docs.withColumn("doc_type", heuristic_type(file_stem(F.col("path")), opening(F.col("text"))))


def normalize_doc_type(c: Column) -> Column:
    """Known types pass, other names are mapped, anything else is a manual."""
    name = F.lower(strip(c))
    table = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
    return F.when(name.isin(*CANONICAL_TYPES), name).otherwise(F.coalesce(F.try_element_at(table, or_blank(name)), F.lit(DEFAULT_TYPE)))


def versions(sample: Column) -> Column:
    """Distinct ``major.minor`` numbers mentioned, ascending."""
    found = F.regexp_extract_all(sample, F.lit(VERSION_MENTION), F.lit(1))
    numbers = F.transform(found, lambda v: F.coalesce(F.regexp_extract(v, r"^(\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0)))
    return F.array_sort(F.array_distinct(numbers))


def extract_versions(docs: DataFrame) -> DataFrame:
    """Least version mentioned (0 without any) and the greatest, if there are two."""
    found = docs.withColumn("_v", versions(opening(F.col("text"))))
    return found.select(
        *docs.columns, F.when(F.size("_v") > 0, F.try_element_at("_v", F.lit(1))).otherwise(0.0).alias("version_min"),
        F.when(F.size("_v") > 1, F.try_element_at("_v", F.lit(-1))).alias("version_max"))


def extract_module(stem: Column, sample: Column) -> Column:
    """Words after a module mention, else the first known word in stem or text, else null."""
    named = F.nullif(F.lower(strip(F.regexp_extract(sample, MODULE_MENTION, 1))), F.lit(""))
    known = F.lit(None).cast("string")
    for w in reversed(MODULE_WORDS):
        known = F.when(_holds(stem, w) | _holds(sample, w), w).otherwise(known)
    return F.coalesce(named, known)


def is_integration_doc(path: Column, stem: Column, sample: Column) -> Column:
    return _any(stem, INTEGRATION_WORDS) | _any(sample, INTEGRATION_WORDS) | _holds(F.lower(path), "robots")


def apply_changelog_rules(docs: DataFrame) -> DataFrame:
    """Changelogs with functional content count as manuals; near-empty ones are discarded."""
    functional = _count(opening(F.col("text")), FUNCTIONAL_WORDS) >= 2
    pure = F.col("doc_type") == "changelog_pure"
    promoted = pure & functional
    short = F.length(strip(or_blank(F.col("text")))) < MIN_PURE_CHANGELOG
    return docs.withColumns({
        "doc_type": F.when(promoted, "changelog_as_manual").otherwise(F.col("doc_type")),
        "discard": F.when(promoted, False).when(pure & short, True).otherwise(F.col("discard"))})


def language(text: Column) -> Column:
    """Language with most frequent words in the whole text; ties by name, none: English.

    The words of a text are looked up once, in all lists together; each language then counts
    among those found."""
    words = F.regexp_extract_all(F.lower(or_blank(text)), F.lit(r"\p{L}+"), F.lit(0))
    listed = sorted({w for stop in STOP_WORDS.values() for w in stop})

    def vote(found: Column) -> Column:
        return F.array_max(F.array(*[
            F.struct(_votes(found, stop).alias("n"), F.lit(-i).alias("rank"), F.lit(lang).alias("lang"))
            for i, (lang, stop) in enumerate(sorted(STOP_WORDS.items()))]))

    best = F.transform(F.array(F.filter(words, lambda w: w.isin(*listed))), vote)
    return F.transform(best, lambda b: F.when(b["n"] > 0, b["lang"]).otherwise("en"))[0]


def _votes(words: Column, stop: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*stop)))


def guess_language(docs: DataFrame) -> DataFrame:
    return docs.withColumn("guess", language(F.col("text")))


def parse_type_reply(answers: DataFrame) -> DataFrame:
    """(doc_id, type_id, confidence, discard) of an external classifier; blank or unknown types
    are null, and too short a text was never asked about."""
    body = replies.json_object(replies.drop_fence_lines(or_blank(F.col("reply"))))
    rows = answers.withColumn("o", replies.parse_object(body, "type_id string, confidence string, pipeline_hints string"))
    kind = strip(or_blank(F.col("o.type_id")))
    asked = F.length(strip(or_blank(F.col("text")))) >= MIN_REPLY_TEXT
    ok = asked & (kind != "") & (F.lower(kind) != "unknown")
    hints = F.from_json("o.pipeline_hints", "discard boolean")
    return rows.select("doc_id", F.when(ok, kind).alias("type_id"), F.when(ok, replies.unit_interval(F.col("o.confidence"), 0.7)).alias("confidence"),
                       F.when(ok, F.coalesce(hints["discard"], F.lit(False))).alias("discard"))


def classify_documents(docs: DataFrame, parsed_replies: DataFrame | None = None) -> DataFrame:
    """Metadata of documents (doc_id, path, text): type from a reply or the rules, versions,
    module, flags, language, format."""
    stem, sample = file_stem(F.col("path")), opening(F.col("text"))
    rows = spread(docs, "doc_id").withColumns({"_stem": stem, "_sample": sample})
    if parsed_replies is not None:
        rows = rows.join(parsed_replies.select("doc_id", F.col("type_id").alias("_type"), F.col("discard").alias("_discard")), "doc_id", "left")
    else:
        rows = rows.withColumns({"_type": F.lit(None).cast("string"), "_discard": F.lit(None).cast("boolean")})
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    typed = rows.withColumns({
        "doc_type": F.when(F.col("_type").isNotNull(), normalize_doc_type(F.col("_type"))).otherwise(heuristic_type(F.col("_stem"), F.col("_sample"))),
        "discard": F.coalesce("_discard", F.lit(False)),
        "module_id": extract_module(F.col("_stem"), F.col("_sample")),
        "is_robot_doc": is_integration_doc(F.col("path"), F.col("_stem"), F.col("_sample")),
        "lang": language(F.col("text")),
        "format": F.when(suffix.isin(*FORMATS), suffix).otherwise("pdf"),
        "source_file": base_name(F.col("path"))})
    kept = apply_changelog_rules(extract_versions(typed)).drop("_stem", "_sample", "_type", "_discard")
    return settle(kept, "doc_type", "discard", "module_id", "is_robot_doc", "lang", "version_min", "version_max")
