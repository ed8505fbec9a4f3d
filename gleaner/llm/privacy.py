"""Personal data in texts, and the words around it that give it away, with DataFrame functions alone.

1. *Entities.* Patterns find email addresses, IP numbers, card and phone numbers with their places;
   checks (parts, lengths, Luhn's sum) drop what only looks alike. Patterns start at the beginning of a run and never step back
   into one, so a text takes time in proportion to its length.
2. *Disclosure.* The words around an entity, in the same ``REACH`` characters on either side, are its
   context. With document counts N, n(c), n(t) and n(c, t), entity c holds -log n(c) / N of information, and a
   term's pointwise mutual information log N * n(c, t) / (n(c) * n(t)) is the part that it reveals. Their quotient is
   at most 1: then whoever reads the term knows the entity. Contexts and words of all rows are counted; a pair
   has to stand in ``SUPPORT`` different texts, as copies of one text are no evidence.
3. *Sanitisation.* Context terms that reveal ``GENERALISE`` or more are replaced by their kind, from
   ``REMOVE`` on they are removed; entities are replaced by their kinds.

Contexts and counts are grouped by entity and term with partial sums, so one entity in a third of
all rows is no single task; what reveals what is joined back to the contexts of different texts.
Texts without entities take part in counting words and in nothing else.

Defined cases: null texts count as empty and have no spans; equal texts get equal spans, whatever
their doc_id, which may be null or repeated; entities of one kind end each other's contexts; an empty
table gives an empty one; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.session import cut_lineage

KINDS = ("email", "ip", "card", "phone", "term")
TERM = len(KINDS) - 1
REACH = 64                 # characters of context on either side
SUPPORT = 3                # different texts in which a pair stands
GENERALISE, REMOVE = 0.8, 0.95
CHUNK = 4096               # characters that a cut looks at
BLOCK = 256                # members of a running sum that are added one by one

# Fixed patterns: a run is entered at its start or where the last match ended, and taken whole.
_PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[ -]?[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
# Texts that fail these hold no entity of the kind.
_TESTS = (r"[A-Za-z0-9-]\.[A-Za-z0-9-]", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"[0-9](?:[ -]?[0-9]){11}", r"\+[0-9][ ().0-9-]")
_MARKS = ("@", ".", None, "+")
_IP = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.|$)){4}$"
_TOKEN = r"""(?s)(.*?(?<!\S)[("'\[]*+)(\p{L}[\p{L}'’-]*+)[)\]"',.;:!?]*+(?!\S)"""
_WORD = r"""(?<!\S)[("'\[]*+(\p{L}[\p{L}'’-]*+)[)\]"',.;:!?]*+(?!\S)"""
_MENTION = "array<struct<kind:int,start:bigint,end:bigint,entity:bigint,left:string,left_start:bigint,right:string,right_start:bigint>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, add: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Running sums (or other folds that start from 0) of an array of bigints, in blocks, so that the
    work is in proportion to its length."""
    def fold(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("bigint"), add)

    def places(n: Column) -> Column:
        return F.sequence(F.lit(0), n - 1)

    def summed(v: Column) -> Column:
        blocks = F.transform(places(F.ceil(F.size(v) / BLOCK).cast("int")), lambda k: fold(F.slice(v, k * BLOCK + 1, F.lit(BLOCK))))
        heads = let(blocks, lambda b: F.transform(places(F.size(b)), lambda k: fold(F.slice(b, F.lit(1), k))))
        return let(heads, lambda h: F.transform(v, lambda _, i: add(
            F.get(h, F.floor(i / BLOCK).cast("int")), fold(F.slice(v, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1)))))

    return let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(summed(v)))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of card numbers."""
    def place(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    values = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), place)
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: int, hit: Column) -> Column:
    if kind == 1:
        return hit.rlike(_IP)
    if kind == 2:
        return let(_digits(hit), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == 3:
        return F.length(_digits(hit)).between(9, 15)
    return hit != ""


def _entity(kind: int, hit: Column) -> Column:
    return F.xxhash64(F.lit(kind), F.lower(hit) if kind == 0 else hit if kind == 1 else _digits(hit))


def _left(gap: Column, first: Column, start: Column) -> Column:
    """(text, place) of the whole words before a mention."""
    def cut(part: Column) -> Column:
        whole = first & (F.length(gap) <= REACH)
        return let(F.when(whole, part).otherwise(F.regexp_replace(part, r"^\S+", "")),
                   lambda p: F.struct(F.regexp_replace(p, r"\S+\z", "").alias("text"), (start - F.length(p)).alias("at")))

    return let(F.right(gap, F.lit(REACH)), cut)


def _right(gap: Column, last: Column, end: Column) -> Column:
    """(text, place) of the whole words after a mention."""
    def cut(part: Column) -> Column:
        whole = last & (F.length(gap) <= REACH)
        return let(F.regexp_replace(part, r"^\S+", ""), lambda p: F.struct(
            F.when(whole, p).otherwise(F.regexp_replace(p, r"\S+\z", "")).alias("text"), (end + F.length(part) - F.length(p)).alias("at")))

    return let(F.left(gap, F.lit(REACH)), cut)


def mentions(kind: int, text: Column) -> Column:
    """The entities of a kind in a text with their contexts, in order."""
    pattern = F.lit(rf"(?s)(.*?)({_PATTERNS[kind]}|\z)")
    maybe = text.rlike(_TESTS[kind])
    if _MARKS[kind]:
        maybe = text.contains(_MARKS[kind]) & maybe
    both = F.struct(F.regexp_extract_all(text, pattern, 1).alias("gaps"), F.regexp_extract_all(text, pattern, 2).alias("hits"))

    def located(z: Column) -> Column:
        lengths = F.zip_with(z["gaps"], z["hits"], lambda g, h: (F.length(g) + F.length(h)).cast("bigint"))
        return let(running(lengths), lambda ends: chosen(z, ends))

    def chosen(z: Column, ends: Column) -> Column:
        def valid(i: Column) -> Column:
            hit = F.get(z["hits"], i)
            return F.when(hit == "", False).otherwise(_valid(kind, hit))

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(z["hits"]) - 1), valid), lambda i: mention(z, ends, i))

    def mention(z: Column, ends: Column, i: Column) -> Column:
        hit, end = F.get(z["hits"], i), F.get(ends, i)
        start = end - F.length(hit)
        after = F.coalesce(F.get(z["gaps"], i + 1), F.lit(""))
        left = _left(F.get(z["gaps"], i), i == 0, start)
        right = _right(after, F.coalesce(F.get(z["hits"], i + 1), F.lit("")) == "", end)
        return let(F.struct(left.alias("l"), right.alias("r")), lambda c: F.struct(
            F.lit(kind).alias("kind"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), _entity(kind, hit).alias("entity"),
            c["l"]["text"].alias("left"), c["l"]["at"].cast("bigint").alias("left_start"),
            c["r"]["text"].alias("right"), c["r"]["at"].cast("bigint").alias("right_start")))

    return F.when(maybe, let(both, located)).otherwise(F.array().cast(_MENTION))


def tokens(text: Column, at: Column) -> Column:
    """(term, start, end) of the plain words of a short text that begins at ``at``."""
    parts = F.struct(*[F.regexp_extract_all(text, F.lit(_TOKEN), i).alias(n) for i, n in enumerate(("whole", "before", "core"))])

    def placed(z: Column) -> Column:
        ends = running(F.transform(z["whole"], lambda w: F.length(w).cast("bigint")))
        return let(ends, lambda e: F.transform(z["core"], lambda core, i: let(
            at + F.get(e, i) - F.length(F.get(z["whole"], i)) + F.length(F.get(z["before"], i)),
            lambda s: F.struct(F.lower(core).alias("term"), s.cast("bigint").alias("start"), (s + F.length(core)).cast("bigint").alias("end")))))

    return let(parts, placed)


def _key(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, key, mentions) of every row; ``key`` stands for the text."""
    text = F.coalesce("text", F.lit(""))
    found = F.flatten(F.array(*[mentions(k, F.col("text")) for k in range(TERM)]))
    return docs.select("doc_id", text.alias("text")).select("doc_id", _key(F.col("text")).alias("key"), found.alias("mentions"))


def contexts(found: DataFrame) -> DataFrame:
    """(key, copies, entity, term, start, end): the words around each entity, once for each different text."""
    texts = (found.where(F.size("mentions") > 0).groupBy("key")
             .agg(F.count("*").alias("copies"), F.first("mentions").alias("mentions")))
    each = texts.select("key", "copies", F.explode("mentions").alias("m")).select(
        "key", "copies", "m.entity", F.concat(tokens(F.col("m.left"), F.col("m.left_start")), tokens(F.col("m.right"), F.col("m.right_start"))).alias("t"))
    return each.select("key", "copies", "entity", F.explode("t").alias("t")).select("key", "copies", "entity", "t.term", "t.start", "t.end")


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n_term): documents that hold a plain word."""
    words = F.transform(F.regexp_extract_all("text", F.lit(_WORD), 1), F.lower)
    return docs.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))


def disclosure(docs: DataFrame, found: DataFrame, around: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(entity, term, n_both, n_entity, n_term, share): how much of an entity's information a term of its
    contexts reveals. Entities in all documents hold none and are left out."""
    n = found.count()
    held = (found.where(F.size("mentions") > 0).select("key", F.explode(F.array_distinct(F.transform("mentions", lambda m: m["entity"]))).alias("entity"))
            .groupBy("entity").agg(F.count("*").alias("n_entity")))
    pairs = (around.groupBy("entity", "term", "key").agg(F.first("copies").alias("copies"))
             .groupBy("entity", "term").agg(F.sum("copies").alias("n_both"), F.count("*").alias("texts")).where(F.col("texts") >= support))
    share = F.log(F.col("n_both") * n / F.col("n_entity") / F.col("n_term")) / F.log(F.lit(n) / F.col("n_entity"))
    return (pairs.join(held, "entity").where(F.col("n_entity") < n).join(term_counts(docs), "term")
            .select("entity", "term", "n_both", "n_entity", "n_term", share.alias("share")))


def revealing(docs: DataFrame, found: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """(key, terms): the spans (start, kind, end, removed) of context terms that reveal too much."""
    around = cut_lineage(contexts(found), "privacy-contexts")
    strong = disclosure(docs, found, around, support).where(F.col("share") >= generalise).select("entity", "term", (F.col("share") >= remove).alias("removed"))
    spans = around.join(strong, ["entity", "term"]).groupBy("key", "start", "end").agg(F.max("removed").alias("removed"))
    one = F.struct("start", F.lit(TERM).alias("kind"), "end", "removed")
    return spans.groupBy("key").agg(F.collect_list(one).alias("terms"))


def find(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """(doc_id, key, spans): for every row its spans (start, kind, end, removed) in order, end exclusive,
    in code points; kinds are places in ``KINDS``."""
    found = cut_lineage(entities(docs), "privacy-entities")
    base = F.transform("mentions", lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), F.lit(False).alias("removed")))
    rows = found.select("doc_id", "key", base.alias("base"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,removed:boolean>>")
    with_some = rows.where(F.size("base") > 0).join(revealing(docs, found, generalise, remove, support), "key", "left")
    return (with_some.select("doc_id", "key", F.array_sort(F.concat("base", F.coalesce("terms", none))).alias("spans"))
            .unionByName(rows.where(F.size("base") == 0).select("doc_id", "key", none.alias("spans"))))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans) of ``find``'s rows."""
    def of(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base = listed(F.filter("spans", lambda s: s["kind"] < TERM))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def cleaned(text: Column, spans: Column) -> Column:
    """The text with every group of overlapping spans replaced by the first one's kind; removed terms by
    nothing. Pieces are cut from chunks, so that a long text isn't walked again for each span."""
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        low, high = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
        head = F.substring(F.get(chunks, low), (a % CHUNK + 1).cast("int"), F.when(low == high, b - a).otherwise(CHUNK).cast("int"))
        tail = F.concat(F.array_join(F.slice(chunks, low + 2, F.greatest(high - low - 1, F.lit(0))), ""), F.substring(F.get(chunks, high), F.lit(1), ((b - 1) % CHUNK + 1).cast("int")))
        return F.when(b <= a, "").when(low == high, head).otherwise(F.concat(head, tail))

    def joined(z: Column) -> Column:
        def at(i: Column) -> Column:
            span, before = F.get(z["spans"], i), F.coalesce(F.get(z["ends"], i - 1), F.lit(0).cast("bigint"))
            label = F.when(span["removed"], "").otherwise(F.get(labels, span["kind"]))
            return F.when(span["start"] >= before, F.concat(piece(z["chunks"], before, span["start"]), label)).otherwise("")

        parts = F.transform(F.sequence(F.lit(0), F.size(z["spans"]) - 1), at)
        return F.concat(F.array_join(parts, ""), piece(z["chunks"], F.element_at(z["ends"], -1), z["n"]))

    ends = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    state = F.struct(spans.alias("spans"), ends.alias("ends"), F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}+"), 0).alias("chunks"), F.length(text).cast("bigint").alias("n"))
    return F.when(F.size(spans) == 0, text).otherwise(let(state, joined))


def sanitise(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """The rows of ``docs`` with sanitised texts. Only texts with entities move; nulls stay null."""
    found = find(docs, generalise, remove, support).where(F.size("spans") > 0)
    spans = found.groupBy("key").agg(F.first("spans").alias("spans"))
    some = F.lit(False)
    for test in _TESTS:
        some = some | F.coalesce("text", F.lit("")).rlike(test)
    names = [f"`{c}`" for c in docs.columns]
    rows = docs.where(some).select(F.struct(*names).alias("row"), _key(F.col("text")).alias("key")).join(spans, "key", "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(cleaned(F.col("row.text"), F.col("spans")))
    new = [text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return docs.where(~some).unionByName(rows.select(*new))
