"""License scan with a positional index of rare template words.

Templates are short texts with mandatory key phrases. Over all documents, the document frequency of
every template word is counted. For each template that may stand in a document, its words of high
inverse frequency, and at least its rarest ``LEAST``, are looked up; each occurrence proposes an offset, and
proposals of different words must agree on it, give or take ``DRIFT`` words. A standing key phrase
proposes its offset by itself, however frequent its words are. An aligned template is accepted if a key phrase stands
there word for word and the words found at their places carry ``ENOUGH`` of the template's weight.

Besides, every place is counted where the words of a base phrase stand consecutively.

Defined cases: null and empty texts have no words, no places and score 0; repeated rows are
scanned one by one; doc_id and other columns do not matter to the result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.rows import mapped
from gleaner.llm.words import plain_bytes

# Phrases that are searched as they are, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Fixed values: (label, text, key phrases of which one must stand word for word), from the public license texts.
TEMPLATES = (
    ("mit", "mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     ("permission is hereby granted free of charge", "obtaining a copy of this software")),
    ("apache", "apache license", ("apache license",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license version",)),
    ("gpl", "general public license", ("general public license",)),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
     ("gnu general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ("redistribution and use in source and binary forms",)),
    ("bsd", "bsd license", ("bsd license",)),
    ("cc", "licensed under cc by", ("under cc by",)),
    ("cc", "licensed under a creative commons attribution license", ("creative commons attribution",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("permission to use copy modify",)),
    ("mpl", "subject to the terms of the mozilla public license", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
RARE_IDF = math.log(10)    # words in under a tenth of the documents propose alignments ...
LEAST = 4                  # ... and at least a template's rarest four in the document
DRIFT = 2
ENOUGH = 0.6

_SEPARATORS = bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A))
_TABLE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def words_in(text: str | None) -> list[bytes]:
    """Runs of a-z, 0-9 and non-ASCII characters, A-Z in lower case."""
    return plain_bytes(text).translate(_TABLE).split()


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Starts of ``phrase`` in ``words``."""
    out, at = [], -1
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at:at + len(phrase)] == phrase:
                out.append(at)
    except ValueError:
        return out


class Index:
    """Template words, their places, and their weights."""

    def __init__(self, templates=TEMPLATES, base=BASE) -> None:
        self.base = [(p.encode().split(), label) for p, label in base]
        self.templates = [(label, t.encode().split(), [k.encode().split() for k in keys]) for label, t, keys in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, words, _) in enumerate(self.templates):
            for pos, w in enumerate(words):
                self.postings[w].append((t, pos))
        self.vocabulary = frozenset(self.postings) | {w for p, _ in self.base for w in p}

    def weigh(self, documents: int, counts: dict[bytes, int]) -> Index:
        self.idf = {w: math.log((documents + 1) / (counts.get(w, 0) + 1)) + 1e-3 for w in self.vocabulary}
        return self

    def scan(self, text: str | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, template spans)."""
        words = words_in(text)
        present = self.vocabulary.intersection(words)
        starts, base = [], set()
        for phrase, label in self.base:
            if present.issuperset(phrase) and (found := _places(words, phrase)):
                starts += found
                base.add(label)
        labels, score, spans = set(base), 0.0, []
        for t, at, share in self._aligned(words, present):
            labels.add(self.templates[t][0])
            score = max(score, share)
            spans.append((self.templates[t][0], at, at + len(self.templates[t][1])))
        return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
                ",".join(sorted(base)), ",".join(sorted(labels)), min(score, 1.0), spans)

    def _aligned(self, words: list[bytes], present: frozenset) -> Iterator[tuple[int, int, float]]:
        # Without all words of a key phrase no alignment can be accepted.
        open_ = {t for t, (_, _, keys) in enumerate(self.templates) if any(present.issuperset(k) for k in keys)}
        if not open_:
            return
        rare: dict[int, set[bytes]] = {}
        for t in open_:
            ranked = sorted(present.intersection(self.templates[t][1]), key=lambda w: (-self.idf[w], w))
            rare[t] = {w for i, w in enumerate(ranked) if i < LEAST or self.idf[w] >= RARE_IDF}
        proposing = set().union(*rare.values())
        votes: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for i, w in enumerate(words):
            if w in proposing:
                for t, pos in self.postings[w]:
                    if t in open_ and w in rare[t]:
                        votes[t][i - pos].add(pos)
        # A key phrase that stands word for word needs no other word to agree.
        keyed = {(t, i - q) for t in open_ for k in self.templates[t][2] for i in _places(words, k) for q in _places(self.templates[t][1], k)}
        for t, at in keyed:
            votes[t][at]
        for t, offsets in votes.items():
            _, text, keys = self.templates[t]
            need = min(2, len(rare[t]))
            total = sum(self.idf[w] for w in text)
            for at in sorted(offsets):
                agree = set().union(*(offsets.get(at + d, ()) for d in range(-DRIFT, DRIFT + 1)))
                if len(agree) < need and (t, at) not in keyed:
                    continue
                area = words[max(at - DRIFT, 0):at + len(text) + DRIFT]
                if not any(_places(area, k) for k in keys):
                    continue
                share = sum(self.idf[w] for p, w in enumerate(text) if w in words[max(at + p - DRIFT, 0):max(at + p + DRIFT + 1, 0)]) / total
                if share >= ENOUGH:
                    yield t, max(at, 0), share


def _frequencies(index: Index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[bytes, int] = defaultdict(int)
        documents = 0
        for b in batches:
            documents += len(b)
            for t in b["text"]:
                for w in index.vocabulary.intersection(words_in(t)):
                    counts[w] += 1
        rows = [("", documents), *((w.decode(), n) for w, n in sorted(counts.items()))]
        yield pd.DataFrame(rows, columns=["word", "n"])

    return run


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    and the spans (label, first word, end) of accepted templates."""
    index = Index()
    # At most one row a template word.
    counted = {r.word: r.n for r in docs.select("text").transform(mapped, _frequencies(index), "word string, n bigint")
               .groupBy("word").agg(F.sum("n").alias("n")).collect()}
    index.weigh(counted.pop("", 0), {w.encode(): n for w, n in counted.items()})
    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([index.scan(t) for t in b["text"]], columns=names, dtype=object)
            for c in ("n_words", "n_base", "first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out["score"] = out["score"].astype("float64")
            out["spans"] = [[{"label": x, "first": a, "end": z} for x, a, z in s] for s in out["spans"]]
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return docs.select("doc_id", "text").transform(mapped, run, (
        f"doc_id {key}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
        "spans array<struct<label string, first bigint, end bigint>>"))
