"""Operator 13: license scans by fuzzy search of short notices.

Texts become lower-case words (ASCII) with one space between them. A notice may
differ by a character (inserted, deleted, substituted) for each CHARS_AN_EDIT, MOST_EDITS at most. It is split
into one piece more than edits, so every such occurrence has one piece unchanged
(pigeonhole): one automaton finds the pieces of all notices, each gives a window
where the notice may stand, and the regex library's bounded-error matching finds
the occurrences in merged windows, from the start of a word to the end of one. All
occurrences are reported with their label, words, characters and edits; those of
one notice don't overlap.

Exact phrases (PHRASES) are found besides, at every place. Null texts have no
words. Repeated and null ids are documents of their own. Long texts are searched
whole; an empty table gives an empty result. The result has the named columns only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Exact phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Short notices of public licenses, as lower-case words, and their labels.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "this program is free software you can redistribute it": "gpl",
    "apache license version 2 0": "apache",
    "licensed under the apache license": "apache",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person": "mit",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "this is free and unencumbered software released into": "unlicense",
}
#: Characters of a notice for each edit that it may have.
CHARS_AN_EDIT = 10
#: Edits of any notice; the time of bounded-error matching grows steeply with them, so notices are short.
MOST_EDITS = 4


def edits_of(notice: str, chars_an_edit: int = CHARS_AN_EDIT) -> int:
    """Edits that a notice may have; none if it is as short as one edit's characters."""
    return min(MOST_EDITS, len(notice) // chars_an_edit) if len(notice) > chars_an_edit else 0


def words_of(text: str | None) -> list[str]:
    """Words of letters and digits, A-Z in lower case."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def split_pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of near equal length, with their places."""
    cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Searcher:
    """Finds notices with at most a number of edits each."""

    def __init__(self, notices: dict[str, str], chars_an_edit: int = CHARS_AN_EDIT) -> None:
        self.labels, self.sizes, self.edits, self.patterns = list(notices.values()), [], [], []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(notices):
            edits = edits_of(notice, chars_an_edit)
            self.sizes.append(len(notice))
            self.edits.append(edits)
            self.patterns.append(regex.compile(f"(?e)(?<![^ ])(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}(?![^ ])"))
            for at, piece in split_pieces(notice, edits):
                pieces.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Stretches of whole words, for each notice, where its occurrences must be."""
        found: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for k, at in where:
                start = last + 1 - size - at
                low, high = start - self.edits[k], start + self.sizes[k] + self.edits[k]
                held = found.setdefault(k, [])
                if held and low <= held[-1][1]:
                    held[-1][0], held[-1][1] = min(low, held[-1][0]), max(high, held[-1][1])
                else:
                    held.append([low, high])
        for k, held in found.items():
            merged: list[list[int]] = []
            for low, high in sorted(held):
                low = text.rfind(" ", 0, max(0, low)) + 1
                high = text.find(" ", min(high, len(text)))
                high = len(text) if high < 0 else high
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(high, merged[-1][1])
                else:
                    merged.append([low, high])
            found[k] = merged
        return found

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) of all occurrences in a text of words with one space between them."""
        found = []
        for k, held in self.windows(text).items():
            for low, high in held:
                found += [(low + m.start(), low + m.end(), k, sum(m.fuzzy_counts)) for m in self.patterns[k].finditer(text[low:high])]
        return sorted(found)


@lru_cache(4)
def searcher(notices: tuple[tuple[str, str], ...], chars_an_edit: int) -> Searcher:
    return Searcher(dict(notices), chars_an_edit)


def phrase_places(text: str, phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(word number, label) of every place of the phrases."""
    held, found = f" {text} ", []
    for phrase, label in phrases.items():
        word, last, at = 0, 0, held.find(f" {phrase} ")
        while at >= 0:
            word += held.count(" ", last, at)
            last = at
            found.append((word, label))
            at = held.find(f" {phrase} ", at + 1)
    return sorted(found)


PLACE = pa.struct([("word", pa.int64()), ("label", pa.string())])
SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64()), ("likeness", pa.float64())])
RESULT = "n_words long, places array<struct<word:long,label:string>>, spans array<struct<label:string,first_word:long,last_word:long,start:long,`end`:long,edits:long,likeness:double>>"


def scan_licenses(docs: DataFrame, notices: dict[str, str] = NOTICES, phrases: dict[str, str] = PHRASES, chars_an_edit: int = CHARS_AN_EDIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places of exact phrases, spans of notices (words from 0; code points of the text from 0, end not included)."""
    small_batches(docs.sparkSession)
    id_type, key = docs.schema[id_col].dataType.simpleString(), tuple(notices.items())

    def spans_of(text: str, words: str, found: list[tuple[int, int, int, int]], search: Searcher) -> list[dict]:
        places = [m.span() for m in _WORD.finditer(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))]
        out, word, at = [], 0, 0
        for start, end, k, edits in found:
            word += words.count(" ", at, start)
            at = start
            last = word + words.count(" ", start, end)
            out.append({"label": search.labels[k], "first_word": word, "last_word": last, "start": places[word][0], "end": places[last][1], "edits": edits, "likeness": 1 - edits / search.sizes[k]})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = searcher(key, chars_an_edit)
        for batch in slices(batches, "text"):
            counts, places, spans = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                joined = " ".join(words)
                found = search.search(joined)
                counts.append(len(words))
                places.append([{"word": a, "label": b} for a, b in phrase_places(joined, phrases)])
                spans.append(spans_of(text, joined, found, search) if found else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, type=pa.int64()), pa.array(places, type=pa.list_(PLACE)), pa.array(spans, type=pa.list_(SPAN))], ["doc_id", "n_words", "places", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, {RESULT}")


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, exact places (number, first and last word, labels), all labels, and the likeness of the best occurrence."""
    base, words = F.col("places.label"), F.col("places.word")
    listed = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    best = F.coalesce(F.array_max("spans.likeness"), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, F.col("spans.label"))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"), "spans",
    )
