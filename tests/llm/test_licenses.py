"""Operator 13 against edit distances over all word spans, and plain search for exact phrases."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from duolume.llm import license_scan as L

SHORT = {"mit license": "mit", "apache license version 2 0": "apache", "creative commons attribution": "cc-by", "cc by nc": "cc-by-nc"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def wanted_labels(words, notices):
    """Labels of notices that a span of whole words equals but for their edits."""
    found = set()
    for notice, label in notices.items():
        edits = len(notice) // 10 if len(notice) > 10 else 0
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                span = " ".join(words[i:j])
                if len(span) > len(notice) + edits:
                    break
                if len(span) >= len(notice) - edits and distance(span, notice) <= edits:
                    found.add(label)
    return found


def edited(rng, text, n):
    for _ in range(n):
        k = rng.randrange(len(text))
        text = rng.choice([text[:k] + text[k + 1 :], text[:k] + rng.choice("abz ") + text[k:], text[:k] + rng.choice("xyz") + text[k + 1 :]])
    return text


def texts():
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choice("abcdeilnmst") for _ in range(rng.randint(1, 7))) for _ in range(n))
    out = [None, "", "...", "MIT License", "limit license", "mit-license, MIT\nLICENCE; CC BY", "cc by cc by cc by", "cc by nc", "the APACHE LICENSE, Version 2.0.", "Apache Licence v. 2.0", "éa apache license", "apache licenseé", "mitlicense", "a mit licens"]
    for notice in SHORT:
        for n in range(6):
            out.append(f"{prose(5)} {edited(rng, notice, n)} {prose(3)} {edited(rng, notice, 1)}")
            out.append(f"{edited(rng, notice, n)}")
    return out


@pytest.mark.parametrize("text", texts())
def test_spans_of_edited_notices(text):
    search = L.Searcher(SHORT)
    words = L.words_of(text)
    joined = " ".join(words)
    found = search.search(joined)
    assert {search.labels[k] for _, _, k, _ in found} == wanted_labels(words, SHORT)
    for start, end, k, edits in found:
        notice = list(SHORT)[k]
        assert distance(joined[start:end], notice) <= edits <= search.edits[k]
        assert (start == 0 or joined[start - 1] == " ") and (end == len(joined) or joined[end] == " ")


def test_pieces():
    for notice in L.NOTICES:
        for edits in range(5):
            pieces = L.split_pieces(notice, edits)
            assert len(pieces) == edits + 1 and "".join(p for _, p in pieces) == notice and all(notice[a : a + len(p)] == p for a, p in pieces)


def test_windows_lose_nothing():
    """Windows give what each pattern finds in the whole text."""
    rng = random.Random(8)
    search = L.Searcher(L.NOTICES)
    for _ in range(30):
        parts = [edited(rng, rng.choice(list(L.NOTICES)), rng.randint(0, 5)) if rng.random() < 0.7 else "words between them" for _ in range(12)]
        text = " ".join(L.words_of(" ".join(parts)))
        whole = sorted((m.start(), m.end(), k) for k, p in enumerate(search.patterns) for m in p.finditer(text))
        assert [x[:3] for x in search.search(text)] == whole


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in L.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_documents(spark):
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "MIT License"), (3, "cc by"), (3, "cc by"), (4, "GNU General Public License " * 3000 + "é" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"spans": F.lit(1), "labels": F.lit("x")})
    found = L.report(L.scan_licenses(docs)).collect()
    got = sorted(str(tuple(x)[:6]) for x in found)
    assert got == sorted(str((i, *base(t))) for i, t in rows)
    for x in found:
        assert set(filter(None, x["base_labels"].split(","))) <= set(x["labels"].split(",")) and 0 <= x["score"] <= 1 and (x["score"] > 0) == bool(x["labels"])
    assert L.report(L.scan_licenses(docs.limit(0))).collect() == []


def test_places_in_the_text(spark):
    text = "É! Released -- under the\nMIT  Licence. And: GNU Lesser General Public-License, version 2"
    x = L.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s["label"], text[s["start"] : s["end"]], s["first_word"], s["last_word"], s["edits"]) for s in x["spans"] if s["label"] != "gpl"] == [
        ("mit", "Released -- under the\nMIT  Licence", 1, 5, 1), ("lgpl", "GNU Lesser General Public-License", 7, 11, 0),
    ]


def test_query(spark):
    from duolume.llm.queries import queries

    sf_dir = "/root/testdata/sf0.01"
    docs = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries()["op13_license_scan"](spark, sf_dir).collect()
    assert len(found) == len(docs) and sum(x["n_base"] > 0 for x in found) > 10
    assert all(tuple(x)[1:6] == base(docs[x["doc_id"]]) for x in found)
