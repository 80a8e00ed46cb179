"""Operator 12 against runs found by comparing all pairs of words."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from duolume.llm import periodic_runs as P


def all_runs(x, least_length=24, least_exponent=3):
    """(start, length, period): for each period the maximal stretches of x[i] == x[i+q] that no smaller period has."""
    found, n = [], len(x)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if x[i] != x[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and x[i] == x[i + q]:
                i += 1
            length = i + q - start
            if length >= 2 * q and not any(all(x[k] == x[k + r] for k in range(start, start + length - r)) for r in range(1, q)):
                found.append((start, length, q))
    return sorted((x for x in found if x[1] >= max(least_length, least_exponent * x[2])), key=lambda x: (x[0], x[2]))


def fibonacci(n):
    a, b = [1], [1, 2]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_numbers(seed):
    """All runs with two periods or more, in words over few letters."""
    rng = random.Random(seed)
    x = [rng.randint(1, rng.choice([1, 2, 2, 3])) for _ in range(rng.choice([1, 2, 5, 30, 90]))]
    if seed % 3 == 0:
        x = x[: 1 + seed % 7] * 6 + x
    got = [tuple(r) for r in P.runs_of(np.array(x), 0, 2).tolist()]
    assert got == all_runs(x, 0, 2)


def test_runs_of_known_words():
    for x in (fibonacci(150), [1] * 100, [1, 2, 3] * 30 + [1, 2], [1, 2] * 20 + [3] + [1, 2] * 20, fibonacci(40) * 4):
        assert [tuple(r) for r in P.runs_of(np.array(x), 0, 2).tolist()] == all_runs(x, 0, 2)


def test_common_extensions():
    rng = random.Random(1)
    for n in (1, 3, 40, 300):
        x = [rng.randint(1, 2) for _ in range(n)]
        tree = P.SuffixTree(x)
        i, j = np.array([(i, j) for i in range(n + 1) for j in range(i + 1, n + 1)]).T
        got = tree.extensions(i, j)
        for a, b, length in list(zip(i.tolist(), j.tolist(), got.tolist(), strict=True))[:: 1 + n // 20]:
            want = next((k for k in range(n - b) if x[a + k] != x[b + k]), n - b)
            assert length == want
        assert tree.order == sorted(range(n + 1), key=lambda k: x[k:])


def texts():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(50)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    return [
        None, "", "  \n", "one", "a " * 23, "a " * 24, "x\x1cy " * 30, " ".join(prose(200)), " ".join(prose(8) * 3), " ".join(prose(7) * 3 + ["end"]), " ".join(prose(5) + prose(9) * 5 + prose(4) + ["no", "yes"] * 40),
        " ".join((["b"] * 30 + ["c"]) * 4), " ".join(map(str, fibonacci(300))), " ".join(prose(150) * 3), "é ü " * 40, " ".join((prose(40) + ["z"] * 30) * 3),
    ]


def wanted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = all_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_documents(spark):
    """Odd texts, under ids of both kinds; repeated and null ids."""
    hit = [k for k in range(2000) if zlib.crc32(str(k).encode()) % 10 == 0]
    rows = [(hit[k] if half else 10_000_000 + k, t) for half in (0, 1) for k, t in enumerate(texts())] + [(None, t) for t in texts()[-3:]] + [(7, "a b " * 20)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"runs": F.lit(1), "collapsed": F.lit("x"), "start": F.lit(2)})
    got = sorted((str(x) for x in P.report(P.collapse_runs(docs, P.periodize)).collect()))
    want = sorted(str(x) for x in spark.createDataFrame([(i, *wanted(i, t)) for i, t in rows], "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string").collect())
    assert got == want
    assert P.report(P.collapse_runs(docs.limit(0), P.periodize)).collect() == []


def test_query(spark):
    """The registered query on short documents of the test table against brute force."""
    from duolume.llm.queries import queries

    sf_dir = "/root/testdata/sf0.001"
    docs = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries()["op12_periodic_runs"](spark, sf_dir).collect()
    assert len(found) == len(docs) and sum(x["n_runs"] > 0 for x in found) >= 10
    for x in found:
        if len((docs[x["doc_id"]] or "").split()) < 400:
            assert tuple(x)[1:] == wanted(x["doc_id"], docs[x["doc_id"]])


def test_long_document():
    words = ["a", "b", "c"] * 40_000 + [str(k) for k in range(50_000)]
    assert P.periodic_runs(words) == [(0, 120_000, 3)]
