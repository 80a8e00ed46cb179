"""The training-data operators against brute force on small tables with odd rows."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghijklmno") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def corpus():
    base = prose(120)
    words = base.split()
    near = [" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in (3, 60, 100)]
    shared = prose(60)
    texts = [base, base, *near, base, prose(40) + " " + shared + " " + prose(30), prose(10) + "\n" + shared, None, "", "  ", "one", "One", "...", "a b c", "é ü ñ " * 30, "x" * 400, "x" * 300, "ab" * 200, prose(3000), prose(80), prose(80), shared[5:], "12 34 !!"]
    return [(i * 3 + 1, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "s1"][i % 4], 0) for i, t in enumerate(texts)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).withColumns({"rank": F.lit(1), "size": F.lit("x"), "copies": F.lit(0)}).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# 1 ---- token output


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_token_digest(spark, docs, tokenizer):
    from tokenizers import Tokenizer

    from duolume.llm.common import new_path
    from duolume.llm.token_output import read_token_files, token_digest, write_token_files

    path = new_path(spark, "t")
    write_token_files(docs, path, tokenizer, 2)
    got = {r["doc_id"]: r for r in token_digest(spark, path).collect()}
    t, start = Tokenizer.from_file(tokenizer), 0
    for doc_id, text, *_ in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        r = got[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    one = read_token_files(spark, path, ["doc_id", "n_tokens"]).filter("doc_id = 1").collect()
    assert len(one) == 1


def test_token_file_layout(spark, docs, tokenizer):
    import pyarrow.dataset as ds

    from duolume.llm.common import new_path
    from duolume.llm.token_output import write_token_files

    path = new_path(spark, "t")
    write_token_files(docs, path, tokenizer, 2)
    encodings = defaultdict(set)
    for f in ds.dataset(path.removeprefix("file://"), format="parquet").get_fragments():
        group = f.metadata.row_group(0)
        for i in range(group.num_columns):
            c = group.column(i)
            encodings[c.path_in_schema] |= set(c.encodings)
            assert c.has_offset_index
    assert "DELTA_BINARY_PACKED" in encodings["doc_id"] and any("DICTIONARY" in x for x in encodings["ids.list.element"])


def encoded(path, texts, end_id=None):
    import pyarrow as pa

    from duolume.llm.token_output import Encoder

    at, ids = Encoder(path).encode(pa.array(texts, type=pa.string()), end_id)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_as_the_whole(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    rng = random.Random(1)
    signs = [*"ab zé ñß.,'*1½²\n\t  日本語한κаж", "\xa0", "\u2003", "\u180e", "\x1c", "\x85", "\u200b", "\u0378", "\U0001f600", "\u0301", "\u0660", "\U0001e900", "\ufeff", "\u3000", "ª", "ʰ", "<|endoftext|>", "'s", "'ll", "  ", "\n\n", "\r\n", "the", " and."]
    texts = ["a  b", " a", "a ", "\n x\n\ny", "don't we'll", "<|endoftext|> x", "x" * 500, "½ Ⅷ ²", "\x1c a", "", "x\n\n", "a.\nB\n\nc"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    t = Tokenizer.from_file(path)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert encoded(path, texts) == want
    assert encoded(path, [*texts[:50], None], 2) == [[*x, 2] for x in want[:50]] + [[2]]


def test_known_pieces_are_bounded(tokenizer, monkeypatch):
    from duolume.llm import token_output as T

    texts = [" ".join(prose(20) for _ in range(5)) for _ in range(30)]
    want = encoded(tokenizer, texts)
    monkeypatch.setattr(T, "KNOWN_PIECES", 40)
    e = T.Encoder(tokenizer)
    import pyarrow as pa

    for i in range(0, 30, 3):
        at, ids = e.encode(pa.array(texts[i : i + 3]))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want[i : i + 3]
    assert len(e.pieces) < 500


def test_token_rows_with_odd_ids(spark, tokenizer):
    from duolume.llm.common import new_path
    from duolume.llm.token_output import token_digest, write_token_files

    path = new_path(spark, "t")
    rows = [(5, "b b"), (5, "a"), (None, "n"), (None, None), (1, "")]
    write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path, tokenizer, 2)
    got = sorted((tuple(r)[:3] for r in token_digest(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 1, 5, 5] and [r[1] for r in got] == [0, 1, 3, 4, 6] and [r[2] for r in got] == [1, 2, 1, 2, 3]
    empty = new_path(spark, "t")
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), empty, tokenizer, 2)
    assert token_digest(spark, empty).count() == 0


# 2 ---- mixing


def targets_by_rounds(sizes, weights, share, cap):
    """Excess is shared again by weight until no source is above its cap."""
    names = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    left, full = share * sum(sizes.values()), {}
    while True:
        rest = [k for k in names if k not in full]
        got = {k: left * w[k] / sum(w[x] for x in rest) for k in rest}
        over = [k for k in rest if got[k] > cap * sizes[k]]
        if not over:
            return full | got
        for k in over:
            full[k] = cap * sizes[k]
            left -= full[k]


def test_mix(spark):
    from duolume.llm.mixing import pareto_mix

    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), None, rng.choice(["a", "b", "c", "d", None, "big", "big", "big"]), 0) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = pareto_mix(df, [3, 1, 2], 1.5, 2.0).collect()
    assert len(got) == 3000
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    want = targets_by_rounds(sizes, [3, 1, 2], 1.5, 2.0)
    for k in sizes:
        assert target[k] == pytest.approx(want[k]) and abs(taken[k] - want[k]) <= 5
    again = pareto_mix(df.repartition(7), [3, 1, 2], 1.5, 2.0).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(map(tuple, again), key=lambda r: r[0])


def test_mix_weights_change_the_odds(spark):
    from duolume.llm.mixing import pareto_mix

    df = spark.createDataFrame([(i, "a b c", None, "s", 0) for i in range(2000)] + [(9999, "x " * 9000, None, "t", 0)], SCHEMA).withColumn("w", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    got = pareto_mix(df, [1, 9], 0.2, 1.0, weight_col="w").filter("source = 's'").groupBy((F.col("doc_id") % 2).alias("k")).agg(F.sum("taken").alias("n")).collect()
    n = {r["k"]: r["n"] for r in got}
    assert n[0] > 1.8 * n[1]


def brute_draw(rows, weights, share, cap):
    """Copies of each (doc_id, size, source): levels by bisection, every document ranked, cut, last change."""
    sizes = defaultdict(int)
    for _, n, source in rows:
        sizes[source] += n
    out, targets = {}, targets_by_rounds(sizes, weights, share, cap)
    for source in sizes:
        own = [(d, n, 2 ** (round(np.log2((n + 1) ** 0.25) * 8) / 8)) for d, n, s in rows if s == source]
        low, high = 0.0, 1e6
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(cap, mid * w) * n for _, n, w in own) < targets[source] else (low, mid)
        ranked = []
        for d, n, w in own:
            expected = min(cap, high * w)
            whole = int(expected + 1e-9)
            p = max(0.0, expected - whole)
            u = (int(hashlib.md5(f"mix|{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            out[d] = whole
            if p > 1e-9 and n:
                ranked.append((u * (1 - p) / (u * (1 - p) + p * (1 - u)), d, n))
        need, taken, before = targets[source] - sum(out[d] * n for d, n, _ in own), set(), 0
        for _, d, n in sorted(ranked):
            if before + n / 2 > need:
                break
            taken.add(d)
            before += n
        gap = need - before
        off = lambda d, n: abs(gap - (-n if d in taken else n))
        best = min(((off(d, n), rank, d) for rank, d, n in ranked if (d in taken) == (gap < 0) and off(d, n) < abs(gap)), default=None)
        if best:
            taken ^= {best[2]}
        for d in taken:
            out[d] += 1
    return out


def test_mix_against_a_brute_force_draw(spark):
    from duolume.llm.mixing import pareto_mix

    rng = random.Random(21)
    rows = [(i, min(400, int(rng.paretovariate(0.9))), rng.choice(["a", "b", "c", "c", None, "d"])) for i in range(1500)]
    df = spark.createDataFrame([(d, " ".join(["w"] * n), None, s, 0) for d, n, s in rows], SCHEMA)
    got = {r["doc_id"]: r for r in pareto_mix(df, [3, 1, 2], 1.5, 2.0).collect()}
    want = brute_draw(rows, [3, 1, 2], 1.5, 2.0)
    assert {d: r["copies"] for d, r in got.items()} == {d: want[d] if n else got[d]["copies"] for d, n, _ in rows}
    # longer documents are likelier
    part = [(d, n) for d, n, s in rows if s == "c"]
    mean = lambda some: np.mean([got[d]["copies"] for d, _ in some])
    assert mean([x for x in part if x[1] >= 16]) > 1.2 * mean([x for x in part if 1 <= x[1] <= 2])


def test_mix_odd_rows(docs, empty):
    from duolume.llm.mixing import mixed_documents, pareto_mix

    got = pareto_mix(docs, [3, 1, 2], 1.5, 2.0).collect()
    assert len(got) == len(ROWS) and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixed_documents(docs, [3, 1, 2], 1.5, 2.0).columns == docs.columns
    assert pareto_mix(empty, [3, 1, 2], 1.5, 2.0).count() == 0


# 3 ---- html


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, None), ("", ""), ("<p>a<p>b", "a\n\nb"), ("a<br>b", "a\nb"), ("<ul><li>x<li>y</ul>", "- x\n- y"), ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
        ("<ul><li>x<ul><li>y</ul></ul>", "- x\n  - y"), ("<head><title>t</title></head><body>b", "b"), ("<script>var a='<p>';</script>x<style>p{}</style>", "x"),
        ("<p hidden>no</p><p style='display: none'>no</p>yes", "yes"), ("<pre>a\n  b</pre>", "a\n  b"), ("a &amp; b &lt;", "a & b <"), ("<p>x</b></i>y", "xy"),
        ("<table><tr><td>a<td>bbb<tr><td>cc<td>d</table>", "a  | bbb\ncc | d"), ("<td>loose", "loose"), ("x <b>y</b>  z\n\tw", "x y z w"), ("<div>a<div>b</div>c</div>", "a\nb\nc"), ("plain < text", "plain < text"),
        ("<!-- c -->x<!-- open", "x"), ("<h1>T</h1>p", "T\n\np"), ("<img alt='pic'>", "pic"),
    ],
)
def test_render(html, text):
    from duolume.llm.html_text import render

    assert render(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>so <math><mfrac><mi>a</mi><mn>2</mn></mfrac><mo>=</mo><msup><mi>x</mi><mn>2</mn></msup><annotation>tex</annotation></math> holds", "so a/2=x^2 holds"),
        ("a<svg><title>Map</title><defs><text>no</text></defs><g>no<text x=1>north<tspan dy=2>pole</tspan></text><path/></g><style>no</style><text>south</text></svg>b", "a Map north pole south b"),
        ("<select><optgroup label=G><option>one<option label=two>2</optgroup><option>three</select>", "G one two three"), ("<title>no</title>x", "x"),
        ("<noscript><p>turn it on</noscript>y", "turn it on\n\ny"), ("<object data=f>no plug-in</object>", "no plug-in"), ("<canvas>a bar chart</canvas>", "a bar chart"),
        ("<pre>a\n <svg><text>label</text></svg></pre>", "a\n  label"), ("<svg hidden><text>no</text></svg>z<iframe>no</iframe><template>no</template>", "z"),
    ],
)
def test_visible_text_of_embedded_elements(html, text):
    from duolume.llm.html_text import render

    assert render(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<p title="<!--">Hello</p><p>World</p>', "Hello\n\nWorld"), ("<textarea>a <!-- b &lt;p></textarea>c", "a <!-- b <p> c"), ("a<!-->b<!--->c<!-- x --!>d", "abcd"), ("a<![foo[ x ]]>b<!doctype x>c<?php x?>d", "abcd"),
        ("<p>cut <a href='http://x", "cut"), ("a < b <3 c", "a < b <3 c"), ("<svg><text><![CDATA[x < y]]></text></svg>", "x < y"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>", "yes"), ("<div style='display:none'><b style='visibility:visible'>no</b></div>ok", "ok"), ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<span aria-hidden=true>seen</span>", "seen"), ("<pre>a<div>b</div>c<p>d</p></pre>", "a\nb\nc\nd"), ("<pre>x <img alt=pic> y</pre>", "x pic y"),
        ("<ol start='²'><li>x</ol>", "1. x"), ("<ol start=-2><li>x<li value=7>y<li>z</ol>", "-2. x\n7. y\n8. z"), ("<ol reversed><li>x<li>y</ol>", "2. x\n1. y"), ("<ol start='99999999999999'><li>x</ol>", "999999999. x"),
        ("<table><tr><td colspan=2>AB<td>C<tr><td>1<td>2<td>3</table>", "AB    | C\n1 | 2 | 3"), ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A | B\n  | C"), ("<table><tr><td colspan=1000>wide<tr><td>1<td>2</table>", "wide\n1 | 2"),
        ("<table><tfoot><tr><td>f</tfoot><tr><td rowspan=0>a<td>b<tr><td>c</table>", "a | b\n  | c\n  | f".replace("  | f", "  | f")), ("<input value=typed><input type=hidden value=no><input placeholder=hint>", "typed hint"),
    ],
)
def test_nothing_visible_is_lost(html, text):
    from duolume.llm.html_text import render

    assert render(html) == text


def plain_words(page):
    """Words of all text between tags, by a small reading of its own: comments, scripts, styles and titles out."""
    import html

    page = re.sub(r"(?is)<!--.*?-->|<(script|style|title)\b.*?</\1\s*>|<!doctype[^>]*>", " ", page)
    page = re.sub(r"(?i)</?(?:b|i|a|em|strong|span)\b[^>]*>", "", page)
    return re.findall(r"\S+", html.unescape(re.sub(r"<[a-zA-Z/][^>]*>", " ", page)))


def test_all_text_of_pages_appears(spark):
    from collections import Counter

    from duolume.llm.html_text import extract_text

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in extract_text(pages.withColumn("kept", F.col("html"))).collect()}
    assert len(got) == pages.count()
    for r in got.values():
        want, have = Counter(plain_words(r["kept"])), Counter(r["text"].split())
        assert not want - have and set(have - want) <= {"-"}


def test_odd_html_never_fails():
    from duolume.llm.html_text import render

    rng = random.Random(5)
    parts = ["<p>", "</p>", "<table>", "<tr>", "<td colspan=3>", "<td rowspan=9>", "</table>", "<ol start=x>", "<li value='5'>", "<!--", "-->", "<![", "]]>", "<pre>", "</pre>", "<svg>", "</svg>", "<textarea>", "</textarea>", "<select>", "<option>", "x", " y ", "&amp;", "&#0;", "<", ">", "<a b='", "<div hidden>", "</div>", "<head>", "<body>", "<dialog>", "<math>", "<mfrac>", "<br/>", "<td/>"]
    for _ in range(3000):
        assert isinstance(render("".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))), str)


def test_deep_and_long_html():
    from duolume.llm.html_text import render

    assert render("<div>" * 3000 + "deep" + "</div>" * 3000).strip() == "deep"
    assert len(render("<p>" + "word " * 50_000)) == 249_999


def test_extract(spark):
    from duolume.llm.html_text import extract_text

    df = spark.createDataFrame([(1, "<p>a", "t"), (2, None, "t"), (2, None, "t")], "page_id long, html string, text string")
    assert sorted((r["page_id"], r["text"]) for r in extract_text(df).collect() if r["text"]) == [(1, "a")]
    assert extract_text(df.limit(0)).count() == 0


# 4 ---- sharding


def test_shards(spark):
    from duolume.llm.sharding import shard_documents

    rng = random.Random(2)
    copies = prose(30)
    rows = [(i, copies if i % 3 == 0 else None if i == 5 else prose(rng.randint(1, 80), rng), None, None, 0) for i in range(4000)]
    got = shard_documents(spark.createDataFrame(rows, SCHEMA).repartition(6), 16).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(4000))
    sums, slots, where = defaultdict(int), defaultdict(list), defaultdict(set)
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        assert r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[text[r["doc_id"]]].add(r["shard"])
    assert len(sums) == 16 and max(sums.values()) < 1.02 * min(sums.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for k, v in where.items() if k != copies) and len(where[copies]) > 1


def test_shards_odd_rows(docs, empty):
    from duolume.llm.sharding import shard_documents

    assert shard_documents(docs, 16).count() == len(ROWS) and shard_documents(empty, 16).count() == 0


def test_shards_against_brute_force(spark, monkeypatch):
    """Every group placed one by one in plain Python, as all groups are over the bound of light ones."""
    from duolume.llm import sharding as S

    monkeypatch.setattr(S, "GRAIN", 10**6)
    rng = random.Random(23)
    rows = [(i, prose(rng.randint(1, 40), rng), None, None, 0) for i in range(90)]
    rows += [(200 + i, rows[i % 7][1], None, None, 0) for i in range(20)]
    got = {r["doc_id"]: r["shard"] for r in S.shard_documents(spark.createDataFrame(rows, SCHEMA), 3).collect()}
    groups = defaultdict(lambda: [0, 0, 0])
    for _, t, *_ in rows:
        for k, n in enumerate((len(t.encode()) + 1, len(t.split()), 1)):
            groups[t][k] += n
    total = [sum(g[k] for g in groups.values()) for k in range(3)]
    vector = {t: [x / y for x, y in zip(g, total, strict=True)] for t, g in groups.items()}
    weigh = lambda v: sum(w * x for w, x in zip(S.WEIGHTS, v, strict=True))
    left, own = [[1 / 3] * 3 for _ in range(3)], {}
    for t in sorted(vector, key=lambda t: -weigh(vector[t])):
        own[t] = max(range(3), key=lambda s: weigh([a * b for a, b in zip(left[s], vector[t], strict=True)]))
        left[own[t]] = [a - b for a, b in zip(left[own[t]], vector[t], strict=True)]
    ties = len(vector) - len({round(weigh(v), 12) for v in vector.values()})
    assert ties or {i: own[t] for i, t, *_ in rows} == got
    sums = np.zeros((3, 3))
    for i, t, *_ in rows:
        sums[got[i]] += [len(t.encode()) + 1, len(t.split()), 1]
    assert (sums.max(axis=0) / sums.min(axis=0) < [1.05, 1.3, 1.5]).all()


def test_shards_with_equal_and_null_ids(spark):
    from duolume.llm.sharding import shard_documents

    rows = [(None, "a b", None, None, 0), (None, "a b", None, None, 0), (1, "a b", None, None, 0), (1, None, None, None, 0), (1, None, None, None, 0)]
    got = shard_documents(spark.createDataFrame(rows, SCHEMA), 2).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 5 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_placement_balances_all_measures():
    from duolume.llm.sharding import place_vectors

    v = np.random.default_rng(0).random((500, 3))
    v /= v.sum(axis=0)
    placed = place_vectors(v, 8)
    sums = np.array([v[placed == s].sum(axis=0) for s in range(8)])
    assert abs(sums[:, 0] - 1 / 8).max() < 0.001 and abs(sums - 1 / 8).max() < 0.02


# 5 ---- language


def test_language(spark):
    from duolume.llm.language_id import predict, train

    rng = random.Random(3)
    kinds = {"aa": ["sha", "tho", "ing", "whe"], "bb": ["eau", "oui", "que", "èr"], "cc": ["sch", "ung", "öß", "ein"]}
    make = lambda k: " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randint(1, 4))) for _ in range(12))
    rows = [(i, make(k), k, None, 0) for i in range(300) for k in [rng.choice(list(kinds))]]
    model = train(spark.createDataFrame(rows[:200], SCHEMA))
    test = spark.createDataFrame([*rows[200:], (900, None, None, None, 0), (901, "123 !", None, None, 0), (902, "", None, None, 0)], SCHEMA)
    got = predict(test, model).collect()
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in got if r["lang"])
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] >= 900)


def test_language_scores_are_sums_of_log_probabilities():
    from duolume.llm import language_id as L

    m = np.log(np.random.default_rng(0).dirichlet(np.ones(L.BUCKETS), 2)).astype(np.float32)
    texts = [L.clean(x) for x in ("Hello wörld", "a", None, "x" * 700)]
    got = L.score_texts(texts, m, np.zeros(2))
    for i, t in enumerate(texts):
        b, _ = L.buckets_of([t])
        assert np.allclose(got[i], m[:, b].sum(axis=1, dtype=np.float64), rtol=1e-6)
    assert len(L.buckets_of(["abcd"])[0]) == 4 + 3 + 2 + 1 and len(L.buckets_of(["ab", "abcd"])[0]) == 3 + 10


def test_language_counts_and_long_texts(spark, monkeypatch):
    """Training counts and scores by plain counting of whole texts."""
    from collections import Counter

    from duolume.llm import language_id as L

    rng = random.Random(4)
    rows = [(i, prose(rng.randint(1, 30), rng), "pq"[i % 3 > 0], None, 0) for i in range(40)] + [(None, "zz top", "q", None, 0), (None, "zz top", "q", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    langs, log_probs, priors = L.train(df)
    for k, lang in enumerate(langs):
        n = Counter(x for _, t, own, *_ in rows if own == lang for x in L.buckets_of([L.clean(t)])[0].tolist())
        want = np.ones(L.BUCKETS)
        for x, m in n.items():
            want[x] += m
        assert np.allclose(log_probs[k], np.log(want / want.sum()), rtol=1e-5)
        assert np.isclose(priors[k], np.log(sum(r[2] == lang for r in rows) / len(rows)))
    long = L.clean(prose(3000))
    whole = np.sort(L.buckets_of([long])[0])
    parts = [b for _, b, _ in L._batches(["ab", long, "c"], 1000)]
    assert (np.sort(np.concatenate(parts[1:-1])) == whole).all()
    got = L.predict(df.withColumn("score", F.lit("mine")), (langs, log_probs, priors))
    assert got.columns.count("score") == 1 and got.filter("score > 0").count() == len(rows)


def test_language_without_training(docs, empty):
    from duolume.llm.language_id import predict, train

    assert {r["lang_pred"] for r in predict(docs, train(empty)).collect()} == {"und"}
    assert predict(empty, train(docs)).count() == 0


# 6 ---- site lines


def test_site_lines(spark):
    from duolume.llm.line_dedup import drop_site_lines

    page = lambda i: f"<nav>home</nav><p>text {i}</p><p>twice</p><p>twice</p>" if i < 12 else f"<p>home</p><p>alone {i}"
    rows = [(i, "http://a.x/p" if i < 12 else f"http://h{i}/", page(i)) for i in range(15)] + [(90, None, None), (91, "odd", ""), (91, "odd", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in drop_site_lines(df).collect()}
    assert got[3]["kept"] == "text 3" and got[3]["n_lines"] == 4 and got[3]["n_dropped"] == 3
    assert got[13]["kept"] == "home\nalone 13" and got[90]["n_lines"] == 0 and got[91]["kept"] == ""
    assert drop_site_lines(df).count() == len(rows) and drop_site_lines(df.limit(0)).count() == 0


def test_site_lines_hosts_and_clashing_columns(spark):
    from duolume.llm.line_dedup import drop_site_lines, host_of

    urls = {"http://u:p@Ex.com:8080/a": "ex.com", "https://ex.com?x": "ex.com", "ftp://[::1]:21/a": "[::1]", "http://a@b@c.org#x": "c.org", "mailto:x": "", None: ""}
    df = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    assert {r["url"]: r["h"] for r in df.withColumn("h", host_of(F.col("url"))).collect()} == urls
    rows = [(None if i == 3 else i, f"http://ex.com:{i}/", "<p>menu<p>own" + str(i)) for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({x: F.lit(7) for x in ("host", "line", "page", "drop", "salt", "n")})
    assert sorted(r["kept"] for r in drop_site_lines(pages).collect()) == [f"own{i}" for i in range(8)]


# 7 ---- decontamination


def brute_matches(docs, items, least):
    """Weighted Jaccard of every window against every item."""
    from duolume.llm.shingles import shingles, word_hashes

    own = {}
    for i, t in items:
        w, _ = word_hashes([(t or "").lower()], punctuation=False)
        if len(w):
            own[i] = (len(w), shingles(w, 5).tolist())
    have = defaultdict(int)
    for _, s in own.values():
        for v in set(s):
            have[v] += 1
    out = set()
    for d, t in docs:
        w, _ = word_hashes([(t or "").lower()], punctuation=False)
        for i, (n, s) in own.items():
            for a in range(len(w) - n + 1):
                x = shingles(w[a : a + n], 5).tolist()
                both = set(x) | set(s)
                weight = lambda v: 1 / have[v] if v in s else 1.0
                score = sum(weight(v) * min(x.count(v), s.count(v)) for v in both) / sum(weight(v) * max(x.count(v), s.count(v)) for v in both)
                if score >= least:
                    out.add((d, i))
                    break
    return out


def test_decontaminate(spark):
    from duolume.llm.decontaminate import benchmark_matches

    rng = random.Random(4)
    items = [(i, prose(rng.randint(8, 40), rng)) for i in range(30)] + [(100, None), (101, ""), (102, "two words"), (103, "Solo")]
    rows = []
    for i in range(80):
        text = prose(rng.randint(5, 60), rng)
        if i % 2:
            w = items[i % 30][1].split()
            if i % 4 == 1 and len(w) > 25:
                w[0] = "edited"
            if i % 8 == 3:
                w = w[: len(w) // 2]
            text = f"{prose(6, rng)} {' '.join(w).upper() if i % 3 else ' '.join(w)} {prose(9, rng)}"
        rows.append((i, text))
    rows += [(200, None), (201, ""), (202, "say two words now"), (203, "solo!")]
    got = benchmark_matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert pairs == brute_matches(rows, items, 0.8) and len(pairs) > 15 and (202, 102) in pairs and (203, 103) in pairs


def test_decontaminate_in_blocks(spark, docs, empty, monkeypatch):
    from duolume.llm import decontaminate as D

    items = spark.createDataFrame([(i, ROWS[0][1][i * 8 : i * 8 + 120]) for i in range(6)], "item_id long, text string")
    whole = {tuple(r) for r in D.benchmark_matches(docs, items).collect()}
    monkeypatch.setattr(D, "MOST_ITEMS", 2)
    assert {tuple(r)[:2] for r in D.benchmark_matches(docs, items).collect()} == {x[:2] for x in whole} and whole
    assert D.benchmark_matches(empty, items).count() == 0 and D.benchmark_matches(docs, items.limit(0)).count() == 0


def test_decontaminate_odd_items(spark, monkeypatch):
    from duolume.llm import decontaminate as D

    a, b = prose(20), prose(20)
    items = spark.createDataFrame([(1, a), (1, a), (1, b), (None, b), (None, None), (None, ""), (5, None), (5, None)], "item_id long, text string")
    docs = spark.createDataFrame([(3, "x " + a), (3, b), (None, "y " + a), (4, None)], "doc_id long, text string")
    for most in (20_000, 1):
        monkeypatch.setattr(D, "MOST_ITEMS", most)
        got = sorted((str(r["doc_id"]), str(r["item_id"]), r["first_word"]) for r in D.benchmark_matches(docs, items).collect())
        assert got == [("3", "1", 0), ("3", "1", 1), ("3", "None", 0), ("None", "1", 1)]


def test_time_follows_shared_shingles_not_items():
    from duolume.llm import decontaminate as D

    rng = random.Random(2)
    items = [(i, prose(20, rng)) for i in range(3000)]
    index = D.Index(items)
    calls = []
    own = index.candidates
    index.candidates = lambda prints, n, some=None: calls.append(len(prints) * len(some)) or own(prints, n, some)
    texts = [f"{prose(30, rng)} {items[i * 50][1]} {prose(30, rng)}" for i in range(20)]
    assert {(i, item) for i, item, *_ in D.find_matches(texts, [index])} == {(i, i * 50) for i in range(20)}
    assert sum(calls) < 20 * 40 * 5


def test_documents_shorter_than_an_item(spark):
    from duolume.llm.decontaminate import benchmark_matches

    rng = random.Random(8)
    template = prose(40, rng)
    # templated items weigh by their own words; the others by all of them
    items = [(i, prose(30, rng)) for i in range(20)] + [(100 + i, f"{template} {prose(16, rng)}") for i in range(50)]
    words = {i: t.split() for i, t in items}
    rows = [(i, " ".join(words[i][:29])) for i in range(10)] + [(i, " ".join(words[i][2:])) for i in range(10, 15)] + [(i, " ".join(words[i][:20])) for i in range(15, 20)]
    rows += [(i, " ".join(words[i][38:])) for i in range(100, 150)]
    got = benchmark_matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in [*range(15), *range(100, 150)]}
    assert {(r["first_word"], r["n_words"]) for r in got if r["doc_id"] < 10} == {(0, 29)}


def test_weights_count_in_fingerprints():
    from duolume.llm import decontaminate as D

    rng = random.Random(8)
    # a template with a fifth of the shingles gives way to other words
    template = prose(14, rng)
    index = D.Index([(i, f"{template} {prose(60, rng)}") for i in range(400)])
    near = []
    for i, x in enumerate(index.shingles):
        common = np.isin(x, index.vocabulary[index.weights < 0.01])
        window = np.concatenate([x[~common], np.arange(common.sum(), dtype=np.uint64) + np.uint64(1000 * i)])
        assert index.similarity(window, i) > 0.8
        near.append(bin(int(D.packed(index.weighted_bits(window).sum(axis=0))[0] ^ index.prints[i])).count("1"))
    assert np.mean(near) < 10.5 and sum(n > D.RADIUS for n in near) <= 2


def test_blocks_find_all_fingerprints_within_the_radius():
    from duolume.llm import decontaminate as D

    rng = np.random.default_rng(1)
    index = D.Index([(i, prose(20)) for i in range(200)])
    probes = index.prints[rng.integers(0, 200, 300)].copy()
    for i in range(300):
        for bit in rng.choice(64, rng.integers(0, 26), replace=False):
            probes[i] ^= np.uint64(1) << np.uint64(bit)
    got = set(index.candidates(probes, 20))
    want = {(w, i) for w, p in enumerate(probes) for i in range(200) if bin(int(p ^ index.prints[i])).count("1") <= D.RADIUS}
    assert got == want


def test_seeds_lose_no_match_and_are_rarely_common():
    from duolume.llm import decontaminate as D

    rng = random.Random(12)
    template = prose(40, rng)
    items = [(i, f"{template} {prose(25, rng)}" if i % 2 else prose(rng.randint(6, 60), rng)) for i in range(300)]
    index, whole = D.Index(items), D.Index(items)
    # the other one takes every shingle for a seed
    whole.seeds_of = np.unique
    lists = [np.unique(x) for x in whole.shingles]
    at = np.concatenate(lists)
    order = np.argsort(at, kind="stable")
    whole.having = np.repeat(np.arange(len(lists)), [len(x) for x in lists])[order].astype(np.int32)
    whole.seeds, first = np.unique(at[order], return_index=True)
    whole.having_at = np.append(first, len(at))
    texts = []
    for i in range(600):
        w = items[i % 300][1].split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = prose(1, rng)
        texts.append(f"{prose(rng.randint(0, 20), rng)} {' '.join(w)} {template if i % 5 == 0 else prose(9, rng)}")
    cells = {}
    for name, x in (("seeds", index), ("whole", whole)):
        own, counted = x.candidates, cells.setdefault(name, [])
        x.candidates = lambda prints, n, some=None, own=own, counted=counted: counted.append(len(prints) * len(some)) or own(prints, n, some)
    got = list(D.find_matches(texts, [index]))
    assert got == list(D.find_matches(texts, [whole])) and len(got) > 200
    # a shingle that half of the items have brings no item
    common = index.vocabulary[index.weights < 0.01]
    assert len(common) == 36 and not np.isin(common, index.seeds).any() and np.isin(common, whole.seeds).all()
    assert sum(cells["seeds"]) < 0.05 * sum(cells["whole"])


# 8 ---- fingerprints


def test_fingerprints(docs, empty):
    from duolume.llm import fingerprints as P

    got = {r["doc_id"]: r for r in P.fingerprint_documents(docs).collect()}
    assert len(got) == len(ROWS)

    def own(t):
        c = P.codes_of(t)
        return P.fingerprint(len(c), P.PrefixHash(c).span(0, len(c)), P.sketch(P.span_hashes(c)))

    for k, (doc_id, text, *_) in enumerate(ROWS):
        t, after = text or "", ROWS[k - 1][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[doc_id]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own(t), own(edited))
        assert (r["common_next"], r["common_edited"]) == (len(os.path.commonprefix([t, after])), len(os.path.commonprefix([t, edited])))
        assert 0 <= r["near_edited"] <= 1 and r["near_next"] == P.likeness(own(t), own(after))
    assert P.fingerprint_documents(empty).count() == 0
    assert P.fingerprint_documents(docs.limit(1)).count() == 1


def test_fingerprints_by_whole_numbers():
    """Hashes and sketches by Python's integers, spans one by one."""
    from duolume.llm import fingerprints as P

    def mixed(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * factor % 2**64
        return x ^ (x >> 31)

    m = 2**31 - 1
    for text in ("", "a", "short text", "é日本😀" * 9, prose(200), "ab" * 300):
        codes = [ord(c) + 1 for c in text]
        of = lambda part, base: sum(c * pow(base, j, m) for j, c in enumerate(part)) % m
        k = min(P.SPAN, len(codes))
        spans = {mixed((of(codes[i : i + k], P.BASES[0]) << 31) | of(codes[i : i + k], P.BASES[1])) >> 32 for i in range(len(codes) - k + 1)} if codes else set()
        want = f"{len(codes):x}-{of(codes, P.BASES[0]):08x}{of(codes, P.BASES[1]):08x}-{''.join(f'{x:08x}' for x in sorted(spans)[: P.SKETCH])}"
        assert P._Document(text).fingerprint == want


def test_fingerprints_with_equal_and_null_ids(spark):
    from duolume.llm import fingerprints as P

    got = P.fingerprint_documents(spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got) == [("1", 1), ("1", 1), ("None", 0), ("None", 1)]


def test_prefix_hashes():
    from duolume.llm import fingerprints as P

    text = prose(9000)
    a, b = P.PrefixHash(P.codes_of(text)), P.PrefixHash(P.codes_of("zz" + text))
    assert a.span(40_000, 500) == b.span(40_002, 500) != b.span(40_001, 500)
    assert a.common_extension(100, b, 102) == len(text) - 100


# 9 ---- repeats


def brute_repeats(rows):
    seen, out = {}, {}
    for doc_id, text in sorted(rows):
        b = (text or "").encode()
        for j in range(len(b) - 49):
            seen.setdefault(b[j : j + 50], doc_id)
    for doc_id, text in rows:
        b = (text or "").encode()
        mask = bytearray(len(b))
        for j in range(len(b) - 49):
            if seen[b[j : j + 50]] < doc_id:
                mask[j : j + 50] = b"\1" * 50
        out[doc_id] = (len(b), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(bytes(x for x, m in zip(b, mask, strict=True) if not m)).hexdigest())
    return out


def check_repeats(spark, rows):
    from duolume.llm.repeats import remove_repeats

    got = {r["doc_id"]: tuple(r)[1:] for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_repeats(rows)


def test_repeats(spark, docs, empty):
    from duolume.llm.repeats import remove_repeats

    check_repeats(spark, [r[:2] for r in ROWS])
    rng = random.Random(6)
    pieces = ["".join(rng.choice("abé") for _ in range(rng.randint(20, 90))) for _ in range(12)]
    check_repeats(spark, [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))) for i in range(60)])
    assert remove_repeats(empty).count() == 0


def passages(rng):
    """Texts with pieces, rulers and phrases that many share, in different surroundings."""
    pieces = ["".join(rng.choice("abé") for _ in range(rng.randint(20, 90))) for _ in range(12)]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(40)]
    texts += [prose(rng.randint(1, 9), rng) + "-" * rng.randint(18, 70) + prose(rng.randint(1, 9), rng) for _ in range(40)]
    return texts + ["\0" * 60, "x" + "\0" * 55, "", None]


@pytest.mark.parametrize("hot", [2, 10_000])
def test_repeats_of_hot_anchors(spark, monkeypatch, hot):
    from duolume.llm import repeats as R

    monkeypatch.setattr(R, "HOT", hot)
    texts = passages(random.Random(7))
    check_repeats(spark, list(enumerate(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = len(R.hot_anchors(df.select("doc_id", F.col("text").cast("binary").alias("text"))))
    assert n > 20 if hot == 2 else n == 0


def test_repeats_with_equal_and_null_ids(spark):
    from duolume.llm.repeats import remove_repeats

    text = prose(30)
    rows = [(4, text), (4, text), (None, "z" + text), (7, text + "y"), (4, None)]
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(text)
    assert got == sorted([("4", n, 0), ("4", n, 0), ("4", 0, 0), ("7", n + 1, n), ("None", n + 1, n)])


def test_repeat_groups_have_all_occurrences(spark):
    from duolume.llm.repeats import repeat_groups

    texts = passages(random.Random(17))
    raw = [(t or "").encode() for t in texts]
    got = repeat_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r["repeat"], r["length"]].add((r["doc_id"], r["start"]))
    assert len(groups) > 50
    at = defaultdict(list)
    for key, places in groups.items():
        assert len({d for d, _ in places}) > 1 and len({raw[d][s : s + key[1]] for d, s in places}) == 1 and key[1] >= 50
        for place in places:
            at[place[0]].append((place[1], key))
    where = defaultdict(set)
    for d, b in enumerate(raw):
        for j in range(len(b) - 49):
            where[b[j : j + 50]].add((d, j))
    for places in where.values():
        if len({d for d, _ in places}) > 1:
            d, j = min(places)
            assert any(s <= j and j + 50 <= s + key[1] and {(x, y - j + s) for x, y in places} <= groups[key] for s, key in at[d])


def test_stack_scan():
    from duolume.llm.repeats import scan

    # banana: a ana anana banana na nana
    assert sorted(map(tuple, scan([-1, 1, 3, 0, 0, 2], [0] * 6).tolist())) == [(0, 0, 6), (1, 0, 3), (2, 4, 6), (3, 1, 3)]
    assert sorted(map(tuple, scan([-1, 2, -1, 0, 5], [1, 1, 0, 0, 0]).tolist())) == [(0, 2, 5), (2, 0, 2), (5, 3, 5)]


def test_repeats_in_long_texts(spark, monkeypatch):
    from duolume.llm import repeats as R

    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2_300_000))
    block = R._BLOCK - 2 * R.WIDTH
    p, h, _ = R.anchors(np.frombuffer(long.encode(), dtype=np.uint8))
    assert len(np.unique(p)) == len(p) and np.diff(p).max() <= R.LEFT + 1
    cut = long[block - 300 : block + 400]
    check_few = [(1, cut), (2, long), (3, "zz" + long[: block + 100])]
    from duolume.llm.repeats import remove_repeats

    got = {r["doc_id"]: r for r in remove_repeats(spark.createDataFrame(check_few, "doc_id long, text string")).collect()}
    assert (got[1]["n_removed"], got[2]["n_removed"], got[2]["n_spans"], got[3]["n_removed"], got[3]["n_spans"]) == (0, 700, 1, block + 100, 1)


# 10 ---- Jaccard join


def brute_components(rows, n, p, q):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    ids = sorted(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            same = len(sets[a] & sets[b])
            if same and q * same >= p * (len(sets[a]) + len(sets[b]) - same):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_corpus():
    rng = random.Random(9)
    passage = prose(40, rng)
    rows = []
    for g in range(12):
        base = prose(rng.randint(1, 90), rng).split()
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append(" ".join(w))
    rows += [f"{passage} {prose(rng.randint(8, 20), rng)}" for _ in range(40)] + [None, "", "x", "x", "X", "a b", "a  b\n"]
    rng.shuffle(rows)
    return [(i * 2, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("n", "p", "q", "most_nodes"), [(4, 85, 100, -2), (4, 85, 100, -1), (4, 85, 100, 20_000), (5, 80, 100, 20_000), (4, 85, 100, 0), (2, 50, 100, 20_000)])
def test_jaccard_components(spark, monkeypatch, n, p, q, most_nodes):
    from duolume.llm import jaccard_join as J

    jaccard_components = J.jaccard_components
    if most_nodes < 0:  # keys are shared by many nodes of one task
        monkeypatch.setattr(J, "MOST_LOCAL", 2)
        most_nodes = 20_000 if most_nodes == -2 else 3

    rows = near_corpus()
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n, p, q, most_nodes=most_nodes).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, n, p, q)


def test_links_of_buckets_headed_by_an_unlinked_node(spark, monkeypatch):
    from duolume.llm import jaccard_join as J

    words_of = lambda own: J.shingle_sets([" ".join(own)], 1)[0]
    keys = lambda own: set(J.segment_keys(words_of(own), 80, 100).tolist())
    x = [f"w{i}" for i in range(100)]
    y = x[:89] + [f"y{i}" for i in range(11)]
    shared = keys(x) & keys(y)
    # has all keys that x and y share, and few more of their words; its hash is the smallest
    head = x
    for i in range(1000):
        other = [*(w for w in head if w != x[i % 100]), f"h{i}"] if x[i % 100] in head else head
        head = other if shared <= keys(other) else head
    node = lambda own: J.node_of(words_of(own))[0]
    head = next(h for k in range(10_000) if node(h := [*head, f"k{k}"]) < min(node(x), node(y)) and shared <= keys(h))
    assert shared and 100 * len(set(head) & set(x)) < 80 * len(set(head) | set(x))
    rows = [(1, " ".join(x)), (2, " ".join(y)), (3, " ".join(head))]
    monkeypatch.setattr(J, "OFTEN", 100)
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80, 100, most_nodes=1).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {1: (100, 1), 2: (100, 1), 3: (101, 3)}


def test_hot_buckets_lie_in_bounded_pieces(spark, monkeypatch):
    from duolume.llm import jaccard_join as J

    # variants under the threshold that share most segments, and some linked ones
    rows = [(i, " ".join([*(f"w{j}" for j in range(70)), *(f"v{i}-{j}" for j in range(30))])) for i in range(60)]
    rows += [(60 + i, rows[i * 7][1].replace(f"v{i * 7}-1", "other")) for i in range(5)]
    monkeypatch.setattr(J, "OFTEN", 1000)
    monkeypatch.setattr(J, "CHUNK", 8, raising=False)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    materialize, seen = J.materialize, {}

    def spy(table, tag):
        out = materialize(table, tag)
        seen[tag] = out
        return out

    monkeypatch.setattr(J, "materialize", spy)
    join, sizes = J._join_components, spark.sparkContext.accumulator(0)

    def counted(*args):
        run = join(*args)

        def checked(batches):
            rows = [x for b in batches for x in [b]]
            comps = [c for b in rows for c in b.column("comp").to_pylist()]
            assert max(map(comps.count, set(comps)), default=0) <= 30
            sizes.add(len(set(comps)))
            return run(iter(rows))

        return checked

    monkeypatch.setattr(J, "_join_components", counted)
    got = J.jaccard_components(df, 1, 80, 100, most_nodes=20).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 1, 80, 100)
    buckets = seen["join-found"].filter("kind = 2")
    assert buckets.agg(F.max("n")).first()[0] > 30 and buckets.agg(F.max(F.size("members"))).first()[0] <= 8
    assert sizes.value > 10


def test_jaccard_repeated_and_null_ids(spark):
    from duolume.llm.jaccard_join import jaccard_components, repeated_documents

    a, b, c = prose(80), prose(80), prose(80)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (None, c), (None, c + " y"), (None, c), (7, b), (7, prose(50)), (7, None), (None, None), (9, c), (9, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard_components(df, 4, 85, 100).collect())
    comps = {a: 1, b: 1, a + " x": 1, b + " x": 1, c: 9, c + " y": 9}
    assert got == sorted((str(i), max(0, len((t or "").split()) - 3), comps.get(t, i)) for i, t in rows)
    texts = {(r["doc_id"], r["k"]): r["text"] for r in df.withColumn("k", F.xxhash64("text")).collect()}
    found = {(r["doc_id"], texts[r["doc_id"], r["key"]], r["kept"]) for r in repeated_documents(df).collect()}
    assert found == {(2, a + " x", False), (3, b + " x", False), (7, b, False), (None, c, False), (None, c + " y", False), (9, c, True)}


def test_sets_with_equal_ids_are_told_apart(spark, monkeypatch):
    from duolume.llm import jaccard_join as J

    rows = near_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    digests, passes, find = J.digests_of, [], J.find_candidates
    # first digests of four bits: nearly all sets share theirs
    monkeypatch.setattr(J, "digests_of", lambda tokens: (digests(tokens)[0] % 16, *digests(tokens)[1:]))
    monkeypatch.setattr(J, "find_candidates", lambda *args: passes.append(args[6:]) or find(*args))
    got = J.jaccard_components(df, 4, 85, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 4, 85, 100)
    assert len(passes) == 2 and 1 < len(passes[1][0]) <= 16


def test_jaccard_of_one_id(spark):
    from duolume.llm.jaccard_join import jaccard_components

    base = prose(60)
    df = spark.createDataFrame([(None, f"{base} v{i % 3}") for i in range(90)], "doc_id long, text string").repartition(6)
    assert {tuple(r) for r in jaccard_components(df, 4, 85, 100).collect()} == {(None, 58, None)}


def test_jaccard_odd_rows(docs, empty):
    from duolume.llm.jaccard_join import jaccard_components

    got = jaccard_components(docs, 4, 85, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components([r[:2] for r in ROWS], 4, 85, 100)
    assert jaccard_components(empty, 4, 85, 100).count() == 0


def test_similar_sets_share_a_key():
    from duolume.llm.jaccard_join import segment_keys

    rng = np.random.default_rng(3)
    common = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    for trial in range(400):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        if trial % 2:
            a = np.unique(np.concatenate([a, rng.choice(common, int(rng.integers(1, 300)), replace=False)]))
        drop = int(len(a) * 0.15 * rng.random())
        b = np.delete(a, rng.choice(len(a), drop, replace=False))
        extra = max(0, int(len(b) / 0.85) - len(a)) if trial % 3 else 0
        b = np.unique(np.concatenate([b, rng.integers(0, 2**63, int(extra * rng.random())).astype(np.uint64)]))
        same = len(np.intersect1d(a, b))
        if 100 * same >= 85 * (len(a) + len(b) - same):
            for level in (0, 1, 2):
                frequent = common if trial % 4 == 1 else None
                assert len(np.intersect1d(segment_keys(a, 85, 100, frequent, level), segment_keys(b, 85, 100, frequent, level)))


def test_components(spark):
    from duolume.llm.components import connected_components

    links = [(i, i + 1) for i in range(0, 40)] + [(100, 105), (105, 103), (7, 7), (100, 105)]
    got = {r["u"]: r["root"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {105: 100, 103: 100}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# pipeline


def pipeline_case(spark, tmp_path, rows, items):
    spark.createDataFrame(rows, SCHEMA + ", lang_pred string, key int, copies int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = f"file://{tmp_path}"
    return sf, spark.read.parquet(f"{sf}/documents.parquet")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    item = prose(30, rng)
    base, other = prose(90, rng), prose(90, rng)
    rows = [(i, prose(rng.randint(20, 60), rng), "en", f"s{i % 3}", 0) for i in range(60)] + [(100, base, "en", "s0", 0), (101, base + " more", "en", "s1", 0), (102, f"{prose(5, rng)} {item} {prose(5, rng)}", "en", "s2", 0), (103, "12345", "en", "s0", 0), (104, None, "en", "s0", 0)]
    # repeated and null ids: only the rows that are meant go
    rows += [(5, base + " again", "en", "s0", 0), (102, other, "en", "s1", 0), (102, other, "en", "s1", 0), (None, f"{item} {prose(3, rng)}", "en", "s1", 0), (None, prose(40, rng), "en", None, 0)]
    rows = [(*r, "x", 1, 2) for r in rows]
    texts = lambda df: sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())
    named = lambda gone: sorted((str(r[0]), str(r[1])) for r in rows if not gone(r))
    sf, docs = pipeline_case(spark, tmp_path, rows, [(1, item)])
    first = corpus_pipeline.language(spark, docs, sf)
    assert first.columns == docs.columns and texts(first) == named(lambda r: r[0] in (103, 104))
    second = corpus_pipeline.near_duplicates(spark, docs, sf)
    want = named(lambda r: r[1] in (base, base + " more"))
    want.remove(("102", other))
    assert second.columns == docs.columns and texts(second) == want
    third = corpus_pipeline.decontaminate(spark, docs, sf)
    assert third.columns == docs.columns and texts(third) == named(lambda r: item in (r[1] or ""))
    assert corpus_pipeline.mix(spark, docs, sf).columns == docs.columns


def test_pipeline_against_brute_force(spark, tmp_path, tokenizer):
    """All stages on a small table: near duplicates, items, mix and ids computed apart."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(12)
    items = [(i, prose(25, rng)) for i in range(4)]
    rows = [(i, prose(rng.randint(30, 80), rng), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(50 + i, rows[i][1] + " tail", "en", "s0", 0) for i in range(5)] + [(60 + i, f"{prose(9, rng)} {t} {prose(9, rng)}", "en", "s1", 0) for i, t in items] + [(70, "...", "en", "s0", 0), (71, None, "en", "s0", 0)]
    sf, docs = pipeline_case(spark, tmp_path, [(*r, "x", 1, 2) for r in rows], items)
    left = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    comps = brute_components([r[:2] for r in left], 5, 80, 100)
    left = [r for r in left if comps[r[0]][1] == r[0]]
    hit = {d for d, _ in brute_matches([r[:2] for r in left], items, 0.8)}
    left = {r[0]: r for r in left if r[0] not in hit}
    assert len(left) == 40
    got = corpus_pipeline.run(spark, sf).collect()
    t = Tokenizer.from_file(tokenizer)
    words, taken, copies = defaultdict(int), defaultdict(int), defaultdict(int)
    for d, text, _, source, _ in left.values():
        words[source] += len(text.split())
    for r in got:
        ids = t.encode(left[r["doc_id"]][1], add_special_tokens=False).ids + [2]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        taken[left[r["doc_id"]][3]] += len(left[r["doc_id"]][1].split())
        copies[r["doc_id"]] += 1
    target = targets_by_rounds(words, [3, 1, 2], 1.5, 2.0)
    assert max(copies.values()) <= 2 and all(abs(taken[k] - target[k]) <= 40 for k in words)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    sf, _ = pipeline_case(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0
