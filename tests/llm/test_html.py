"""Operator 3: heads that are left open, deep trees, templates, wide cells, and visibility against a walk over known trees."""

from __future__ import annotations

import random

import pytest

from duolume.llm.html_text import MOST_DEPTH, WIDEST, render


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<html><head><title>T</title>Hello world<p>x", "Hello world\n\nx"),
        ("<head><meta charset=x><span>Hello</span> more", "Hello more"),
        ("<head><noscript>turn it on</noscript><style>p{}</style>", "turn it on"),
        ("<head><noscript><img alt=pic></noscript>", "pic"),
        ("<head>\n <link rel=x><script>a<b</script>\n</head><body>b", "b"),
        ("<head><template><p>t</p></template><title>a</title></head>b", "b"),
        ("<p>a<template><p>t</template>b", "ab"),
        ("<div>a<template></div>t</template>b</div>c", "ab\nc"),
        ("<b>" * 205 + "visible<script>var a=1;</script><style>p{}</style><div hidden>secret</div>", "visible"),
        ("<font>" * 500 + "a<div>b</div><div>c</div>d<span style='display:none'>no</span><title>no</title>e", "a b c de"),
        ("<i>" * 300 + "<span style='visibility:hidden'>no<b style='visibility:visible'>yes</b></span>", "yes"),
    ],
)
def test_visible_and_invisible(html, text):
    assert render(html) == text


def test_wide_cells_are_aligned():
    prose = " ".join(f"word{k}" for k in range(60))
    rows = render(f"<table><tr><td>{prose}<td>right<tr><td>short<td>second<tr><td>{'x' * 90}<td>third</table>").split("\n")
    assert rows[0].index("| right") == next(x for x in rows if "second" in x).index("| second") <= WIDEST + 1
    assert " ".join(x.split(" |")[0].strip() for x in rows[:-2]) == prose
    assert rows[-1] == "x" * 90 + " | third"


def test_many_open_elements_take_no_square_of_time():
    assert render("<b>" * 60_000 + "a" + "<div>" * 20_000 + "b" + "</i>" * 20_000).split() == ["a", "b"]


INVISIBLE = ["<script>{}</script>", "<style>{}</style>", "<template><div>{}</div></template>", "<div hidden>{}</div>", "<span style='display: none'>{}</span>", "<iframe>{}</iframe>", "<dialog>{}</dialog>"]
VISIBLE = ["<b>{}</b>", "<div>{}</div>", "<span>{}</span>", "<ul><li>{}</li></ul>", "<section>{}</section>", "<dialog open>{}</dialog>", "<blockquote>{}</blockquote>", "<table><tr><td>{}</td></tr></table>", "<noscript>{}</noscript>"]


@pytest.mark.parametrize("seed", range(30))
def test_random_trees(seed):
    """Words are visible unless an element around them isn't, at any depth."""
    rng, shown, words = random.Random(seed), [], iter(range(10**6))

    def tree(depth, visible):
        parts = []
        for _ in range(rng.randint(1, 3)):
            word = f"w{next(words)}"
            if visible:
                shown.append(word)
            parts.append(f" {word} ")
            if depth and rng.random() < 0.8:
                hide = rng.random() < 0.2
                frame = rng.choice(INVISIBLE if hide else VISIBLE)
                # nothing but text in what the tokenizer takes as text
                parts.append(frame.format(tree(0 if frame[1:7] in ("script", "style>", "iframe") else depth - 1, visible and not hide)))
        return "".join(parts)

    page = tree(6, True)
    deep = MOST_DEPTH + 60
    for html in (page, "<em>" * deep + page + "</em>" * deep):
        assert [x for x in render(html).replace("- ", " ").split() if x != "|"] == shown
