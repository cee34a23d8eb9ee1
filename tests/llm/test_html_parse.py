"""Parsing of odd pages: time in proportion to length, and parts that names of several words give away."""

import time

import pytest

from lagweave.llm import html_text

N = 100_000
STORY = "<p>" + "Plain words of a story that goes on. " * 8 + "</p>"
PLAIN = ("Plain words of a story that goes on. " * 8).strip()


@pytest.mark.parametrize("page", ["<span>" * N + "</b>" * N, "<span>" * N + "<hr>" * N, "<b>" * N + "</i>" * N + "<p>y" * 9, "<a " * N, "<a \"'>" * N, "<ul><li>" * (N // 2), "<article>" + "<header>" * N, "<!-- " * N, "</" * N])
def test_deep_and_broken_pages_take_linear_time(page):
    seconds = []
    for part in (page[: len(page) // 4], page):
        began = time.process_time()
        html_text.main_text(part)
        seconds.append(time.process_time() - began)
    assert seconds[1] < max(1.0, 10 * seconds[0])  # four times as long; quadratic work would take sixteen times


@pytest.mark.parametrize("part", ['<div class="share-this-post">Share on every site</div>', '<div id="our_newsletter_box">Our letter each week</div>', "<label>Your address</label>", "<fieldset><legend>Pick</legend></fieldset>"])
def test_parts_inside_articles(part):
    assert html_text.main_text(f"<body><article>{STORY}{part}{STORY}</article></body>") == f"{PLAIN} {PLAIN}"


def test_names_of_articles_stay():
    for name in ("post-content", "main article", "page-container", "related-work", "content has-sidebar"):
        assert html_text.main_text(f'<body><div class="{name}">{STORY}{STORY}</div></body>') == f"{PLAIN} {PLAIN}"


def test_end_tags_keep_to_their_scope():
    for page, want in (
        ("<div>a<b>b<div>c</b>d</div>e</div>f", "a b c d e f"), ("<ul><li>a<ul><li>b</ul><li>c</ul>d", "a b c d"), ("<table><tr><td>a<td>b<tr><td>c</table>d", "a b c d"),
        ("<p>a<div>b</p>c</div>d", "a b c d"), ("x</div></p></b>y", "x y"), ("<dl><dt>a<dd>b<dt>c</dl>", "a b c"), ("a<br", "a"), ("a<!-- b", "a"), ("1 < 2 > 0", "1 < 2 > 0"),
    ):
        assert " ".join(html_text.main_text(page).replace(" ", "")) == " ".join(want.replace(" ", ""))
