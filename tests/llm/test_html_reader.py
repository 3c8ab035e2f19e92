"""Pages as authors leave them: stray quotes, elements that don't end, marks of several words, and time in proportion to the page."""

import time

import pytest
from pyspark.sql import functions as F

from tracklight.llm import html_text

P = "<p>Enough words of the article, with commas, and more of them, so that it scores, as articles do, all day long.</p>"
SAID = "Enough words of the article, with commas, and more of them, so that it scores, as articles do, all day long."


@pytest.mark.parametrize(
    "mess",
    [
        '<svg class="i"/>', "<svg class=i>", "<title/>", "<object data=x>", "<textarea/>", '<div class="a"">', "<iframe src=x>", "<a href='x''>y</a>",
        "<select>", "<!doctype html>", "<!-->", "<!-- a > b -->", "</>", "<?xml version='1'?>", "</div></div></section>", "<canvas/>", "<math/>",
    ],
)
def test_mess_loses_nothing(mess):
    out = html_text.extract(f"<body>{mess}<article>{P}{P}</article></body>")
    assert out.split("\n\n")[-2:] == [SAID, SAID] and "class" not in out and "<" not in out


@pytest.mark.parametrize("name", ["post-comments", "main-nav", "page-footer", "comment-content", "postComments", "content-sidebar"])
def test_marks_of_several_words(name):
    out = html_text.extract(f'<body><div class="post">{P}{P}</div><div class="{name}"><p>Gone, gone, gone, as, readers, menus, and feet, go, all of them.</p></div></body>')
    assert "Gone" not in out and out.count(SAID) == 2
    out = html_text.extract(f'<body><article>{P}<div class="{name}"><p>Gone, gone, gone.</p></div>{P}</article></body>')
    assert out == f"{SAID}\n\n{SAID}"


@pytest.mark.parametrize("name", ["entry-header", "post has-sidebar", "content no-comments"])
def test_names_that_only_look_like_marks(name):
    assert "Title" in html_text.extract(f'<body><article><div class="{name}"><h1>Title</h1></div>{P}</article></body>')


def test_all_of_the_article_in_order():
    page = f"""<body><article><h1>Head</h1>loose words<div class=text>{P}{P}</div><h2>Lists</h2><ul><li>one<li>two</ul>
    <h2>References</h2><ul><li><a href=/1>A long title of the first reference</a><li><a href=/2>Another long title, of the second</a>
    <li><a href=/3>The third and last of the references</a></ul><ul><li><a href=/>Home</a><li><a href=/>Up</a><li><a href=/>Next</a></ul></article></body>"""
    assert html_text.extract(page).split("\n\n") == [
        "Head", "loose words", SAID, SAID, "Lists", "one", "two", "References", "A long title of the first reference",
        "Another long title, of the second", "The third and last of the references",
    ]


def test_text_beside_the_best_container():
    page = f"<body><div><div>{P}{P}{P}</div>Loose text of some length stands here.<h2>More</h2><ul><li>item one</ul><h2>Links</h2><ul><li><a href=/>a</a></ul></div></body>"
    assert html_text.extract(page).split("\n\n") == [SAID, SAID, SAID, "Loose text of some length stands here.", "More", "item one"]


@pytest.mark.parametrize(
    "page",
    [
        "<a '" * 2_500_000, "<a b=\">\"" * 1_000_000, "<div>" * 200_000 + "</b>" * 200_000, "<b>" * 50_000 + "<div>" * 50_000 + "</i></b>" * 50_000,
        "<p><div>" + "<b>" * 100_000 + "<h2>x" * 100_000, "<" * 5_000_000, "<svg>" * 500_000, "<!--" * 1_000_000, "<script>" * 500_000, "<td>x<b>" * 100_000, "<a b=" * 1_000_000,
    ],
    ids=range(11),
)
def test_time_in_proportion(page):
    began = time.perf_counter()
    html_text.extract(page + f"<article>{P}</article>")
    assert time.perf_counter() - began < 10


def test_pages_of_odd_rows(spark):
    long_ = "<article>" + P * 3000 + "</article>"
    rows = [(1, "u", None, 1), (2, None, "", 2), (3, "u", P, 3), (3, "u", P, 3), (None, None, long_, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int").withColumn("text", F.lit(5))
    out = html_text.extract_text(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in out) == [(0, 3000 * (len(SAID) + 2) - 2), (1, 0), (2, 0), (3, len(SAID)), (3, len(SAID))]
    assert all(len(r.text) == r.n_chars for r in out)
    assert html_text.extract_text(df.limit(0)).count() == 0
