"""Slug ids and attribute values that aren't marks of menus or of hidden parts."""

import pytest

from tracklight.llm import html_text

P = "<p>Enough words of the article, with commas, and more of them, so that it scores, as articles do, all day long.</p>"


@pytest.mark.parametrize(
    "part",
    [
        '<h2 id="related-work">Seen</h2>', '<h2 id="social-impact">Seen</h2>', '<h2 id="skip-lists">Seen</h2>', '<p class="notice">Seen</p>',
        '<section id="search-algorithms"><h2>Seen</h2>' + P + "</section>", '<p>See <a title="the hidden cost">Seen</a> here.</p>',
        '<p data-note="a hidden gem">Seen</p>', "<p title='display: none'>Seen</p>",
    ],
)
def test_content_stays(part):
    assert "Seen" in html_text.extract(f"<body><article><h1>A</h1>{P}{part}{P}</article></body>")


@pytest.mark.parametrize(
    "part",
    [
        "<p hidden>Gone</p>", '<p aria-hidden="true">Gone</p>', '<p style="color: red; display:none">Gone</p>', '<div class="related">Gone</div>',
        '<div id="related-posts"><a href=/>Gone</a> <a href=/>one</a></div>', '<div id="cookie-banner">Gone, as notices, and banners, are.</div>',
    ],
)
def test_the_rest_goes(part):
    assert "Gone" not in html_text.extract(f"<body><article><h1>A</h1>{P}{part}{P}</article></body>")
