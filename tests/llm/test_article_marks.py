"""What may and may not count as a page's article, and boxes inside it that are no part of it."""

from __future__ import annotations

import pytest

from tessera.llm.html_extraction import extract

LONG = "The house that stood on the hill was old and the people who had lived there for many years did not want to leave it, for they had seen their children and the children of their children grow up in it and knew every stone of the wall."
MORE = "In the summer they sat on the bench in front of the door and looked at the valley, where the river went its way between the fields, and when it was dark they went in and lit the lamp that stood on the table at the window."


@pytest.mark.parametrize("name", [
    "ad-slot", "ad-unit", "google-ad", "ad-300x250", "promo-top", "newsletter-signup-form", "related-articles", "read-next", "share-tools", "sponsored-message", "cookie-policy-bar", "wp-comment", "comment-form-area",
    "user-comments", "comments-area-main", "AdBox ad_banner", "x y social-share", "up-next",
])
def test_boxes_inside_an_article(name):
    inner = f'<div class="{name}"><p>Nothing of the article stands in this box, although it is long enough that it could be one of its paragraphs.</p></div>'
    assert extract(f"<body><article><p>{LONG}</p>{inner}<p>{MORE}</p></article></body>") == f"{LONG}\n{MORE}"


@pytest.mark.parametrize("name", ["related-work", "lead", "text-muted", "loading", "shadow", "notice-of-terms", "header-note", "addendum", "commentary", "promontory", "more-than-words"])
def test_boxes_that_stay(name):
    assert extract(f'<article><p>{LONG}</p><div class="{name}"><p>{MORE}</p></div></article>') == f"{LONG}\n{MORE}"


@pytest.mark.parametrize("box", [
    '<div class="text-muted">Updated today</div>', '<div class="body text-center">Welcome</div>', '<section class="post-teaser"><p>Read our other piece</p></section>', '<div class="entry-meta">By someone</div>', '<td class="content">A cell</td>',
    '<article class="card"><p>A teaser of another piece</p></article>', '<main></main>',
])
def test_a_small_mark_is_not_the_article(box):
    text = extract(f"<body><nav><a href='/'>Home</a></nav>{box}<div><p>{LONG}</p><p>{MORE}</p></div><footer>me</footer></body>")
    assert LONG in text and MORE in text and "Home" not in text


def test_marks_that_hold_the_text():
    outside = "<p>Short words beside it.</p>"
    assert extract(f"<body>{outside}<article><p>{LONG}</p></article>{outside}</body>") == LONG
    assert extract(f'<body>{outside}<div class="entry-content"><p>{LONG}</p></div>{outside}</body>') == LONG
    # a wrapper named "content" does not make its menus and notes part of the article inside it
    assert extract(f'<body><div class="content"><p>Short words beside it.</p><article><p>{LONG}</p></article></div></body>') == LONG
