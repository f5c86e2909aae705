"""Copies of a page are no template."""

from __future__ import annotations

from .test_html_template import page, run

ARTICLE = "<section class='a-slug'><p>One story told here with many words of its own.</p><ul class='points'><li>First point of it</li><li>Second point</li></ul></section><section class='b-slug'><p>The story goes on in another section, which is about as long as the first one was.</p></section>"
WANT = "One story told here with many words of its own.\nFirst point of it\nSecond point\nThe story goes on in another section, which is about as long as the first one was."


def copies(n: int, change=lambda i, html: html):
    _, url, html, _ = page(900, body=ARTICLE)
    return [(900 + i, f"{url}?copy={i}", change(i, html), WANT) for i in range(n)]


def test_copies_beside_other_pages_keep_their_text(spark):
    others = [page(i) for i in range(12)]
    got = run(spark, [*others, *copies(7)])
    assert {got[i].text for i in range(900, 907)} == {WANT}
    assert all(got[i].text == want for i, _, _, want in others)


def test_changed_copies_beside_other_pages_keep_their_text(spark):
    others = [page(i) for i in range(12)]
    rows = copies(7, lambda i, html: html.replace("var a", f"var a{i}"))
    got = run(spark, [*others, *rows])
    assert {got[i].text for i in range(900, 907)} == {WANT}


def test_a_host_of_copies_alone(spark):
    got = run(spark, copies(6))
    assert {got[i].text for i in range(900, 906)} == {WANT}
