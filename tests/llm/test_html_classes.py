"""Equivalence classes against their definition, templates without tag signals, names, and pages built to be slow."""

from __future__ import annotations

import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from prismata.llm import html_template as h
from prismata.llm.html_page import Page

from .test_html_template import SCHEMA, page, run


def table(spark, rows):
    return spark.createDataFrame([r[:3] for r in rows], SCHEMA)


def brute_classes(rows, least: int):
    """(host, vector) groups of tokens on at least ``least`` distinct pages, and whether they keep one order."""
    vectors: dict = defaultdict(lambda: defaultdict(dict))
    places: dict = defaultdict(dict)
    for _, url, html, *_ in rows:
        host = h.host_of(url)
        for token, t in h.page_tokens(Page(html or "")).items():
            vectors[host][token][html] = t[2]
            places[html][token] = (t[3], t[4])
    out = set()
    for host, tokens in vectors.items():
        groups = defaultdict(set)
        for token, v in tokens.items():
            if len(v) >= least:
                groups[frozenset(v.items())].add(token)
        for v, group in groups.items():
            orders = set()
            for html, _ in v:
                ends = [(p, t) for t in group for p in places[html][t]]
                orders.add(tuple(t for _, t in sorted(ends)))
            out.add((host, frozenset(group), len(orders) == 1))
    return out


def test_classes_equal_their_definition(spark, small_dir):
    rows = [page(i) for i in range(8)] + [page(3)]
    swapped = "<div class='p'>one</div><div class='q'>two</div>", "<div class='q'>two</div><div class='p'>one</div>"
    rows += [page(20 + i, "swap.example", f"<p>text {i}</p>{swapped[i % 2]}") for i in range(6)]
    rows += [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{small_dir}/pages.parquet").limit(40).collect()]
    tokens = table(spark, rows).mapInArrow(h._tokens(True), ", ".join(f"{c} long" for c in h.TOKENS))
    tokens = tokens.groupBy("host", "mark", "token").agg(*[F.max(c).alias(c) for c in h.TOKENS[3:]])
    got = defaultdict(set)
    for r in h.classes(tokens, 3, 0.0).collect():
        got[(r["host"], r["cls"], r["cls_ordered"])].add(r["token"])
    assert {(host, frozenset(t), ordered) for (host, _, ordered), t in got.items()} == brute_classes(rows, 3)
    assert any(not ordered for _, _, ordered in got)


def test_a_class_over_two_slots_is_split():
    token = lambda t, parent, cls, sib: dict(token=t, parent=parent, cls=cls, sib=sib, cls_ordered=True, sib_ordered=True)
    tokens = [token(1, 0, 10, 11), token(2, 1, 10, 12), token(3, 1, 10, 12), token(4, 2, 20, 21), token(5, 3, 20, 22)]
    assert h.valid_classes(tokens) == {1: 10, 2: 10, 3: 10, 4: 21, 5: 22}


def plain(i: int) -> tuple[int, str, str, str]:
    """A page of divs only; the advert is one of three, the menu varies, the footer is fixed and longer than the article."""
    want = f"Heading number {i * 17}\nWords of page {i} that stand nowhere else, {i * 31} of them.\nMore of them {i * 7}."
    head, first, second = want.split("\n")
    html = f"""<body><div class=m>Menu {i % 2} all pages news</div><div class=z>{["Buy soap", "Buy boats", "Buy bread"][i % 3]}</div>
<div class=t><div class=u>{head}</div><p>{first}<p>{second}</div>
<div class=e>{"The imprint of this site is the same wherever you look and goes on. " * 20}</div></body>"""
    return i, f"http://plain.example/{i}", html, want


def test_the_template_alone_finds_the_article(spark):
    rows = [plain(i) for i in range(20)]
    df = table(spark, rows)
    on = {r.page_id: r.text for r in h.extract(df, signals=False).collect()}
    off = {r.page_id: r.text for r in h.extract(df, min_pages=10**9).collect()}
    assert all(on[i] == want for i, _, _, want in rows)
    assert all(off[i] != want for i, _, _, want in rows)


NAMED = ["<div class='content has-sidebar'>{}</div>", "<div class='post no-sidebar'>{}</div>", "<div class='entry comments-open'>{}</div>", "<div class='post hentry category-legal'>{}</div>", "<div class='page full-width-header'>{}</div>", "<section id='alert-story'>{}</section>", "<div class='sidebar'>{}</div>"]


@pytest.mark.parametrize("shape", NAMED)
def test_a_name_takes_no_article_away(spark, shape):
    body = lambda i: f"<h1>Title {i}</h1><p>Paragraph {i} tells of several things at once.</p>"
    rows = [(i, f"http://{'one' if i < 12 else f'host{i}'}.example/{i}", f"<html><body>{shape.format(body(i))}<div class='sidebar'>Links</div></body></html>") for i in range(14)]
    got = run(spark, rows)
    assert all(got[i].text == f"Title {i}\nParagraph {i} tells of several things at once." for i in range(14))


def test_words_inside_attribute_values_hide_nothing(spark):
    text = "<p>See <a href='/hidden/valley' title='the hidden cost of x' data-hidden='false'>the valley</a> and <b data-id='comments' data-role='search'>more</b>.</p>"
    got = run(spark, [(1, "http://a.example/1", f"<body>{text}<p hidden>not this</p><p aria-hidden=true>nor this</p></body>")])
    assert got[1].text == "See the valley and more."


SLOW = ["<a b " * 200_000, "<a b='" * 200_000, "<div>" * 20_000 + "</b>" * 20_000, "<p " * 300_000, "<!--" * 250_000, "<td><p>" * 20_000, "<a " + " " * 1_000_000, "<" * 1_000_000]


@pytest.mark.parametrize("html", SLOW, ids=range(len(SLOW)))
def test_reading_is_linear(html):
    begin = time.process_time()
    h.main_text(Page(html), None, None)
    assert time.process_time() - begin < 3
