"""Main texts of hand-written pages whose article is known."""

from __future__ import annotations

from prismata.llm import html_template as h

SCHEMA = "page_id long, url string, html string"


def page(i: int, host: str = "site.example", body: str | None = None) -> tuple[int, str, str, str]:
    """id, url, html, and the article that should come out."""
    article = [f"Title {i} about things", f"First paragraph {i} with several words & a sign.", f"Second one, number {i}, somewhat longer than the first so that it weighs."]
    inner = body or f"<h1>{article[0]}</h1><p>{article[1].replace('&', '&amp;')}</p>\n<p>Second one,\n number <b>{i}</b>, somewhat&#32;longer than\tthe first so that it weighs.</p>"
    html = f"""<!DOCTYPE html><html><head><title>T {i}</title><style>p {{ x }}</style></head><body>
<div class="top-nav"><ul><li><a href="/">Home</a></li><li>About</li></ul></div>
<header><p>Site name</p></header>
<div id="wrap"><div class="content"><!-- note <p>hidden</p> -->{inner}<script>var a = "<p>no</p>";</script></div>
<div class="block7">Follow our letters to hear of everything</div>
<div class="sidebar"><p>Links</p></div></div>
<div id="comments"><p>Reader says {i} words of comment</p></div>
<form><input name=q><button>Go</button></form><footer>Imprint</footer></body></html>"""
    return i, f"https://{host}/p/{i}", html, "\n".join(article)


def run(spark, rows) -> dict:
    df = spark.createDataFrame([r[:3] for r in rows], SCHEMA)
    return {r.page_id: r for r in h.extract(df).collect()}


def test_articles_of_a_host(spark):
    rows = [page(i) for i in range(12)] + [page(i, "other.example") for i in range(100, 109)]
    got = run(spark, rows)
    for i, url, _, want in rows:
        assert got[i].text == want
        assert got[i].url == url and got[i].n_chars == len(want)


def test_fixed_text_is_template_even_inside_the_slot(spark):
    """A container with the same text on every page of the host is no part of any article."""
    rows = []
    for i in range(10):
        body = f"<p>Own text {i} with many words that differ from page to page {i * 7}.</p><div class='x1'>The same words stand on every page.</div><p>More own text {i * 3}.</p>"
        rows.append(page(i, body=body))
    got = run(spark, rows)
    assert got[3].text == "Own text 3 with many words that differ from page to page 21.\nMore own text 9."


def test_single_page_and_broken_markup(spark):
    rows = [
        (1, "http://a.example/", "<p>One<p>Two <i>words</i><br>Three &lt;b&gt; &eacute; &#x1F5FC; &nbsp;x</div></p>"),
        (2, None, "plain text only"),
        (3, "not a url", None),
        (4, "http://a.example/2", ""),
        (5, "http://b.example", "<div><p>open <b>tags"),
        (6, "http://c.example", "<script>never closed <p>x"),
        (7, "http://d.example", "a < b and c > d <notatag attr='>'>e</notatag>"),
        (7, "http://d.example", "a < b and c > d <notatag attr='>'>e</notatag>"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS host", "'y' AS skeleton")
    got = h.extract(df).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[1] == "One\nTwo words\nThree <b> é 🗼 x"
    assert text[2] == "plain text only"
    assert text[3] == text[4] == text[6] == ""
    assert text[5] == "open tags"
    assert text[7] == "a < b and c > d e"


def test_empty_table(spark):
    assert h.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_page(spark):
    body = "".join(f"<p>Paragraph {i} of a very long page.</p>" for i in range(20_000))
    got = run(spark, [page(1, body=body)])
    assert got[1].text.count("\n") == 19_999


def test_every_page_of_the_table(spark, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    got = h.extract(pages).collect()
    assert len(got) == pages.count()
    assert all(r.n_chars == len(r.text) for r in got)
    assert sum(r.n_chars > 0 for r in got) > 0.9 * len(got)
    assert not any("  " in r.text or "\n\n" in r.text or r.text != r.text.strip() for r in got)
