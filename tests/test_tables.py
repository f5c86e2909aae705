"""Grids, records, specs and modes of pages, and what unclosed markup costs."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from prismata.functions import text as tx
from prismata.functions import urls as ur
from prismata.operators import specs
from prismata.operators import tables as tb

SPANS = """<h1>x</h1><!-- <table><tr><td>gone</table> --><table class="a"><tr><th>Mode</th><th colspan="2">Output (lm)</th></tr>
<tr><td rowspan='2'>High</td><td>1,000</td><td>2&nbsp;h</td></tr><tr><td>900</td><td><b>3</b> h</td></tr><tr><td>Low</td><td></td></table>after"""
NESTED = """<table><tr><td>Lumens:</td><td><table><tr><th>Mode<th>Lumens<th>Runtime (min)<tr><td>Turbo<td>4500 lumens<td>45<tr><td>Eco<td>20<td>90</table>4,500 lm</td></tr>
<tr><td>Weight</td><td>142</td></tr><tr><td>Beam distance</td><td>500 m</td></tr><tr><td>Length</td><td>13.2 cm</td></table><ul><li><b>CRI:</b> 95</li><li>plain &amp; simple<li></ul><dl><dt>CCT<dd>4000K<dt>Empty</dl></ul>"""


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page long, html string")


def told(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_spans_fill_the_grid(spark):
    got = told(tb.cells(pages(spark, SPANS), "page", "html"), "row", "column", "head", "text")
    assert got == [(0, 0, True, "Mode"), (0, 1, True, "Output (lm)"), (0, 2, True, "Output (lm)"), (1, 0, False, "High"), (1, 1, False, "1,000"), (1, 2, False, "2 h"), (2, 0, False, "High"), (2, 1, False, "900"), (2, 2, False, "3 h"), (3, 0, False, "Low"), (3, 1, False, "")]


def test_header_rows_are_keys(spark):
    got = told(tb.records(pages(spark, SPANS), "page", "html"), "row", "label", "key", "value")
    key = "output (lm)"
    assert got == [(1, "High", key, "1,000"), (1, "High", key, "2 h"), (2, "High", key, "3 h"), (2, "High", key, "900"), (3, "Low", key, "")]


def test_blocks_inside_cells_are_blocks_of_their_own(spark):
    got = told(tb.records(pages(spark, NESTED), "page", "html"), "block", "row", "label", "key", "value")
    assert got == [
        (0, 0, "", "lumens", "4,500 lm"), (0, 1, "", "weight", "142"), (0, 2, "", "beam distance", "500 m"), (0, 3, "", "length", "13.2 cm"),
        (1, 1, "Turbo", "lumens", "4500 lumens"), (1, 1, "Turbo", "runtime (min)", "45"), (1, 2, "Eco", "lumens", "20"), (1, 2, "Eco", "runtime (min)", "90"),
        (2, 0, "", "cri", "95"), (2, 1, "", "", "plain & simple"), (2, 2, "", "", ""), (3, 0, "", "cct", "4000K"), (3, 1, "", "", "Empty"),
    ]


def test_specs_and_modes(spark):
    r = tb.records(pages(spark, NESTED), "page", "html")
    got = tb.specs(r).first()
    assert (got.lumens, got.throw_m, got.length_mm, got.weight_g, got.cct, got.cri) == (4500.0, 500.0, pytest.approx(132.0), 142.0, 4000.0, 95.0)
    assert told(tb.modes(r), "mode", "lumens", "runtime_h") == [("Eco", 20.0, 1.5), ("Turbo", 4500.0, 0.75)]


def test_odd_pages(spark):
    odd = [None, "", "no block", "</table></ul>", "<table>", "<table><tr>", "<table><tr><td rowspan=0 colspan=99999>x<tr><td>y", "</ul><ul><li>a", "<script><table><tr><td>s"]
    got = tb.cells(pages(spark, *odd), "page", "html")
    assert told(got.where("page not in (6)"), "page", "block", "kind", "text") == [(7, 0, "list", "a")]
    wide = got.where("page = 6")
    assert wide.count() == 2001 and told(wide.where("text = 'y'"), "row", "column") == [(1, 1000)]
    assert tb.records(pages(spark, *odd[:4]), "page", "html").collect() == []


def plain_grid(rows: list[list[tuple[str, int, int]]]) -> set[tuple[int, int, str]]:
    """Cells (text, colspan, rowspan) laid out place by place."""
    out, carried = set(), {}
    for r, row in enumerate(rows):
        at, below = 0, {c: (t, n - 1) for c, (t, n) in carried.items() if n > 1}
        here = {c: t for c, (t, _) in carried.items()}
        for text, wide, tall in row:
            for _ in range(wide):
                while at in carried:
                    at += 1
                here[at] = text
                if tall > 1:
                    below[at] = (text, tall - 1)
                at += 1
        carried = below
        out |= {(r, c, t) for c, t in here.items()}
    return out


def test_random_spans_match_a_plain_layout(spark):
    import random

    rng = random.Random(4)
    tables = [[[(f"{r}.{c}", rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 4])) for c in range(rng.randrange(1, 4))] for r in range(rng.randrange(1, 7))] for _ in range(40)]
    html = ["<table>" + "".join("<tr>" + "".join(f'<td colspan="{w}" rowspan={h}>{t}</td>' for t, w, h in row) + "</tr>" for row in t) + "</table>" for t in tables]
    got = tb.cells(pages(spark, *html), "page", "html").collect()
    for i, t in enumerate(tables):
        assert {(r.row, r.column, r.text) for r in got if r.page == i} == plain_grid(t)


@pytest.mark.parametrize("piece", ["<nav>", "<a b ", "<script>", "<!--", "<table>", "<tr><td>", "<ul><li>", "<title>", "<a href=", "</td"])
def test_a_megabyte_of_unclosed_tags_is_linear(spark, piece):
    df = pages(spark, piece * (1_000_000 // len(piece)))
    df = df.select("page", "html", tx.html_to_text(F.col("html")).alias("t"), ur.links(F.col("html")).alias("l"), ur.anchors(F.col("html")).alias("a"), ur.title(F.col("html")).alias("n"))
    began = time.perf_counter()
    df.select(F.length("t"), F.size("l"), F.size("a"), F.length("n")).collect()
    if piece not in ("<ul><li>", "<table>"):
        tb.cells(df, "page", "html").count()
    assert time.perf_counter() - began < 20  # seconds, session start and a busy machine included; a quadratic pass takes minutes


def test_sections_under_headings(spark):
    html = "<h1>Top</h1>short<h2 class=x>Battery &amp; <b>runtime</b></h2><p>lasts two hours on high and three days on low</p><nav><h2>no</h2>" + "x" * 50 + "</nav><h3>Unclosed<p>" + "y" * 40
    df = pages(spark, html, None, "", "<h1>" * 1000 + "z" * 40)
    got = df.select("page", F.explode(specs.sections(F.col("html"), {"power": "battery"})).alias("s")).select("page", "s.*").collect()
    assert [tuple(r) for r in got] == [(0, "Battery & runtime", "power", "lasts two hours on high and three days on low")]


def test_no_step_is_worked_out_again_by_a_filter(spark):
    """Spark tests what it explodes; pushed below the steps that build a grid, such a test repeats all of them for each."""
    p = pages(spark, SPANS)
    for df in (tb.records(p, "page", "html"), tb.cells(p, "page", "html")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert max(len(line) for line in plan.splitlines() if "Filter" in line[:80].split("(")[0]) < 1000
        assert "try_cast" not in plan  # a failed one costs an exception for each cell


def test_odd_spans(spark):
    html = "<table><tr><td ROWSPAN=000>a<td colspan=''>b<tr><td colspan=x>c<tr><td data-span=2>d</table>"
    got = told(tb.cells(pages(spark, html), "page", "html"), "row", "column", "text")
    assert got == [(0, 0, "a"), (0, 1, "b"), (1, 0, "a"), (1, 1, "c"), (2, 0, "a"), (2, 1, "d")]
