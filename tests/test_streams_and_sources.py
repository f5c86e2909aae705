"""Streams over several files, late data, restarts; landed files and sinks."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from prismata.operators import vocabulary as vo
from prismata.sources import landed
from prismata.streaming import events as ev

SCHEMA = "event_id long, user_id long, ts timestamp, value double"


def at(hour: float) -> datetime:
    return datetime(2024, 1, 1 + int(hour // 24), int(hour % 24), int(hour * 60 % 60))


def land(spark, path, number: int, rows) -> None:
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_late_events_are_dropped(spark, tmp_path):
    """An event behind the watermark no longer changes its closed window."""
    path = str(tmp_path / "events")
    land(spark, path, 0, [(1, 1, at(0.5), 1.0), (2, 1, at(10), 1.0)])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    windows = ev.tumbling(stream, "ts", "1 hour", ["user_id"], [F.count(F.lit(1)).alias("n")], "2 hours")
    ev.run_available(windows, "append", "late")
    land(spark, path, 1, [(3, 1, at(0.6), 1.0), (4, 1, at(30), 1.0)])
    got = ev.run_available(windows, "append", "late")
    land(spark, path, 2, [(5, 1, at(31), 1.0)])
    got = {(r.start, r.n) for r in ev.run_available(windows, "append", "late").collect()}
    assert (at(0), 1) in got and (at(10), 1) in got
    assert not any(s == at(0) and n > 1 for s, n in got)


def test_restart_adds_nothing_twice(spark, tmp_path):
    path = str(tmp_path / "queue")
    land(spark, path, 0, [(i, i % 3, at(i), float(i)) for i in range(6)])
    sink = str(tmp_path / "out")
    work = lambda df: ev.with_outcome(df, F.when(F.col("value") > 4, F.lit("too dear")))
    for _ in range(2):
        ev.drain(spark.readStream.schema(SCHEMA).parquet(path), work, sink, "restart")
    land(spark, path, 1, [(9, 1, at(9), 9.0)])
    ev.drain(spark.readStream.schema(SCHEMA).parquet(path), work, sink, "restart")
    got = spark.read.parquet(sink).orderBy("event_id").collect()
    assert [r.event_id for r in got] == [0, 1, 2, 3, 4, 5, 9]
    assert all(r.scraped for r in got) and [r.event_id for r in got if r.error] == [5, 9]


def test_dedup_within_watermark_and_batch_alike(spark, tmp_path):
    path = str(tmp_path / "events")
    land(spark, path, 0, [(1, 1, at(1), 1.0), (1, 1, at(1), 1.0), (2, 1, at(2), 2.0)])
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    got = ev.run_available(ev.deduplicated(stream, ["event_id"], "ts", "1 day"))
    assert sorted(r.event_id for r in got.collect()) == [1, 2]
    assert ev.deduplicated(spark.read.parquet(path), ["event_id"], "ts").count() == 2


def test_storefront_pages_become_entries(spark, tmp_path):
    products = [
        {"title": "Arc 18", "handle": "arc-18", "vendor": "Nord", "product_type": "lamp", "tags": ["edc"], "body_html": "<p>900 lumens</p>", "images": [{"src": f"i{i}.jpg"} for i in range(7)], "variants": [{"title": "a", "price": "49.50", "available": False}, {"title": "b", "price": "0", "available": True}, {"title": "c", "price": "n/a"}], "options": [{"name": "Color", "values": ["Black", "Sand"]}, {"name": "LED", "values": ["x"]}]},
        {"title": "Bare", "handle": "bare", "vendor": "Nord"},
    ]
    (tmp_path / "p1.json").write_text(json.dumps({"products": products}))
    (tmp_path / "p2.json").write_text(json.dumps({"products": products[:1]}))
    got = {r.id: r for r in landed.entries(landed.storefront(spark, str(tmp_path)), "https://shop.example/").collect()}
    assert set(got) == {"nord-arc-18", "nord-bare"}
    a = got["nord-arc-18"]
    assert (a.price_usd, a.price_high, a.color, len(a.image_urls), a.in_stock) == (49.5, 49.5, ["Black", "Sand"], 5, True)
    assert a.url == "https://shop.example/products/arc-18"
    assert got["nord-bare"].price_usd is None and got["nord-bare"].color == []


def test_second_store_shape(spark, tmp_path):
    """Prices in minor units, attributes, a sale price, categories by name."""
    products = [
        {"id": 7, "name": "Nord Arc 18 &amp; Case", "permalink": "https://two.example/arc", "prices": {"price": "4950", "currency_minor_unit": 2}, "images": [{"src": "a.jpg"}], "attributes": [{"name": "Colour", "terms": [{"name": "Black"}]}, {"name": "Length", "terms": [{"name": "120 mm"}]}], "categories": [{"name": "Lamps"}], "description": "<p>Length: 120 mm, 900 lumens</p>", "is_in_stock": True},
        {"id": 8, "name": "Bare", "permalink": "https://two.example/bare"},
    ]
    (tmp_path / "p1.json").write_text(json.dumps(products))
    (tmp_path / "p2.json").write_text(json.dumps(products[:1]))
    got = {r.id: r for r in landed.second_entries(landed.second_store(spark, str(tmp_path)), "Nord").collect()}
    a = got["nord-arc-18-case"]
    assert (a.model, a.brand, a.price_usd, a.color, a.in_stock, a.url) == ("Arc 18 & Case", "Nord", 49.5, ["Black"], True, "https://two.example/arc")
    assert got["nord-bare"].price_usd is None and got["nord-bare"].color == []
    assert landed.reviews(spark.createDataFrame([(1, "<h1>Nord Arc 18 review</h1><p>Measured 850 lumens, CRI 95</p>", "https://r.example/1")], "page_id long, html string, url string")).collect()[0].asDict() == {"page_id": 1, "url": "https://r.example/1", "subject": "Nord Arc 18", "measured_lumens": [850.0], "measured_cri": 95.0, "measured_cct": []}


def test_sitemaps_and_matrices(spark, tmp_path):
    loc = lambda u: f"<loc> {u} </loc>"
    site = {
        "https://a/map": f"<sitemapindex><sitemap>{loc('https://a/one')}</sitemap><sitemap>{loc('https://a/two.xml')}</sitemap><sitemap>{loc('https://a/gone.xml')}</sitemap></sitemapindex>",
        "https://a/one": f"<urlset><url>{loc('https://a/p1')}</url><url>{loc('https://a/p2')}</url><url>{loc('https://a/two.xml')}</url></urlset>",
        "https://a/two.xml": f"<sitemapindex><sitemap>{loc('https://a/three.xml')}</sitemap><sitemap>{loc('https://a/map')}</sitemap></sitemapindex>",
        "https://a/three.xml": f"<urlset><url>{loc('https://a/p2')}</url><url>{loc('https://a/p3')}</url><sitemap>{loc('https://a/two.xml')}</sitemap></urlset>",
        "https://b/map": f"<urlset><url>{loc('https://b/never')}</url></urlset>",
    }
    files = spark.createDataFrame([*site.items(), ("https://a/empty", None)], "url string, body string")
    got = {(r.url, r.level) for r in landed.sitemap_pages(files, ["https://a/map"]).collect()}
    assert got == {("https://a/p1", 1), ("https://a/p2", 1), ("https://a/p3", 2)}
    assert landed.sitemap_pages(files, ["https://a/none"]).collect() == []
    wanted = spark.createDataFrame([(1, ["x", "y", "z"]), (2, ["q"]), (3, None)], "id int, urls array<string>")
    done = spark.createDataFrame([("x", False, None), ("y", True, "Y"), ("z", True, "Z")], "url string, ok boolean, body string")
    assert [tuple(r) for r in landed.first_success(wanted, "id", "urls", done).collect()] == [(1, "y", "Y")]
    (tmp_path / "m.json").write_text(json.dumps({"head": ["model", "lumens"], "data": [["A", "10"], ["B"]]}))
    got = {(r.row, r.column, r.value) for r in landed.matrix(spark, str(tmp_path / "m.json")).collect()}
    assert got == {(0, "model", "A"), (0, "lumens", "10"), (1, "model", "B")}


def test_segments_hosts_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x" * 20_000, "https://www.a.example/1"), (2, "short", "https://b.example/2"), (3, None, "https://a.example/3")], "id int, text string, url string")
    kept = landed.text_segments(df, "text").collect()
    assert [(r.id, len(r.text)) for r in kept] == [(1, 15_000)]
    done = df.where("id = 2")
    assert {(r.host, r.n) for r in landed.pending_hosts(df, "url", done).collect()} == {("a.example", 2)}
    landed.write_dataset(df, spark.createDataFrame([("id", "range")], "column string, kind string"), str(tmp_path / "set"))
    rows, facets = landed.read_dataset(spark, str(tmp_path / "set"))
    assert rows.count() == 3 and facets.first().kind == "range"
    landed.write_feed(df.select("id"), str(tmp_path / "feed"))
    assert spark.read.json(str(tmp_path / "feed")).count() == 3
    lines = landed.report_lines(df.select("id", F.col("text").substr(1, 3).alias("t")), ["id", "t"])
    assert [r.value for r in lines.orderBy("value").collect()] == ["| 1 | xxx |", "| 2 | sho |", "| 3 |  |"]


GOLDEN = {
    "battery": [(["18650"], ["18650"]), (["2x18650"], ["18650", "2x18650"]), (["1x AA battery"], ["AA"]), (["rechargeable", "Li-ion", None], ["Li-ion"]), (["AAA"], ["AAA"]), (["unknown", ""], [])],
    "material": [(["Aluminium", "AL"], ["aluminum"]), (["stainless steel 304"], ["stainless steel"]), (["wood"], ["wood"]), (["x" * 60], [])],
    "switch": [(["Tail", "rear click"], ["tail switch"]), (["E-switch"], ["electronic switch"]), (["none"], [])],
    "features": [(["Pocket Clip", "magnetic tail"], ["clip", "magnet"]), (["USB Type-C charging"], ["usb-c"])],
    "led": [(["Cree XHP70.2 HI"], ["Cree XHP70.2 HI"]), (["unknown"], [])],
}


def test_vocabulary_golden_cases_and_idempotence(spark):
    for name, cases in GOLDEN.items():
        df = spark.createDataFrame([(a,) for a, _ in cases], "c array<string>")
        once = df.select(vo.NORMALISERS[name](F.col("c")).alias("c"))
        assert [r.c for r in once.collect()] == [b for _, b in cases], name
        twice = once.select(vo.NORMALISERS[name](F.col("c")).alias("c"))
        assert twice.collect() == once.collect(), name
