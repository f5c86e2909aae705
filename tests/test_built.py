"""The built table's columns, and prices told in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismata.operators import built, specs

ROW = {
    "id": 1, "model": "Arc 18", "brand": "nord-light", "type": ["lamp"], "led": ["CREE XP-L HI V3", "unknown"], "battery": ["2x18650", "rechargeable"], "lumens": [900.0, 0.5], "runtime_hours": [1.5],
    "modes": ["turbo", "moon", "strobe"], "levels": 7, "material": ["Aluminium"], "switch": ["Tail"], "features": ["Pocket Clip"], "length_mm": 120.0, "bezel_mm": 0.0, "body_mm": 25.4, "weight_g": 6000.0, "impact": ["1.5m"],
    "image_urls": ["a.jpg", "b.jpg"], "purchase_urls": ["https://x"], "price_usd": 49.5,
}


def test_one_full_and_one_empty_entry(spark):
    kinds = ", ".join(f"{c} {built.ENTRY[c]}" for c in ROW if c != "id")
    df = spark.createDataFrame([tuple(ROW.values()), (2, *[None] * (len(ROW) - 1))], f"id int, {kinds}")
    full, empty = built.built(df, keep=("id",)).orderBy("id").collect()
    want = {
        "_pic": "a.jpg", "brand": "Nord-Light", "led": ["Cree XP-L HI"], "led_options": [], "battery": ["18650", "2x18650"], "levels": ["6+"], "modes": ["900 lum / 1.5h", "0.5 lum", "strobe"], "features": ["clip"], "switch": ["tail switch"],
        "measurements": ["120mm", "⌀25.4mm body", "6000g"], "weight": None, "material": ["aluminum"], "impact": 1.5, "purchase": ["https://x"], "info": [], "price": 49.5, "year": None,
    }
    assert {k: full[k] for k in want} == want
    assert set(empty.asDict()) == {"id", *built.COLUMNS}
    assert all(v in (None, []) for k, v in empty.asDict().items() if k != "id")
    deep = df.withColumn("impact", F.array(F.lit("120m")))
    assert built.built(deep, ["impact"]).first().impact is None


def test_only_the_asked_columns_are_read(spark, tmp_path):
    spark.createDataFrame([(1, "a", 5.0)], "id int, model string, wh double").write.parquet(str(tmp_path / "e"))
    plan = built.built(spark.read.parquet(str(tmp_path / "e")), ["model"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<model:string>" in plan


def test_prices_in_texts(spark):
    cases = [("Now $29.90$29.90 List: $35.99", 35.99), ("$29.90$29.90 in stock", 29.9), ("$1.00$2.00 then $7.50$7.50", 7.5), ("Our price: $1,089.95", 1089.95), ("MSRP $2", None), ("MSRP $2 price: $20", 20.0), ("costs $20", None), ("", None), (None, None)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    assert [(r.t, r.p) for r in df.select("t", specs.told_price(F.col("t")).alias("p")).collect()] == cases
