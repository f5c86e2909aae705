"""Golden cases of extraction, vocabularies and display strings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from prismata.functions import text as tx
from prismata.operators import extraction as ex
from prismata.operators import vocabulary as vo


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first().x


def many(spark, cases, expression):
    df = spark.createDataFrame([(k,) for k, _ in cases], "t string")
    return [(r.t, r.x) for r in df.select("t", expression(F.col("t")).alias("x")).collect()]


TEXT = """Max output: 4,500 lumens, low 1 lm. Peak intensity: 62,500 cd, beam distance: 1,640 ft or 500 m throw.
Runtime: 45 minutes on turbo, 2.5 hours on high, 3 days on moonlight. Length: 13.2 cm, head 32 mm, body 25.4 mm.
Weighs 5 oz (142 g). CRI: 95, 4000K or 6500 K. Sold since 2021 for $129.95 with a 21700 cell, clip and USB-C."""
FIELDS = {"lumens": [4500.0, 1.0], "candela": 62500.0, "throw_m": 500.0, "runtime_h": [72.0, 2.5, 0.75], "length_mm": 132.0, "bezel_mm": 32.0, "body_mm": 25.4, "weight_g": 142.0, "cri": 95.0, "cct": [6500.0, 4000.0], "price": 129.95, "year": 2021.0}


@pytest.mark.parametrize("name", sorted(FIELDS))
def test_fields_of_a_text(spark, name):
    assert one(spark, TEXT, lambda t: ex.extract(t, name)) == pytest.approx(FIELDS[name])


def test_missing_empty_and_implausible(spark):
    for text in (None, "", "900000 lumens, runs 9000 hours"):
        got = one(spark, text, lambda t: ex.extract(t, "lumens"))
        assert got in (None, [])
        assert one(spark, text, lambda t: ex.extract(t, "weight_g")) is None


def test_terms_and_cells(spark):
    assert one(spark, TEXT, lambda t: ex.terms(F.lower(t), "battery")) == ["21700"]
    assert one(spark, TEXT, lambda t: ex.terms(F.lower(t), "charging")) == ["usb-c"]
    assert one(spark, "intensity: 10,000 cd", ex.throw_or_candela) == 200.0
    assert one(spark, "21700", lambda t: ex.length_for_cell(F.lit(60.0), F.array(t))) is None
    assert one(spark, "21700", lambda t: ex.length_for_cell(F.lit(120.0), F.array(t))) == 120.0


def test_model_colours(spark):
    cases = [("Rose Gold X1", ["pink", "gold"]), ("X1-BK", ["black"]), ("Wave olive", ["green"]), ("Plain", [])]
    assert many(spark, cases, ex.model_colours) == cases


# fixed values: what the vocabularies must give
LEDS = [
    ("519a", "Nichia 519A"), ("NICHIA 519A", "Nichia 519A"), ("XP-G3", "Cree XP-G3"), ("CREE XHP70", "Cree XHP70"), ("SST40", "Luminus SST-40"), ("LUMINUS SST40", "Luminus SST-40"), ("Luminus SBT90.2", "Luminus SBT-90.2"),
    ("XP-LHI", "Cree XP-L HI"), ("XPL HI", "Cree XP-L HI"), ("CREE XPL-Hi", "Cree XP-L HI"), ("XP-LHD", "Cree XP-L HD"), ("CREE XP-L2 V6", "Cree XP-L2"), ("CREE XM-L T6", "Cree XM-L"), ("CREE XP-L HI V3", "Cree XP-L HI"),
    ("Nichia 519a R9080 4000K", "Nichia 519A"), ("Cool White - SST20, 6500K", "Luminus SST-20"), ("NTG35 5000K 95CRI+", "NTG35"), ("8*NTG35 5000K 95CRI+", "8x NTG35"), ("8*Cool White - SST20, 6500K", "8x Luminus SST-20"),
    ("XHP70.2", "Cree XHP70.2"), ("XHP35 HI", "Cree XHP35 HI"), ("XHP-50", "Cree XHP50"), ("Luminus SFT40-W", "Luminus SFT-40-W"), ("219C", "Nichia 219C"), ("E21A", "Nichia E21A"), ("SBT-90 Gen 2", "Luminus SBT-90.2"),
    ("LH351D", "Samsung LH351D"), ("CSLNM1", "Osram CSLNM1.TG"), ("OSRAM P8", "Osram P8"), ("CREE XP-L2 V6 LED", "Cree XP-L2"), ("LED", None), ("White LED", None), ("High Performance Cool White LED", None), ("Cree", None), ("unknown", None), ("Cree XP", None), ("LED Chip", None),
    ("Cree XHP 70.3 HD", "Cree XHP70.3 HD"), ("XHP50.3HI", "Cree XHP50.3 HI"), ("Cree XHP35-HI", "Cree XHP35 HI"), ("XML3", "Cree XM-L3"), ("XPE", "Cree XP-E"), ("XP-L Warm", "Cree XP-L"), ("Luminux SST-40", "Luminus SST-40"), ("MCE", "Cree MC-E"), ("KW CSLPM1.TG", "Osram CSLPM1.TG"), ("XM-L2 U2", "Cree XM-L2"), ("Cree XP-G R5", "Cree XP-G"),
    ("COB LED", "COB"), ("3 W LED", None), ("1 Watt LED bulb", None), ("24 super bright LED", None), ("7 LEDs", None), ("C4 LED", "C4 LED"), ("LEP", "LEP"), ("X-LED", "X-LED"), ("5mm", "5mm"), ("UV LED", "UV LED"), ("RGB LED", "RGB LED"), ("Xenon", "Xenon"), ("Halogen Bulb", "Halogen"), ("red emitters", None), ("Cree XHP", None), ("219B", "Nichia 219B"), ("SBT-90", "Luminus SBT-90"), (None, None), ("", None),
]
BATTERIES = [
    ("18650", "18650"), ("AA", "AA"), ("Sub-C", "Sub-C"), ("123A", "CR123A"), ("CR123", "CR123A"), ("123A lithium", "CR123A"), ("IMR16340", "16340"), ("SF18650B", "18650"), ("10880 Li-ion", "10880"), ("D cell", "D"), ("Lithium Ion", "Li-ion"), ("Li-polymer", "Li-poly"), ("Li-Pol", "Li-poly"),
    ("lithium polymer", "Li-poly"), ("Lithium polymer rechargeable", "Li-poly"), ("NiMH", "NiMH"), ("LiFePO4", "LiFePO4"), ("Alkaline", "alkaline"), ("alkaline batteries", "alkaline"), ("Built-In Li-ion Battery Pack", "built-in"), ("Integrated Rechargeable Lithium-ion", "built-in"), ("5000mAh", "built-in"), ("3.7V 5000mAh", "built-in"), ("20V", None), ("6V lantern", "6V lantern"), ("unknown", None),
    ("LR44", "LR44"), ("CR2016", "CR2016"), ("CR2032", "CR2032"), ("RCR123", "CR123A"), ("C", "C"), ("C cell", "C"), ("NiCd", "NiCd"), ("lithium-polymer", "Li-poly"), ("Built in only", "built-in"), ("Internal Battery Pack", "built-in"), ("ZX840 ZITHION", "built-in"), ("COAST ZITHION lithium-ion", "built-in"), ("0.5Wh li-poly", "built-in"), ("18Wh li-ion", "built-in"), ("3.7V 13.69Wh Li-ion Battery Pack", "built-in"), ("7.4V li-ion", "built-in"),
    ("3.7V 230mAh Rechargeable Lithium Polymer Battery (built-in)", "built-in"), ("130 mAh lithium-ion", "built-in"), ("600mAh lithium polymer", "built-in"), ("built-in 500mAh polymer lithium battery", "built-in"), ("12V sealed lead", "12V lantern"), ("rechargeable", None), ("n/a", None), ("n/a battery", "n/a battery"), ("", None), (None, None),
]


def test_emitters(spark):
    assert many(spark, LEDS, vo.emitter) == LEDS


def test_batteries(spark):
    assert many(spark, BATTERIES, vo.battery) == BATTERIES


def test_multiples_expand(spark):
    got = spark.createDataFrame([(["2x18650", "1xAAA", "3 x D Alkaline", "rechargeable"],)], "a array<string>").select(vo.NORMALISERS["battery"](F.col("a")).alias("x")).first().x
    assert got == ["18650", "2x18650", "3xD", "AAA", "D"]


def test_references(spark):
    assert one(spark, "a&#233;b&#x1F5FC;&#0;&amp;#65; &#xD800;", lambda t: F.replace(tx.numeric_references(t), F.lit("&amp;"), F.lit("&"))) == "aéb🗼&#0;&#65; &#xD800;"
    assert one(spark, "plain", tx.numeric_references) == "plain"
    assert one(spark, None, tx.numeric_references) is None
