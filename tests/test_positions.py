"""Values and their nearest labels in segments."""

from __future__ import annotations

import pytest

from prismata.operators import positions as po

CASES = [
    ("Brightness: 4,500, low 1 lm. Intensity 62,500; throw up to 1,640 ft.", {"lumens": [4500.0, 1.0], "candela": 62500.0, "throw_m": pytest.approx(499.872)}),
    ("Runtime 45 minutes turbo, 2:30 h high, 1h30m eco, 3 days moon, 20 minutes to charge", {"runtime_h": [72.0, 2.5, 1.5, 0.75]}),
    ("Length 132 mm, head 32 mm, body: 25.4 mm, weighs 5 oz (142 g)", {"length_mm": 132.0, "bezel_mm": 32.0, "body_mm": 25.4, "weight_g": pytest.approx(141.7475)}),
    ("Length 60 mm for one 21700", {"length_mm": None}),
    ("Length 120 mm for one 21700 of 5000mAh, 4000K, CRI 95, spill 70 degrees", {"length_mm": 120.0, "capacity_mah": 5000.0, "cct": [4000.0], "cri": 95.0, "beam_angle": 70.0}),
    ("Length: see the table on the next page, it is far below. 44 mm", None),  # too far from its label
    ("12 mm without a label, version 2.5 of 2021", {"version": 2.5, "year": None}),
    ("lumens 900000 lumens, throw 99999 m", None),
    ("", None),
    (None, None),
]


def test_nearest_labels(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id long, t string")
    got = {r.key: r for r in po.fields(df, "id", "t").collect()}
    for i, (text, want) in enumerate(CASES):
        if want is None:
            assert i not in got, text
        else:
            for name, value in want.items():
                assert got[i][name] == value, (text, name, got[i][name])


def test_offsets_are_code_points(spark):
    text = "é🗼 Weight 5 g, length\n12 cm"
    m = po.marks(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").orderBy("i").collect()
    assert [text[r.start : r.end].lower() for r in m] == [r.word for r in m] == ["weight", "5 g", "length", "12 cm"]
