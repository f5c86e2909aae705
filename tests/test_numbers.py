"""Figures as text: digits of the exact binary value."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from prismata.functions.numbers import fixed_text, si_text
from prismata.operators.prices import sparkline


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_digits_are_those_of_printf(spark, digits):
    r = random.Random(digits)
    values = [0.0, -0.0, 0.5, 1.5, 2.5, 0.25, 0.75, 0.125, 0.375, 0.005, 0.015, 0.045, 0.055, 0.0625, 0.004999999999999999, 1e-300, 1.005, 1.115, 99.95, 9.995, 0.995, 999.5, 1000.5, -2.5, -0.004, 123456789.125, 2.0**53 - 1, 2.0**53 + 2]
    values += [round(r.uniform(-1000, 1000), 3) for _ in range(500)] + [r.random() * 10.0 ** -r.randint(0, 5) for _ in range(500)] + [r.randint(0, 10**6) / 8 for _ in range(200)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed_text(F.col("v"), digits).alias("t")).collect()
    assert [(x.v, x.t) for x in got] == [(v, f"{v:.{digits}f}") for v in values]


def test_halves_of_prices(spark):
    """Java's format would give 10.3k, 1.01k and 0.13."""
    rows = spark.createDataFrame([(10250.0,), (1005.0,), (0.125,), (None,)], "v double").select(si_text(F.col("v")).alias("t")).collect()
    assert [x.t for x in rows] == ["10.2k", "1.00k", "0.12", None]


def test_halves_of_a_path(spark):
    """18 - 0.609375 * 16 is 8.25, which is 8.2 in SQL."""
    path = spark.createDataFrame([([1.0, 1.609375, 2.0],)], "p array<double>").select(sparkline(F.col("p")).alias("t")).first().t
    assert path == "M0.0,18.0 L25.0,8.2 L50.0,2.0"
