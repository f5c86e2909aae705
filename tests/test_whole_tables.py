"""Queries that answer every row of their table, not a part of it."""

from __future__ import annotations

from prismata.plans import catalogue

from .compare import connect, rows


def test_every_row_is_asked_for_its_variants(spark, tmp_path):
    names = {1: "red x", 3: "blue x", 5: "small x", 7: "large x", 2: "red x", 4: "green x", 9: "green x", 11: "red y", 13: "small red z", 14: "small blue z"}
    part = [(i, n, "b") for i, n in names.items()] + [(15, "blue y", "c"), (17, None, "b"), (19, "blue x", None), (None, "blue x", "b")]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))

    def first(i, name, brand):
        asked = {name.replace("red", "blue"), name.replace("small", "large")} if name else set()
        return min((j for j, n, b in part if None not in (i, j, b) and b == brand and n in asked and j != i), default=None)

    want = {i: c for i, n, b in part if (c := first(i, n, b)) is not None}
    assert want == {1: 2, 2: 1, 5: 7, 4: 9, 9: 4, 13: 14}
    got = catalogue.QUERIES["variant_candidate"](spark, str(tmp_path))
    assert {r.id: r.candidate for r in got.collect()} == want


def test_every_part_of_a_table_is_asked_for_its_variants(spark, small_dir):
    con = connect(small_dir)
    got = catalogue.QUERIES["variant_candidate"](spark, small_dir)
    whole = """SELECT a.p_partkey AS id, min(b.p_partkey) AS candidate FROM part a JOIN part b ON b.p_brand = a.p_brand AND b.p_partkey <> a.p_partkey
        WHERE b.p_name = replace(a.p_name, 'red', 'blue') OR b.p_name = replace(a.p_name, 'small', 'large') GROUP BY 1"""
    assert rows(got.toPandas()) == rows(con.execute(whole).fetchdf())
    assert {r.id % 2 for r in got.select("id").collect()} == {0, 1}
