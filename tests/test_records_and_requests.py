"""Records of unknown shape, order of strings, and requests that overtake each other."""

from __future__ import annotations

import threading
import time

from pyspark.sql import functions as F

from prismata.functions import text as tx
from prismata.operators import facets as fa
from prismata.operators import records as re_
from prismata.operators.latest import Latest

FIELDS = {"n": re_.Number("$.n", 1, 10), "t": re_.Text("$.t", 5), "tags": re_.Items("$.tags", 3, longest=4), "nums": re_.Items("$.nums", 3, low=0, high=9), "deep": re_.Number("$.a.b[1].c", 0, 100)}


def test_records(spark):
    rows = [
        '{"n": 5, "t": "abc", "tags": ["a", 1, null, "too long", ""], "nums": [1, "2", 99, 3.5]}',
        '{"n": "7", "t": 12, "tags": ["a", "b"], "nums": [1, "2", 99], "a": {"b": [0, {"c": 42}]}}',
        '{"n": 11, "t": "abcdef", "tags": "a", "nums": {}, "a": {"b": []}}',
        '{"n": true, "t": {"x": 1}, "tags": null}',
        "[1, 2]", '"text"', "{broken", "", None, '{"n": 1} trailing', "{}",
    ]
    got = [tuple(r)[1:] for r in re_.read(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string"), "j", FIELDS).orderBy("i").drop("j").collect()]
    assert got[0] == (5.0, "abc", None, None, None, None)  # arrays of four and five items are over-long
    assert got[1] == (7.0, None, ["a", "b"], [1.0], 42.0, None)
    assert got[2] == (None,) * 6 and got[3] == (None,) * 6 and got[10] == (None,) * 6
    assert [g[-1] for g in got[4:9]] == rows[4:9] and all(g[:5] == (None,) * 5 for g in got[4:9])
    assert got[9] == (1.0, None, None, None, None, None)


def test_strings_in_the_order_of_letters(spark):
    names = ["zebra", "Émile", "emile", "Eclair", "apple", "Äpfel", "", None, "éclair", "Zoo"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    down = [r.name for r in fa.query(df, fa.Spec(sort="name"), "id").collect()]
    assert down[-2:] == ["", None]
    assert [n for n in down if n] == ["Zoo", "zebra", "Émile", "emile", "éclair", "Eclair", "apple", "Äpfel"]
    up = [r.name for r in fa.query(df, fa.Spec(sort="name", descending=False), "id").collect()]
    assert up == down[::-1]


def test_a_line_scanner_with_state(spark):
    text = "menu\nstop here\nPRODUCT\n\nfirst\n \n\nsecond\nskip me\n\nstop here\nfooter"
    df = spark.createDataFrame([(text,), ("no start\nstop here\nend",), ("",), (None,)], "t string")
    got = [r.x for r in df.select(tx.after_anchor(F.col("t"), "^PRODUCT$", "^stop", "^skip").alias("x")).collect()]
    assert got == ["first\n\nsecond", "no start\nstop here\nend", "", None]


def test_the_latest_request_wins(spark):
    place, got = Latest(spark), {}
    def ask(name, df):
        got[name] = place.rows(df)

    first = threading.Thread(target=ask, args=("slow", spark.range(0, 1 << 40, 1, 8).where(F.sha2(F.col("id").cast("string").cast("binary"), 512) == "x")))
    first.start()
    time.sleep(3)
    began = time.perf_counter()
    ask("new", spark.range(3))
    first.join(30)
    assert not first.is_alive() and time.perf_counter() - began < 30
    assert got["slow"] == [] and [r.id for r in got["new"]] == [0, 1, 2]
    assert [r.id for r in place.rows(spark.range(1))] == [0]
