"""The facet compiler against a small model of its semantics on random rows."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismata.operators import facets as fa
from prismata.operators.facet_url import parse, serialise

OPTIONS = ["a", "b", "c", "d", "//b", "e f", "x,y"]


def model_multi(data: list[str], selected: list[str], mode: str) -> bool:
    d, s = set(data), set(selected)
    if mode == "any":
        return bool(d & s)
    if mode == "none":
        return not d & s
    if mode == "all":
        return len(data) >= len(selected) and s <= d
    return 0 < len(data) <= len(selected) and d <= s


def clean(cell):
    return [x.removeprefix("//") for x in cell or [] if x is not None]


@pytest.fixture(scope="module")
def cells():
    rng = random.Random(4)
    rows = [None, [], [None], ["a", "a", "a"], ["//b"], ["b", None]]
    rows += [rng.choices(OPTIONS, k=rng.randint(0, 4)) for _ in range(80)]
    return rows


@pytest.mark.parametrize("mode", fa.MODES)
@pytest.mark.parametrize("selected", [["a"], ["a", "b"], ["c", "d", "e f"]])
@pytest.mark.parametrize("unknown", [False, True])
def test_set_logic(spark, cells, mode, selected, unknown):
    df = spark.createDataFrame(list(enumerate(cells)), "id int, tags array<string>")
    spec = fa.Spec((fa.Multi("tags", tuple(selected), mode, unknown),))
    got = {r.id for r in df.where(fa.predicate(spec, df.schema)).collect()}
    want = {i for i, c in enumerate(cells) if model_multi(clean(c), selected, mode) or (unknown and not c)}
    assert got == want


@pytest.mark.parametrize("mode", fa.MODES)
@pytest.mark.parametrize("selected", [["a"], ["a", "b"], ["a", ""]])
def test_plain_strings(spark, mode, selected):
    values = ["a", "b", "c", "", None]
    df = spark.createDataFrame(list(enumerate(values)), "id int, s string")
    got = {r.id for r in df.where(fa.predicate(fa.Spec((fa.Multi("s", tuple(selected), mode),)), df.schema)).collect()}
    assert got == {i for i, v in enumerate(values) if model_multi([v] if v else [], selected, mode)}


@pytest.mark.parametrize(("yes", "no", "mode"), [(("a",), (), "all"), (("a",), ("b",), "all"), (("a", "c"), ("d",), "any"), ((), ("a", "b"), "any"), ((), (), "any")])
def test_yes_no(spark, cells, yes, no, mode):
    df = spark.createDataFrame(list(enumerate(cells)), "id int, tags array<string>")
    got = {r.id for r in df.where(fa.predicate(fa.Spec((fa.YesNo("tags", yes, no, mode),)), df.schema)).collect()}
    fold = all if mode == "all" else any
    want = {i for i, c in enumerate(cells) if not (yes or no) or fold([y in clean(c) for y in yes] + [n not in clean(c) for n in no])}
    assert got == want


def test_ranges(spark):
    rows = [(0, None, None), (1, 5.0, []), (2, 10.0, ["3", "x"]), (3, 10.5, ["10", "11"]), (4, -1.0, [None, "9.99"])]
    df = spark.createDataFrame(rows, "id int, n double, xs array<string>")
    ids = lambda f: {r.id for r in df.where(fa.predicate(fa.Spec((f,)), df.schema)).collect()}
    assert ids(fa.Range("n", 5, 10)) == {1, 2}
    assert ids(fa.Range("n", None, 5, True)) == {0, 1, 4}
    assert ids(fa.Range("xs", 9, 10)) == {3, 4}
    assert ids(fa.Range("xs", 9, 10, True)) == {0, 1, 3, 4}
    assert ids(fa.Range("n")) == {0, 1, 2, 3, 4}
    assert ids(fa.Range("gone", 1, 2)) == {0, 1, 2, 3, 4}


def fuzzy(text: str, word: str) -> bool:
    extra = len(word) // 4
    if word in text:
        return True
    if not extra:
        return False
    for i in range(len(text)):
        window, at = text[i : i + len(word) + extra], 0
        if not window.startswith(word[0]):
            continue
        for ch in window:
            if at < len(word) and ch == word[at]:
                at += 1
        if at == len(word):
            return True
    return False


def test_fuzzy_words(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcd ", k=rng.randint(0, 30))) for _ in range(150)] + ["a.b(c", "", "abxcd"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for word in ("ab", "abc", "abcd", "dcba", "abcdabcd", "a.b("):
        got = [r.hit for r in df.select(fa.fuzzy(F.col("t"), word).alias("hit")).collect()]
        assert got == [fuzzy(t, word) for t in texts], word


FACETS = [fa.Facet("tags"), fa.Facet("extras", "boolean", ("all", "any")), fa.Facet("n", "range", low=0, high=100, sortable=True)]
NAMES = st.text(st.sampled_from("abcXYZ 0129,&=%+é/"), min_size=1, max_size=6).filter(lambda s: s.strip() == s and s not in ("_", "?", "inc", "dec", *fa.MODES))


@settings(max_examples=200, deadline=None)
@given(
    st.lists(NAMES, max_size=3, unique=True),
    st.sampled_from(fa.MODES),
    st.booleans(),
    st.lists(NAMES, max_size=2, unique=True),
    st.sampled_from(["all", "any"]),
    st.one_of(st.none(), st.integers(1, 50)),
    st.one_of(st.none(), st.integers(51, 99)),
    st.sampled_from([None, "n"]),
    st.booleans(),
)
def test_url_round_trip(selected, mode, unknown, no, logic, low, high, sort, descending):
    filters = []
    if selected:
        filters.append(fa.Multi("tags", tuple(selected), mode, unknown))
    if no:
        filters.append(fa.YesNo("extras", (), tuple(no), logic))
    if low is not None or high is not None:
        filters.append(fa.Range("n", low, high))
    spec = fa.Spec(tuple(filters), sort, descending if sort else True, "two words")
    assert parse(serialise(spec, FACETS), FACETS) == spec


def test_sorting_is_total_and_reversible(spark):
    rows = [(i, v) for i, v in enumerate([3.0, None, 1.0, 3.0, None, 2.0])]
    df = spark.createDataFrame(rows, "id int, n double")
    down = [r.id for r in fa.query(df, fa.Spec(sort="n"), "id").collect()]
    up = [r.id for r in fa.query(df, fa.Spec(sort="n", descending=False), "id").collect()]
    assert down == [0, 3, 5, 2, 1, 4]
    assert up == down[::-1]


def test_option_inversion():
    assert fa.inverted(fa.Multi("c", ("b",))) == fa.Multi("c", ("b",), "none")
