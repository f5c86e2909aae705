"""Tables and lists of pages as rows: grids with spans, header rows as keys, mode tables unpivoted.

Everything is native and linear in the page.  A page is cut before each tag that
opens or closes a block (table, list, definition list); running sums over the
cuts give each piece its depth and its block, so a block inside a cell is a
block of its own and what follows it belongs to the outer one again.  Blocks are
cut into rows and rows into cells.  A cell that spans columns fills all of them;
one that spans rows is carried into the rows below, whose own cells take the
columns that are left free.

Defined cases: a page without blocks or a null page gives no rows; blocks and
cells that are never closed run to the next cut; comments, scripts and styles
are left out; an empty cell keeps its place; spans are held to 1,000 columns and
65,534 rows as browsers do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import decoded, without_elements
from .extraction import FIELDS, values

BLOCK = r"(?i)(?=</?(?:table|ul|ol|dl)\b)"
TAG = r"(?i)^<(/?)(table|ul|ol|dl)\b[^<>]*>?"
ROW = {"table": r"(?i)<tr\b", "dl": r"(?i)<dt\b", "list": r"(?i)<li\b"}
CELL_END = r"(?i)</(?:t[hdr]|thead|tbody|tfoot|li|d[td])\b"
MOST_COLUMNS, MOST_ROWS = 1000, 65534


def blocks(pages: DataFrame, page: str, html: str) -> DataFrame:
    """page, block (0, 1, ... in page order), kind (table, dl, list) and the block's own markup."""
    pieces = F.split(without_elements(F.col(html), ["script", "style"]), BLOCK)
    t = pages.select(F.col(page).alias("page"), F.posexplode(pieces).alias("pos", "piece"))
    t = t.select("page", "pos", "piece", F.regexp_extract("piece", TAG, 1).alias("shut"), F.lower(F.regexp_extract("piece", TAG, 2)).alias("tag")).where("tag <> ''")
    t = t.withColumn("body", F.regexp_replace("piece", TAG, "")).drop("piece")
    so_far = Window.partitionBy("page").orderBy("pos")
    t = t.withColumn("level", F.sum(F.when(F.col("shut") == "", 1).otherwise(-1)).over(so_far))
    # an end tag without a start takes nothing away
    t = t.withColumn("depth", F.col("level") - F.least(F.lit(0), F.min("level").over(so_far)))
    t = t.withColumn("ordinal", F.sum(F.when(F.col("shut") == "", 1).otherwise(0)).over(Window.partitionBy("page", "depth").orderBy("pos"))).where("depth > 0")
    own = t.groupBy("page", "depth", "ordinal").agg(F.min("pos").alias("first"), F.min_by("tag", "pos").alias("tag"), F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("parts"))
    number = (F.row_number().over(Window.partitionBy("page").orderBy("first")) - 1).cast("long")
    kind = F.when(F.col("tag").isin("ul", "ol"), F.lit("list")).otherwise(F.col("tag"))
    return own.select("page", number.alias("block"), kind.alias("kind"), F.array_join(F.transform("parts", lambda p: p.body), " ").alias("markup"))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` worked out once: inside lambdas Spark works out an expression wherever it stands."""
    return F.get(F.transform(F.array(x), f), 0)


def _read(found: Column) -> Column:
    """Cells with their markup turned into text; each step is a pass of its own, so that nothing is worked out twice."""
    bare = F.transform(found, lambda c: F.struct(c.head, c.wide, c.left, F.regexp_replace(c.text, "<[^<>]*>", " ").alias("text")))
    plain = lambda x: F.when(F.contains(x, F.lit("&")), decoded(x)).otherwise(x)
    return F.transform(bare, lambda c: F.struct(c.head, c.wide, c.left, F.trim(F.regexp_replace(plain(c.text), r"\s+", " ")).alias("text")))


def _span(attributes: Column, name: str, most: int) -> Column:
    digits = F.regexp_extract(attributes, rf"(?i)\b{name}\s*=\s*[\"']?([0-9]{{1,6}})", 1)
    # told by its text first: a failed cast costs an exception for each cell
    span = lambda d: F.when(d == "", F.lit(1)).when(d.rlike("^0+$"), F.lit(most)).otherwise(F.least(d.cast("int"), F.lit(most)))  # noqa: E731  (0: to the end)
    return F.when(attributes.rlike("(?i)span"), _let(digits, span)).otherwise(F.lit(1))


def _cells(raws: Column) -> Column:
    """(head, wide, left, text) of each cell's markup, which begins behind its ``<``; the text is still markup."""
    opened = F.transform(raws, lambda raw: F.struct(raw.alias("raw"), F.regexp_extract(raw, r"^[^<>]*", 0).alias("opened")))
    inner = lambda c: F.get(F.split(F.substr(c.raw, F.length(c.opened) + 2), CELL_END, 2), F.lit(0))
    return F.transform(opened, lambda c: F.struct(c.opened.rlike("(?i)^th").alias("head"), _span(c.opened, "colspan", MOST_COLUMNS).alias("wide"), _span(c.opened, "rowspan", MOST_ROWS).alias("left"), inner(c).alias("text")))


def _item(raw: Column) -> Column:
    """Cells of a list item: its bold beginning, if there is one, and the rest."""
    start = r"(?is)^\s*<(?:b|strong)\b[^<>]*>"
    one = lambda x: F.struct(F.lit(False).alias("head"), F.lit(1).alias("wide"), F.lit(1).alias("left"), x.alias("text"))

    def of(inner: Column) -> Column:
        bold = F.regexp_extract(inner, start + r"([^<]*)</(?:b|strong)>", 1)
        rest = F.regexp_replace(inner, start + r"[^<]*</(?:b|strong)>\s*:?", "")
        return F.when(bold != "", F.array(one(bold), one(rest))).otherwise(F.array(one(inner)))

    return _let(F.get(F.split(F.regexp_replace(raw, r"^[^<>]*>", ""), CELL_END, 2), F.lit(0)), of)


GRID = "array<struct<row:int,column:int,head:boolean,text:string>>"


def _grid(rows: Column) -> Column:
    """For each row every cell at every place it fills; ``rows`` is an array of arrays of cells."""
    carried = "array<struct<column:int,head:boolean,text:string,left:int>>"
    zero = F.struct(F.lit(0).alias("row"), F.array().cast(carried).alias("carry"), F.array().cast(f"array<{GRID}>").alias("out"))
    spread = lambda row: F.flatten(F.transform(row, lambda c: F.array_repeat(c, c.wide)))

    def step(acc: Column, row: Column) -> Column:
        def placed(x: Column) -> Column:
            free = F.array_except(F.sequence(F.lit(0), F.size(x.units) + F.size(x.taken)), x.taken)
            own = F.zip_with(F.slice(free, 1, F.size(x.units)), x.units, lambda c, u: F.struct(c.alias("column"), u.head.alias("head"), u.text.alias("text"), u.left.alias("left")))
            return F.concat(own, acc.carry)

        def kept(full: Column) -> Column:
            here = F.transform(full, lambda c: F.struct(acc.row.alias("row"), c.column, c.head, c.text))
            below = F.transform(F.filter(full, lambda c: c.left > 1), lambda c: F.struct(c.column, c.head, c.text, (c.left - 1).alias("left")))
            return F.struct((acc.row + 1).alias("row"), below.cast(carried).alias("carry"), F.concat(acc.out, F.array(here.cast(GRID))).alias("out"))

        return _let(_let(F.struct(spread(row).alias("units"), F.transform(acc.carry, lambda c: c.column).alias("taken")), placed), kept)

    plain = F.transform(rows, lambda row, i: F.transform(spread(row), lambda u, j: F.struct(i.alias("row"), j.alias("column"), u.head.alias("head"), u.text.alias("text"))))
    spans = F.exists(rows, lambda row: F.exists(row, lambda c: c.left > 1))
    return F.when(spans, F.aggregate(rows, zero, step, lambda acc: acc.out)).otherwise(plain.cast(f"array<{GRID}>"))


def _laid_out(pages: DataFrame, page: str, html: str) -> DataFrame:
    """page, block, kind and ``rows``: for each row of the block's grid the cells in it; no row is empty."""
    b = blocks(pages, page, html)
    later = lambda parts: F.filter(parts, lambda x, i: i > 0)
    rows = F.when(F.col("kind") == "table", F.split("markup", ROW["table"])).when(F.col("kind") == "dl", F.split("markup", ROW["dl"])).otherwise(F.split("markup", ROW["list"]))
    b = b.select("page", "block", "kind", later(rows).alias("rows"))
    of_row = lambda row: _cells(later(F.split(row, r"(?i)<(?=t[hd]\b)")))
    of_term = lambda row: _cells(later(F.split(F.concat(F.lit("<dt"), row), r"(?i)<(?=d[td]\b)")))
    found = F.when(F.col("kind") == "table", F.transform("rows", of_row)).when(F.col("kind") == "dl", F.transform("rows", of_term)).otherwise(F.transform("rows", _item))
    b = b.select("page", "block", "kind", F.filter(F.transform(found, _read), lambda r: F.size(r) > 0).alias("cells"))
    return b.select("page", "block", "kind", _grid(F.col("cells")).alias("rows"))


def grids(pages: DataFrame, page: str, html: str) -> DataFrame:
    """page, block, kind and the grid of each block; that of a block without cells is empty."""
    return _laid_out(pages, page, html).select("page", "block", "kind", F.flatten("rows").alias("grid"))


def cells(pages: DataFrame, page: str, html: str) -> DataFrame:
    """page, block, kind, row, column, head, text of each place of each grid."""
    g = grids(pages, page, html)
    # outer: a plain explode makes Spark test the grid below, once more for every step that builds it
    return g.select("page", "block", "kind", F.explode_outer("grid").alias("c")).where("c is not null").select("page", "block", "kind", "c.row", "c.column", "c.head", "c.text")


def key_of(label: Column) -> Column:
    """A label as a key: lower case, without a closing colon."""
    return F.trim(F.regexp_replace(F.lower(label), r"\s*:\s*$", ""))


def records(pages: DataFrame, page: str, html: str) -> DataFrame:
    """page, block, row, label, key, value: tables unpivoted to one row for each value.

    A table whose first row is all header cells, with rows below it, takes its
    keys from there and labels each row by its first cell.  In any other block
    of several columns the first cell of a row is the key of the others.  A
    block of one column has values only.
    """
    g = _laid_out(pages, page, html).withColumn("first", F.get("rows", 0))
    headed = (F.col("kind") == "table") & F.forall("first", lambda c: c.head) & (F.size("rows") > 1)
    # of several cells in one place, as overlapping spans make them, the first counts
    at = lambda cs: F.map_from_entries(F.transform(F.array_distinct(F.transform(cs, lambda c: c.column)), lambda k: F.struct(k, F.element_at(F.filter(cs, lambda c: c.column == k), 1).text)))
    g = g.select("page", "block", headed.alias("headed"), F.when(headed, at(F.col("first"))).alias("heads"), "rows")
    # outer, as in ``cells``; a row of the grid is a row of the table, so nothing is grouped
    row = g.select("page", "block", "headed", "heads", F.explode_outer("rows").alias("row")).withColumn("n", F.get("row", 0).row).where("n is not null and (not headed or n > 0)")
    cs = F.array_sort(F.transform("row", lambda c: F.struct(c.column, c.text)))
    row = row.select("page", "block", F.col("n").alias("row"), "headed", "heads", cs.alias("cs"))
    lead = F.get("cs", F.lit(0)).text
    one = row.withColumn("lead", lead).withColumn("single", F.size("cs") == 1)
    one = one.select("page", "block", "row", "headed", "heads", "lead", F.explode_outer(F.when(F.col("single"), F.col("cs")).otherwise(F.slice("cs", 2, F.greatest(F.size("cs"), F.lit(1))))).alias("c"), "single")
    key = F.when(F.col("headed"), F.try_element_at("heads", F.col("c.column"))).when(~F.col("single"), F.col("lead"))
    label = F.when(F.col("headed") & ~F.col("single"), F.col("lead"))
    return one.select("page", "block", "row", F.coalesce(label, F.lit("")).alias("label"), key_of(F.coalesce(key, F.lit(""))).alias("key"), F.col("c.text").alias("value"))


# fixed values: which labels of tables tell a field
LABELS = {
    "lumens": r"lumen|brightness|\boutput\b|luminous flux",
    "candela": r"candela|intensity",
    "throw_m": r"throw|beam distance|\brange\b",
    "runtime_h": r"run ?-?time",
    "length_mm": r"length",
    "weight_g": r"weight",
    "cct": r"\bcct\b|colou?r temp",
    "cri": r"\bcri\b",
}
#: The unit of a bare number, by field.
UNITS = {"lumens": "lumens", "candela": "cd", "throw_m": "m throw", "runtime_h": "hours", "length_mm": "mm long", "weight_g": "g", "cct": "K", "cri": "CRI"}


def field_value(key: Column, value: Column, name: str) -> Column:
    """The field's value in a table cell, for cells whose key tells the field; a bare number has the unit its key tells, or the field's."""
    field = FIELDS[name]
    told = F.regexp_extract(key, r"\(([a-z]{1,7})\)\s*$", 1)
    bare = value.rlike(r"^[0-9][0-9.,]*$")
    said = F.when(bare, F.concat_ws(" ", value, F.when(told != "", told).otherwise(F.lit(UNITS[name])))).otherwise(value)
    named = F.concat(F.lit({"throw_m": "throw ", "length_mm": "length ", "runtime_h": "runtime ", "cri": "cri "}.get(name, "")), said)
    return F.when(key.rlike(LABELS[name]), F.coalesce(F.get(values(said, field), 0), F.get(values(named, field), 0)))


def specs(records_: DataFrame) -> DataFrame:
    """page and a column for each field: the first value, in page order, of a row whose key tells it; rows of mode tables left out."""
    plain = records_.where("label = ''")
    place = F.struct("block", "row")
    found = [F.min_by(v, F.when(v.isNotNull(), place)).alias(n) for n in LABELS for v in [field_value(F.col("key"), F.col("value"), n)]]
    return plain.groupBy("page").agg(*found)


def modes(records_: DataFrame) -> DataFrame:
    """page, block, row, mode, lumens, candela, throw_m, runtime_h: the rows of tables with a header row that tell an output."""
    found = [F.max(field_value(F.col("key"), F.col("value"), n)).alias(n) for n in ("lumens", "candela", "throw_m", "runtime_h")]
    return records_.where("label <> ''").groupBy("page", "block", "row", F.col("label").alias("mode")).agg(*found).where("lumens is not null")
