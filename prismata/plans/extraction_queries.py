"""Extraction from the whole texts of ``documents`` and ``pages``; the SQL runs the same tables of patterns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as ur
from ..operators import extraction as ex
from ..operators import positions as po
from ..operators import specs
from ..operators import vocabulary as vo
from ..sources.shared import shared_dir
from .registry import query, table


def _q(s: str) -> str:
    return s.replace("'", "''")


def _values(text: str, field: ex.Field) -> str:
    lists = ", ".join(f"list_transform(regexp_extract_all({text}, '{_q(p)}', 1), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE) * {k!r}::DOUBLE)" for p, k in field.patterns)
    return f"list_filter(flatten([{lists}]), lambda v: v BETWEEN {field.low} AND {field.high})"


def _shown(text: str, name: str) -> str:
    field = ex.FIELDS[name]
    v = _values(text, field)
    if field.pick == "all":
        return f"array_to_string(list_transform(list_reverse_sort(list_distinct({v})), lambda x: CAST(round(x * 100) AS BIGINT)), ',')"
    return f"CAST(round(({'list_max' if field.pick == 'max' else 'list_first'}({v})) * 100) AS BIGINT)"


def _column(text: str, name: str):
    v = ex.extract(F.col(text), name, F.col("low"))
    cents = lambda x: F.round(x * 100).cast("long")
    return (F.array_join(F.transform(v, lambda x: cents(x).cast("string")), ",") if ex.FIELDS[name].pick == "all" else cents(v)).alias(name)


def _with_low(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("low", F.lower(text))


def _terms(text: str, name: str) -> str:
    hits = ", ".join(f"CASE WHEN regexp_matches(lower({text}), '{_q(tx.word_pattern(t.replace('-', chr(92) + '-')))}') THEN '{t}' END" for t in ex.TERMS[name])
    return f"array_to_string(list_filter([{hits}], lambda x: x IS NOT NULL), ',')"


_LIGHT = ("lumens", "candela", "throw_m", "cri", "cct")
_BODY = ("length_mm", "bezel_mm", "body_mm", "weight_g", "runtime_h", "price", "year", "version")


@query("text_light_fields", "SELECT doc_id, " + ", ".join(f"{_shown('text', n)} AS {n}" for n in _LIGHT) + " FROM documents")
def text_light_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output, intensity, distance and colour figures of every whole text, in hundredths."""
    return _with_low(table(spark, sf_dir, "documents")).select("doc_id", *[_column("text", n) for n in _LIGHT])


@query("text_body_fields", "SELECT doc_id, " + ", ".join(f"{_shown('text', n)} AS {n}" for n in _BODY) + " FROM documents")
def text_body_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, weights, runtimes, prices, years and versions of every whole text, in hundredths."""
    return _with_low(table(spark, sf_dir, "documents")).select("doc_id", *[_column("text", n) for n in _BODY])


@query("text_terms", "SELECT doc_id, " + ", ".join(f"{_terms('text', n)} AS {n}" for n in ex.TERMS) + " FROM documents")
def text_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, materials, switches, features, charging and blink modes that every whole text names."""
    return _with_low(table(spark, sf_dir, "documents")).select("doc_id", *[F.array_join(ex.terms(F.col("low"), n), ",").alias(n) for n in ex.TERMS])


@query("page_fields", "SELECT page_id, " + ", ".join(f"{_shown('html', n)} AS {n}" for n in ("lumens", "price", "year", "weight_g")) + " FROM pages")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of whole landed pages, markup included."""
    return _with_low(table(spark, sf_dir, "pages"), "html").select("page_id", *[_column("html", n) for n in ("lumens", "price", "year", "weight_g")])


@query("title_fields", "SELECT doc_id, " + ", ".join(f"{_shown('title', n)} AS {n}" for n in ex.TITLE_FIELDS) + " FROM (SELECT doc_id, string_split(text, chr(10))[1] AS title FROM documents)")
def title_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that titles tell, from the first line of every text."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("title"))
    return _with_low(t, "title").select("doc_id", *[_column("title", n) for n in ex.TITLE_FIELDS])


_TURNS = "(SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY 1)"


@query("segment_fields", "SELECT conv_id, " + ", ".join(f"{_shown('text', n)} AS {n}" for n in ("lumens", "runtime_h", "weight_g", "year")) + f" FROM {_TURNS} t")
def segment_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a thread, its posts joined in order."""
    posts = F.array_sort(F.collect_list(F.struct("turn", "text")))  # the posts of one thread
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(posts, lambda p: p["text"]), "\n").alias("text"))
    return _with_low(t).select("conv_id", *[_column("text", n) for n in ("lumens", "runtime_h", "weight_g", "year")])


@query("mined_missing", f"SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN 2000.0::DOUBLE END, list_max({_values('d.text', ex.FIELDS['year'])})) AS year FROM documents d")
def mined_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field is read from the text only where it is missing."""
    d = table(spark, sf_dir, "documents").withColumn("year", F.when(F.col("doc_id") % 2 == 0, F.lit(2000.0)))
    return ex.mined(d, "text", {"year": "year"}).select("doc_id", "year")


_WORDS = "list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains(lower(p_name), '{k}') THEN '{v}' END" for k, v in ex.COLOUR_WORDS) + "], lambda x: x IS NOT NULL))"


@query("model_colours", f"SELECT p_partkey AS id, array_to_string(list_sort({_WORDS}), ',') AS colours FROM part")
def model_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.array_join(F.array_sort(ex.model_colours(F.col("p_name"))), ",").alias("colours"))


_ANCHOR = "'(?i)<a\\s[^<>]*href=\"([^\"<>]+)\"[^<>]*>([^<]+)</a>'"


@query(
    "html_table_pairs",
    f"SELECT page_id, label, arg_min(value, i) AS value FROM (SELECT page_id, unnest(list_transform(regexp_extract_all(html, {_ANCHOR}, 2), lambda x: trim(x))) AS label, unnest(regexp_extract_all(html, {_ANCHOR}, 1)) AS value, generate_subscripts(regexp_extract_all(html, {_ANCHOR}, 1), 1) AS i FROM pages) WHERE label <> '' GROUP BY 1, 2",
)
def html_table_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and targets of every page's links; the first of a label wins."""
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(ur.anchors(F.col("html"))).alias("pos", "a"))
    return p.groupBy("page_id", "a.label").agg(F.min_by("a.target", "pos").alias("value"))


_NUMBER = "([0-9]{1,3}(?:,[0-9]{3})+(?:\\.[0-9]+)?|[0-9]+(?:\\.[0-9]+)?)"
_TRIES = ['(?i)itemprop="price"[^>]*content="([0-9.,]+)"', '(?i)"price"\\s*:\\s*"?([0-9.,]+)"?', "[$€£]\\s?([0-9][0-9,]*\\.?[0-9]*)"]
_PRICE = "coalesce(" + ", ".join(f"CASE WHEN TRY_CAST(replace(regexp_extract({{0}}, '{t}', 1), ',', '') AS DOUBLE) BETWEEN 5 AND 5000 THEN TRY_CAST(replace(regexp_extract({{0}}, '{t}', 1), ',', '') AS DOUBLE) END" for t in _TRIES) + ")"


@query("html_price", f"SELECT page_id AS id, {_PRICE.replace('{0}', 'html')} AS price FROM pages UNION ALL SELECT -doc_id - 1, {_PRICE.replace('{0}', 'text')} FROM documents")
def html_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of every page and every text by preference: structured, linked data, first amount."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), specs.price(F.col("html")).alias("price"))
    d = table(spark, sf_dir, "documents").select((-F.col("doc_id") - 1).alias("id"), specs.price(F.col("text")).alias("price"))
    return p.unionByName(d)


#: Lines that begin and end the part that is read, and lines left out; fixed by the texts themselves.
_START, _STOP, _SKIP = "^(The|Die|La|Que|De) ", "[?!]$|^(Of|Und|Et) ", "(?i)licen[sc]e|copyright"
_AT = f"list_position(list_transform(lines, lambda x: regexp_matches(x, '{_START}')), true)"


@query(
    "boilerplate_strip",
    f"""WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
    b AS (SELECT doc_id, coalesce({_AT}, 0) AS pos, CASE WHEN coalesce({_AT}, 0) > 0 THEN lines[coalesce({_AT}, 0) + 1 :] ELSE lines END AS rest FROM a),
    c AS (SELECT *, CASE WHEN pos > 0 THEN coalesce(list_position(list_transform(rest, lambda x: regexp_matches(x, '{_STOP}')), true), 0) ELSE 0 END AS stop FROM b),
    d AS (SELECT doc_id, list_transform(list_filter(CASE WHEN stop > 0 THEN rest[1 : stop - 1] ELSE rest END, lambda x: NOT regexp_matches(x, '{_SKIP}')), lambda x: CASE WHEN trim(x) = '' THEN '' ELSE x END) AS kept FROM c)
    SELECT doc_id, regexp_replace(regexp_replace(coalesce(array_to_string(kept, chr(10)), ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\A\\n+|\\n+\\z', '', 'g') AS body FROM d""",
)
def boilerplate_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of every text behind its start line, up to its stop line, without licence lines."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.after_anchor(F.col("text"), _START, _STOP, _SKIP).alias("body"))


def _vocabulary(column: str, rules: vo.Rules) -> str:
    """The SQL of ``vo.normalise`` for rules without captured groups."""
    low = f"lower(trim({column}))"
    out = (low if rules.lower else f"trim({column})") if rules.keep_unknown else "NULL"
    if rules.longest is not None:
        out = f"CASE WHEN length({low}) <= {rules.longest} THEN {out} END"
    for pattern, new in reversed(rules.patterns):
        put = "NULL" if new is None else (f"regexp_extract({low}, '{_q(pattern)}', 1)" if "$" in new else f"'{new}'")
        out = f"CASE WHEN regexp_matches({low}, '{_q(pattern)}') THEN {put} ELSE {out} END"
    for k, v in rules.exact.items():
        out = f"CASE WHEN {low} = '{_q(k)}' THEN {'NULL' if v is None else chr(39) + _q(v) + chr(39)} ELSE {out} END"
    return f"CASE WHEN {low} IN ('', 'unknown') THEN NULL ELSE {out} END"


_TERMS_N = "(SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+', 0)) AS term FROM documents) GROUP BY 1 HAVING count(*) > 2)"


def _terms_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lower-cased term of all texts that occurs more than twice."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n > 2")


def _vocabulary_query(name: str, how):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _terms_n(spark, sf_dir).select("term", how(F.col("term")).alias(name), "n")

    return run


for _name, _rules in (("material", vo.MATERIAL), ("switch", vo.SWITCH), ("feature", vo.FEATURES)):
    query(f"normalise_{_name}", f"SELECT term, {_vocabulary('term', _rules)} AS {_name}, n FROM {_TERMS_N}")(_vocabulary_query(_name, lambda c, rules=_rules: vo.normalise(c, rules)))


def _map(table_: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{_q(k)}': '{_q(v)}'" for k, v in table_.items()) + "}"


def _listed(words) -> str:
    return "(" + ", ".join(f"'{_q(w)}'" for w in words) + ")"


def _battery_sql(source: str = _TERMS_N) -> str:
    out = f"CASE WHEN length(term) > {vo.LONGEST_POWER} THEN 'built-in' ELSE term END"
    first = lambda test: f"list_filter(words, lambda w: {test})[1]"
    size, number = first(f"w IN {_listed(vo.CELLS)}"), first("regexp_matches(w, '^[0-9]')")
    for shape, name in reversed(vo.POWER_SHAPES):
        new = "NULL" if name is None else "'" + name.replace("{size}", f"' || {size} || '").replace("{number}", f"' || {number} || '") + "'"
        out = f"CASE WHEN regexp_matches(kinds, '{shape}') THEN {new} ELSE {out} END"
    words = f"SELECT term, n, regexp_extract_all(replace(lower(term), ',', ''), '{vo.POWER_WORD}') AS words FROM {source}"
    kinds = f"SELECT *, ' ' || array_to_string(list_transform(words, lambda w: coalesce({_map(vo.POWER_WORDS)}[w], CASE WHEN regexp_matches(w, '^[0-9]') THEN '#' ELSE '?' END)), ' ') || ' ' AS kinds FROM ({words})"
    return f"SELECT term, CASE WHEN term NOT IN {_listed(vo.NO_VALUE)} THEN {out} END AS battery, n FROM ({kinds})"


query("normalise_battery", _battery_sql())(_vocabulary_query("battery", vo.battery))


def _led_sql(source: str = _TERMS_N) -> str:
    """The SQL of ``vo.emitter`` for one term without blanks, hyphens and makers."""
    out = "CASE WHEN NOT told OR compact IN " + _listed(vo.BARE) + " THEN NULL ELSE term END"
    for pattern, maker, parts in reversed(vo.FAMILIES):
        group = lambda x: f"upper(regexp_extract(compact, '^(?:{pattern})$', {x[-1]}))"  # noqa: B023, E731
        texts = [f"CASE WHEN {group(x)} <> '' THEN '{x[:-2]}' || {group(x)} ELSE '' END" if "$" in x else f"'{x}'" for x in parts]
        out = f"CASE WHEN regexp_matches(compact, '^(?:{pattern})$') THEN '{maker + ' ' if maker else ''}' || {' || '.join(texts)} ELSE {out} END"
    raw = f"SELECT term, n, regexp_extract(term, '{vo.COUNTED}', 1) AS dies, regexp_replace(term, '{vo.COUNTED}', '') AS compact FROM {source} WHERE term NOT IN {_listed([*vo.MAKERS, 'ii'])}"
    told = f"SELECT *, compact NOT IN {_listed(vo.TELLS_NOTHING)} AND NOT regexp_matches(compact, '^(?:{vo.MEASURE})$') AS told FROM (SELECT term, n, dies, compact FROM ({raw}))"
    return f"SELECT term, CASE WHEN dies <> '' THEN dies || 'x ' ELSE '' END || {out.replace('ELSE term END', 'ELSE compact END')} AS led, n FROM ({told})"


@query("normalise_led", _led_sql())
def normalise_led(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent term of the texts as an emitter would be read."""
    return _terms_n(spark, sf_dir).where(~F.col("term").isin(*vo.MAKERS, "ii")).select("term", vo.emitter(F.col("term")).alias("led"), "n")


_CELLS_OF = {"battery": "string_split(p_name, ' ')", "material": "[p_type, 'alu', p_brand]", "switch": "[p_name, p_type]", "features": "string_split(p_name, ' ')", "led": "[p_size || 'x' || lower(p_type), lower(p_type)]"}
_RULES_OF = {"material": vo.MATERIAL, "switch": vo.SWITCH, "features": vo.FEATURES}


def _items(name: str) -> str:
    source = f"(SELECT unnest({_CELLS_OF[name]}) AS term, 1 AS n FROM part)"
    if name in _RULES_OF:
        return f"SELECT term, {_vocabulary('term', _RULES_OF[name])} AS v FROM {source}"
    return f"SELECT term, {name} AS v FROM ({(_battery_sql if name == 'battery' else _led_sql)(source)})"


@query("vocabulary_counts", " UNION ALL ".join(f"SELECT '{n}' AS vocabulary, count(*) AS items, count(*) FILTER (v IS NULL) AS dropped, count(*) FILTER (v <> term) AS changed FROM ({_items(n)})" for n in _CELLS_OF))
def vocabulary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vocabularies in one pass: the normalised table is written, and what each changed is observed meanwhile."""
    c = F.col
    p = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.split("p_name", " ").alias("battery"),
        F.array(c("p_type"), F.lit("alu"), c("p_brand")).alias("material"),
        F.array("p_name", "p_type").alias("switch"),
        F.split("p_name", " ").alias("features"),
        F.array(F.concat(c("p_size").cast("string"), F.lit("x"), F.lower("p_type")), F.lower("p_type")).alias("led"),
    )
    counts = vo.normalised_table(p, list(_CELLS_OF), f"{shared_dir(spark)}/normalised-{uuid.uuid4().hex}")
    one = lambda n: F.struct(F.lit(n).alias("vocabulary"), *[F.lit(v).cast("long").alias(k) for k, v in zip(("items", "dropped", "changed"), counts[n], strict=True)])
    return spark.range(1).select(F.explode(F.array(*[one(n) for n in _CELLS_OF])).alias("r")).select("r.*")  # one row for each vocabulary


@query(
    "normalise_cells",
    f"""WITH i AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS term, 1 AS n FROM part), d AS (SELECT DISTINCT term, n FROM i), m AS ({_battery_sql('d')})
    SELECT p_partkey AS id, coalesce(string_agg(DISTINCT battery, ',' ORDER BY battery), '') AS battery FROM (SELECT p_partkey, battery FROM i JOIN m USING (term)) GROUP BY 1""",
)
def normalise_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of several values: dropped, normalised, each once and in order."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("cell"))
    return vo.once_each(p, "cell", vo.NORMALISERS["battery"], "items").select("id", F.array_join("items", ",").alias("battery"))


_SIZES = f"(?i){_NUMBER}\\s*(mm|cm|in)\\b"


@query(
    "extract_units",
    f"SELECT doc_id, round(list_max(list_filter(list_transform(list_zip(regexp_extract_all(text, '{_SIZES}', 1), regexp_extract_all(text, '{_SIZES}', 2)), lambda z: TRY_CAST(replace(z[1], ',', '') AS DOUBLE) * CASE lower(z[2]) WHEN 'mm' THEN 1.0::DOUBLE WHEN 'cm' THEN 10.0::DOUBLE ELSE 25.4::DOUBLE END), lambda v: v BETWEEN 15 AND 800)), 6) AS mm FROM documents",
)
def extract_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest plausible measure of every whole text, each converted by the unit captured beside it."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(specs.length_mm(F.col("text")), 6).alias("mm"))


_WEIGHTS = f"(?i){_NUMBER}\\s*(g|kg|oz|lb)\\b"


@query(
    "spec_extraction",
    f"""SELECT doc_id, array_to_string(list_transform(list_reverse_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '(?i){_NUMBER}\\s*(?:lumens?|lm)\\b', 1), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda v: v > 0.1 AND v < 200000))), lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',') AS lumens,
        round(list_first(list_filter(list_transform(list_zip(regexp_extract_all(text, '{_WEIGHTS}', 1), regexp_extract_all(text, '{_WEIGHTS}', 2)), lambda z: TRY_CAST(replace(z[1], ',', '') AS DOUBLE) * CASE lower(z[2]) WHEN 'g' THEN 1.0::DOUBLE WHEN 'kg' THEN 1000.0::DOUBLE WHEN 'oz' THEN 28.3495::DOUBLE ELSE 453.592::DOUBLE END), lambda v: v BETWEEN 5 AND 5000)), 6) AS weight_g,
        nullif(upper(regexp_extract(text, '(?i)\\b(IP[X0-9][0-9])\\b', 1)), '') AS ip FROM documents""",
)
def spec_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs, the first weight and the protection class of every whole text."""
    d = table(spark, sf_dir, "documents")
    lumens = F.array_join(F.transform(specs.lumens(F.col("text")), lambda v: v.cast("long").cast("string")), ",")
    return d.select("doc_id", lumens.alias("lumens"), F.round(specs.weight_g(F.col("text")), 6).alias("weight_g"), specs.ip_rating(F.col("text")).alias("ip"))


def _shown_fields() -> list:
    cents = lambda x: F.round(x * 100).cast("long")
    return [(F.array_join(F.transform(n, lambda x: cents(x).cast("string")), ",") if s.pick == "all" else cents(F.col(n))).alias(n) for n, s in po.SPOTS.items()]


def _positions_sql(source: str) -> str:
    """The SQL of ``po.fields`` over a table of (key, text)."""
    p, map_of = _q(po.PATTERN), lambda t: "MAP {" + ", ".join(f"'{_q(k)}': {v!r}" for k, v in t.items()) + "}"
    can = " OR ".join(f"(near = '{n}' AND unit IN {_listed([*s.own, *s.after_label])})" for n, s in po.SPOTS.items())
    good = " OR ".join(f"(field = '{n}' AND value BETWEEN {s.low} AND {s.high})" for n, s in po.SPOTS.items())
    cents = lambda x: f"CAST(round({x} * 100) AS BIGINT)"
    out = []
    for n, s in po.SPOTS.items():
        if s.pick == "all":
            out.append(f"coalesce(array_to_string(list_transform(list_reverse_sort(list(DISTINCT value) FILTER (field = '{n}')), lambda x: {cents('x')}), ','), '') AS {n}")
        elif s.pick == "first":
            out.append(f"{cents(f"arg_min(value, i) FILTER (field = '{n}')")} AS {n}")
        elif n == "length_mm":
            out.append(f"CASE WHEN max(cell) IS NULL OR max(value) FILTER (field = '{n}') >= max(cell) THEN {cents(f"max(value) FILTER (field = '{n}')")} END AS {n}")
        else:
            out.append(f"{cents(f"max(value) FILTER (field = '{n}')")} AS {n}")
    return f"""WITH t AS ({source}),
    a AS (SELECT key, list_transform(regexp_extract_all(text, '{p}'), lambda x: lower(x)) AS w, list_transform(regexp_split_to_array(text, '{p}'), lambda x: length(x)) AS g FROM t),
    b AS (SELECT key, unnest(w) AS word, unnest(g[1:len(w)]) AS gap, unnest(range(len(w))) AS i FROM a),
    c AS (SELECT *, sum(gap + length(word)) OVER (PARTITION BY key ORDER BY i) AS stop, {map_of(po.LABELS)}[word] AS label FROM b),
    d AS (SELECT *, last_value(CASE WHEN label IS NOT NULL THEN {{'f': label, 'at': stop}} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, regexp_matches(word, '^{po.CLOCK}$') AS clock FROM c),
    e AS (SELECT key, i, word, CASE WHEN clock THEN 'clock' ELSE trim(regexp_replace(word, '^{po.NUMBER}', '')) END AS unit, CASE WHEN stop - length(word) - before.at <= {po.REACH} THEN before.f END AS near,
        CASE WHEN clock THEN CAST(regexp_extract_all(word, '[0-9]+')[1] AS DOUBLE) + CAST(regexp_extract_all(word, '[0-9]+')[2] AS DOUBLE) / 60 ELSE TRY_CAST(replace(regexp_extract(word, '{po.NUMBER}'), ',', '') AS DOUBLE) END AS number FROM d WHERE label IS NULL),
    f AS (SELECT key, i, coalesce(CASE WHEN {can} THEN near END, {map_of(po.OWN)}[unit]) AS field, number * coalesce({map_of(po.WORTH)}[unit]::DOUBLE, 1) AS value, {map_of(ex.CELL_MM)}[word]::DOUBLE AS cell FROM e),
    g AS (SELECT * REPLACE (CASE WHEN {good} THEN field END AS field) FROM f WHERE {good} OR cell IS NOT NULL)
    SELECT key, {", ".join(out)} FROM g GROUP BY key HAVING count(field) > 0"""


@query("position_fields", _positions_sql("SELECT doc_id AS key, text FROM documents"))
def position_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen fields of every whole text, each value with its nearest label, in hundredths."""
    return po.fields(table(spark, sf_dir, "documents"), "doc_id", "text").select("key", *_shown_fields())


@query("thread_position_fields", _positions_sql(f"SELECT conv_id AS key, text FROM {_TURNS}"))
def thread_position_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of threads, their posts joined in order, so that a label may stand in the post before."""
    posts = F.array_sort(F.collect_list(F.struct("turn", "text")))  # the posts of one thread
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(posts, lambda p: p["text"]), "\n").alias("text"))
    return po.fields(t, "conv_id", "text").select("key", *_shown_fields())
