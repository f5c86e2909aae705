"""Text, HTML, URLs and vocabularies on ``documents``, ``pages`` and ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as ur
from ..operators import records, specs
from ..operators import vocabulary as vo
from .registry import query, table

_STRIP = "html"
_STRIP = f"regexp_replace({_STRIP}, '(?s)<!--.*?(?:-->|\\z)', '', 'g')"
for _tag in tx.SILENT:
    _STRIP = f"regexp_replace({_STRIP}, '(?is)<{_tag}\\b[^<>]*>.*?(?:</{_tag}>|\\z)', '', 'g')"
_STRIP = f"regexp_replace({_STRIP}, '(?i)</(p|div|tr|li|h[1-6]|ul|ol|table|section|article)>|<br\\s*/?>', chr(10), 'g')"
_STRIP = f"regexp_replace({_STRIP}, '(?i)</t[dh]>', chr(9), 'g')"
_STRIP = f"regexp_replace({_STRIP}, '<[^<>]*>', '', 'g')"
for _name, _char in tx.ENTITIES:
    _STRIP = "replace({}, '{}', '{}')".format(_STRIP, _name, _char.replace("'", "''"))
_STRIP = f"regexp_replace(regexp_replace({_STRIP}, '[‘’]', '''', 'g'), '[“”]', '\"', 'g')"
_STRIP = f"regexp_replace({_STRIP}, '[ \\t]+', ' ', 'g')"
_STRIP = f"trim(regexp_replace({_STRIP}, ' ?\\n[ \\n]*', chr(10), 'g'))"


@query("html_to_text", f"SELECT page_id, {_STRIP} AS txt FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("txt"))


@query("html_links", "SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '(?i)<a\\s[^<>]*href=\"([^\"]+)\"', 1))), ' ') AS links FROM pages")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(ur.links(F.col("html"))), " ").alias("links"))


@query("html_title", "SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^<>]*>(.*?)(?:</title>|\\z)', 1), '\\s+', ' ', 'g')), '') AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ur.title(F.col("html")).alias("title"))


_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '')"


@query("url_host_class", f"SELECT page_id, {_HOST} AS host, CASE WHEN {_HOST} IN ('ththre.example.com', 'thther.example.org') THEN 'reviews' WHEN {_HOST} IN ('ththed.example.org') THEN 'retailers' ELSE 'manufacturers' END AS kind FROM pages")
def url_host_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    kind = ur.source_class(F.col("url"), {"reviews": ["ththre.example.com", "thther.example.org"], "retailers": ["ththed.example.org"]}, "manufacturers")
    return p.select("page_id", ur.host(F.col("url")).alias("host"), kind.alias("kind"))


@query("store_subdomain", f"SELECT page_id, {_HOST} = 'example.net' OR ends_with({_HOST}, '.example.net') OR {_HOST} = 'ththre.example.com' AS is_store FROM pages")
def store_subdomain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ur.in_domains(F.col("url"), ["example.net", "ththre.example.com"]).alias("is_store"))


@query("url_model_name", "SELECT page_id, array_to_string(list_transform(regexp_extract_all(lower(regexp_replace(list_extract(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '/'), -1), '[-_]+', ' ', 'g')), '[a-z0-9]+|[^a-z0-9]+'), lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), '') AS model FROM pages")
def url_model_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ur.last_path_words(F.col("url")).alias("model"))


@query("pages_by_host", f"SELECT {_HOST} AS host, count(*) AS n, min(page_id) AS first_id FROM pages GROUP BY 1")
def pages_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending pages of each domain, and the first of each."""
    p = table(spark, sf_dir, "pages")
    return p.groupBy(ur.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id"))


_NUM = "list_filter(list_transform(regexp_extract_all(text, '([0-9]+)', 1), lambda x: TRY_CAST(x AS DOUBLE)), lambda x: x > 0 AND x < 100000)"


@query("extract_numbers_desc", f"SELECT doc_id, array_to_string(list_transform(list_reverse_sort(list_distinct({_NUM})), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS numbers FROM documents")
def extract_numbers_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n = tx.numbers_desc(F.col("text"), "([0-9]+)", 0, 100000)
    return d.select("doc_id", F.array_join(F.transform(n, lambda x: x.cast("long").cast("string")), ",").alias("numbers"))


@query("keyword_detect", "SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])the($|[^\\p{L}\\p{N}_])') THEN 'the' END, CASE WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])die($|[^\\p{L}\\p{N}_])') THEN 'die' END, CASE WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])que($|[^\\p{L}\\p{N}_])') THEN 'que' END, CASE WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])license($|[^\\p{L}\\p{N}_])') THEN 'license' END], lambda x: x IS NOT NULL), ',') AS found FROM documents")
def keyword_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.keywords(F.col("text"), ["the", "die", "que", "license"]), ",").alias("found"))


@query("negative_context", "SELECT doc_id, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])license($|[^\\p{L}\\p{N}_])') AND NOT regexp_matches(lower(text), 'mit license') AS flagged FROM documents")
def negative_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.keyword_unless(F.col("text"), "license", "mit license").alias("flagged"))


@query("truncate_text", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '[...]' ELSE text END AS head FROM documents")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The display cut of long texts."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncated(F.col("text"), 200, "[...]").alias("head"))


@query("brand_alias_titlecase", "SELECT p_partkey AS id, CASE WHEN p_name = 'red plate' THEN 'Scarlet' WHEN p_name LIKE 'small ring' THEN 'Small-Ring' ELSE upper(substring(w1, 1, 1)) || substring(w1, 2) || ' ' || upper(substring(w2, 1, 1)) || substring(w2, 2) END AS brand FROM (SELECT *, string_split(p_name, ' ')[1] AS w1, string_split(p_name, ' ')[2] AS w2 FROM part)")
def brand_alias_titlecase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tx.alias_or_title(F.col("p_name"), {"red plate": "Scarlet"}, {"small ring": "Small-Ring"}).alias("brand"))


_COLOUR = "CASE " + " ".join(f"WHEN contains(lower(p_name), '{k}') THEN '{v}'" for k, v in vo.COLOURS) + " ELSE 'black' END"


@query("color_first_match", f"SELECT p_partkey AS id, {_COLOUR} AS color FROM part")
def color_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tx.first_key_in(F.col("p_name"), vo.COLOURS, "black").alias("color"))


_WORDS = vo.Rules(exact={"gizmo": "gadget", "old": None}, patterns=(("^(red|blue)$", "colour"), ("ring|rod", "$0")), longest=5)


@query(
    "normalise_vocab_counts",
    """SELECT count(DISTINCT w) AS "before", count(DISTINCT n) AS "after", count(*) FILTER (n IS NOT NULL AND n <> w) AS changed, count(*) FILTER (n = w) AS unchanged, count(*) FILTER (n IS NULL) AS dropped
    FROM (SELECT w, CASE WHEN w = 'old' THEN NULL WHEN w = 'gizmo' THEN 'gadget' WHEN w IN ('red', 'blue') THEN 'colour' WHEN w IN ('ring', 'rod') THEN w WHEN length(w) <= 5 THEN w END AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part))""",
)
def normalise_vocab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("words"))
    return vo.change_report(p, "words", _WORDS)


@query("spec_validation", "SELECT event_id, CASE WHEN k BETWEEN 10 AND 90 THEN k END AS k FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)")
def spec_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record keeps known keys with plausible values only."""
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(specs.validated(F.col("props"), {"k": (10, 90), "price": (0, 100)}), F.lit("k")).alias("k"))


_JSON = """CASE WHEN p_partkey % 7 = 0 THEN substring(r, 1, length(r) // 2) ELSE r END"""
_RECORD = """'{"size": ' || CASE WHEN p_partkey % 5 = 0 THEN '"' || p_size || '"' ELSE CAST(p_size AS VARCHAR) END || ', "names": ["' || replace(p_name, ' ', '", "') || '", ' || p_size || ', null, {"x": ["y"]}], "price": {"usd": ' || CAST(p_partkey % 300 AS VARCHAR) || '}, "marks": [' || rtrim(repeat(CAST(p_size AS VARCHAR) || ',', 1 + CAST(p_partkey % 9 AS INT)), ',') || '], "brand": "' || p_brand || '"}'"""


@query(
    "record_fields",
    f"""WITH a AS (SELECT p_partkey, {_RECORD} AS r FROM part), b AS (SELECT p_partkey AS id, {_JSON} AS r FROM a), c AS (SELECT id, r, CASE WHEN json_valid(r) THEN r END AS j FROM b)
    SELECT id, CASE WHEN j IS NULL THEN r END AS corrupt, CASE WHEN TRY_CAST(json_extract_string(j, '$.size') AS DOUBLE) BETWEEN 5 AND 40 THEN TRY_CAST(json_extract_string(j, '$.size') AS DOUBLE) END AS size,
        array_to_string(list_transform(list_filter(json_extract(j, '$.names[*]'), lambda x: json_type(x) = 'VARCHAR' AND length(json_extract_string(x, '$')) <= 5), lambda x: json_extract_string(x, '$')), ',') AS names,
        CASE WHEN TRY_CAST(json_extract_string(j, '$.price.usd') AS DOUBLE) BETWEEN 20 AND 250 THEN TRY_CAST(json_extract_string(j, '$.price.usd') AS DOUBLE) END AS usd,
        CASE WHEN json_array_length(j, '$.marks') <= 6 THEN len(list_filter(json_extract(j, '$.marks[*]'), lambda x: CAST(x AS INT) BETWEEN 10 AND 60)) END AS marks, json_extract_string(j, '$.brand') AS brand FROM c""",
)
def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with broken, nested and over-long parts: every field inside its bounds, unreadable ones as they came."""
    p = table(spark, sf_dir, "part")
    size, text = F.col("p_size").cast("string"), lambda x: F.lit(x)
    r = F.concat(
        text('{"size": '), F.when(F.col("p_partkey") % 5 == 0, F.concat(text('"'), size, text('"'))).otherwise(size), text(', "names": ["'), F.replace("p_name", F.lit(" "), F.lit('", "')), text('", '), size, text(', null, {"x": ["y"]}], "price": {"usd": '),
        (F.col("p_partkey") % 300).cast("string"), text('}, "marks": ['), F.array_join(F.array_repeat(size, (1 + F.col("p_partkey") % 9).cast("int")), ","), text('], "brand": "'), F.col("p_brand"), text('"}'),
    )
    p = p.select(F.col("p_partkey").alias("id"), r.alias("r"))
    p = p.withColumn("r", F.when(F.col("id") % 7 == 0, F.substr("r", F.lit(1), F.floor(F.length("r") / 2).cast("int"))).otherwise(F.col("r")))
    fields = {"size": records.Number("$.size", 5, 40), "names": records.Items("$.names", 12, longest=5), "usd": records.Number("$.price.usd", 20, 250), "marks": records.Items("$.marks", 6, low=10, high=60), "brand": records.Text("$.brand", 20)}
    t = records.read(p, "r", fields)
    return t.select("id", "corrupt", "size", F.array_join("names", ",").alias("names"), "usd", F.when(F.col("marks").isNotNull(), F.size("marks")).cast("long").alias("marks"), "brand")


@query("first_n_per_topic", "SELECT conv_id, turn, role FROM conversations WHERE length(text) >= 50 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2")
def first_n_per_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two long enough posts of each topic."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").where(F.length("text") >= 50)
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", "role", n.alias("n")).where("n <= 2").drop("n")


@query("first_value_per_topic", "SELECT conv_id, arg_min(text, turn) FILTER (role = 'assistant') AS answer, arg_min(turn, turn) FILTER (length(text) > 200) AS long_turn FROM conversations GROUP BY 1")
def first_value_per_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first usable value of each field in post order."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer"), F.min(F.when(F.length("text") > 200, F.col("turn"))).alias("long_turn"))
