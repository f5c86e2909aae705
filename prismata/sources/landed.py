"""Landed data: store pages, sitemaps, matrix JSON and raw text; feeds and reports.

Fetching is not Spark's work: connectors land what they get as files, and these
readers turn files into tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.display import without_references
from ..functions.text import html_to_text, slug, without_prefix
from ..functions.urls import host, sitemap_locations
from ..operators.extraction import extract
from .shared import checkpointed

PRODUCT = "struct<title:string,handle:string,vendor:string,product_type:string,tags:array<string>,body_html:string,images:array<struct<src:string>>,variants:array<struct<title:string,price:string,available:boolean,sku:string>>,options:array<struct<name:string,values:array<string>>>>"


def storefront(spark: SparkSession, path: str) -> DataFrame:
    """Products of landed store pages (``{"products": [...]}``, one file per page); a repeated handle counts once."""
    pages = spark.read.schema(f"products array<{PRODUCT}>").option("multiLine", True).json(path)
    return pages.select(F.explode("products").alias("p")).select("p.*").dropDuplicates(["vendor", "handle"])


def option_values(options: Column, name: str) -> Column:
    """Values of the option whose name matches, in order."""
    return F.flatten(F.transform(F.filter(options, lambda o: F.lower(o["name"]).rlike(name)), lambda o: o["values"]))


def entries(products: DataFrame, store_url: str) -> DataFrame:
    """One catalogue row per product: id, model, brand, price range, colours, images, url, stock."""
    prices = F.transform("variants", lambda v: v["price"].try_cast("double"))
    positive = F.filter(prices, lambda p: p > 0)
    return products.select(
        slug(F.col("vendor"), F.col("title")).alias("id"),
        F.trim("title").alias("model"),
        F.col("vendor").alias("brand"),
        F.array_min(positive).alias("price_usd"),
        F.array_max(positive).alias("price_high"),
        F.coalesce(option_values(F.col("options"), "colou?r"), F.array().cast("array<string>")).alias("color"),
        F.slice(F.transform("images", lambda i: i["src"]), 1, 5).alias("image_urls"),
        F.concat(F.lit(store_url.rstrip("/") + "/products/"), "handle").alias("url"),
        F.exists("variants", lambda v: F.coalesce(v["available"], F.lit(False))).alias("in_stock"),
        F.col("body_html"),
    )


SECOND = "array<struct<id:long,name:string,permalink:string,prices:struct<price:string,currency_minor_unit:int>,images:array<struct<src:string>>,attributes:array<struct<name:string,terms:array<struct<name:string>>>>,categories:array<struct<name:string>>,description:string,is_in_stock:boolean>>"


def second_store(spark: SparkSession, path: str) -> DataFrame:
    """Products of the other store shape (a JSON list per landed page, prices in minor units); a repeated id counts once."""
    pages = spark.read.text(path, wholetext=True).select(F.from_json("value", SECOND).alias("p"))
    return pages.select(F.explode("p").alias("p")).select("p.*").dropDuplicates(["id", "permalink"])


def second_entries(products: DataFrame, brand: str) -> DataFrame:
    """The same catalogue rows from the other store shape; its names carry the brand and references."""
    name = without_references(F.trim("name"))
    minor = F.coalesce(F.col("prices.currency_minor_unit"), F.lit(2))
    price = F.col("prices.price").try_cast("double") / F.pow(F.lit(10.0), minor)
    terms = F.flatten(F.transform(F.filter("attributes", lambda a: F.lower(a["name"]).rlike("colou?r")), lambda a: F.transform(a["terms"], lambda t: t["name"])))
    model = without_prefix(name, F.lit(brand))
    return products.select(
        slug(F.lit(brand), model).alias("id"),
        model.alias("model"),
        F.lit(brand).alias("brand"),
        F.when(price > 0, price).alias("price_usd"),
        F.coalesce(terms, F.array().cast("array<string>")).alias("color"),
        F.slice(F.transform("images", lambda i: i["src"]), 1, 5).alias("image_urls"),
        F.col("permalink").alias("url"),
        F.coalesce("is_in_stock", F.lit(False)).alias("in_stock"),
        F.col("description").alias("body_html"),
    )


def reviews(pages: DataFrame) -> DataFrame:
    """page_id, url, subject and what was measured, of landed review pages (page_id, html, url)."""
    heading = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", " "))
    text = html_to_text(F.col("html"))
    return pages.select(
        "page_id",
        "url",
        F.trim(F.regexp_replace(heading, r"(?i)\s*[-–:|]?\s*\b(?:review|test|hands[- ]on)\b.*$", "")).alias("subject"),
        extract(text, "lumens").alias("measured_lumens"),
        extract(text, "cri").alias("measured_cri"),
        extract(text, "cct").alias("measured_cct"),
    )


def sitemap_entries(files: DataFrame) -> DataFrame:
    """url, nested, parent of landed sitemap files (url, body): what stands in a ``sitemap`` element, or ends in .xml, is a sitemap itself."""
    inner = F.regexp_extract_all("body", F.lit(r"(?is)<sitemap\b[^<>]*>\s*<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    t = files.select(F.col("url").alias("parent"), inner.alias("inner"), F.explode(sitemap_locations(F.col("body"))).alias("url"))
    return t.select("url", (F.array_contains("inner", F.col("url")) | F.col("url").rlike(r"\.xml(\.gz)?(\?.*)?$")).alias("nested"), "parent")


def sitemap_pages(files: DataFrame, roots: list[str]) -> DataFrame:
    """url, level of every page that the sitemaps reach from ``roots``; ``files`` has what was landed, as (url, body).

    Each round reads the sitemaps of the frontier and keeps those nested ones
    that no round has visited, so sitemaps that name each other end; a sitemap
    that was not landed has no pages.  A page counts at its first level.
    """
    spark = files.sparkSession
    links = checkpointed(sitemap_entries(files))
    frontier = spark.createDataFrame([(r,) for r in sorted(set(roots))], "url string")
    visited, pages, level = frontier, [], 0
    while frontier.limit(1).count():
        here = links.join(frontier.select(F.col("url").alias("parent")), "parent", "left_semi")
        pages.append(here.where("not nested").select("url", F.lit(level).alias("level")).distinct())
        frontier = checkpointed(here.where("nested").select("url").distinct().join(visited, "url", "left_anti"))
        visited = visited.unionByName(frontier)
        level += 1
    every = pages[0]
    for more in pages[1:]:
        every = every.unionByName(more)
    return every.groupBy("url").agg(F.min("level").alias("level"))


def first_success(candidates: DataFrame, key: str, urls: str, done: DataFrame) -> DataFrame:
    """key, url, body of each key's first URL, in the order of its list, that was landed (``done``: url, ok, body)."""
    t = candidates.select(F.col(key), F.posexplode(urls).alias("place", "url"))
    hit = t.join(done.where("ok").select("url", "body"), "url")
    return hit.groupBy(key).agg(F.min_by(F.struct("url", "body"), "place").alias("first")).select(key, "first.url", "first.body")


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """row, column, value of a JSON file of parallel ``head`` and ``data`` arrays; short rows give no value."""
    raw = spark.read.schema("head array<string>, data array<array<string>>").option("multiLine", True).json(path)
    rows = raw.select("head", F.posexplode("data").alias("row", "cells"))
    cells = F.explode(F.arrays_zip(F.col("head").alias("column"), F.slice("cells", 1, F.size("head")).alias("value")))
    return rows.select(F.col("row").cast("long").alias("row"), cells.alias("c")).select("row", "c.column", "c.value").where("value is not null")


def text_segments(df: DataFrame, text: str, least: int = 50, most: int = 15_000) -> DataFrame:
    """Raw texts worth keeping, cut to the segment size that the store keeps."""
    return df.where(F.length(F.trim(text)) >= least).withColumn(text, F.substring(text, 1, most))


def pending_hosts(df: DataFrame, url: str, done: DataFrame) -> DataFrame:
    """host, n of the urls that are not done yet."""
    left = df.select(F.col(url).alias("url")).distinct().join(done.select(F.col(url).alias("url")), "url", "left_anti")
    return left.groupBy(host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


def write_dataset(df: DataFrame, facets: DataFrame, path: str) -> None:
    """The built dataset: rows and facet metadata as two tables."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    facets.write.mode("overwrite").json(f"{path}/facets")


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/rows"), spark.read.json(f"{path}/facets")


def write_feed(deals: DataFrame, path: str) -> None:
    """A feed of at most some hundred rows as one JSON-lines file."""
    deals.coalesce(1).write.mode("overwrite").json(path)


def report_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """Markdown table rows of a report, to be written as text; append mode keeps earlier reports."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
