"""URLs: hosts, source classes, links and images of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(c: Column) -> Column:
    """Host name without a leading www.; null where there is none."""
    h = F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    return F.when(h != "", F.regexp_replace(h, r"^www\.", ""))


def is_safe(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^https?://[^\s/]+"), F.lit(False))


def in_domains(c: Column, domains: list[str]) -> Column:
    """The host is one of the domains or below one."""
    h = host(c)
    out = F.lit(False)
    for d in domains:
        out = out | (h == d) | F.endswith(h, F.lit(f".{d}"))
    return F.coalesce(out, F.lit(False))


def source_class(c: Column, classes: dict[str, list[str]], default: str) -> Column:
    """Name of the first class that lists the URL's host."""
    out = F.lit(default)
    for name, hosts in reversed(classes.items()):
        out = F.when(host(c).isin(hosts), F.lit(name)).otherwise(out)
    return out


def links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^<>]*href="([^"]+)"'), F.lit(1)))


def images(html: Column, most: int = 5) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)<img\s[^<>]*src="([^"]+)"'), F.lit(1))), 1, most)


def sitemap_locations(xml: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)))


def title(html: Column) -> Column:
    t = F.regexp_extract(html, r"(?is)<title[^<>]*>(.*?)(?:</title>|\z)", 1)
    return F.when(t != "", F.trim(F.regexp_replace(t, r"\s+", " ")))


def last_path_words(c: Column) -> Column:
    """Last piece of a URL's path, hyphens as spaces, title case."""
    from .text import title_case

    path = F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"/+$", "")
    return title_case(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"[-_]+", " "))


def any_outside(urls: Column, pattern: str) -> Column:
    """Any URL that is there and does not match ``pattern``."""
    return F.exists(urls, lambda u: F.coalesce((u != "") & ~u.rlike(pattern), F.lit(False)))


def script_call(html: Column, name: str) -> Column:
    """The number that a page's script passes to a function."""
    return F.regexp_extract(html, rf"(?s)<script[^>]*>.*?{name}\((\d+)\)", 1).try_cast("long")


def script_literal(html: Column, name: str) -> Column:
    """The JSON text literal that a page's script assigns to a variable; null where there is none."""
    v = F.regexp_extract(html, rf'(?s)<script[^>]*>var {name}=("[^"]*");', 1)
    return F.when(v != "", v)


def anchors(html: Column) -> Column:
    """array of (label, target): the links with a plain text, in page order."""
    pattern = F.lit(r'(?i)<a\s[^<>]*href="([^"<>]+)"[^<>]*>([^<]+)</a>')
    found = F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(2)).alias("label"), F.regexp_extract_all(html, pattern, F.lit(1)).alias("target"))
    return F.filter(F.transform(found, lambda s: F.struct(F.trim(s["label"]).alias("label"), s["target"].alias("target"))), lambda s: s["label"] != "")
