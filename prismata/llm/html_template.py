"""Main text of web pages by equivalence classes of template tokens.

Method.  A page is read as tokens (``html_page``): its block elements, named by
their paths, and its text blocks, named by their element and text.  Over the distinct pages of a host every token has an occurrence
vector: how often it stands on each page.

1. Tokens with one vector form an equivalence class.  A vector is held as
   order-free sums of hashes of (page, count), so classes come from partially
   aggregated groups and no host is ever gathered.  Only tokens on at least
   ``MIN_PAGES`` pages and a ``SHARE`` of the host's pages take part; a page's
   tokens over ``SHARE`` bound their number whatever the size of the host.
2. A class is ordered when its tokens open and close in one order on all pages.
   It is nested when all of it lies in one slot of the class around it.  A class
   that is not both is split into its groups of siblings; what still has no order
   is no template.  Valid classes, nested by their paths, are the template.
3. What remains between template tokens are the slots.  A slot's text is
   ``repeated`` as far as its blocks are frequent tokens themselves, else its
   own.  The article's region is found from the top of the template downwards,
   in the direction of the host's own text.
4. A page gives the blocks of that region, without blocks that are template text
   (in a class of two tokens or more on nearly every page) and without slots on
   nearly every page whose text is nearly all repeated, as adverts from a pool.

Elements and roles (menus, footers, forms, article and main) are one more sign:
their blocks never enter, and an article element draws the region to it.  A few
whole class names count only where they hold less than half of a page's text.
``signals=False`` turns all of these off.

Equal htmls of a host are one page in all counts.  A host with fewer than
``MIN_PAGES`` different pages, or most of whose pages have no block of their own
or hardly any text of their own (changed copies of one page), has no template:
its pages, and pages that lack their host's region, choose the region by their
own text.

Defined cases: a null or empty page gives an empty text; a null url is a host of
its own; unclosed and stray tags are tolerated; repeated rows each give a row
and count as one page; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .html_page import Page, digest

MIN_PAGES = 5
#: Tokens on a smaller share of the host's pages are data.
SHARE = 0.01
#: Share of the host's pages from which a token is on nearly every page.
NEARLY_ALL = 0.8
#: A child that holds so much of its parent's text is the article's region.
MOST = 0.6
#: An article or main element needs only so much.
SEMANTIC = 0.25
#: Repeated share from which a slot is no part of an article.
REPEATED = 0.9
#: Share of its own text without which a host shows no template.
LEAST_OWN = 0.05
#: Share of its pages that must have a text block of their own for a host to show a template.
LEAST_FRESH = 0.5

TEXT, ELEMENT, PAGE = 0, 1, 2


def host_of(url: str | None) -> int:
    if url is None:
        return 0
    rest = url.split("://", 1)[-1]
    return digest(re.split(r"[/?#]", rest, maxsplit=1)[0].rsplit("@", 1)[-1].lower()) or 1


def text_token(element: int, text: str) -> int:
    return digest(element, text)


def page_tokens(page: Page) -> dict[int, list[int]]:
    """token: [kind, parent, times, first, last, text length, whether a region may be there, whether an article or main]."""
    out: dict[int, list[int]] = {}
    for e, token in enumerate(page.token):
        parent = page.token[page.parent[e]] if page.parent[e] >= 0 else 0
        t = out.setdefault(token, [ELEMENT, parent, 0, page.first[e], 0, 0, int(page.container[e]), int(page.semantic[e])])
        t[2] += 1
        t[4] = max(t[4], page.last[e])
        t[5] += page.mass[e]
    for text, e, marked, at in page.blocks:
        parent = page.token[e] if e >= 0 else 0
        t = out.setdefault(text_token(parent, text), [TEXT, parent, 0, at, 0, 0, 0, 0])
        t[2] += 1
        t[4] = at
        t[5] += 0 if marked else len(text)
    return out


TOKENS = ["host", "mark", "token", "kind", "parent", "times", "first", "last", "mass", "may", "semantic"]


def _tokens(signals: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, ...]] = []
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                host, mark = host_of(url), digest(source or "")
                rows.append((host, mark, 0, PAGE, 0, 1, 0, 0, 0, 0, 0))
                rows.extend((host, mark, token, *t) for token, t in page_tokens(Page(source or "", signals)).items())
            columns = np.array(rows, np.int64).reshape(-1, len(TOKENS)).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=TOKENS)

    return run


def classes(rows: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """The frequent tokens of each host with their equivalence class.

    ``rows`` has one row for each (host, mark, token).  ``cls`` is the class by
    vector and ``sib`` the class among siblings; ``cls_ordered`` and
    ``sib_ordered`` say whether the order of tokens is the same on all pages.
    """
    v = F.xxhash64("mark", "times")
    got = rows.withColumn("v1", v.bitwiseAND(F.lit(0xFFFFFFFF))).withColumn("v2", F.shiftrightunsigned(v, 32))
    same = [F.max(c).alias(c) for c in ("kind", "parent", "may", "semantic")]
    sums = got.groupBy("host", "token").agg(*same, F.count(F.lit(1)).alias("pages"), F.count_if(F.col("times") == 1).alias("once"), F.sum("mass").alias("mass"), F.sum("v1").alias("v1"), F.sum("v2").alias("v2"), F.max("mark").alias("mark"))
    sums = common.saved(sums.where((F.col("pages") >= min_pages) | ((F.col("pages") == 1) & (F.col("kind") == TEXT))))
    fresh = sums.where("pages = 1").select("host", "mark").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("fresh"))
    sums = sums.where(F.col("pages") >= min_pages)
    hosts = sums.where(F.col("kind") == PAGE).select("host", F.col("pages").alias("of")).join(fresh, "host", "left")
    often = sums.where(F.col("kind") != PAGE).join(hosts, "host").where(F.col("pages") >= share * F.col("of"))
    often = common.saved(often.select("host", "token", "kind", "parent", "may", "semantic", "pages", "once", "mass", "of", F.coalesce("fresh", F.lit(0)).alias("fresh"), F.xxhash64("v1", "v2").alias("cls"), F.xxhash64("v1", "v2", "parent").alias("sib")))
    seen = rows.select("host", "mark", "token", "first", "last").join(often.select("host", "token", "cls", "sib"), ["host", "token"])
    seen = seen.select("host", "mark", "token", "first", "last", F.explode(F.array("cls", "sib")).alias("class"))
    ends = F.array(F.struct(F.col("first").alias("at"), "token"), F.struct(F.col("last").alias("at"), "token"))
    order = F.array_sort(F.flatten(F.collect_list(ends)))  # the tokens of one page
    order = seen.groupBy("host", "class", "mark").agg(F.xxhash64(F.transform(order, lambda x: x["token"])).alias("order"))
    order = order.groupBy("host", "class").agg((F.min("order") == F.max("order")).alias("ordered"))
    for c in ("cls", "sib"):
        often = often.join(order.select("host", F.col("class").alias(c), F.col("ordered").alias(f"{c}_ordered")), ["host", c], "left")
    return often


def valid_classes(tokens: list[dict]) -> dict[int, int]:
    """token: its valid class.  A class that is not ordered or not nested falls into its siblings."""
    by_token = {t["token"]: t for t in tokens}
    chosen: dict[int, tuple[int, bool]] = {}
    for t in tokens:
        if t["cls_ordered"]:
            chosen[t["token"]] = (t["cls"], False)
        elif t["sib_ordered"]:
            chosen[t["token"]] = (t["sib"], True)

    def around(token: int) -> int:
        """The nearest token outside that is of another class."""
        own = chosen[token][0]
        at = by_token[token]["parent"]
        while at in by_token and (at not in chosen or chosen[at][0] == own):
            at = by_token[at]["parent"]
        return at if at in by_token else 0

    slots: dict[int, set[int]] = defaultdict(set)
    for token, (c, split) in chosen.items():
        if not split:
            slots[c].add(around(token))
    out = {}
    for token, (c, split) in chosen.items():
        t = by_token[token]
        if split or len(slots[c]) == 1:
            out[token] = c
        elif t["sib_ordered"]:
            out[token] = t["sib"]
    return out


def slot(nodes: dict[int, tuple[int, float, bool, bool]]) -> int:
    """The article's region among (parent, text, may be a region, article or main); 0: the whole page."""
    children = defaultdict(list)
    for token, (parent, mass, may, semantic) in nodes.items():
        children[parent if parent in nodes else 0].append((mass, may, semantic, token))
    total = sum(mass for mass, _, _, _ in children[0])
    now, mass = 0, total
    while total:
        ways = [(semantic and m >= SEMANTIC * total, m, token) for m, may, semantic, token in children[now] if may]
        if not ways:
            break
        best = max(ways)
        if not best[0] and best[1] < MOST * mass:
            break
        now, mass = best[2], best[1]
    return now


def host_template(tokens: list[dict]) -> tuple[int, list[int]] | None:
    """(region, tokens whose text goes) of a host's frequent tokens; None: no template."""
    valid = valid_classes(tokens)
    elements = {t["token"]: t for t in tokens if t["kind"] == ELEMENT}
    texts = [t for t in tokens if t["kind"] == TEXT]
    size: dict[int, int] = defaultdict(int)
    for token, c in valid.items():
        size[c] += 2 if token in elements else 1  # an element opens and closes
    depth: dict[int, int] = {}
    for token in elements:
        trail = []
        while token in elements and token not in depth:
            trail.append(token)
            token = elements[token]["parent"]
        base = depth.get(token, 0)
        for i, t in enumerate(reversed(trail), 1):
            depth[t] = base + i
    inside = sorted(elements, key=depth.__getitem__, reverse=True)
    repeated: dict[int, int] = defaultdict(int)
    for t in texts:
        repeated[t["parent"]] += t["mass"]
    for token in inside:
        repeated[elements[token]["parent"]] += repeated[token]
    own = {token: max(0, e["mass"] - repeated[token]) for token, e in elements.items()}
    tops = [token for token, e in elements.items() if e["parent"] not in elements]
    if tokens[0]["fresh"] < LEAST_FRESH * tokens[0]["of"] or sum(own[t] for t in tops) < LEAST_OWN * sum(elements[t]["mass"] for t in tops):
        return None

    def often(t: dict) -> bool:
        return t["pages"] >= NEARLY_ALL * t["of"]

    nodes = {}
    for token, e in elements.items():
        if token in valid:
            parent = e["parent"]
            while parent in elements and parent not in valid:
                parent = elements[parent]["parent"]
            nodes[token] = (parent, own[token], bool(e["may"]) and often(e) and e["once"] >= NEARLY_ALL * e["pages"], bool(e["semantic"]))
    region = slot(nodes)
    whole = elements[region] if region else None
    page = whole["mass"] / whole["pages"] if whole else sum(elements[t]["mass"] / elements[t]["pages"] for t in tops)
    gone = [t["token"] for t in texts if t["token"] in valid and often(t) and size[valid[t["token"]]] > 1]
    for token, e in elements.items():
        if token in valid and token != region and often(e) and e["mass"] and repeated[token] >= REPEATED * e["mass"] and e["mass"] / e["pages"] <= page / 2:
            gone.append(token)
    return region, gone


def _host_templates(group: pa.Table) -> pa.Table:
    got = host_template(group.to_pylist())
    host = group.column("host")[0].as_py()
    rows = [] if got is None else [{"host": host, "region": got[0], "gone": got[1]}]
    return pa.Table.from_pylist(rows, pa.schema([("host", pa.int64()), ("region", pa.int64()), ("gone", pa.list_(pa.int64()))]))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, signals: bool = True, share: float = SHARE) -> DataFrame:
    """host, region, gone: each host's article region and the tokens whose text is template."""
    common.workers_import(pages.sparkSession)
    rows = pages.mapInArrow(_tokens(signals), ", ".join(f"{c} long" for c in TOKENS))
    # equal htmls give equal rows
    rows = common.saved(rows.groupBy("host", "mark", "token").agg(*[F.max(c).alias(c) for c in TOKENS[3:]]))
    found = classes(rows, min_pages, share)
    return common.saved(found.groupBy("host").applyInArrow(_host_templates, "host long, region long, gone array<long>"))


def main_text(page: Page, region: int | None, gone: list[int] | None) -> str:
    """The article of a page, given its host's region (0: all of the page, None: no template) and template tokens."""
    n = len(page.token)
    total = sum(len(t) for t, _, marked, _ in page.blocks if not marked)
    drop = set(gone or ())
    out = [False] * n
    for e in range(n):
        parent = page.parent[e]
        out[e] = (parent >= 0 and out[parent]) or page.token[e] in drop or (page.named[e] and page.mass[e] < total / 2)
    mass = [0] * n  # without what goes
    for text, e, marked, _ in page.blocks:
        if e >= 0 and not marked and not out[e]:
            mass[e] += len(text)
    for e in range(n - 1, -1, -1):
        if page.parent[e] >= 0:
            mass[page.parent[e]] += mass[e]
    inside = [region == 0] * n
    if region:
        for e in range(n):
            inside[e] = page.token[e] == region or (page.parent[e] >= 0 and inside[page.parent[e]])
    if not region or not any(i and m for i, m in zip(inside, mass, strict=True)):
        inside = [True] * n
    # a narrower region by the page's own text, where its host has shown none or an article element is inside
    held: dict[int, list] = {}
    for e in range(n):
        if inside[e]:
            h = held.setdefault(page.token[e], [page.token[page.parent[e]] if page.parent[e] >= 0 else 0, 0, 0, page.container[e], page.semantic[e]])
            h[1] += mass[e]
            h[2] += 1
    if region is None or all(inside):
        root = slot({t: (p, m, may and times == 1, semantic) for t, (p, m, times, may, semantic) in held.items()})
    else:
        articles = [(m, t) for t, (_, m, times, _, semantic) in held.items() if semantic and times == 1]
        root = max(articles, default=(0, 0))[1] if articles and max(articles)[0] >= MOST * held[region][1] else 0
    if root:
        for e in range(n):
            inside[e] = page.token[e] == root or (page.parent[e] >= 0 and inside[page.parent[e]])
    whole = not root and (region is None or all(inside))
    kept = []
    for text, e, marked, _ in page.blocks:
        if marked or (e >= 0 and (out[e] or not inside[e])) or (e < 0 and not whole):
            continue
        if drop and text_token(page.token[e] if e >= 0 else 0, text) in drop:
            continue
        kept.append(text)
    return "\n".join(kept)


def _extract(signals: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("html", "region", "gone"))
            texts = [main_text(Page(h or "", signals), region, gone) for h, region, gone in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=["page_id", "url", "text", "n_chars"])

    return run


def _with_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts = pa.array([host_of(u) for u in batch.column("url").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, hosts], names=[*batch.schema.names, "host"])


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, signals: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of each row.

    The templates are a stored table, so Spark knows its size: a small one is
    broadcast and the pages stay where they are, a large one meets the pages in
    a sort-merge join that splits a hot host.
    """
    p = common.with_columns(pages, page_id="long", url="string", html="string")
    t = templates(p, min_pages, signals)
    p = p.mapInArrow(_with_host, "page_id long, url string, html string, host long")
    return p.join(t, "host", "left").select("page_id", "url", "html", "region", "gone").mapInArrow(_extract(signals), "page_id long, url string, text string, n_chars long")
