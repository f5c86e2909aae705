"""Text: keys, names, HTML to text, numbers and keywords in prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"


def slug(*parts: Column) -> Column:
    """Lower case, runs of anything but letters and digits to one hyphen, none at the ends."""
    joined = F.lower(F.concat_ws("-", *parts))
    return F.regexp_replace(F.regexp_replace(joined, "[^a-z0-9]+", "-"), "^-|-$", "")


def title_case(c: Column) -> Column:
    """Capitals after every word boundary, hyphens and apostrophes included."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+|[^a-z0-9]+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def alias_or_title(c: Column, aliases: dict[str, str], typos: dict[str, str] | None = None) -> Column:
    """Known aliases, then known typos (both by lower case), else title case."""
    out = title_case(F.trim(c))
    low = F.lower(F.trim(c))
    for table in (typos or {}, aliases):
        if table:
            m = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
            out = F.coalesce(F.try_element_at(m, low), out)
    return out


def match_key(c: Column, spaced: bool = False) -> Column:
    """Comparison key: lower case, other characters dropped or turned into one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " " if spaced else ""))


def core_model(c: Column) -> Column:
    """Leading letters-and-digits code in upper case, else the first word with a digit."""
    code = F.upper(F.regexp_extract(c, r"(?i)\b([a-z]{1,4}[0-9]{1,4}[a-z]{0,3})\b", 1))
    word = F.upper(F.regexp_extract(c, r"(\S*[0-9]\S*)", 1))
    return F.when(code != "", code).when(word != "", word)


def without_version(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?i)\s*(v|ver|version|mk|gen)\.?\s*[0-9]+(\.[0-9]+)?\s*$", ""))


def without_specs(c: Column) -> Column:
    """Figures with units and bracketed remarks taken out."""
    t = F.regexp_replace(c, r"\([^)]*\)|\[[^\]]*\]", " ")
    t = F.regexp_replace(t, r"(?i)\b[0-9][0-9,.]*\s*(lumens?|lm|mah|wh|k|mm|cm|m|g|v|w)\b", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def without_prefix(c: Column, prefix: Column) -> Column:
    """A leading brand name, case aside, taken off."""
    return F.when(F.startswith(F.lower(c), F.concat(F.lower(prefix), F.lit(" "))), F.trim(F.substring(c, F.length(prefix) + 1, F.length(c)))).otherwise(c)


def without_zero_width(c: Column) -> Column:
    return F.regexp_replace(c, r"[\u200b\u200c\u200d\u2060\ufeff]", "")


def unfenced(c: Column) -> Column:
    """The inside of a code fence, or the text itself."""
    inside = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.trim(F.when(inside != "", inside).otherwise(c))


def truncated(c: Column, most: int, mark: str = "") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


# fixed values: elements whose content is no text, and common named references
SILENT = ["script", "style", "nav", "footer", "header", "noscript", "svg"]
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&times;", "x"), ("&deg;", "°"), ("&plusmn;", "±"), ("&middot;", "·"), ("&copy;", "©"), ("&ndash;", "-"), ("&mdash;", "-"), ("&amp;", "&")]


def numeric_references(c: Column) -> Column:
    """Decimal and hexadecimal character references decoded; those beyond Unicode stay.

    The text is cut at its references, each is turned into its character as
    UTF-32 bytes, and the pieces are joined again.
    """
    pattern = "&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
    pieces = F.split(c, pattern, -1)
    found = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))

    def char(ref: Column) -> Column:
        inside = F.regexp_replace(ref, "[&#;]", "")
        number = F.when(inside.rlike("^[xX]"), F.conv(F.substring(inside, F.lit(2), F.lit(9)), 16, 10)).otherwise(inside).cast("long")
        known = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(ref)

    joined = F.array_join(F.zip_with(pieces, F.transform(found, char), lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")
    return F.when(F.contains(c, F.lit("&#")), joined).otherwise(c)


def without_elements(c: Column, tags: list[str]) -> Column:
    """Without comments and these elements; one that is never closed runs to the end, so every pass is linear."""
    t = F.regexp_replace(c, r"(?s)<!--.*?(?:-->|\z)", "")
    for tag in tags:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^<>]*>.*?(?:</{tag}>|\z)", "")
    return t


def decoded(c: Column) -> Column:
    """Named and numeric references decoded, the ampersand last, so that nothing is decoded twice."""
    for name, char in ENTITIES[:-1]:
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.replace(numeric_references(c), F.lit(ENTITIES[-1][0]), F.lit(ENTITIES[-1][1]))


def html_to_text(c: Column) -> Column:
    """Readable text: silent elements and comments dropped, blocks as lines, cells as tabs, references decoded."""
    t = without_elements(c, SILENT)
    t = F.regexp_replace(t, r"(?i)</(p|div|tr|li|h[1-6]|ul|ol|table|section|article)>|<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?i)</t[dh]>", "\t")
    t = decoded(F.regexp_replace(t, r"<[^<>]*>", ""))
    t = F.regexp_replace(t, "[‘’]", "'")
    t = F.regexp_replace(t, "[“”]", '"')
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(t, r" ?\n[ \n]*", "\n"))


def numbers_desc(c: Column, pattern: str, low: float, high: float) -> Column:
    """All numbers that ``pattern`` captures, inside the bounds, distinct, largest first."""
    found = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    return F.sort_array(F.array_distinct(F.filter(found, lambda x: (x > low) & (x < high))), asc=False)


def word_pattern(word: str) -> str:
    """A whole word: no letter or digit of any script beside it."""
    return rf"(^|[^\p{{L}}\p{{N}}_]){word}($|[^\p{{L}}\p{{N}}_])"


def keywords(c: Column, words: list[str], whole: bool = True) -> Column:
    """Which of ``words`` occur, in list order; as whole words or anywhere."""
    low = F.lower(c)
    hit = (lambda w: F.contains(low, F.lit(w)) & low.rlike(word_pattern(w))) if whole else (lambda w: F.contains(low, F.lit(w)))
    return F.array_compact(F.array(*[F.when(hit(w), F.lit(w)) for w in words]))


def keyword_unless(c: Column, word: str, not_in: str) -> Column:
    """``word`` occurs and the misleading phrase does not."""
    low = F.lower(c)
    return F.contains(low, F.lit(word)) & low.rlike(word_pattern(word)) & ~low.rlike(not_in)


def first_key_in(c: Column, table: list[tuple[str, str]], default: str | None = None) -> Column:
    """Value of the first key, in table order, that the text contains."""
    out = F.lit(default).cast("string")
    for key, value in reversed(table):
        out = F.when(F.contains(F.lower(c), F.lit(key)), F.lit(value)).otherwise(out)
    return out


def after_anchor(c: Column, start: str, stop: str, skip: str) -> Column:
    """The lines of the product part: from behind the first line that matches ``start`` up to the next that matches ``stop``.

    A stop line counts behind the start only; without a start line the text is
    taken from its beginning and no stop line counts.  Lines that match ``skip``
    are left out, and runs of blank lines become one, none at either end.
    """
    lines = F.split(c, "\n")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(start)), True)
    rest = F.when(at > 0, F.slice(lines, (at + 1).cast("int"), F.size(lines))).otherwise(lines)
    end = F.when(at > 0, F.array_position(F.transform(rest, lambda x: x.rlike(stop)), True)).otherwise(0)
    inside = F.filter(F.when(end > 0, F.slice(rest, 1, (end - 1).cast("int"))).otherwise(rest), lambda x: ~x.rlike(skip))
    marked = F.transform(inside, lambda x: F.when(F.trim(x) == "", F.lit("")).otherwise(x))
    return F.regexp_replace(F.regexp_replace(F.array_join(marked, "\n"), "\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")


def year(c: Column) -> Column:
    """The first year of 2010 to 2029."""
    return F.regexp_extract(c, "20[12][0-9]", 0).try_cast("int")


def without_words(c: Column, words: list[str]) -> Column:
    """The text without these whole words."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, rf"\b({'|'.join(words)})\b", " "), r"\s+", " "))
