"""Column expressions that read stored HTML pages.

Pages are parsed with Spark's string and array functions, one row at a time; no Python parser
is involved.  Tag and attribute names match in any case, attributes in any order and with
either quote, and text may span lines and child tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import squish, strip

# Names in the stored pages' markup; pass others for other pages.
ADDRESS_PROP, BEDS_PROP, BATHS_PROP = "home:address", "home:beds", "home:baths"
SIZE_BLOCK, SIZE_SPAN = "size-block", 6
SUMMARY_CLASS, SUMMARY_SPANS = "summary-row", {"list_price": 2, "beds": 5, "baths": 9, "sqft": 13}
ADDRESS_ID = "summary-address"
BASE_RE = r"^(https?://[^/]+)"
# Possessive runs, so that no page takes the matcher's stack, and none that stops at ``<``
# reads on to the page's end: time is linear in the page however its markup is broken.
_INSIDE = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""
TAG_RE = r"(?is)<{name}\b" + _INSIDE
ATTRIBUTE_RE = r"""(?is)(?<![\w-]){name}\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>]++)"""
TOKEN_RE = r"(?s)<" + _INSIDE + r"|[^<]++"
HIDDEN_RE = r"(?is)<!--(?:.*?-->|.*+)|<(script|style)\b[^>]*+>(?:.*?</\1\s*+>|.*+)"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unescape(text: Column) -> Column:
    def plain(t: Column) -> Column:
        out = t
        for entity, character in ENTITIES.items():
            out = F.replace(out, F.lit(entity), F.lit(character))
        return F.when(t.contains("&"), out).otherwise(t)

    return _once(text, plain)


def attribute(tag: Column, name: str) -> Column:
    """The attribute's value, quoted or not; NULL if the tag has none of this name."""
    held = F.get(F.regexp_extract_all(tag, F.lit(ATTRIBUTE_RE.format(name=name)), F.lit(0)), 0)
    return unescape(F.regexp_replace(held, r"""^[^=]*+=\s*+["']?|["']$""", ""))


def visible(html) -> Column:
    """The page without comments, scripts and styles (an unclosed one reaches to the end)."""
    h = _c(html)
    return F.when(h.rlike(r"(?i)<(?:!--|script|style)"), F.regexp_replace(h, HIDDEN_RE, "")).otherwise(h)


def tags(shown, name: str, having: str | None = None) -> Column:
    """The tags of this name in a ``visible`` page, in order; only those in which ``having``
    occurs, if given."""
    found = F.regexp_extract_all(_c(shown), F.lit(TAG_RE.format(name=name)), 0)
    return F.filter(found, lambda t: F.lower(t).contains(having)) if having else found


def hrefs(html="html") -> Column:
    """Every href value of the page's tags, in page order (an array)."""
    found = F.transform(tags(visible(html), "[a-z][a-z0-9]*+", "href"), lambda t: attribute(t, "href"))
    return F.filter(found, lambda h: h.isNotNull())


def metas(shown) -> Column:
    """property and content of every meta tag of a ``visible`` page, in page order."""
    return F.transform(tags(shown, "meta"), lambda t: F.struct(
        attribute(t, "property").alias("property"), attribute(t, "content").alias("content")))


def meta_content(prop: str, html="html", found=None) -> Column:
    """``content`` of the last ``<meta property=prop>`` tag; NULL if none.  ``found``: the
    page's ``metas``, if they are at hand."""
    held = F.filter(metas(visible(html)) if found is None else _c(found), lambda m: m["property"] == F.lit(prop))
    return F.try_element_at(held, F.lit(-1))["content"]


def row_labels(html="html", shown=None) -> Column:
    """``label`` attributes of table rows that have one.  ``shown``: the ``visible`` page,
    if it is at hand."""
    page = visible(html) if shown is None else _c(shown)
    found = F.transform(tags(page, "tr", "label"), lambda t: attribute(t, "label"))
    return F.filter(found, lambda x: x.isNotNull())


def label_entries(label) -> Column:
    """E11: 'k: v, k2: v2' -> array of (key, value) structs; parts without a
    colon are skipped, each part splits at its first colon, both halves
    are stripped."""
    parts = F.filter(F.split(_c(label), ", "), lambda p: p.contains(":"))
    return F.transform(parts, lambda p: F.struct(
        strip(F.substring_index(p, ":", 1)).alias("key"),
        strip(F.get(F.split(p, ":", 2), 1)).alias("value")))


def label_value(entries, key: str) -> Column:
    """Value of ``key`` in the entries; the last one wins, like a dict built
    from the pairs in order."""
    hits = F.filter(_c(entries), lambda e: e["key"] == F.lit(key))
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)["value"])


def _name(token: Column) -> Column:
    return F.when(token.startswith("<"), F.regexp_extract(F.lower(token), r"^<(/?[a-z][a-z0-9]*)", 1)).otherwise("")


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row: they pass a generator, so the optimizer
    does not copy their expressions into each use and each filter."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_pinned")
    return df.select("*", one).select(*df.columns, *[F.col(f"_pinned.{n}").alias(n) for n in columns])


def _marks(names: Column, name: Column) -> Column:
    """The places (from 1) of the tokens that open an element ``name`` and, negative, of those
    that close one, in page order."""
    places = F.transform(names, lambda tag, i: F.when(tag == name, i + 1).when(
        tag == F.concat(F.lit("/"), name), -(i + 1)).otherwise(0))
    return F.filter(places, lambda m: m != 0)


def _close(names: Column, marks: Column, begin: Column) -> Column:
    """The place (from 0) of the token that closes an element opened just before the place
    ``begin``; the end if none does."""
    def walk(depth: Column, mark: Column) -> Column:  # the closing mark, once it is found
        return F.when((depth < 0) | (F.abs(mark) <= begin), depth).when(mark > 0, depth + 1).when(
            depth > 1, depth - 1).otherwise(mark)

    return F.aggregate(marks, F.lit(1), walk, lambda at: F.when(at < 0, -at - 1).otherwise(F.size(names)))


def with_element(df: DataFrame, out: str, name: str, value: str, html: str = "html",
                 shown: str | None = None) -> DataFrame:
    """Add ``out`` (tokens: tags and texts) and ``out``_tags (their tag names, empty for
    texts): what the first element holds whose attribute ``name`` is, or among blanks holds,
    ``value``.  NULL if there is none.  ``shown``: the column of the ``visible`` page, if there
    is one."""
    held = rf"""(?:"(?:[^"]*\s)?{value}(?:\s[^"]*)?"|'(?:[^']*\s)?{value}(?:\s[^']*)?')"""
    pattern = rf"(?is)<[a-z][a-z0-9]*+\b[^<>]*?(?<![\w-]){name}\s*+=\s*+{held}[^<>]*+>"
    if shown is None:
        return with_element(pinned(df, _shown=visible(html)), out, name, value, shown="_shown").drop("_shown")
    df = pinned(df, _open=F.regexp_extract(shown, pattern, 0))
    tail = F.substr(F.col(shown), F.instr(F.col(shown), F.col("_open")) + F.length("_open"))
    df = pinned(df, _tag=F.lower(F.regexp_extract("_open", r"(?i)^<([a-z][a-z0-9]*)", 1)), _tokens=F.when(
        F.col("_open") != "", F.regexp_extract_all(tail, F.lit(TOKEN_RE), F.lit(0))))
    df = pinned(df, _names=F.transform("_tokens", _name))
    df = pinned(df, _end=_close(F.col("_names"), _marks(F.col("_names"), F.col("_tag")), F.lit(0)))
    df = pinned(df, **{out: F.slice("_tokens", F.lit(1), F.col("_end")),
                       f"{out}_tags": F.slice("_names", F.lit(1), F.col("_end"))})
    return df.drop("_open", "_tag", "_tokens", "_names", "_end")


def text_of(tokens: Column) -> Column:
    """The text without tags, blanks collapsed."""
    return squish(unescape(F.array_join(F.filter(tokens, lambda t: ~t.startswith("<")), "")))


def with_spans(df: DataFrame, block: str, spans: dict[str, int]) -> DataFrame:
    """Add the texts of numbered (zero-based) spans of a ``with_element`` block; NULL
    for a span that the block does not have."""
    tags = F.col(f"{block}_tags")
    df = pinned(df, _marks=_marks(tags, F.lit("span")))
    df = pinned(df, _opens=F.filter("_marks", lambda m: m > 0))
    df = pinned(df, **{f"_at_{c}": F.get("_opens", F.lit(k)) for c, k in spans.items()})
    df = pinned(df, **{f"_to_{c}": _close(tags, F.col("_marks"), F.col(f"_at_{c}")) for c in spans})
    texts = {c: F.when(F.col(f"_at_{c}").isNotNull(), text_of(F.slice(
        block, F.col(f"_at_{c}") + 1, F.col(f"_to_{c}") - F.col(f"_at_{c}")))) for c in spans}
    return pinned(df, **texts).drop("_marks", "_opens", *[f"_{x}_{c}" for x in ("at", "to") for c in spans])


def base_url(url="url") -> Column:
    """Scheme and host of a page URL (for E8)."""
    return F.regexp_extract(_c(url), BASE_RE, 1)
