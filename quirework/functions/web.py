"""Links and metadata of work pages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import patterns as P
from .expr import indices, let, let_all
from .html import after_tag, attribute, has_class, tokens, tokens_text
from .naming import or_default
from .text import py_strip


def _elements(t: Column, tag: str, wanted) -> Column:
    """The inside, as tokens, of each ``tag`` element whose opening tag is ``wanted``."""
    opening = rf"(?i)^<{tag}[\s/>]"
    at = F.filter(indices(t), lambda i: F.get(t, i).rlike(opening) & wanted(F.get(t, i)))
    return F.transform(at, lambda i: after_tag(t, i, tag))


def page_title(t: Column) -> Column:
    """Title from a page's tokens, which must be cheap to evaluate repeatedly."""
    heading = F.coalesce(F.get(_elements(t, "h2", lambda x: has_class(x, "title", "heading")), F.lit(0)),
                         F.array().cast("array<string>"))
    meta = F.filter(t, lambda x: x.rlike(r"(?i)^<meta[\s/>]") & (attribute(x, "property") == "og:title"))
    content = F.coalesce(attribute(F.get(meta, F.lit(0)), "content"), F.lit(""))
    return or_default(tokens_text(heading), or_default(py_strip(content), P.DEFAULT_WORK_TITLE))


def page_author(t: Column) -> Column:
    """Author from a page's tokens, which must be cheap to evaluate repeatedly."""
    bylines = F.flatten(_elements(t, "h3", lambda x: has_class(x, "byline", "heading")))
    author = lambda x: F.array_contains(F.split(attribute(x, "rel"), r"\s+"), "author")
    link = let(bylines, lambda b: F.coalesce(
        F.get(_elements(b, "a", author), F.lit(0)), F.array().cast("array<string>")))
    return or_default(tokens_text(link), P.UNKNOWN_AUTHOR)


# --- URLs -------------------------------------------------------------------------

_URL_BASE = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?"


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in an absolute path."""

    def resolve(parts):
        kept = F.aggregate(
            parts,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == ".", acc)
            .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
            .otherwise(F.concat(acc, F.array(s))),
        )
        last = F.element_at(parts, -1)
        tail = F.when(last.isin(".", ".."), "/").otherwise("")
        return F.concat(F.array_join(kept, "/"), tail)

    return F.when(
        path.rlike(r"(?:^|/)\.{1,2}(?:/|\z)"), let(F.split(path, "/", -1), resolve)
    ).otherwise(path)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute URL of a link found on page ``base``."""

    def build(v):
        b, h = v["base"], v["href"]
        origin = F.regexp_extract(b, _URL_BASE, 0)
        scheme = F.regexp_extract(b, _URL_BASE, 1)
        path = F.regexp_extract(b, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?([^?#]*)", 1)
        folder = or_default(F.regexp_extract(path, r"(?s)^(.*/)", 1), "/")
        rest = F.regexp_extract(h, r"(?s)[?#].*\z", 0)
        own = F.regexp_extract(h, r"(?s)^[^?#]*", 0)
        return (
            F.when(h == "", b)
            .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h.startswith("/"), F.concat(origin, _without_dots(own), rest))
            .when(h.startswith("#"), F.concat(F.regexp_extract(b, r"(?s)^[^#]*", 0), h))
            .when(h.startswith("?"), F.concat(origin, path, h))
            .otherwise(F.concat(origin, _without_dots(F.concat(folder, own)), rest))
        )

    return let_all({"base": base, "href": href}, build)


def normalize_work_url(url: Column) -> Column:
    """``scheme://host/works/<id>``, or null when the path names no work."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    work = F.regexp_extract(path, r"^/works/([0-9]+)", 1)
    return F.when(
        work != "",
        F.concat(
            or_default(scheme, P.DEFAULT_WORK_SCHEME), F.lit("://"),
            or_default(host, P.DEFAULT_WORK_HOST), F.lit("/works/"), work,
        ),
    )


# --- download links ---------------------------------------------------------------


def page_links(html_col: Column, base: Column) -> Column:
    """``array<struct<text,href,url>>`` of all anchors with a target, in page order.

    An anchor's text reaches to its end tag (or to the next anchor, or the end)."""

    def build(t):
        anchors = F.filter(indices(t), lambda i: F.get(t, i).rlike(r"(?i)^</?a[\s/>]"))

        def pick(an):
            opens = F.filter(
                indices(an), lambda k: F.get(t, F.get(an, k)).rlike(r"(?i)^<a\s")
            )
            links = F.transform(
                opens,
                lambda k: F.struct(
                    F.lower(
                        tokens_text(
                            F.slice(
                                t,
                                F.get(an, k) + 2,
                                F.coalesce(F.get(an, k + 1), F.size(t)) - F.get(an, k) - 1,
                            )
                        )
                    ).alias("text"),
                    attribute(F.get(t, F.get(an, k)), "href").alias("href"),
                ),
            )
            return F.transform(
                F.filter(links, lambda x: x["href"] != ""),
                lambda x: F.struct(
                    x["text"].alias("text"),
                    x["href"].alias("href"),
                    resolve_url(base, x["href"]).alias("url"),
                ),
            )

        return let(anchors, pick)

    return let(tokens(html_col), build)


def download_links(html_col: Column, base: Column, formats=P.DOWNLOAD_FORMATS) -> Column:
    """Map of format to URL; the last link that names a format wins."""

    def by_format(links):
        named = F.transform(
            F.array(*[F.lit(f) for f in formats]),
            lambda f: F.struct(
                f.alias("key"),
                F.try_element_at(
                    F.filter(
                        links,
                        lambda x: F.contains(x["text"], f) | F.contains(F.lower(x["href"]), f),
                    ),
                    F.lit(-1),
                )["url"].alias("value"),
            ),
        )
        return F.map_from_entries(F.filter(named, lambda e: e["value"].isNotNull()))

    return let(page_links(html_col, base), by_format)


def pick_format(available: Column, preferred=P.DEFAULT_FORMAT_ORDER) -> Column:
    """``struct(fmt, url)`` of the first preferred format at hand, or null."""
    wanted = F.array(*[F.lit(f.lower()) for f in preferred])
    return let(
        available,
        lambda m: let(
            F.get(F.filter(wanted, lambda f: F.map_contains_key(m, f)), F.lit(0)),
            lambda f: F.when(
                f.isNotNull(), F.struct(f.alias("fmt"), F.try_element_at(m, f).alias("url"))
            ),
        ),
    )
