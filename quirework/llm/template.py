"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are all its elements (by the path of tags, classes and places among equal
siblings that leads to them) and all its text blocks (path and text). Over the pages of a host,
tokens that occur equally often on every page share an *occurrence vector*; tokens with one
vector are an equivalence class. Vectors are never gathered: a sum of hashes of (page, count)
stands for one, so classes come from plain aggregation and a host with a third of all pages is no
special case. A class with enough tokens and pages is valid if it nests, that is if its elements
lie in itself and at most one other class. Valid classes that half of a host's pages share are its
template: elements with slots between them, and text that repeats word for word.

**The article's slot** is told by what varies. The text under an element that is neither link nor
template is what its slots hold; from the root down, the walk follows the container that
holds most of it (``DOMINANT``), and ends where no single one does. An ``article`` element on that way is
taken, else the last container; names decide between these only. A first heading of its own beside
the container belongs to it. Advert, menu and footer have slots of their own, whatever they are
called and however much they vary, and go. In the container goes what is template text on every
page of the host, and parts that say that they are something else (``names_part``).

**Pages without a deduced slot** (hosts with few pages or without template, pages of another
layout) are read by names: inside an ``article`` or ``main``, if there is one, else all that is
not marked as something else by element, class, id or role and does not consist of links, without
the host's template text. If names mark all of a page, only elements count.

Defined results: a null or empty html gives an empty text; pages without a host in the url (also
a null url) are read by names; repeated rows are separate pages. A page is read in one pass
whose time grows with its length, however deep it nests.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import bounded_batches, staged

#: Pages a host needs, and a class.
MIN_PAGES = 5
MIN_TOKENS = 3
#: Share of a host's pages from which on text outside articles is template.
SUPPORT = 0.5
#: Share of link characters from which on a block outside articles is a menu.
LINKS = 0.6
#: Share of the varying text of an element from which on a container in it is followed: in html and
#: body, where other slots are expected, and in a container, where they are rather parts of the article.
DOMINANT_IN_FRAME, DOMINANT = 0.6, 0.85
#: Share of the varying text that unmarked elements must hold for marks to be believed.
BELIEVED = 0.3

# fixed values: elements and the words in class, id or role that mark what is not article
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style template noscript iframe svg textarea title select".split())
BLOCKS = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p
    pre search section summary table tbody td tfoot th thead tr ul""".split())
DROPPED = set("nav footer aside form button menu dialog head search object audio video canvas".split())
MARKS = set("""nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar
    sidenav aside widget widgets ad ads adv advert adverts advertisement banner promo promotion sponsor sponsored
    cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe signup login
    comment comments commentlist discussion replies reply respond disqus related recommended share sharing social
    toolbar pagination pager search skip complementary contentinfo dialog alert banners""".split())
#: What stands beside a mark in the name of a part of an article ("ad-slot", "post-comments").
BESIDE = set("""area article bar block body bottom box button buttons card center col column container div dfp entry form
    google gpt group icon icons in inline inner item items js left link links list page panel post posts right section
    site slot top unit wp wrap wrapper""".split())
#: Ids of one word that are no slug of a heading.
IDS = set("""ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments commentlist disqus nav navbar
    newsletter pagination respond sidebar sidenav toolbar topbar""".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that may hold an article.
CONTAINERS = set("center dd div li main section table tbody td tr".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
#: A start of these ends what ``CLOSED_BY`` says, but not across the list or table around it.
SCOPES = set("ul ol dl menu table tbody thead tfoot select body html article".split())

#: A quote opens a value after an equals sign only; anywhere else it is a character.
TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:-->|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")
#: Names that say what a page has around its article ("with-sidebar") mark nothing.
AROUND = re.compile(r"(?:has|with|without|no|is)[-_]")

ROOT = 0
#: Why an element is dropped: by its names or those of one around it, or by what it is.
MARKED, ELEMENT = 1, 2
#: What a token is: text, an element, a first heading, html or body, a container, an article.
TEXT, OTHER, HEADING, FRAME, CONTAINER, ARTICLE = range(6)


def names_part(name: str, part: str, tag: str) -> bool:
    """Does a name inside an article mark what is not article? All its words are marks or
    stand beside them. Ids are also slugs of headings, so those on headings say nothing."""
    words = [w for w in WORDS.findall(part) if w != "header"]
    marks = [w for w in words if w in MARKS]
    if not marks or any(w not in MARKS and w not in BESIDE for w in words):
        return False
    if name != "id":
        return True
    return tag not in HEADINGS and (len(words) > len(marks) or (len(words) == 1 and words[0] in IDS))


def attributes(rest: str, tag: str) -> tuple[str, bool, bool]:
    """(label, marked by any word, marked as part of an article) from what stands in a tag after
    its name."""
    label, word, part = "", False, False
    for name, *values in ATTRIBUTE.findall(rest):
        name, value = name.lower(), "".join(values).lower()
        if name == "aria-hidden":
            word |= value == "true"
            part |= value == "true"
            continue
        words = WORDS.findall(value)
        for piece in value.split():
            if not AROUND.match(piece):
                word |= any(w in MARKS for w in WORDS.findall(piece))
                part |= names_part(name, piece, tag)
        if name != "role":
            label += f".{' '.join(sorted(words))}"
    return label, word, part


def path_token(parent: int, label: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{parent}/{label}") >> 1


def text_token(path: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\n{text}") >> 1


KINDS = {"article": ARTICLE, "h1": HEADING, "html": FRAME, "body": FRAME}


class Element:
    __slots__ = ("tag", "token", "above", "kind", "dropped", "within", "apart", "inside", "link", "labels", "chars", "clean")

    def __init__(self, tag: str, token: int, above: int, kind: int = OTHER):
        self.tag, self.token, self.above, self.kind = tag, token, above, kind
        #: Why it is dropped where names are read; whether it is dropped within a deduced slot; whether an
        #: element within a block, and so a part of the block's text, is dropped.
        self.dropped, self.within, self.apart = 0, False, False
        #: 2 inside an article, 1 if a wrapper around the article is marked.
        self.inside, self.link = 0, False
        self.labels: dict[str, int] = {}
        #: Characters under it that are no links, and those of them that nothing marks.
        self.chars, self.clean = 0, 0


class Page:
    """One pass over a page's tags: ``elements`` in the order of their start, and ``blocks`` (place
    of the element around, text, link characters) in page order."""

    def __init__(self, source: str):
        self.elements = [Element("", ROOT, -1, FRAME)]
        self.blocks: list[tuple[int, str, int]] = []
        #: Open elements, and of them by tag and for blocks the depths at which they stand.
        self.stack = [0]
        self.depths: dict[str, list[int]] = {}
        self.blocks_open: list[int] = []
        self.parts: list[str] = []
        self.links, self.where = 0, 0
        at, end = 0, source.rfind(">") + 1
        while m := TOKEN.search(source, at, end):
            if m.start() > at:
                self.text(entities.unescape(source[at: m.start()]))
            at = m.end()
            if at == end and source.startswith(("<!--", "<![CDATA["), m.start()) and not m[0].endswith(("-->", "]]>")):
                at = len(source)
            if m["tag"]:
                tag = m["tag"].lower()
                if m["end"]:
                    self.end(tag)
                elif tag in RAW:
                    if not m["rest"].endswith("/") or tag in ("script", "style"):
                        stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(source, at)
                        at = stop.end() if stop else len(source)
                else:
                    self.start(tag, m["rest"])
            elif m["cdata"]:
                self.text(m["cdata"])
        if at < len(source):
            self.text(entities.unescape(source[at:]))
        self.flush()
        self.sum_up()

    def text(self, x: str) -> None:
        top = self.elements[self.stack[-1]]
        if top.apart:
            return
        if not self.parts:
            self.where = self.stack[self.blocks_open[-1]] if self.blocks_open else 0
        self.parts.append(x)
        if top.link:
            self.links += len(x.strip())

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((self.where, text, self.links))
        self.parts, self.links = [], 0

    def start(self, tag: str, rest: str) -> None:
        if tag in BLOCKS:
            self.flush()
            self.close({"p"}, SCOPES)
            if tag in CLOSED_BY:
                self.close(CLOSED_BY[tag], SCOPES - {tag})
        if tag == "br":
            self.text(" ")
        if tag in VOID:
            return
        place = self.stack[-1]
        above = self.elements[place]
        label, word, part = attributes(rest, tag) if rest else ("", False, False)
        label = tag + label
        above.labels[label] = nth = above.labels.get(label, 0) + 1
        e = Element(tag, path_token(above.token, f"{label}:{nth}"), place)
        e.kind = KINDS.get(tag, CONTAINER if tag in CONTAINERS else OTHER)
        article, dropped = above.inside, above.dropped
        marked = part if article or tag == "article" else word
        if tag in ("html", "body", "main"):
            marked = False
        e.inside = article
        if tag in ("article", "main") and not article:
            e.inside = 1 if tag == "article" and dropped == MARKED else 2
        if tag == "main" or e.inside != article:
            # whatever wrappers are called; an element like a footer keeps its articles
            dropped = 0 if tag == "main" or dropped == MARKED else dropped
        if tag in DROPPED or (tag == "header" and not article):
            dropped = ELEMENT
        elif marked:
            dropped = dropped or MARKED
        e.dropped = dropped
        e.within = tag in DROPPED or (part and tag not in ("html", "body", "main"))
        e.link = above.link or tag == "a"
        if tag in BLOCKS:
            self.blocks_open.append(len(self.stack))
        else:
            e.apart = above.apart or e.within
        self.depths.setdefault(tag, []).append(len(self.stack))
        self.stack.append(len(self.elements))
        self.elements.append(e)

    def cut(self, depth: int) -> None:
        """Close the open element at a depth and all in it."""
        while len(self.stack) > depth:
            e = self.elements[self.stack.pop()]
            self.depths[e.tag].pop()
            if e.tag in BLOCKS:
                self.blocks_open.pop()

    def innermost(self, tags: set[str]) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def close(self, tags: set[str], stop: set[str]) -> None:
        """Close the innermost open element of ``tags``, if no element of ``stop`` is within."""
        depth = self.innermost(tags)
        if depth and depth > self.innermost(stop - tags):
            self.cut(depth)

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        depth = self.innermost({tag})
        # an inline end tag does not close blocks
        if depth and (tag in BLOCKS or not self.blocks_open or self.blocks_open[-1] < depth):
            self.cut(depth)

    def sum_up(self) -> None:
        for place, text, links in self.blocks:
            own = max(0, len(text) - links)
            e = self.elements[place]
            e.chars += own
            e.clean += 0 if e.dropped else own
        for e in reversed(self.elements[1:]):
            above = self.elements[e.above]
            above.chars += e.chars
            above.clean += e.clean

    def tokens(self) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(token, token around, count, kind, characters, unmarked characters)."""
        for e in self.elements:
            yield e.token, self.elements[e.above].token if e.above >= 0 else ROOT, 1, e.kind, e.chars, e.clean
        texts: dict[tuple[int, int], list[int]] = {}
        for place, text, links in self.blocks:
            e, own = self.elements[place], max(0, len(text) - links)
            sums = texts.setdefault((text_token(e.token, text), e.token), [0, 0, 0])
            sums[0] += 1
            sums[1] += own
            sums[2] += 0 if e.dropped else own
        for (token, path), (n, chars, clean) in texts.items():
            yield token, path, n, TEXT, chars, clean


def in_slots(page: Page, slots: set[int], everywhere: set[int]) -> list[str]:
    """Blocks in the slots of a deduced article, without template text and marked parts."""
    under, dropped = [False] * len(page.elements), [False] * len(page.elements)
    for i, e in enumerate(page.elements):
        if e.above >= 0:
            under[i], dropped[i] = under[e.above], dropped[e.above]
        if e.token in slots:
            under[i], dropped[i] = True, False
        elif under[i]:
            dropped[i] = dropped[i] or e.within
    return [text for place, text, _ in page.blocks
            if under[place] and not dropped[place] and text_token(page.elements[place].token, text) not in everywhere]


def by_names(page: Page, everywhere: set[int], often: set[int], marks: bool) -> list[str]:
    """Blocks that the names of elements leave, without template text."""
    blocks = [(page.elements[place], text, links) for place, text, links in page.blocks]
    blocks = [b for b in blocks if b[0].dropped != ELEMENT and (not marks or not b[0].dropped)]
    article = max((e.inside for e, _, _ in blocks), default=0)
    out = []
    for e, text, links in blocks:
        if e.inside < article or (not e.inside and links > LINKS * len(text)):
            continue
        token = text_token(e.token, text)
        if token not in everywhere and (e.inside or token not in often):
            out.append(text)
    return out


def main_text(page: Page, slots: set[int], everywhere: set[int], often: set[int]) -> str:
    return "\n".join(
        (slots and in_slots(page, slots, everywhere)) or by_names(page, everywhere, often, True)
        or by_names(page, set(), set(), True) or by_names(page, everywhere, often, False)
        or by_names(page, set(), set(), False))


TOKEN_FIELDS = ("token", "parent", "n", "kind", "chars", "clean")
TOKENS = ArrayType(StructType([StructField(f, IntegerType() if f in ("n", "kind") else LongType()) for f in TOKEN_FIELDS]))


@F.pandas_udf(TOKENS)
def page_tokens(html: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(TOKEN_FIELDS, t, strict=True)) for t in Page(x or "").tokens()] for x in html], dtype=object)


@F.pandas_udf(StringType())
def slots_text(html: pd.Series, slots: pd.Series, everywhere: pd.Series, often: pd.Series) -> pd.Series:
    some = lambda x: set(x.tolist() if isinstance(x, np.ndarray) else x) if x is not None else set()
    return pd.Series([main_text(Page(h or ""), some(s), some(a), some(b))
                      for h, s, a, b in zip(html, slots, everywhere, often, strict=True)])


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def equivalence_classes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, token, parent, kind, class, chars, clean, n_pages, n_host) of tokens on ``MIN_PAGES``
    pages or more. ``class`` stands for the occurrence vector, ``chars`` and ``clean`` are sums."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.xxhash64(*pages.columns).alias("page"),
                        page_tokens(F.col(html)).alias("tokens"))
    rows = rows.filter("host IS NOT NULL").select("host", "page", F.explode("tokens").alias("t")).select("host", "page", "t.*")
    part = F.xxhash64("page", "n")
    low, high = part.bitwiseAND(F.lit((1 << 31) - 1)), F.shiftrightunsigned(part, 33)
    tokens = rows.groupBy("host", "token").agg(
        F.min("parent").alias("parent"), F.max("kind").alias("kind"), F.count("*").alias("n_pages"),
        F.sum(low).alias("_low"), F.sum(high).alias("_high"), F.sum("n").alias("_n"),
        F.sum("chars").alias("chars"), F.sum("clean").alias("clean"))
    tokens = tokens.filter(F.col("n_pages") >= MIN_PAGES).withColumn(
        "class", F.xxhash64("_low", "_high", "_n", "n_pages")).drop("_low", "_high", "_n")
    tokens = staged(tokens, "page-tokens")
    sizes = tokens.filter(F.col("token") == ROOT).select("host", F.col("n_pages").alias("n_host"))
    return tokens.join(sizes, "host")


def valid_classes(classes: DataFrame) -> DataFrame:
    """(host, class, n_tokens, inside): classes that nest; ``inside`` is the class around one,
    null for the outermost."""
    above = classes.select("host", F.col("token").alias("parent"), F.col("class").alias("_above"))
    nested = classes.join(above, ["host", "parent"], "left")
    other = F.when(~F.col("_above").eqNullSafe(F.col("class")), F.coalesce("_above", F.lit(-1).cast("long")))
    return (nested.groupBy("host", "class").agg(
                F.count("*").alias("n_tokens"), F.min(other).alias("inside"), F.max(other).alias("_last"))
            .filter((F.col("n_tokens") >= MIN_TOKENS) & F.col("inside").eqNullSafe(F.col("_last"))).drop("_last"))


def deduced(tokens: list[dict]) -> set[int]:
    """The elements whose slots hold the article, from the template of one host: tokens of its valid
    classes. Empty if no container stands out."""
    elements = {t["token"]: t for t in tokens if t["kind"] != TEXT}
    for weight in ("clean", "chars"):
        varying = {k: t[weight] for k, t in elements.items()}
        for t in tokens:  # text of the template varies nowhere above it
            k = t["parent"] if t["kind"] == TEXT else None
            while k in elements:
                varying[k] -= t[weight]
                k = elements[k]["parent"] if k != ROOT else None
        if weight == "clean" and varying.get(ROOT, 0) >= BELIEVED * (
                elements[ROOT]["chars"] - sum(t["chars"] for t in tokens if t["kind"] == TEXT)):
            break
    inner: dict[int, list[int]] = {}
    for k, t in elements.items():
        if k != ROOT:
            inner.setdefault(t["parent"], []).append(k)
    if varying.get(ROOT, 0) <= 0:
        return set()
    way = [ROOT]
    while True:
        boxes = [k for k in inner.get(way[-1], ()) if elements[k]["kind"] >= FRAME]
        best = max(boxes, key=lambda k: (varying[k], -k), default=None)
        share = DOMINANT_IN_FRAME if elements[way[-1]]["kind"] == FRAME else DOMINANT
        if best is None or varying[best] < share * varying[way[-1]]:
            break
        way.append(best)
    articles = [k for k in way if elements[k]["kind"] == ARTICLE]
    slot = articles[-1] if articles else way[-1]
    if elements[slot]["kind"] == FRAME:
        return set()

    def within(k: int) -> Iterator[int]:
        todo = [k]
        while todo:
            yield (k := todo.pop())
            todo += inner.get(k, ())

    own = set(within(slot))
    headings = {k for k, t in elements.items() if t["kind"] == HEADING and varying[k] > 0}
    return {slot} if own & headings else {slot} | headings


def templates(classes: DataFrame) -> DataFrame:
    """(host, slots, everywhere, often): elements that hold the article, and text tokens of the
    template, on all pages of the host and on at least the share ``SUPPORT``. The template of a
    host has no more tokens than two of its pages, and only that forms a group."""
    valid = valid_classes(classes).select("host", "class", F.lit(True).alias("_valid"))
    shared = classes.filter(F.col("n_pages") >= F.col("n_host") * SUPPORT).join(valid, ["host", "class"], "left").filter(
        F.col("_valid") | (F.col("kind") == FRAME))  # html and body are around all of it

    def deduce(group: pa.Table) -> pa.Table:
        tokens = group.to_pylist()
        texts = [t for t in tokens if t["kind"] == TEXT]
        row = {
            "host": tokens[0]["host"],
            "slots": sorted(deduced(tokens)) if any(t["token"] == ROOT for t in tokens) else [],
            "everywhere": sorted(t["token"] for t in texts if t["n_pages"] == t["n_host"]),
            "often": sorted(t["token"] for t in texts),
        }
        return pa.Table.from_pylist([row], schema=pa.schema(
            [("host", pa.string()), *[(c, pa.list_(pa.int64())) for c in ("slots", "everywhere", "often")]]))

    columns = ("host", "token", "parent", "kind", "chars", "clean", "n_pages", "n_host")
    return shared.select(*columns).groupBy("host").applyInArrow(
        deduce, "host string, slots array<long>, everywhere array<long>, often array<long>")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) for each page."""
    bounded_batches(pages)
    found = staged(templates(equivalence_classes(pages.select(key, url, html), url, html)), "templates")
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"),
                        host_of(F.col(url)).alias("_host"))
    # written and read, so the planner knows its size: broadcast while small, else split where skewed
    joined = rows.join(found, F.col("_host") == F.col("host"), "left")
    return joined.select("page_id", "url", slots_text("html", "slots", "everywhere", "often").alias("text"))
