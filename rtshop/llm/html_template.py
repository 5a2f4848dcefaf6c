"""Main text of web pages by template deduction from equivalence classes.

A page is a sequence of tokens: elements, told apart by their path of structural elements with class and id, and text
nodes, told apart by path and text. Over the pages of a host a token has an occurrence vector, its count on each page.
Tokens with one vector form an equivalence class, whose tokens stand or fall together: a class is valid if many of the
host's pages have it and if it has an element, that is, if its texts come and go with a part of the page's layout. A
text that many pages happen to share, alone in its class, is no template. Valid classes are nested into the host's
template, each into the innermost element that holds it by path and position; what the texts of the template leave open
below an element is its slots.

The article is in the slots. Where pages name their article (``article``, else ``main``), all containers so named are it,
but for those that have no slot on the whole host while others have: they say the same on each page. Otherwise the
article is every slot that is not in an element of layout. Inside a named container all text stays, also what pages share.

Elements of layout are known by a fixed list of element names, roles and class words. Class words say nothing about
``html``, ``body``, ``main`` and ``article``, about what holds the only ones of the last two, or about what holds half of the
page's text.

Vectors are never gathered: a token's vector is known by its support and by two order-free sums (exclusive-or of hashes
of page and count), so a host with a third of all pages is a partial aggregate like any other. Tokens on fewer than
``SUPPORT`` of a host's pages are dropped, which bounds a template by twice the tokens of a page. Pages meet their
host's template in a join on the host, which may be split at a hot one.

Defined results
---------------
* Null or empty html gives an empty text. Pages with a null or unusable url form one host, "".
* Hosts of fewer than ``TEXT_PAGES`` pages have no template. Article text does not depend on the number of pages: what a template
  takes away are texts outside named containers that come with an element on most pages.
* If nothing else is left of a page, its layout's text is taken rather than none: copies of one page are no template.
* Repeated rows each get their row. An empty table gives an empty result. Other columns pass through where kept, whatever
  their names; ``text`` and ``n_chars`` are replaced.
* Unclosed elements end with the element around them; a page cut off in the middle of a tag ends there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rtshop.llm.common import add_columns, staged
from rtshop.llm.url_filter import host_of

# Share of a host's pages that must have a token for it to belong to the template, and pages that a template needs.
SUPPORT = 0.5
TEXT_PAGES = 5
# Share of a page's text that makes an element more than layout, whatever its class says; share of links that makes a list a menu.
MOST, LINKED = 0.5, 0.8

# Elements by what they are to the layout of a page.
STRUCTURE = frozenset("html body div section article main nav header footer aside form ul ol dl table tbody thead tr td "
                      "th figure details fieldset dialog center".split())
BLOCKS = STRUCTURE | frozenset("address blockquote br caption dd dt figcaption h1 h2 h3 h4 h5 h6 hr legend li p pre "
                               "summary title option".split())
DROPPED = frozenset("nav footer aside form dialog head button select menu".split())
RAW = "script|style|noscript|template|iframe|svg|textarea|object|canvas|title"
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
CLASS_WORDS = frozenset("""ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promotion
    sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices banner
    popup modal overlay newsletter subscribe subscription signup login social share sharing comment comments reply replies
    respond disqus related recommended widget pagination pager skip""".split())
# Words that name a layout element together with those above; any other word beside one of them names something else,
# as in related-work, has-sidebar or comments-open.
PART_WORDS = frozenset("""area article articles bar block body bottom box button buttons center col column container content
    dialog element footer google group header icons inner item items left link links list main outer page panel part
    policy post posts reader readers right row section site slot stories sub tags text the title top unit user users wrap
    wrapper your""".split())
NAMED = ("article", "main")
# Their class and id say how the page is laid out, not what they are.
WHOLE = frozenset(("html", "body", *NAMED))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + RAW + r")\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<more>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Za-z]+")


class Element:
    """A structural element of a page; ``chars`` and ``linked`` count its own text, then all text below it."""

    __slots__ = ("tag", "up", "path", "label", "layout", "marked", "names", "chars", "linked", "dropped")

    def __init__(self, tag: str, up: int, path: int, label: str, layout: bool, marked: bool):
        self.tag, self.up, self.path, self.label, self.layout, self.marked = tag, up, path, label, layout, marked
        self.names, self.chars, self.linked, self.dropped = tag in NAMED, 0, 0, False


def path_hash(parent: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label.encode("utf-8", "replace"), parent & 0xFFFFFFFF) - (1 << 63)


def layout_name(value: str) -> bool:
    """Whether one of the names in a class or id is that of a layout element."""
    for name in value.split():
        words = WORDS.findall(name)
        if not CLASS_WORDS.isdisjoint(words) and all(w in CLASS_WORDS or w in PART_WORDS for w in words):
            return True
    return False


def look(tag: str, more: str) -> tuple[str, bool, bool]:
    """(label of an element, whether its role is one of layout, whether its class or id is)."""
    if not more or ("class" not in more and "id" not in more and "role" not in more and more.islower()):
        return tag, False, False
    label, role, marked = tag, False, False
    for name, *values in ATTRIBUTE.findall(more):
        name, value = name.lower(), "".join(values).lower()
        if name == "role":
            role |= value in ROLES
            label += "@" + value
        else:
            marked |= tag not in WHOLE and layout_name(value)
            # Numbers in ids differ from page to page; the words do not.
            label += ("." if name == "class" else "#") + "-".join(WORDS.findall(value))
    return label, role, marked


class Page:
    """A page's elements in order, the first one standing for the page, and its events: ``(element, text)``, text None
    where a block begins or ends, ``""`` where the element itself begins."""

    def __init__(self, html: str):
        self.elements = [Element("", -1, 0, "", False, False)]
        self.events: list[tuple[int, str | None]] = []
        self._read(html)
        self._judge()

    def _read(self, html: str) -> None:
        stack, at, links = [0], 0, 0
        for found in TOKEN.finditer(html):
            if found.start() > at:
                self._text(stack[-1], html[at:found.start()], links > 0)
            at = found.end()
            tag = found["tag"]
            if not tag:
                continue
            tag = tag.lower()
            if tag in STRUCTURE or tag in DROPPED:
                if found["end"]:
                    for k in range(len(stack) - 1, 0, -1):
                        if self.elements[stack[k]].tag == tag:
                            del stack[k:]
                            break
                else:
                    label, role, marked = look(tag, found["more"])
                    up = self.elements[stack[-1]]
                    self.elements.append(Element(tag, stack[-1], path_hash(up.path, label), label, role or tag in DROPPED, marked))
                    self.events.append((len(self.elements) - 1, ""))
                    if not found["more"].rstrip().endswith("/"):
                        stack.append(len(self.elements) - 1)
                    links = 0
                self.events.append((stack[-1], None))
            elif tag in BLOCKS:
                self.events.append((stack[-1], None))
            elif tag == "a":
                links = 0 if found["end"] else 1
        if at < len(html):
            self._text(stack[-1], html[at:], links > 0)

    def _text(self, place: int, value: str, linked: bool) -> None:
        self.events.append((place, value))
        n = len(value) - value.count(" ")
        self.elements[place].chars += n
        self.elements[place].linked += n * linked

    def _judge(self) -> None:
        """Tell which elements are layout, from the inside out and then from the outside in."""
        for own in reversed(self.elements[1:]):
            up = self.elements[own.up]
            if not own.layout:
                up.chars += own.chars
                up.linked += own.linked
                up.names |= own.names
        whole, inside = self.elements[0].chars, [False] * len(self.elements)
        clear, found = [True], False
        for own in self.elements[1:]:
            clear.append(clear[own.up] and not own.layout and (not own.marked or own.chars >= MOST * whole))
            found |= clear[-1] and own.tag in NAMED
        for i, own in enumerate(self.elements[1:], 1):
            up = self.elements[own.up]
            # What holds the only articles of a page is no layout; reader comments may be articles beside it.
            holds = own.names and not found
            spared = holds or own.chars >= MOST * whole
            # A header inside an article holds its title; one around the page does not.
            heading = own.tag == "header" and not inside[own.up] and not holds
            own.dropped = up.dropped or own.layout or (own.marked and not spared) or heading
            inside[i] = (inside[own.up] or own.tag in NAMED) and not own.dropped

    def within(self, tag: str, flat: frozenset[int]) -> list[bool]:
        """For each element whether it is in a container ``tag`` that is not one of ``flat``."""
        held = [False]
        for own in self.elements[1:]:
            held.append(held[own.up] or (own.tag == tag and own.path not in flat))
        return held

    def menus(self) -> list[bool]:
        """For each element whether it is in a list or table that is little more than links."""
        held = [False]
        for own in self.elements[1:]:
            links = own.tag in ("ul", "ol", "table", "dl") and own.chars and own.linked >= LINKED * own.chars
            held.append(held[own.up] or bool(links))
        return held


def clean(raw: str) -> str:
    return " ".join(unescape(raw).split()) if "&" in raw else " ".join(raw.split())


TOKENS = ("host string, page long, token long, parent long, label string, named string, dropped boolean, n int, "
          "place int, chars long")


def page_tokens(html: str) -> dict[int, list]:
    """Tokens of a page: token to [parent, label, named, dropped, count, first place, characters of text below]."""
    page, tokens = Page(html), {}
    for place, (i, value) in enumerate(page.events):
        own = page.elements[i]
        if value == "":
            named = own.tag if own.tag in NAMED else None
            token = tokens.setdefault(own.path, [page.elements[own.up].path, own.label, named, own.dropped, 0, place, 0])
            token[4] += 1
            token[6] += own.chars
        elif value is not None and (text := clean(value)):
            size = len(value) - value.count(" ")
            token = tokens.setdefault(path_hash(own.path, "\0" + text), [own.path, None, None, own.dropped, 0, place, 0])
            token[4] += 1
            token[6] += size
    return tokens


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in TOKENS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(),
             pa.int64()]
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        for host, page, html in zip(*(c.to_pylist() for c in batch.columns)):
            # Token 0 stands for the page itself: its support is the number of pages of the host.
            for values in ((0, 0, None, None, False, 1, 0, 0), *((t, *v) for t, v in page_tokens(html or "").items())):
                for column, value in zip(rows, (host, page, *values)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)


def equivalence_classes(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``host, pages, classes``: a host's frequent classes, each with its support and its tokens.

    One row a host; a token is in it only when ``support`` of the host's pages have it.
    """
    key = F.xxhash64("page_id", "url")
    tokens = pages.select(host_of(F.col("url")).alias("host"), key.alias("page"), "html").mapInArrow(_token_rows, TOKENS)
    vectors = tokens.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("support"), F.bit_xor(F.xxhash64("page", "n")).alias("one"),
        F.bit_xor(F.xxhash64("n", "page")).alias("two"), F.min("parent").alias("parent"), F.min("label").alias("label"),
        F.max("named").alias("named"), F.max("dropped").alias("dropped"), F.avg("place").alias("place"),
        F.sum("chars").alias("chars"))
    vectors = staged(vectors.filter("support > 1 or token = 0"), "vectors")
    hosts = vectors.filter("token = 0").select("host", F.col("support").alias("pages"))
    frequent = (vectors.filter("token != 0").join(hosts, "host")
                .filter((F.col("support") >= support * F.col("pages")) & (F.col("pages") > 1)))
    members = F.struct("token", "parent", "label", "named", "dropped", "place", "chars")
    classes = frequent.groupBy("host", "pages", "support", "one", "two").agg(F.sort_array(F.collect_list(members)).alias("tokens"))
    return classes.groupBy("host", "pages").agg(F.collect_list(F.struct("support", "tokens")).alias("classes"))


def nested(classes: list[dict]) -> list[dict]:
    """The valid classes as a template: tokens of elements and texts, each with ``slots``, the characters below an element
    that the template leaves open.

    A class is valid if it has an element; its tokens then all belong to the template. Classes nest by path: a token is
    below the elements on its path, those of its own class and of classes around it, in order of their place.
    """
    valid = [c for c in classes if any(t["label"] is not None for t in c["tokens"])]
    tokens = sorted((dict(t, slots=t["chars"] if t["label"] is not None else 0) for c in valid for t in c["tokens"]),
                    key=lambda t: (t["place"], t["token"]))
    elements = {t["token"]: t for t in tokens if t["label"] is not None}
    for text in tokens:
        at = text["parent"] if text["label"] is None else None
        while at in elements:
            elements[at]["slots"] -= text["chars"]
            at = elements[at]["parent"]
    return tokens


def deduce(pages: int, classes: list[dict]) -> tuple[list[int], list[int]]:
    """(named containers without a slot where others have one, texts of the template) from a host's classes."""
    if pages < TEXT_PAGES:
        return [], []
    template = nested(classes)
    flat = []
    for tag in NAMED:
        named = [t for t in template if t["named"] == tag and not t["dropped"]]
        if any(t["slots"] > 0 for t in named):
            flat += [t["token"] for t in named if t["slots"] <= 0]
    return flat, [t["token"] for t in template if t["label"] is None]


def templates(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``host, flat, texts``: what the template of every host with two pages at least says (see ``deduce``)."""
    schema = "host string, flat array<long>, texts array<long>"
    types = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(host, *deduce(n, own)) for host, n, own in zip(*(c.to_pylist() for c in batch.columns))]
            made = zip(*rows) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(made, types)],
                                             names=["host", "flat", "texts"])

    return equivalence_classes(pages, support).mapInArrow(nest, schema)


def main_text(html: str | None, flat: list[int] | None = None, texts: list[int] | None = None) -> str:
    """Text of the page's article: its named containers with slots, or else all slots that are not layout."""
    if not html:
        return ""
    page, same, known = Page(html), frozenset(flat or ()), frozenset(texts or ())
    kept = [not e.dropped for e in page.elements]
    for tag in NAMED:
        # Containers that say the same on all pages count where the page has no others.
        for out in (same, frozenset()):
            if text := _join(page, [a and b for a, b in zip(kept, page.within(tag, out))]):
                return text
    open_to = [a and not b for a, b in zip(kept, page.menus())]
    layout = [not e.layout for e in page.elements]
    for i, own in enumerate(page.elements[1:], 1):
        layout[i] = layout[i] and layout[own.up]
    for elements, out in ((open_to, known), (open_to, frozenset()), (kept, frozenset()), (layout, frozenset())):
        if text := _join(page, elements, out):
            return text
    return ""


def _join(page: Page, elements: list[bool], without: frozenset[int] = frozenset()) -> str:
    """The text of the given elements, blocks apart, without texts of the template."""
    parts = []
    for i, value in page.events:
        if value is None:
            parts.append(" ")
        elif value and elements[i] and not (without and path_hash(page.elements[i].path, "\0" + clean(value)) in without):
            parts.append(value)
    return clean("".join(parts))


FIELDS = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]


def extract(pages: DataFrame, support: float = SUPPORT, keep: list[str] | None = None) -> DataFrame:
    """Add ``text`` and ``n_chars``, the article of each page and its length in code points, to ``pages``."""
    kept = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]
    known = staged(templates(pages.select("page_id", "url", "html"), support), "templates").select(
        F.col("host").alias("llm_host"), F.col("flat").alias("llm_flat"), F.col("texts").alias("llm_texts"))
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(0)
    rows = pages.select(row.alias("llm_row"), F.col("html").alias("llm_html"), host_of(F.col("url")).alias("llm_of"))
    joined = rows.join(known, F.col("llm_of") == F.col("llm_host"), "left")

    def cut(html: pa.Array, flat: pa.Array, texts: pa.Array) -> list:
        found = [main_text(*row) for row in zip(*(c.to_pylist() for c in (html, flat, texts)))]
        return [found, [len(t) for t in found]]

    made = add_columns(joined, cut, FIELDS, ["llm_html", "llm_flat", "llm_texts"], ["llm_row"])
    return made.select(*[F.col("llm_row")[c].alias(c) for c in kept], "text", "n_chars")
