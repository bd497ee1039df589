"""Main text of HTML pages by site template removal.

One tolerant parse turns a page into its text blocks.  Each block knows the container
elements (divisions, sections, lists ...) around it by a hash of the container's whole
subtree.  Spark counts for each host under how many different titles a subtree occurs;
those under many are template, and blocks inside them go.  Titles are counted instead of
pages because copies of one article under several addresses must not make the article
look like a template; paragraphs, headings and other text blocks themselves are never
counted, so a sentence that many articles share stays.  The counts are over all containers,
also those that declare themselves as menu, footer, advert, form, comment and so on; such
names decide on what doesn't recur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, written
from .media import INLINE

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text.
DROPPED = frozenset("nav footer aside form script style noscript template iframe svg button select textarea dialog menu head title object audio video canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Words of a class or id that mark such elements.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices newsletter subscribe subscription signup popup modal overlay "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies discussion discussions widget pagination pager toolbar skip adsbygoogle alert login".split()
)
#: Those of reader comments; in an article, the id of a section counts for no other (it may be the anchor of a heading).
COMMENTS = frozenset("comment comments commentlist disqus respond discussion discussions".split())
#: Those that a paragraph, heading or row of plain text may bear.
SOFT = frozenset("alert banner reply replies respond related menu toolbar widget login skip".split())
#: Words that may stand beside one of them in such a name (``related-posts``); others (``related-work``) make it no mark.
BESIDE = frozenset("list box container wrapper wrap section area block inner outer site page main top bottom left right global primary secondary link links bar post posts article articles story stories content item items thread count icon icons button buttons unit slot group row col column header title js user users reader readers".split())
#: And those that do so outside an article.
OUTER_MARKS = frozenset("header topbar search".split())
ROOTS = frozenset(("html", "body", "article", "main", "#page"))
#: Blocks of text; their subtrees aren't counted as templates.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th tr tbody thead dt dd figcaption figure address".split())
#: Neither are these in an article or main part, nor plain divisions of text there.
CONTENT = frozenset("ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What stays of the header of an article or main part.
LEAD = HEADINGS | {"p"}
#: Elements without text of the page; they make no blocks at all.
SILENT = frozenset("script style noscript template iframe svg head title object audio video canvas select textarea button".split())
#: Elements that stand before the text: these tags end one that was left open, and so does the page's end for the tags of RUNNING in it.
BEFORE_TEXT, AFTER_MENU, RUNNING = frozenset(("nav", "menu")), frozenset(("article", "main", "footer")), frozenset("h1 p blockquote pre".split())
#: An opening tag of the key closes open elements of the value, up to the nearest of LIMITS.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"},
}
LIMITS = frozenset("html body table ul ol dl div section article main nav aside header footer select form".split())
#: Opening any of these closes an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
WORD = re.compile(r"[a-z0-9]+")


#: Why a block goes: it may come back if only a form is around it and that holds most of the page's text.
KEPT, IN_FORM, GONE = 0, 1, 2


def marks(names: str) -> set[str]:
    """Words of class names and ids that declare an element to be no main text."""
    found: set[str] = set()
    for name in names.lower().split():
        words = set(WORD.findall(name))
        if words <= MARKS | OUTER_MARKS | BESIDE:
            found |= words
    return found


class _Element:
    __slots__ = ("tag", "dropped", "inside", "hash_id", "region", "nested", "gone", "header", "silent", "unclosed")

    def __init__(self, tag, dropped, name, region, gone=False, header=False, silent=False):
        # ``inside``: its tag and class, its texts, and the hashes of the elements in it
        self.tag, self.dropped, self.inside, self.hash_id, self.region, self.nested = tag, dropped, [name], None, region, False
        self.gone, self.header, self.silent, self.unclosed = gone, header, silent, False


class Page(HTMLParser):
    """Text blocks of a page in order: (text, containers around it, why its name makes it go, elements whose names do)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [_Element("#page", KEPT, "", "")]
        self.muted: list[str] = []  # open hidden elements inside a block, and their like in them
        self.blocks, self.hashes, self.parts, self.title, self.heading = [], [], [], [], []
        self.owner = self.open[0]

    def flush(self) -> None:
        self.muted = []
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                inside = self.open[-1]
                if not inside.silent:
                    beside = inside.header and inside.tag not in LEAD
                    self.blocks.append((text, [e for e in self.open if e.hash_id is not None], GONE if beside else inside.dropped, inside.tag, [e for e in self.open if e.gone]))
                if inside.tag == "h1" and not inside.dropped:
                    self.heading.append(text)

    def close_to(self, k: int, by_tag: bool = False) -> None:
        """Close the open elements from place ``k``, that at ``k`` perhaps by its own end tag."""
        self.flush()
        while len(self.open) > k:
            e = self.open.pop()
            e.unclosed = not by_tag or len(self.open) > k
            own = xxhash.xxh64_intdigest("\0".join(e.inside).encode(errors="replace"))
            self.open[-1].inside.append(f"{own:x}")
            if e.hash_id is not None and (e.nested or not e.region):
                self.hashes[e.hash_id] = own

    def handle_starttag(self, tag, attrs):
        if tag in VOID or tag in INLINE:
            if tag == "br":
                self.parts.append(" ")
            if tag in VOID and tag not in INLINE and tag not in ("img", "input", "wbr"):
                self.flush()
            elif tag not in VOID and (tag in self.muted or self.hidden({k: v or "" for k, v in attrs})):
                self.muted.append(tag)
            return
        if tag in ENDS_P:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == "p":
                    self.close_to(k)
                    break
                if self.open[k].tag in LIMITS:
                    break
        for k in range(len(self.open) - 1, 0, -1) if tag in CLOSES else ():
            if self.open[k].tag in CLOSES[tag]:
                self.close_to(k)
            elif self.open[k].tag in LIMITS:
                break
        if tag in AFTER_MENU:
            menu = next((k for k, e in enumerate(self.open) if e.tag in BEFORE_TEXT), None)
            if menu is not None:
                self.close_to(menu)
        self.flush()
        above, given = self.open[-1], {k: v or "" for k, v in attrs}
        region = "article" if tag == "article" else "main" if above.region != "article" and (tag == "main" or given.get("role") == "main") else above.region
        gone = (
            (tag in DROPPED and tag != "form")
            or (tag == "header" and not region)
            or self.named(tag, given, region)
            or given.get("role", "").lower() in ROLES
            or self.hidden(given)
        )
        dropped = max(above.dropped, GONE if gone else IN_FORM if tag == "form" else KEPT)
        e = _Element(tag, dropped, f"{tag} {given.get('class', '')}", region, gone, above.header or tag == "header", above.silent or tag in SILENT)
        above.nested = True
        if tag not in ROOTS and tag not in TEXT_BLOCKS and tag != "head" and not (region and tag in CONTENT):
            e.hash_id = len(self.hashes)
            self.hashes.append(None)  # stays so if the subtree isn't to be counted
        self.open.append(e)

    @staticmethod
    def named(tag: str, given: dict[str, str], region: str) -> bool:
        """Whether class or id declare an element to be no main text."""
        by_class = marks(given.get("class", ""))
        if tag in TEXT_BLOCKS:
            return bool(by_class & MARKS - SOFT)
        if tag in ROOTS and tag != "article":
            return False
        by_id = marks(given.get("id", ""))
        if tag == "section" and region:
            by_id &= COMMENTS
        return bool((by_class | by_id) & (MARKS if region else MARKS | OUTER_MARKS))

    @staticmethod
    def hidden(given: dict[str, str]) -> bool:
        style = given.get("style", "").replace(" ", "").lower()
        return "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in INLINE:
            if tag in self.muted:
                del self.muted[len(self.muted) - 1 - self.muted[::-1].index(tag) :]
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self.close_to(k, by_tag=True)
                return

    def handle_data(self, data):
        if self.open[-1].tag == "title":
            self.title.append(data)
        if not self.muted:
            self.parts.append(data)
        self.open[-1].inside.append(data.strip())


def parse(html: str | None) -> tuple[list[tuple[str | None, list[int]]], list[int], int]:
    """Blocks (text, subtree hashes around it), all subtree hashes, and a hash of the title.

    The text of a block that goes by a name is None.  The title is that of the page and its
    main headings that aren't dropped.
    """
    page = Page()
    page.feed(html or "")
    page.close()
    page.close_to(1)
    page.flush()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    hashes = [None if h is None else signed(h) for h in page.hashes]
    swallowed = lambda tag, causes: tag in RUNNING and bool(causes) and all(e.unclosed and e.tag in BEFORE_TEXT for e in causes)
    found = [(t, around, KEPT if d == GONE and swallowed(tag, causes) else d) for t, around, d, tag, causes in page.blocks]
    mass = [sum(len(t) for t, _, d in found if d == kind) for kind in (KEPT, IN_FORM)]
    most = IN_FORM if mass[1] > mass[0] else KEPT  # a page wrapped in a form has its text there
    blocks = [(t if d <= most else None, [h for e in around if (h := hashes[e.hash_id]) is not None]) for t, around, d in found]
    name = " ".join(" ".join([*page.title, *page.heading]).split())
    return blocks, sorted(set(hashes) - {None}), signed(xxhash.xxh64_intdigest(name.encode(errors="replace")))


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


BLOCK_TYPE = pa.list_(pa.struct([("text", pa.string()), ("around", pa.list_(pa.int64()))]))


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, row, host, title, blocks, hashes`` of every whole page; ``row`` numbers the rows."""
    kind = pages.schema.fields[pages.columns.index(id_col)].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [parse(h.as_py()) for h in part.column("h")]
                urls = part.column("u")
                blocks = pa.array([[{"text": t, "around": a} for t, a in b] for b, _, _ in found], BLOCK_TYPE)
                columns = [pa.array(range(row, row + len(part)), pa.int64()), pa.array([host_of(u.as_py()) for u in urls]), pa.array([t for _, _, t in found], pa.int64()), blocks, pa.array([h for _, h, _ in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("k"), urls, *columns], ["page_id", "url", "row", "host", "title", "blocks", "hashes"])
                row += len(part)

    schema = f"page_id {kind}, url string, row bigint, host string, title bigint, blocks array<struct<text: string, around: array<bigint>>>, hashes array<bigint>"
    return pick(pages, k=id_col, u=url_col, h=html_col).mapInArrow(run, schema)


#: A subtree that stands on very many pages of a host is dealt over so many keys when pages are joined with templates.
SALTS = 16


def templates(parsed_: DataFrame, least_titles: int = 3) -> DataFrame:
    """``host, hash`` of subtrees that occur under at least so many of their host's titles, however many it has."""
    each = parsed_.select("host", "title", F.explode("hashes").alias("hash")).distinct()
    return each.groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= least_titles).select("host", "hash")


def _around(blocks: str | Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(blocks, lambda b: b["around"])))


def _template_hashes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``row, gone`` of ``rows (row, host, around)``: those hashes of ``around`` that are of templates, where there are any."""
    salted = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    each = rows.select("row", "host", F.explode("around").alias("hash"), F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
    return each.join(salted, ["host", "hash", "salt"], "left_semi").groupBy("row").agg(F.collect_set("hash").alias("gone"))


def _in_template(block: Column) -> Column:
    return F.arrays_overlap(block["around"], F.coalesce("gone", F.array().cast("array<bigint>")))


def reasons(store: DataFrame) -> DataFrame:
    """``host, row, n_kept, n_template, n_named`` of every row of :func:`parsed`: blocks that stay, that are in a template, and that only a name removes.

    It shuffles hashes only, no texts.
    """
    narrow = F.transform("blocks", lambda b: F.struct(b["around"].alias("around"), b["text"].isNull().alias("named")))
    gone = _template_hashes(store.select("row", "host", _around("blocks").alias("around")), templates(store))
    rows = store.select("host", "row", narrow.alias("blocks")).join(gone, "row", "left")
    count = lambda test: F.size(F.filter("blocks", test))
    return rows.select(
        "host", "row",
        count(lambda b: ~_in_template(b) & ~b["named"]).alias("n_kept"), count(_in_template).alias("n_template"), count(lambda b: ~_in_template(b) & b["named"]).alias("n_named"),
    )


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page: its main blocks in order, joined by an empty line.

    A block goes if it is in a template of its host or, failing that, if a name says so.  A
    null or empty page has an empty text; pages with a null address share one host.  Repeated
    rows stay; an empty table gives an empty table.
    """
    store = written(parsed(pages, id_col, url_col, html_col), "pages")
    # The texts of a page need to meet its templates only if some that no name removes stand in containers.
    unnamed = F.filter("blocks", lambda b: b["text"].isNotNull())
    around = _around(unnamed)
    gone = _template_hashes(store.select("row", "host", around.alias("around")), templates(store))
    plain = F.size(around) == 0
    kept = lambda rows, blocks: rows.select("page_id", "url", F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n").alias("text"))
    left = F.filter(unnamed, lambda b: ~_in_template(b))
    out = kept(store.filter(plain), unnamed).unionByName(kept(store.filter(~plain).join(gone, "row", "left"), left))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
