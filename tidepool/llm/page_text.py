"""Main text of web pages: differencing of pages whose URLs are nearest, beside what markup itself says.

Pages of a host are put in order of their URL paths; each is compared with up to two pages before and two after it. A
longest common subsequence aligns the blocks of two pages outside their articles, and blocks shared with most of these
pages are deleted: menus, notices and other furniture that a site repeats. What markup names (nav, footer, aside, forms,
class names of adverts, comments and the like) goes, too, whether shared or not; what it names as the article stays, as
articles of a host quote the same passages.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_side, settle, table
from .vectors import groups, parts

# Fixed sets of HTML's vocabulary.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption head html legend option tbody td tfoot th thead tr".split())
HIDDEN = frozenset("script style head title template noscript iframe object svg math canvas audio video map".split())  # never text of the page
ASIDE = frozenset("nav footer aside form button select textarea datalist dialog menu search".split())  # text, but not of the article
# What an open element of one kind is closed by: the next of its kind, within the element that holds them.
SIBLINGS = {tag: (closed.split(), holders.split()) for tag, closed, holders in [("li", "li", "ul ol menu"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("tr", "tr", "table"), ("td", "td th", "tr table"), ("th", "td th", "tr table"), ("option", "option", "select datalist")]}
HOLD_P = frozenset("article section div td th li dd main body button".split())
# Words of class names, ids and roles that sites give to what surrounds an article.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars rail nav navbar navigation menu menus "
    "breadcrumb breadcrumbs masthead header footer cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe signup "
    "login search searchbox share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus widget widgets toolbar "
    "pagination pager contentinfo complementary topbar skip".split()
)
TITLES = frozenset("header masthead banner topbar".split())  # in an article these hold its title
FIRM = frozenset("comment comments commentlist reply replies respond disqus related recommended recommendations".split())  # and their articles, too
WORDS = re.compile(r"[a-z]+").findall
OUTSIDE, INSIDE, FURNITURE = 0, 1, 2  # of the article; FURNITURE: by its markup


class Element:
    __slots__ = ("tag", "named", "asides", "hidden", "article", "main", "firm")

    def __init__(self, tag: str):
        self.tag = tag
        self.named = self.asides = self.hidden = self.article = self.main = self.firm = False


@lru_cache(maxsize=4096)
def names_of(attributes: tuple) -> frozenset[str]:
    """The words of an element's class names, id and role, without names that speak of something else ("has-sidebar")."""
    out: set[str] = set()
    for key, value in attributes:
        if key in ("class", "id", "role") and value:
            for name in re.sub("([a-z0-9])([A-Z])", r"\1-\2", value).lower().split():
                found = WORDS(name)
                if found and found[0] not in ("has", "with", "no", "is", "without"):
                    out.update(found)
    return frozenset(out)


class Page(HTMLParser):
    """Blocks of a page: text, whether in an article, whether in main, and the elements that may set it aside."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Element] = []
        self.text: list[str] = []
        self.blocks: list[tuple] = []
        self.hidden = 0  # open elements without text of the page

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text.clear()
            if text:
                asides = [e for e in self.open if e.named or e.asides]
                self.blocks.append((text, any(e.article for e in self.open), any(e.main for e in self.open), asides))

    def pop_to(self, at: int) -> None:
        if self.text and any(e.tag in BLOCK for e in self.open[at:]):
            self.flush()
        self.hidden -= sum(e.hidden for e in self.open[at:])
        del self.open[at:]

    def handle_starttag(self, tag, attributes):
        if tag in BLOCK:
            self.flush()
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag == "body":  # a head may never have been closed
            self.open = [e for e in self.open if not e.hidden]
            self.hidden = 0
        if tag in CLOSES_P:
            self.close_within(("p",), HOLD_P)
        if tag in SIBLINGS:
            self.close_within(*SIBLINGS[tag])
        e = Element(tag)
        e.hidden = tag in HIDDEN
        if attributes:
            self.look_at(e, attributes)
        if tag in ASIDE:
            e.asides, e.firm = True, tag == "aside"
        elif tag == "header":
            e.asides = not any(x.article for x in self.open)
        elif tag in ("article", "main") or e.article or e.main:
            self.open_main(e)
        self.hidden += e.hidden
        self.open.append(e)

    def look_at(self, e: Element, attributes) -> None:
        for key, value in attributes:
            if key == "hidden" and value != "until-found":
                e.hidden = True
            elif key == "itemprop" and value and "articleBody" in value:
                e.article = True
            elif key == "role" and value == "main":
                e.main = True
        if e.tag not in ("html", "body", "main"):
            names = names_of(tuple(attributes))
            if names:
                e.firm = not FIRM.isdisjoint(names)
                e.named = not NAMED.isdisjoint(names - TITLES if any(x.article for x in self.open) else names)

    def open_main(self, e: Element) -> None:
        inside = any(x.article for x in self.open)
        e.article |= e.tag == "article"
        e.main |= e.tag == "main"
        e.asides = e.tag == "article" and inside  # an article in an article is a reader's comment
        if not e.named and not (e.article and inside):
            for x in self.open:  # what holds the article is no furniture, or was never closed; asides and comments hold articles of their own
                if not x.firm:
                    x.named = x.asides = False

    def close_within(self, tags, holders) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag in tags:
                return self.pop_to(at)
            if self.open[at].tag in holders:
                return None

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)  # HTML ignores the slash
        if tag in ("svg", "math", "iframe", "script"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "p":
            self.flush()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag == tag:
                self.pop_to(at)
                break

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def blocks(html: str | None) -> tuple[list[str], list[int]]:
    """Texts of a page's blocks and the zone of each.

    With an article, what main doesn't hold is furniture; with main alone, what lies outside it.
    """
    page = Page()
    page.feed(html or "")
    page.close()
    page.flush()
    found = [(text, article, main, any(e.named or e.asides for e in asides)) for text, article, main, asides in page.blocks]
    article = any(a and not aside for _, a, _, aside in found)
    main = any(m and not aside for _, _, m, aside in found)
    zones = []
    for _, a, m, aside in found:
        if aside:
            zones.append(FURNITURE)
        elif article:
            zones.append(INSIDE if a else OUTSIDE if m else FURNITURE)
        else:
            zones.append(FURNITURE if main and not m else OUTSIDE)
    return [x[0] for x in found], zones


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of a longest common subsequence of each prefix of a with b: a bit for each place of a, a step for each of b."""
    full = (1 << len(a)) - 1
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    rest = full
    for x in b:
        hit = rest & at.get(x, 0)
        rest = ((rest + hit) | (rest - hit)) & full
    bits = np.unpackbits(np.frombuffer((full ^ rest).to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(bits)])


def common(a: list, b: list) -> list[int]:
    """Places of a that a longest common subsequence of a and b takes, in memory proportional to both."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    middle, other = a[start : len(a) - end], b[start : len(b) - end]
    both = set(middle) & set(other)
    places = [i for i, x in enumerate(middle) if x in both]
    inner = _common([middle[i] for i in places], [x for x in other if x in both])
    return [*range(start), *(start + places[i] for i in inner), *range(len(a) - end, len(a))]


def _common(a: list, b: list) -> list[int]:
    if not a or not b:
        return []
    if len(b) == 1:
        return [a.index(b[0])] if b[0] in a else []
    if len(a) == 1:
        return [0] if a[0] in b else []
    half = len(b) // 2
    fore, back = _lengths(a, b[:half]), _lengths(a[::-1], b[half:][::-1])[::-1]
    cut = int(np.argmax(fore + back))
    return _common(a[:cut], b[:half]) + [cut + i for i in _common(a[cut:], b[half:])]


def host(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


HASHED = np.dtype([("hash", "<u8"), ("chars", "<u4")])


def parsed(pages: DataFrame, texts: bool) -> DataFrame:
    """host, path and page (a hash of all blocks) of each row; and the blocks outside the article as hashes and lengths
    (``shape``), or with ``texts`` the row itself, its blocks that markup doesn't set aside (``at``: place in the shape, -1
    in the article) and how many it does."""
    block = pa.list_(pa.struct([("text", pa.string()), ("at", pa.int32())]))
    kinds = {"page": pa.binary(), "shape": pa.binary(), "blocks": block, "set_aside": pa.int64()}
    names = ["page", "blocks", "set_aside"] if texts else ["page", "shape"]
    kept = ["page_id", "url"] if texts else ["host", "path"]

    def row(html):
        found, zones = blocks(html)
        hashes = [xxhash.xxh64_intdigest(t) for t in found]
        page = xxhash.xxh128_digest(np.array(hashes, "<u8").tobytes() + bytes(zones))
        if not texts:
            return page, np.array([(h, len(t)) for h, t, z in zip(hashes, found, zones) if z != INSIDE], HASHED).tobytes()
        out, at = [], 0
        for text, zone in zip(found, zones):
            if zone != FURNITURE:
                out.append({"text": text, "at": -1 if zone == INSIDE else at})
            at += zone != INSIDE
        return page, out, zones.count(FURNITURE)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # few pages at a time, as each can be long
                part = batch.slice(at, 64)
                out = zip(*map(row, part.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *(pa.array(c, kinds[n]) for c, n in zip(out, names))], [*part.schema.names[1:], *names])

    url = F.col("url")
    source = pages.select("html", F.col("page_id").cast("long"), url, host(url).alias("host")) if texts else pages.select("html", host(url).alias("host"), path(url).alias("path"))
    schema = "page_id long, url string, host string, page binary, blocks array<struct<text: string, at: int>>, set_aside long" if texts else "host string, path string, page binary, shape binary"
    assert all(c in source.columns for c in kept)
    return source.mapInArrow(run, schema)


def votes(mine: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which blocks are shared with two of the other pages, or with all of them.

    Pages that share four fifths of the text of both count as copies, and are left aside while others are at hand.
    """
    found, alike = [], []
    for other in others:
        at = common(mine["hash"].tolist(), other["hash"].tolist())
        chars = int(mine["chars"][at].sum())
        found.append(at)
        alike.append(5 * chars >= 4 * max(int(mine["chars"].sum()), int(other["chars"].sum())))
    used = [at for at, copy in zip(found, alike) if not copy] or found
    count = np.zeros(len(mine), np.int64)
    for at in used:
        count[at] += 1
    return count >= min(2, max(len(used), 1))


def shared_blocks(shapes: DataFrame, reach: int = 2, block: int = 512) -> DataFrame:
    """host, page and shared (for each block of the shape, whether it is template) for shapes(host, path, page, shape).

    Pages of a host are ordered by path; of each, up to ``reach`` on either side are compared. The order of all pages is
    numbered and cut into blocks for the tasks, and each block gets copies of the ``reach`` rows before and after it.
    """
    order = ["host", "path", "page"]
    rows = settle(shapes.select(*order, "shape").repartitionByRange(parts(shapes), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    piece = F.shiftright("at", 33)
    sizes = rows.groupBy(piece.alias("piece")).agg(F.count("*").alias("rows"))  # a row a partition
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("piece", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    place = F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)
    placed = rows.withColumn("piece", piece).join(F.broadcast(first), "piece").select("host", "page", "shape", place.alias("place"))
    near = F.array_distinct(F.array(*[F.floor((F.col("place") + d) / block) for d in (-reach, 0, reach)]))
    dealt = placed.withColumn("block", F.explode(near)).repartition(parts(shapes), "block").sortWithinPartitions("block", "place")

    def run(batches):
        for (number,), place, name, page, shape in groups(batches, ["block"], ["place", "host", "page", "shape"]):
            read = [np.frombuffer(x, HASHED) for x in shape]
            own = [i for i in range(len(place)) if place[i] // block == number]
            out = []
            for i in own:
                others = [j for j in range(max(0, i - reach), min(len(place), i + reach + 1)) if j != i and name[j] == name[i]]
                out.append(votes(read[i], [read[j] for j in others]).tolist() if others else [])
            columns = [pa.array(name[own], pa.string()), pa.array(page[own], pa.binary()), pa.array(out, pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, ["host", "page", "shared"])

    return dealt.select("block", "place", "host", "page", "shape").mapInArrow(run, "host string, page binary, shared array<boolean>")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared, n_set_aside for each row of pages(page_id, url, html).

    Blocks of text are joined by empty lines; white space inside one is a single space. n_shared counts blocks that other
    pages share, n_set_aside those that markup sets aside. Null and empty pages, and those without an article, give an
    empty text; pages of any length are read whole; pages without a host are compared with none; copies within a host
    count as one page; repeated rows and null ids stay; other columns are ignored; an empty table gives an empty result.
    """
    shapes = parsed(pages, texts=False).filter((F.col("host") != "") & (F.length("shape") > 0))
    shapes = shapes.groupBy("host", "page").agg(F.min("path").alias("path"), F.min("shape").alias("shape"))  # equal pages have equal shapes
    found = parsed(pages, texts=True).join(join_side(shared_blocks(shapes)), ["host", "page"], "left")
    left = F.filter("blocks", lambda b: (b["at"] < 0) | ~F.coalesce(F.get("shared", b["at"]), F.lit(False)))
    found = found.select("page_id", "url", F.array_join(F.transform(left, lambda b: b["text"]), "\n\n").alias("text"), F.coalesce(F.size(F.filter("shared", lambda x: x)), F.lit(0)).cast("long").alias("n_shared"), "set_aside")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("n_shared") > 0, F.col("n_shared")).otherwise(0).alias("n_shared"), F.col("set_aside").alias("n_set_aside"))


def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
