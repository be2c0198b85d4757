"""HTML extraction by host-wide consensus on the path of the main container.

Every page is read once, into blocks of text with the path of elements around them (tags with
their class, digits out). A page's candidates are the containers around all of its text outside
link lists, down to an article or main. It votes for the outermost one that differs from the
innermost in nothing, votes are summed per host and path in Spark, and each page gives the
text of its candidate with the most votes. So what a host's vote decides is which link lists belong to
the article; no other text is left out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import lookup, stored, table
from packetloom.llm.url_templates import host_and_path

#: What `best` asks of a container; votes and texts don't depend on it.
MAJORITY = 0.75
#: Containers that are the article: no vote goes below them.
ARTICLE = {"article", "main"}

#: Elements whose text is no text of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "xmp"}
#: Elements beside the article, and words in class, id or role that say so.
DROP = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "input", "label", "dialog", "menu", "head"}
DROP_WORDS = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "header", "masthead",
    "footer", "sidebar", "aside", "widget", "related", "recommended", "ad", "ads", "adv", "advert", "adverts",
    "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "share",
    "sharing", "social", "comment", "comments", "commentlist", "disqus", "respond", "login", "signup", "search", "toc",
}
#: Beside one of these pieces of a class such a word says nothing of the element: with-sidebar, ad-free.
BEFORE = {"with", "without", "has", "have", "no", "not", "non", "hide"}
AFTER = {"free", "less"}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "td", "center"}
KEEP = {"html", "body", "main", "article"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr", "picture", "source", "video", "audio", "track", "map", "area", "o:p", "nobr",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: A start tag on the left ends an open element on the right.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
#: ... but not beyond one of these.
FENCE = {"ul", "ol", "dl", "table", "select", "body", "html", "article", "main", "div", "section"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    __slots__ = ("text", "linked", "chain")

    def __init__(self, text: str, linked: int, chain: tuple[int, ...]):
        self.text, self.linked, self.chain = text, linked, chain


class Marked:
    """An element whose class, id or role is in DROP_WORDS: what is in it that would be text without the mark."""

    __slots__ = ("chars", "articles", "whole", "inner")

    def __init__(self, chars: int, articles: int, whole: bool, inner: bool):
        self.chars, self.articles = chars, articles
        self.whole, self.inner = whole, inner  # a class on its own, not a piece of one; in another marked element


class Page:
    """Blocks of a page outside what DROP and RAW exclude, and its containers.

    A word in class, id or role doesn't leave out an element around an article or main, or around most of
    the page's text, if the page has no article or main elsewhere; nor, if the word is only a piece of a class, one
    around most of the text at all. Elements with pieces of such words stay as well if nothing else would be left.
    """

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.paths: list[str] = []  # of each container, in page order
        self.tags: list[str] = []
        self.cuts: list[tuple[int, ...]] = []  # containers around each element that is left out
        spared = self._read(html, frozenset())
        if spared:
            for found in (self.blocks, self.paths, self.tags, self.cuts):
                found.clear()
            self._read(html, spared)

    def _read(self, html: str, spared: frozenset[int]) -> frozenset[int]:
        """Reads the page; gives the marked elements, by where they begin, that are not to be left out."""
        open_tags: list[tuple[str, int, bool, bool, int]] = []  # tag, container or -1, dropped, by its tag, where if marked
        chain: tuple[int, ...] = ()
        dropped = links = 0
        beside = marks = lost = articles = clean = 0  # open elements dropped by tag, marked; text and articles in marked ones
        marked: dict[int, Marked] = {}
        words: list[str] = []
        linked = 0
        at = 0

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(words).split())
            if text:
                self.blocks.append(Block(text, min(linked, len(text)), chain))
            words.clear()
            linked = 0

        def say(text: str) -> None:
            nonlocal linked, lost
            if not text:
                return
            if dropped:
                if not beside:
                    lost += sum(map(len, unescape(text).split()))
                return
            text = unescape(text)
            words.append(text)
            if links:
                linked += len(" ".join(text.split()))

        def close(k: int) -> None:
            nonlocal chain, dropped, links, beside, marks
            while len(open_tags) > k:
                tag, container, out, hard, begin = open_tags.pop()
                if container >= 0:
                    chain = chain[:-1]
                dropped -= out
                beside -= hard
                if begin >= 0:
                    marks -= 1
                    own = marked[begin]
                    own.chars, own.articles = lost - own.chars, articles - own.articles
                links -= tag == "a"

        end = len(html)
        while at < end:
            m = _TOKEN.search(html, at)
            if not m:
                say(html[at:])
                break
            say(html[at:m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            inline = tag in INLINE
            if tag == "br":
                words.append(" ")
                continue
            if not inline:
                flush()
            if m[1]:
                for k in range(len(open_tags) - 1, -1, -1):
                    if open_tags[k][0] == tag:
                        close(k)
                        break
                continue
            if tag in RAW:
                if not m[3].endswith("/"):
                    stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                    at = stop.end() if stop else (end if tag in ("script", "style") else at)
                continue
            if not inline:  # a block ends an open paragraph, and what is open in it
                for k in range(len(open_tags) - 1, -1, -1):
                    if open_tags[k][0] == "p":
                        close(k)
                        break
                    if open_tags[k][0] in FENCE:
                        break
            if tag in ENDS:
                for k in range(len(open_tags) - 1, -1, -1):
                    if open_tags[k][0] in ENDS[tag]:
                        close(k)
                        break
                    if open_tags[k][0] in FENCE:
                        break
            if tag in VOID or m[3].endswith("/"):
                continue
            names, hard, mark = self._named(tag, m[3])
            begin = m.start() if mark and not hard and not beside else -1
            out = hard or (mark > 0 and m.start() not in spared)
            if tag in ARTICLE and not beside and not hard:
                articles += marks > 0
                clean += not marks
            container = -1
            if tag in CONTAINERS and not dropped and not out:
                container = len(self.paths)
                up = chain[-1] if chain else -1
                self.paths.append((self.paths[up] + ">" if up >= 0 else "") + names)
                self.tags.append(tag)
                chain = (*chain, container)
            if out and not dropped:
                self.cuts.append(chain)
            open_tags.append((tag, container, out, hard, begin))
            dropped += out
            beside += hard
            if begin >= 0:
                marks += 1
                marked[begin] = Marked(lost, articles, mark == 2, marks > 1)
            links += tag == "a"
        flush()
        close(0)
        if spared or not marked:
            return frozenset()
        most = lost + sum(len(b.text) - b.text.count(" ") for b in self.blocks)
        keep = frozenset(begin for begin, own in marked.items() if (
            own.chars * 2 > most and not (own.whole and clean)) or (own.articles and not clean))
        if not clean and not self.blocks:  # nothing stands outside
            keep |= {begin for begin, own in marked.items() if not own.whole and not own.inner}
        return keep

    @staticmethod
    def _named(tag: str, attributes: str) -> tuple[str, bool, int]:
        """Tag with its classes, digits out; whether the element can be no part of an article; and whether its names
        say so: 1 with a piece of a name, 2 with a whole name."""
        classes, mark, hidden = [], 0, False
        for name, value in _ATTRIBUTE.findall(attributes) if attributes.strip() else ():
            name, value = name.lower(), unescape(value.strip("\"'"))
            if name == "class":
                classes = sorted({re.sub(r"\d+", "", c) for c in value.lower().split()})
            if name in ("class", "id", "role"):
                for token in value.split():
                    pieces = [x.lower() for x in _PIECES.findall(token)]
                    for k, piece in enumerate(pieces):
                        if piece in DROP_WORDS and BEFORE.isdisjoint(pieces[k - 1:k]) and AFTER.isdisjoint(pieces[k + 1:k + 2]):
                            mark = max(mark, 1 + (len(pieces) == 1))
            hidden |= name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "").lower())
        return ".".join([tag, *classes]), hidden or tag in DROP, 0 if tag in KEEP else mark

    def mass(self) -> tuple[dict[int, float], float]:
        """Text outside links in each container, and in all."""
        held: dict[int, float] = defaultdict(float)
        whole = 0.0
        for b in self.blocks:
            own = len(b.text) - b.linked if b.linked * 2 <= len(b.text) else 0.0
            whole += own
            for c in b.chain:
                held[c] += own
        return held, whole

    def best(self) -> int:
        """The deepest container with most of the page's text; -1 if there is none."""
        held, whole = self.mass()
        good = [c for c, m in held.items() if whole and m >= MAJORITY * whole]
        return max(good, key=lambda c: (self.paths[c].count(">"), -c), default=-1)

    def shared(self) -> tuple[list[int], list[int], int]:
        """Containers around all text outside link lists, outermost first and down to an article;
        of each block, how many of them hold it; and which of them the page votes for, -1 if there are none.

        A container stands for all of its path, so that an article in pieces of one path is whole.
        """

        def depth(chain: tuple[int, ...], most: int) -> int:
            for k in range(min(most, len(chain))):
                if chain[k] != common[k] and self.paths[chain[k]] != self.paths[common[k]]:
                    return k
            return min(most, len(chain))

        common: tuple[int, ...] | None = None
        for chain in dict.fromkeys(b.chain for b in self.blocks if b.linked * 2 <= len(b.text)):
            common = chain if common is None else common[:depth(chain, len(common))]
        common = common or ()
        last = next((k for k, c in enumerate(common) if self.tags[c] in ARTICLE), len(common) - 1)
        common = common[:last + 1]
        depths = {chain: depth(chain, len(common)) for chain in dict.fromkeys([*(b.chain for b in self.blocks), *self.cuts])}
        vote = last
        if common and self.tags[common[last]] not in ARTICLE:
            # down to where the last link list or left out element is left behind
            vote = max((k for k in depths.values() if k <= last), default=0)
        return list(common), [depths[b.chain] for b in self.blocks], vote

    def text(self, winners: list[str]) -> str:
        """Text of the first of the paths that is around all text outside link lists, or else of the page's own vote."""
        common, depths, vote = self.shared()
        at = {self.paths[c]: k for k, c in enumerate(common)}
        k = next((at[path] for path in winners if path in at), vote)
        return "\n".join(b.text for b, d in zip(self.blocks, depths, strict=True) if d > k)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host of each row with what its text takes: lines, and of each line how many candidates hold it.

    paths has a digest of the path of each candidate, outermost first, vote the one that the page votes
    for (-1: none), and layout a digest of host, paths and vote.
    """

    def digest(text: str) -> str:
        return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, depths, paths, votes, layouts = [], [], [], [], []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                page = Page(html.as_py() or "")
                common, depth, vote = page.shared()
                lines.append([b.text for b in page.blocks])
                depths.append(depth)
                paths.append([digest(page.paths[c]) for c in common])
                votes.append(vote)
                layouts.append(digest("\n".join([host, str(vote), *paths[-1]])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(layouts, pa.string()),
                 pa.array(paths, pa.list_(pa.string())), pa.array(votes, pa.int32()),
                 pa.array(lines, pa.list_(pa.string())), pa.array(depths, pa.list_(pa.int32()))],
                ["page_id", "url", "host", "layout", "paths", "vote", "lines", "depths"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "host", "html").mapInArrow(
        read, f"page_id {id_type}, url string, host string, layout string, paths array<string>, vote int, "
              "lines array<string>, depths array<int>")


def chosen(read: DataFrame) -> DataFrame:
    """layout, size (its pages), k: the candidate with the most votes on the host, of equal ones the page's own; -1: none."""
    layouts = stored(read.groupBy("layout").agg(
        F.first("host").alias("host"), F.first("paths").alias("paths"), F.first("vote").alias("vote"), F.count("*").alias("size")), "layouts")
    votes = layouts.filter("vote >= 0").groupBy("host", F.get("paths", F.col("vote")).alias("path")).agg(F.sum("size").alias("n"))
    tries = layouts.select("layout", "host", "vote", "size", F.posexplode_outer("paths").alias("k", "path"))
    best = F.max(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (F.col("k") == F.col("vote")).alias("own"), "k"))
    return tries.join(votes, ["host", "path"], "left").groupBy("layout").agg(
        F.first("size").alias("size"), F.coalesce(best["k"], F.lit(-1)).alias("k"))


def extract(pages: DataFrame) -> DataFrame:
    """Main text of each row of pages (page_id, url, html): page_id, url, text, n_chars, host.

    Blocks in page order, one a line, white space within a block as one space. Elements beside the
    article are left out wherever they stand. A page on which no path of its host is around all text
    outside link lists uses the container that it voted for itself. A null or empty html, or one without text,
    gives an empty text. Repeated rows are extracted each; an empty table gives no rows; other
    columns are not looked at.
    """
    read = stored(parsed(pages.select("page_id", "url", "html", host_and_path(F.col("url"))[0].alias("host"))), "pages")
    facts = stored(chosen(read), "chosen")
    total = facts.agg(F.sum("size")).first()[0] or 0
    lines = F.filter("lines", lambda line, i: F.get("depths", i) > F.col("k"))
    found = lookup(read.select("page_id", "url", "host", "layout", "lines", "depths"), facts, "layout", F.col("size"), total)
    return found.withColumn("text", F.concat_ws("\n", lines)).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "host")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).drop("host")
