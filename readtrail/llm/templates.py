"""Main text of web pages by site template removal.

Every element is hashed with all that it contains.  Spark counts, host by host, on how many
different pages a subtree occurs; subtrees that many pages of a host share are its template
and are deleted, also inside articles.  Pages whose content but for the subtree is mostly the
same text count as one, so copies and near copies do not make a template.  What then counts as the page's own text is its article (or main) element,
or else its body, without the elements that HTML or their names mark as something else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtrail.llm.common import map_rows, mix64, staged

MANY_PAGES = 5  # a template's subtree is on so many different pages of its host at least, however many it has
DRAWS = 4  # lines drawn from a page's content to tell it from others
LARGE_SHARE = 0.75  # of the content's text from which on a subtree is itself what tells pages apart

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul caption".split()
)
HEAD = frozenset("base link meta noscript script style template title".split())
DROPPED = frozenset(
    "head title script style noscript template nav footer aside button select textarea option iframe "
    "object svg math canvas audio video dialog menu search datalist".split()
)
PLAIN = frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot caption blockquote pre figcaption b i em strong a span u s "
    "small sub sup code q cite mark abbr time kbd samp var del ins font tt big br article main body html".split()
)
FRAMES = frozenset("article main body html td th li".split())  # of PLAIN, what may hold boxes
#: names in class or id, and roles, of what is not the article
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar cookie "
    "cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription comment comments "
    "commentlist respond disqus share sharing social related recommended breadcrumb breadcrumbs nav navbar "
    "navigation menu pagination pager login signup search widget widgets toolbar masthead".split()
)
#: what may stand beside those words in a name; with any other word, the name says nothing
PARTS = frozenset(
    "list box form post posts link links button buttons btn bar area section wrap wrapper container inner outer block "
    "item items header footer head foot title body content text top bottom left right slot unit zone panel group row "
    "col column field icon icons media feed card cards grid layer message info page site wp js".split()
)
EDGES = frozenset("header footer site-header site-footer page-header page-footer global-header global-footer".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
#: elements that end an open one of their kind, unless one of the second set lies between
SIBLINGS = {
    **dict.fromkeys(("li",), (frozenset(["li"]), frozenset(["ul", "ol", "menu"]))),
    **dict.fromkeys(("dt", "dd"), (frozenset(["dt", "dd"]), frozenset(["dl"]))),
    **dict.fromkeys(("td", "th"), (frozenset(["td", "th"]), frozenset(["tr", "table"]))),
    **dict.fromkeys(("tr",), (frozenset(["tr"]), frozenset(["table"]))),
    **dict.fromkeys(("option",), (frozenset(["option"]), frozenset(["select", "datalist"]))),
}
_name = re.compile(r"[a-z0-9]+")
_unseen = re.compile(r"(^|;)\s*(display\s*:\s*none|visibility\s*:\s*hidden)")


class Element:
    __slots__ = ("tag", "dropped", "hashes", "digest", "chars", "within", "content", "beside", "first", "last", "above", "marked", "prose")

    def __init__(self, tag: str, dropped: bool, within: bool, above: Element | None = None, marked: int = 0) -> None:
        self.tag, self.dropped, self.within = tag, dropped, within
        self.above = above
        self.marked = marked  # FORM, IN_NAME or BY_NAME; goes unless it holds the article
        self.prose = 0  # characters outside links and what is dropped by tag
        self.hashes: list[bytes] = []
        self.digest = 0
        self.chars = 0
        self.first = self.last = 0  # lines of the page before it, and up to its end
        self.beside = False  # whether it has text of its own, outside its elements
        self.content = False  # the article or main element itself


FORM, IN_NAME, BY_NAME = 1, 2, 3  # marks: a form, a listed word in a name, a listed word as the name


def _is_other(tag: str, attributes: list[tuple[str, str | None]], within: bool) -> bool:
    """Whether an element is something other than the article whatever it holds."""
    if tag in DROPPED or tag == "header" and not within:
        return True
    for key, value in attributes:
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "role" and value and value.lower() in ROLES:
            return True
        if key == "style" and value and _unseen.search(value.lower()):
            return True
    return False


def _mark(tag: str, attributes: list[tuple[str, str | None]], content: bool) -> int:
    """What tag and names say of an element; of an article only whole names say anything."""
    mark = FORM if tag == "form" else 0
    for key, value in attributes:
        if not value:
            continue
        if key == "role" and value.lower() == "form":
            mark = max(mark, FORM)
        if key in ("class", "id") and tag not in ("html", "body"):
            for name in value.lower().split():
                words = _name.findall(name)
                if name in NAMES or name in EDGES:
                    mark = BY_NAME
                elif not content and not NAMES.isdisjoint(words) and all(
                    w in NAMES or w in PARTS or not w.isalpha() for w in words
                ):
                    mark = max(mark, IN_NAME)
    return mark


class Page(HTMLParser):
    """The page as a flat list of texts, opened elements and, as None with a stack, closed ones."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tokens: list[str | Element | None] = []
        self.elements: list[Element] = []
        self.stack: list[Element] = []
        self.open: dict[str, int] = {}
        self.has_content = False
        #: hash, characters and element of each line of text outside links
        self.runs: list[tuple[int, int, Element]] = []
        self.line: list[str] = []
        self.feed(html)
        self.close()
        while self.stack:
            self._pop()
        self._unmark()

    def _unmark(self) -> None:
        """Take the marks off what is or holds the article, or most of its prose, then drop what is still marked.

        The article is the longest article or main element that no whole name drops, or
        else the longest of all.  A form that holds any is a page's frame.  Pages without
        one have their text in elements with more than half of the text outside links.
        """

        def path(element: Element | None) -> Iterator[Element]:
            while element:
                yield element
                element = element.above

        contents = [e for e in self.elements if e.content and e.chars]
        if contents:
            free = [e for e in contents if all(x.marked != BY_NAME for x in path(e))] if len(contents) > 1 else contents
            for element in path(max(free or contents, key=lambda e: e.prose)):
                element.marked = 0
            for content in contents:
                for element in path(content):
                    if element.marked == FORM:
                        element.marked = 0
            for element in self.elements:
                if element.marked:
                    held = next((x for x in path(element.above) if x.content), None)
                    if held and 2 * element.prose > held.prose:
                        element.marked = 0
        else:
            total = sum(e.prose for e in self.elements if e.above is None)
            for element in self.elements:
                if element.marked and 2 * element.prose > total:
                    element.marked = 0
        for element in self.elements:  # from outside inwards
            above = element.above
            element.dropped = element.dropped or bool(element.marked) or above is not None and above.dropped
        self.has_content = any(not e.dropped for e in contents)

    def _end_line(self, tag: str) -> None:
        if self.line and (tag in BLOCKS or tag not in PLAIN):
            run = " ".join(self.line).encode()
            self.runs.append((xxhash.xxh3_64_intdigest(run), sum(map(len, self.line)), self.line_of))
            self.line = []

    def _pop(self) -> None:
        element = self.stack.pop()
        self._end_line(element.tag)
        self.open[element.tag] -= 1
        self.tokens.append(None)
        element.digest = xxhash.xxh3_64_intdigest(b"\x00".join([element.tag.encode(), *element.hashes]))
        if self.stack:
            above = self.stack[-1]
            above.hashes.append(element.digest.to_bytes(8, "little"))
            above.chars += element.chars
            if element.tag != "a" and not element.dropped:
                above.prose += element.prose
        element.last = len(self.runs)

    def _pop_to(self, tag: str) -> None:
        while True:
            last = self.stack[-1].tag
            self._pop()
            if last == tag:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.tokens.append(" ")
            return
        if self.open.get("head") and tag not in HEAD and tag != "head":
            self._pop_to("head")
        if tag in BLOCKS and self.open.get("p"):
            self._pop_to("p")
        if tag in SIBLINGS:
            ended, scope = SIBLINGS[tag]
            for element in reversed(self.stack):
                if element.tag in scope:
                    break
                if element.tag in ended:
                    self._pop_to(element.tag)
                    break
        if tag in VOID:
            if tag == "hr":
                self.tokens += Element(tag, False, False), None
            return
        above = self.stack[-1] if self.stack else None
        within = above is not None and (above.within or above.content)
        dropped = above is not None and above.dropped or _is_other(tag, attrs, within)
        content = tag in ("article", "main") or ("role", "main") in attrs
        element = Element(tag, dropped, within, above, 0 if dropped else _mark(tag, attrs, content))
        self._end_line(tag)
        element.first = len(self.runs)
        element.content = content and not dropped
        self.stack.append(element)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.elements.append(element)
        self.tokens.append(element)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML knows no self-closing elements

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):
            self._pop_to(tag)

    def handle_data(self, data: str) -> None:
        words = data.split()
        if words and self.stack:
            top = self.stack[-1]
            top.hashes.append(" ".join(words).encode())
            chars = sum(map(len, words))
            top.chars += chars
            top.prose += chars
            top.beside = True
            if not top.dropped and not self.open.get("a"):
                if not self.line:
                    self.line_of = top
                self.line += words
        self.tokens.append(data)

    def may_be_template(self, element: Element) -> bool:
        """Text blocks of an article are never template by themselves, its other parts may be.

        Nor are, anywhere, parts of a text block (a bold word) or of a line of text.
        """
        if not element.chars or element.content or element.tag in ("html", "body"):
            return False
        if element.tag not in BLOCKS:
            above = element.above
            while above and above.tag not in BLOCKS:
                if above.beside:
                    return False
                above = above.above
            if above and (above.beside or above.tag in PLAIN and above.tag not in FRAMES):
                return False
        return not element.within or element.tag not in PLAIN

    def subtrees(self) -> dict[int, list[int]]:
        """Hashes, as signed 64-bit numbers, of the subtrees that may be template.

        With each go DRAWS lines (as numbers) of the page's content outside the subtree,
        drawn by hash with the odds of their lengths, so contents agree in as large a share
        of draws as they share of their text.  Nothing outside gives 0.  A subtree with
        most of the content's text is drawn from as well: what a copy adds does not vote.
        """
        some = [e for e in self.elements if not e.dropped and self.may_be_template(e)]
        if not some:
            return {}
        hashes = np.array([h for h, _, _ in self.runs], np.uint64)
        chars = np.array(
            [0 if e.dropped or self.has_content and not (e.within or e.content) else n for _, n, e in self.runs], np.float64
        )
        seeds = mix64(np.arange(1, DRAWS + 1, dtype=np.uint64))
        chance = (mix64(hashes ^ seeds[:, None]) >> np.uint64(11)).astype(np.float64) + 0.5
        with np.errstate(divide="ignore"):
            late = np.where(chars > 0, (53 * np.log(2) - np.log(chance)) / chars, np.inf)
        # the earliest line before each place and from each place on
        ends = np.full((DRAWS, 1), np.inf)
        before = np.minimum.accumulate(np.hstack((ends, late)), axis=1)
        after = np.minimum.accumulate(np.hstack((late, ends))[:, ::-1], axis=1)[:, ::-1]
        total = np.concatenate(([0.0], np.cumsum(chars)))
        keys: dict[int, list[int]] = {}
        for e in some:
            own = total[e.last] - total[e.first]
            drawn = before[:, -1] if own > LARGE_SHARE * total[-1] else np.minimum(before[:, e.first], after[:, e.last])
            keys[_signed(e.digest)] = np.where(np.isinf(drawn), 0.0, drawn).view(np.int64).tolist()
        return keys

    def text(self, template: set[int]) -> str:
        """Blocks of the article (or body) left, each on a line, white space as one space."""
        blocks: list[str] = []
        held: list[str] = []

        def end_block() -> None:
            line = " ".join("".join(held).split())
            if line:
                blocks.append(line)
            held.clear()

        shown: list[bool] = []
        tags: list[str] = []
        inside = not self.has_content
        for token in self.tokens:
            if isinstance(token, str):
                if shown[-1] if shown else inside:
                    held.append(token)
            elif token is None:
                shown.pop()
                if tags.pop() in BLOCKS:
                    end_block()
            else:
                if token.tag in BLOCKS:
                    end_block()
                outer = shown[-1] if shown else inside
                gone = token.dropped or template and _signed(token.digest) in template and self.may_be_template(token)
                shown.append((outer or token.content) and not gone)
                tags.append(token.tag)
        end_block()
        return "\n".join(blocks)


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def host(url: str = "url") -> Column:
    """Lower-case host of an address, without user, port and a leading www; empty where there is none."""
    name = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(name, r"^www\.", "")


def page_templates(pages: DataFrame) -> DataFrame:
    """`_host`, `_page` and `template`, the page's subtrees that many different pages of the host share.

    A subtree is on as many different pages as its surroundings there give different draws,
    on average over the DRAWS; see Page.subtrees.  How large the host is does not matter.
    The template stays in rows of host and subtree; a list is one page's own subtrees.
    """

    def rows(batches) -> Iterator[tuple]:
        for batch in batches:
            for name, page, html in zip(*(c.to_pylist() for c in batch.columns)):
                keys = Page(html).subtrees()
                if keys:
                    yield name, page, list(keys), list(keys.values())

    found = map_rows(
        pages.select("_host", "_page", F.coalesce("html", F.lit("")).alias("html")), rows,
        "_host string, _page binary, subtrees array<long>, keys array<array<long>>",
    )
    one = F.any_value(F.struct("subtrees", "keys")).alias("one")
    single = staged(found.groupBy("_host", "_page").agg(one).select("_host", "_page", "one.*"), "page-subtrees")
    each = single.select("_host", F.explode(F.arrays_zip("subtrees", "keys")).alias("s"))
    draws = each.select("_host", F.col("s.subtrees").alias("subtree"), F.posexplode("s.keys").alias("draw", "key"))
    counts = draws.distinct().groupBy("_host", "subtree").agg(F.count("*").alias("drawn"))
    template = counts.where(F.col("drawn") >= MANY_PAGES * DRAWS).select("_host", "subtree")
    return (
        single.select("_host", "_page", F.explode("subtrees").alias("subtree")).join(template, ["_host", "subtree"])
        .groupBy("_host", "_page").agg(F.collect_list("subtree").alias("template"))
    )


def extract(pages: DataFrame) -> DataFrame:
    """`page_id`, `url`, `text` and `n_chars` of every page.

    Null and empty html give the empty text, and so do pages of which nothing is left.
    Pages without a host in their address count as one host.  Rows are treated one by one,
    so repeated rows and ids make no difference.
    """
    types = dict(pages.dtypes)
    digest = F.unhex(F.md5(F.coalesce("html", F.lit(""))))
    named = pages.select("page_id", "url", "html").withColumns({"_host": host(), "_page": digest})
    joined = named.join(staged(page_templates(named), "page-templates"), ["_host", "_page"], "left")

    def rows(batches) -> Iterator[tuple]:
        for batch in batches:
            for page, url, html, template in zip(*(c.to_pylist() for c in batch.columns)):
                text = Page(html).text(set(template or ())) if html else ""
                yield page, url, text, len(text)

    schema = f"page_id {types['page_id']}, url string, text string, n_chars long"
    return map_rows(joined.select("page_id", "url", "html", "template"), rows, schema)
